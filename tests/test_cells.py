"""Cells are parsed no more often than needed, and come out as they would by the plain way."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.functions import json_int
from stopwise.operators import parse_json_array
from stopwise.operators.nested import literal_to_json
from stopwise.plans import parse_arrivals, predictions

ITEMS = "struct<n:string, t:string>"
CELLS = [
    "[]", " [] ", "[ ]", "[[]]", "", " ", None, "null", "{}", '{"n": 1}', "[{broken", "[1] True", "[{'n': 1,}]", '[{"n": 1},]',
    "[{'t': 'a\\'b'}]", "[{'t': 'a\"b'}]", '[{"t": "a\'b", "n": None}]', '[{"t": "x, None, True,]"}]', "[{'t': '\\x41', 'n': True}]",
    '[{"t": "a\\\\", "n": False}]', "[{'n': Nonesuch}]", "[{'n': 1.5, 't': {'k': None}}]", "[None]", "[,]", "['", "[\"\\", "[{'n': 1}] , ]",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_as_by_two_plain_parses(spark):
    df = spark.createDataFrame(list(enumerate(CELLS)), "i int, cell string")
    array, text = f"array<{ITEMS}>", F.col("cell")
    twice = F.coalesce(F.from_json(text, array), F.from_json(literal_to_json(text), array))
    plain = df.select("i", twice.alias("items"), (text.isNotNull() & twice.isNull()).alias("bad"))
    got = parse_json_array(df, "cell", ITEMS, "items").select("i", "items", F.col("items_bad").alias("bad"))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_empty_and_unchanged_cells_are_not_parsed(spark):
    df = spark.createDataFrame([("[]",)], "cell string")
    text = plan(parse_json_array(df, "cell", ITEMS, "items").select("items"))
    assert text.count("from_json(") == 2  # the cell, and what the rewriting changed
    assert "= []) THEN [] ELSE from_json(" in text
    assert "CASE WHEN NOT (__items_rewritten" in text


def test_time_of_a_key_is_written_once_a_poll(spark):
    raw = spark.createDataFrame([("t", "[]", "[]", "1", "2")], "timestamp string, arrive string, stopinfo string, stopid string, line string")
    above = plan(predictions(parse_arrivals(raw))).split("Generate explode")[0]
    assert "sha2(" in above and "unix_seconds(" not in above


def test_whole_numbers_as_by_the_plain_cast(spark):
    texts = ["7", " 7 ", "+5", "-3", "007", "17.0", ".", "1.", "1e3", "", "2147483648", "seven", "\t8\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", json_int(F.col("t")).alias("got"), F.col("t").try_cast("int").alias("plain")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.plain) for r in rows]
    assert "Contains(" in plan(df.select(json_int(F.col("t"))))  # a fraction raises no error inside the cast
