"""Runs that die in the middle of a write, and the rules of keys and columns."""

from __future__ import annotations

import ast
import random
import uuid

import pytest
from pyspark.sql import functions as F

from stopwise.operators.nested import literal_to_json
from stopwise.sinks import Table, append, compact, day_partition, ensure_table, overwrite_partitions, prefix_partition, upsert
from stopwise.sinks import storage
from stopwise.sinks.compact import data_files
from stopwise.sinks.table import MissingColumns, scan
from stopwise.sinks.upsert import probe
from test_tables import COLUMNS, FIRST, content, frame


def new_table(tmp_path, parts):
    return Table(f"db_{uuid.uuid4().hex}.t", str(tmp_path / "db" / "t"), COLUMNS, ("id",), parts)


LAYOUTS = [(), (day_partition("ts"), prefix_partition("line", 2, "line_prefix"))]
NEXT = [(2, "2024-01-01 11:00", "08", 22), (3, "2024-01-05 11:00", "", 33), (4, "2024-01-01 11:00", "07", 4)]


class Died(Exception):
    pass


WHOLE = {1: (1, "01 10:00", "07x", 1), None: (None, None, "it's", 9)}
OLD = WHOLE | {2: (2, "01 11:00", "08", 2), 3: (3, "02 11:00", "", 3)}
NEW = WHOLE | {2: (2, "01 11:00", "08", 22), 3: (3, "05 11:00", "", 33), 4: (4, "01 11:00", "07", 4)}


def steps_of_a_write(monkeypatch, spark, before):
    """Calls ``before(n)`` ahead of the n-th change of storage or catalog."""
    count = iter(range(10_000))

    def watched(owner, name):
        old = getattr(owner, name)

        def step(self, text, *more):
            if name != "sql" or text.startswith("ALTER"):
                before(next(count))
            return old(self, text, *more)

        monkeypatch.setattr(owner, name, step)

    for name in ("write", "delete", "make"):
        watched(storage.Storage, name)
    watched(type(spark), "sql")


@pytest.mark.parametrize("parts", LAYOUTS)
def test_dead_upsert_is_finished_by_the_next(spark, tmp_path, monkeypatch, parts):
    """The run dies before any change of storage or catalog; nothing is lost, with the catalog or (odd) without."""
    monkeypatch.setattr(storage, "THREADS", 1)
    for survived in range(40):
        table = new_table(tmp_path / str(survived), parts)
        upsert(spark, table, frame(spark, *FIRST))

        def before(n):
            if n == survived:
                raise Died

        with monkeypatch.context() as patch:
            steps_of_a_write(patch, spark, before)
            try:
                upsert(spark, table, frame(spark, *NEXT))
                break
            except Died:
                pass
        if survived % 2:
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
        ensure_table(spark, table)  # what every write begins with
        assert content(spark, table) in (sorted(OLD.values(), key=repr), sorted(NEW.values(), key=repr)), survived
        upsert(spark, table, frame(spark, *NEXT))
        assert {r[0]: r for r in content(spark, table)} == NEW and len(content(spark, table)) == 5
    assert survived > 5


@pytest.mark.parametrize("parts", LAYOUTS)
def test_readers_see_old_or_new_rows_of_every_partition(spark, tmp_path, monkeypatch, parts):
    """Between any two steps of a write, and with a plan made before it, a partition has its old or its new rows."""
    monkeypatch.setattr(storage, "THREADS", 1)
    table = new_table(tmp_path, parts)
    many = [(k, f"2024-01-{k % 5 + 1:02d} 10:00", "aa", k) for k in range(20)]
    upsert(spark, table, frame(spark, *many))
    earlier, seen = spark.table(table.name), []

    def read(_):
        for df in (spark.table(table.name), earlier):
            rows = df.select(F.dayofmonth("ts"), F.col("v") >= 1000).collect()
            days = {d: [new for e, new in rows if e == d] for d in range(1, 6)}
            assert all(len(x) == 4 and len(set(x)) == 1 for x in days.values())
            seen.append(tuple(all(x) for x in days.values()))

    steps_of_a_write(monkeypatch, spark, read)
    upsert(spark, table, frame(spark, *[(k, t, line, v + 1000) for k, t, line, v in many]))
    monkeypatch.undo()
    assert seen[0] == (False,) * 5 and len(set(seen)) == 2
    assert {r[3] for r in content(spark, table)} == {k + 1000 for k in range(20)}


def test_row_groups_without_a_key_are_skipped(spark, tmp_path):
    """Keys strewn over all files: statistics cannot exclude a row group, Bloom filters do."""
    table = new_table(tmp_path, (day_partition("ts"),))
    rows = spark.range(200_000).selectExpr("id * 7919 % 200000 AS id", "timestamp_seconds(1704067200 + id % 40 * 86400) AS ts", "'a' AS line", "1 AS v")
    upsert(spark, table, rows, stable_partitions=True)
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
    try:
        found = probe(spark, table, spark.createDataFrame([(11,), (7919,)], "id bigint"))
        assert len(found.collect()) == 2
        nodes = [found._jdf.queryExecution().executedPlan()]
        read = 0
        while nodes:
            node = nodes.pop()
            if node.metrics().contains("numFiles"):
                read = node.metrics().apply("numOutputRows").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.parquet.pushdown.inFilterThreshold")
    assert spark.table(table.name).count() == 200_000 and 2 <= read < 100_000


def test_touched_folders_are_all_that_is_read(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    table = new_table(tmp_path, (day_partition("ts"),))
    upsert(spark, table, frame(spark, *[(d, f"2024-01-{d:02d} 10:00", "a", d) for d in range(1, 20)]))
    read, old = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **o: (read.extend(paths), old(self, *paths, **o))[1])
    upsert(spark, table, frame(spark, (3, "2024-01-03 10:00", "a", 33)), stable_partitions=True)
    assert [p.rsplit("/", 2)[1] for p in read if "event_date" in p] == ["event_date=2024-01-03"]  # below it the write
    assert len(content(spark, table)) == 19


def test_missing_columns_are_an_error_in_an_upsert(spark, tmp_path):
    table = new_table(tmp_path, ())
    with pytest.raises(MissingColumns):
        upsert(spark, table, frame(spark, *FIRST).drop("v"))


def test_names_match_in_any_case(spark, tmp_path):
    table = new_table(tmp_path, ())
    append(spark, table, frame(spark, *FIRST).withColumnRenamed("line", "LINE"))
    assert spark.table(table.name).columns == list(COLUMNS)
    assert {r[2] for r in content(spark, table)} == {"07x", "08", "", "it's"}


def test_latest_needs_an_order(spark, tmp_path):
    with pytest.raises(ValueError, match="latest_by"):
        upsert(spark, new_table(tmp_path, ()), frame(spark, *FIRST), on_duplicate="latest")


def test_null_safe_keys_are_replaced(spark, tmp_path):
    table = Table(f"db_{uuid.uuid4().hex}.t", str(tmp_path / "db" / "t"), COLUMNS, ("ts", "line"), (day_partition("ts"),))
    for v in (1, 2):
        upsert(spark, table, frame(spark, (1, "2024-01-01 10:00", None, v)), null_safe=True)
    assert [r[3] for r in content(spark, table)] == [2]


def test_two_zones_keep_one_row_per_key(spark, tmp_path):
    table = new_table(tmp_path, (day_partition("ts"),))
    rows = spark.sql("SELECT 1L AS id, timestamp_seconds(1704153600 - 600) AS ts, 'a' AS line, 1 AS v")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            upsert(spark, table, rows, stable_partitions=True)
            assert scan(spark, table, between=("ts", F.timestamp_seconds(F.lit(1704153000)), None)).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert spark.table(table.name).count() == 1


def test_partition_values_do_not_follow_the_zone(spark):
    from stopwise.functions import utc_date, utc_hour_key, utc_text

    df = spark.sql("SELECT timestamp_micros(x) AS t FROM VALUES (1704153000000000L), (-1500000L), (1711846799123450L), (NULL) v(x)")
    shown = df.select(utc_date(F.col("t")).cast("string"), utc_hour_key(F.col("t")), utc_text(F.col("t")))
    try:
        for zone in ("UTC", "Europe/Madrid", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [tuple(r) for r in shown.collect()] == [
                ("2024-01-01", "2024-01-01-23", "2024-01-01 23:50:00"),
                ("1969-12-31", "1969-12-31-23", "1969-12-31 23:59:58.5"),
                ("2024-03-31", "2024-03-31-00", "2024-03-31 00:59:59.12345"),
                (None, None, None),
            ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_compaction_obeys_its_target(spark, tmp_path):
    table = new_table(tmp_path, (day_partition("ts"),))
    rows = spark.range(40_000).selectExpr(
        "id", "timestamp'2024-01-01 10:00:00' AS ts", "sha2(cast(id AS string), 256) AS line", "1 AS v"
    )
    for k in range(12):
        append(spark, table, rows.where(f"id % 12 = {k}").coalesce(1))
    size = data_files(spark, table).first()["bytes"]
    target = size // 3
    assert compact(spark, table, target) == 1
    after = data_files(spark, table).first()
    assert after["files"] in (3, 4) and spark.table(table.name).count() == 40_000
    assert compact(spark, table, target) == 0


def test_overwrite_of_a_dead_append(spark, tmp_path):
    table = new_table(tmp_path, LAYOUTS[1])
    overwrite_partitions(spark, table, frame(spark, *FIRST))
    append(spark, table, frame(spark, *FIRST))
    assert len(content(spark, table)) == 8


def random_literal(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 2:
        alphabet = "abN'\"\\,:[]{} é日Nonetruex0\n\t"
        return "".join(rng.choice(alphabet) for _ in range(rng.randrange(8))) + rng.choice(["", "None", ", True,", "\\x41"])
    if kind < 5:
        return rng.choice([None, True, False, 0, -3, 12, 2.5])
    if kind == 5:
        return {f"k{n}'": random_literal(rng, depth + 1) for n in range(rng.randrange(3))}
    return [random_literal(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_literals_become_the_json_they_mean(spark):
    import json

    rng = random.Random(11)
    values = [[random_literal(rng) for _ in range(rng.randrange(4))] for _ in range(400)] + [["x" * 100_000 + "'\""]]
    texts = [repr(v) for v in values] + ["['a', 'None, b',]", "[\"it's\", None]"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for row in df.select("k", literal_to_json(F.col("text")).alias("json")).collect():
        assert json.loads(row["json"]) == ast.literal_eval(texts[row["k"]]), texts[row["k"]]
