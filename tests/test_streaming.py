from __future__ import annotations

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from stopwise.plans.tables import live_weather
from stopwise.schemas import METEOROLOGY_CURRENT
from stopwise.streaming import (
    decoded_path,
    live_rows,
    observations_from_live,
    parse_messages,
    route,
    stream_files,
    stream_messages,
    write_bronze,
    write_live,
)
from stopwise.streaming.live import dead_letter_table

ONCE = {"availableNow": True}
GOOD = [
    json.dumps({"last_updated_epoch": 1759655700, "last_updated": "2025-10-05 12:15", "temp_c": 20.1, "humidity": 55.0,
                "condition": {"text": "Sunny", "code": 1000}, "air_quality": {"co": 1.5, "us-epa-index": 2}}),
    json.dumps({"location": {"name": "x"}, "current": {"last_updated_epoch": "1759655701", "temp_c": "abc", "uv": "7"}}),
    "{}",
    '{"current": 5, "temp_c": 3}',
]
BAD = {
    "": "empty",
    "[1,2]": "not an object",
    "5": "not an object",
    "null": "not an object",
    '[{"temp_c": 9}]': "not an object",
    '{"a":1} xyz': "invalid json",
    '{"temp_c": 1}{"temp_c": 2}': "invalid json",
    '{"temp_c":1},{"temp_c":2}': "invalid json",
    '{"temp_c": ': "invalid json",
}


@pytest.fixture
def live(spark, tmp_path):
    """``run(lines)`` adds a file of messages and runs the stream over what is new."""
    db = f"live_{uuid.uuid4().hex}"
    good = live_weather(str(tmp_path), db)
    dead = dead_letter_table(f"{db}.dead", str(tmp_path / db / "dead"))
    os.makedirs(tmp_path / "in")

    def run(lines):
        (tmp_path / "in" / f"{uuid.uuid4().hex}.txt").write_text("".join(f"{x}\n" for x in lines))
        messages = stream_messages(spark, str(tmp_path / "in"))
        write_live(messages, good, dead, str(tmp_path / "checkpoint"), ONCE).awaitTermination()
        return spark.table(good.name), spark.table(dead.name)

    run.checkpoint = tmp_path / "checkpoint"
    return run


def test_every_message_ends_in_one_table(live):
    good, dead = live([*GOOD, *BAD])
    assert {bytes(r.value).decode(): r.reason for r in dead.collect()} == BAD
    assert good.count() == len(GOOD)
    first = good.where("ts_epoch = 1759655700").first()
    assert (first.temperature_celsius, first.humidity, first.raw_partition_key) == (20.1, 55, "1759655700")
    assert first.weather_condition == '{"text": "Sunny", "code": 1000}' or json.loads(first.weather_condition)["code"] == 1000
    second = good.where("ts_epoch = 1759655701").first()
    assert (second.temperature_celsius, second.uv_index) == (None, 7.0)
    assert good.where("temperature_celsius = 3").count() == 1


def test_restart_takes_only_what_is_new(live):
    live([*GOOD, *BAD])
    good, dead = live([GOOD[0], "broken"])
    assert (good.count(), dead.count()) == (len(GOOD) + 1, len(BAD) + 1)


def test_replayed_batch_leaves_no_copies(live):
    live([GOOD[0], "broken"])
    # The batch is written but its commit is lost, as after a crash.
    for name in os.listdir(live.checkpoint / "commits"):
        os.unlink(live.checkpoint / "commits" / name)
    good, dead = live([])
    assert (good.count(), dead.count()) == (1, 1)


def test_batch_and_stream_agree(spark, live):
    good, _ = live([*GOOD, *BAD])
    messages = spark.createDataFrame([(m, None) for m in [*GOOD, *BAD]], "value string, partition_key string")
    batch = live_rows(parse_messages(messages)).drop("ingest_time")
    assert sorted(map(repr, batch.collect())) == sorted(map(repr, good.select(*batch.columns).collect()))


def test_live_rows_become_observations(live):
    good, _ = live(GOOD)
    got = {r.temp_c: r for r in observations_from_live(good).collect()}
    assert set(got) == {20.1, None}
    assert list(got[20.1].asDict()) == list(METEOROLOGY_CURRENT)
    assert (got[20.1].air_co, got[20.1].air_us_epa_index, got[20.1].condition_text, got[20.1].condition_code) == (1.5, 2, "Sunny", 1000)


@pytest.mark.parametrize(
    ("path", "domain"),
    [("s3://b/raw/city/arrivals/x.csv", "arrivals"), ("/raw/meteorology/x", "meteorology"), ("/raw/other/x", None), (None, None)],
)
def test_routing(spark, path, domain):
    df = spark.createDataFrame([(path,)], "source_path string")
    assert route(df).first().domain == domain


def test_paths_are_decoded(one):
    assert one("p string", ("/raw/a%20b+c%25",), decoded_path(F.col("p"))) == ("/raw/a b+c%",)
    assert one("p string", ("/raw/100%",), decoded_path(F.col("p"))) == ("/raw/100%",)


@pytest.mark.parametrize("source_format", ["text", "binaryFile"])
def test_bronze(spark, tmp_path, source_format):
    for folder in ("arrivals/d 1", "lines", "odd"):
        os.makedirs(tmp_path / "raw" / folder)
        (tmp_path / "raw" / folder / "f.txt").write_text("l1\nl2\n")
    for _ in range(2):
        files = stream_files(spark, str(tmp_path / "raw"), source_format)
        write_bronze(files, str(tmp_path / "out"), str(tmp_path / "checkpoint"), trigger=ONCE).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    per_file = 2 if source_format == "text" else 1
    assert {r["domain"]: r["count"] for r in got.groupBy("domain").count().collect()} == {
        "arrivals": per_file, "lines": per_file, None: per_file,
    }
    moved = got.where("domain = 'arrivals'").first()
    assert moved.bronze_path.endswith("/bronze/arrivals/d 1/f.txt") and (tmp_path / "raw" / "lines" / "f.txt").exists()


def test_failed_bytes_are_kept_and_checkpoints_do_not_meet(spark, tmp_path):
    db = f"live_{uuid.uuid4().hex}"
    good = live_weather(str(tmp_path), db)
    dead = dead_letter_table(f"{db}.dead", str(tmp_path / db / "dead"))
    raw = b'{"temp_c": "\xff\xfe"}'
    for k in range(2):
        os.makedirs(tmp_path / f"in{k}")
        (tmp_path / f"in{k}" / "a.txt").write_bytes(raw + b"\n" + GOOD[0].encode() + b"\n")
        messages = stream_messages(spark, str(tmp_path / f"in{k}"))
        write_live(messages, good, dead, str(tmp_path / f"checkpoint{k}"), ONCE).awaitTermination()
    failed = spark.table(dead.name).collect()
    assert [(bytes(r.value), r.reason) for r in failed] == [(raw, "not utf-8")] * 2
    assert spark.table(good.name).count() == 2
