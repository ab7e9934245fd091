"""Documents with lines that cannot be read, and gold builds of what changed."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from stopwise.config import GoldConfig
from stopwise.incremental import refresh_gold
from stopwise.jobs import build_gold, documents_or_quarantine
from stopwise.plans import tables
from stopwise.sinks import upsert
from stopwise.sinks.storage import Storage, Writes
from stopwise.sinks.table import conform
from stopwise.sources import split_documents


def test_every_line_is_good_bad_header_or_blank(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    expected, good_lines = [], 0
    for name in ("a.csv", "deep/b.csv"):
        lines = ["x,y,z"]
        for i in range(100):
            if i % 10 == 3:
                lines.append(" " if i % 20 == 3 else "")
            bad = f"{i},only" if i % 7 == 0 else f'{i},"q",z,more' if i % 11 == 0 else f'{i},"open,z' if i % 13 == 0 else None
            lines.append(bad or f'{i},"q, ""t""",')
            good_lines += bad is None
            if bad:
                expected.append((name, len(lines), bad))
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    (tmp_path / "empty.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # files in many blocks
    try:
        good, bad = split_documents(spark, str(tmp_path), ["x", "y", "z"])
        assert {(r.y, r.z) for r in good.collect()} == {('q, "t"', None)} and good.count() == good_lines
        got = sorted((r.file.split(f"{tmp_path}/")[1], r.line, r.raw) for r in bad.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(expected)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_json_lines_that_are_no_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x":1,"y":{"a":[1]}}\n[1]\nnull\n{bad\n\n"s"\n{}\n')
    good, bad = split_documents(spark, str(tmp_path), ["x", "y"], "json")
    assert [tuple(r) for r in good.collect()] == [("1", '{"a":[1]}'), (None, None)]
    assert sorted((r.line, r.raw) for r in bad.collect()) == [(2, "[1]"), (3, "null"), (4, "{bad"), (6, '"s"')]
    with pytest.raises(ValueError):
        split_documents(spark, str(tmp_path), ["x"], "xml")


def test_quarantine_is_filled_once(spark, tmp_path):
    db = f"db_{uuid.uuid4().hex}"
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / "in" / day).mkdir(parents=True)
        (tmp_path / "in" / day / "a.csv").write_text("x,y\n1,2\n3\n4,5,6\n")
    for _ in range(2):
        assert documents_or_quarantine(spark, str(tmp_path / "in"), ["x", "y"], str(tmp_path), db).count() == 2
    kept = spark.table(f"{db}.quarantined_documents").select("folder", "line", "raw").collect()
    assert sorted(map(tuple, kept)) == [(d, n, t) for d in ("2024-01-01", "2024-01-02") for n, t in ((3, "3"), (4, "4,5,6"))]


def silver(spark, folder, db):
    return tables.arrivals_predictions(folder, db), tables.meteorology_current(folder, db)


def put(spark, target, rows, schema):
    df = spark.createDataFrame(rows, schema)
    times = {n: F.col(n).cast("timestamp") for n in df.columns if n.endswith("_ts")}
    upsert(spark, target, conform(df.withColumns(times), target), stable_partitions=True)


def arrive(spark, target, *rows):
    put(spark, target, rows, "id string, event_ts string, line string, stop_id string, estimate_arrive_sec int")


def observe(spark, target, *rows):
    put(spark, target, rows, "id string, obs_ts string, temp_c double, precip_mm double")


def content(spark, warehouse, db):
    facts = spark.table(tables.arrivals_weather(warehouse, db).name).drop("build_ts")
    hours = spark.table(tables.delay_weather_hourly(warehouse, db).name).drop("build_ts")
    return [sorted(map(repr, df.collect())) for df in (facts, hours)]


@pytest.mark.parametrize("bucket_tz", [None, "Asia/Kolkata"])
def test_changes_add_up_to_a_full_build(spark, tmp_path, bucket_tz):
    config = GoldConfig(bucket_tz=bucket_tz)
    root, db, whole = str(tmp_path), f"db_{uuid.uuid4().hex}", f"db_{uuid.uuid4().hex}"
    arrivals, weather = silver(spark, root, db)
    times = spark.createDataFrame(
        [("07", "LA", "05:00", "23:00", 10, "10:00", "12:00", 5)],
        "line string, day_type string, d1_start_time string, d1_stop_time string, d1_min_freq int, "
        "d2_start_time string, d2_stop_time string, d2_min_freq int",
    )

    def refreshed():
        built = refresh_gold(spark, arrivals, weather, times, root, db, config)
        build_gold(spark, spark.table(arrivals.name), times, spark.table(weather.name), root, whole, config)
        assert content(spark, root, db) == content(spark, root, whole)
        return built

    arrive(spark, arrivals, ("a", "2024-01-02 10:05:00", "07", "S", 900), ("b", "2024-01-02 23:50:00", "07", "S", 60), ("n", None, None, "S", 1))
    observe(spark, weather, ("w", "2024-01-02 10:20:00", 8.0, 0.0))
    assert refreshed() > 24  # the day, what the observation reaches, and the rows without a time
    facts = Writes(Storage(spark, tables.arrivals_weather(root, db).location)).record["last"]
    assert refreshed() == 0
    assert Writes(Storage(spark, tables.arrivals_weather(root, db).location)).record["last"] == facts
    # an observation of the next day serves an arrival before midnight, one that comes later is nearer
    observe(spark, weather, ("x", "2024-01-03 00:10:00", 3.0, 9.0))
    assert 0 < refreshed() <= 6
    arrive(spark, arrivals, ("c", "2024-01-05 06:00:00", "07", "T", 30), ("a", "2024-01-02 10:05:00", "07", "S", 30))
    assert refreshed() == 48
    mark = Storage(spark, f"{root}/{db}").read("_built")
    assert json.loads(mark)["config"]["bucket_tz"] == bucket_tz
    times = times.withColumn("d1_min_freq", F.lit(20))  # everything is built again
    assert refreshed() > 48
