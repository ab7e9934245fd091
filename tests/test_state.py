"""Streams with state: late rows, repeats, nearest observation; and the folding of live batches."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from catalogue import streams
from stopwise import jobs
from stopwise.operators import nearest_join
from stopwise.plans.tables import delay_weather_hourly, live_weather, meteorology_current
from stopwise.streaming import live as live_module, stream_messages, write_live
from stopwise.streaming.live import dead_letter_table
from stopwise.streaming.state import deduplicated, late_rows, nearest_in_streams, roll_up_hours, write_rollup, write_rows

ONCE = {"availableNow": True}
FACTS = "event_ts timestamp, line string, delayed boolean, weather_adverse boolean, delay_weather_attributed boolean, temp_c double, wind_kph double, precip_mm double"


def files(spark, folder, schema, *batches):
    """A stream that reads one batch of rows after the other."""
    for rows in batches:
        df = spark.createDataFrame([], schema) if not rows else spark.sql(f"SELECT * FROM VALUES {', '.join(rows)}").toDF(*[c.split(" ")[0] for c in schema.split(", ")])
        cast = [F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in schema.split(", ")]
        df.select(*cast).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)


def fact(time, line="'a'", delayed="true"):
    return f"('{time}', {line}, {delayed}, true, false, 1, 2, 3)"


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    stream = files(
        spark, str(tmp_path / "in"), FACTS,
        [fact("2024-01-01 10:05"), fact("2024-01-01 10:50", delayed="false"), fact("2024-01-01 10:10", "null")],
        [fact("2024-01-01 12:30"), fact("2024-01-01 10:59")],  # the watermark is 09:50: in time
        [fact("2024-01-01 20:00")],
        [fact("2024-01-01 10:30", "'late'"), fact("2024-01-01 20:10")],  # the watermark is 19:00
    )
    hourly = delay_weather_hourly(str(tmp_path), f"db_{uuid.uuid4().hex}")
    query = write_rollup(roll_up_hours(stream, "1 hour"), hourly, str(tmp_path / "checkpoint"), ONCE)
    query.awaitTermination()
    got = spark.table(hourly.name).select(F.hour("event_hour"), "line", "total_preds", "delayed_preds", "avg_temp_c").collect()
    assert sorted(map(tuple, got), key=repr) == [(10, "a", 3, 2, 1.0), (10, None, 1, 1, 1.0), (12, "a", 1, 1, 1.0), (20, "a", 2, 2, 1.0)]
    assert late_rows(query) == 1


def test_quarters_land_by_many_tasks_one_batch_each(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).selectExpr("id", "timestamp_seconds(id) AS ts", "IF(id = 7, NULL, id) AS __part")
    tasks, batches = [], []

    def start(stream):
        def note(batch, _):
            if batch.count():
                tasks.append(len(batch.select(F.input_file_name()).distinct().collect()))
                batches.append({r.id % 4 for r in batch.select("id").collect()})

        return stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(**ONCE).foreachBatch(note).start()

    streams._run_landing(rows, str(tmp_path), start)
    assert batches == [{0}, {1}, {2}, {3}] and min(tasks) > 1
    assert spark.read.parquet(str(tmp_path / "in")).count() == 3999  # a row without a number lands nowhere


def test_repeats_within_the_watermark_go(spark, tmp_path):
    schema = "id string, ts timestamp"
    rows = ["('a', '2024-01-01 10:00')", "('b', '2024-01-01 10:10')", "(null, '2024-01-01 10:00')"]
    stream = files(spark, str(tmp_path / "in"), schema, rows + rows[:1], rows, ["('c', '2024-01-01 11:00')", rows[0]])
    found = deduplicated(stream, ["id"], "ts", "2 hours")
    write_rows(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ONCE).awaitTermination()
    assert sorted((r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == ["a", "b", "c", None]


@pytest.mark.parametrize("mode", ["slot", "exact"])
def test_nearest_of_two_streams(spark, tmp_path, mode):
    beat = "2030-01-01 00:00"
    events = files(
        spark, str(tmp_path / "events"), "id string, at timestamp",
        ["('tie', '2024-01-01 10:00')", "('later', '2024-01-01 12:40')", "('far', '2024-01-01 14:20')", "('none', '2024-01-02 10:00')"],
        [f"(null, '{beat}')"],
    )
    weather = files(
        spark, str(tmp_path / "weather"), "obs string, seen timestamp, temp int",
        ["('w2', '2024-01-01 10:05', 2)", "('w1', '2024-01-01 09:55', 1)", "('w0', '2024-01-01 09:55', 0)"],
        ["('w3', '2024-01-01 13:01', 3)"],  # 79 minutes from 'far': within the slots, not within the hour
        [f"('x', '{beat}', 9)"],
    )
    found = nearest_in_streams(events, weather, "at", "seen", "obs", ["id"], "1 hour", mode=mode)
    write_rows(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ONCE).awaitTermination()
    got = {r.id: (r.obs, r.temp) for r in spark.read.parquet(str(tmp_path / "out")).where("id IS NOT NULL").collect()}
    far = ("w3", 3) if mode == "slot" else (None, None)
    assert got == {"tie": ("w0", 0), "later": ("w3", 3), "far": far, "none": (None, None)}


@pytest.mark.parametrize("mode", ["slot", "exact"])
def test_streams_meet_in_cells_not_in_pairs(spark, tmp_path, mode):
    """Many observations a slot, several a second and some borders bare: the rows of ``nearest_join``, one state row an event."""
    start, beat = 1704067200, 2000000000
    moments = {  # seconds with a fraction, so that whole seconds repeat
        "events": spark.range(400).selectExpr("string(id) AS id", f"timestamp_micros(({start} + id * 7919 % 43200) * 1000000 + id) AS at"),
        "weather": spark.range(900).selectExpr(
            "concat('w', id) AS obs",
            f"timestamp_micros(({start} + 3600 * (id % 4) * 3 + id * 613 % 4000 DIV 3 * 3) * 1000000 + id % 3) AS seen", "int(id % 50) AS temp",
        ),
    }
    streams = []
    for name, rows in moments.items():
        rows.write.parquet(str(tmp_path / name))
        last = [F.timestamp_seconds(F.lit(beat)) if kind == "timestamp" else F.lit(None).cast(kind) for _, kind in rows.dtypes]
        spark.range(1).select(*[c.alias(n) for c, n in zip(last, rows.columns)]).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(rows.schema).parquet(str(tmp_path / name)))
    found = nearest_in_streams(*streams, "at", "seen", "obs", ["id"], "1 hour", mode=mode)
    query = write_rows(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ONCE)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("id IS NOT NULL").select("id", "seen", "obs", "temp").collect()
    same = nearest_join(moments["events"], moments["weather"], "at", "seen", "obs", ["id"], mode=mode)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, same.select("id", "seen", "obs", "temp").collect()), key=repr)
    joins = [o for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"] == "symmetricHashJoin"]
    assert joins and sum(o["numRowsUpdated"] for o in joins) <= 402


@pytest.mark.parametrize("dies_in", ["append", "drop_folded", None])
def test_fold_takes_every_batch_once(spark, tmp_path, monkeypatch, dies_in):
    database, folder = f"db_{uuid.uuid4().hex}", str(tmp_path)
    good, dead = live_weather(folder, database), dead_letter_table(f"{database}.dead", f"{folder}/dead")

    def send(*minutes):
        rows = [f'{{"last_updated_epoch": {1704067200 + 60 * m}, "last_updated": "2024-01-01 00:{m:02d}", "temp_c": {m}}}' for m in minutes]
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
        write_live(stream_messages(spark, f"{folder}/in"), good, dead, f"{folder}/checkpoint", ONCE).awaitTermination()

    def fold():
        return jobs.fold_live(spark, folder, database, folder, database)

    send(1, 2)
    if dies_in:
        with monkeypatch.context() as patch:
            patch.setattr(jobs, dies_in, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                fold()
    assert fold() == (0 if dies_in == "drop_folded" else 1)
    send(3)
    read, old = [], live_module.observations_from_live
    monkeypatch.setattr(jobs, "observations_from_live", lambda df: (read.append(df.count()), old(df))[1])
    assert fold() == 1 and fold() == 0 and read == [1]
    observed = spark.table(meteorology_current(folder, database).name)
    assert sorted(r.temp_c for r in observed.collect()) == [1.0, 2.0, 3.0]
    assert spark.table(good.name).count() == 0 and spark.sql(f"SHOW PARTITIONS {good.name}").count() == 0
