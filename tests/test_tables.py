from __future__ import annotations

import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from stopwise.sinks import (
    Partition,
    Table,
    append,
    compact,
    day_partition,
    ensure_table,
    full_refresh,
    hour_partition,
    merge_into,
    overwrite_partitions,
    prefix_partition,
    upsert,
)
from stopwise.sinks.compact import data_files
from stopwise.sinks.drift import TypeDrift, wider
from stopwise.sinks.table import scan
from stopwise.sinks.upsert import DuplicateKeys

COLUMNS = {"id": "bigint", "ts": "timestamp", "line": "string", "v": "int"}


@pytest.fixture
def table(tmp_path):
    parts = (day_partition("ts"), prefix_partition("line", 2, "line_prefix"))
    return Table(f"db_{uuid.uuid4().hex}.t", str(tmp_path / "db" / "t"), COLUMNS, ("id",), parts)


def frame(spark, *rows):
    df = spark.createDataFrame(rows, "id bigint, ts string, line string, v int")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def content(spark, table):
    df = spark.table(table.name).select("id", F.date_format("ts", "dd HH:mm").alias("ts"), "line", "v")
    return sorted((tuple(r) for r in df.collect()), key=repr)


FIRST = [(1, "2024-01-01 10:00", "07x", 1), (2, "2024-01-01 11:00", "08", 2), (3, "2024-01-02 11:00", "", 3), (None, None, "it's", 9)]
NEXT = [(2, "2024-01-03 10:00", "08", 22), (4, "2024-01-01 11:00", "07", 4), (5, None, None, 5)]
AFTER = [
    (1, "01 10:00", "07x", 1), (2, "03 10:00", "08", 22), (3, "02 11:00", "", 3), (4, "01 11:00", "07", 4),
    (5, None, None, 5), (None, None, "it's", 9),
]


def test_upsert_moves_keys_and_is_idempotent(spark, table):
    upsert(spark, table, frame(spark, *FIRST))
    for _ in range(2):
        upsert(spark, table, frame(spark, *NEXT))
        assert content(spark, table) == sorted(AFTER, key=repr)
    partitions = [r[0] for r in spark.sql(f"SHOW PARTITIONS {table.name}").collect()]
    assert "event_date=2024-01-01/line_prefix=08" not in partitions and len(partitions) == 5


def test_upsert_without_partitions(spark, tmp_path):
    flat = Table(f"db_{uuid.uuid4().hex}.t", str(tmp_path / "db" / "t"), COLUMNS, ("id",))
    upsert(spark, flat, frame(spark, *FIRST))
    upsert(spark, flat, frame(spark, *NEXT))
    assert content(spark, flat) == sorted(AFTER, key=repr)


def test_null_keys_are_inserted_every_time(spark, table):
    for _ in range(2):
        upsert(spark, table, frame(spark, (None, "2024-01-01 10:00", "a", 1)))
    assert len(content(spark, table)) == 2


def test_duplicate_rules(spark, table):
    twice = frame(spark, (1, "2024-01-01 10:00", "a", 1), (1, "2024-01-01 10:00", "a", 2))
    with pytest.raises(DuplicateKeys):
        upsert(spark, table, twice)
    assert content(spark, table) == []
    upsert(spark, table, twice, on_duplicate="latest", latest_by=[F.col("v").desc()])
    assert content(spark, table) == [(1, "01 10:00", "a", 2)]


def test_upsert_projects_to_the_table(spark, table):
    upsert(spark, table, frame(spark, *FIRST).withColumn("noise", F.lit(1)))
    assert spark.table(table.name).columns == [*COLUMNS, "event_date", "line_prefix"]
    assert {r[2] for r in content(spark, table)} == {"07x", "08", "", "it's"}


def test_composite_key(spark, tmp_path):
    both = Table(f"db_{uuid.uuid4().hex}.t", str(tmp_path / "db" / "t"), COLUMNS, ("ts", "line"), (day_partition("ts"),))
    upsert(spark, both, frame(spark, (1, "2024-01-01 10:00", "a", 1), (2, "2024-01-01 10:00", "b", 2)))
    upsert(spark, both, frame(spark, (9, "2024-01-01 10:00", "a", 9)), stable_partitions=True)
    assert content(spark, both) == [(2, "01 10:00", "b", 2), (9, "01 10:00", "a", 9)]


def test_ensure_leaves_data_and_reopens(spark, table):
    assert ensure_table(spark, table)
    upsert(spark, table, frame(spark, *FIRST))
    assert not ensure_table(spark, table)
    assert len(content(spark, table)) == 4
    spark.sql(f"DROP TABLE {table.name}")
    assert ensure_table(spark, table)
    assert len(content(spark, table)) == 4


def test_dynamic_overwrite_keeps_other_partitions(spark, table):
    overwrite_partitions(spark, table, frame(spark, *FIRST))
    overwrite_partitions(spark, table, frame(spark, (7, "2024-01-01 12:00", "07", 7)))
    assert [r[0] for r in content(spark, table)] == [2, 3, 7, None]


def test_append_adds_columns(spark, table):
    append(spark, table, frame(spark, *FIRST))
    grown = append(spark, table, frame(spark, *NEXT).withColumn("note", F.lit("n")).drop("v"))
    assert "note" in grown.columns
    got = spark.table(table.name).where("id = 4 OR id = 1").orderBy("id").select("id", "v", "note").collect()
    assert [tuple(r) for r in got] == [(1, 1, None), (4, None, "n")]


def test_compaction_keeps_rows(spark, table):
    for row in FIRST * 3:
        append(spark, table, frame(spark, row))
    before = content(spark, table)
    assert data_files(spark, table).agg(F.max("files")).first()[0] == 3
    assert compact(spark, table) == 4
    assert compact(spark, table) == 0
    assert content(spark, table) == before
    assert data_files(spark, table).agg(F.max("files")).first()[0] == 1


def test_clustered_compaction_prunes_files(spark, table):
    rows = [(i, f"2024-01-0{1 + i % 2} {i % 24:02}:00", f"L{i // 7 % 40:02}", i) for i in range(4000)]
    for k in range(5):
        append(spark, table_by_day(table), frame(spark, *rows[k::5]))
    day = table_by_day(table)
    before, size = content(spark, day), data_files(spark, day).agg(F.max("bytes")).first()[0]
    wanted = spark.table(day.name).where("line = 'L07'")
    assert files_holding(spark, day, "L07") >= 10
    assert compact(spark, day, size // 6, cluster_by=["line", "ts"], every=True) == 2
    assert content(spark, day) == before
    assert files_holding(spark, day, "L07") <= 4
    spark.catalog.refreshTable(day.name)
    assert wanted.count() == sum(r[2] == "L07" for r in rows)


def table_by_day(table):
    return Table(table.name, table.location, COLUMNS, ("id",), (day_partition("ts"),))


def files_holding(spark, table, line):
    """Files whose statistics do not exclude the value."""
    found = 0
    for path in spark.table(table.name).inputFiles():
        groups = pq.ParquetFile(path.removeprefix("file://")).metadata
        stats = [groups.row_group(g).column(2).statistics for g in range(groups.num_row_groups)]
        found += any(s.min <= line <= s.max for s in stats)
    return found


def test_wider_types():
    kind = lambda text: _parse_datatype_string(f"c {text}")[0].dataType
    for stored, incoming, expected in [
        ("int", "bigint", "bigint"), ("bigint", "tinyint", "bigint"), ("int", "float", "double"), ("float", "double", "double"),
        ("int", "double", "double"), ("decimal(7,1)", "decimal(12,3)", "decimal(12,3)"), ("decimal(7,3)", "decimal(9,1)", "decimal(11,3)"),
        ("decimal(4,1)", "int", "decimal(11,1)"), ("string", "string", "string"), ("int", "void", "int"),
        ("bigint", "double", None), ("double", "bigint", None), ("string", "int", None), ("date", "timestamp", None),
        ("decimal(38,0)", "decimal(38,10)", None), ("int", "decimal(5,2)", None),
    ]:
        got = wider(kind(stored), kind(incoming))
        assert (got and got.simpleString()) == expected, (stored, incoming)


def test_append_widens_and_refuses(spark, table):
    append(spark, table, frame(spark, *FIRST))
    wide = append(spark, table, frame(spark, *NEXT).withColumn("v", F.col("v") + F.lit(5_000_000_000)))
    assert wide.columns["v"] == "bigint" and dict(spark.table(table.name).dtypes)["v"] == "bigint"
    assert [r.v for r in spark.table(table.name).where("id IN (1, 4)").orderBy("id").collect()] == [1, 5_000_000_004]
    files = len(spark.table(table.name).inputFiles())
    # whole numbers in a text column fit; other texts do not, and then nothing is written
    append(spark, table, frame(spark, (7, "2024-01-01 10:00", "07x", 7)).withColumn("v", F.lit("77")))
    assert spark.table(table.name).where("id = 7").first().v == 77
    for bad in (F.lit("seven"), F.lit("1.5"), F.lit(2.5), F.lit(1e30), F.array(F.lit(1)), F.create_map(F.lit(1), F.lit(2))):
        with pytest.raises(TypeDrift):
            append(spark, table, frame(spark, (8, "2024-01-01 10:00", "07x", 8)).withColumn("v", bad))
    with pytest.raises(TypeDrift):  # partitions hang on it
        append(spark, Table(f"{table.name}2", f"{table.location}2", {"k": "int"}, (), (by_remainder(),)), spark.range(3).selectExpr("id AS k"))
    assert spark.table(table.name).where("id = 8").count() == 0 and len(spark.table(table.name).inputFiles()) >= files


def by_remainder():
    return Partition("part", "int", "k", lambda c: F.pmod(c, F.lit(3)).cast("int"), monotone=False)


def test_added_and_widened_columns_outlive_rewrites(spark, table):
    """Upsert and compaction with the first declaration keep what appends have added."""
    append(spark, table, frame(spark, *FIRST))
    append(spark, table, frame(spark, *NEXT[1:2]).withColumns({"note": F.lit("n"), "v": F.lit(6_000_000_000)}))
    upsert(spark, table, frame(spark, (9, "2024-01-01 11:00", "07", 9)))
    for row in FIRST[:3]:
        append(spark, table, frame(spark, row).withColumn("id", F.col("id") + 100))
    compact(spark, table)
    got = {r.id: (r.v, r.note) for r in spark.table(table.name).where("id IN (1, 4, 9)").collect()}
    assert got == {1: (1, None), 4: (6_000_000_000, "n"), 9: (9, None)}


def test_full_refresh_replaces_schema(spark, tmp_path):
    name = f"db_{uuid.uuid4().hex}.t"
    full_refresh(spark, name, str(tmp_path / "db" / "t"), spark.range(5))
    full_refresh(spark, name, str(tmp_path / "db" / "t"), spark.range(2).selectExpr("id", "'x' AS note"))
    assert spark.table(name).columns == ["id", "note"] and spark.table(name).count() == 2


def test_time_bounds_prune_partitions(spark, tmp_path):
    hourly = Table(f"db_{uuid.uuid4().hex}.t", str(tmp_path / "db" / "t"), COLUMNS, ("id",), (hour_partition("ts", "hour"),))
    overwrite_partitions(spark, hourly, frame(spark, *FIRST[:3]))
    df = scan(spark, hourly, ["id"], ("ts", "2024-01-01 11:00:00", "2024-01-01 23:00:00"))
    assert [r.id for r in df.collect()] == [2]
    assert len(df.inputFiles()) == 1
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(hour" in plan and "ReadSchema: struct<id:bigint,ts:timestamp>" in plan


def test_merge_needs_a_row_level_catalog(spark, table):
    ensure_table(spark, table)
    source = spark.table(table.name).limit(0)
    with pytest.raises(Exception, match="UNSUPPORTED|not support|MERGE"):
        merge_into(table.name, source, ["id"])
