"""The physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from catalogue import REGISTRY
from catalogue.gold import arrivals, timetable, weather
from stopwise.operators import latest_per_key, nearest_join
from stopwise.plans import enrich, parse_arrivals, stops

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of all that is written, the batches of a stream too."""
    plans = []
    for name in ("parquet", "saveAsTable"):
        old = getattr(DataFrameWriter, name)

        def noted(self, *args, old=old, **options):
            plans.append(plan(self._df))
            return old(self, *args, **options)

        monkeypatch.setattr(DataFrameWriter, name, noted)
    return plans


# the many partitions are written by the plans of upsert_single_key
@pytest.mark.parametrize("name", sorted(set(REGISTRY) - {"upsert_many_partitions"}))
def test_no_nested_loops_or_products(spark, written, name):
    texts = [plan(REGISTRY[name].run(spark, SF)), *written]
    if REGISTRY[name].run.__module__.endswith("writes") and name != "partition_transforms":
        assert written
    for text in texts:
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_upsert_reads_pruned_folders_and_joins_by_key(spark, written):
    REGISTRY["upsert_single_key"].run(spark, SF)
    merge = [t for t in written if "LeftAnti" in t]
    assert len(merge) == 1
    assert "event_date" in merge[0] and "BroadcastNestedLoop" not in merge[0]


def test_json_cells_stay_in_the_jvm(spark):
    raw = spark.createDataFrame([("t", "[]", "[]", "1", "2")], "timestamp string, arrive string, stopinfo string, stopid string, line string")
    assert "Python" not in plan(parse_arrivals(raw)) and "ArrowEval" not in plan(parse_arrivals(raw))


def test_enrichment_moves_no_arrival(spark):
    text = plan(enrich(arrivals(spark, SF), timetable(spark, SF), weather(spark, SF), unique_ids=True))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text
    # Every shuffle hangs below a broadcast: walk up from each Exchange to the nearest wider operator.
    lines = text.splitlines()

    def level(line):
        return re.search(r"[A-Za-z*]", line).start()

    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            above, at = [], level(line)
            for earlier in reversed(lines[:i]):
                if level(earlier) < at:
                    at = level(earlier)
                    above.append(earlier)
            assert any("BroadcastExchange" in a for a in above), line


def test_large_sides_are_not_broadcast(spark):
    facts = arrivals(spark, SF).select("id", "event_ts")
    observed = weather(spark, SF).select(F.col("id").alias("obs_id"), "obs_ts")
    joined = nearest_join(facts, observed, "event_ts", "obs_ts", "obs_id", ["id"], max_broadcast_bytes=0)
    assert "__salt" in plan(joined)


def test_unpivot_scans_once(spark):
    assert plan(REGISTRY["unpivot_directions"].run(spark, SF)).count("FileScan") == 1


def test_dedupe_filters_before_the_shuffle(spark):
    text = plan(latest_per_key(spark.read.parquet(f"{SF}/events.parquet"), ["user_id"], [F.col("ts").desc()]))
    before = text[text.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before and text.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(REGISTRY["scan_project"].run(spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThanOrEqual(" in text
    assert "o_orderdate" not in text


def test_stop_dimension_parses_each_cell_once(spark):
    raw = spark.createDataFrame([("t", "[]", "[]", "1", "2")], "timestamp string, arrive string, stopinfo string, stopid string, line string")
    text = plan(stops(parse_arrivals(raw, repair_literals=False)))
    assert text.count("from_json(") == 1
