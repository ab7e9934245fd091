from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stopwise.operators import (
    band_join,
    flatten,
    headway_by_window,
    headway_lookup,
    latest_per_key,
    map_fields,
    nearest_join,
    normalize_headers,
    optional_column,
    parse_json_array,
    quality_counts,
    salted_left_join,
    union_with_missing,
    unpivot_groups,
)
from stopwise.operators import nearest
from stopwise.operators.headers import normalized


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


@pytest.mark.parametrize(
    ("mode", "name", "expected"),
    [
        ("basic", " Incident.Lista Incident.data", "incident_lista_incident_data"),
        ("basic", "us-epa", "us-epa"),
        ("hyphen", "current.air_quality.us-epa-index", "current_air_quality_us_epa_index"),
        ("strict", "Línea (Nº)--x", "l_nea_n_x"),
    ],
)
def test_header_modes(mode, name, expected):
    assert normalized(name, mode) == expected


def test_colliding_headers(spark):
    with pytest.raises(ValueError, match="collide"):
        normalize_headers(spark.range(1).selectExpr("1 AS `a b`", "2 AS `a.b`"))


def test_flatten_and_rename(spark):
    df = spark.sql("SELECT named_struct('b', named_struct('c', 1), 'd', array(1)) AS a, 2 AS e")
    assert flatten(df).columns == ["a.b.c", "a.d", "e"]
    assert rows(map_fields(df, {"e": "x", "nope": "y"})) == [(2,)]
    assert map_fields(df, {"d": "list", "zz": "y"}, block="a").columns == ["list"]
    assert df.select(optional_column(df, "zz", "int").alias("zz")).dtypes == [("zz", "int")]


CELLS = [
    ('[{"n": "1", "t": "x"}]', ["1"], False),
    ("[]", [], False),
    (None, None, False),
    ("not json", None, True),
    ("[{'n': None, 't': \"it's\", 'h': True}]", [None], False),
    ("[{'n': 5, 't': 'a, None, b', 'h': False}]", ["5"], False),
    ('[{"n": 12}]', ["12"], False),
    ("__import__('os')", None, True),
]


@pytest.mark.parametrize("repair", [True, False])
def test_json_cells(spark, repair):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CELLS)], "i int, cell string")
    parsed = parse_json_array(df, "cell", "struct<n:string, t:string, h:string>", "items", repair)
    got = {r.i: r for r in parsed.collect()}
    for i, (text, numbers, bad) in enumerate(CELLS):
        if not repair and text and text.startswith("[{'") and ("None" in text):
            # 'a, None, b' is text in single quotes, but its False is no JSON either.
            assert got[i]["items"] is None and got[i].items_bad
            continue
        items = got[i]["items"]
        assert (None if items is None else [x.n for x in items]) == numbers
        assert got[i].items_bad == bad
    if repair:
        assert got[5]["items"][0].t == "a, None, b"
        assert quality_counts(parsed).first().asDict() == {"rows": 8, "items_bad": 2}


def test_latest_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "w"), ("a", None, "z"), (None, 3, "q"), (None, 2, "r")], "k string, t int, v string")
    expected = [("a", 1, "w"), (None, 3, "q")]
    for parts in (1, 3):
        got = latest_per_key(df.repartition(parts), ["k"], [F.col("t").desc_nulls_last()])
        assert rows(got) == sorted(expected, key=repr)


def test_unpivot_and_union(spark):
    df = spark.sql("SELECT 1 AS k, 'a' AS d1_s, 'b' AS d2_s")
    groups = {"D1": {"s": "d1_s"}, "D2": {"s": "d2_s"}}
    long = unpivot_groups(df, ["k"], groups, "dir")
    assert rows(long, "k", "dir", "s") == [(1, "D1", "a"), (1, "D2", "b")]
    both = union_with_missing(df.select("k"), df.select("d1_s"))
    assert rows(both) == [(1, None), (None, "a")]


def timetable(spark, *windows):
    return spark.createDataFrame(
        [("7", "LA", *w) for w in windows],
        "line string, day_type string, d1_start_time string, d1_stop_time string, d1_min_freq int,"
        " d2_start_time string, d2_stop_time string, d2_min_freq int",
    )


TIMETABLE = [
    ("06:00", "10:00", 12, "09:00", "11:00", 8),
    ("06:00", "10:00", 15, None, "11:00", 1),
    ("20:00", "24:30", None, "23:00", "24:30", 30),
    ("23:30", "05:00", 40, "12:00", "12:00", 2),
    ("07", "13:00", 3, "13:00", "14:00", 0),
]


def test_headway_windows(spark):
    got = rows(headway_by_window(timetable(spark, *TIMETABLE)), "start_min", "stop_min", "expected_min_freq")
    assert (360, 600, 12) in got and (540, 660, 8) in got and (1200, 1470, None) in got
    assert (1410, 300, 40) in got and (None, 780, 3) in got and len(got) == 8
    wrapped = rows(headway_by_window(timetable(spark, *TIMETABLE), wrap_midnight=True), "start_min", "stop_min", "expected_min_freq")
    assert (1410, 1440, 40) in wrapped and (0, 300, 40) in wrapped and (1410, 300, 40) not in wrapped


@pytest.mark.parametrize("wrap", [True, False])
@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_headway_lookup_every_minute(spark, limit, wrap):
    windows = headway_by_window(timetable(spark, *TIMETABLE), wrap)
    listed = windows.collect()
    facts = spark.range(1440).selectExpr("CAST(id AS INT) AS m", "'7' AS line", "'LA' AS day_type")
    facts = facts.unionByName(spark.sql("SELECT 400 AS m, '8' AS line, 'LA' AS day_type UNION ALL SELECT 400, NULL, 'LA'"))
    got = headway_lookup(facts, windows, "m", ["m"], limit).collect()
    assert len(got) == 1442
    for r in got:
        fitting = [
            w.expected_min_freq
            for w in listed
            if w.start_min is not None and w.start_min <= r.m < w.stop_min and w.expected_min_freq is not None
        ]
        assert r.expected_headway_min == (min(fitting, default=None) if r.line == "7" else None), r


def brute_nearest(events, observations, window, mode):
    result = {}
    for key, t in events:
        fitting = []
        for oid, o in observations:
            near = t is not None and o is not None and (
                abs(t // 1800 - o // 1800) <= window // 30 if mode == "slot" else abs(t - o) <= window * 60
            )
            if near:
                fitting.append((abs(t - o), o, oid))
        result[key] = min(fitting)[2] if fitting else None
    return result


def times(spark, pairs, key, ts):
    return spark.createDataFrame(pairs, f"{key} int, sec bigint").select(
        key, F.timestamp_seconds("sec").alias(ts)
    )


@pytest.mark.parametrize("mode", ["slot", "exact"])
@pytest.mark.parametrize("limit", [1 << 26, 0])
@pytest.mark.parametrize("window", [0, 45, 60])
def test_nearest_equals_brute_force(spark, mode, limit, window):
    draw = random.Random(window)
    events = [(i, draw.randrange(0, 40_000)) for i in range(150)] + [(900, None), (901, 0), (902, -1)]
    observations = [(i, draw.randrange(0, 15) * 2_500 + draw.randrange(3)) for i in range(40)]
    observations += [(70, 0), (71, 0), (72, -1800), (73, None), (80, 39_999)]
    got = nearest_join(
        times(spark, events, "id", "t"),
        times(spark, observations, "oid", "o"),
        "t", "o", "oid", ["id"],
        window_minutes=window, mode=mode, max_broadcast_bytes=limit,
    )
    assert {r.id: r.oid for r in got.collect()} == brute_nearest(events, observations, window, mode)
    assert got.count() == len(events)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_nearest_in_crowded_slots(spark, limit):
    draw = random.Random(5)
    events = [(i, draw.randrange(0, 9_000)) for i in range(200)]
    observations = [(i, draw.randrange(0, 5_000)) for i in range(800)]
    got = nearest_join(
        times(spark, events, "id", "t"), times(spark, observations, "oid", "o"), "t", "o", "oid", ["id"],
        max_broadcast_bytes=limit,
    )
    assert {r.id: r.oid for r in got.collect()} == brute_nearest(events, observations, 60, "slot")


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_nearest_with_hot_seconds(spark, limit):
    """Thousands of copies of one event second and of one observation second stay linear and whole."""
    events = times(spark, [(i, 7_200) for i in range(5_000)] + [(9_000 + i, 7_300 + i) for i in range(50)], "id", "t")
    observed = times(spark, [(i, 7_250) for i in range(5_000, 0, -1)] + [(6_000, 7_330)], "oid", "o")
    got = nearest_join(events, observed, "t", "o", "oid", ["id"], max_broadcast_bytes=limit)
    counts = {r.oid: r["count"] for r in got.groupBy("oid").count().collect()}
    # Seconds 7,300 to 7,349: nearer to 7,330 from 7,291 on.
    assert counts == {1: 5_000, 6_000: 50}


def test_nearest_documented_distances(spark):
    # 61 and 89 minutes lie in the slot window of 60, not in the exact one; 91 in neither.
    events = [(1, 29 * 60 + 36_000)]
    for minutes, slot, exact in ((60, True, True), (61, True, False), (89, True, False), (91, False, False)):
        observed = times(spark, [(5, 29 * 60 + 36_000 - minutes * 60)], "oid", "o")
        for mode, expected in (("slot", slot), ("exact", exact)):
            got = nearest_join(times(spark, events, "id", "t"), observed, "t", "o", "oid", ["id"], mode=mode)
            assert (got.first().oid is not None) == expected, (minutes, mode)


def test_nearest_without_observations(spark):
    got = nearest_join(times(spark, [(1, 5)], "id", "t"), times(spark, [], "oid", "o"), "t", "o", "oid", ["id"])
    assert rows(got, "id", "oid") == [(1, None)]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_band_join_equals_brute_force(spark, limit):
    draw = random.Random(3)
    events = [(i, draw.randrange(0, 60_000)) for i in range(60)] + [(99, None)]
    observations = [(i, draw.randrange(0, 30_000)) for i in range(90)]
    measures = {"n": ("count", "oid"), "low": ("min", "oid"), "high": ("max", "oid"), "total": ("sum", "oid")}
    got = band_join(
        times(spark, events, "id", "t"), times(spark, observations, "oid", "o"), "t", "o", measures, ["id"],
        max_broadcast_bytes=limit,
    )
    for r in got.collect():
        t = dict(events)[r.id]
        ids = [i for i, o in observations if t is not None and abs(t // 1800 - o // 1800) <= 2]
        assert (r.n, r.low, r.high, r.total) == (len(ids), min(ids, default=None), max(ids, default=None), sum(ids) if ids else None)


def test_salted_join_splits_hot_keys(spark):
    left = spark.range(300).selectExpr(
        "id", "CASE WHEN id < 150 THEN 'hot' WHEN id < 200 THEN NULL ELSE 'k' || id % 7 END AS k"
    )
    right = spark.sql("SELECT 'hot' AS k, 1 AS v UNION ALL SELECT 'k3', 3 UNION ALL SELECT 'k5', 5 UNION ALL SELECT NULL, 9")
    for threshold in (10, 1_000):
        got = salted_left_join(left, right, ["k"], ["id"], rows_per_task=threshold)
        assert rows(got, "id", "k", "v") == rows(left.join(right, "k", "left"), "id", "k", "v")


def test_observations_of_one_second_are_measured_as_one(spark):
    many = spark.range(500).selectExpr("string(id) AS obs", "timestamp_micros(1704067200000000 + id) AS seen")
    size = nearest._measure(many, "seen", 30)
    assert (size["rows"], size["slots"]) == (1, 1)
