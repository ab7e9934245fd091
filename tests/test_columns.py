from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from stopwise import functions as fn

C = F.col("v")


def column(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").orderBy("i")
    return [r[0] for r in df.select(expression.alias("x")).collect()]


NUMBERS = ["40,4", "1,76E+09", "1.234,5", "", "text", "12", None, "-3,9"]


def test_locale_numbers(spark):
    assert column(spark, NUMBERS, fn.locale_double(C)) == [40.4, 1.76e9, None, None, None, 12.0, None, -3.9]
    assert column(spark, NUMBERS, fn.locale_int(C)) == [40, 1760000000, None, None, None, 12, None, -3]
    assert column(spark, ["1,76E+12"], fn.locale_bigint(C)) == [1760000000000]
    assert column(spark, ["1,76E+12"], fn.locale_int(C)) == [None]


def test_integers(spark):
    texts = ["7", "07", "", "7.5", None, "-7", "99999999999"]
    assert column(spark, texts, fn.strict_int(C)) == [7, 7, None, None, None, None, None]
    assert column(spark, texts, fn.json_int(C)) == [7, 7, None, None, None, -7, None]


def test_bool_text(spark):
    assert column(spark, ["True", "TRUE", "yes", "", None], fn.bool_text(C)) == [True, True, False, False, False]


def test_minute_of_day(spark):
    texts = ["06:00", "23:30", "24:30", "07", None, "x:10"]
    assert column(spark, texts, fn.minute_of_day(C)) == [360, 1410, 1470, None, None, None]


def test_hash_key(one):
    def keys(row, null_safe):
        return one("a string, b string, c string", row, fn.hash_key([F.col(x) for x in "abc"], null_safe))[0]

    assert keys(("a", None, "b"), True) == hashlib.sha256(b"a||||b").hexdigest()
    assert keys(("a", None, "b"), True) != keys(("a", "b", None), True)
    assert keys(("a", None, "b"), False) == keys(("a", "b", None), False)


@pytest.mark.parametrize(
    ("utc", "expected"),
    [
        ("2025-10-03 21:30:00", "LA"),  # Friday there too
        ("2025-10-03 22:30:00", "SA"),  # Saturday 00:30 in Madrid
        ("2025-10-05 12:00:00", "FE"),
        ("2025-10-06 12:00:00", "LA"),
    ],
)
def test_day_type(one, utc, expected):
    ts = F.col("v").cast("timestamp")
    assert one("v string", (utc,), fn.day_type(ts, "Europe/Madrid")) == (expected,)


def test_clock_changes(spark):
    # 00:30 and 01:30 UTC are both 02:30 in Madrid on the day the clock goes back.
    times = ["2025-10-26 00:30:00", "2025-10-26 01:45:10", "2025-03-30 01:10:00"]
    ts = C.cast("timestamp")
    assert column(spark, times, fn.local_minute(ts, "Europe/Madrid")) == [150, 165, 190]
    slots = column(spark, times, F.date_format(fn.time_slot(ts), "HH:mm:ss"))
    assert slots == ["00:30:00", "01:30:00", "01:00:00"]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Madrid")
    try:
        assert column(spark, [1761442200], F.unix_seconds(fn.time_slot(F.timestamp_seconds(C))), "bigint") == [1761442200]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_source_zone(one):
    at = F.date_format(fn.naive_to_instant(C, "Europe/Madrid"), "yyyy-MM-dd HH:mm")
    assert one("v string", ("2025-07-01 12:00:00",), at) == ("2025-07-01 10:00",)
    assert one("v string", ("soon",), fn.naive_to_instant(C)) == (None,)


SEVERITY = [
    ((1.99, 0.0, 10.0), "bad"), ((2.0, 0.0, 10.0), "severe"), ((0.0, 45.0, 10.0), "severe"),
    ((0.0, 44.9, 10.0), "bad"), ((0.0, 0.0, 2.9), "severe"), ((0.0, 0.0, 3.0), "bad"),
    ((0.49, 0.0, 10.0), "moderate"), ((0.5, 0.0, 10.0), "bad"), ((0.0, 30.0, 10.0), "bad"),
    ((0.0, 29.9, 10.0), "moderate"), ((0.0, 0.0, 5.9), "bad"), ((0.0, 0.0, 6.0), "good"),
    ((0.1, 0.0, 10.0), "moderate"), ((0.09, 19.9, 10.0), "good"), ((0.0, 20.0, 10.0), "moderate"),
    ((None, None, None), "good"), ((None, 50.0, None), "severe"), ((None, None, 4.0), "bad"),
]


def test_severity(spark):
    df = spark.createDataFrame([(*m, e) for m, e in SEVERITY], "p double, w double, v double, e string")
    got = df.select(fn.severity(F.col("p"), F.col("w"), F.col("v")).alias("s"), "e", "p", "w", "v").collect()
    assert [r for r in got if r.s != r.e] == []
    assert [r[0] for r in df.select(fn.adverse(F.lit("bad"))).distinct().collect()] == [True]


@pytest.mark.parametrize(
    ("eta", "headway", "ratio", "late"),
    [
        (780, 10, 1.3, False),  # exactly the threshold
        (781, 10, 781 / 600, True),
        (100, 0, None, True),
        (0, 0, None, False),
        (100, None, None, False),
        (None, 10, None, False),
    ],
)
def test_delay(one, eta, headway, ratio, late):
    got = one(
        "e int, h int",
        (eta, headway),
        fn.delay_ratio(F.col("e"), F.col("h")),
        fn.delayed(F.col("e"), F.col("h"), 1.30),
    )
    assert got == (pytest.approx(ratio) if ratio is not None else None, late)


def test_points(spark):
    points = [[1.0, 2.0], [1.0], [], None]
    assert column(spark, points, fn.lon(C), "array<double>") == [1.0, None, None, None]
    assert column(spark, points, fn.lat(C), "array<double>") == [2.0, None, None, None]
    assert column(spark, points, fn.lon(C, whole_only=False), "array<double>") == [1.0, 1.0, None, None]
