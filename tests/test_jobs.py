from __future__ import annotations

import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from stopwise import __main__ as cli
from stopwise.config import GoldConfig
from stopwise.jobs import build_gold, load_arrivals, load_lines, load_weather
from stopwise.plans import (
    enrich,
    hourly_rollup,
    ingest_arrivals,
    ingest_lines,
    latest_enriched,
    parse_arrivals,
    parse_weather,
    predictions,
    recent_delay_rates,
    weather_quality,
)
from stopwise.plans import tables
from stopwise.schemas import ARRIVALS_WEATHER, DELAY_WEATHER_HOURLY, METEOROLOGY_CURRENT
from stopwise.sources import read_document_sets, read_documents, read_json_documents, read_workbooks

ARRIVE = json.dumps(
    [
        {"line": "027", "stop": "17", "isHead": "True", "destination": "CASTILLA", "deviation": -1, "bus": "515",
         "geometry": {"type": "Point", "coordinates": [-3.7, 40.4]}, "estimateArrive": 781, "DistanceBus": 900,
         "positionTypeBus": "1"},
        {"bus": 516, "estimateArrive": 100, "geometry": {"coordinates": [-3.8]}},
    ]
)
STOP = json.dumps([{"lines": ["027", "005"], "stopId": "17", "stopName": "Old", "Direction": "A"}, {"stopId": "99"}])
POLLS = [
    ("2025-10-06 08:10:00", ARRIVE, STOP, "17", "027"),
    ("2025-10-06 08:20:00", "[]", STOP.replace("Old", "New"), "17", "027"),
    ("2025-10-06 08:30:00", "nonsense", "[]", "18", None),
    ("2025-10-06 08:40:00", "[{'bus': 7, 'stop': '19', 'isHead': False, 'estimateArrive': None}]", None, None, "005"),
]
HEADERS = ["timestamp", "Arrive", "StopInfo", "stopId", "line"]


def polls(spark):
    return spark.createDataFrame(POLLS, ", ".join(f"`{h}` string" for h in HEADERS))


def test_arrivals(spark):
    frames = ingest_arrivals(polls(spark))
    got = {(r.stop_id, r.bus): r for r in frames["arrivals_predictions"].collect()}
    assert set(got) == {("17", 515), ("17", 516), ("17", None), ("18", None), ("19", 7)}
    first = got[("17", 515)]
    assert (first.line, first.is_head, first.deviation, first.estimate_arrive_sec) == ("027", True, -1, 781)
    assert (first.lon, first.lat, got[("17", 516)].lon, got[("17", 516)].lat) == (-3.7, 40.4, -3.8, None)
    assert got[("19", 7)].line == "005" and got[("19", 7)].is_head is False
    assert len({r.id for r in got.values()}) == 5
    stops = frames["stops"].collect()
    assert [(s.stop_id, s.stop_name, s.lines) for s in stops] == [("17", "New", ["027", "005"])]
    parsed = parse_arrivals(polls(spark))
    assert parsed.where("arrive_json_bad").count() == 1
    assert predictions(parsed, keep_empty=False).count() == 3


def line_documents(spark):
    def service(start, stop, freq):
        return {"StartTime": start, "StopTime": stop, "MinimunFrequency": freq, "MaximumFrequency": "x", "Frequency": "07"}

    days = [
        {"DayType": "LA", "Direction1": service("06:00", "23:00", "10"), "Direction2": service("06:30", "22:00", "7.5")},
        {"DayType": "SA", "Direction1": service("07:00", "23:00", "")},
    ]
    entry = [{"IdLine": "27", "Label": "027", "nameA": "A", "nameB": "B", "typeOfDays": days}]
    stops = [
        {"stop": "17", "name": "S17", "geometry": {"coordinates": [-3.7, 40.4]}, "dataLine": ["27/H"]},
        {"stop": "18", "name": "S18", "geometry": {"coordinates": [-3.7]}},
    ]
    rows = [
        ("27", None, json.dumps(stops), json.dumps(entry)),
        ("27", None, json.dumps(stops), json.dumps(entry)),
        (None, "L", "[]", repr([{"IdLine": "5", "nameA": None, "typeOfDays": []}])),
    ]
    return spark.createDataFrame(rows, "Line string, Label string, Stops string, `time table` string").withColumnRenamed(
        "time table", "Timetable"
    )


def test_lines(spark):
    frames = ingest_lines(line_documents(spark))
    master = {(r.line, r.label, r.name_a, r.name_b) for r in frames["lines"].collect()}
    assert master == {("27", "027", "A", "B"), ("5", "L", None, None)}
    stops = {(r.line, r.stop_id, r.lon, r.lat) for r in frames["lines_stops"].collect()}
    assert stops == {("27", "17", -3.7, 40.4), ("27", "18", None, None), (None, None, None, None)}
    timetable = {(r.line, r.day_type): r for r in frames["lines_timetable"].collect()}
    assert set(timetable) == {("27", "LA"), ("27", "SA"), ("5", None)}
    working = timetable[("27", "LA")]
    assert (working.d1_min_freq, working.d1_max_freq, working.d1_freq, working.d2_min_freq) == (10, None, 7, None)
    assert timetable[("27", "SA")].d1_min_freq is None and timetable[("27", "SA")].d2_start_time is None


WEATHER = [
    ("2025-10-06 08:05:00", "Madrid", "40,4", "1,76E+09", "2025-10-06 08:00", "18,5", "55,0", "46,8", "2,5"),
    ("2025-10-06 09:05:00", "Madrid", "40,4", "1.234,5", "2025-10-06 09:30", "warm", "", "10", None),
]
WEATHER_HEADERS = [
    "run_ts_utc", "location.name", "location.lat", "location.localtime_epoch", "current.last_updated",
    "current.temp_c", "current.humidity", "current.wind_kph", "current.air_quality.us-epa-index",
]


def weather_documents(spark):
    return spark.createDataFrame(WEATHER, ", ".join(f"`{h}` string" for h in WEATHER_HEADERS))


def test_weather(spark):
    got = parse_weather(weather_documents(spark)).orderBy("run_ts_utc").collect()
    assert list(got[0].asDict()) == list(METEOROLOGY_CURRENT) and len(METEOROLOGY_CURRENT) == 49
    assert (got[0].lat, got[0].localtime_epoch, got[0].temp_c, got[0].humidity) == (40.4, 1760000000, 18.5, 55)
    assert (got[1].localtime_epoch, got[1].temp_c, got[1].humidity, got[1].air_us_epa_index) == (None, None, None, None)
    quality = weather_quality(weather_documents(spark)).first()
    assert (quality["rows"], quality.localtime_epoch_bad, quality.temp_c_bad, quality.humidity_bad) == (2, 1, 1, 0)


def test_gold_flags(spark):
    config = GoldConfig()
    arrivals = ingest_arrivals(polls(spark))["arrivals_predictions"]
    got = {
        (r.stop_id, r.bus): r
        for r in enrich(
            arrivals.unionByName(arrivals), ingest_lines(line_documents(spark).replace("27", "027", "Line"))["lines_timetable"],
            parse_weather(weather_documents(spark)), config,
        ).collect()
    }
    assert len(got) == 5
    late = got[("17", 515)]  # 10:10 on a Monday in Madrid, headway 10
    assert (late.expected_headway_min, late.delayed, late.weather_severity) == (10, True, "severe")
    assert late.delay_ratio == pytest.approx(781 / 600)
    assert late.delay_weather_attributed and late.weather_matched and late.wind_kph == 46.8
    early = got[("17", 516)]
    assert (early.delayed, early.weather_adverse, early.delay_weather_attributed) == (False, True, False)
    assert got[("19", 7)].expected_headway_min is None and got[("19", 7)].delayed is False


def test_no_weather_is_good_weather(spark):
    arrivals = ingest_arrivals(polls(spark))["arrivals_predictions"]
    none = parse_weather(weather_documents(spark).limit(0))
    lines = ingest_lines(line_documents(spark))["lines_timetable"]
    got = enrich(arrivals, lines, none).select("weather_severity", "weather_adverse", "weather_matched").distinct()
    assert [tuple(r) for r in got.collect()] == [("good", False, False)]


def test_rollup_of_nothing_and_reports(spark):
    facts = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ARRIVALS_WEATHER.items()))
    assert hourly_rollup(facts).columns == list(DELAY_WEATHER_HOURLY)
    arrivals = ingest_arrivals(polls(spark))["arrivals_predictions"]
    lines = ingest_lines(line_documents(spark).replace("27", "027", "Line"))["lines_timetable"]
    facts = enrich(arrivals, lines, parse_weather(weather_documents(spark)))
    hourly = hourly_rollup(facts)
    rows = {r.line: r for r in hourly.collect()}
    assert (rows["027"].total_preds, rows["027"].delayed_preds, rows["027"].adverse_preds) == (3, 1, 3)
    assert rows["027"].delay_rate == pytest.approx(1 / 3) and rows["027"].weather_attrib_delays == 1
    assert latest_enriched(facts, "2025-10-06 23:00:00").count() == 5
    assert latest_enriched(facts, "2025-10-07 00:00:00").count() == 0
    report = [r.line for r in recent_delay_rates(hourly, "2025-10-07 12:00:00").collect()]
    assert report == sorted(report, key=lambda v: (v is not None, v)) and len(report) == 3
    assert recent_delay_rates(hourly, "2025-10-08 00:00:00").count() == 0


@pytest.mark.parametrize(("zone", "hours"), [(None, {"22", "23"}), ("Europe/Madrid", {"00", "01"})])
def test_hour_bucket_zone(spark, zone, hours):
    times = spark.createDataFrame([("2025-07-01 22:30:00",), ("2025-07-01 23:10:00",)], "event_ts string")
    columns = {c: F.lit(None).cast(t) for c, t in ARRIVALS_WEATHER.items() if c != "event_ts"}
    facts = times.withColumns({"event_ts": F.col("event_ts").cast("timestamp"), **columns})
    got = hourly_rollup(facts, GoldConfig(bucket_tz=zone)).select(F.date_format("event_hour", "HH")).collect()
    assert {r[0] for r in got} == hours


def test_whole_chain_twice(spark, tmp_path):
    mark = uuid.uuid4().hex
    silver, gold = str(tmp_path / "silver"), str(tmp_path / "gold")
    config = GoldConfig()
    results = []
    for _ in range(2):
        load_arrivals(spark, polls(spark), silver, f"t{mark}")
        load_lines(spark, line_documents(spark).replace("27", "027", "Line"), silver, f"t{mark}")
        load_weather(spark, weather_documents(spark), silver, f"w{mark}")
        arrivals = spark.table(tables.arrivals_predictions(silver, f"t{mark}").name)
        weather = spark.table(tables.meteorology_current(silver, f"w{mark}").name)
        timetable = spark.table(f"t{mark}.lines_timetable")
        facts, hourly = build_gold(spark, arrivals, timetable, weather, gold, f"g{mark}", config)
        results.append(
            [
                sorted(map(repr, spark.table(t.name).drop("build_ts").collect()))
                for t in (facts, hourly)
            ]
        )
    assert len(results[0][0]) == 5
    assert results[0][0] == results[1][0]
    # The poll without a line has a null in the roll-up key, which a merge inserts every time.
    assert set(results[0][1]) == set(results[1][1])


def test_command_line(spark, tmp_path):
    mark = uuid.uuid4().hex
    silver, gold = str(tmp_path / "silver"), str(tmp_path / "gold")
    for job, frame in (("arrivals", polls(spark)), ("lines", line_documents(spark)), ("weather", weather_documents(spark))):
        frame.write.option("header", True).option("escape", '"').csv(str(tmp_path / job))
        db = f"{'w' if job == 'weather' else 't'}{mark}"
        cli.main([job, "--input", str(tmp_path / job), "--warehouse", silver, "--db", db])
    databases = ["--transit_db", f"t{mark}", "--weather_db", f"w{mark}", "--gold_db", f"g{mark}"]
    spark.sql(f"DROP TABLE t{mark}.arrivals_predictions")  # as in a session with a new catalog
    spark.sql(f"DROP TABLE t{mark}.lines_timetable")
    cli.main(["gold", "--warehouse", gold, "--silver_warehouse", silver, *databases])
    assert spark.table(f"g{mark}.arrivals_weather").count() == 5
    assert spark.table(f"g{mark}.delay_weather_hourly").count() == 3


def test_document_sets_and_json(spark, tmp_path):
    spark.sql("SELECT 1 AS a, 'x, \"y\"' AS b").write.option("header", True).option("escape", '"').csv(str(tmp_path / "one"))
    spark.sql("SELECT 2 AS a, 3 AS c").write.option("header", True).csv(str(tmp_path / "two"))
    both = read_document_sets(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).orderBy("a")
    assert [tuple(r) for r in both.collect()] == [("1", 'x, "y"', None), ("2", None, "3")]
    assert {t for _, t in read_documents(spark, str(tmp_path / "one")).dtypes} == {"string"}
    (tmp_path / "j.json").write_text('{"a": 1, "b": [{"c": null}]}\n')
    got = read_json_documents(spark, str(tmp_path / "j.json"), ["a", "b", "z"]).first()
    assert tuple(got) == ("1", '[{"c": null}]', None)


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheet_xml, shared=()):
    strings = "".join(f"<si><t>{s}</t></si>" for s in shared)
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        if shared:
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet_xml}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(
        tmp_path / "a.xlsx",
        '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row><c r="A2"><v>12</v></c><c r="C2" t="s"><v>2</v></c></row>'
        '<row><c r="C3" t="b"><v>1</v></c></row><row/>',
        ["line", "Arrive", "[{'bus': 1}]"],
    )
    workbook(
        tmp_path / "b.xlsx",
        '<row><c t="inlineStr"><is><t>Arrive</t></is></c></row><row><c t="inlineStr"><is><t>[]</t></is></c></row>',
    )
    got = read_workbooks(spark, str(tmp_path), ["line", "Arrive", "absent"])
    rows = sorted((tuple(r)[1:] for r in got.collect()), key=repr)
    assert rows == sorted([("12", "[{'bus': 1}]", None), (None, "true", None), (None, "[]", None)], key=repr)
    assert got.where(F.col("source_path").endswith("b.xlsx")).count() == 1
