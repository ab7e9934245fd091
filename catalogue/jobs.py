"""Whole ingest jobs on raw documents that Spark derives from the tables, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalogue.base import EVENTS_SQL, events, query, table
from stopwise.operators import quality_counts
from stopwise.plans import (
    line_stops,
    lines_master,
    parse_arrivals,
    parse_lines,
    parse_weather,
    predictions,
    stops,
    timetable,
    weather_quality,
)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def arrival_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item is one poll: JSON, an empty array, Python literals, or text that is neither."""
    order, part, supp, number = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    seconds = F.make_interval(secs=F.pmod(order * 60 + part, F.lit(86400)))
    quantity = F.col("l_quantity").cast("int")
    point = _text('{"type": "Point", "coordinates": [', F.col("l_quantity"), ", ", F.col("l_tax"), "]}")
    head = F.when(F.col("l_returnflag") == "R", "True").otherwise("no")
    first = _text(
        '{"line": "T', number, '", "stop": "S', supp, '", "isHead": "', head, '", "destination": "',
        F.col("l_returnflag"), '", "deviation": ', -number, ', "bus": ', part, ', "geometry": ', point,
        ', "estimateArrive": ', quantity * 60, ', "DistanceBus": ', F.col("l_quantity"), "}",
    )
    second = _text('{"bus": "', supp, '", "destination": "x, None, y", "estimateArrive": ', quantity, "}")
    literals = _text("[{'bus': ", part, ", 'isHead': True, 'destination': \"it's, None\", 'deviation': None}]")
    arrive = (
        F.when(number == 1, "[]")
        .when(number == 2, "[{broken")
        .when(number == 3, literals)
        .when(number == 4, F.lit(None))
        .otherwise(_text("[", first, ", ", second, "]"))
    )
    place = _text(
        '{"lines": ["T', number, '", "T0"], "stopId": "S', supp, '", "stopName": "Stop ', part,
        '", "geometry": ', point, ', "Direction": "', F.col("l_linestatus"), '"}',
    )
    other = _text('{"stopId": "S', part, '", "stopName": "never used"}')
    info = F.when(number != 5, _text("[", place, ", ", other, "]")).otherwise("[]")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_shipdate").cast("timestamp") + seconds).cast("string").alias("timestamp"),
        arrive.alias("Arrive"),
        info.alias("StopInfo"),
        F.when(F.col("l_returnflag") != "N", _text("S", supp)).alias("stopId"),
        F.when(number != 6, _text("T", number)).alias("line"),
    )


_POLLS_SQL = """
    (SELECT *, l_shipdate + to_seconds((l_orderkey * 60 + l_partkey) % 86400) AS event_ts,
            CASE WHEN l_returnflag <> 'N' THEN 'S' || l_suppkey END AS own_stop,
            CASE WHEN l_linenumber <> 6 THEN 'T' || l_linenumber END AS own_line,
            CAST(trunc(l_quantity) AS INTEGER) AS qty
     FROM lineitem)
"""


@query(f"""
    SELECT sha256(concat_ws('||', strftime(event_ts, '%Y-%m-%d %H:%M:%S'), coalesce(stop_id, ''),
                            coalesce(line, ''), coalesce(CAST(bus AS VARCHAR), ''),
                            coalesce(CAST(estimate_arrive_sec AS VARCHAR), ''))) AS id,
           epoch_us(event_ts) AS event_us, line, stop_id, destination, is_head, deviation, bus,
           estimate_arrive_sec, distance_bus_m, lon, lat
    FROM (
        SELECT event_ts, coalesce(own_line, 'T' || l_linenumber) AS line,
               coalesce(own_stop, 'S' || l_suppkey) AS stop_id, l_returnflag AS destination,
               l_returnflag = 'R' AS is_head, -l_linenumber AS deviation, CAST(l_partkey AS INTEGER) AS bus,
               qty * 60 AS estimate_arrive_sec, CAST(NULL AS INTEGER) AS distance_bus_m,
               l_quantity AS lon, l_tax AS lat
        FROM {_POLLS_SQL} p WHERE l_linenumber >= 5
        UNION ALL
        SELECT event_ts, own_line, own_stop, 'x, None, y', false, NULL, CAST(l_suppkey AS INTEGER), qty,
               NULL, NULL, NULL
        FROM {_POLLS_SQL} p WHERE l_linenumber >= 5
        UNION ALL
        SELECT event_ts, own_line, own_stop, 'it''s, None', true, NULL, CAST(l_partkey AS INTEGER), NULL,
               NULL, NULL, NULL
        FROM {_POLLS_SQL} p WHERE l_linenumber = 3
        UNION ALL
        SELECT event_ts, own_line, own_stop, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL
        FROM {_POLLS_SQL} p WHERE l_linenumber IN (1, 2, 4)) u
""", nullable=("deviation", "bus", "estimate_arrive_sec", "distance_bus_m"))
def json_explode_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(parse_arrivals(arrival_documents(spark, sf_dir)))
    return rows.withColumn("event_us", F.unix_micros("event_ts")).select(
        "id",
        "event_us",
        "line",
        "stop_id",
        "destination",
        "is_head",
        "deviation",
        "bus",
        "estimate_arrive_sec",
        "distance_bus_m",
        "lon",
        "lat",
    )


@query(f"""
    SELECT stop_id, stop_name, lon, lat, direction, lines FROM (
        SELECT *, row_number() OVER (PARTITION BY stop_id
                   ORDER BY event_ts DESC, stop_name, lon, lat, direction, lines) AS rn
        FROM (SELECT 'S' || l_suppkey AS stop_id, event_ts, 'Stop ' || l_partkey AS stop_name, l_quantity AS lon,
                     l_tax AS lat, l_linestatus AS direction, 'T' || l_linenumber || ',T0' AS lines
              FROM {_POLLS_SQL} p WHERE l_linenumber <> 5) s) r
    WHERE rn = 1
""")
def first_element_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stops(parse_arrivals(arrival_documents(spark, sf_dir)))
    return rows.drop("updated_ts").withColumn("lines", F.array_join("lines", ","))


@query("""
    SELECT count(*) AS rows, count(*) FILTER (WHERE l_linenumber = 2) AS arrive_json_bad,
           0::BIGINT AS stopinfo_json_bad, 0::BIGINT AS incident_listaincident_data_json_bad,
           count(*) FILTER (WHERE l_linenumber = 7) AS event_ts_bad
    FROM lineitem
""")
def json_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seventh poll of an order has a time that cannot be read."""
    unreadable = F.when(F.col("line") == "T7", F.concat(F.lit("at "), "timestamp")).otherwise(F.col("timestamp"))
    return quality_counts(parse_arrivals(arrival_documents(spark, sf_dir).withColumn("timestamp", unreadable)))


def line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is one line document; some lack their own line or label."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    line = _text("L", F.floor(key / 2))

    def stop(number: int, *coordinates: Column) -> Column:
        geometry = F.struct(F.array(*coordinates).alias("coordinates"))
        return F.struct(
            _text("S", nation + number).alias("stop"),
            _text("Stop ", nation + number).alias("name"),
            F.col("c_mktsegment").alias("postalAddress"),
            geometry.alias("geometry"),
            F.lit(number).alias("pmv"),
            F.array(line).alias("dataLine"),
        )

    def service(start: Column, frequency: Column) -> Column:
        return F.struct(
            _text(F.lpad(start.cast("string"), 2, "0"), ":00").alias("StartTime"),
            _text(start + 12, ":30").alias("StopTime"),
            frequency.cast("string").alias("MinimunFrequency"),
            _text(key % 9, ".5").alias("MaximumFrequency"),
            _text("0", key % 9).alias("Frequency"),
        )

    def day(code: str, start: Column) -> Column:
        return F.struct(
            F.lit(code).alias("DayType"),
            service(start, key % 11).alias("Direction1"),
            service(start + 1, nation).alias("Direction2"),
        )

    entry = F.struct(
        line.alias("IdLine"),
        _text("Label ", nation).alias("Label"),
        _text("From ", nation).alias("nameA"),
        _text("To ", key % 4).alias("nameB"),
        F.array(day("LA", key % 5), day("SA", key % 3 + 5)).alias("typeOfDays"),
    )
    return table(spark, sf_dir, "customer").select(
        F.when(nation % 5 != 0, line).alias("Line"),
        F.when(nation % 4 != 0, F.col("c_mktsegment")).alias("Label"),
        F.to_json(F.array(stop(0, F.col("c_acctbal"), nation / 2), stop(1, F.col("c_acctbal")))).alias("Stops"),
        F.when(nation != 7, F.to_json(F.array(entry))).otherwise("[]").alias("Time-Table"),
    ).withColumnRenamed("Time-Table", " timetable ")


_ENTRIES_SQL = """
    (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 5 <> 0 OR c_nationkey <> 7
                THEN 'L' || CAST(floor(c_custkey / 2) AS BIGINT) END AS line,
            CASE WHEN c_nationkey % 4 <> 0 THEN c_mktsegment
                 WHEN c_nationkey <> 7 THEN 'Label ' || c_nationkey END AS label,
            CASE WHEN c_nationkey <> 7 THEN 'From ' || c_nationkey END AS name_a,
            CASE WHEN c_nationkey <> 7 THEN 'To ' || c_custkey % 4 END AS name_b
     FROM customer)
"""


@query(f"""
    SELECT line, label, name_a, name_b FROM (
        SELECT *, row_number() OVER (PARTITION BY line
                   ORDER BY label NULLS LAST, name_a NULLS LAST, name_b NULLS LAST) AS rn
        FROM {_ENTRIES_SQL} e) r
    WHERE rn = 1
""")
def coalesce_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_master(parse_lines(line_documents(spark, sf_dir))).drop("ingest_ts")


@query("""
    SELECT line, label, stop_id, stop_name, postal_address, round(lon, 2) AS lon, lat, pmv, data_lines FROM (
        SELECT *, row_number() OVER (PARTITION BY line, stop_id
                   ORDER BY label NULLS LAST, stop_name, postal_address, lon NULLS LAST, lat NULLS LAST, pmv,
                            data_lines) AS rn
        FROM (SELECT CASE WHEN c_nationkey % 5 <> 0 THEN 'L' || CAST(floor(c_custkey / 2) AS BIGINT) END AS line,
                     CASE WHEN c_nationkey % 4 <> 0 THEN c_mktsegment END AS label,
                     'S' || (c_nationkey + i) AS stop_id, 'Stop ' || (c_nationkey + i) AS stop_name,
                     c_mktsegment AS postal_address, CASE WHEN i = 0 THEN c_acctbal END AS lon,
                     CASE WHEN i = 0 THEN c_nationkey / 2 END AS lat, CAST(i AS VARCHAR) AS pmv,
                     'L' || CAST(floor(c_custkey / 2) AS BIGINT) AS data_lines
              FROM customer, (VALUES (0), (1)) AS v(i)) s) r
    WHERE rn = 1
""")
def point_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_stops(parse_lines(line_documents(spark, sf_dir))).drop("ingest_ts")
    return rows.withColumns({"lon": F.round("lon", 2), "data_lines": F.array_join("data_lines", ",")})


@query(f"""
    SELECT line, label, name_a, name_b, day_type, d1_start_time, d1_stop_time, d1_min_freq, d1_max_freq, d1_freq,
           d2_start_time, d2_stop_time, d2_min_freq, d2_max_freq, d2_freq FROM (
        SELECT *, row_number() OVER (PARTITION BY line, day_type, d1_start_time, d2_start_time
                   ORDER BY label NULLS LAST, name_a NULLS LAST, name_b NULLS LAST, d1_stop_time NULLS LAST,
                            d1_min_freq NULLS LAST, d1_freq NULLS LAST, d2_stop_time NULLS LAST,
                            d2_min_freq NULLS LAST) AS rn
        FROM (SELECT line, label, name_a, name_b, day_type,
                     lpad(CAST(s AS VARCHAR), 2, '0') || ':00' AS d1_start_time, (s + 12) || ':30' AS d1_stop_time,
                     CAST(CASE WHEN s IS NOT NULL THEN c_custkey % 11 END AS INTEGER) AS d1_min_freq,
                     CAST(NULL AS INTEGER) AS d1_max_freq,
                     CAST(CASE WHEN s IS NOT NULL THEN c_custkey % 9 END AS INTEGER) AS d1_freq,
                     lpad(CAST(s + 1 AS VARCHAR), 2, '0') || ':00' AS d2_start_time,
                     (s + 13) || ':30' AS d2_stop_time,
                     CASE WHEN s IS NOT NULL THEN c_nationkey END AS d2_min_freq,
                     CAST(NULL AS INTEGER) AS d2_max_freq,
                     CAST(CASE WHEN s IS NOT NULL THEN c_custkey % 9 END AS INTEGER) AS d2_freq
              FROM (SELECT *, 'LA' AS day_type, c_custkey % 5 AS s FROM {_ENTRIES_SQL} e WHERE c_nationkey <> 7
                    UNION ALL
                    SELECT *, 'SA', c_custkey % 3 + 5 FROM {_ENTRIES_SQL} e WHERE c_nationkey <> 7
                    UNION ALL
                    SELECT *, NULL, NULL FROM {_ENTRIES_SQL} e WHERE c_nationkey = 7) d) t) r
    WHERE rn = 1
""", nullable=("d1_min_freq", "d1_max_freq", "d1_freq", "d2_min_freq", "d2_max_freq", "d2_freq"))
def nested_two_level_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable(parse_lines(line_documents(spark, sf_dir))).drop("ingest_ts")


def weather_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is one weather poll with dotted headers and decimal commas."""
    k, value = F.col("k"), F.col("value")

    def comma(number: Column) -> Column:
        return F.translate(number.cast("string"), ".", ",")

    at = F.date_format("ts", "yyyy-MM-dd HH:mm")
    return events(spark, sf_dir).select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("run_ts_utc"),
        _text("City ", F.col("user_id")).alias("location.name"),
        F.when(k >= 5, F.col("event_type")).alias("location.region"),
        comma(value).alias("location.lat"),
        F.when(k < 50, F.lit("1,76E+09")).otherwise(F.unix_seconds("ts").cast("string")).alias("location.localtime_epoch"),
        at.alias("location.localtime"),
        at.alias("current.last_updated"),
        F.when(k < 90, comma(value)).otherwise("1.234,5").alias("current.temp_c"),
        F.when(k < 30, _text(k, ",4")).otherwise(k.cast("string")).alias("current.humidity"),
        _text("Sky ", k).alias("current.condition.text"),
        F.when(k != 3, comma(value / 2)).otherwise("").alias("current.air_quality.pm2_5"),
        (k % 6).cast("string").alias("current.air_quality.us-epa-index"),
    )


@query(f"""
    SELECT sha256(concat_ws('||', 'City ' || user_id, CASE WHEN k >= 5 THEN event_type ELSE '' END, '',
                            CAST(CASE WHEN k < 50 THEN 1760000000 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS VARCHAR),
                            strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S'),
                            strftime(ts, '%Y-%m-%d %H:%M:%S'))) AS id,
           CAST(floor(epoch(ts)) AS BIGINT) AS run_sec,
           CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS obs_sec,
           'City ' || user_id AS location_name, CASE WHEN k >= 5 THEN event_type END AS location_region,
           CAST(NULL AS VARCHAR) AS location_country, round(value, 2) AS lat,
           CASE WHEN k < 50 THEN 1760000000 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS localtime_epoch,
           CASE WHEN k < 90 THEN round(value, 2) END AS temp_c, k AS humidity, 'Sky ' || k AS condition_text,
           CASE WHEN k <> 3 THEN round(value / 2, 4) END AS air_pm2_5, CAST(k % 6 AS INTEGER) AS air_us_epa_index
    FROM {EVENTS_SQL} e
""")
def weather_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_weather(weather_documents(spark, sf_dir).drop("event_id")).select(
        "id",
        F.unix_seconds("run_ts_utc").alias("run_sec"),
        F.unix_seconds("obs_ts").alias("obs_sec"),
        "location_name",
        "location_region",
        "location_country",
        F.round("lat", 2).alias("lat"),
        "localtime_epoch",
        F.round("temp_c", 2).alias("temp_c"),
        "humidity",
        "condition_text",
        F.round("air_pm2_5", 4).alias("air_pm2_5"),
        "air_us_epa_index",
    )


@query(f"""
    SELECT count(*) AS rows, count(*) FILTER (WHERE k >= 90) AS temp_c_bad, 0::BIGINT AS humidity_bad,
           0::BIGINT AS obs_ts_bad
    FROM {EVENTS_SQL} e
""", name="weather_quality")
def weather_cells_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = weather_quality(weather_documents(spark, sf_dir).drop("event_id"))
    return counts.select("rows", "temp_c_bad", "humidity_bad", "obs_ts_bad")
