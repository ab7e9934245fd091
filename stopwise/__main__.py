"""``python -m stopwise <job> ...`` (or as the entry point of spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from stopwise import jobs
from stopwise.config import GoldConfig
from stopwise.incremental import refresh_gold
from stopwise.plans import tables
from stopwise.schemas import WEATHER_FIELDS
from stopwise.session import build_session
from stopwise.sinks.table import ensure_namespace_of, ensure_table
from stopwise.sources import read_documents, read_json_documents, read_workbooks
from stopwise.streaming import stream_files, stream_messages, write_bronze, write_live
from stopwise.streaming.live import dead_letter_table
from stopwise.streaming.silver import write_silver

# Headers of the documents, for the formats that must be told.
HEADERS = {
    "arrivals": ["timestamp", "Arrive", "StopInfo", "Incident.ListaIncident.data", "stopId", "line"],
    "lines": ["line", "label", "stops", "timetable"],
    "weather": [header for header, _ in WEATHER_FIELDS.values()],
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="stopwise")
    commands = parser.add_subparsers(dest="job", required=True)
    for job in ("arrivals", "lines", "weather"):
        p = commands.add_parser(job)
        p.add_argument("--input", required=True)
        p.add_argument("--format", choices=("csv", "json", "workbook"), default="csv")
        p.add_argument("--headers", nargs="*", help="headers as in the files, in their order")
        p.add_argument("--warehouse", required=True)
        p.add_argument("--db", default="meteorology" if job == "weather" else "transit")
        p.add_argument("--source_tz")
        p.add_argument("--quarantine", action="store_true", help="keep lines that cannot be read (csv, json)")
        if job != "lines":
            p.add_argument("--method", choices=jobs.METHODS, default="rewrite")
    fold = commands.add_parser("fold", help="live rows into the observations")
    fold.add_argument("--warehouse", required=True)
    fold.add_argument("--live_db", default="live")
    fold.add_argument("--db", default="meteorology")
    fold.add_argument("--method", choices=jobs.METHODS, default="rewrite")
    silver = commands.add_parser("silver", help="new landing files into the silver tables")
    silver.add_argument("--input", required=True)
    silver.add_argument("--warehouse", required=True)
    silver.add_argument("--transit_db", default="transit")
    silver.add_argument("--weather_db", default="meteorology")
    silver.add_argument("--checkpoint", required=True)
    silver.add_argument("--once", action="store_true", help="take what is there and stop")
    defaults = GoldConfig()
    gold = commands.add_parser("gold")
    gold.add_argument("--warehouse", required=True)
    gold.add_argument("--silver_warehouse", required=True)
    gold.add_argument("--transit_db", default="transit")
    gold.add_argument("--weather_db", default="meteorology")
    gold.add_argument("--gold_db", default="gold")
    gold.add_argument("--tz", default=defaults.tz)
    gold.add_argument("--delay_ratio_thresh", type=float, default=defaults.delay_ratio_threshold)
    gold.add_argument("--wx_recent_minutes", type=int, default=defaults.weather_window_minutes)
    gold.add_argument("--window_mode", choices=("slot", "exact"), default=defaults.window_mode)
    gold.add_argument("--slot_minutes", type=int, default=defaults.slot_minutes)
    gold.add_argument("--bucket_tz", default=defaults.bucket_tz)
    gold.add_argument("--wrap_midnight", action="store_true")
    gold.add_argument("--between", nargs=2, metavar=("FROM", "BEFORE"), help="build these hours only")
    gold.add_argument("--changed", action="store_true", help="build what changed since the last such build")
    for job in ("live", "bronze"):
        p = commands.add_parser(job)
        p.add_argument("--input")
        p.add_argument("--format", default="text")
        p.add_argument("--option", action="append", default=[], help="name=value of the source")
        p.add_argument("--warehouse", required=True)
        p.add_argument("--db", default="live")
        p.add_argument("--checkpoint", required=True)
        p.add_argument("--once", action="store_true", help="take what is there and stop")
    return parser


def _documents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    headers = args.headers or HEADERS[args.job]
    if args.quarantine:
        return jobs.documents_or_quarantine(spark, args.input, headers, args.warehouse, args.db, args.format)
    if args.format == "json":
        return read_json_documents(spark, args.input, headers)
    if args.format == "workbook":
        return read_workbooks(spark, args.input, headers)
    return read_documents(spark, args.input)


def _silver(spark: SparkSession, warehouse: str, db: str, name: str) -> DataFrame:
    """A silver table, from the catalog or, where the catalog is new, from its folder."""
    full = f"{db}.{name}"
    if not spark.catalog.tableExists(full):
        location = f"{warehouse.rstrip('/')}/{db}/{name}"
        ensure_namespace_of(spark, full, location)
        spark.catalog.createTable(full, path=location, source="parquet")
    return spark.table(full)


def _gold(spark: SparkSession, args: argparse.Namespace) -> None:
    config = GoldConfig(
        tz=args.tz,
        delay_ratio_threshold=args.delay_ratio_thresh,
        weather_window_minutes=args.wx_recent_minutes,
        window_mode=args.window_mode,
        slot_minutes=args.slot_minutes,
        bucket_tz=args.bucket_tz,
        wrap_midnight=args.wrap_midnight,
    )
    arrivals = tables.arrivals_predictions(args.silver_warehouse, args.transit_db)
    weather = tables.meteorology_current(args.silver_warehouse, args.weather_db)
    for table in (arrivals, weather):
        ensure_table(spark, table)
    timetable = _silver(spark, args.silver_warehouse, args.transit_db, "lines_timetable")
    if args.changed:
        refresh_gold(spark, arrivals, weather, timetable, args.warehouse, args.gold_db, config)
        return
    jobs.build_gold(
        spark,
        spark.table(arrivals.name),
        timetable,
        spark.table(weather.name),
        args.warehouse,
        args.gold_db,
        config,
        between=tuple(args.between) if args.between else None,
    )


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session(f"stopwise-{args.job}")
    if args.job == "arrivals":
        jobs.load_arrivals(spark, _documents(spark, args), args.warehouse, args.db, args.source_tz, args.method)
    elif args.job == "lines":
        jobs.load_lines(spark, _documents(spark, args), args.warehouse, args.db)
    elif args.job == "weather":
        jobs.load_weather(spark, _documents(spark, args), args.warehouse, args.db, args.source_tz, args.method)
    elif args.job == "gold":
        _gold(spark, args)
    elif args.job == "fold":
        jobs.fold_live(spark, args.warehouse, args.live_db, args.warehouse, args.db, args.method)
    elif args.job == "silver":
        names = {"arrivals": args.transit_db, "lines": args.transit_db, "meteorology": args.weather_db}
        trigger = {"availableNow": True} if args.once else None
        write_silver(spark, args.input, args.checkpoint, args.warehouse, names, trigger).awaitTermination()
    else:
        options = dict(o.split("=", 1) for o in args.option)
        trigger = {"availableNow": True} if args.once else None
        if args.job == "live":
            dead = dead_letter_table(f"{args.db}.dead_letter", f"{args.warehouse}/{args.db}/dead_letter")
            messages = stream_messages(spark, args.input, args.format, **options)
            good = tables.live_weather(args.warehouse, args.db)
            query = write_live(messages, good, dead, args.checkpoint, trigger)
        else:
            files = stream_files(spark, args.input, args.format, **options)
            query = write_bronze(files, f"{args.warehouse}/bronze", args.checkpoint, trigger=trigger)
        query.awaitTermination()


if __name__ == "__main__":
    main()
