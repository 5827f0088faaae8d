"""Command line: reports, studies, imports and single queries, for spark-submit or python -m tremora.cli."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tremora.operators.lineage import cut
from tremora.operators.trend import SeriesConfig
from tremora.plans import bundle, dashboard, report, research
from tremora.session import build_session
from tremora.sources import fdsn, geojson, pinned
from tremora.sources.catalogs import CatalogStore, exported, read_catalog, region_dictionary, region_key, to_observatory, write_catalog


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tremora")
    commands = top.add_subparsers(dest="command", required=True)
    observatory = commands.add_parser("report", help="observatory report of a catalog file, or of a region of a store")
    observatory.add_argument("catalog", help="a catalog file; with --store, a store's folder")
    observatory.add_argument("--store", action="store_true")
    observatory.add_argument("--json", help="folder for the JSON document")
    observatory.add_argument("--region", default="all")
    observatory.add_argument("--intelligence", action="store_true", help="with time series, trend and index")
    observatory.add_argument("--frequency", choices=("daily", "weekly", "monthly"), default="daily")
    observatory.add_argument("--baseline-lookback", type=_positive, default=30, help="periods of history that a score rests on")
    observatory.add_argument("--recent-periods", type=_positive, default=14, help="periods that are listed")
    for name in ("start", "end"):
        observatory.add_argument(f"--{name}", type=datetime.fromisoformat, help="bound of event times")
    study = commands.add_parser("research", help="research bundle of a catalog, faults and boundary steps")
    for name in ("catalog", "faults", "steps", "out"):
        study.add_argument(name)
    fetched = commands.add_parser("research-download", help="the same of an event service and the pinned files of faults and steps")
    for name in ("url", "out"):
        fetched.add_argument(name)
    fetched.add_argument("--by", choices=("planned", "month", "whole"), default="planned")
    profile = research.Profile()
    for command in (study, fetched):
        for name in ("start", "end"):
            command.add_argument(f"--{name}", type=datetime.fromisoformat, default=getattr(profile, name))
        for name in ("minimum_magnitude", "fault_radius_km", "boundary_radius_km"):
            command.add_argument(f"--{name.replace('_', '-')}", type=float, default=getattr(profile, name))
        command.add_argument("--sources", help="JSON configuration of sources")
    again = commands.add_parser("restudy", help="run the along-boundary study of a bundle again")
    again.add_argument("bundle")
    again.add_argument("--minimum-magnitude", type=float, default=6.0)
    shown = commands.add_parser("dashboard", help="dashboard JSON of a bundle")
    for name in ("bundle", "out"):
        shown.add_argument(name)
    ingest = commands.add_parser("ingest", help="merge GeoJSON feeds into a store")
    for name in ("feeds", "store", "region", "start", "end"):
        ingest.add_argument(name)
    ingest.add_argument("--minimum-magnitude", type=float)
    build = commands.add_parser("build", help="download the events of a region and merge them into a store")
    for name in ("url", "store", "regions"):
        build.add_argument(name)
    build.add_argument("--region", help="by default the configuration's own")
    build.add_argument("--start-year", type=int, required=True)
    build.add_argument("--end-year", type=int, required=True)
    build.add_argument("--minimum-magnitude", type=float, help="by default the region's own")
    build.add_argument("--by", choices=("planned", "month", "whole"), default="planned")
    build.add_argument("--reports", help="folder for catalog files and the activity report")
    export = commands.add_parser("export", help="write a catalog in the export columns")
    for name in ("catalog", "out"):
        export.add_argument(name)
    return top


def _positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return value


def _report(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.store:
        events = to_observatory(CatalogStore(spark, args.catalog).load(args.region))
    else:
        catalog = read_catalog(spark, args.catalog)
        events = catalog if "event_time_utc" in catalog.columns else to_observatory(catalog)
    if args.start:
        events = events.where(F.col("event_time_utc") >= F.lit(args.start))
    if args.end:
        events = events.where(F.col("event_time_utc") < F.lit(args.end))
    if args.intelligence:
        made = cut(report.intelligence_report(events, SeriesConfig(args.frequency, args.baseline_lookback), args.recent_periods, region=args.region))
        print(report.render_intelligence(made.first()))
    else:
        made = cut(report.observatory_report(events, args.region))
        print(report.render(made.first()))
    if args.json:
        report.save_json(made, args.json)


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    regions, default = region_dictionary(spark, args.regions)
    region = regions[region_key(args.region) if args.region else default]
    start, end = datetime(args.start_year, 1, 1), datetime(args.end_year + 1, 1, 1)
    least = region.minimum_magnitude if args.minimum_magnitude is None else args.minimum_magnitude
    events = cut(fdsn.download(spark, args.url, fdsn.EventQuery(start, end, *region.box, least), args.by))
    counts = CatalogStore(spark, args.store).update(region.key, events, start, end, region.box, least)
    print(counts.first().asDict())
    if args.reports:
        stem = bundle.catalog_stem(region.key, args.start_year, args.end_year)
        bundle.write_catalog_files(events, counts, stem, f"{args.reports}/raw", f"{args.reports}/processed")
        bundle.write_activity_report(to_observatory(events), args.reports, region.key)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    if args.command == "report":
        _report(spark, args)
    elif args.command in ("research", "research-download"):
        profile = research.Profile(args.start, args.end, args.minimum_magnitude, args.fault_radius_km, args.boundary_radius_km)
        configured = pinned.load_sources(spark, args.sources)
        if args.command == "research-download":
            counts = research.run_from_sources(spark, args.out, args.url, profile, configured, args.by)
            print("\n".join(f"{name}: {n} rows" for name, n in counts.items()))
            return
        cited = {f"{s}.{k}": pinned.citation(configured, s, k) for s, k in (pinned.GEM, pinned.PB2002)}
        for name, n in research.run(spark, args.out, read_catalog(spark, args.catalog), args.faults, args.steps, profile, cited).items():
            print(f"{name}: {n} rows")
    elif args.command == "restudy":
        print(bundle.restudy_along(spark, args.bundle, args.minimum_magnitude)["along_boundary"])
    elif args.command == "dashboard":
        needed = ("events", "boundary_associations", "fault_associations", "interaction_pairs", "interaction_windows", *dashboard.STUDY)
        tables = bundle.open_bundle(spark, args.bundle, needed, bundle.BUNDLE_VERSION)
        for name, n in dashboard.write_dashboard(tables, args.out).items():
            print(f"{name}: {n} rows")
    elif args.command == "ingest":
        start, end = datetime.fromisoformat(args.start), datetime.fromisoformat(args.end)
        events, counts = geojson.ingest(geojson.read_features(spark, args.feeds), start, end, None, args.minimum_magnitude)
        print(counts.first().asDict())
        print(CatalogStore(spark, args.store).update(args.region, events, start, end).first().asDict())
    elif args.command == "build":
        _build(spark, args)
    else:
        write_catalog(exported(read_catalog(spark, args.catalog)), args.out)


if __name__ == "__main__":
    main()
