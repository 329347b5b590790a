"""Command line: python -m veiltrack.plans.cli [-c CONFIG] [-q SHAPES] [-o OUT] [-k KML] SOURCE."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators.privacy import sum_counters
from ..session import ship_package
from ..sinks.csv import counter_lines, write_trip_files
from ..sinks.kml import trip_kml, write_kml
from ..sources.shapes import read_shapes
from ..sources.trips import number_points, read_list, read_mapped_trips, read_trips, readable, trip_counters
from .config import DIConfig, load_json, parse_config
from .pipeline import run


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="veiltrack", description="Removes the points of trips that give away where people stay.")
    p.add_argument("source", help="trip file, or with --list a file of one path a line")
    p.add_argument("-c", "--config", help="parameters, key:value lines or JSON (.json)")
    p.add_argument("-q", "--quad", help="shape file of the roads")
    p.add_argument("-o", "--out", default=".", help="folder for the trips that are kept")
    p.add_argument("-k", "--kml", default="", help="folder for KML, if the parameters ask for it")
    p.add_argument("-l", "--list", action="store_true", help="source is a list of paths")
    p.add_argument("-n", "--count", action="store_true", help="print the counters of the run")
    p.add_argument("-m", "--mapped", action="store_true", help="files of any layout, with several trips each")
    p.add_argument("-v", "--verbose", action="store_true", help="a line for each stage of the run on standard error")
    p.add_argument("--legacy-config", action="store_true", help="read two keys as older versions did")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("veiltrack").getOrCreate()
    ship_package(spark)
    config = DIConfig()
    if args.config:
        text = Path(args.config).read_text()
        config = load_json(text) if args.config.endswith(".json") else parse_config(text, args.legacy_config)
    paths = [p for p, _ in read_list(spark, args.source)] if args.list else [args.source]
    there = readable(spark, paths)
    for path in set(paths) - set(there):
        print(f"passed over, can't be read: {path}", file=sys.stderr)
    if not there:
        return 1
    records = read_mapped_trips(spark, there, config.lat_field, config.lon_field, config.heading_field, config.speed_field, config.time_field, tuple(config.uid_columns)) if args.mapped else read_trips(spark, there)
    edges = read_shapes(spark, args.quad).edges.drop("file", "seq") if args.quad else None
    result = run(number_points(records), edges, config, trip_counters(records), progress=(lambda line: print(line, file=sys.stderr)) if args.verbose else None)
    write_trip_files(result.kept, args.out, ".di.csv" if args.mapped else ".csv", trip_ids=result.marked)
    if config.plot_kml:
        write_kml(trip_kml(result.marked, result.critical.unionByName(result.private), config.fit_scale, config.fit_extension), args.kml or args.out)
    if args.count:
        print(counter_lines(sum_counters(result.counters)).first()[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
