"""Command line: ``python -m kinfold.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from kinfold.plans.config import ConfigError, compile_config, load_config


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("kinfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinfold")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("status", help="what is installed")
    validate = commands.add_parser("validate-config", help="check a configuration")
    validate.add_argument("config")
    run = commands.add_parser("run", help="run a configuration and write its result as parquet")
    run.add_argument("config")
    run.add_argument("--out", required=True)
    run.add_argument("--root", action="append", help="folders sources may lie in")
    reviews = commands.add_parser("resolve-consensus", help="reviews (csv or jsonl) to decisions per pair")
    reviews.add_argument("reviews")
    reviews.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    if args.command == "status":
        import pyspark

        print(json.dumps({"spark": pyspark.__version__, "python": sys.version.split()[0]}))
        return 0
    if args.command == "resolve-consensus":
        from kinfold.operators.adjudication import active_events, consensus
        from kinfold.sources.readers import import_reviews, read_source

        kind = "jsonl" if args.reviews.endswith((".jsonl", ".json")) else "csv"
        consensus(active_events(import_reviews(read_source(_session(), args.reviews, kind)))).write.mode("overwrite").parquet(args.out)
        return 0
    try:
        plan = compile_config(load_config(args.config))
    except (ConfigError, ValueError) as wrong:
        print(wrong, file=sys.stderr)
        return 2
    if args.command == "validate-config":
        print(json.dumps({"valid": True, "digest": plan.digest, "mode": plan.mode}))
        return 0
    from kinfold.plans.pipeline import run_plan

    run_plan(_session(), plan, args.root).result.write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
