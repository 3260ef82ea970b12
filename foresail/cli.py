"""Command line: validate, run, report and risk. Exit codes: 0 done, 1 data or gate refused, 2 wrong use."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .config import load_config
from .errors import ConfigError, ForesailError
from .plans import run as plans
from .plans.gate import load_gate


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foresail", description=__doc__)
    parser.add_argument("command", choices=("validate", "run", "report", "risk"))
    parser.add_argument("config")
    parser.add_argument("--gate")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--thresholds", default="0.02,0.05,0.1", help="simple losses")
    parser.add_argument("--cache", default="cache")
    args = parser.parse_args(argv)
    try:
        config, warnings = load_config(args.config)
        gate = load_gate(args.gate) if args.gate else None
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    except ForesailError as e:
        print(e, file=sys.stderr)
        return 1
    for w in warnings:
        print(f"warning: {w}")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "validate":
        bad = 0
        for name, found in plans.profiles(spark, config, args.cache).items():
            if isinstance(found, ForesailError):
                print(f"{name}: {found}", file=sys.stderr)
                bad = 1
            else:
                found.show(truncate=False)
        return bad
    try:
        folder: Path = plans.run(spark, config, warnings, gate, args.force, args.cache)
        print(folder)
        if args.command in ("run", "report"):
            print(plans.report(spark, folder, config, gate))
        if args.command == "risk":
            print(plans.risk(spark, folder, config, [float(x) for x in args.thresholds.split(",")]))
    except ForesailError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
