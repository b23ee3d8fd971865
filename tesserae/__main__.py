"""python -m tesserae advise --table PARQUET --relation NAME --workload JSON --budget N --out FOLDER"""

from __future__ import annotations

import argparse
import sys
from decimal import Decimal

from pyspark.sql import SparkSession

from tesserae.plans import costs
from tesserae.plans.advise import advise
from tesserae.sources.workload import read_workload


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tesserae")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("advise", help="recommend statistics for one table")
    for name in ("table", "relation", "workload", "budget", "out"):
        one.add_argument(f"--{name}", required=True)
    one.add_argument("--target", type=int, default=100)
    one.add_argument("--mcv-ms", type=float)
    one.add_argument("--fd-ms", type=float)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    cost = costs.measured(given.mcv_ms, given.fd_ms) if given.mcv_ms is not None and given.fd_ms is not None else costs.preset()
    try:
        table, queries = spark.read.parquet(given.table), read_workload(spark, given.workload)
        found = advise(table, given.relation, queries, Decimal(given.budget), cost, given.out, given.target)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    print("\n".join(found["plan"]["deploy"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
