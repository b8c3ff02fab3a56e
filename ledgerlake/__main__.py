"""Command line: list or run registered queries.

    python -m ledgerlake list
    python -m ledgerlake run a1_spending_by_category --data /path/to/tables --out /path/to/result
    python -m ledgerlake explain a5_top_merchants --data /path/to/tables

``run`` uses the active (or a default) SparkSession, so ``spark-submit`` settings
apply; the result is written as parquet (one job, atomic commit).
"""

from __future__ import annotations

import argparse
import sys

from .plans import registry
from .session import apply_base_conf, ensure_checkpoint_dir


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerlake")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--data", required=True, help="folder holding the <table>.parquet inputs")
        if name == "run":
            p.add_argument("--out", required=True)
            p.add_argument("--mode", default="errorifexists")
    args = ap.parse_args(argv)
    registry.load_all()
    if args.cmd == "list":
        for n in sorted(registry.QUERIES):
            print(n, "(oracle)" if n in registry.ORACLE else "")
        return 0
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.appName(f"ledgerlake-{args.query}").getOrCreate()
    apply_base_conf(spark)
    ensure_checkpoint_dir(spark)
    df = registry.QUERIES[args.query](spark, args.data)
    if args.cmd == "explain":
        df.explain("formatted")
    else:
        df.write.mode(args.mode).parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
