"""Command line: take exports into a store, watch a folder, make synthetic quotes, or run the whole evidence chain."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tickloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "watch"):
        p = commands.add_parser(name)
        p.add_argument("inbox")
        p.add_argument("store")
        p.add_argument("--pairs", default="")
        p.add_argument("--once", action="store_true")
        p.add_argument("--archive", default="")
    p = commands.add_parser("demo")
    p.add_argument("store")
    p.add_argument("first")
    p.add_argument("last")
    p = commands.add_parser("run")
    p.add_argument("store")
    p.add_argument("out")
    p.add_argument("first", type=int)
    p.add_argument("last", type=int)
    p.add_argument("--pairs", default="")
    p.add_argument("--draws", type=int)
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tickloom.frozen import FROZEN, inconsistencies
    from tickloom.operators.quotes import month_of
    from tickloom.plans.evidence import whole_run
    from tickloom.sources import exports, synthetic
    from tickloom.streaming.bars import take_in, watch_exports

    if wrong := inconsistencies():
        print("\n".join(wrong), file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    pairs = tuple(p.strip().upper() for p in getattr(args, "pairs", "").split(",") if p.strip())
    if args.command == "ingest":
        new = exports.read_exports(spark, args.inbox, list(pairs) or None)
        if new.isEmpty():
            print("nothing to take in", file=sys.stderr)
            return 1
        print(take_in(spark, new, args.store))
    elif args.command == "watch":
        watch_exports(spark, args.inbox, args.store, lambda f, why: print(f"{f}: {why}", file=sys.stderr), once=args.once, archive=args.archive or None, pairs=list(pairs) or None).awaitTermination()
    elif args.command == "demo":
        exports.write_store(synthetic.generate(spark, args.first, args.last).withColumn("yyyymm", month_of()), args.store)
    else:
        quotes = exports.read_store(spark, args.store).withColumn("tick_id", F.col("seq"))
        pairs = pairs or FROZEN.primary
        quotes = quotes.where(F.col("sym").isin(*pairs))
        if quotes.isEmpty():
            print("no quotes of these pairs", file=sys.stderr)
            return 1
        print(whole_run(spark, quotes, args.first, args.last, args.out, pairs, args.draws, args.store)["verdict"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
