"""python -m lexigrove INDEX [-b | -p] [-k N] QUERY...: searches a saved index and prints the documents."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexigrove.plans.search import search, show
from lexigrove.sources.tables import load_index


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = argparse.ArgumentParser(prog="lexigrove", description=__doc__)
    args.add_argument("index")
    mode = args.add_mutually_exclusive_group()
    mode.add_argument("-b", dest="mode", action="store_const", const="boolean", help="AND, OR, NOT and parentheses")
    mode.add_argument("-p", dest="mode", action="store_const", const="phrase", help="words in this order")
    args.add_argument("-k", type=int, help="the first so many documents")
    args.add_argument("query", nargs="+")
    got = args.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    query = got.query if got.mode is None else " ".join(got.query)
    for line in show(search(load_index(spark, got.index), query, got.mode or "free", got.k)):
        print(line)


if __name__ == "__main__":
    main()
