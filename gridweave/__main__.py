"""Copy or convert a table: ``python -m gridweave INPUT OUTPUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gridweave.sources.tables import copy_table


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridweave", description="Copy a table; the suffixes name the formats.")
    parser.add_argument("input")
    parser.add_argument("output")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("gridweave").getOrCreate()
    metrics = copy_table(spark, args.input, args.output)
    print(f"{metrics.rows} rows in {metrics.elapsed:.1f} s: {args.output}")


if __name__ == "__main__":
    main()
