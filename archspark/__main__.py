"""python -m archspark PATH: analyses a source tree, or with --config several repositories."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import values as V
from .operators.multirepo import analyze_all
from .plans.analyze import analyze
from .sources.export import save_json, summary, write_tables


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="archspark", description="Analyses the architecture of source trees.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-o", "--output", default="architecture.json")
    p.add_argument("--tables", help="also write the tables as Parquet below this folder")
    p.add_argument("--max-file-size", type=int, default=V.MAX_FILE_SIZE)
    p.add_argument("--max-symbols", type=int, default=V.MAX_SYMBOLS, help="0 keeps all")
    p.add_argument("--preview-lines", type=int, default=V.PREVIEW_LINES, help="accepted; previews have a fixed length")
    p.add_argument("--pretty", action="store_true", default=True)
    p.add_argument("--compact", action="store_true")
    p.add_argument("--config", help="a JSON file that names repositories")
    a = p.parse_args(args)
    if not (os.path.isfile(a.config) if a.config else os.path.isdir(a.path)):
        print(f"Error: {a.config or a.path} does not exist", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("archspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        arch = analyze_all(spark, a.config, a.max_file_size, a.max_symbols) if a.config else analyze(spark, a.path, a.max_file_size, a.max_symbols)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if a.tables:
        write_tables(arch, a.tables)
    print(summary(save_json(arch, a.output, a.compact)))
    print(f"\nOutput: {a.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
