"""Command line: ``python -m plumbline.cli PATH... [--out DIR] [--var V] [--bbox W,S,E,N] [--start D] [--end D]``."""

from __future__ import annotations

import argparse
import json

from plumbline.sources.files import strict
from plumbline.sources.registry import Options


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline", description="Profile files and folders with Spark.")
    p.add_argument("paths", nargs="+")
    p.add_argument("--out")
    p.add_argument("--var")
    p.add_argument("--bbox", type=lambda s: tuple(float(x) for x in s.split(",")), help="west,south,east,north")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--reuse", action="store_true", help="keep reports that are newer than their files")
    a = p.parse_args(argv)
    if a.bbox and len(a.bbox) != 4:
        p.error("--bbox takes four numbers")
    from pyspark.sql import SparkSession

    from plumbline.plans.explore import explore

    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for path in a.paths:
        for r in explore(spark, path, a.out, Options(a.var, a.bbox, a.start, a.end), a.reuse):
            print(json.dumps(strict(r), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
