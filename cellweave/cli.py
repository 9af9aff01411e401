"""python -m cellweave.cli stages | queries | run NAME SF_DIR [OUT] | chain LAYERS OUT --side N --res M [--stages a,b]"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cellweave", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    sub.add_parser("stages")
    sub.add_parser("queries")
    r = sub.add_parser("run")
    r.add_argument("name")
    r.add_argument("sf_dir")
    r.add_argument("out", nargs="?")
    c = sub.add_parser("chain")
    c.add_argument("layers")
    c.add_argument("out")
    c.add_argument("--side", type=int, required=True)
    c.add_argument("--res", type=float, default=40.0)
    c.add_argument("--year", type=int, default=2026)
    c.add_argument("--stages", default="terrain,habitat,behavior,access")
    a = p.parse_args(args)

    import cellweave.queries  # noqa: F401
    from cellweave import core
    from cellweave.plans import stages

    if a.do == "stages":
        print(*stages.STAGES, sep="\n")
        return 0
    if a.do == "queries":
        print(*core.QUERIES, sep="\n")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("cellweave").getOrCreate()
    if a.do == "run":
        df = core.QUERIES[a.name](spark, a.sf_dir)
    else:
        df = stages.run(spark.read.parquet(a.layers), {"sides": (a.side, a.side), "res": a.res, "year": a.year}, a.stages.split(","))
    df.write.mode("overwrite").parquet(a.out) if a.out else df.show(20, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
