"""python -m weftgraph ROOT [--out FOLDER] [--bundle FILE] [--compact]: analyses a source tree."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from weftgraph.plans import analysis
from weftgraph.sources import settings, stores


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("weftgraph", description="Dependency-graph analytics of a source tree.")
    p.add_argument("root")
    p.add_argument("--out", help="folder for the Parquet tables")
    p.add_argument("--bundle", help="file for the JSON bundle")
    p.add_argument("--compact", action="store_true", help="dictionary-encode the bundle")
    p.add_argument("--external", action="store_true", help="keep edges to what lies outside")
    p.add_argument("--max-bytes", default=10**8, type=int)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    given = settings.load(args.root)
    s = settings.from_mapping({"include_external": args.external or given.include_external, "max_file_bytes": args.max_bytes}, given)
    a = analysis.analyze(spark, args.root, s)
    if args.out:
        analysis.save(a, args.out)
    if args.bundle:
        stores.write_document(analysis.bundle(a, compact=args.compact, name=args.root.rstrip("/").rpartition("/")[2]), args.bundle)
    if not args.out and not args.bundle:
        for name, df in analysis.summary_tables(a).items():
            print(f"\n{name}")
            df.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
