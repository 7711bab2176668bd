"""Command line: ``spark-submit`` or ``python -m lodestone PATH --out FOLDER``: a tree as chunks with a token report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodestone.config import CHUNKING, FORMATS, PRESETS, STRATEGIES, Config, replace
from lodestone.plans.pipeline import process_codebase


def parse(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("lodestone", description=__doc__)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--out", default="lodestone-out", help="folder of the chunks")
    for name, known, first in (("strategy", STRATEGIES, "structural"), ("format", FORMATS, "markdown"), ("chunking", CHUNKING, "semantic")):
        group = p.add_mutually_exclusive_group()
        for k in known:
            group.add_argument(f"--{k}", dest=name, action="store_const", const=k)
        p.set_defaults(**{name: first})
    p.add_argument("--preset", choices=sorted(PRESETS))
    p.add_argument("--language", help="only files of a language")
    p.add_argument("--min-complexity", type=float)
    p.add_argument("--cache", help="folder of metadata rows: files that didn't change aren't parsed again")
    p.add_argument("--reset-cache", action="store_true", help="parse all files, whatever the cache has")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> None:
    a = parse(args)
    config = replace(PRESETS[a.preset] if a.preset else Config(), strategy=a.strategy, output_format=a.format, chunking=a.chunking)
    spark = SparkSession.builder.appName("lodestone").config(map=config.spark()).getOrCreate()
    query = {k: v for k, v in (("language", a.language), ("min_complexity", a.min_complexity)) if v is not None}
    before = None
    if a.cache and not a.reset_cache:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{a.cache}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            before = spark.read.parquet(a.cache)
    result = process_codebase(spark, a.path, query or None, config, before=before)
    result.write(a.out)
    if a.cache:
        # The cache is read while it is made anew, so the new one is written beside it first.
        result.files.write.mode("overwrite").parquet(f"{a.cache}.next")
        spark.read.parquet(f"{a.cache}.next").write.mode("overwrite").parquet(a.cache)


if __name__ == "__main__":
    main()
