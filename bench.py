"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. A query counts as the median of its warm runs."""

from __future__ import annotations

import json
import os
import re
import statistics
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, store
from lodestone.plans import bindings, catalog

RUNS = 5
NAMES = (
    "corpus_totals", "language_counts", "content_hash_dups", "basic_complexity", "complexity_histogram", "select_by_query",
    "signatures", "security_verdicts", "change_detection", "import_edges", "top_imports", "next_fit_chunks", "window_dedup",
    "metric_retention", "stage_summary", "bottlenecks", "consecutive_failures",
)


def files_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discover, parse, structural projection, chunks: the whole job over documents as files."""
    files = bindings.code(spark, sf_dir).withColumn("imports", F.array().cast("array<string>"))
    shaped = store.structural(files).withColumn("size", F.length(F.to_json(F.struct("imports", "functions", "classes", "constants"))).cast("long"))
    return chunking.next_fit(shaped.select(F.split("path", "/")[0].alias("source"), "path", "size"), ["source"], ["path"], "size", 50_000)


def control(texts: list[str]) -> float:
    """Seconds of one Python thread for the structural patterns over the same rows."""
    patterns = [re.compile(p) for p in (r"def\s+(\w+)\s*\([^)]*\)", r"class\s+(\w+)", r"[A-Z_]+\s*=\s*['\"\d]", r"\w+|[^\w\s]")]
    start = time.perf_counter()
    for t in texts:
        for p in patterns:
            p.findall(t)
    return time.perf_counter() - start


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {"files_pipeline": files_pipeline} | {n: catalog.queries()[n] for n in NAMES}
    seconds = {}
    for name, f in todo.items():
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").toPandas()["text"].tolist()
    mb = sum(len(t.encode()) for t in docs) / 1e6
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "files_per_s": round(len(docs) / seconds["files_pipeline"]), "mb_per_s": round(mb / seconds["files_pipeline"], 1),
        "control_python_files_per_s": round(len(docs) / control(docs)), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
