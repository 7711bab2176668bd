"""Metric series and stage records: retention, summaries, bottlenecks, advice, exports, breakers and health."""

from __future__ import annotations

import time
from contextlib import contextmanager
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.schema import B, S, with_field


def last_points(metrics: DataFrame, n: int = 1000) -> DataFrame:
    """The newest points of each metric; rows (metric, ts, value, id), equal times by id."""
    w = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("id"))
    return metrics.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def latest(metrics: DataFrame) -> DataFrame:
    newest = F.max_by(F.col("value"), F.struct("ts", "id"))
    return metrics.groupBy("metric").agg(newest.alias("value"))


def derived(stages: DataFrame) -> DataFrame:
    """Stage records with duration and rates; 0 where the duration is."""
    d = F.when(F.col("end").isNull(), F.lit(0.0)).otherwise(F.col("end") - F.col("start"))
    rate = lambda c: F.when(F.col("duration") > 0, F.col(c) / F.col("duration")).otherwise(F.lit(0.0))
    return stages.withColumn("duration", d).withColumn("items_per_s", rate("items")).withColumn("bytes_per_s", rate("bytes"))


def stage_summary(stages: DataFrame) -> DataFrame:
    """Per stage name: counts and totals of all records, durations of completed ones."""
    done = F.when(F.col("end").isNotNull(), F.col("end") - F.col("start"))
    return stages.groupBy("stage").agg(
        F.count("*").alias("n"), F.avg(done).alias("avg_s"), F.min(done).alias("min_s"), F.max(done).alias("max_s"),
        F.sum("items").alias("items"), F.sum("bytes").alias("bytes"), F.sum("errors").alias("errors"),
    )


def memory_report(stages: DataFrame) -> DataFrame:
    d = F.col("end") - F.col("start")
    return stages.groupBy("stage").agg(
        F.avg(d).alias("avg_s"), F.max(d).alias("max_s"), F.min(d).alias("min_s"),
        F.avg(F.col("memory_peak") - F.col("memory_start")).alias("memory_delta"), F.count("*").alias("n"),
    )


def system_summary(samples: DataFrame) -> DataFrame:
    """One row over (ts, id, cpu, memory)."""
    at = F.struct("ts", "id")
    return samples.agg(
        F.avg("cpu").alias("cpu_avg"), F.max("cpu").alias("cpu_max"), F.avg("memory").alias("memory_avg"), F.max("memory").alias("memory_max"),
        (F.max_by("memory", at) - F.min_by("memory", at)).alias("memory_growth"),
    )


def errors_by_stage(stages: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows (stage, n): error points (stage_id) of known stage records, by the record's stage name.

    Points are counted per stage_id before they meet the records.
    """
    per = errors.where("stage_id is not null").groupBy("stage_id").agg(F.count("*").alias("k"))
    return stages.select("stage_id", "stage").join(per, "stage_id").groupBy("stage").agg(F.sum("k").alias("n"))


def bottlenecks(stages: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows (type, stage, severity, value, suggestion): what slows a pipeline.

    slow_stage: a name whose mean duration is over half of the longest one's, which is high, the others medium. memory_growth:
    every record whose peak is over twice its start. high_error_rate: a name with more than ten error points (stage_id).
    io_bottleneck: one row, stage null, if records use less than half a CPU at under 10 MB/s; its value is how many.
    """
    per = stages.where(F.col("end").isNotNull()).groupBy("stage").agg(F.avg(F.col("end") - F.col("start")).alias("value"))
    top = per.withColumn("top", F.max("value").over(Window.partitionBy()))  # over one row per stage name
    slow = top.where("value > 0.5 * top").select(
        F.lit("slow_stage").alias("type"), "stage", severity(F.col("value"), F.col("top")).alias("severity"), "value"
    )
    grown = stages.where("memory_peak > 2 * memory_start").select(
        F.lit("memory_growth").alias("type"), "stage", F.lit("high").alias("severity"), (F.col("memory_peak") - F.col("memory_start")).cast("double").alias("value")
    )
    failing = errors_by_stage(stages, errors).where("n > 10").select(
        F.lit("high_error_rate").alias("type"), "stage", F.lit("high").alias("severity"), F.col("n").cast("double").alias("value")
    )
    waiting = derived(stages).where((F.col("cpu") < 50) & (F.col("bytes_per_s") / (1 << 20) < 10)).agg(F.count("*").cast("double").alias("value")).where("value > 0")
    waiting = waiting.select(F.lit("io_bottleneck").alias("type"), F.lit(None).cast("string").alias("stage"), F.lit("medium").alias("severity"), "value")
    advice = (
        F.when(F.col("type") == "slow_stage", F.concat(F.lit("optimise "), "stage"))
        .when(F.col("type") == "memory_growth", F.concat(F.lit("stream or split the input of "), "stage"))
        .when(F.col("type") == "high_error_rate", F.concat(F.lit("look into the errors of "), "stage"))
        .otherwise("little CPU at low throughput: the input is the limit")
    )
    return slow.unionByName(grown).unionByName(failing).unionByName(waiting).withColumn("suggestion", advice)


def waiting_stages(stages: DataFrame) -> DataFrame:
    """Rows (stage, n): the records behind io_bottleneck, by name."""
    return derived(stages).where((F.col("cpu") < 50) & (F.col("bytes_per_s") / (1 << 20) < 10)).groupBy("stage").agg(F.count("*").alias("n"))


def severity(value: Column, top: Column) -> Column:
    return F.when(value == top, "high").otherwise("medium")


def _advice(df: DataFrame, *rules: tuple[Column, str, str]) -> DataFrame:
    found = F.array(*[F.when(c, F.struct(F.lit(k).alias("category"), F.lit(t).alias("advice"))) for c, k, t in rules])
    return df.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select("a.category", "a.advice")


def suggestions(stages: DataFrame, system: DataFrame, metrics: DataFrame) -> DataFrame:
    """Rows (category, advice). ``system``: one row of system_summary; ``metrics``: (metric, value)."""
    cpu = F.coalesce("cpu_avg", F.lit(0.0))
    a = _advice(
        system,
        (cpu < 50, "resource_utilization", "more workers: the CPUs are idle"),
        ((cpu >= 50) & (F.col("cpu_max") > 90), "resource_utilization", "CPU bound: a lower level or a faster codec"),
        (F.col("memory_growth") > 1 << 30, "memory_management", "memory grows: stream, or use smaller batches"),
    )
    rate = derived(stages).where("end is not null and items > 0").groupBy("stage").agg(F.avg("items_per_s").alias("r"))
    name = F.lower("stage")
    b = _advice(
        rate.where("r < 100"),
        (name.contains("parsing"), "stage_optimization", "parsing is slow: use expressions instead of a full parser"),
        (~name.contains("parsing") & name.contains("compression"), "stage_optimization", "compression is slow: a lower level or a faster codec"),
    )
    m = metrics.agg(
        F.avg(F.when(F.col("metric") == "batch_size", F.col("value"))).alias("batch"),
        F.avg(F.when((F.col("metric") == "cache_hit") & F.col("value").isin(0.0, 1.0), F.col("value"))).alias("hit"),
    )
    c = _advice(
        m,
        (F.col("batch") < 10, "batching", "batches are small"),
        (F.col("batch") > 1000, "batching", "batches are large"),
        (F.col("hit") < 0.5, "caching", "few cache hits: a larger cache or longer life"),
    )
    return a.unionByName(b).unionByName(c)


def config_advice(results: DataFrame) -> DataFrame:
    """Rows (category, advice) for (mb_per_s, files_per_min, memory_mb, memory_limit_mb)."""
    return _advice(
        results,
        (F.col("mb_per_s") < 100, "compression", "a lower compression level"),
        (F.col("memory_mb") > 0.8 * F.col("memory_limit_mb"), "memory", "smaller batches or windows"),
        (F.col("files_per_min") < 1000, "throughput", "more workers"),
    )


def prometheus(metrics: DataFrame) -> DataFrame:
    """One row, value: a gauge per metric in the text exposition format, in order of name."""
    last = latest(metrics).select("metric", F.concat(F.lit("# TYPE "), "metric", F.lit(" gauge\n"), "metric", F.lit(" "), F.col("value").cast("string")).alias("line"))
    return last.agg(F.array_join(F.array_sort(F.collect_list(F.struct("metric", "line")))["line"], "\n").alias("value"))


def to_json(metrics: DataFrame, n: int = 100) -> DataFrame:
    """Rows (metric, json): the newest points of a metric as JSON, oldest first."""
    pts = last_points(metrics, n).groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "value"))).alias("p"))
    return pts.select("metric", F.to_json(F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["value"].alias("value")))).alias("json"))


def grafana_dashboard(metrics: list[str]) -> dict:
    """A dashboard of one panel per metric."""
    return {"title": "lodestone", "panels": [{"id": i + 1, "title": m, "type": "timeseries", "targets": [{"expr": m}]} for i, m in enumerate(metrics)]}


def percentiles(metrics: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Rows (group, p50, p95, mean, std): interpolated percentiles, mean and population deviation."""
    v = F.col(value)
    return metrics.groupBy(*group).agg(
        F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )


def batch_size(sizes: DataFrame, group: list[str], memory: float, size: str = "value") -> DataFrame:
    """Rows (group, batch): how many items of the mean size fit in half the memory twice over, from 1 to 1000."""
    n = F.floor(F.lit(float(memory)) * F.lit(0.5) / (F.avg(size) * 2))
    return sizes.groupBy(*group).agg(F.greatest(F.lit(1), F.least(F.lit(1000), n)).cast("long").alias("batch"))


class Profiler:
    """Wall-clock records of stages that a driver runs: a context manager per stage, or a decorator; rows for ``derived``."""

    def __init__(self, enabled: bool = True):
        self.enabled, self.records = enabled, []

    @contextmanager
    def stage(self, name: str):
        """Records (stage_id, stage, start, end, items, bytes, errors); an error is counted and goes on."""
        record = {"stage_id": len(self.records), "stage": name, "start": time.time(), "end": None, "items": 0, "bytes": 0, "errors": 0}
        if self.enabled:
            self.records.append(record)
        try:
            yield record
        except Exception:
            record["errors"] += 1
            raise
        finally:
            record["end"] = time.time()

    def profiled(self, name: str):
        def wrap(f):
            @wraps(f)
            def run(*args, **kwargs):
                with self.stage(name):
                    return f(*args, **kwargs)

            return run

        return wrap

    def rows(self, spark: SparkSession) -> DataFrame:
        schema = "stage_id long, stage string, start double, end double, items long, bytes long, errors long"
        return spark.createDataFrame([tuple(r.values()) for r in self.records], schema)


def hit_rate(counts: DataFrame) -> DataFrame:
    """``counts`` (hits, misses) with the rate in percent, two places; 0 if there was no look-up."""
    n = F.col("hits") + F.col("misses")
    return counts.withColumn("hit_rate", F.when(n > 0, F.round(F.col("hits") * F.lit(100.0) / n, 2)).otherwise(F.lit(0.0)))


def breaker(calls: DataFrame, failures: int = 5, timeout: float = 60.0, successes: int = 2) -> DataFrame:
    """``calls`` (user_id, event_id, t, failed) with the breaker's state before each call, and whether it was let through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"], kind="stable")
        state, bad, good, since, states, passed = "closed", 0, 0, 0.0, [], []
        for t, failed in zip(pdf["t"], pdf["failed"], strict=True):
            if state == "open" and t - since >= timeout:
                state, good = "half_open", 0
            states.append(state)
            passed.append(state != "open")
            if state == "open":
                continue
            if failed:
                bad += 1
                if state == "half_open" or bad >= failures:
                    state, since = "open", t
            else:
                good, bad = good + 1, 0
                if state == "half_open" and good >= successes:
                    state = "closed"
        return pdf.assign(state=states, passed=passed)

    return calls.groupBy("user_id").applyInPandas(run, with_field(with_field(calls.schema, "state", S), "passed", B))


def failure_streaks(calls: DataFrame) -> DataFrame:
    """``calls`` (user_id, event_id, t, failed) with the number of failures in a row up to each, and whether that is the third."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    part = F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w)
    run = Window.partitionBy("user_id", "part").orderBy("t", "event_id")
    streak = F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(run)
    return calls.withColumn("part", part).withColumn("streak", streak).drop("part").withColumn("recover", F.col("streak") == 3)
