"""Structured Streaming forms: file intake, window dedup, stage tracking, event-time windows and sessions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestone.operators.incremental import to_parse


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a tree as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)


def table_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).parquet(folder)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table in memory: for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def latest_snapshot(spark: SparkSession, snapshot: str, before: int | None = None) -> DataFrame | None:
    """The newest complete snapshot of ``intake``, or that before a batch; None if there is none. Errors of reading are raised."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(snapshot)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{snapshot}/batch=*/_SUCCESS"))
    names = sorted(s.getPath().getParent().toString() for s in done or [])
    names = [n for n in names if before is None or n.rpartition("/")[2] < f"batch={before:012d}"]
    return spark.read.parquet(names[-1]) if names else None


def intake(stream: DataFrame, snapshot: str, checkpoint: str):
    """Keep a snapshot of (path, content_hash): each batch's added and modified paths replace theirs."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        now = df.select("path", F.sha2("content", 256).alias("content_hash")).dropDuplicates(["path"])
        before = latest_snapshot(spark, snapshot, epoch)
        before = spark.createDataFrame([], now.schema) if before is None else before
        fresh = now.join(to_parse(now, before), "path", "left_semi")
        kept = before.join(now.select("path"), "path", "left_anti").unionByName(before.join(now, ["path", "content_hash"], "left_semi"))
        # A batch's snapshot is a folder of its own, complete once _SUCCESS is there; a batch that is run again replaces it.
        kept.unionByName(fresh).write.mode("overwrite").parquet(f"{snapshot}/batch={epoch:012d}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Pieces whose hash was not seen within the watermark: state is bounded by time instead of by a count."""
    return stream.withWatermark(ts, delay).withColumn("hash", F.md5("piece")).dropDuplicatesWithinWatermark(["hash"])


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Extension: counts and sums per window and type. Works on batch and stream."""
    e = events.withWatermark("ts", delay) if delay else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Extension: sessions of a user, ended by a gap."""
    e = events.withWatermark("ts", delay) if delay else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )


def track_stages(stream: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Rows (stage_id, items, errors, done) as stages progress: keyed state over (stage_id, kind, items).

    With ``timeout_ms`` a stage that is silent for so long is given up; such a query needs a running trigger.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            items, errors = state.get
            state.remove()
            yield pd.DataFrame({"stage_id": [key[0]], "items": [items], "errors": [errors], "done": [False]})
            return
        items, errors = state.get if state.exists else (0, 0)
        done = False
        for pdf in batches:
            items += int(pdf.loc[pdf["kind"] == "progress", "items"].sum())
            errors += int((pdf["kind"] == "error").sum())
            done = done or bool((pdf["kind"] == "end").any())
        if done:
            if state.exists:
                state.remove()
        else:
            state.update((items, errors))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"stage_id": [key[0]], "items": [items], "errors": [errors], "done": [done]})

    return stream.groupBy("stage_id").applyInPandasWithState(
        step, "stage_id string, items long, errors long, done boolean", "items long, errors long", "update",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout,
    )
