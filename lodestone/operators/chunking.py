"""Chunks of bounded size: next fit, by cluster, balanced; overlapping byte windows and their dedup."""

from __future__ import annotations

import hashlib
import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.graph import connected_components
from lodestone.schema import B, I, with_field
from lodestone.workdir import Stash

#: A group of up to so many rows is packed by one task; beyond it next fit runs over ranges, with the same result.
GROUP_ROWS = 1 << 20


def _next_fit(size: pd.Series, most: int) -> list[int]:
    out, k, full = [], 0, 0
    for i, s in enumerate(size):
        if i and full + s > most:
            k, full = k + 1, 0
        full += s
        out.append(k)
    return out


def next_fit(items: DataFrame, group: list[str], order: list[str], size: str, most: int, rows: int = GROUP_ROWS) -> DataFrame:
    """``items`` with their chunk within the group: a new one begins when the next item would pass ``most``.

    An item larger than that is a chunk of its own. Groups run side by side. If a group has more than ``rows`` rows, the
    items are cut into ordered ranges: each range says what comes of it for every fill that it may be entered with, the
    driver chains those few rows, and every range then numbers its items by itself.
    """
    most_rows = items.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most_rows > rows:
        return _by_ranges(items, group, order, size, most, max(2, -(-most_rows // rows)))
    schema = with_field(items.schema, "chunk", I)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [o.split()[0] for o in order]
        pdf = pdf.sort_values(names, ascending=[not o.endswith(" desc") for o in order], kind="stable")
        return pdf.assign(chunk=_next_fit(pdf[size], most))

    return items.groupBy(*group).applyInPandas(run, schema)


def range_chain(size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What comes of a range of items entered with an open chunk.

    (c, fill, count): c[k] is the size of the first k items, for those k that an empty chunk has room for; if the open
    chunk takes exactly the first k items, the range ends with a chunk of ``fill[k]`` and has begun ``count[k]`` ones.
    """
    c = np.concatenate(([0], np.cumsum(size)))
    n = len(size)
    first = int(np.searchsorted(c, most, "right"))
    nxt = np.maximum(np.searchsorted(c, c[:-1] + most, "right") - 1, np.arange(n) + 1)
    fill, count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for j in range(n - 1, -1, -1):
        t = int(nxt[j])
        fill[j], count[j] = (c[n] - c[j], 1) if t == n else (fill[t], count[t] + 1)
    keep = min(first, n + 1)
    return c[:keep], fill[:keep], count[:keep]


def entered(c: np.ndarray, fill: np.ndarray, count: np.ndarray, whole: int, rows: int, most: int, f: int | None) -> tuple[int, int, int]:
    """(items that the open chunk takes, fill at the end, chunks begun) of a range of ``rows`` items entered with fill f; None: no chunk is open."""
    k = 0 if f is None else int(np.searchsorted(c, most - f, "right")) - 1
    k = max(k, 0)
    if k == rows:
        return k, (f or 0) + whole, 0
    return k, int(fill[k]), int(count[k])


def _by_ranges(items: DataFrame, group: list[str], order: list[str], size: str, most: int, ranges: int) -> DataFrame:
    spark = items.sparkSession
    stash = Stash(spark)
    keys = [F.col(g) for g in group] + [F.desc(o.split()[0]) if o.endswith(" desc") else F.asc(o) for o in order]
    parts = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Written with the range's number, so that both passes see the same ranges.
    placed = stash.put(items.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    names, down = [*group, *[o.split()[0] for o in order]], [True] * len(group) + [not o.endswith(" desc") for o in order]
    summary = "__part int, __group string, __rank int, rows long, whole long, c array<long>, fill array<long>, count array<long>"

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ascending=down, kind="stable")
        out = []
        for rank, (key, own) in enumerate(pdf.groupby(group, sort=False, dropna=False)):
            s = own[size].to_numpy(np.int64)
            out.append((int(own["__part"].iloc[0]), repr(key), rank, len(s), int(s.sum()), *range_chain(s, most)))
        return pd.DataFrame(out, columns=["__part", "__group", "__rank", "rows", "whole", "c", "fill", "count"])

    # A group spans neighbouring ranges only, and each range's share of it is as many numbers as one chunk has items.
    told = placed.groupBy("__part").applyInPandas(tell, summary).orderBy("__part", "__rank").toLocalIterator()
    begin, now = [], {"group": None, "fill": None, "begun": 0}
    for r in told:
        if r["__group"] != now["group"]:
            now = {"group": r["__group"], "fill": None, "begun": 0}
        begin.append((r["__part"], r["__group"], now["fill"], now["begun"]))
        c, fill, count = (np.array(r[x], np.int64) for x in ("c", "fill", "count"))
        _, end, more = entered(c, fill, count, r["whole"], r["rows"], most, now["fill"])
        now = {"group": now["group"], "fill": end, "begun": now["begun"] + more}
    starts: dict[int, dict] = {}
    for part, key, f, k in begin:
        starts.setdefault(part, {})[key] = (f, k)
    handed = spark.sparkContext.broadcast(starts)
    schema = with_field(items.schema, "chunk", I)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ascending=down, kind="stable")
        mine, out = handed.value[int(pdf["__part"].iloc[0])], []
        for key, own in pdf.groupby(group, sort=False, dropna=False):
            f, begun = mine[repr(key)]
            k, full, chunk = begun - 1, f, []
            for s in own[size]:
                if full is None or full + s > most:
                    k, full = k + 1, 0
                full += s
                chunk.append(k)
            out.append(own.drop(columns="__part").assign(chunk=chunk))
        return pd.concat(out)

    return placed.groupBy("__part").applyInPandas(run, schema)


def metadata_chunks(files: DataFrame, group: list[str], most: int = 1 << 20) -> DataFrame:
    """Most complex first, then next fit on size."""
    return next_fit(files, group, ["complexity desc", "path"], "size", most)


def semantic(spark: SparkSession, items: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Rows (path, cluster, chunk): connected files stay together; clusters are packed whole, singletons included."""
    comps = connected_components(spark, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    placed = items.join(comps, items["path"] == comps["node"], "left").withColumn("cluster", F.coalesce("component", "path"))
    sizes = placed.groupBy("cluster").agg(F.sum("size").alias("size")).withColumn("g", F.lit(0))
    packed = next_fit(sizes, ["g"], ["cluster"], "size", most).select("cluster", "chunk")
    return placed.join(packed, "cluster").select("path", "cluster", "chunk")


def balanced(items: DataFrame, group: list[str], most: int) -> DataFrame:
    """``items`` (path, size, complexity) with a chunk: most complex first, each to the chunk of least size, the first of equal ones.

    There are total size // most + 1 chunks. The greedy order is sequential: a group of numbers runs through one task.
    """
    schema = with_field(items.schema, "chunk", I)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["size"].sum() // most + 1)
        heap = [(0, i) for i in range(n)]
        pdf = pdf.sort_values(["complexity", "path"], ascending=[False, True], kind="stable")
        out = []
        for s in pdf["size"]:
            load, i = heapq.heappop(heap)
            out.append(i)
            heapq.heappush(heap, (load + s, i))
        return pdf.assign(chunk=out)

    return items.groupBy(*group).applyInPandas(run, schema)


def byte_windows(texts: DataFrame, window: int, hop: int, pieces: bool = False) -> DataFrame:
    """Rows (doc_id, start, hash, is_tail) of each text's bytes: all full windows, hop apart, then what is left.

    hash: MD5 of the window. pieces: the windows themselves, too. Null or empty text: no row. One Arrow pass over the bytes.
    """
    if window <= 0 or hop <= 0 or hop > window:
        raise ValueError("window and hop are positive, and the hop is no longer than the window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            at, start, digest, tail, piece, held = [], [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(digest, pa.string()), pa.array(tail, pa.bool_())]
                return pa.RecordBatch.from_arrays(cols + ([pa.array(piece, pa.binary())] if pieces else []), names)

            for i in range(batch.num_rows):
                value = text[i].as_buffer()
                if not value:
                    continue
                b = memoryview(value)
                full = (len(b) - window) // hop + 1 if len(b) >= window else 0
                for k in range(full + 1):
                    w = b[k * hop : k * hop + window] if k < full else b[k * hop :]
                    if len(w):
                        at.append(i)
                        start.append(k * hop)
                        digest.append(hashlib.md5(w).hexdigest())
                        tail.append(k == full)
                        if pieces:
                            piece.append(bytes(w))
                            held += len(w)
                if held > 1 << 22:  # a batch of long texts leaves in parts
                    yield flush()
                    at, start, digest, tail, piece, held = [], [], [], [], [], 0
            yield flush()

    names = ["doc_id", "start", "hash", "is_tail", *["piece"] * pieces]
    kind = texts.select("doc_id").schema[0].dataType.simpleString()
    out = f"doc_id {kind}, start long, hash string, is_tail boolean" + (", piece binary" if pieces else "")
    return texts.select("doc_id", "text").mapInArrow(run, out)


def dedup_windows(windows: DataFrame) -> DataFrame:
    """The first window of each hash by (doc_id, start), and all tails. Firsts are aggregated before they are shuffled."""
    extra = [c for c in windows.columns if c not in ("doc_id", "start", "hash", "is_tail")]
    firsts = windows.where("not is_tail").groupBy("hash").agg(F.min(F.struct("doc_id", "start", *extra)).alias("f"))
    return firsts.select("f.doc_id", "f.start", "hash", F.lit(False).alias("is_tail"), *[F.col(f"f.{c}").alias(c) for c in extra]).unionByName(windows.where("is_tail"))


def dedup_statistics(windows: DataFrame, max_hashes: int = 100_000) -> DataFrame:
    """One row (windows, hashes, duplicates, max_hashes, utilization in percent) of the full windows."""
    per = windows.where("not is_tail").groupBy("hash").agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("windows"), F.count("*").alias("hashes"))
    return out.select(
        "windows", "hashes", (F.col("windows") - F.col("hashes")).alias("duplicates"), F.lit(max_hashes).alias("max_hashes"),
        (F.least("hashes", F.lit(max_hashes)) * F.lit(100.0) / max_hashes).alias("utilization"),
    )


def lru_windows(windows: DataFrame, group: list[str], max_hashes: int = 100_000) -> DataFrame:
    """``windows`` with kept, as a set of at most ``max_hashes`` hashes would decide that drops the least recently seen one.

    The set is sequential by nature: each group is one stream by (doc_id, start). Tails are always kept.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable")
        seen: OrderedDict[str, bool] = OrderedDict()
        out = []
        for h, tail in zip(pdf["hash"], pdf["is_tail"], strict=True):
            if not tail and h in seen:
                seen.move_to_end(h)
                out.append(False)
                continue
            out.append(True)
            if not tail:
                if len(seen) >= max_hashes:
                    seen.popitem(last=False)
                seen[h] = True
        return pdf.assign(kept=out)

    return windows.groupBy(*group).applyInPandas(run, with_field(windows.schema, "kept", B))
