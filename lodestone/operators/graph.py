"""Connected components of an undirected graph given as rows, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.workdir import Stash, small

#: A graph of up to so many edges (two ids each) is labelled by one task; beyond it by rounds over all tasks, with the same result.
TASK_EDGES = 1 << 20


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over rows (a, b): every node's neighbours are linked to the least of them.

    Large star links the larger neighbours, small star the smaller ones and the node itself.
    """
    if large:
        arcs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = arcs.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").union(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of nodes 0 .. n - 1."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not any(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    ends = [table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("a", "b")]
    names, code = np.unique(np.concatenate(ends), return_inverse=True)
    label = labels(code[: len(ends[0])], code[len(ends[0]) :], len(names))
    kind = table.schema.field("a").type
    yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(names[label], kind)], ["node", "component"])


def connected_components(spark: SparkSession, edges: DataFrame, stash: Stash | None = None, rows: int = TASK_EDGES) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Nulls and self edges: an edge with a null end is ignored; a self edge makes its node a component of one.
    Duplicate edges change nothing. No edges: no rows. More than ``rows`` edges are labelled in rounds: each is written to the shared folder, so that
    lineage stays short; the rounds go on until every node points at its component's least node, which takes
    O(log^2 n) of them.
    """
    stash = stash or Stash(spark)
    clean = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null")
    clean = stash.put(clean.distinct())
    if small(clean, rows):
        kind = clean.schema["a"].dataType
        return clean.coalesce(1).mapInArrow(_in_one_task, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    nodes = clean.select(F.col("a").alias("node")).union(clean.select(F.col("b").alias("node"))).distinct()
    now = clean.where("a <> b")
    before = None
    while True:
        nxt = stash.put(_star(_star(now, True), False))
        if before is not None:
            stash.drop(now)
        # Converged: every a has one b, and no b is itself an a.
        left = nxt.select(F.col("b").alias("a")).distinct().join(nxt.select("a"), "a", "left_semi").limit(1).count()
        many = 0 if left else nxt.groupBy("a").count().where("count > 1").limit(1).count()
        before, now = now, nxt
        if not left and not many:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("component", "node").alias("component"))
