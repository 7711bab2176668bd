"""Fitting small numpy models to a bounded sample of labelled rows, in one task."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Model = dict[str, np.ndarray]


def labelled(spark: SparkSession, sf_dir: str, label: str, per_class: int) -> DataFrame:
    """Rows (doc_id, text, y): at most ``per_class`` labelled documents of either class, drawn by a hash of doc_id.

    Labels of null, or documents of null text, are left out; a doc_id labelled more than once takes the greatest.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    labels = labels.where("doc_id is not null and y is not null")
    some = [
        labels.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    return docs.where("text is not null").join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("doc_id", "text", "y")


def fit(sample: DataFrame, how: Callable[[pa.Table], Model]) -> Model | None:
    """``how`` over all rows of ``sample``, in order of doc_id, in one task. None if there is no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = sum(b.num_rows for b in held)
        if rows:
            table = pa.Table.from_batches(held)
            table = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
            out = io.BytesIO()
            np.savez(out, **how(table))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    if not rows:
        return None
    with np.load(io.BytesIO(rows[0]["model"])) as z:
        return {k: z[k] for k in z.files}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    """Adam steps over a dict of arrays, in place."""

    def __init__(self, params: Model, rate: float, decay: float = 0.0):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Model) -> None:
        self.t += 1
        c = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= c * self.m[k] / (np.sqrt(self.v[k]) + 1e-8) + self.rate * self.decay * self.p[k]


def scatter(idx: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Row sums of ``x`` by index, as (n, columns)."""
    return np.stack([np.bincount(idx, weights=x[:, j], minlength=n) for j in range(x.shape[1])], axis=1).astype(np.float32)


def platt(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) of the calibrated probability sigmoid(a * score + b), by Newton's method with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        g = np.array([((p - t) * score).sum(), (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h00, h01, h11 = (w * score * score).sum() + 1e-6, (w * score).sum(), w.sum() + 1e-6
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        da, db = (h11 * g[0] - h01 * g[1]) / det, (h00 * g[1] - h01 * g[0]) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-7:
            break
    return float(a), float(b)


def held_out(n: int) -> np.ndarray:
    """Every fifth row is kept from training."""
    return np.arange(n) % 5 == 4


def cut(score: np.ndarray, y: np.ndarray, cost: float = 5.0) -> float:
    """The threshold that maximises true positives' share less ``cost`` times false positives'; midway between scores."""
    s = np.unique(score)
    mids = np.concatenate(([s[0] - 1e-3], (s[1:] + s[:-1]) / 2, [s[-1] + 1e-3]))
    pos, neg = np.sort(score[y == 1]), np.sort(score[y == 0])
    tp = 1 - np.searchsorted(pos, mids) / max(1, len(pos))
    fp = 1 - np.searchsorted(neg, mids) / max(1, len(neg))
    gain = tp - cost * fp
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(mids[best[len(best) // 2]])
