"""Operator 6, quality rules: hashed word and character n-gram logistic regression, calibrated, fixed thresholds.

Features of a text: the shares of its words, word pairs and character triples (bytes, in their case) in hashed
buckets; a pair of equal words has a bucket of its own. The model is fitted to at most ``PER_CLASS`` labelled
documents of either class, calibrated (Platt) on the fifth of them kept from training, and applied to all
documents in Arrow batches.

Defined results. Null, empty or white text: probability 0 and decision ``drop``. A null doc_id is carried. Repeated
rows are scored each. Empty table: no rows. Labels of one class or none: ValueError. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import vec
from lodestone.llm.fit import Adam, Model, fit, held_out, labelled, platt, sigmoid

PER_CLASS = 1500
BITS = 12
#: A document of at least KEEP is kept, of less than DROP dropped, between them reviewed.
KEEP, DROP = 0.5, 0.2
SCALE = 64.0
_SAME = 7


def features(c: vec.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, document) of every feature occurrence; values of a kind sum to SCALE in a document."""
    n = 1 << BITS
    c.words(vec.DARK)
    h = c.hashes()
    word = (h >> vec.U(64 - BITS)).astype(np.int32)
    per = np.maximum(np.diff(c.woff), 1)
    with np.errstate(over="ignore"):
        pair = (vec.mix(h[:-1] * vec.U(31) + h[1:]) >> vec.U(64 - BITS)).astype(np.int32)
    pair[h[:-1] == h[1:]] = _SAME
    inside = c.wdoc[1:] == c.wdoc[:-1] if len(h) else np.zeros(0, bool)
    tri = vec.char_grams(c.buf, BITS, c.off)
    tdoc = np.repeat(np.arange(c.n), np.diff(c.off))
    bytes_ = np.maximum(np.diff(c.off), 1)
    idx = np.concatenate((word, n + pair[inside], 2 * n + tri))
    doc = np.concatenate((c.wdoc, c.wdoc[:-1][inside], tdoc))
    val = np.concatenate((SCALE / per[c.wdoc], SCALE / per[c.wdoc[:-1][inside]], SCALE / bytes_[tdoc]))
    return idx, val.astype(np.float32), doc


def raw_scores(c: vec.Chunk, w: np.ndarray, b: float) -> np.ndarray:
    """The model's logit per document of a chunk."""
    idx, val, doc = features(c)
    return np.bincount(doc, weights=w[idx] * val, minlength=c.n) + b


def train(table: pa.Table) -> Model:
    y = table["y"].to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        raise ValueError("labels of both classes are needed")
    n = 3 << BITS
    rows, cols, vals = [], [], []
    for c in vec.chunks(table["text"], lower=False):
        idx, val, doc = features(c)
        key, inv = np.unique(doc.astype(np.int64) * n + idx, return_inverse=True)
        rows.append(key // n + c.lo)
        cols.append(key % n)
        vals.append(np.bincount(inv, weights=val))
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    out = held_out(len(y))
    use = ~out[row]
    weight = np.where(y == 1, 0.5 / max(1, (y[~out] == 1).sum()), 0.5 / max(1, (y[~out] == 0).sum())) * ~out
    p = {"w": np.zeros(n), "b": np.zeros(1)}
    opt = Adam(p, 0.02)
    for _ in range(150):
        s = np.bincount(row, weights=val * p["w"][col], minlength=len(y)) + p["b"][0]
        e = (sigmoid(s) - y) * weight
        g = np.bincount(col[use], weights=val[use] * e[row[use]], minlength=n) + 1e-5 * p["w"]
        opt.step({"w": g, "b": np.array([e.sum()])})
    s = np.bincount(row, weights=val * p["w"][col], minlength=len(y)) + p["b"][0]
    a, b = platt(s[out], y[out])
    right = ((sigmoid(a * s[out] + b) >= 0.5) == (y[out] == 1)).mean()
    return {"w": p["w"].astype(np.float32), "b": p["b"], "ab": np.array([a, b]), "held_out": np.array([right])}


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for c in vec.chunks(batch.column(1), lower=False):
                s = sigmoid(model["ab"][0] * raw_scores(c, model["w"], model["b"][0]) + model["ab"][1])
                p[c.lo : c.lo + c.n] = np.where(np.diff(c.woff) > 0, s, 0.0)
            decision = np.where(p >= KEEP, "keep", np.where(p < DROP, "drop", "review"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(decision, pa.string())], ["doc_id", "quality", "decision"])

    return run


def score(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows (doc_id, quality, decision) for every row of ``docs``, by a model fitted to ``sample`` (doc_id, text, y)."""
    model = fit(sample, train)
    if model is None:
        raise ValueError("labels of both classes are needed")
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, quality double, decision string")


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 6 over documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), labelled(spark, sf_dir, "quality", PER_CLASS))
