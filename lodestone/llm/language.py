"""Operator 7, language identification: nearest of several centroids per language, by cosine, with rejection.

A text is the TF-IDF vector, of length 1, of its hashed character triples (bytes in lower case), with 1 + log of the
counts. Document frequencies are counted over all documents. The centroids are those of ``CENTROIDS`` clusters
(spherical k-means) per language, fitted to at most ``PER_LANG`` documents of each ``lang``, drawn by a hash of
doc_id. A text farther (1 - cosine) from all centroids than the limit of the nearest one's language is rejected as
``und``; the limit is ``SLACK`` times the farthest distance but for the last thousandth in the sample.

Defined results. Null, empty or white text is ``und`` at distance 1. A null doc_id is carried. Null ``lang``: not used for
fitting. Cosines are rounded to DIGITS digits; ties go to the language of the lesser name. Repeated rows are answered each. Empty table: no rows. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import vec
from lodestone.llm.fit import Model, fit

PER_LANG = 600
CENTROIDS = 3
BITS = 12
SLACK = 1.1
#: Digits of a cosine; beyond them the order of summation, which depends on a text's neighbours, would show.
DIGITS = 5
SEED = 7


def counts(c: vec.Chunk) -> np.ndarray:
    """Occurrences of every hashed triple, as (documents, 2**BITS)."""
    n = 1 << BITS
    doc = np.repeat(np.arange(c.n, dtype=np.int64), np.diff(c.off))
    return np.bincount(doc * n + vec.char_grams(c.buf, BITS, c.off), minlength=c.n * n).reshape(c.n, n)


def _blocks(col: pa.Array) -> Iterator[vec.Chunk]:
    yield from vec.chunks(col, size=1 << 19, rows=512)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(count.shape, np.float32)
    at = count > 0
    x[at] = 1 + np.log(count[at].astype(np.float32))
    x *= idf
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for c in _blocks(batch.column(0)):
            total += (counts(c) > 0).sum(axis=0)
            rows += c.n
    if rows:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], ["g", "n"])


def idf_of(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequencies of all triples over all documents; one row per triple reaches the driver."""
    found = docs.select("text").mapInArrow(_frequencies, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(1 << BITS), 0
    for r in found:
        if r["g"] < 0:
            n = r["n"]
        else:
            df[r["g"]] = r["n"]
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def train(table: pa.Table, idf: np.ndarray) -> Model:
    x = np.concatenate([vectors(counts(c), idf) for c in _blocks(table["text"])])
    lang = np.array(table["y"].to_pylist())
    names, cents, limits = [], [], []
    rng = np.random.default_rng(SEED)
    for name in sorted(set(lang)):
        own = x[lang == name]
        k = min(CENTROIDS, len(own))
        # The first seed is the mean; each further one is the row farthest from those there are.
        c = [own.mean(axis=0)]
        for _ in range(k - 1):
            c.append(own[int(np.max([own @ (v / max(np.linalg.norm(v), 1e-12)) for v in c], axis=0).argmin())])
        c = np.stack(c)
        for _ in range(15):
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            near = (own @ c.T).argmax(axis=1)
            c = np.stack([own[near == i].mean(axis=0) if (near == i).any() else own[rng.integers(len(own))] for i in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        d = 1 - (own @ c.T).max(axis=1)
        names += [name] * k
        cents.append(c)
        limits += [min(0.999, SLACK * float(np.quantile(d, 0.999)))] * k
    return {"names": np.array(names), "c": np.concatenate(cents).astype(np.float32), "limits": np.array(limits), "idf": idf}


def _answer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, dist = np.full(n, "und", object), np.ones(n)
            for c in _blocks(batch.column(1)):
                c.words(vec.DARK)
                cos = np.round(vectors(counts(c), model["idf"]) @ model["c"].T, DIGITS)
                near = cos.argmax(axis=1)
                d = np.clip(1 - cos[np.arange(c.n), near], 0, 1)
                some = np.diff(c.woff) > 0
                dist[c.lo : c.lo + c.n] = np.where(some, d, 1.0)
                ok = some & (d <= model["limits"][near])
                lang[c.lo : c.lo + c.n] = np.where(ok, model["names"][near].astype(object), "und")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(dist.astype(np.float64))], ["doc_id", "language", "distance"])

    return run


def identify(docs: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, language, distance) for every row of ``docs``; ``sample`` (doc_id, text, y) defaults to a draw by ``lang``."""
    out = "doc_id long, language string, distance double"
    idf = idf_of(docs)
    if sample is None:
        own = docs.where("lang is not null and text is not null and doc_id is not null")
        w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
        # Ranks are taken without the texts, which join the few that are drawn.
        drawn = own.select("doc_id", "lang").withColumn("r", F.row_number().over(w)).where(F.col("r") <= PER_LANG)
        drawn = drawn.select("doc_id", F.col("lang").alias("y"))
        sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    model = fit(sample, lambda table: train(table, idf))
    if model is None:
        model = {"names": np.array(["und"]), "c": np.zeros((1, 1 << BITS), np.float32), "limits": np.zeros(1), "idf": idf}
    return docs.select("doc_id", "text").mapInArrow(_answer(model), out)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 7 over documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
