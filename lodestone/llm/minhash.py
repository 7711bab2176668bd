"""Operator 10, MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification.

One permutation (sigma) scatters the shingles over a universe of 2**20 places, a second (pi), shifted by
k = 0 .. K-1, gives the K signature coordinates: coordinate k of a set is the least pi[(place + k) mod 2**20].
The bands of a signature are its candidate keys; a pair that shares one is verified on the whole sets.

Defined results. Null or wordless text: never a copy. Fewer than ``SHINGLE`` words: one shingle of all of them.
A null doc_id can't be named, so has no row and its document stays. Repeated rows of one doc_id are one
document; if their texts differ, the one whose shingle set has the greatest hash decides, in banding and verification alike. Empty table: no rows. The group of a
document is named by its least doc_id, which is the one that stays. Further columns are ignored and, in the
stage, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import vec
from lodestone.llm.groups import groups
from lodestone.workdir import Stash, maybe_broadcast

SHINGLE = 3
THRESHOLD = 0.7
BANDS, ROWS = 25, 5
UNIVERSE_BITS = 20
SEED = 20210914

_pi: dict[int, np.ndarray] = {}


def _windows(k: int) -> np.ndarray:
    """Row s: pi[s], pi[s+1], ... pi[s+k-1], indices modulo the universe. A view, not a copy."""
    if k not in _pi:
        pi = np.random.default_rng(SEED).permutation(1 << UNIVERSE_BITS).astype(np.int32)
        _pi.clear()
        _pi[k] = np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[: k - 1])), k)
    return _pi[k]


def shingle_sets(chunk: vec.Chunk, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the chunk's documents, sorted within each, and their offsets."""
    chunk.words()
    h = chunk.hashes()
    count = np.diff(chunk.woff)
    with np.errstate(over="ignore"):
        run = h.copy()
        short = count < n
        for i in range(1, n):
            run[: len(h) - i] = vec.mix(run[: len(h) - i] * vec.U(31) + h[i:]) if len(h) > i else run[: len(h) - i]
    first = np.arange(len(h)) - chunk.woff[chunk.wdoc]
    ok = first <= count[chunk.wdoc] - n
    doc, sh = chunk.wdoc[ok], run[ok]
    for d in np.flatnonzero(short & (count > 0)):  # one shingle of the few words there are
        with np.errstate(over="ignore"):
            one = vec.mix(np.bitwise_xor.reduce(vec.mix(h[chunk.woff[d] : chunk.woff[d + 1]] + np.arange(count[d], dtype=vec.U))))
        doc, sh = np.append(doc, d), np.append(sh, one)
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])
    doc, sh = doc[new], sh[new]
    return sh, np.searchsorted(doc, np.arange(chunk.n + 1))


def signatures(sh: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """One row of k coordinates per set; the universe's size where a set is empty."""
    out = np.full((len(off) - 1, k), 1 << UNIVERSE_BITS, np.int32)
    win = _windows(k)
    place = (vec.mix(sh ^ vec.U(SEED)) >> vec.U(64 - UNIVERSE_BITS)).astype(np.int64)  # sigma
    lo = 0
    while lo < len(off) - 1:  # about 4,096 shingles at a time stay in the cache
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + 4096, "right")) - 1)
        full = np.flatnonzero(off[lo + 1 : hi + 1] > off[lo:hi]) + lo
        if len(full):
            out[full] = np.minimum.reduceat(win[place[off[lo] : off[hi]]], off[full] - off[lo], axis=0)
        lo = hi
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.zeros((len(sig), bands), vec.U) + np.arange(1, bands + 1, dtype=vec.U)
        for r in range(rows):
            key = vec.mix(key * vec.U(0x100000001B3) + sig[:, r::rows].astype(vec.U))
    return key.view(np.int64)


def _sketch(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for c in vec.chunks(batch.column(1)):
                sh, off = shingle_sets(c, n)
                full = np.flatnonzero(np.diff(off) > 0)
                if not len(full):
                    continue
                keys = _band_keys(signatures(sh, off, bands * rows)[full], bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(full + c.lo)),
                        _same(sh, off).take(pa.array(full)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                    ],
                    ["doc_id", "same", "buckets"],
                )

    return run


def _same(sh: np.ndarray, off: np.ndarray) -> pa.StructArray:
    """A 128-bit hash of every set of a chunk."""
    with np.errstate(over="ignore"):
        s1, s2 = (vec.segment_sum(x, off).view(np.int64) for x in (vec.mix(sh + vec.U(1)), vec.mix(sh ^ vec.U(0xABCDEF))))
    return pa.StructArray.from_arrays([pa.array(s1), pa.array(s2)], ["h1", "h2"])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in vec.chunks(batch.column(1)):
                sh, off = shingle_sets(c, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.lo, c.n),
                        pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(sh.view(np.int64))),
                        _same(sh, off),
                    ],
                    ["id", "sh", "same"],
                )

    return run


def _with_set(n: int):
    """Rows (text, row) to rows (row, hash of the text's set; null where there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in vec.chunks(batch.column(0)):
                sh, off = shingle_sets(c, n)
                full = pa.array(np.where(np.diff(off) > 0, np.arange(c.n), -1))
                same = _same(sh, off).take(pa.compute.if_else(pa.compute.less(full, 0), None, full))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.lo, c.n), same], ["__ls_row", "__ls_same"])

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE
) -> DataFrame:
    """Rows (doc_id, group_id, links, keep) for every document with words: the components of pairs of Jaccard >= threshold.

    Two documents are compared if they share a band; with 25 bands of 5 rows a pair of Jaccard 0.7 does with
    probability 0.99. links: the verified pairs that tie the document's set to other sets.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    given = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    sketched = given.mapInArrow(
        _sketch(bands, rows, shingle), "doc_id long, same struct<h1:long,h2:long>, buckets array<long>"
    )
    # Equal sets have Jaccard 1: the least id stands for them, and only it goes through banding.
    table = stash.put(sketched)
    every = stash.put(table.groupBy("doc_id").agg(F.max("same").alias("same")))
    firsts = stash.put(every.groupBy("same").agg(F.min("doc_id").alias("id")))
    keyed = table.join(firsts, (table["doc_id"] == firsts["id"]) & (table["same"] == firsts["same"]), "left_semi").select(
        F.col("doc_id").alias("id"), "buckets"
    )

    def verified(pairs: DataFrame) -> DataFrame:
        ids = stash.put(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        near = given.join(maybe_broadcast(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi").select("doc_id", "text")
        # Of a doc_id with several texts, the set that stands for it: the one that was banded.
        chosen = stash.put(firsts.join(maybe_broadcast(ids), "id"))
        sets = near.mapInArrow(_sets(shingle), "id long, sh array<long>, same struct<h1:long,h2:long>")
        one = stash.put(sets.join(maybe_broadcast(chosen), ["id", "same"]).select("id", "sh")).dropDuplicates(["id"])
        x = one.select(F.col("id").alias("a"), F.col("sh").alias("sa"))
        y = one.select(F.col("id").alias("b"), F.col("sh").alias("sb"))
        both = pairs.join(x, "a").join(y, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.col("n") >= F.lit(threshold) * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b")

    out = groups(spark, every, keyed.select(F.explode("buckets").alias("bucket"), "id"), verified, stash)
    return out.withColumn("keep", F.col("doc_id") == F.col("group_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """The documents without those whose group has one of a lesser doc_id; rows of a null doc_id stay.

    Rows that repeat a doc_id are one document, of which the row stays whose text stands for it.
    """
    marks = near_duplicates(docs, threshold, bands, rows, shingle)
    stash = Stash(docs.sparkSession)
    gone = stash.put(marks.where("not keep").select(F.col("doc_id").alias("__ls_id")))
    left = docs.join(maybe_broadcast(gone), docs["doc_id"] == F.col("__ls_id"), "left_anti")
    again = stash.put(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__ls_id")))
    if not again.limit(1).count():
        return left
    # Of a repeated doc_id the row stays whose set stands for it; among equal ones that of the greatest hash.
    many = left.join(maybe_broadcast(again), left["doc_id"] == F.col("__ls_id"), "left_semi").select(F.struct(*docs.columns).alias("__ls_row"))
    keyed = many.select(F.col("__ls_row.text").alias("text"), "__ls_row").mapInArrow(
        _with_set(shingle), T.StructType([*many.schema.fields, T.StructField("__ls_same", T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2")]))])
    )
    best = F.max_by("__ls_row", F.struct("__ls_same", F.xxhash64("__ls_row")))
    once = keyed.groupBy("__ls_row.doc_id").agg(best.alias("__ls_row")).select("__ls_row.*")
    rest = left.join(maybe_broadcast(again), left["doc_id"] == F.col("__ls_id"), "left_anti")
    return rest.unionByName(once.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over documents: every document's group."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
