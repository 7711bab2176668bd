"""Operator 1, quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words, and its label is the bag's. A passage is encoded from the mean
embeddings of its hashed character triples and word pairs; gated attention (tanh times sigmoid; Ilse, Tomczak and
Welling, 2018) weighs the passages of a document, and the weighted representation is scored. Encoder, attention
and score are learned together, in numpy, from at most ``PER_CLASS`` labelled documents of either class.

Defined results. The last passage of a document may be shorter. Null, empty or white text: no passage, quality 0,
attention null. A null doc_id is carried. Repeated rows are scored each, and equal texts alike whatever
stands next to them. Equal attention: the first passage is named.
Empty table: no rows. Labels of one class or none: ValueError. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import vec
from lodestone.llm.fit import Adam, Model, fit, held_out, labelled, platt, scatter, sigmoid

PER_CLASS = 1000
PASSAGE = 64
TRI_BITS, PAIR_BITS = 12, 11
DIM_TRI, DIM_PAIR, HIDDEN, ATT = 12, 4, 16, 8
EPOCHS, BATCH = 6, 32
SEED = 1802
_SAME = 0  # the bucket of a word pair of equal words


class Bags:
    """The passages of a chunk. ``poff``: each document's first passage; the occurrences are in order of passage."""

    def __init__(self, c: vec.Chunk):
        c.words(vec.DARK)
        h = c.hashes()
        words = np.diff(c.woff)
        per = -(-words // PASSAGE)
        self.poff = np.concatenate(([0], np.cumsum(per)))
        wpass = self.poff[c.wdoc] + (np.arange(len(h)) - c.woff[c.wdoc]) // PASSAGE
        n = int(self.poff[-1])
        first = np.searchsorted(wpass, np.arange(n))
        # Bytes of a passage: from its first word to the next passage's first word, or the document's last word.
        lo = c.ws[first] if n else np.zeros(0, np.int64)
        last = np.searchsorted(wpass, np.arange(n), "right") - 1
        hi = c.we[last] if n else np.zeros(0, np.int64)
        tri = vec.char_grams(c.buf, TRI_BITS, c.off)
        inside = np.zeros(len(c.buf) + 1, np.int64)
        np.add.at(inside, lo, 1)
        np.add.at(inside, hi, -1)
        keep = np.cumsum(inside[:-1]) > 0
        self.tri = tri[keep]
        self.toff = np.concatenate(([0], np.cumsum(hi - lo)))
        with np.errstate(over="ignore"):
            pair = (vec.mix(h[:-1] * vec.U(31) + h[1:]) >> vec.U(64 - PAIR_BITS)).astype(np.int32)
        pair[h[:-1] == h[1:]] = _SAME
        ok = wpass[1:] == wpass[:-1] if len(h) else np.zeros(0, bool)
        self.pair = pair[ok]
        self.foff = np.searchsorted(wpass[:-1][ok], np.arange(n + 1)) if len(h) else np.zeros(1, np.int64)


def _mean(table: np.ndarray, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
    return vec.segment_sum(table[idx], off) / np.maximum(np.diff(off), 1)[:, None].astype(np.float32)


def encode(m: Model, tri, toff, pair, foff) -> tuple[np.ndarray, np.ndarray]:
    """Passage inputs and passage representations."""
    x = np.concatenate((_mean(m["Et"], tri, toff), _mean(m["Ep"], pair, foff)), axis=1)
    return x, np.tanh(vec.dense(x, m["W"]) + m["b"])


def attend(m: Model, h: np.ndarray, poff: np.ndarray) -> tuple[np.ndarray, ...]:
    """(attention, gate parts, bag representation, logit) of bags of passages."""
    t, s = np.tanh(vec.dense(h, m["V"])), sigmoid(vec.dense(h, m["U"]))
    e = vec.dense(t * s, m["a"])
    full = np.flatnonzero(poff[1:] > poff[:-1])
    top = np.zeros(len(poff) - 1, np.float32)
    if len(full):
        top[full] = np.maximum.reduceat(e, poff[full])
    bag = np.repeat(np.arange(len(poff) - 1), np.diff(poff))
    w = np.exp(e - top[bag])
    a = w / np.maximum(vec.segment_sum(w, poff), 1e-12)[bag]
    z = vec.segment_sum(a[:, None] * h, poff)
    return a, t, s, bag, z, vec.dense(z, m["c"]) + m["d"][0]


def _take(off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the segments ``rows`` one after another, and their offsets."""
    n = off[rows + 1] - off[rows]
    new = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(off[rows] - new[:-1], n) + np.arange(new[-1]), new


def train(table: pa.Table) -> Model:
    y = table["y"].to_numpy().astype(np.float32)
    if len(np.unique(y)) < 2:
        raise ValueError("labels of both classes are needed")
    rng = np.random.default_rng(SEED)
    g = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    m = {
        "Et": g(1 << TRI_BITS, DIM_TRI), "Ep": g(1 << PAIR_BITS, DIM_PAIR), "W": g(DIM_TRI + DIM_PAIR, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
        "V": g(HIDDEN, ATT), "U": g(HIDDEN, ATT), "a": g(ATT), "c": g(HIDDEN), "d": np.zeros(1, np.float32),
    }
    parts = [Bags(c) for c in vec.chunks(table["text"], lower=False)]
    tri, pair = np.concatenate([p.tri for p in parts]), np.concatenate([p.pair for p in parts])
    join = lambda k: np.concatenate(([0], np.cumsum(np.concatenate([np.diff(getattr(p, k)) for p in parts]))))
    toff, foff, poff = join("toff"), join("foff"), join("poff")
    out = held_out(len(y))
    own = np.flatnonzero(~out & (np.diff(poff) > 0))
    share = np.where(y == 1, 0.5 / max(1, (y[own] == 1).sum()), 0.5 / max(1, (y[own] == 0).sum())) * len(own)
    opt = Adam(m, 0.01, 1e-4)
    for epoch in range(EPOCHS):
        opt.rate = 0.01 * (1 - epoch / EPOCHS) + 0.001
        rng.shuffle(own)
        for lo in range(0, len(own), BATCH):
            docs = own[lo : lo + BATCH]
            prow, po = _take(poff, docs)
            ti, to = _take(toff, prow)
            fi, fo = _take(foff, prow)
            tb, pb = tri[ti], pair[fi]
            x, h = encode(m, tb, to, pb, fo)
            a, t, s, bag, z, logit = attend(m, h, po)
            e = ((sigmoid(logit) - y[docs]) * share[docs] / len(docs)).astype(np.float32)
            dz = e[:, None] * m["c"]
            da = (h * dz[bag]).sum(axis=1)
            de = a * (da - vec.segment_sum(a * da, po)[bag])
            dgate = de[:, None] * m["a"]
            dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
            dh = a[:, None] * dz[bag] + dt @ m["V"].T + ds @ m["U"].T
            dp = dh * (1 - h * h)
            dx = dp @ m["W"].T
            dtri = np.repeat(dx[:, :DIM_TRI] / np.maximum(np.diff(to), 1)[:, None], np.diff(to), axis=0)
            dpair = np.repeat(dx[:, DIM_TRI:] / np.maximum(np.diff(fo), 1)[:, None], np.diff(fo), axis=0)
            opt.step({
                "Et": scatter(tb, dtri, 1 << TRI_BITS), "Ep": scatter(pb, dpair, 1 << PAIR_BITS), "W": x.T @ dp, "b": dp.sum(axis=0),
                "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ e, "d": e.sum(keepdims=True),
            })
    test = np.flatnonzero(out & (np.diff(poff) > 0))
    score = np.zeros(len(test))
    for lo in range(0, len(test), 64):
        prow, po = _take(poff, test[lo : lo + 64])
        (ti, to), (fi, fo) = _take(toff, prow), _take(foff, prow)
        score[lo : lo + 64] = attend(m, encode(m, tri[ti], to, pair[fi], fo)[1], po)[-1]
    m["ab"] = np.array(platt(score, y[test]))
    m["held_out"] = np.array([((sigmoid(m["ab"][0] * score + m["ab"][1]) >= 0.5) == (y[test] == 1)).mean()])
    return m


def _score(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            quality, passages, top, weight = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
            for c in vec.chunks(batch.column(1), lower=False):
                p = Bags(c)
                _, h = encode(m, p.tri, p.toff, p.pair, p.foff)
                a, _, _, bag, _, logit = attend(m, h, p.poff)
                own = slice(c.lo, c.lo + c.n)
                passages[own] = np.diff(p.poff)
                full = np.flatnonzero(passages[own] > 0)
                quality[own] = np.where(passages[own] > 0, sigmoid(m["ab"][0] * logit + m["ab"][1]), 0)
                if len(full):
                    best = np.lexsort((np.arange(len(a)), -a, bag))[p.poff[full]]
                    top[c.lo + full], weight[c.lo + full] = best - p.poff[full], a[best]
            some = top >= 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(quality), pa.array(quality >= 0.5), pa.array(passages),
                    pa.array(top, mask=~some), pa.array(weight, mask=~some),
                ],
                ["doc_id", "quality", "keep", "passages", "top_passage", "top_attention"],
            )

    return run


def score(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows (doc_id, quality, keep, passages, top_passage, top_attention) for every row of ``docs``."""
    model = fit(sample, train)
    if model is None:
        raise ValueError("labels of both classes are needed")
    out = "doc_id long, quality double, keep boolean, passages long, top_passage long, top_attention double"
    return docs.select("doc_id", "text").mapInArrow(_score(model), out)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 1 over documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), labelled(spark, sf_dir, "quality", PER_CLASS))
