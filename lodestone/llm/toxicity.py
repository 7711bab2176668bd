"""Operator 5, toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows.

A word's input is the embedding of the word, if the training sample has it in ``MIN_DOCS`` documents, next to the mean
embedding of its hashed character triples. A gated recurrent network reads every window of ``WINDOW`` words forth
and back, attention pools its states, and the pooled state is scored. Windows begin every ``STRIDE`` words, so they
overlap, and cover all of a text; a document's score is its highest window's. Trained in numpy on at most
``PER_CLASS`` labelled documents of either class: first on all their windows under the document's label, then on each
document's highest window. The threshold is set on the fifth of the sample that is kept from training.

Defined results. A text of fewer than WINDOW words is one window. Null or wordless text: no window, score 0, not toxic,
top_window null. A null doc_id is carried. Repeated rows are scored each, to DIGITS digits; ties name the first window. Empty table: no
rows. Labels of one class or none: ValueError. Further columns are kept by ``reject`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import vec
from lodestone.llm.fit import Adam, Model, cut, fit, held_out, labelled, scatter, sigmoid

PER_CLASS = 1200
WINDOW, STRIDE = 32, 16
TRI_BITS = 12
MIN_DOCS = 4
DIM_WORD, DIM_CHAR, HIDDEN, ATT = 8, 12, 8, 8
WARM, SHARP, BATCH = 3, 5, 128
#: Digits of a score; beyond them the order of summation, which depends on a text's neighbours, would show.
DIGITS = 4
SEED = 1412


class Words:
    """The distinct words of a chunk (``uh`` hashes, ``tri``/``toff`` triples) and each word's number among them."""

    def __init__(self, c: vec.Chunk):
        c.words()
        self.uh, first, self.uid = np.unique(c.hashes(), return_index=True, return_inverse=True)
        lo, n = c.ws[first], c.we[first] - c.ws[first]
        # Triples of a word between marks: "^w", .., "w$".
        new = np.concatenate(([0], np.cumsum(n + 2)))
        at = np.arange(new[-1])
        word = np.repeat(np.arange(len(n)), n + 2)
        rel = at - new[:-1][word] - 1
        byte = np.where(rel < 0, 1, np.where(rel >= n[word], 2, c.buf[np.clip(lo[word] + rel, 0, max(0, len(c.buf) - 1))] if len(c.buf) else 0)).astype(np.uint8)
        g = vec.char_grams(byte, TRI_BITS)
        keep = rel < n[word] - 1  # a triple begins at all but the last two places
        keep |= (n[word] == 1) & (rel < 0)
        self.tri, self.toff = g[keep], np.concatenate(([0], np.cumsum(np.bincount(word[keep], minlength=len(n)))))


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word within its document, document) of every window of documents with so many words."""
    per = np.where(words > 0, np.maximum(0, -(-(words - WINDOW) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(words)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return np.maximum(0, np.minimum(k * STRIDE, words[doc] - WINDOW)), doc


def inputs(m: Model, uh: np.ndarray, tri: np.ndarray, toff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of distinct words, and their row in the word table (the last row, zero, for unknown words)."""
    at = np.searchsorted(m["vocab"], uh)
    at = np.where((at < len(m["vocab"])) & (m["vocab"][np.minimum(at, len(m["vocab"]) - 1)] == uh) if len(m["vocab"]) else False, at, len(m["vocab"]))
    ch = vec.segment_sum(m["Ec"][tri], toff) / np.maximum(np.diff(toff), 1)[:, None].astype(np.float32)
    return np.concatenate((m["Ew"][at], ch), axis=1), at


def _gru(x: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction for projected inputs (T, B, 3H)."""
    steps, n, h = len(x), x.shape[1], u.shape[0]
    out, state, held = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        hu = state @ u
        zr = sigmoid(x[t, :, : 2 * h] + hu[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(x[t, :, 2 * h :] + r * hu[:, 2 * h :])
        nxt = new + z * (state - new)
        if keep:
            held.append((t, state, z, r, new, hu[:, 2 * h :]))
        out[t] = state = nxt
    return out, held


def _gru_back(u: np.ndarray, held: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    h = u.shape[0]
    dx, du, dh = np.empty((*dout.shape[:2], 3 * h), np.float32), np.zeros_like(u), np.zeros(dout.shape[1:], np.float32)
    for t, state, z, r, new, hun in reversed(held):
        dh = dh + dout[t]
        dz, dn = dh * (state - new) * z * (1 - z), dh * (1 - z) * (1 - new * new)
        dr = dn * hun * r * (1 - r)
        dx[t] = np.concatenate((dz, dr, dn), axis=1)
        dhu = np.concatenate((dz, dr, dn * r), axis=1)
        du += state.T @ dhu
        dh = dh * z + dhu @ u.T
    return dx, du


def forward(m: Model, pf: np.ndarray, pb: np.ndarray, idx: np.ndarray, keep: bool = False):
    """Logits of windows. pf, pb: projected inputs of words, the last row for padding; idx: (windows, WINDOW) word numbers."""
    pad = len(pf) - 1
    seq = np.ascontiguousarray(idx.T)
    f, hf = _gru(pf[seq], m["Uf"], False, keep)
    b, hb = _gru(pb[seq], m["Ub"], True, keep)
    o = np.concatenate((f, b), axis=2)
    s = np.tanh(o @ m["A"])
    e = np.where(seq == pad, np.float32(-1e9), s @ m["a"])
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    ctx = np.einsum("tb,tbh->bh", w, o)
    return ctx @ m["c"] + m["d"][0], (seq, hf, hb, o, s, w, ctx)


def project(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both directions' projected inputs, and a row for padding that leaves the state as it is."""
    pad = np.zeros((1, 3 * HIDDEN), np.float32)
    pad[0, :HIDDEN] = 30
    return tuple(np.concatenate((x @ m["W" + d] + m["b" + d], pad)).astype(np.float32) for d in "fb")


def train(table: pa.Table) -> Model:
    y = table["y"].to_numpy().astype(np.float32)
    if len(np.unique(y)) < 2:
        raise ValueError("labels of both classes are needed")
    rng = np.random.default_rng(SEED)
    uh, tri, toff, idx, wdoc = [], [], [0], [], []
    df: dict[int, int] = {}
    base = 0
    for c in vec.chunks(table["text"]):
        w = Words(c)
        start, doc = windows(np.diff(c.woff))
        pos = c.woff[doc][:, None] + start[:, None] + np.arange(WINDOW)
        ok = pos < c.woff[doc + 1][:, None]
        idx.append(np.where(ok, w.uid[np.minimum(pos, max(0, len(w.uid) - 1))] + base if len(w.uid) else 0, -1))
        wdoc.append(doc + c.lo)
        for h, k in zip(*np.unique(np.unique(np.stack((c.wdoc, w.uid)), axis=1)[1], return_counts=True)):
            df[int(w.uh[h])] = df.get(int(w.uh[h]), 0) + int(k)
        uh.append(w.uh)
        tri.append(w.tri)
        toff = np.concatenate((toff, w.toff[1:] + toff[-1]))
        base += len(w.uh)
    uh, tri, idx, wdoc = np.concatenate(uh), np.concatenate(tri), np.concatenate(idx), np.concatenate(wdoc)
    idx[idx < 0] = base
    vocab = np.array(sorted(h for h, k in df.items() if k >= MIN_DOCS), vec.U)
    g = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(np.float32)
    n_in = DIM_WORD + DIM_CHAR
    m = {"Ew": g(len(vocab) + 1, DIM_WORD, by=0.05), "Ec": g(1 << TRI_BITS, DIM_CHAR), "A": g(2 * HIDDEN, ATT), "a": g(ATT), "c": g(2 * HIDDEN), "d": np.zeros(1, np.float32)}
    for d in "fb":
        m |= {"W" + d: g(n_in, 3 * HIDDEN), "U" + d: g(HIDDEN, 3 * HIDDEN), "b" + d: np.zeros(3 * HIDDEN, np.float32)}
    m["Ew"][-1] = 0
    opt = Adam({k: v for k, v in m.items()}, 0.01, 1e-5)
    m["vocab"] = vocab
    out = held_out(len(y))
    count = np.bincount(wdoc, minlength=len(y))
    first = np.cumsum(count) - count

    def logits(rows: np.ndarray) -> np.ndarray:
        score = np.empty(len(rows), np.float32)
        pf, pb = project(m, inputs(m, uh, tri, toff)[0])
        for lo in range(0, len(rows), 2048):
            score[lo : lo + 2048] = forward(m, pf, pb, idx[rows[lo : lo + 2048]])[0]
        return score

    def step(rows: np.ndarray, weight: np.ndarray) -> None:
        words, inv = np.unique(idx[rows], return_inverse=True)
        inv = inv.reshape(len(rows), WINDOW)
        padded = words[-1] == base
        words = words[:-1] if padded else words
        n = toff[words + 1] - toff[words]
        o2 = np.concatenate(([0], np.cumsum(n)))
        tb = tri[np.repeat(toff[words] - o2[:-1], n) + np.arange(o2[-1])]
        x, at = inputs(m, uh[words], tb, o2)
        drop = rng.random(len(words)) < 0.3  # so that characters learn what words know
        x[drop, :DIM_WORD] = 0
        pf, pb = project(m, x)
        logit, (seq, hf, hb, o, s, w, ctx) = forward(m, pf, pb, inv, keep=True)
        e = ((sigmoid(logit) - y[wdoc[rows]]) * weight / len(rows)).astype(np.float32)
        dctx = e[:, None] * m["c"]
        dw = np.einsum("tbh,bh->tb", o, dctx)
        de = w * (dw - (w * dw).sum(axis=0))
        ds = de[:, :, None] * m["a"] * (1 - s * s)
        do = w[:, :, None] * dctx + ds @ m["A"].T
        grads = {"A": np.einsum("tbh,tba->ha", o, ds), "a": np.einsum("tba,tb->a", s, de), "c": ctx.T @ e, "d": e.sum(keepdims=True)}
        dx = np.zeros_like(x)
        for d, held, part in (("f", hf, do[:, :, :HIDDEN]), ("b", hb, do[:, :, HIDDEN:])):
            dp, grads["U" + d] = _gru_back(m["U" + d], held, part)
            dproj = scatter(seq.ravel(), dp.reshape(-1, 3 * HIDDEN), len(pf))[:-1]
            grads["W" + d], grads["b" + d] = x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ m["W" + d].T
        dx[drop, :DIM_WORD] = 0
        grads["Ew"] = scatter(at, dx[:, :DIM_WORD], len(m["Ew"]))
        grads["Ew"][-1] = 0
        grads["Ec"] = scatter(tb, np.repeat(dx[:, DIM_WORD:] / np.maximum(n, 1)[:, None], n, axis=0), 1 << TRI_BITS)
        opt.step(grads)

    own = np.flatnonzero(~out & (count > 0))
    share = np.where(y == 1, 0.5 / max(1, (y[own] == 1).sum()), 0.5 / max(1, (y[own] == 0).sum())) * len(own)
    rows = np.concatenate([first[d] + np.arange(count[d]) for d in own])
    for epoch in range(WARM):
        opt.rate = 0.01 if epoch else 0.02
        order = rng.permutation(rows)
        for lo in range(0, len(order), 4 * BATCH):
            step(order[lo : lo + 4 * BATCH], np.ones(len(order[lo : lo + 4 * BATCH]), np.float32))
    for epoch in range(SHARP):
        opt.rate = 0.01 * (1 - epoch / SHARP) + 0.001
        score = logits(rows)
        order = np.lexsort((-score, wdoc[rows]))
        sizes = count[own]
        start = np.cumsum(sizes) - sizes
        top = rows[order[start]]
        # Documents that aren't toxic also give their next highest windows: all of theirs should be low.
        quiet = y[own] == 0
        more = [rows[order[start[quiet & (sizes > k)] + k]] for k in range(1, 6)]
        pick = np.concatenate([top, *more])
        weight = np.concatenate([share[own], *[np.full(len(q), 0.5, np.float32) for q in more]])
        order = rng.permutation(len(pick))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            step(pick[part], weight[part])
    test = np.flatnonzero(out & (count > 0))
    rows = np.concatenate([first[d] + np.arange(count[d]) for d in test])
    score = logits(rows)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, wdoc[rows], score)
    m["cut"] = np.array([cut(best[test], y[test])])
    hit = best[test] > m["cut"][0]
    m["held_out"] = np.array([hit[y[test] == 1].mean(), hit[y[test] == 0].mean()])
    return m


def _score(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            best, top, many = np.full(n, -np.inf), np.full(n, -1, np.int64), np.zeros(n, np.int64)
            for c in vec.chunks(batch.column(1)):
                w = Words(c)
                if not len(w.uid):
                    continue
                pf, pb = project(m, inputs(m, w.uh, w.tri, w.toff)[0])
                start, doc = windows(np.diff(c.woff))
                pad, score = len(pf) - 1, np.empty(len(doc), np.float32)
                for lo in range(0, len(doc), 2048):
                    d = doc[lo : lo + 2048]
                    pos = (c.woff[d] + start[lo : lo + 2048])[:, None] + np.arange(WINDOW)
                    idx = np.where(pos < c.woff[d + 1][:, None], w.uid[np.minimum(pos, len(w.uid) - 1)], pad)
                    score[lo : lo + 2048] = forward(m, pf, pb, idx)[0]
                per = np.bincount(doc, minlength=c.n)
                full = np.flatnonzero(per)
                at = np.lexsort((start, -score, doc))[(np.cumsum(per) - per)[full]]
                many[c.lo : c.lo + c.n] = per
                best[c.lo + full], top[c.lo + full] = score[at], start[at]
            none = top < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(none, 0.0, np.round(sigmoid(best), DIGITS))), pa.array(best > m["cut"][0]), pa.array(many), pa.array(top, mask=none)],
                ["doc_id", "toxicity", "toxic", "windows", "top_window"],
            )

    return run


def score(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows (doc_id, toxicity, toxic, windows, top_window) for every row of ``docs``; top_window: its first word."""
    model = fit(sample, train)
    if model is None:
        raise ValueError("labels of both classes are needed")
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, toxicity double, toxic boolean, windows long, top_window long")


def reject(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with all their columns. No shuffle: the score is a column next to them."""
    model = fit(sample, train)
    if model is None:
        raise ValueError("labels of both classes are needed")
    names = docs.columns
    at = names.index("text")
    run = _score(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])
            for scored in run(iter([pair])):
                yield batch.filter(pa.compute.invert(scored.column(2)))

    return docs.mapInArrow(clean, docs.schema)


def sample_of(spark, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, "toxic", PER_CLASS)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 5 over documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), sample_of(spark, sf_dir))
