"""Operator 4, document fingerprints: randomised edit embedding of anchored segments, banding, verified edit distance.

A segment begins wherever the hash of four characters is the least of its neighbourhood (and at a text's first
character), so that one edit, of whatever length, disturbs the segments at its place and no others. All segments walk
through the same random function: at step j a segment shows the character under its pointer, and the pointer moves on
if the shared random bit of (j, character) is one (the edit embedding of Chakraborty, Goldenberg and Koucky, 2016,
restarted at every anchor). Sampled steps of a walk are a segment's sketch. The least sketch of a text under each of
PLACES random orders is its signature. A band samples ROWS of the places; texts that agree on them and lie in one cell of
length, whose borders differ from band to band, are candidates if they agree on MIN_AGREE places in all. The candidates'
edit distance is checked on the whole texts.

Defined results. In short texts every character begins a segment; texts near the limit are indexed both ways, so that
any two texts within the bound share one. Bands, cells and MIN_AGREE may lose a pair (tests/llm/test_copies.py measures how
many). Null or empty text: never a copy. A null doc_id has no row. Repeated
rows of one doc_id are one document; if their texts differ, the one of the greatest hash is sketched, compared and named.
Empty table: no rows. A group is named by its least doc_id. Further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import vec
from lodestone.llm.groups import groups
from lodestone.workdir import Stash, maybe_broadcast

#: Two texts are copies if their edit distance is at most RATIO of the longer one's length.
RATIO = 0.1
PLACES, BANDS, ROWS, MIN_AGREE = 60, 40, 4, 12
#: Independent walks of STEPS steps, of which BITS are sampled; place i of the signature has walk i mod WALKS.
WALKS, STEPS, BITS = 2, 24, 6
#: An anchor has the least hash of GRAM characters among REACH positions either side.
GRAM, REACH = 4, 8
#: Every position is an anchor up to LONG characters, anchors are chosen from SHORT on; SHORT is within the bound of LONG.
SHORT, LONG = 300, 333
SEED = 1603
HIST = 64
#: Characters that are sketched at once.
_AT_ONCE = 1 << 21
_MAX = np.uint32(0xFFFFFFFF)
#: Characters of a verified match, and of the grams that reject.
_MATCH, _Q = 12, 5
#: Every band's places, and where its cells of length begin: a cell is as wide as twice the bound allows.
_SAMPLED = [np.random.default_rng(SEED + b).choice(PLACES, ROWS, replace=False).tolist() for b in range(BANDS)]
_SHIFT = [b * 0.6180339887 % 1 for b in range(BANDS)]
_CELL = -2 * math.log(1 - RATIO)


def bound(length: int) -> int:
    """The greatest edit distance at which a text of this length still is a copy of a shorter one."""
    return int(RATIO * length)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One byte from 1 to 255 for every character, zeros after each text; where each text begins."""
    gap = "\0" * (REACH + GRAM)
    raw = np.frombuffer(gap.join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    start = np.cumsum(lens + len(gap)) - lens - len(gap)
    codes = np.where(raw < 128, raw, 128 + (raw * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(127)).astype(np.uint8)
    codes[codes == 0] = 255
    for k in range(len(gap)):
        codes[start + lens + k] = 0
    return codes, start


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _anchors(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Positions whose hash is the least within REACH, and every text's first."""
    h = np.zeros(len(codes), np.uint32)
    inside = codes > 0
    for k in range(GRAM):
        c = codes[k:].astype(np.uint32)
        h[: len(c)] = h[: len(c)] * np.uint32(0x01000193) + c
        inside[: len(c)] &= c > 0
    h = _mix32(h)
    h[~inside] = _MAX
    h[len(h) - GRAM + 1 :] = _MAX
    low, width = h, 1
    while width < REACH:  # low[i]: the least of h[i : i + width]
        step = min(width, REACH - width)
        low, width = np.minimum(low, np.concatenate((low[step:], np.full(step, _MAX)))), width + step
    pad = np.full(REACH, _MAX)
    before, after = np.concatenate((pad, low))[: len(h)], np.concatenate((low[1:], pad[:1]))
    chosen = (h < before) & (h <= after) & (h < _MAX)
    chosen[start] = True
    return np.flatnonzero(chosen)


def _signatures(codes: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least sketch of each text's segments, which begin at ``at``, under each order: (PLACES, texts)."""
    rng = np.random.default_rng(SEED)
    moves = rng.integers(0, 2, (WALKS, STEPS, 256), dtype=np.uint8)
    moves[:, :, 0] = 0  # the end of a text: the pointer stays
    looks = [set(rng.choice(STEPS, BITS, replace=False).tolist()) for _ in range(WALKS)]
    odd, plus = (rng.integers(0, 1 << 32, PLACES, dtype=np.uint32) for _ in range(2))
    first = np.searchsorted(at, start)
    sketches = []
    for w in range(WALKS):
        ptr, h = at.copy(), np.full(len(at), w + 1, np.uint32)
        for j in range(max(looks[w]) + 1):
            c = codes[ptr]
            if j in looks[w]:
                h = h * np.uint32(0x01000193) + c
            ptr += moves[w, j][c]
        sketches.append(_mix32(h))
    return np.stack([np.minimum.reduceat(sketches[k % WALKS] * (odd[k] | np.uint32(1)) + plus[k], first) for k in range(PLACES)])


def signatures(texts: list[str]) -> tuple[list, list]:
    """Each text's places as a short text and as a long one; None where it isn't one. A text near the limit is both."""
    out = [None] * len(texts), [None] * len(texts)
    todo, size = [], 0
    for i, t in enumerate(texts):
        if t:
            todo.append(i)
            size += len(t)
        if todo and (size >= _AT_ONCE or i + 1 == len(texts)):
            for kind, own in ((0, [i for i in todo if len(texts[i]) <= LONG]), (1, [i for i in todo if len(texts[i]) >= SHORT])):
                if own:
                    codes, start = _codes([texts[i] for i in own])
                    sig = _signatures(codes, np.flatnonzero(codes) if kind == 0 else _anchors(codes, start), start)
                    places = (_mix32(sig) >> np.uint32(16)).astype(np.uint16).view(np.int16).T
                    for k, i in enumerate(own):
                        out[kind][i] = places[k]
            todo, size = [], 0
    return out


def _places(a: str) -> dict[str, int]:
    """For every character, its places in a as bits."""
    at = defaultdict(list)
    for i, c in enumerate(a):
        at[c].append(i)
    out = {}
    for c, own in at.items():
        bits = np.zeros(len(a), np.uint8)
        bits[own] = 1
        out[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _column(pv: int, mv: int, width: int) -> np.ndarray:
    """The running sum of vertical differences."""
    bits = [np.unpackbits(np.frombuffer(v.to_bytes(-(-width // 8), "little"), np.uint8), bitorder="little")[:width] for v in (pv, mv)]
    return np.concatenate(([0], np.cumsum(bits[0].astype(np.int64) - bits[1])))


def _distance(a: str, b: str, k: int | None = None) -> int:
    """The edit distance, by bit-parallel columns (Myers 1999, Hyyro 2003) over the rows within k of the diagonal.

    If it is over k, any number over k. Cells outside the window count as one more than their neighbours, which is
    too much at most, and an alignment of at most k edits never leaves the window.
    """
    m, n = len(a), len(b)
    k = m + n if k is None else k
    if abs(m - n) > k or not m or not n:
        return max(m, n)
    places = _places(a)
    step = max(64, k // 2)
    top, low, base, pv, mv = 0, 0, 0, 0, 0
    for j in range(0, n, step):
        if j:
            column = base + _column(pv, mv, low - top)
            least = column + np.abs(m - n + j - np.arange(top, low + 1))
            if least.min() > k:
                return k + 1
            s = max(0, j - k) - top
            base, pv, mv, top = int(column[s]), pv >> s, mv >> s, top + s
        end = min(m, j + step + k)
        pv |= ((1 << (end - low)) - 1) << (low - top)
        low = end
        mask = (1 << (low - top)) - 1
        seen = {}
        for c in b[j : j + step]:
            eq = seen.get(c)
            if eq is None:
                eq = seen[c] = places.get(c, 0) >> top & mask
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (mask & ~(xh | pv))
            mh = pv & xh
            ph = ph << 1 | 1
            pv = ((mh << 1) | ~(xv | ph)) & mask
            mv = ph & xv & mask
        base += min(step, n - j)
    return base + int(_column(pv, mv, low - top)[-1])


def _grams(t: str, q: int) -> np.ndarray:
    raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(raw) - q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + raw[k : k + n]
    return h


def _at_most(a: str, b: str, k: int) -> bool | None:
    """Whether an alignment along matches that are unique in both texts costs at most k; None if it costs more."""
    (x, i, m), (y, j, n) = (np.unique(_grams(t, _MATCH), return_index=True, return_counts=True) for t in (a, b))
    i, j, x, y = i[m == 1], j[n == 1], x[m == 1], y[n == 1]
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(i[p])
    i, j = i[p][order], j[q][order]
    if len(j) and (np.diff(j) < 0).any():  # the longest increasing run of places
        ends, ids, back = [], [], []
        for t, v in enumerate(j.tolist()):
            s = bisect_left(ends, v)
            back.append(ids[s - 1] if s else -1)
            ends[s : s + 1], ids[s : s + 1] = [v], [t]
        t, keep = ids[-1], []
        while t >= 0:
            keep.append(t)
            t = back[t]
        i, j = i[keep[::-1]], j[keep[::-1]]
    # Runs on one diagonal are one match.
    cut = np.flatnonzero((np.diff(i) > _MATCH) | (np.diff(i) != np.diff(j))) if len(i) else np.zeros(0, np.int64)
    heads, tails = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(i) - 1]))
    runs = [(int(i[h]), int(j[h]), int(i[t]) + _MATCH - int(i[h])) for h, t in zip(heads, tails)] if len(i) else []
    pa = pb = cost = 0
    for u, v, n in [*runs, (len(a), len(b), 0)]:
        late = max(0, pa - u, pb - v)
        u, v, n = u + late, v + late, n - late
        if n < 0 or a[u : u + n] != b[v : v + n]:
            continue
        s, t = a[pa:u], b[pb:v]
        cost += _distance(s, t) if max(len(s), len(t)) <= 2000 else max(len(s), len(t))
        if cost > k:
            return None
        pa, pb = u + n, v + n
    return True if (pa, pb) == (len(a), len(b)) else None


def within(a: str, b: str) -> bool:
    """Whether the edit distance is at most the bound: exactly, at the cost of an alignment for most pairs."""
    k = bound(max(len(a), len(b)))
    if abs(len(a) - len(b)) > k:
        return False
    # An edit changes at most q of the q-grams. Counts of hashes can only be too high.
    (x, m), (y, n) = (np.unique(_grams(t, _Q), return_counts=True) for t in (a, b))
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if np.minimum(m[p], n[q]).sum() < max(len(a), len(b)) - _Q + 1 - k * _Q:
        return False
    return bool(_at_most(a, b, k)) or _distance(a, b, k) <= k


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [i for i in range(batch.num_rows) if within(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())]
        yield batch.select([0, 1]).take(pa.array(good, pa.int64()))


def histogram(text: str) -> np.ndarray:
    """Counts of the characters, folded to HIST bins. An edit moves at most two counts by one."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((raw * np.uint32(0x9E3779B1)) >> np.uint32(26), minlength=HIST)


SKETCH = "doc_id long, same struct<h1:long,h2:long>, hist array<int>, short array<short>, long array<short>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        short, long = signatures(texts)
        hist = pa.array([histogram(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))
        cols = [batch.column(0), batch.column(2), hist, *[pa.array(x, pa.list_(pa.int16())) for x in (short, long)]]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "same", "hist", "short", "long"])


def _total(c):
    return F.aggregate(c, F.lit(0), lambda acc, v: acc + v)


def bands(sketches: DataFrame) -> DataFrame:
    """Rows (bucket, id) of sketches (id, hist, short, long): a key for every band."""
    width = F.log(_total("hist").cast("double")) / F.lit(_CELL)
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("p")) for k, c in enumerate(("short", "long"))]), lambda x: x["p"].isNotNull())
    each = sketches.select("id", width.alias("w"), F.explode(kinds).alias("k")).select("id", "w", "k.kind", "k.p")
    key = lambda b: F.xxhash64(F.lit(b), "kind", F.floor(F.col("w") + F.lit(_SHIFT[b])), *[F.col("p")[i] for i in _SAMPLED[b]])
    return each.select("id", F.explode(F.array(*[key(b) for b in range(BANDS)])).alias("bucket")).select("bucket", "id")


def edit_copies(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, group_id, links, fingerprint, keep) for every document with text.

    group_id: the least doc_id of its component under pairs within the edit bound; links: the verified pairs that tie its
    text to others; fingerprint: the document's signature, as one hash; equal for equal texts.
    """
    stash = Stash(docs.sparkSession)
    same = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(SEED), "text").alias("h2"))
    given = docs.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''").withColumn("same", same)
    table = stash.put(given.select("doc_id", "text", "same").mapInArrow(_sketch, SKETCH))
    # Equal texts are one, and their least doc_id stands for them. Of a doc_id's texts the greatest hash decides.
    chosen = F.max(F.struct("same", F.xxhash64("short", "long").alias("fingerprint"))).alias("m")
    every = stash.put(table.groupBy("doc_id").agg(chosen, F.count("*").alias("rows")).select("doc_id", "m.*", "rows"))
    firsts = stash.put(every.groupBy("same").agg(F.min(F.struct("doc_id", "rows")).alias("f")).select("same", "f.*"))
    repeats = every.where("rows > 1").limit(1).count()

    def one_each(df: DataFrame) -> DataFrame:
        """``df`` (doc_id, rows, ..) without the repeats of a doc_id of several rows; the others aren't shuffled for it."""
        if not repeats:
            return df.drop("rows", "same")
        return df.where("rows = 1").unionByName(df.where("rows > 1").dropDuplicates(["doc_id"])).drop("rows", "same")

    sketches = one_each(table.join(maybe_broadcast(firsts), ["doc_id", "same"])).withColumnRenamed("doc_id", "id")

    def verified(pairs: DataFrame) -> DataFrame:
        # Sieves on small rows: places that agree, and, exactly, that k edits move the counts of characters by at most 2 k.
        # Only what they leave is read as text.
        ids = stash.put(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        known = sketches.join(maybe_broadcast(ids), "id", "left_semi")
        x, y = (known.select(F.col("id").alias(c), *[F.col(k).alias(k + c) for k in ("hist", "short", "long")]) for c in "ab")
        moved = _total(F.zip_with("hista", "histb", lambda p, q: F.abs(p - q)))
        k = F.floor(F.greatest(_total("hista"), _total("histb")) * F.lit(RATIO))
        agree = lambda c: F.coalesce(_total(F.zip_with(c + "a", c + "b", lambda p, q: (p == q).cast("int"))), F.lit(0))
        both = pairs.join(x, "a").join(y, "b").where(F.greatest(agree("short"), agree("long")) >= MIN_AGREE)
        left = stash.put(both.where(moved <= 2 * k).select("a", "b"))
        ids = left.select(F.col("a").alias("doc_id")).union(left.select(F.col("b").alias("doc_id"))).distinct()
        some = stash.put(firsts.join(maybe_broadcast(stash.put(ids)), "doc_id"))
        texts = one_each(given.join(maybe_broadcast(some), ["doc_id", "same"]))
        x = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        y = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        # Few pairs are joined to b's texts where those are read; the texts of a pair meet by a shuffle on a, split where it is skewed.
        both = y.join(maybe_broadcast(left), "b").join(x.hint("merge"), "a")
        return both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")

    out = groups(docs.sparkSession, every.select("doc_id", "same"), bands(sketches), verified, stash)
    return out.join(every.select("doc_id", "fingerprint"), "doc_id").select(
        "doc_id", "group_id", "links", "fingerprint", (F.col("doc_id") == F.col("group_id")).alias("keep")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 4 over documents: every document's fingerprint and group."""
    return edit_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
