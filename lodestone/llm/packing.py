"""Operator 8, packing: cutting-stock column generation over a length histogram.

Documents are cut into pieces of at most ``CAPACITY`` words; every piece's length is rounded up to one of
``CAPACITY / GRAIN`` sizes, and only the histogram of sizes goes to the driver. There a linear program minimises the
number of bins: its columns are patterns (how many pieces of each size share a bin), priced by a knapsack dynamic
program over the duals until none improves it (Gilmore and Gomory, 1961). The solution is rounded down; what that
leaves is packed first-fit decreasing, which adds fewer bins than there are sizes. Pieces are ranked within their
size, and the rank tells a piece its bin: a join against the table of patterns, whose size depends on the number
of sizes only.

Defined results. Null, empty or white text has no piece. Pieces hold whole words, joined by single spaces. Rows
are ranked by (doc_id, piece, hash of the text) within buckets, so repeated rows are packed each. A null doc_id
comes out as null in ``doc_ids``. Empty table: no bins. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.workdir import Stash, maybe_broadcast

CAPACITY = 2048
GRAIN = 16
#: Ranks are counted within buckets of the doc_id's hash, of about so many pieces, so that no task sorts a whole size. How
#: many bins there are, and of which patterns, doesn't depend on it.
BUCKET_PIECES = 1 << 16
#: A linear program of m sizes that takes more than ROUNDS * m columns is an error.
ROUNDS = 1000


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best value of any multiset of sizes that fits, and how many of each it has."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = np.flatnonzero(sizes <= c)
        best[c], took[c] = best[c - 1], -1
        if len(fit):
            v = best[c - sizes[fit]] + values[fit]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], took[c] = v[k], fit[k]
    count, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            count[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), count


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. Threaded BLAS is avoided: on a driver its threads may fight with the JVM's."""
    n = len(a)
    x = np.concatenate((a, np.eye(n)), axis=1)
    for i in range(n):
        p = i + int(np.abs(x[i:, i]).argmax())
        x[[i, p]] = x[[p, i]]
        x[i] /= x[i, i]
        f = x[:, i].copy()
        f[i] = 0
        x -= f[:, None] * x[i]
    return x[:, n:]


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Patterns, how often each is used (an integer), and the bound of the linear program.

    The patterns cover ``demand`` exactly. Columns are added until none has a reduced cost; demands are moved apart by up
    to a millionth of a piece, so that the program never stands still. RuntimeError if it doesn't end (ROUNDS).
    """
    m = len(sizes)
    if not m:
        return [], np.zeros(0, np.int64), 0.0
    basis = np.diag(room // sizes).astype(float)  # columns: patterns of one size each
    inverse = _inverse(basis)
    goal = demand + 1e-6 * (np.arange(m) + 1) / m
    x = (inverse * goal).sum(axis=1)
    for step in range(ROUNDS * m + 1):
        if step == ROUNDS * m:
            raise RuntimeError(f"column generation over {m} sizes didn't end")
        duals = inverse.sum(axis=0)
        value, column = knapsack(duals, sizes, room)
        if value <= 1 + 1e-9:
            break
        d = (inverse * column).sum(axis=1)
        can = d > 1e-9
        if not can.any():
            break
        ratio = np.where(can, x / np.where(can, d, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * d
        x[out] = ratio[out]
        basis[:, out] = column
        if step % 50 == 49:
            inverse = _inverse(basis)
            x = np.maximum((inverse * goal).sum(axis=1), 0)
        else:
            row = inverse[out] / d[out]
            inverse = inverse - d[:, None] * row
            inverse[out] = row
    bound = float((inverse.sum(axis=0) * demand).sum())
    cols = [basis[:, j].round().astype(np.int64) for j in range(m)]
    use = np.floor(x + 1e-5).astype(np.int64)
    left = demand - sum((c * u for c, u in zip(cols, use)), np.zeros(m, np.int64))
    for j in range(m):  # rounding may have taken a unit too much
        while (left < 0).any() and use[j] > 0 and (cols[j][left < 0] > 0).any():
            use[j] -= 1
            left += cols[j]
    # First fit decreasing over what is left; alike bins are one pattern.
    order = np.argsort(-sizes)
    bins: list[np.ndarray] = []
    free: list[int] = []
    for i in order:
        for _ in range(int(left[i])):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                bins.append(np.zeros(m, np.int64))
                free.append(room)
            bins[k][i] += 1
            free[k] -= sizes[i]
    rest: dict[bytes, int] = {}
    for b in bins:
        rest[b.tobytes()] = rest.get(b.tobytes(), 0) + 1
    cols += [np.frombuffer(b, np.int64) for b in rest]
    use = np.concatenate((use, np.array(list(rest.values()), np.int64)))
    return [c for c, u in zip(cols, use) if u], use[use > 0], bound


def _slots(sizes: np.ndarray, cols: list[np.ndarray], use: np.ndarray) -> list[tuple]:
    """Rows (size, from rank, to rank, per bin, first bin) for every size of every pattern; ranks from 0."""
    rows, taken, first = [], np.zeros(len(sizes), np.int64), 0
    for c, u in zip(cols, use):
        for i in np.flatnonzero(c):
            n = int(c[i] * u)
            rows.append((int(sizes[i]), int(taken[i]), int(taken[i]) + n, int(c[i]), first))
            taken[i] += n
        first += int(u)
    return rows


def assign(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, stash: Stash | None = None) -> DataFrame:
    """Rows (bin, doc_id, row_hash, piece, tokens) for every piece of every document."""
    spark = docs.sparkSession
    stash = stash or Stash(spark)
    words = F.regexp_count("text", F.lit(r"\S+")).cast("long")
    lengths = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), words.alias("n")).where("n > 0")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece")
    pieces = lengths.select("doc_id", "row_hash", "n", piece).withColumn(
        "tokens", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity)
    )
    pieces = stash.put(
        pieces.withColumn("size", F.ceil(F.col("tokens") / grain).cast("int")).drop("n")
    )
    buckets = max(1, -(-pieces.count() // BUCKET_PIECES))
    # Repeated rows and a null doc_id are spread by piece and text as well.
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row_hash"), F.lit(buckets)).cast("int"))
    counts = stash.put(pieces.groupBy("size", "bucket").agg(F.count("*").alias("c")))  # at most sizes x buckets rows
    by = {r["size"]: r["c"] for r in counts.groupBy("size").agg(F.sum("c").alias("c")).collect()}  # at most capacity / grain
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("size", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    sizes = np.array(sorted(by), np.int64)
    cols, use, _ = patterns(sizes, np.array([by[s] for s in sizes], np.int64), capacity // grain)
    # The slots of a size are cut at bucket ends by rank, not by bucket: a rank finds its slot in a sorted array.
    slot = "size int, slots array<struct<lo:long,hi:long,per:long,first:long>>"
    by_size: dict[int, list] = {}
    for s, lo, hi, per, first in _slots(sizes, cols, use):
        by_size.setdefault(s, []).append((lo, hi, per, first))
    table = spark.createDataFrame(list(by_size.items()), slot)
    rank = Window.partitionBy("size", "bucket").orderBy("doc_id", "piece", "row_hash")
    ranked = pieces.withColumn("k", F.row_number().over(rank)).join(maybe_broadcast(stash.put(start)), ["size", "bucket"])
    ranked = ranked.withColumn("r", F.col("start") + F.col("k") - 1).join(F.broadcast(table), "size")
    s = F.filter("slots", lambda x: (x["lo"] <= F.col("r")) & (F.col("r") < x["hi"]))[0]
    return ranked.withColumn("s", s).select(
        (F.col("s.first") + F.floor((F.col("r") - F.col("s.lo")) / F.col("s.per"))).alias("bin"),
        "doc_id", "row_hash", "piece", "tokens",
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per bin: bin, n_tokens, doc_ids, pieces, starts (the word of the bin at which each piece begins), text."""
    stash = Stash(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    where = stash.put(assign(docs, capacity, grain, stash))
    per = where.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("piece", "bin", "tokens")).alias("p"))
    # Equal rows of one doc_id hold equal pieces; each piece's text is taken once and goes to all its bins.
    texts = docs.where("text is not null").withColumn("row_hash", F.xxhash64("text"))
    if _repeats(docs):
        texts = texts.dropDuplicates(["doc_id", "row_hash"])
    a, b = texts.alias("a"), per.alias("b")
    joined = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.row_hash = b.row_hash"))
    # Words are cut without their white space at the ends, which split would show as an empty word.
    word = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+", -1)
    cut = joined.select("a.doc_id", word.alias("w"), F.explode("b.p").alias("p")).select(
        "doc_id", "p.piece", "p.bin", "p.tokens",
        F.array_join(F.slice("w", (F.col("p.piece") * capacity + 1).cast("int"), F.col("p.tokens").cast("int")), " ").alias("text"),
    )
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "piece", "tokens", "text")))
    bins = cut.groupBy("bin").agg(rows.alias("x"))
    starts = F.transform(
        F.sequence(F.lit(1), F.size("x")),
        lambda i: F.aggregate(F.slice("x", F.lit(1), i - 1), F.lit(0).cast("long"), lambda acc, e: acc + e["tokens"]),
    )
    return bins.select(
        "bin",
        F.aggregate("x", F.lit(0).cast("long"), lambda acc, e: acc + e["tokens"]).alias("n_tokens"),
        F.col("x.doc_id").alias("doc_ids"),
        F.col("x.piece").alias("pieces"),
        starts.alias("starts"),
        F.array_join(F.col("x.text"), " ").alias("text"),
    )


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over documents: the packed bins."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
