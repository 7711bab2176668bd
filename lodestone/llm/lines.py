"""Operator 2, line dedup: lines that an earlier line equals, or comes within one edit of, are dropped.

Lines are compared in lower case with outer white space (ASCII) gone; blank lines don't count. The earliest occurrence,
by (doc_id, hash of the text, line number), stays. Equal lines, of any length, fall to a grouping on 128 bits of hash. The
first occurrences of at least ``MIN_CHARS`` characters then go through a deletion-neighbourhood join: a line's variants
are itself and itself less any one character; two lines within one edit share a variant, so variants are emitted as
hashed keys, equal keys are joined, and the edit distance of the joined lines is verified. A line is dropped if any
earlier line is within the bound, whether or not that one is dropped itself. Below MIN_CHARS one edit makes another word
("Yes." and "Yet."), so there only equal lines are copies.

A line only needs variants if another line can be within one edit of it. One edit touches one of three parts of a
line, so lines that share no two parts with a line of nearly the same length are left out beforehand; this drops no
pair.

Defined results. Null text stays null; a document without lines to drop comes out unchanged, one that loses lines and
of which but blank ones are left has no row. A null doc_id can't be ordered: its rows stay as they are. Rows that repeat
doc_id and text are one document, and a dropped line goes from each; rows of one doc_id that differ in text are
documents one after another, by the hash of the text. Empty table: no rows. n_chars, if there, is set anew. Further
columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import vec
from lodestone.workdir import Stash, maybe_broadcast, small

#: Lines of fewer characters are copies only of equal ones.
MIN_CHARS = 20
MAX_EDITS = 1
#: Parts of a line, of which one edit touches one.
PARTS = 3
_WHITE = " \t\r\v\f"


def _norm(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(_WHITE)))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash that tells apart the texts of one doc_id."""
    return docs.withColumn("__ls_h", F.xxhash64("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, h, pos, line) of the lines that aren't blank, normalised."""
    some = _keyed(docs.where("doc_id is not null and text is not null"))
    cut = some.select("doc_id", F.col("__ls_h").alias("h"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return cut.select("doc_id", "h", "pos", _norm(F.col("raw")).alias("line")).where("line <> ''")


def variants(line: str) -> np.ndarray:
    """Hashes of a line and of it less each one of its characters (MAX_EDITS = 1), without repeats."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(vec.U)
    up, down = vec.power(len(c) + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(len(c) + 1, vec.U)
        np.cumsum(vec.mix(c + vec.U(1)) * up[: len(c)], out=s[1:])
        less = s[:-1] + (s[-1] - s[1:]) * down[1]
        key = np.concatenate((vec.mix(s[-1:] + vec.U(len(c))), vec.mix(less + vec.U(max(0, len(c) - 1)))))
    return np.unique(key).view(np.int64)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [variants(x) for x in batch.column(1).to_pylist()]
        n = np.fromiter(map(len, keys), np.int64, len(keys))
        at = pa.array(np.repeat(np.arange(len(keys)), n))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        for lo in range(0, len(flat), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(flat[lo : lo + (1 << 18)]), batch.column(0).take(at.slice(lo, 1 << 18))], ["key", "f"])


_AT = "struct<doc_id:long,h:long,pos:int>"


def dropped_lines(docs: DataFrame, stash: Stash | None = None) -> DataFrame:
    """Rows (doc_id, h, pos) of the lines to drop, positions from 0; h: the hash of the document's text."""
    stash = stash or Stash(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    n = F.length("line")

    def part(m: Column, i: int) -> Column:
        """A hash of all but the i-th part of a line, for partners of which the shorter has m characters."""
        lo, hi = F.floor(m * i / PARTS).cast("int"), F.floor(m * (i + 1) / PARTS).cast("int")
        head = F.substring(F.col("line"), F.lit(1), lo)
        tail = F.when(m > hi, F.substring(F.col("line"), hi - m, m - hi)).otherwise("")
        return F.xxhash64(F.lit(i), m, head, tail)

    keys = F.when(n >= MIN_CHARS, F.array(*[part(m, i) for m in (n, n - 1) for i in range(PARTS)]))
    seen = stash.put(
        _lines(docs).select(
            F.struct("doc_id", "h", "pos").alias("at"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), keys.alias("parts")
        )
    )
    firsts = stash.put(
        seen.groupBy("h1", "h2").agg(F.min("at").alias("f"), F.count("*").alias("c"), F.min("parts").alias("parts"))
    )
    many = firsts.where("c > 1").select("h1", "h2", "f")
    repeats = seen.select("at", "h1", "h2").join(maybe_broadcast(stash.put(many)), ["h1", "h2"]).where("at <> f").select("at.*")

    parts = firsts.where("parts is not null").select(F.explode("parts").alias("k"), "f")
    shared = parts.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    able = stash.put(parts.join(maybe_broadcast(stash.put(shared)), "k", "left_semi").select("f.*").distinct())
    where = able.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("__ls_pos"))
    where = stash.put(where.toDF("__ls_id", "__ls_at", "__ls_pos"))
    # The size of the side to broadcast goes by its positions.
    where = F.broadcast(where) if small(able) else where
    some = _keyed(docs.where("text is not null")).join(where, F.expr("doc_id = __ls_id and __ls_h = __ls_at"))
    texts = some.select("doc_id", "__ls_h", F.split("text", "\n", -1).alias("all"), F.explode("__ls_pos").alias("pos"))
    texts = stash.put(
        texts.select(F.struct("doc_id", F.col("__ls_h").alias("h"), "pos").alias("f"), _norm(F.element_at("all", F.col("pos") + 1)).alias("line"))
    )
    near = stash.put(texts.mapInArrow(_variants, f"key long, f {_AT}"))
    # Lines that share a variant differ in one character at one place, so a key has no more of them than there are characters.
    x, y = near.select("key", F.col("f").alias("x")), near.select("key", F.col("f").alias("y"))
    pairs = stash.put(x.join(y, "key").where("y < x").select("x", "y").distinct())
    close = (
        pairs.join(texts.select(F.col("f").alias("x"), F.col("line").alias("lx")), "x")
        .join(texts.select(F.col("f").alias("y"), F.col("line").alias("ly")), "y")
        .where(F.levenshtein("lx", "ly", MAX_EDITS) >= 0)
        .select("x.*")
        .distinct()
    )
    return repeats.union(close)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with their dropped lines gone, all columns kept."""
    stash = Stash(docs.sparkSession)
    gone = dropped_lines(docs, stash).groupBy("doc_id", "h").agg(F.collect_set("pos").alias("__ls_gone"))
    gone = stash.put(gone.toDF("__ls_id", "__ls_at", "__ls_gone"))
    # What is dropped grows with the documents, so this join shuffles at every size.
    joined = _keyed(docs).join(gone.hint("merge"), F.expr("doc_id = __ls_id and __ls_h = __ls_at"), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__ls_gone", i))
    joined = joined.withColumn("__ls_kept", F.when(F.col("__ls_id").isNotNull(), kept))
    joined = joined.where(F.col("__ls_kept").isNull() | F.exists("__ls_kept", lambda x: _norm(x) != ""))
    text = F.when(F.col("__ls_kept").isNull(), F.col("text")).otherwise(F.array_join("__ls_kept", "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        size = F.when(F.col("__ls_kept").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: The same by brute force: equal lines and lines within one edit, compared where a half agrees.
SQL = """
WITH l AS (
  SELECT doc_id, i - 1 AS pos, lower(trim(s[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS line, s[i] AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
       generate_series(1, len(s)) g(i)),
e AS (SELECT line, length(line) AS n, min(doc_id * 1000000 + pos) AS f FROM l WHERE line <> '' GROUP BY line),
f AS (SELECT * FROM e WHERE n >= 20),
near AS (
  SELECT DISTINCT x.line FROM f x JOIN f y
    ON y.f < x.f AND y.n BETWEEN x.n - 1 AND x.n + 1
   AND left(x.line, (least(x.n, y.n) // 2)::BIGINT) = left(y.line, (least(x.n, y.n) // 2)::BIGINT)
  WHERE levenshtein(x.line, y.line) <= 1
  UNION
  SELECT DISTINCT x.line FROM f x JOIN f y
    ON y.f < x.f AND y.n BETWEEN x.n - 1 AND x.n + 1
   AND right(x.line, (least(x.n, y.n) // 2)::BIGINT) = right(y.line, (least(x.n, y.n) // 2)::BIGINT)
  WHERE levenshtein(x.line, y.line) <= 1),
k AS (
  SELECT l.*, e.line IS NULL OR (e.f = l.doc_id * 1000000 + l.pos AND l.line NOT IN (SELECT line FROM near)) AS stays
  FROM l LEFT JOIN e ON l.line = e.line)
SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE stays) AS text, count(*) FILTER (WHERE stays) AS n_lines
FROM k GROUP BY doc_id HAVING bool_and(stays) OR bool_or(stays AND line <> '')
UNION ALL SELECT doc_id, text, NULL FROM documents WHERE text IS NULL
"""


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 2 over documents: what is left of each."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
