"""Operator 9, mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, per shard.

A document's shard is a hash of its doc_id. Within a shard and source, documents lie in a seeded order end to end;
their tokens (words between white space) are cut into blocks of ``BLOCK_TOKENS``, and a document belongs to the
block in which its first token falls. The i-th block of a source with weight w has the quotient w / (2i - 1); the
``SHARE`` of a shard's blocks are allocated by highest quotient, ties to the source of the greater name. A source that
runs out of blocks gives its further turns to the others. That gives a quota per shard and source; which of its blocks
a source sends is drawn by seed.

By default a source's weight is the square root of its tokens over all documents (a temperature of two), so that no
source is lost and large ones don't crowd out the rest; ``weights`` gives others.

Defined results. A null source is a source of its own; null text has no tokens, and goes with the block at its
place. Sources without a weight (None in ``weights``, or zero) get nothing. A shard without one of the sources is
apportioned among those it has. Equal hashes are ordered by doc_id, then text. A null doc_id is placed by its
text's hash. Repeated rows take their places one after another. Empty table: no rows. Further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.workdir import Stash, maybe_broadcast

BLOCK_TOKENS = 2048
#: A shard has about so many tokens: it is the unit of which the order is sorted in one task.
SHARD_TOKENS = 1 << 24
#: The part of a shard's blocks that the mix has, rounded up: the target is so many tokens.
SHARE = 0.9
SEED = 1910


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _hash32(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def mark(docs: DataFrame, weights: dict[str, float] | None = None, stash: Stash | None = None, share: float = SHARE) -> DataFrame:
    """Rows (doc_id, source, tokens, shard, block, picked, row_hash) for every row of ``docs``.

    row_hash tells apart the rows of one doc_id that differ in text.
    """
    stash = stash or Stash(docs.sparkSession)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    base = stash.put(
        docs.select(
            "doc_id",
            F.coalesce("source", F.lit("(null)")).alias("source"),
            n_tokens(F.col("text")).alias("tokens"),
            F.md5(F.coalesce("text", F.lit(""))).alias("row_hash"),
            _hash32(F.lit(f"s{SEED}"), ident).alias("h"),
            F.md5(F.concat_ws(":", F.lit(f"o{SEED}"), ident)).alias("o"),
        )
    )
    totals = base.groupBy("source").agg(F.sum("tokens").alias("t"))
    if weights is None:
        weighted = totals.select("source", F.sqrt(F.col("t").cast("double")).alias("w"), "t")
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v or 0)))]) if weights else None
        weighted = totals.select("source", (F.coalesce(given[F.col("source")], F.lit(0.0)) if given is not None else F.lit(0.0)).alias("w"), "t")
    weighted = stash.put(weighted)
    every = weighted.agg(F.sum("t")).first()[0] or 0
    shards = max(1, -(-every // SHARD_TOKENS))
    base = base.withColumn("shard", F.col("h") % shards)
    run = Window.partitionBy("shard", "source").orderBy("o", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    size = base.groupBy("shard", "source").agg(F.sum("tokens").alias("t"))
    have = size.select("shard", "source", F.greatest(F.lit(1), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("long").alias("n"))
    have = stash.put(have.join(maybe_broadcast(weighted.select("source", "w")), "source"))
    # One row per block: at most as many as a shard has tokens over BLOCK_TOKENS, and one for each small source.
    rows = have.select("shard", "source", "w", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i", "block"))
    turn = Window.partitionBy("shard").orderBy(F.desc("q"), F.desc("source"))
    target = F.ceil(F.count("*").over(Window.partitionBy("shard")) * F.lit(share))
    seats = rows.withColumn("target", target).where("w > 0").withColumn("q", F.col("w") / (2 * F.col("i") + 1))
    quota = seats.withColumn("r", F.row_number().over(turn)).where("r <= target").groupBy("shard", "source").agg(F.count("*").alias("quota"))
    drawn = F.md5(F.concat_ws(":", F.lit(f"b{SEED}"), "shard", "source", "block"))
    draw = Window.partitionBy("shard", "source").orderBy(drawn, "block")
    picked = stash.put(
        rows.withColumn("r", F.row_number().over(draw)).join(maybe_broadcast(stash.put(quota)), ["shard", "source"])
        .where("r <= quota").select("shard", "source", "block", F.lit(True).alias("p"))
    )
    placed = (
        base.withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0)))
        .join(maybe_broadcast(have.select("shard", "source", "n")), ["shard", "source"])
        .withColumn("block", F.least(F.floor(F.col("before") / BLOCK_TOKENS), F.col("n") - 1).cast("long"))
    )
    return placed.join(maybe_broadcast(picked), ["shard", "source", "block"], "left").select(
        "doc_id", "source", "tokens", "shard", "block", F.coalesce("p", F.lit(False)).alias("picked"), "row_hash"
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents of the picked blocks, all columns kept."""
    stash = Stash(docs.sparkSession)
    marks = mark(docs, weights, stash).where("picked").select(
        F.col("doc_id").alias("__ls_id"), F.col("row_hash").alias("__ls_row")
    )
    # Rows alike in doc_id and text may lie on both sides of a block's end; then both go with the picked one.
    marks = stash.put(marks.distinct())
    row = F.md5(F.coalesce(docs["text"], F.lit("")))
    return docs.join(maybe_broadcast(marks), docs["doc_id"].eqNullSafe(F.col("__ls_id")) & (row == F.col("__ls_row")), "left_semi")


SQL = f"""
WITH b AS (
  SELECT doc_id, coalesce(source, '(null)') AS source, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS tokens,
    md5(coalesce(text, '')) AS row_hash,
    ('0x' || substr(md5('s{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 8))::BIGINT AS h,
    md5('o{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS o
  FROM documents),
w AS (SELECT source, sqrt(sum(tokens)::DOUBLE) AS w FROM b GROUP BY source),
s AS (SELECT *, h % greatest(1, (SELECT ceil(sum(tokens) / {SHARD_TOKENS}.0)::BIGINT FROM b)) AS shard FROM b),
h AS (SELECT shard, source, greatest(1, ceil(sum(tokens) / {BLOCK_TOKENS}.0)::BIGINT) AS n FROM s GROUP BY shard, source),
q AS (
  SELECT shard, source, w.w / (2 * i - 1) AS q, count(*) OVER (PARTITION BY shard) AS blocks
  FROM h JOIN w USING (source), generate_series(1, n) g(i)),
quota AS (
  SELECT shard, source, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY shard ORDER BY q DESC, source DESC) AS r FROM q WHERE q > 0)
  WHERE r <= ceil(blocks * {SHARE}) GROUP BY shard, source),
picked AS (
  SELECT shard, source, block FROM (
    SELECT shard, source, block, row_number() OVER (
      PARTITION BY shard, source ORDER BY md5('b{SEED}:' || shard || ':' || source || ':' || block), block) AS r
    FROM h, generate_series(0, n - 1) g(block))
  JOIN quota USING (shard, source) WHERE r <= quota),
placed AS (
  SELECT s.*, least((coalesce(sum(tokens) OVER (PARTITION BY shard, source ORDER BY o, doc_id, row_hash
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BLOCK_TOKENS})::BIGINT, h.n - 1) AS block
  FROM s JOIN h USING (shard, source))
SELECT p.doc_id, p.source, p.tokens, p.shard, p.block::BIGINT AS block, k.block IS NOT NULL AS picked
FROM placed p LEFT JOIN picked k ON p.shard = k.shard AND p.source = k.source AND p.block = k.block
"""


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over documents: every document's block, and whether the mix has it."""
    return mark(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_hash")
