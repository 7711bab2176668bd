"""From shared bucket keys to groups of verified copies, used by the operators that look for copies of whole documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.graph import connected_components
from lodestone.workdir import Stash, maybe_broadcast

#: Passes by leaders go on while all open pairs would be more than so many times the open members, LEADER_PASSES at most.
OPEN_PAIRS, LEADER_PASSES = 8, 4


def resolve(
    spark: SparkSession,
    members: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    stash: Stash,
) -> DataFrame:
    """Rows (id, root, links): the connected components of the verified pairs among all pairs that share a bucket.

    members: rows (bucket, id), any repeated. verified: gets pairs (a, b), a < b, returns those that pass.
    A pair whose ends already are in one component need not be verified, so the result is that of verifying every
    pair that shares a bucket, without the quadratic number of pairs of a bucket that holds thousands of copies: first
    every id against the least one of all its buckets, then in passes every member against one leader of another
    component in its bucket, last all pairs still in different components. Least and greatest of a bucket are
    aggregated before they are shuffled and joined back, so no task holds a hot bucket. links: an id's verified pairs.
    Ids without a partner have no row.
    """
    ends = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    shared = stash.put(ends.select(F.col("bucket").alias("shared"), "lo"))
    mark = maybe_broadcast(shared)
    own = stash.put(members.join(mark, members["bucket"] == mark["shared"]).select("bucket", "id", "lo"))
    tested = stash.put(own.where("lo < id").groupBy("id").agg(F.min("lo").alias("a")).select("a", F.col("id").alias("b")))
    edges = stash.put(verified(tested))
    step, comps = 0, None
    while True:
        comps = comps or stash.put(connected_components(spark, edges, stash))
        label = maybe_broadcast(comps)
        placed = own.join(label, own["id"] == label["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
        ends = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        ends = stash.put(ends.select(F.col("bucket").alias("shared")))
        open_ = stash.put(placed.join(maybe_broadcast(ends), placed["bucket"] == F.col("shared"), "left_semi"))
        if open_.limit(1).count() == 0:
            break
        per = open_.groupBy("bucket").count()
        size = per.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.sum("count")).first()
        last = step >= 1 and (size[0] <= OPEN_PAIRS * size[1] or step >= LEADER_PASSES)
        if last:
            x, y = open_.alias("x"), open_.alias("y")
            pairs = x.join(y, F.expr("x.bucket = y.bucket and x.id < y.id and x.comp <> y.comp")).selectExpr("x.id as a", "y.id as b")
        else:
            # The leader of pass 0 is the least id; those of later passes are drawn by a hash of bucket and pass.
            by = F.struct(F.xxhash64("id", F.lit(step)) if step else F.lit(0).cast("long"), "id", "comp")
            lead = open_.groupBy("bucket").agg(F.min(by).alias("f")).select(F.col("bucket").alias("led"), "f.id", "f.comp")
            lead = lead.toDF("led", "leader", "led_comp")
            pairs = open_.join(lead, F.expr("bucket = led and comp <> led_comp")).select(
                F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")
            )
        fresh = stash.put(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        if fresh.limit(1).count():
            found = stash.put(verified(fresh))
            if found.limit(1).count():
                edges = stash.put(edges.union(found))
                comps = None
            tested = stash.put(tested.union(fresh)) if not last else tested
        if last:
            comps = comps or stash.put(connected_components(spark, edges, stash))
            break
        step += 1
    ends = edges.select(F.col("a").alias("id"), "b").union(edges.select(F.col("b").alias("id"), F.col("a").alias("b")))
    links = ends.distinct().groupBy("id").agg(F.count("*").alias("links"))
    named = comps.select(F.col("node").alias("id"), F.col("component").alias("root"))
    return named.join(links, "id", "left").select("id", "root", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def groups(
    spark: SparkSession, every: DataFrame, members: DataFrame, verified: Callable[[DataFrame], DataFrame], stash: Stash
) -> DataFrame:
    """Rows (doc_id, group_id, links) for each document of ``every`` (doc_id, same).

    Documents of equal ``same`` are copies; the least stands for them. members: rows (bucket, id) of those
    that stand. Null ``same``: no copy of anything. links: the verified pairs that tie a document's text to other texts.
    """
    reps = every.groupBy("same").agg(F.min("doc_id").alias("rep"))
    found = resolve(spark, members, verified, stash)
    found = found.withColumnRenamed("id", "found")
    named = stash.put(reps.join(found, reps["rep"] == found["found"]).select("same", "root", "links"))
    # Only classes with a link are joined to the documents; the rest are named by their least doc_id.
    rest = every.join(reps, "same", "left").join(maybe_broadcast(named), "same", "left")
    return rest.select("doc_id", F.coalesce("root", "rep", "doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
