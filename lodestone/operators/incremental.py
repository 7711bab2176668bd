"""Changes between snapshots, expiry, upserts and look-ups in caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.store import latest


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows (path, change) for (path, content_hash) tables: added, modified, deleted or unchanged."""
    a, b = now.select("path", F.col("content_hash").alias("h1")), before.select("path", F.col("content_hash").alias("h2"))
    change = (
        F.when(F.col("h2").isNull(), "added").when(F.col("h1").isNull(), "deleted")
        .when(F.col("h1") != F.col("h2"), "modified").otherwise("unchanged")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def to_parse(now: DataFrame, before: DataFrame) -> DataFrame:
    """Paths added or modified."""
    return diff(now, before).where(F.col("change").isin("added", "modified")).select("path")


def valid(cached_at: Column, now: Column, ttl: float, same: Column | None = None) -> Column:
    """Whether an entry is young enough and, if ``same`` is given, of the content that there is now."""
    young = _young(cached_at, now, ttl)
    return young if same is None else young & F.coalesce(same, F.lit(False))


def _young(cached_at: Column, now: Column, ttl: float) -> Column:
    return (F.unix_micros(now) - F.unix_micros(cached_at)) / 1e6 < ttl


def expired(cache: DataFrame, now: Column, ttl: float) -> DataFrame:
    return cache.where((F.unix_micros(now) - F.unix_micros(F.col("cached_at"))) / 1e6 > ttl)


def upsert(snapshot: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    return latest(snapshot.unionByName(new), ["path"], order)


def merge(cached: DataFrame, new: DataFrame) -> DataFrame:
    """New rows, and cached ones of other paths."""
    return cached.join(new.select("path").distinct(), "path", "left_anti").unionByName(new)


def read_through(keys: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows (key, value, found_in) from a near cache, else a far one."""
    l_, r = local.select("key", F.col("value").alias("lv")), remote.select("key", F.col("value").alias("rv"))
    got = keys.join(l_, "key", "left").join(r, "key", "left")
    where = F.when(F.col("lv").isNotNull(), "local").when(F.col("rv").isNotNull(), "remote").otherwise("none")
    return got.select("key", F.coalesce("lv", "rv").alias("value"), where.alias("found_in"))


def clear_prefix(kv: DataFrame, prefix: str) -> DataFrame:
    """A key-value table without the keys of a prefix."""
    return kv.where(~F.col("key").startswith(prefix))


def cleared(kv: DataFrame, prefix: str) -> DataFrame:
    """One row, n: how many keys ``clear_prefix`` takes away."""
    return kv.where(F.col("key").startswith(prefix)).agg(F.count("*").alias("n"))


def put_many(kv: DataFrame, new: DataFrame, most: int = 512 * 1024 * 1024) -> DataFrame:
    """A table (key, value) with new values in place of old ones; a value of more bytes than ``most`` isn't taken."""
    fits = new.where(F.octet_length("value") <= most)
    return kv.join(fits.select("key"), "key", "left_anti").unionByName(fits)


def get_many(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of given keys (key); unknown keys have none."""
    return kv.join(keys.select("key").distinct(), "key", "left_semi")


def delete_many(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key").distinct(), "key", "left_anti")


def exists(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (key, found) of given keys."""
    return keys.select("key").distinct().join(kv.select("key", F.lit(True).alias("found")).distinct(), "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def cache_statistics(cache: DataFrame) -> DataFrame:
    """One row (entries, mb, oldest) of cached entries (size, cached_at)."""
    return cache.agg(F.count("*").alias("entries"), (F.sum("size") / 1048576).alias("mb"), F.min("cached_at").alias("oldest"))


def set_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows (op, n): how many paths are added, deleted, common and in all, of two sets of paths."""
    x, y = now.select("path").distinct().withColumn("x", F.lit(1)), before.select("path").distinct().withColumn("y", F.lit(1))
    both = x.join(y, "path", "full")
    n = both.agg(
        F.count_if(F.col("y").isNull()).alias("added"), F.count_if(F.col("x").isNull()).alias("deleted"), F.count("x").alias("k"), F.count("*").alias("all")
    ).select("added", "deleted", (F.col("k") - F.col("added")).alias("common"), "all")
    return n.unpivot([], ["added", "deleted", "common", "all"], "op", "n")
