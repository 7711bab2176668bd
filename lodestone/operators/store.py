"""The metadata store: criteria, symbol index, latest rows, and the projection levels of what is selected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

#: Criterion to predicate. Lists of structs are searched by name.
CRITERIA: dict[str, Callable[[object], Column]] = {
    "language": lambda v: F.col("language") == v,
    "imports": lambda v: F.array_contains("imports", v),
    "exports": lambda v: F.array_contains("exports", v),
    "function": lambda v: F.exists("functions", lambda f: f["name"] == v),
    "class": lambda v: F.exists("classes", lambda c: c["name"] == v),
    "min_complexity": lambda v: F.col("complexity") >= v,
    "max_size": lambda v: F.col("size") <= v,
    "min_tokens": lambda v: F.col("token_count") >= v,
}


def query(files: DataFrame, **criteria) -> DataFrame:
    """Rows that meet all criteria; none without a criterion. ValueError on an unknown one."""
    unknown = sorted(set(criteria) - set(CRITERIA))
    if unknown:
        raise ValueError(f"unknown criteria: {', '.join(unknown)}")
    if not criteria:
        return files.limit(0)
    out = files
    for k, v in criteria.items():
        out = out.where(CRITERIA[k](v))
    return out


def fetch(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of given paths; unknown paths have none."""
    return files.join(paths.select("path"), "path", "left_semi")


def symbols(files: DataFrame) -> DataFrame:
    """Rows (kind, symbol, path), one per distinct symbol of a file."""
    kinds = [("import", F.col("imports")), ("export", F.col("exports")), ("function", F.col("functions.name")), ("class", F.col("classes.name"))]
    have = {f.name for f in files.schema}
    each = [
        tx.tagged(F.array_distinct(c), "kind", k, "symbol")  # of strings, by hash; of structs, each would be compared with each
        for (k, c), col in zip(kinds, ["imports", "exports", "functions", "classes"], strict=True)
        if col in have
    ]
    return files.select("path", F.explode(F.concat(*each)).alias("s")).select("s.kind", "s.symbol", "path")


def probe(files: DataFrame, index: DataFrame, kind: str, symbol: str) -> DataFrame:
    """Files that have a symbol, by the index."""
    hits = index.where((F.col("kind") == kind) & (F.col("symbol") == symbol))
    return files.join(hits, "path", "left_semi")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def add(files: DataFrame, new: DataFrame) -> DataFrame:
    """Append; a path that is parsed again has its newest row."""
    both = files.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, ["path"], [F.col("__new").desc(), F.col("content_hash")]).drop("__new")


def clear(files: DataFrame) -> DataFrame:
    """An empty store of the same columns."""
    return files.limit(0)


def statistics(files: DataFrame) -> DataFrame:
    """One row: files, size, averages, languages and how many distinct symbols of each kind; files 0 and nulls if empty.

    Symbols are distinct per kind by aggregation over (kind, symbol); averages are taken before symbols are exploded.
    """
    one = files.agg(
        F.count("*").alias("files"), F.sum("size").alias("size"), F.avg("size").alias("avg_size"), F.avg("complexity").alias("avg_complexity"),
        F.avg("token_count").alias("avg_tokens"), F.when(F.count("*") > 0, F.countDistinct("language")).alias("languages"),
    )
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"unique_{k}s" if k != "class" else "unique_classes")
    if not {"imports", "exports", "functions", "classes"} & set(files.columns):
        return one
    kinds = symbols(files).select("kind", "symbol").distinct().agg(*[n(k) for k in ("import", "export", "function", "class")])
    # One row each.
    return one.join(F.broadcast(kinds), F.lit(True))


# Projection levels, each by itself or all in one pass.

_META = ("language", "size", "complexity", "token_count")


def _meta(files: DataFrame) -> Column:
    """What a projection says of its file: those of _META that there are."""
    return F.struct(*[c for c in _META if c in files.columns]).alias("metadata")


def _or_empty(files: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")) if name in files.columns else F.array().cast("array<string>")


def full(files: DataFrame) -> DataFrame:
    return files.select("path", F.lit("full").alias("type"), tx.minify(F.col("text")).alias("content"), _meta(files))


def structural(files: DataFrame) -> DataFrame:
    """imports and exports as they are known (none if the column is missing), signatures and constants of the text."""
    t, lang = F.col("text"), F.col("language")
    return files.select(
        "path", F.lit("structural").alias("type"), _or_empty(files, "imports").alias("imports"), _or_empty(files, "exports").alias("exports"),
        tx.function_signatures(t, lang).alias("functions"), tx.class_signatures(t, lang).alias("classes"), tx.constants(t).alias("constants"), _meta(files),
    )


def signature(files: DataFrame) -> DataFrame:
    t, lang = F.col("text"), F.col("language")
    return files.select(
        "path", F.lit("signature").alias("type"), tx.function_signatures(t, lang).alias("functions"), tx.class_signatures(t, lang).alias("classes"), _meta(files)
    )


def summary(files: DataFrame) -> DataFrame:
    """Language, size, complexity and how many imports, exports, functions and classes a file has (0 where a column is missing)."""
    n = lambda c: (F.coalesce(F.size(c), F.lit(0)) if c in files.columns else F.lit(0)).cast("long").alias(f"{c}_count")
    return files.select("path", F.lit("summary").alias("type"), "language", "size", "complexity", *[n(c) for c in ("imports", "exports", "functions", "classes")])


def levels(files: DataFrame) -> DataFrame:
    """Rows of all levels, one after another for each file, with the columns of every level: of these a row's ``type`` has its own."""
    t, lang = F.col("text"), F.col("language")
    have = [c for c in _META if c in files.columns]
    counts = summary(files).columns[-4:]
    n = {c: F.coalesce(F.size(k), F.lit(0)).cast("long") if (k := c.removesuffix("_count")) in files.columns else F.lit(0).cast("long") for c in counts}
    each = {k: _or_empty(files, k) for k in ("imports", "exports")}
    each |= {"functions": tx.function_signatures(t, lang), "classes": tx.class_signatures(t, lang), "constants": tx.constants(t), "content": tx.minify(t)}
    wide = files.select("path", *have, *[c.alias(k) for k, c in (n | each).items()])
    rows = wide.select("*", F.explode(F.array(*map(F.lit, STRATEGIES))).alias("type"))  # the texts' columns are found before rows are four
    return rows.withColumn("metadata", _meta(files))


STRATEGIES = {"full": full, "structural": structural, "signature": signature, "summary": summary}


def compress_by_query(files: DataFrame, strategy: str = "structural", **criteria) -> DataFrame:
    """Criteria, then a projection level; an unknown level is the structural one."""
    return STRATEGIES.get(strategy, structural)(query(files, **criteria))
