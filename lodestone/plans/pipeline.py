"""The whole job over a file tree: scan, parse, select, project, render and chunk, with map and token report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.functions import paths, text as tx
from lodestone.operators import chunking, codemap, formats, incremental, store
from lodestone.operators.parsers import Registry
from lodestone.sources import files as src


def parsed(files: DataFrame, base: str, project: str, registry: Registry | None = None) -> DataFrame:
    """``files`` (path, language, text, ..) with parsed and derived columns, in one pass over the rows."""
    out = (registry or Registry()).parse(files)
    rel = paths.relative(F.regexp_replace("path", "^file:/+", "/"), base)
    lang, imports = F.col("language"), F.col("imports")
    own = lambda c, f: F.when(F.size(c) > 0, F.col(c)).otherwise(f(imports, project))
    return out.withColumns({
        "relative_path": rel, "module_path": F.coalesce("module_path", paths.module(rel, lang)), "file_type": paths.file_type(F.col("path")),
        "content_hash": tx.content_hash(F.col("text")), "token_count": tx.count_language_tokens(F.col("text"), lang),
        "internal_dependencies": own("internal_dependencies", paths.internal), "external_dependencies": own("external_dependencies", paths.external),
    })


def corpus(
    spark: SparkSession, root: str, config: Config = Config(), registry: Registry | None = None, ignore: list[str] = paths.IGNORED, strict: bool = True,
    before: DataFrame | None = None,
) -> DataFrame:
    """Metadata rows of a tree: every column of a file, with its text.

    before: rows of an earlier run; a file of the same content has its row from there and isn't parsed again. Files that are
    gone have no row.
    """
    raw = src.scan(spark, root).where(paths.allowed(F.col("path")) & ~paths.ignored(F.col("path"), ignore))
    raw = src.guard(raw, config.max_files, config.max_bytes, strict).withColumn("language", paths.language(F.col("path")))
    base = root.removeprefix("file://").rstrip("/")
    project = base.rpartition("/")[2]
    if before is None:
        return parsed(raw, base, project, registry)
    now = raw.withColumn("content_hash", tx.content_hash(F.col("text")))
    fresh = raw.join(incremental.to_parse(now, before), "path", "left_semi")
    kept = before.join(now.select("path", "content_hash"), ["path", "content_hash"], "left_semi")
    return kept.unionByName(parsed(fresh, base, project, registry), allowMissingColumns=True)


def report(files: DataFrame) -> DataFrame:
    """The corpus map of parsed files, one row (value)."""
    edges = codemap.dependency_edges(files.select("path", F.col("internal_dependencies").alias("imports")))
    tree = codemap.tree_text(files.select(F.col("relative_path").alias("path")))
    return formats.corpus_map(codemap.overview(files), tree, codemap.top_importers(edges), codemap.top_imports(files))


def chunked(items: DataFrame, files: DataFrame, how: str, most: int) -> DataFrame:
    """Rows (path, chunk) of rendered items (path, rendered); an unknown way is the balanced one.

    semantic: files that import each other stay together; size: by path; balanced: the most complex first.
    """
    sized = items.select("path", F.length("rendered").cast("long").alias("size"), F.lit(0).alias("g"))
    if how == "semantic":
        edges = codemap.dependency_edges(files.select("path", F.col("internal_dependencies").alias("imports")))
        both = edges.unionByName(codemap.export_edges(files)).where("src <> dst")
        return chunking.semantic(files.sparkSession, sized, both, most).select("path", "chunk")
    if how == "size":
        return chunking.next_fit(sized, ["g"], ["path"], "size", most).select("path", "chunk")
    rated = sized.join(files.select("path", "complexity"), "path")
    return chunking.balanced(rated, ["g"], most).select("path", "chunk")


def format_output(files: DataFrame, level: str, fmt: str = "markdown", how: str = "semantic", most: int = 100_000, head: DataFrame | None = None) -> DataFrame:
    """Rows (chunk, position, path, rendered): files at a level, rendered and packed; head: one row (value) that begins chunk 0."""
    level = level if level in store.STRATEGIES else "structural"
    items = formats.render(store.STRATEGIES[level](files), fmt, level)
    placed = chunked(items, files, how, most).join(items, "path")
    at = F.row_number().over(Window.partitionBy("chunk").orderBy("path"))
    out = placed.withColumn("position", at).select("chunk", "position", "path", "rendered")
    if head is None:
        return out
    return out.unionByName(head.select(F.lit(0).alias("chunk"), F.lit(0).alias("position"), F.lit(None).cast("string").alias("path"), F.col("value").alias("rendered")))


def token_report(files: DataFrame, rendered: DataFrame, fmt: str = "markdown") -> DataFrame:
    """One row (value): the tokens of what is rendered, against those of the files' texts."""
    new = tx.token_statistics(rendered.select(F.col("rendered").alias("text"))).select("tokens", "words", "chars")
    old = tx.token_statistics(files).select(F.col("tokens").alias("original"))
    return formats.token_header(new.join(F.broadcast(old), F.lit(True)), fmt)  # one row each


@dataclass
class Result:
    """files: metadata rows; chunks: rows (chunk, position, path, rendered); header: one row (value)."""

    files: DataFrame
    chunks: DataFrame
    header: DataFrame

    def write(self, path: str, fmt: str = "text") -> None:
        src.write_chunks(self.chunks, path, fmt, self.header)


def process_codebase(
    spark: SparkSession, root: str, query: dict | None = None, config: Config = Config(), registry: Registry | None = None, before: DataFrame | None = None
) -> Result:
    """Scan, parse what changed, select, project, render with the corpus map, chunk, and count tokens."""
    files = corpus(spark, root, config, registry, before=before)
    chosen = store.query(files, **query) if query is not None else files
    chunks = format_output(chosen, config.strategy, config.output_format, config.chunking, config.chunk_chars, report(files))
    return Result(files, chunks, token_report(files, chunks, config.output_format))


def compress_codebase(
    spark: SparkSession, root: str, output_format: str = "markdown", strategy: str = "structural", query: dict | None = None, config: Config = Config()
) -> DataFrame:
    """Rows (chunk, position, path, rendered) of a tree; the row without a path is the corpus map."""
    return process_codebase(spark, root, query, replace(config, output_format=output_format, strategy=strategy)).chunks
