"""Scans and sinks: file trees, documents as files, snapshots, chunk files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths, text as tx
from lodestone.schema import CACHE

MAX_FILES = 100_000
MAX_TOTAL_BYTES = 1 << 30
#: Folders that, as hidden parts of a path, keep a file out of a scan.
HIDDEN = [".git", ".env", ".aws", ".ssh", ".gnupg"]


class LimitExceeded(ValueError):
    """A scan holds more files or bytes than its limits allow."""


def decode(content: Column) -> Column:
    """UTF-8 text of bytes; what isn't UTF-8 is left out (and with it, in such a text only, the replacement character)."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Rows (path, size_bytes, modified, text, size) of all files below ``root``, without hidden credential folders."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    bad = F.exists(F.split("path", "/"), lambda p: p.isin(HIDDEN))
    raw = reader.load(root).where(~bad)
    return raw.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), decode(F.col("content")).alias("text")).withColumn("size", F.length("text").cast("long"))


def guard(files: DataFrame, most_files: int = MAX_FILES, most_bytes: int = MAX_TOTAL_BYTES, strict: bool = True) -> DataFrame:
    """``files`` if it keeps within the limits; else LimitExceeded, or no rows if not ``strict``. Reads sizes only."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    if n > most_files or size > most_bytes:
        if not strict:
            return files.limit(0)
        raise LimitExceeded(f"{n} files of {size} bytes; the limits are {most_files} and {most_bytes}")
    return files


def fallback_listing(spark: SparkSession, root: str) -> DataFrame:
    """The degraded scan: paths of a hundred Python files at most."""
    return scan(spark, root, "*.py").select("path").orderBy("path").limit(100)


#: Most bytes of rows that go to a Python worker at once, beside a row that is larger. A worker holds a batch several times over: as
#: Arrow, as Python's objects, and what is made of them.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer partitions than there are cores: one row group can't be split.

    A table of many files, as any large one, comes back as it is. The session's Arrow batches get BATCH_BYTES, unless it has a setting.
    """
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


EXT = [".py", ".js", ".json", ".md", ".go", ".rs", "/__init__.py", ".ts"]


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, path, language, text, size): documents under a path of source, lang, id and a suffix by id."""
    ext = F.element_at(F.array(*map(F.lit, EXT)), (F.col("doc_id") % len(EXT) + 1).cast("int"))
    return docs.select(
        "doc_id",
        F.concat_ws("", "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.col("lang").alias("language"),
        "text",
        F.length("text").cast("long").alias("size"),
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A stored cache; one that isn't there or can't be read counts as empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE)


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, path: str, fmt: str = "text", header: DataFrame | None = None) -> None:
    """One folder per chunk, its lines in order: rows (chunk, position, rendered). header: one row (value) before chunk 0."""
    if header is not None:
        kinds = {f.name: f.dataType for f in chunks.schema}
        first = header.select(F.lit(0).cast(kinds["chunk"]).alias("chunk"), F.lit(-2).cast(kinds["position"]).alias("position"), F.concat("value", F.lit("\n")).alias("rendered"))
        chunks = chunks.select("chunk", "position", "rendered").unionByName(first)
    whole = chunks.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("position", "rendered"))).alias("x"))
    rows = whole.select(F.format_string("%04d", "chunk").alias("chunk"), F.array_join("x.rendered", "\n").alias("value"))
    rows.write.mode("overwrite").partitionBy("chunk").text(path) if fmt == "text" else rows.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_totals(totals: DataFrame, path: str) -> None:
    """Add a run's totals (codec, kind, files, size, packed) to those kept."""
    totals.write.mode("append").parquet(path)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of all runs together."""
    from lodestone.operators.adaptive import add_totals

    kept = spark.read.parquet(path)
    return add_totals(kept, kept.limit(0))


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, added to those that are there."""
    rows.write.mode("append").json(path)


def checksummed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with json of the columns in order of name, and its checksum."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return df.withColumn("json", body).withColumn("checksum", F.sha2("json", 256))


def verified(df: DataFrame) -> DataFrame:
    """Rows whose json still has its checksum."""
    return df.where(F.sha2("json", 256) == F.col("checksum"))


def metadata(files: DataFrame, base: str, project: str, imports: Column | None = None) -> DataFrame:
    """The derived columns of a file: relative and module path, kind, hash, tokens, complexity, dependencies."""
    lang = F.col("language")
    found = imports if imports is not None else F.when(lang == "python", tx.python_imports(F.col("text"))).when(
        lang.isin("javascript", "typescript"), tx.javascript_imports(F.col("text"))
    ).when(lang == "go", tx.go_imports(F.col("text"))).otherwise(F.array().cast("array<string>"))
    out = files.withColumn("relative_path", paths.relative(F.col("path"), base)).withColumn("imports", found)
    return out.withColumns({
        "module_path": paths.module(F.col("relative_path"), lang), "file_type": paths.file_type(F.col("path")),
        "content_hash": tx.content_hash(F.col("text")), "token_count": tx.count_tokens(F.col("text")),
        "complexity": tx.basic_complexity(F.col("text")), "internal_dependencies": paths.internal(F.col("imports"), project),
        "external_dependencies": paths.external(F.col("imports"), project),
    })
