"""Byte analysis, choice of a codec, compression and its statistics."""

from __future__ import annotations

import bz2
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import B, D, I, S, row

ANALYSIS = row(
    entropy=D, likely_compressed=B, repetition=D, structure=D, binary=B, compressibility=D, top=T.MapType(I, D)
)
#: File kind to (codec, level, priority); lz4 and brotli aren't at hand, zlib stands for them.
PROFILES = {
    "python": ("zstd", 6, "balanced"), "javascript": ("zlib", 5, "balanced"), "typescript": ("zlib", 5, "balanced"),
    "go": ("zstd", 5, "speed"), "rust": ("zstd", 5, "speed"), "html": ("zlib", 6, "ratio"), "css": ("zlib", 6, "ratio"),
    "json": ("zstd", 9, "ratio"), "xml": ("bzip2", 9, "ratio"), "csv": ("zstd", 7, "ratio"), "markdown": ("zlib", 6, "balanced"),
    "text": ("zlib", 6, "balanced"), "binary": ("lz4", 1, "speed"), "image": ("none", 0, "speed"), "compressed": ("none", 0, "speed"),
}
#: Codec to (speed, ratio, memory).
ALGORITHMS = {
    "none": ("fastest", "none", "least"), "lz4": ("fastest", "low", "low"), "zlib": ("medium", "medium", "low"),
    "bzip2": ("slow", "high", "medium"), "zstd": ("fast", "high", "medium"), "brotli": ("slow", "high", "medium"),
}


def sample_of(b: bytes, size: int = 8192) -> bytes:
    """Head, middle and tail of long content."""
    if len(b) <= size:
        return b
    t, h, m = size // 3, size // 6, len(b) // 2
    return b[:t] + b[m - h : m + h] + b[-t:]


def analyse(b: bytes) -> dict:
    s = sample_of(b)
    n = len(s)
    count = np.bincount(np.frombuffer(s, np.uint8), minlength=256)
    p = count[count > 0] / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum()) if n else 0.0
    pieces = [s[i : i + 16] for i in range(0, n - 16, 16)]
    repetition = 1 - len(set(pieces)) / len(pieces) if pieces else 0.0
    structure = 1 - len(p) / 256
    top = np.lexsort((np.arange(256), -count))[:10]
    return {
        "entropy": entropy, "likely_compressed": entropy / 8 > 0.95, "repetition": repetition, "structure": structure,
        "binary": bool(count[0] > n * 0.01 or count[32:127].sum() < n * 0.75),
        "compressibility": (1 - entropy / 8) * 0.4 + repetition * 0.3 + structure * 0.3,
        "top": {int(i): float(count[i] / n) for i in top if count[i]},
    }


@F.pandas_udf(ANALYSIS)
def analysis(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([analyse((c or "").encode() if isinstance(c, str) or c is None else bytes(c)) for c in content])


def choose(kind: Column, compressibility: Column, likely_compressed: Column, size: Column, load: Column | float = 0.5) -> Column:
    """struct<codec,level> for a file: its kind's profile, then content, size and load, in that order."""
    table = F.create_map(*[x for k, (c, n, _) in PROFILES.items() for x in (F.lit(k), F.struct(F.lit(c).alias("codec"), F.lit(n).alias("level")))])
    base = F.coalesce(F.try_element_at(table, kind), F.struct(F.lit("lz4").alias("codec"), F.lit(3).alias("level")))
    codec, level = base["codec"], base["level"]
    high, low = compressibility > 0.7, compressibility < 0.3
    codec = F.when(high & (codec == "lz4"), "zstd").when(low, "lz4").otherwise(codec)
    level = F.when(high, F.least(level + 2, F.lit(9))).when(low, F.greatest(level - 2, F.lit(1))).otherwise(level)
    big, tiny = size > 10 * 1024 * 1024, size < 10 * 1024
    codec = F.when(big & codec.isin("bzip2", "brotli"), "zstd").otherwise(codec)
    level = F.when(big, F.greatest(level - 1, F.lit(1))).when(tiny, F.least(level + 1, F.lit(9))).otherwise(level)
    load = F.lit(load) if isinstance(load, float) else load
    busy, idle = load > 0.8, load < 0.3
    codec = F.when(busy, "lz4").when(idle & (codec == "lz4"), "zstd").otherwise(codec)
    level = F.when(busy, 1).when(idle, F.least(level + 1, F.lit(9))).otherwise(level)
    none = F.struct(F.lit("none").alias("codec"), F.lit(0).alias("level"))
    return F.when(likely_compressed, none).otherwise(F.struct(codec.alias("codec"), level.alias("level")))


def pack(b: bytes, codec: str, level: int) -> bytes:
    if codec == "zstd":
        return zstandard.ZstdCompressor(level=level).compress(b)
    if codec == "bzip2":
        return bz2.compress(b, max(1, level))
    if codec == "none":
        return b
    return zlib.compress(b, min(9, max(1, level if codec == "zlib" or codec == "brotli" else 1)))


def packed(b: bytes, codec: str, level: int) -> bytes:
    """``pack``, or zlib at its fastest if the codec fails; the first byte says which: 1 as asked, 0 not."""
    try:
        return b"\1" + pack(b, codec, level)
    except (zstandard.ZstdError, zlib.error, OSError, ValueError):
        return b"\0" + zlib.compress(b, 1)


def unpacked(b: bytes, codec: str) -> bytes:
    return unpack(b[1:], codec) if b[0] else zlib.decompress(b[1:])


def unpack(b: bytes, codec: str) -> bytes:
    if codec == "zstd":
        return zstandard.ZstdDecompressor().decompress(b)
    return bz2.decompress(b) if codec == "bzip2" else b if codec == "none" else zlib.decompress(b)


@F.pandas_udf(T.BinaryType())
def compress(text: pd.Series, codec: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([packed((t or "").encode(), c, int(n)) for t, c, n in zip(text, codec, level, strict=True)])


@F.pandas_udf(T.BinaryType())
def compress_bytes(data: pd.Series, codec: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([packed(bytes(b), c, int(n)) for b, c, n in zip(data, codec, level, strict=True)])


@F.pandas_udf(T.BinaryType())
def decompress_bytes(data: pd.Series, codec: pd.Series) -> pd.Series:
    return pd.Series([unpacked(bytes(b), c) for b, c in zip(data, codec, strict=True)])


@F.pandas_udf(S)
def decompress(data: pd.Series, codec: pd.Series) -> pd.Series:
    return pd.Series([unpacked(bytes(b), c).decode() for b, c in zip(data, codec, strict=True)])


def compression_stats(rows: DataFrame) -> DataFrame:
    """Rows (ext, codec, n, size, packed) of (ext, codec, size, packed); null stands for all, by one pass of a cube."""
    g = rows.cube("ext", "codec").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("packed").alias("packed"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g").bitwiseAND(2) == 0, F.col("ext")).otherwise("*").alias("ext"), F.when(F.col("g").bitwiseAND(1) == 0, F.col("codec")).otherwise("*").alias("codec"), "n", "size", "packed")


def compression_report(rows: DataFrame, n: int = 10) -> DataFrame:
    """Rows (ext, files, share, ratio): the extensions that compress best."""
    per = rows.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("s"), F.sum("packed").alias("p"))
    all_ = Window.partitionBy()  # over one row per extension
    out = per.withColumn("share", F.col("files") / F.sum("files").over(all_)).withColumn("ratio", F.col("p") / F.col("s"))
    return out.select("ext", "files", "share", "ratio").orderBy("ratio", "ext").limit(n)


def benchmark(texts: DataFrame, codecs: tuple[str, ...] = ("zlib", "zstd", "bzip2"), levels: tuple[int, ...] = (1, 5, 9)) -> DataFrame:
    """Rows (codec, level, size, packed, seconds) of every codec and level over all texts."""
    spark = texts.sparkSession
    ways = spark.createDataFrame([(c, n) for c in codecs for n in levels], "codec string, level int")

    def run(batches):
        for pdf in batches:
            out = []
            for t, c, n in zip(pdf["text"], pdf["codec"], pdf["level"], strict=True):
                b, start = (t or "").encode(), time.perf_counter()
                out.append((c, n, len(b), len(pack(b, c, n)), time.perf_counter() - start))
            yield pd.DataFrame(out, columns=["codec", "level", "size", "packed", "seconds"])

    each = texts.select("text").crossJoin(F.broadcast(ways)).mapInPandas(run, "codec string, level int, size long, packed long, seconds double")
    return each.groupBy("codec", "level").agg(F.sum("size").alias("size"), F.sum("packed").alias("packed"), F.sum("seconds").alias("seconds"))


def byte_frequencies(texts: DataFrame, n: int = 10) -> DataFrame:
    """Rows (byte, n): the most frequent bytes over all texts. Each batch sends at most 256 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            col = batch.column(0).cast(pa.large_binary())
            for i in range(len(col)):
                if col[i].is_valid:
                    total += np.bincount(np.frombuffer(col[i].as_buffer(), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["byte", "n"])

    each = texts.select("text").mapInArrow(run, "byte int, n long")
    return each.groupBy("byte").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "byte").limit(n)


def entropy_of(text: str) -> float:
    """Shannon entropy of a text's characters, in bits."""
    _, k = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    p = k / k.sum()
    return float(max(0.0, -(p * np.log2(p)).sum()))


def text_entropy(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, entropy) of every non-empty text, next to its row: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([entropy_of(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "entropy"])

    return texts.where("text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id long, entropy double")


def compress_files(files: DataFrame, load: float = 0.5) -> DataFrame:
    """Rows (path, codec, level, size, packed, data): each file (path, language, text) by the codec that suits it.

    Its kind, content and size choose the codec; a codec that fails is replaced by the fastest one (see ``pack``).
    """
    a = files.withColumn("a", analysis("text")).withColumn("size", F.octet_length("text").cast("long"))
    chosen = choose(F.col("language"), F.col("a.compressibility"), F.col("a.likely_compressed"), F.col("size"), load)
    packed = a.withColumn("c", chosen).select("path", "c.codec", "c.level", "size", compress("text", "c.codec", "c.level").alias("data"))
    return packed.select("path", "codec", "level", "size", F.octet_length("data").cast("long").alias("packed"), "data")


def compress_windows(windows: DataFrame, codec: str = "lz4", level: int = 9) -> DataFrame:
    """``windows`` (doc_id, start, is_tail, piece) that dedup has left, with codec and data instead of the piece."""
    data = compress_bytes("piece", F.lit(codec), F.lit(level)).alias("data")
    return windows.select("doc_id", "start", "is_tail", F.lit(codec).alias("codec"), F.octet_length("piece").cast("long").alias("size"), data)


def usage_totals(packed: DataFrame) -> DataFrame:
    """Rows (codec, kind, files, size, packed) of compressed files with their kind (language): what is kept of a run's statistics."""
    return packed.groupBy("codec", F.col("language").alias("kind")).agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("packed").alias("packed"))


def add_totals(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Totals of earlier runs and of a new one, together."""
    n = ("files", "size", "packed")
    return kept.unionByName(new).groupBy("codec", "kind").agg(*[F.sum(c).alias(c) for c in n])
