"""Settings of a run, checked on construction, and presets; a preset names Spark settings, not data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("full", "structural", "signature", "summary")
FORMATS = ("markdown", "json", "xml", "custom")
CHUNKING = ("semantic", "size", "balanced")


@dataclass(frozen=True)
class Config:
    window_bytes: int = 1 << 20
    hop_bytes: int = 1 << 16
    chunk_chars: int = 100_000
    shuffle_partitions: int = 200
    max_partition_bytes: int = 128 << 20
    max_files: int = 100_000
    max_bytes: int = 1 << 30
    max_hashes: int = 100_000
    level: int = 6
    ttl_s: float = 86_400.0
    strategy: str = "structural"
    output_format: str = "markdown"
    chunking: str = "semantic"

    def __post_init__(self) -> None:
        for k in ("window_bytes", "hop_bytes", "chunk_chars", "shuffle_partitions", "max_partition_bytes", "max_files", "max_bytes", "max_hashes", "ttl_s"):
            if getattr(self, k) <= 0:
                raise ValueError(f"{k} is positive")
        if self.hop_bytes > self.window_bytes:
            raise ValueError("hop_bytes is at most window_bytes")
        if not 0 <= self.level <= 22:
            raise ValueError("level is from 0 to 22")
        for k, known in (("strategy", STRATEGIES), ("output_format", FORMATS), ("chunking", CHUNKING)):
            if getattr(self, k) not in known:
                raise ValueError(f"{k} is one of {', '.join(known)}")

    def spark(self) -> dict[str, str]:
        return {
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
            "spark.sql.files.maxPartitionBytes": str(self.max_partition_bytes),
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
        }


PRESETS = {
    "large": Config(shuffle_partitions=4000, max_partition_bytes=256 << 20, max_files=1_000_000_000, max_bytes=1 << 50),
    "memory_constrained": Config(shuffle_partitions=1000, max_partition_bytes=32 << 20, max_hashes=10_000),
    "real_time": Config(level=1, shuffle_partitions=32, strategy="signature", ttl_s=300),
    "high_quality": Config(level=19, strategy="full"),
    "development": Config(shuffle_partitions=8, max_files=1_000),
    "cloud": Config(shuffle_partitions=2000, output_format="json"),
}


def measure(files: DataFrame) -> tuple[int, int]:
    """(files, bytes) of rows (size_bytes, ..): what ``auto`` goes by."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    return int(n), int(size)


def auto(files: int, total_bytes: int) -> Config:
    """A preset by how many files there are and how large they are on average."""
    if files > 100_000:
        return PRESETS["large"]
    average = total_bytes / files if files else 1024
    return PRESETS["real_time"] if average < 10 * 1024 else PRESETS["high_quality"]


def for_query(config: Config, **criteria) -> Config:
    """A setting that suits what is asked for."""
    if criteria.get("min_complexity", 0) > 10:
        config = replace(config, window_bytes=2 * config.window_bytes, strategy="full")
    if criteria.get("language") in ("python", "javascript"):
        config = replace(config, strategy="structural")
    elif criteria.get("language") in ("c", "cpp"):
        config = replace(config, strategy="signature")
    if "imports" in criteria or "exports" in criteria:
        config = replace(config, chunking="semantic")
    return config


def constrained(config: Config, max_memory_gb: float | None = None, max_time_minutes: float | None = None, output_size_mb: float | None = None) -> Config:
    """A setting within limits: less memory means smaller partitions, less time a lower level, less output a summary."""
    if max_memory_gb is not None:
        config = replace(config, max_partition_bytes=max(1 << 20, min(config.max_partition_bytes, int(max_memory_gb * (1 << 30) / 16))))
    if max_time_minutes is not None:
        config = replace(config, level=min(config.level, 6), chunking="size")
    if output_size_mb is not None:
        config = replace(config, level=12, strategy="summary")
    return config
