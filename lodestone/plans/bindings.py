"""The relations that the test tables stand in for, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.sources.files import documents_as_files, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


FILES = """files AS (
  SELECT doc_id, source || '/' || lang || '/' || doc_id ||
    ['.py', '.js', '.json', '.md', '.go', '.rs', '/__init__.py', '.ts'][doc_id % 8 + 1] AS path,
    lang AS language, text, length(text)::BIGINT AS size FROM documents)"""

#: A snippet of code for every document, by its id: what patterns look for.
SNIPPETS = [
    "import os, sys as s\nfrom pathlib import Path\n# note\nMAX_SIZE = 10\ndef load(path, mode='r') -> str:\n    return 'x'\nclass Box(Base):\n    pass\n",
    "import { a } from 'left-pad'\nconst fs = require('fs')\nfunction run(x) { return x }\nconst go = async (y) => y\nclass Cat extends Animal {}\n",
    "password = hunter2hunter2\n<script src=x>\n",
    "API_KEY = 'abcdefghijklmnop1234'\nDROP TABLE users;\n../up\n",
    "static final int x = 1\nif (a and b) for while\n",
]


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with a snippet before the text, and a language that patterns know."""
    s = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
    lang = F.when(F.col("doc_id") % len(SNIPPETS) == 0, "python").when(F.col("doc_id") % len(SNIPPETS) == 1, "javascript").otherwise("text")
    out = files(spark, sf_dir).withColumn("text", F.concat(s, "text")).withColumn("language", lang)
    return out.withColumn("size", F.length("text").cast("long"))


_LIST = ", ".join("'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for s in SNIPPETS)
CODE = f"""{FILES}, code AS (
  SELECT doc_id, path, ([{_LIST}])[doc_id % {len(SNIPPETS)} + 1] || text AS text,
    CASE doc_id % {len(SNIPPETS)} WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'text' END AS language
  FROM files)"""


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that filters above don't compute again: a generator of one row stands between."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with token_count and complexity."""
    f = files(spark, sf_dir)
    return once(f, token_count=tx.count_tokens(F.col("text")), complexity=tx.basic_complexity(F.col("text")))


_W = r"[\p{L}\p{M}\p{N}_]"
TOKEN_SQL = rf"{_W}+|[^\p{{L}}\p{{M}}\p{{N}}_\s]"
COMPLEXITY_SQL = r"""(1 + len(regexp_extract_all(text, '(?i)\b(?:if|else|elif|while|for|case|catch|except|switch|try|finally)\b'))
    + len(regexp_extract_all(text, '\b(?:and|or|&&|\|\|)\b')))::DOUBLE"""
MEASURED = rf"""{FILES}, measured AS (
  SELECT *, len(regexp_extract_all(text, '{TOKEN_SQL}'))::BIGINT AS token_count, {COMPLEXITY_SQL} AS complexity FROM files)"""


_FOUND = {"exports": r"class\s+(\w+)", "functions": r"(?:def|function)\s+(\w+)", "classes": r"class\s+(\w+)"}
JS_IMPORTS_SQL = r"""regexp_extract_all(text, 'import\s+(?:\{[^}]+\}|[*\w]+(?:\s+as\s+\w+)?)\s+from\s+[''"]([^''"]+)[''"]', 1)
    || regexp_extract_all(text, '(?:var|let|const)\s+\w+\s*=\s*require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1)"""


def coded(spark: SparkSession, sf_dir: str, filtered: bool = False) -> DataFrame:
    """code with measures and symbols. filtered: by columns of these, so that they are all found first; else only those that are used are."""
    t = F.col("text")
    each = {k: tx.found(t, p) for k, p in _FOUND.items()}
    for k in ("functions", "classes"):
        each[k] = F.transform(each[k], lambda n: F.struct(n.alias("name")))
    each |= {"token_count": tx.count_tokens(t), "complexity": tx.basic_complexity(t), "imports": tx.javascript_imports(t)}
    return once(code(spark, sf_dir), **each) if filtered else code(spark, sf_dir).withColumns(each)


CODED = CODE + "".join([rf""", coded AS (
  SELECT *, length(text)::BIGINT AS size, len(regexp_extract_all(text, '{TOKEN_SQL}'))::BIGINT AS token_count, {COMPLEXITY_SQL} AS complexity, {JS_IMPORTS_SQL} AS imports""",
  *[f", regexp_extract_all(text, '{p}', 1) AS {k}" for k, p in _FOUND.items()], " FROM code)"])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with t, seconds since the epoch."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("t", F.unix_micros("ts") / F.lit(1e6))


EVENTS = "ev AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("id"), "value")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage record per event: every 11th is not ended; props give items."""
    e = events(spark, sf_dir)
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return e.select(
        F.col("event_id").alias("stage_id"), F.concat(F.col("event_type"), F.lit("_parsing")).alias("stage"), F.col("t").alias("start"),
        F.when(F.col("event_id") % 11 != 0, F.col("t") + F.col("event_id") % 7 + 1).alias("end"), k.alias("items"), (k * 1000).alias("bytes"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("errors"), (F.col("user_id") + 100).alias("memory_start"),
        (F.col("user_id") + 100 + k * 3).alias("memory_peak"), (F.col("event_id") % 100).cast("double").alias("cpu"),
    )


STAGES = f"""{EVENTS}, stages AS (
  SELECT event_id AS stage_id, event_type || '_parsing' AS stage, t AS start,
    CASE WHEN event_id % 11 <> 0 THEN t + event_id % 7 + 1 END AS "end",
    coalesce((props->>'$.k')::BIGINT, 0) AS items, coalesce((props->>'$.k')::BIGINT, 0) * 1000 AS bytes,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors, user_id + 100 AS memory_start,
    user_id + 100 + coalesce((props->>'$.k')::BIGINT, 0) * 3 AS memory_peak, (event_id % 100)::DOUBLE AS cpu
  FROM ev)"""


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that import and export symbols: suppliers as files, parts as symbols, from every row of lineitem."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").repartition("l_suppkey").distinct()  # the one shuffle of rows
    n = F.col("l_partkey")
    own = li.groupBy("l_suppkey").agg(
        F.sort_array(F.collect_list(F.when(n % 3 == 0, n.cast("string")))).alias("imports"),
        F.sort_array(F.collect_list(F.when(n % 3 == 0, F.lit(None)).otherwise((n * 3).cast("string")))).alias("exports"),
    )
    return own.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), "imports", "exports")


DEPS = """li AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
imp AS (SELECT DISTINCT 's' || l_suppkey AS path, l_partkey::VARCHAR AS symbol FROM li WHERE l_partkey % 3 = 0),
exp AS (SELECT DISTINCT 's' || l_suppkey AS path, (l_partkey * 3)::VARCHAR AS symbol FROM li WHERE l_partkey % 3 <> 0)"""

#: Names of files of every kind: (name, kind, what its parser calls it, strategy).
KINDS = [
    ("main.py", "source", "source", "structural"), ("tests/util.py", "test", "source", "structural"), ("setup.py", "config", "source", "structural"),
    ("README.md", "doc", "source", "summary"), ("pkg/__init__.py", "init", "source", "structural"), ("main.go", "source", "main", "structural"),
    ("a_test.go", "test", "test", "signature"), ("main.rs", "source", "main", "structural"), ("lib.rs", "source", "library", "structural"),
    ("mod.rs", "source", "module", "structural"), ("x.d.ts", "source", "declaration", "structural"), ("y.spec.ts", "source", "test", "signature"),
    ("z.test.ts", "test", "test", "signature"), ("app.min.js", "source", "source", "summary"), ("conf.yaml", "source", "source", "full"),
    ("notes.txt", "source", "source", "summary"),
]


def python_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Python modules (doc_id, path, language, text): functions, a class and calls by id, then the whole text as comments."""
    n = F.col("doc_id")
    each = F.transform(F.sequence(F.lit(0), (n % 4).cast("int")), lambda i: F.concat(F.lit("@wraps\ndef f"), i.cast("string"), F.lit("(a, b):\n    if a and b:\n        return [x for x in a]\n")))
    text = F.concat(
        F.lit("import os, json\nfrom a.b import c\nLIMIT = 1\n"), F.array_join(each, ""),
        F.when(n % 3 == 0, F.lit("class Box(Base):\n    size: int = 1\n    def get(self):\n        return getattr(self, 'size')\n")).otherwise(F.lit("")),
        F.when(n % 5 == 0, F.lit("x = eval('1')\nos.remove('y')\n")).otherwise(F.lit("")), F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")),
    )
    broken = F.when(n % 7 == 0, F.concat(F.lit("def (:\n"), text)).otherwise(text)
    return files(spark, sf_dir).select("doc_id", F.concat(n.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), broken.alias("text"))
