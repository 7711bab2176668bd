"""Content scan by line, file verdicts, rate limits and safe parsing."""

from __future__ import annotations

import ast
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.schema import STRINGS, B, S, with_field

_Q = "[\"']?"
#: (kind, type, pattern).
PATTERNS = [
    ("sensitive", "API Key", rf"(?i)(?:apikey|api[-_]?key)\s*[=:]\s*{_Q}[0-9a-zA-Z]{{16,}}{_Q}"),
    ("sensitive", "AWS Access Key", r"AKIA[A-Z0-9]{16}"),
    ("sensitive", "AWS Secret Key", rf"(?i)aws[-_]?secret[-_]?access[-_]?key\s*[=:]\s*{_Q}[0-9a-zA-Z/+=]{{40}}{_Q}"),
    ("sensitive", "Private Key", r"-----BEGIN (?:EC |RSA )?PRIVATE KEY-----"),
    ("sensitive", "Password", rf"(?i)(?:passwd|password|pwd)\s*[=:]\s*{_Q}[^\s\"']{{8,}}{_Q}"),
    ("sensitive", "Database URL", r"(?i)(?:postgresql|mysql|mongodb)://[^:]+:[^@]+@[^/]+"),
    ("sensitive", "JWT", r"eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+"),
    ("malicious", "Code execution", r"(?i)(?:exec|eval|passthru|shell_exec|system)\s*\("),
    ("malicious", "SQL injection", r"(?i)(?:drop\s+table|union\s+select|insert\s+into|delete\s+from)"),
    ("malicious", "Path traversal", r"\.\./"),
    ("malicious", "Script tag", r"<script[^>]*>"),
]
MAX_LINES, MAX_LINE, CHECKED_LINES = 100_000, 10_000, 1_000


def _hit(text: Column, kind: str | None = None) -> Column:
    """Whether any pattern of a kind occurs in a text; what a line holds, the whole text holds."""
    out = F.lit(False)
    for k, _, p in PATTERNS:
        if kind in (None, k):
            out = out | text.rlike(p)
    return out


def findings(files: DataFrame, key: str = "path") -> DataFrame:
    """Rows (key, line, kind, type): at most one per pattern and line, lines from 1. Only texts with a hit are cut into lines."""
    at = files.where(_hit(F.col("text"))).select(key, F.posexplode(F.split("text", "\n", -1)).alias("i", "raw"))
    hit = F.array(*[F.when(F.col("raw").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(t).alias("type"))) for k, t, p in PATTERNS])
    each = at.select(key, (F.col("i") + 1).cast("long").alias("line"), F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("f"))
    return each.select(key, "line", "f.kind", "f.type")


def _verdict(text: Column, most_lines: int, most_chars: int) -> dict[str, Column]:
    rows = F.split(text, "\n", -1)
    n = lambda kind: F.when(_hit(text, kind), F.size(F.filter(rows, lambda x: _hit(x, kind)))).otherwise(0).cast("long")
    return {
        "too_many_lines": F.regexp_count(text, F.lit("\n")) + 1 > most_lines,
        "long_line": (F.length(text) > most_chars) & F.exists(F.slice(rows, 1, CHECKED_LINES), lambda x: F.length(x) > most_chars),
        "sensitive": n("sensitive"), "malicious": n("malicious"),
    }


def verdicts(files: DataFrame, key: str = "path", most_lines: int = MAX_LINES, most_chars: int = MAX_LINE) -> DataFrame:
    """Rows (key, safe, too_many_lines, long_line, sensitive, malicious): unsafe by sensitive content or too many lines."""
    found = _verdict(F.col("text"), most_lines, most_chars)
    out = files.select(key, *[c.alias(k) for k, c in found.items()])
    return out.withColumn("safe", ~((F.col("sensitive") > 0) | F.col("too_many_lines")))


@F.pandas_udf(S)
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility-normalised text: for paths, before they are checked."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def validate(files: DataFrame, base: str, most_lines: int = MAX_LINES) -> DataFrame:
    """Rows (path, error, valid, warnings): rules of the compatibility-normalised path, of the file, then the scan, whose findings only warn."""
    p = nfkc(F.col("path"))
    found = _verdict(F.col("text"), most_lines, MAX_LINE)
    error = F.coalesce(paths.path_error(p, base), paths.file_error(p, F.col("size")))
    warn = F.filter(
        F.array(
            F.when(F.col("size") == 0, "empty file"), F.when(found["sensitive"] > 0, "sensitive content"),
            F.when(found["malicious"] > 0, "suspicious content"), F.when(found["long_line"], "line too long"),
        ),
        lambda x: x.isNotNull(),
    )
    return files.select("path", error.alias("error"), error.isNull().alias("valid"), warn.alias("warnings"))


_CALLS = frozenset("eval exec compile open input globals locals vars dir getattr setattr delattr hasattr __import__".split())
_OWNERS = frozenset({"os", "subprocess", "sys"})
_MODULES = _OWNERS | frozenset("builtins imp importlib pkgutil runpy __builtin__".split())


def _issues(text: str | None) -> list[str]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ["can't be parsed"]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name) and f.id in _CALLS:
                out.append((node.lineno, f"call of {f.id}"))
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in _OWNERS:
                out.append((node.lineno, f"call of {f.value.id}.{f.attr}"))
        elif isinstance(node, ast.Import):
            out += [(node.lineno, f"import of {a.name}") for a in node.names if a.name in _MODULES]
        elif isinstance(node, ast.ImportFrom) and node.module in _MODULES:
            out.append((node.lineno, f"import from {node.module}"))
    return [f"line {n}: {m}" for n, m in sorted(out)]


@F.pandas_udf(STRINGS)
def ast_issues(s: pd.Series) -> pd.Series:
    """Dangerous calls and imports of Python text."""
    return s.map(_issues)


def json_depth(text: Column) -> Column:
    """How deep the brackets of a JSON text nest, outside its strings."""
    bare = F.regexp_replace(text, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    step = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), 0), lambda x: F.when(x.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deeper = lambda acc, x: F.struct((acc["now"] + x).alias("now"), F.greatest(acc["most"], acc["now"] + x).alias("most"))
    return F.aggregate(step, start, deeper, lambda acc: acc["most"])


def safe_json(text: Column, schema: str, most: int = 10 * 1024 * 1024, depth: int = 100) -> Column:
    """Parsed JSON, null if it is too long, nests more than ``depth`` brackets, or is wrong."""
    return F.when((F.length(text) <= most) & (json_depth(text) <= depth), F.from_json(text, schema))


def admitted(calls: DataFrame, most: int = 100, window: float = 60.0) -> DataFrame:
    """``calls`` (user_id, event_id, t) with allowed: fewer than ``most`` allowed calls in the last ``window`` seconds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"], kind="stable")
        times, first, out = [], 0, []
        for t in pdf["t"]:
            while first < len(times) and times[first] <= t - window:
                first += 1
            ok = len(times) - first < most
            if ok:
                times.append(t)
            out.append(ok)
        return pdf.assign(allowed=out)

    return calls.groupBy("user_id").applyInPandas(run, with_field(calls.schema, "allowed", B))


def call_rate(calls: DataFrame, window: int = 60) -> DataFrame:
    """Calls of a user in the window that ends at each: an upper bound of what the limiter counts."""
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-window, 0)
    return calls.withColumn("in_window", F.count("*").over(w))


ERROR_CLASSES = {"FileNotFoundError": "file not found", "PermissionError": "not permitted", "ValueError": "invalid value", "MemoryError": "out of memory", "TimeoutError": "timed out"}


def sanitized_error(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ERROR_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("an error occurred"))
