"""What keeps operators' cost in proportion to their input, and that results stay those of the plain form."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import codemap, store
from lodestone.plans import catalog
from lodestone.sources import files


def test_names_look_at_few_targets(spark):
    # Every key's short grams are in many paths, its long ones only in its own.
    paths = spark.createDataFrame([(f"Brand#{k % 25}/old_ring_{k}.py",) for k in range(2000)], "dst string")
    names = spark.createDataFrame([(f"_{k}.",) for k in range(2000)] + [(f"old_ring_{k}",) for k in range(50)], "dep string")
    found = codemap.containing(names, paths).count()
    assert found == 2000 + sum(str(k).startswith(str(j)) for j in range(50) for k in range(2000))
    assert codemap.candidates(names, paths).count() < 2 * found


def test_dependency_edges_are_distinct_without_a_shuffle_of_edges(spark):
    rows = [("a/x.py", ["x", "a/", "", "x.", "yy"]), ("a/x.py", ["x", "z"]), ("b/yy.py", ["yy", "/"]), ("z", None), ("c/" + "long" * 60, ["long" * 55, "q"])]
    got = codemap.dependency_edges(spark.createDataFrame(rows, "path string, imports array<string>"))
    want = {(p, q) for p, own in rows for d in own or [] if d for q, _ in rows if d in q}
    edges = [tuple(r) for r in got.select("src", "dst").collect()]
    assert len(edges) == len(set(edges)) and set(edges) == want
    top = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in x for x in top[: next(i for i, x in enumerate(top) if "Join" in x)])


def test_features_are_those_of_the_plain_patterns(spark):
    w = "[\\p{L}\\p{M}\\p{N}_]"
    plain = {
        "typescript": {"generics": rf"<[A-Z]{w}*(?:\s+extends\s+{w}+)?>|{w}+<[^>]+>", "decorators": rf"@{w}+\s*(?:\([^)]*\))?\s*(?:class|function|get|set|method)"},
        "go": {"goroutines": rf"\bgo\s+{w}+\s*\(", "channels": r"\bchan\b|<-", "generics": rf"\[\s*{w}+\s+{w}+(?:\s*,\s*{w}+\s+{w}+)*\s*\]"},
        "rust": {"unsafe": r"\bunsafe\s*\{", "async": r"\basync\b|\bawait\b", "macros": f"{w}+!", "generics": rf"<[^>]*(?:[A-Z]{w}*|'{w}+)[^>]*>"},
    }
    texts = ["", None, "é<x>", "a<>", "<A>", "<a 'b>", "<a '>", "<aB\nc>", "<x > Y>", "<<'é", "x <Y", "ago f(", "go f (", "(go)", "chance", "chan", "a<-b", "!", "a!", "ü!", " [a b, c d]", "[a]", "unsafe {", "unsafer{", "await", "awaits", "@a(b) class", "@ class"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    for lang, own in plain.items():
        want = F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in own.items()]), lambda x: x.isNotNull())
        assert d.where(~tx.features(t, lang).eqNullSafe(want)).count() == 0
    # Time was quadratic for a "<" with capitals and no ">" behind it.
    long = spark.range(1).select(F.concat(F.lit("> <"), F.repeat(F.lit("A b "), 100_000)).alias("t"))
    began = time.time()
    assert long.select(tx.features(F.col("t"), "rust").alias("f")).first()["f"] == []
    assert time.time() - began < 20


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_complexity_and_found_are_those_of_the_plain_patterns(spark):
    words = "|".join(tx.KEYWORDS)
    texts = ["", None, "IF a and b", "if&&else||x", "a&&b || c", "for or nor", "éif ifé if", "Case:AND and", "def f function g undef x", "let a = b => c", "const x = require('y')", "final x = 1\nAB = '2'", "=> ="]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = (F.regexp_count(t, F.lit(rf"(?i)\b(?:{words})\b")) + F.regexp_count(t, F.lit(r"\b(?:and|or|&&|\|\|)\b")) + 1).cast("double")
    assert d.where(~tx.basic_complexity(t).eqNullSafe(plain)).count() == 0
    for p in tx._LITERALS:
        assert d.where(~tx.found(t, p, 0).eqNullSafe(F.regexp_extract_all(t, F.lit(p), 0))).count() == 0


def test_texts_are_read_once(spark, sf_dir):
    q = catalog.queries()
    for name in ("format_xml", "format_custom", "format_markdown"):
        assert _plan(q[name](spark, sf_dir)).count("Relation") == 1
    for name in ("store_statistics", "corpus_map"):
        assert _plan(q[name](spark, sf_dir)).count(tx.TOKEN) == 1


def test_symbols_of_a_large_file(spark):
    n = 100_000  # each struct was compared with each
    f = spark.range(1).select(F.lit("p").alias("path"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % (n - 1)).cast("string")).alias("imports"))
    began = time.time()
    assert store.symbols(f).count() == n - 1
    assert time.time() - began < 20


def test_overview_of_nothing_and_of_unrated_files(spark):
    schema = "language string, size long, token_count long, complexity double"
    assert codemap.overview(spark.createDataFrame([], schema)).first().asDict() == {"files": 0, "size": 0, "tokens": 0, "average": 0.0, "languages": []}
    got = codemap.overview(spark.createDataFrame([("b", 1, 2, 0.0), ("a", 3, 4, 3.0), ("a", 5, 6, 4.0)], schema)).first()
    assert tuple(got)[:4] == (3, 9, 12, 3.5) and [tuple(x) for x in got["languages"]] == [("a", 2), ("b", 1)]


def test_python_gets_few_bytes_at_once(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    d = files.spread(spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))).coalesce(1)
    n = [r["n"] for r in d.mapInArrow(rows, "n long").collect()]
    assert sum(n) > 40_000_000 and max(n) < 1.5 * files.BATCH_BYTES
