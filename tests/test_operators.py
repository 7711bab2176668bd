"""Operators on small hand-made rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import paths, text as tx
from lodestone.operators import adaptive, chunking, codemap, incremental, monitoring, parsers, security, store
from lodestone.operators.graph import connected_components
from lodestone.plans.pipeline import compress_codebase, corpus
from lodestone.sources import files as src
from lodestone.streaming import jobs


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("x")).first()["x"]


def components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    for rows in (0, 1000):  # in rounds, and in one task
        assert {x["node"]: x["component"] for x in connected_components(spark, df, rows=rows).collect()} == components(edges)


def test_components_of_a_long_path(spark):
    path = spark.range(400).selectExpr("concat('n', lpad(id, 4, '0')) a", "concat('n', lpad(id + 1, 4, '0')) b")
    for rows in (0, 1000):
        got = connected_components(spark, path, rows=rows)
        assert got.count() == 401 and got.select("component").distinct().count() == 1


def test_components_of_nothing(spark):
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_selection(spark):
    rows = [("/t/file1.py", "python", 1024, 5.5, ["os", "sys"], 30), ("/t/utils.js", "javascript", 512, 2.0, ["fs"], 9)]
    f = spark.createDataFrame(rows, "path string, language string, size long, complexity double, imports array<string>, token_count long")
    assert [r["path"] for r in store.query(f, language="python", min_complexity=5.5).collect()] == ["/t/file1.py"]
    assert store.query(f, imports="fs", max_size=512).count() == 1
    assert store.query(f).count() == 0  # no criterion, no row
    with pytest.raises(ValueError):
        store.query(f, colour="red")


def test_python_parser(spark):
    code = 'import os\nfrom pathlib import Path\n\n\ndef f(a, b=None):\n    """Doc."""\n    if a:\n        for x in b:\n            if x and a:\n                pass\n\n\nclass T(Base):\n    k = 1\n\n    async def m(self):\n        pass\n'
    df = spark.createDataFrame([("a.py", "python", code), ("b.py", "python", "def broken(a):\n  import x\n  def inner(b): (\n"), ("c.py", "python", None)], "path string, language string, text string")
    got = {r["path"]: r for r in parsers.PythonParser().parse(df).collect()}
    a = got["a.py"]
    assert a["imports"] == ["os", "pathlib"] and a["functions"][0]["name"] == "f" and a["functions"][0]["docstring"] == "Doc."
    assert a["classes"][0]["name"] == "T" and a["classes"][0]["methods"][0]["is_async"] and a["complexity"] == 5
    assert got["b.py"]["parse_error"].startswith("SyntaxError") and got["b.py"]["functions"][0]["name"] == "broken"
    assert got["c.py"]["functions"] == []


def test_registry():
    class Mock(parsers.MinimalParser):
        extensions = (".mock",)

    r = parsers.Registry()
    low, high, low2 = Mock(), Mock(), Mock()
    for p, n in ((low, 5), (high, 15), (low2, 3)):
        r.register(p, n)
    assert r.for_extension(".MOCK") is high and r.for_extension(".none") is None
    assert r.for_language("go").name == "go" and r.stats() == {"built-in": 6, "runtime": 3}


def test_other_parsers(spark):
    go = 'package main\nimport (\n "fmt"\n "os"\n)\ntype Point struct {\n X int `json:"x"`\n}\nfunc (p *Point) Sum() int { if p.X > 0 { return 1 }; return 0 }\n'
    rs = "use std::fmt;\n#[derive(Debug)]\npub struct A;\nenum B { X }\ntrait C {}\npub async fn go<T>(x: T) {}\n"
    ts = "import { x } from 'y'\n/* no */\nexport interface I { a: string }\nexport class K<T> {}\nconst f = async (a) => a // c\n"
    df = spark.createDataFrame([("a.go", "go", go), ("b.rs", "rust", rs), ("c.ts", "typescript", ts), ("d.xyz", "unknown", "?")], "path string, language string, text string")
    got = {r["path"]: r for r in parsers.Registry().parse(df).collect()}
    assert got["a.go"]["imports"] == ["fmt", "os"] and set(got["a.go"]["exports"]) == {"Sum", "Point"}
    assert [c["name"] for c in got["b.rs"]["classes"]] == ["A", "B", "C"] and got["b.rs"]["functions"][0]["name"] == "go"
    assert got["c.ts"]["imports"] == ["y"] and {c["type"] for c in got["c.ts"]["classes"]} == {"interface", "class"}
    assert got["d.xyz"]["functions"] == []


def test_next_fit(spark):
    rows = [("g", f"p{i}", s, float(c)) for i, (s, c) in enumerate(zip((100, 200, 300, 400, 500), (0, 2, 4, 6, 8)))]
    f = spark.createDataFrame(rows, "g string, path string, size long, complexity double")
    got = {r["size"]: r["chunk"] for r in chunking.metadata_chunks(f, ["g"], 600).collect()}
    assert got == {500: 0, 400: 1, 300: 2, 200: 2, 100: 2}
    assert [r["chunk"] for r in chunking.metadata_chunks(f.where("size = 500"), ["g"], 100).collect()] == [0]
    assert chunking.metadata_chunks(f.limit(0), ["g"], 100).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=30), st.integers(1, 60))
def test_next_fit_keeps_all(sizes, most):
    import pandas as pd

    chunk = chunking._next_fit(pd.Series(sizes, dtype="int64"), most)
    for k in set(chunk):
        own = [s for s, c in zip(sizes, chunk) if c == k]
        assert sum(own) <= most or len(own) == 1
    assert chunk == sorted(chunk) and len(chunk) == len(sizes)


def test_windows(spark):
    df = spark.createDataFrame([(1, "A" * 4096), (2, "short"), (3, "")], "doc_id long, text string")
    w = chunking.byte_windows(df, 1024, 256, pieces=True)
    assert w.where("doc_id = 1 and not is_tail").count() == 13 and w.where("doc_id = 2").first()["piece"] == b"short"
    d = chunking.dedup_windows(w)
    assert d.where("doc_id = 1 and not is_tail").count() == 1 and w.where("doc_id = 3").count() == 0
    for bad in ((0, 1), (4, 0), (4, 5)):
        with pytest.raises(ValueError):
            chunking.byte_windows(df, *bad)


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    before = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "path string, content_hash string")
    assert {r["path"]: r["change"] for r in incremental.diff(now, before).collect()} == {"a": "added", "b": "unchanged", "c": "modified", "d": "deleted"}


def test_security(spark):
    df = spark.createDataFrame([("a", "x = 1"), ("b", "url = postgresql://u:p@h/d\nAPI_KEY = 'sk-1234567890abcdef'"), ("c", "eval(x)"), ("d", "x\n" * 9)], "path string, text string")
    v = {r["path"]: r for r in security.verdicts(df, most_lines=5).collect()}
    assert v["a"]["safe"] and not v["b"]["safe"] and v["c"]["safe"] and v["c"]["malicious"] == 1 and not v["d"]["safe"]


def test_limiter_and_breaker(spark):
    rows = [(1, i, float(i), i < 5) for i in range(8)] + [(1, 8, 70.0, False), (1, 9, 71.0, False), (1, 10, 72.0, False)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t double, failed boolean")
    allowed = [r["allowed"] for r in security.admitted(df, 3, 60.0).orderBy("event_id").collect()]
    assert allowed == [True] * 3 + [False] * 5 + [True] * 3
    states = [r["state"] for r in monitoring.breaker(df).orderBy("event_id").collect()]
    assert states == ["closed"] * 5 + ["open"] * 3 + ["half_open", "half_open", "closed"]


def test_paths(spark):
    p = F.col("p")
    for path, want in (("/b/../x", "leaves its base"), ("/b/etc/x", "forbidden path"), ("/var/log/x", "forbidden path"), ("/c/x", "outside its base"), ("/b/x.py", None)):
        assert one(spark, paths.path_error(p, "/b"), p=path) == want
    assert one(spark, paths.file_type(p), p="a/tests/x.py") == "test" and one(spark, paths.file_type(p), p="a/setup.py") == "config"
    assert one(spark, paths.module(p, F.lit("python")), p="a/b/__init__.py") == "a.b"
    assert one(spark, paths.ignored(p), p="a/node_modules/x.js") and one(spark, paths.ignored(p), p="a/x.pyc") and not one(spark, paths.ignored(p), p="a/dist.py")
    assert len(one(spark, paths.sanitize(p), p="a" * 300 + ".py")) == 200 and one(spark, paths.join_safe("/b", p), p="../x") is None


def test_text(spark):
    t = F.col("t")
    assert one(spark, tx.minify(t), t="  a\n\n# c\n\tb ") == "a\nb"
    assert one(spark, tx.remove_c_comments(t), t="x // y\nhttp://z /* q\n */ w") == "x \nhttp://z  w"
    assert one(spark, tx.python_imports(t), t="import a as b, c\nfrom d.e import f") == ["a", "c", "d.e"]
    assert one(spark, tx.parse_set(t), t="{'a', 'b'}") == ["a", "b"] and one(spark, tx.parse_set(t), t="set()") == []


def test_codecs():
    data = b"abc" * 1000
    for codec in ("zstd", "zlib", "bzip2", "none"):
        assert adaptive.unpack(adaptive.pack(data, codec, 5), codec) == data
    a = adaptive.analyse(b"\0" * 100)
    assert a["entropy"] == 0 and a["binary"] and adaptive.analyse(b"")["top"] == {}


def test_tree(spark):
    f = spark.createDataFrame([("a/b/x",), ("a/c",)], "path string")
    lines = [r["line"] for r in codemap.tree_text(f).orderBy("path").collect()]
    assert lines == ["└── a", "    ├── b", "    │   └── x", "    └── c"]


def test_config():
    for bad in ({"hop_bytes": 2 << 20}, {"level": 99}, {"strategy": "x"}, {"max_files": 0}):
        with pytest.raises(ValueError):
            config.Config(**bad)
    assert config.for_query(config.PRESETS["large"], min_complexity=15).strategy == "full"
    assert config.auto(200_000, 0) == config.PRESETS["large"] and config.auto(20_000, 0) == config.PRESETS["real_time"] and config.auto(100, 2 << 20) == config.PRESETS["high_quality"] and all(c.spark() for c in config.PRESETS.values())


def test_file_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.py").write_text("hidden = 1")
    (tmp_path / "main.py").write_text("import os, sys\n\n\ndef main():\n    pass\n")
    (tmp_path / "utils.js").write_text("const fs = require('fs')\nfunction readFile(x) { return x }\n")
    (tmp_path / "src" / "helper.py").write_bytes(b"x = 1 # caf\xff\n")
    (tmp_path / "data.exe").write_bytes(b"\0")
    files = {r["relative_path"]: r for r in corpus(spark, str(tmp_path)).collect()}
    assert sorted(files) == ["main.py", "src/helper.py", "utils.js"]
    assert files["main.py"]["imports"] == ["os", "sys"] and files["src/helper.py"]["module_path"] == "src.helper"
    out = compress_codebase(spark, str(tmp_path), query={"language": "python"}).collect()
    assert sum(r["path"] is not None for r in out) == 2 and any("main" in r["rendered"] for r in out if r["path"])
    assert [(r["chunk"], r["position"]) for r in out if r["path"] is None] == [(0, 0)]
    with pytest.raises(src.LimitExceeded):
        src.guard(src.scan(spark, str(tmp_path)), most_files=1)
    assert src.fallback_listing(spark, str(tmp_path)).count() == 2
    assert src.read_snapshot(spark, str(tmp_path / "none")).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, "b"), (0, 0, "a"), (1, 0, "c")], "chunk int, position int, rendered string")
    src.write_chunks(rows, str(tmp_path / "chunks"))
    assert (next((tmp_path / "chunks" / "chunk=0000").glob("*.txt"))).read_text() == "a\nb\n"
    src.append_log(rows, str(tmp_path / "log"))
    src.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_intake(spark, tmp_path):
    root, snap = tmp_path / "in", str(tmp_path / "snap")
    root.mkdir()
    (root / "a.txt").write_text("1")
    for k in range(2):
        jobs.intake(jobs.file_stream(spark, str(root)), snap, str(tmp_path / "cp")).awaitTermination()
        assert jobs.latest_snapshot(spark, snap).count() == k + 1
        (root / "b.txt").write_text("2")
