"""Queries of the scalar operators, filters and projection levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import paths, text as tx
from lodestone.operators import adaptive, store
from lodestone.plans import bindings as b
from lodestone.sources import files as src

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("content_hash_dups", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    g = b.files(spark, d).groupBy(tx.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return g.where("n > 1")


@query("file_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def _(spark, d):
    return b.files(spark, d).select("doc_id", tx.window_hash(F.col("text")).alias("md5"), F.sha1("text").alias("sha1"))


@query("language_detect", f"""WITH {b.FILES} SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'json' WHEN 3 THEN 'markdown'
  WHEN 4 THEN 'go' WHEN 5 THEN 'rust' WHEN 6 THEN 'python' ELSE 'typescript' END AS language FROM files""")
def _(spark, d):
    return b.files(spark, d).select("doc_id", paths.language(F.col("path")).alias("language"))


@query("module_paths", f"""WITH {b.FILES}, r AS (SELECT doc_id, regexp_replace(path, '^src1/', '') AS rel FROM files)
SELECT doc_id, rel AS relative_path, CASE WHEN rel LIKE '%.py' THEN regexp_replace(replace(regexp_replace(rel, '\\.py$', ''), '/', '.'), '(^|\\.)__init__$', '') ELSE rel END AS module_path FROM r""")
def _(spark, d):
    f = b.files(spark, d).withColumn("rel", paths.relative(F.col("path"), "src1"))
    return f.select("doc_id", F.col("rel").alias("relative_path"), paths.module(F.col("rel"), paths.language(F.col("path"))).alias("module_path"))


def _named(spark, d):
    names = F.array(*[F.lit(k[0]) for k in b.KINDS])
    path = F.concat_ws("/", F.lit("src"), F.col("doc_id").cast("string"), F.element_at(names, (F.col("doc_id") % len(b.KINDS) + 1).cast("int")))
    return b.files(spark, d).withColumn("path", path)


_KINDS = ", ".join(f"({i}, '{k}', '{p}', '{x}')" for i, (_, k, p, x) in enumerate(b.KINDS))


@query("file_types", f"""SELECT doc_id, file_type, parser_type, strategy FROM documents JOIN (VALUES {_KINDS}) k(i, file_type, parser_type, strategy) ON i = doc_id % {len(b.KINDS)}""")
def _(spark, d):
    p = F.col("path")
    return _named(spark, d).select("doc_id", paths.file_type(p).alias("file_type"), paths.parser_file_type(p, paths.language(p)).alias("parser_type"), paths.profile(p)["strategy"].alias("strategy"))


@query("allowed_files", """SELECT doc_id, CASE WHEN length(text) * (CASE doc_id % 4 WHEN 0 THEN 1000000 ELSE 1 END) > 104857600 THEN 'too large' WHEN doc_id % 6 IN (1, 5) THEN 'forbidden extension'
  WHEN doc_id % 6 IN (2, 3) THEN 'extension not allowed' END AS error, doc_id % 6 IN (0, 4) AS allowed FROM documents""")
def _(spark, d):
    ext = F.element_at(F.array(*map(F.lit, [".py", ".exe", ".bin", "", ".MD", ".so"])), (F.col("doc_id") % 6 + 1).cast("int"))
    path, size = F.concat(F.lit("a/x"), ext), F.col("size") * F.when(F.col("doc_id") % 4 == 0, 1000000).otherwise(1)
    return b.files(spark, d).select("doc_id", paths.file_error(path, size).alias("error"), paths.allowed(path).alias("allowed"))


@query("ignore_patterns", f"WITH {b.FILES} SELECT doc_id, path FROM files WHERE NOT (path LIKE '%.md' OR list_contains(string_split(path, '/')[:-2], 'de') OR contains(path, 'src1/'))")
def _(spark, d):
    return b.files(spark, d).where(~paths.ignored(F.col("path"), ["*.md", "de", "src1/"])).select("doc_id", "path")


@query("path_checks", """SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'leaves its base' WHEN 2 THEN 'outside its base' WHEN 3 THEN 'forbidden path' WHEN 4 THEN 'too deep'
  WHEN 5 THEN 'forbidden path' WHEN 6 THEN 'null byte' END AS error FROM documents""")
def _(spark, d):
    made = ["base/x", "base/../x", "other/x", "base/etc/x", "base/" + "d/" * 20 + "x", "/var/log/x", "base/\0x"]
    p = F.concat(F.element_at(F.array(*map(F.lit, made)), (F.col("doc_id") % 7 + 1).cast("int")), F.col("doc_id").cast("string"))
    return b.files(spark, d).select("doc_id", paths.path_error(p, "base").alias("error"))


@query("safe_names", f"""WITH n AS (SELECT p_partkey, p_name AS name FROM part)
SELECT p_partkey, regexp_matches(name, '^[a-zA-Z0-9._-]+$') AND length(name) <= 255 AND NOT starts_with(name, '.') AS safe,
  regexp_replace(name, '[^a-zA-Z0-9._-]', '_', 'g') AS clean, 'base/' || name AS joined FROM n""")
def _(spark, d):
    n = F.col("p_name")
    return b.table(spark, d, "part").select("p_partkey", paths.safe_name(n).alias("safe"), paths.sanitize(n).alias("clean"), paths.join_safe("base", n).alias("joined"))


@query("token_counts", rf"SELECT doc_id, len(regexp_extract_all(text, '{b.TOKEN_SQL}'))::BIGINT AS tokens FROM documents")
def _(spark, d):
    return b.files(spark, d).select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"))


@query("basic_tokens", rf"""WITH l AS (SELECT doc_id, i, unnest(regexp_extract_all(trim(line), '"[^"]*"|''[^'']*''|{b.TOKEN_SQL}')) AS token
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
SELECT doc_id, count(*) AS n, count(DISTINCT token) AS distinct_tokens FROM l GROUP BY doc_id""")
def _(spark, d):
    t = b.files(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


@query("basic_complexity", f"SELECT doc_id, {b.COMPLEXITY_SQL} AS complexity FROM documents")
def _(spark, d):
    return b.files(spark, d).select("doc_id", tx.basic_complexity(F.col("text")).alias("complexity"))


def _n(*patterns):
    return " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in patterns)


_JS = _n(r"\bif\b", r"\belse\s+if\b", r"\bwhile\b", r"\bfor\b", r"\bcase\b", r"\bcatch\b", r"\?\s*[^:]+\s*:", "&&", r"\|\|")


@query("language_complexity", rf"""WITH {b.CODE} SELECT doc_id, (1 + {_n(r"\bif\b", r"\bfor\b", r"\bswitch\b", r"\bselect\b")})::DOUBLE AS go, (1 + {_JS})::DOUBLE AS js,
  (1 + {_n(r"\bif\b", r"\bmatch\b", r"\bfor\b", r"\bwhile\b", r"\bloop\b")})::DOUBLE AS rust FROM (SELECT doc_id, text || ' switch (x) ? y : z select case loop match && ||' AS text FROM code)""")
def _(spark, d):
    t = F.concat("text", F.lit(" switch (x) ? y : z select case loop match && ||"))
    c = b.once(b.code(spark, d), t=t)
    return c.select("doc_id", *[tx.language_complexity(F.col("t"), k).alias(n) for k, n in (("go", "go"), ("javascript", "js"), ("rust", "rust"))])


_S = r"""'[^']*'|"[^"]*"|`[^`]*`""".replace("'", "''")
_OPS = rf"[=<>!+\-*/&|^~%]+|[(){{}}[\];,.:]"
_BARE = {"javascript": r"regexp_replace(text, '(?m)(^|[^:])//.*$', '\1', 'g')", "typescript": r"regexp_replace(text, '(?m)(^|[^:])//.*$', '\1', 'g')", "go": "regexp_replace(text, '(?m)//.*$', '', 'g')", "rust": "regexp_replace(text, '(?m)//.*$', '', 'g')"}
_TOKENS = {
    "javascript": rf"{b._W}+|=>|\.\.\.|\?\.|\?\?|{_OPS}|{_S}", "typescript": rf"{b._W}+|<[^>]+>|\?\.|\?\?|=>|\.\.\.|{_OPS}|@{b._W}+|{_S}",
    "go": rf"{b._W}+|<-|:=|\.\.\.|{_OPS}|{_S}", "rust": rf"{b._W}+|::|->|=>|\?|\.\.|&mut|&|''{b._W}+|{_OPS}",
}
_TOKENISED = "x := a?.b ?? 'it' <- `q` // gone\nuse a::b; let s: Vec<u8> = |x| -> &mut 'a [..]; @dec /* no\n */ => ...\n"


@query("language_tokens", f"""WITH d AS (SELECT doc_id, '{_TOKENISED.replace("'", "''").replace(chr(10), "' || chr(10) || '")}' || text AS text FROM documents)
SELECT doc_id, {", ".join(f"list_aggregate(regexp_extract_all(regexp_replace({_BARE[k]}, '(?s)/\\*.*?\\*/', '', 'g'), '{p}'), 'string_agg', chr(31)) AS {k}" for k, p in _TOKENS.items())} FROM d""")
def _(spark, d):
    t = F.concat(F.lit(_TOKENISED), "text")
    return b.files(spark, d).select("doc_id", *[F.array_join(tx.language_tokens(t, k), "\x1f").alias(k) for k in _TOKENS])


@query("token_estimates", r"SELECT doc_id, greatest(1, floor(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE)::BIGINT) AS tokens FROM documents")
def _(spark, d):
    return b.files(spark, d).select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query("context_usage", rf"""WITH {b.MEASURED} SELECT doc_id, token_count * 100.0::DOUBLE / 512 AS percent, token_count <= 512 AS fits, greatest(1, (token_count + 511) // 512)::BIGINT AS chunks FROM measured""")
def _(spark, d):
    return b.measured(spark, d).select("doc_id", tx.context_usage(F.col("token_count"), 512).alias("u")).select("doc_id", "u.*")


@query("compression_ratios", r"""SELECT doc_id, CASE WHEN k > 0 THEN n::DOUBLE / k WHEN n > 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE END AS ratio,
  CASE WHEN n < 1024 THEN 0 ELSE 9 END AS level FROM (SELECT doc_id, length(text) AS n, length(text) - len(string_split(text, chr(10))) AS k FROM documents)""")
def _(spark, d):
    f = b.files(spark, d).withColumn("k", F.col("size") - F.size(tx.lines(F.col("text"))))
    return f.select("doc_id", tx.compression_ratio(F.col("size").cast("double"), F.col("k")).alias("ratio"), tx.compression_level(F.col("size")).alias("level"))


@query("minified", f"""WITH {b.CODE}, l AS (SELECT doc_id, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM code))
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS content FROM l WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY doc_id""")
def _(spark, d):
    return b.code(spark, d).select("doc_id", F.md5(tx.minify(F.col("text"))).alias("content"))


@query("signatures", rf"""WITH {b.CODE} SELECT doc_id,
  CASE language WHEN 'python' THEN [rtrim(x, ':') FOR x IN regexp_extract_all(text, 'def\s+\w+\s*\([^)]*\)(?:\s*->\s*[^:]+)?:')]
    WHEN 'javascript' THEN regexp_extract_all(text, 'function\s+(\w+)\s*\([^)]*\)', 1) || regexp_extract_all(text, '(?:let|var|const)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=]+)\s*=>', 1) ELSE [] END AS functions,
  CASE language WHEN 'python' THEN [rtrim(x, ':') FOR x IN regexp_extract_all(text, 'class\s+\w+(?:\([^)]*\))?:')]
    WHEN 'javascript' THEN regexp_extract_all(text, 'class\s+(\w+)(?:\s+extends\s+\w+)?', 1) ELSE [] END AS classes FROM code""")
def _(spark, d):
    t, lang = F.col("text"), F.col("language")
    return b.code(spark, d).select("doc_id", tx.function_signatures(t, lang).alias("functions"), tx.class_signatures(t, lang).alias("classes"))


@query("constants", rf"""WITH {b.CODE} SELECT doc_id, (regexp_extract_all(text, '(?:final|static\s+final|const)\s+\w+\s*=') || regexp_extract_all(text, '[A-Z_]+\s*=\s*[''"\d]'))[1:10] AS constants FROM code""")
def _(spark, d):
    return b.code(spark, d).select("doc_id", tx.constants(F.col("text")).alias("constants"))


@query("named_signatures", rf"""WITH {b.CODE} SELECT doc_id, 'def' AS hint, unnest(regexp_extract_all(text, 'def\s+\w+')) AS signature FROM code
  UNION ALL SELECT doc_id, 'class', unnest(regexp_extract_all(text, 'class\s+\w+')) FROM code""")
def _(spark, d):
    s = tx.named_signatures(F.col("text"), {"def": r"def\s+\w+", "class": r"class\s+\w+"})
    return b.code(spark, d).select("doc_id", F.explode(s).alias("s")).select("doc_id", "s.hint", "s.signature")


_PY_IMPORTS = r"""flatten([CASE WHEN starts_with(s, 'from') THEN [regexp_extract(s, '^from\s+(\S+)', 1)]
  ELSE [regexp_extract(n, '^\s*(\S*)', 1) FOR n IN string_split(regexp_replace(s, '^import\s+', ''), ',')] END
  FOR s IN regexp_extract_all(text, '(?m)^\s*((?:from\s+\S+\s+)?import\s+.+)$', 1)])"""


@query("python_imports", f"WITH {b.CODE} SELECT doc_id, {_PY_IMPORTS} AS imports FROM code")
def _(spark, d):
    return b.code(spark, d).select("doc_id", tx.python_imports(F.col("text")).alias("imports"))


@query("js_go_rust_imports", rf"""WITH {b.CODE}, more AS (SELECT doc_id, text || chr(10) || 'import "one"' || chr(10) || 'import (' || chr(10) || '  x "two/' || doc_id || '"' || chr(10) || '  "three"' || chr(10) || ')' || chr(10) || 'pub use a::b;' AS text FROM code)
SELECT doc_id, {b.JS_IMPORTS_SQL} AS js, regexp_extract_all(text, 'import\s+"([^"]+)"', 1)
  || flatten([regexp_extract_all(x, '"([^"]+)"', 1) FOR x IN regexp_extract_all(text, 'import\s*\([^)]+\)')]) AS go, regexp_extract_all(text, '(?m)^\s*(?:pub\s+)?use\s+([^;]+);', 1) AS rust FROM more""")
def _(spark, d):
    tail = F.concat(F.lit('\nimport "one"\nimport (\n  x "two/'), F.col("doc_id").cast("string"), F.lit('"\n  "three"\n)\npub use a::b;'))
    t = F.concat("text", tail)
    return b.code(spark, d).select("doc_id", tx.javascript_imports(t).alias("js"), tx.go_imports(t).alias("go"), tx.rust_imports(t).alias("rust"))


@query("comments_removed", r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?m)#.*$', '', 'g'), '(?s)<!--.*?-->', '', 'g')) AS body FROM pages""")
def _(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.md5(tx.remove_comments(F.col("html"), r"#.*$", r"<!--.*?-->")).alias("body"))


@query("c_comments_removed", r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?m)(^|[^:])//.*$', '\1', 'g'), '(?s)/\*.*?\*/', '', 'g')) AS body FROM pages""")
def _(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.md5(tx.remove_c_comments(F.col("html"))).alias("body"))


_SHOWING = ["go run(x)\nch <- 1\n", "func F[T any](x T) {}\n", "unsafe { x }\nasync fn f() {}\nprintln!(1)\n", "@Injectable() class A<T> {}\n", "let v: Vec<String>\n", ""]
_SHOWING_SQL = ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _SHOWING)


def _flags(**patterns):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


_W = b._W
_TS_FLAGS = _flags(generics=rf"<[A-Z]{_W}*(?:\s+extends\s+{_W}+)?>|{_W}+<[^>]+>", decorators=rf"@{_W}+\s*(?:\([^)]*\))?\s*(?:class|function|get|set|method)")
_GO_FLAGS = _flags(goroutines=rf"\bgo\s+{_W}+\s*\(", channels=rf"(?:^|[^{_W[1:-1]}])chan(?:[^{_W[1:-1]}]|$)|<-", generics=rf"\[\s*{_W}+\s+{_W}+(?:\s*,\s*{_W}+\s+{_W}+)*\s*\]")
_RUST_FLAGS = _flags(unsafe=r"\bunsafe\s*\{", **{"async": r"\basync\b|\bawait\b"}, macros=f"{_W}+!", generics=rf"<[^>]*(?:[A-Z]{_W}*|''{_W}+)[^>]*>")


@query("feature_flags", f"""WITH d AS (SELECT doc_id, ([{_SHOWING_SQL}])[doc_id % {len(_SHOWING)} + 1] || text AS text FROM documents)
SELECT doc_id, {_TS_FLAGS} AS typescript, {_GO_FLAGS} AS go, {_RUST_FLAGS} AS rust FROM d""")
def _(spark, d):
    t = F.concat(F.element_at(F.array(*map(F.lit, _SHOWING)), (F.col("doc_id") % len(_SHOWING) + 1).cast("int")), "text")
    f = b.once(b.files(spark, d), t=t)
    return f.select("doc_id", *[tx.features(F.col("t"), k).alias(k) for k in ("typescript", "go", "rust")])


@query("yaml_structure", r"""WITH y AS (SELECT doc_id, 'name: a' || chr(10) || 'db:' || chr(10) || '  host: ${DB_HOST}' || chr(10) || 'note: |' || chr(10) || '  - ' || replace(text, chr(10), chr(10) || repeat(' ', (doc_id % 5)::BIGINT) || '- ') AS text FROM documents)
SELECT doc_id, regexp_extract_all(text, '(?m)^(\w[\w-]*):', 1) AS keys, regexp_extract_all(text, '\$\{(\w+)\}', 1) AS variables,
  1.0::DOUBLE + list_max([length(x) FOR x IN regexp_extract_all(text, '(?m)^( *)\S', 1)]) / 2.0::DOUBLE + len(regexp_extract_all(text, '(?m)^\s*\w[\w-]*:')) * 0.1::DOUBLE
  + len(regexp_extract_all(text, '(?m)^\s*-\s')) * 0.05::DOUBLE + len(regexp_extract_all(text, '(?m):\s*[|>]\s*$')) * 0.5::DOUBLE AS complexity FROM y""")
def _(spark, d):
    item = F.concat(F.lit("\n"), F.repeat(F.lit(" "), (F.col("doc_id") % 5).cast("int")), F.lit("- "))
    y = F.concat(F.lit("name: a\ndb:\n  host: ${DB_HOST}\nnote: |\n  - "), F.replace("text", F.lit("\n"), item))
    return b.files(spark, d).select("doc_id", tx.yaml_structure(y).alias("y")).select("doc_id", "y.*")


@query("set_strings", "SELECT conv_id, turn, regexp_extract_all(text, '[a-z]+') AS members FROM conversations")
def _(spark, d):
    words = F.regexp_extract_all("text", F.lit("[a-z]+"), 0)
    s = F.when(F.size(words) > 0, F.concat(F.lit("{'"), F.array_join(words, "', '"), F.lit("'}"))).otherwise("set()")
    return b.table(spark, d, "conversations").select("conv_id", "turn", tx.parse_set(s).alias("members"))


@query("retry_delays", "SELECT event_id, least(1.0 * pow(2.0, (event_id % 9 + 1) - 1), 60.0)::DOUBLE AS delay, greatest(0.0, 60.0 - value)::DOUBLE AS recovery FROM events")
def _(spark, d):
    return b.table(spark, d, "events").select("event_id", tx.retry_delay(F.col("event_id") % 9 + 1).alias("delay"), tx.time_until_recovery(F.lit(60.0), F.col("value")).alias("recovery"))


_STDLIB = "['collections', 'csv', 'datetime', 'functools', 'io', 'itertools', 'json', 'logging', 'math', 'os', 'pathlib', 're', 'sys', 'time', 'typing']"


@query("dependency_classes", f"""WITH {b.CODE}, i AS (SELECT doc_id, {b.JS_IMPORTS_SQL} || {_PY_IMPORTS} || ['.local', 'json.tool', 'fs.extra', 'x' || (doc_id % 3)] AS imports FROM code)
SELECT doc_id, list_sort(list_distinct([x FOR x IN imports IF NOT (starts_with(x, '.') OR starts_with(x, 'fs')) AND NOT list_contains({_STDLIB}, string_split(x, '.')[1])])) AS external,
  list_sort(list_distinct([x FOR x IN imports IF starts_with(x, '.') OR starts_with(x, 'fs')])) AS internal FROM i""")
def _(spark, d):
    t = F.col("text")
    more = F.array(F.lit(".local"), F.lit("json.tool"), F.lit("fs.extra"), F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string")))
    c = b.code(spark, d).select("doc_id", F.concat(tx.javascript_imports(t), tx.python_imports(t), more).alias("i"))
    return c.select("doc_id", F.array_sort(paths.external(F.col("i"), "fs")).alias("external"), F.array_sort(paths.internal(F.col("i"), "fs")).alias("internal"))


_SUMMARY = "path, 'summary' AS type, language, size, complexity, len(imports) AS imports_count, len(exports) AS exports_count, len(functions) AS functions_count, len(classes) AS classes_count"


@query("select_by_query", f"WITH {b.CODED} SELECT {_SUMMARY} FROM coded WHERE language = 'javascript' AND complexity >= 2 AND size <= 5000 AND token_count >= 50")
def _(spark, d):
    return store.compress_by_query(b.coded(spark, d, filtered=True), "summary", language="javascript", min_complexity=2, max_size=5000, min_tokens=50)


@query("select_by_symbol", f"WITH {b.CODED} SELECT {_SUMMARY} FROM coded WHERE list_contains(imports, 'fs') AND list_contains(exports, 'Cat') AND list_contains(functions, 'run') AND list_contains(classes, 'Cat')")
def _(spark, d):
    return store.compress_by_query(b.coded(spark, d, filtered=True), "summary", imports="fs", exports="Cat", function="run", **{"class": "Cat"})


@query("strategy_full", f"""WITH {b.FILES}, l AS (SELECT path, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM
  (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM files)),
c AS (SELECT path, string_agg(line, chr(10) ORDER BY i) AS content FROM l WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY path)
SELECT path, 'full' AS type, coalesce(content, '') AS content, language, size FROM files LEFT JOIN c USING (path)""")
def _(spark, d):
    return store.full(b.files(spark, d)).select("path", "type", "content", "metadata.language", "metadata.size")


_SIGNED = SQL["signatures"].rpartition("SELECT doc_id,")[2].rpartition(" FROM code")[0]
_CONSTANTS = SQL["constants"].rpartition("SELECT doc_id, ")[2].partition(" AS constants")[0]
#: The structural projection of code, with what is known of its files.
STRUCTURAL = f"{b.CODED}, s AS (SELECT path, {_SIGNED} FROM code), structural AS (SELECT c.* EXCLUDE (functions, classes), s.functions, s.classes, {_CONSTANTS} AS constants FROM coded c JOIN s USING (path))"


@query("strategy_structural", f"WITH {STRUCTURAL} SELECT path, 'structural' AS type, imports, exports, functions, classes, constants, language, complexity FROM structural")
def _(spark, d):
    out = store.structural(b.coded(spark, d))
    return out.select("path", "type", "imports", "exports", "functions", "classes", "constants", "metadata.language", "metadata.complexity")


@query("strategy_signature", f"WITH {b.CODE} SELECT path, 'signature' AS type, {_SIGNED} FROM code")
def _(spark, d):
    return store.signature(b.code(spark, d)).drop("metadata")


_PROFILES = "('python', 'zstd', 6), ('javascript', 'zlib', 5), ('typescript', 'zlib', 5), ('go', 'zstd', 5), ('rust', 'zstd', 5), ('json', 'zstd', 9), ('markdown', 'zlib', 6), ('xml', 'bzip2', 9)"


@query("codec_choice", f"""WITH k AS (SELECT doc_id, load, CASE WHEN doc_id % 9 = 0 THEN 'cobol' WHEN doc_id % 9 = 1 THEN 'xml' ELSE (['python', 'javascript', 'json', 'markdown', 'go', 'rust', 'python', 'typescript'])[doc_id % 8 + 1] END AS kind,
    (doc_id % 11) / 10.0::DOUBLE AS c, doc_id % 13 = 0 AS done, length(text) * (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 20 ELSE 100000 END) AS size FROM documents, (VALUES (0.1::DOUBLE), (0.5), (0.9)) l(load)),
b AS (SELECT k.*, coalesce(codec, 'lz4') AS codec, coalesce(level, 3) AS level FROM k LEFT JOIN (VALUES {_PROFILES}) p(kind, codec, level) USING (kind)),
x AS (SELECT * REPLACE (CASE WHEN c > 0.7 AND codec = 'lz4' THEN 'zstd' WHEN c < 0.3 THEN 'lz4' ELSE codec END AS codec, CASE WHEN c > 0.7 THEN least(level + 2, 9) WHEN c < 0.3 THEN greatest(level - 2, 1) ELSE level END AS level) FROM b),
y AS (SELECT * REPLACE (CASE WHEN size > 10485760 AND codec IN ('bzip2', 'brotli') THEN 'zstd' ELSE codec END AS codec, CASE WHEN size > 10485760 THEN greatest(level - 1, 1) WHEN size < 10240 THEN least(level + 1, 9) ELSE level END AS level) FROM x)
SELECT doc_id, load, CASE WHEN done THEN 'none' WHEN load > 0.8 THEN 'lz4' WHEN load < 0.3 AND codec = 'lz4' THEN 'zstd' ELSE codec END AS codec,
  CASE WHEN done THEN 0 WHEN load > 0.8 THEN 1 WHEN load < 0.3 THEN least(level + 1, 9) ELSE level END AS level FROM y""")
def _(spark, d):
    n = F.col("doc_id")
    kind = F.when(n % 9 == 0, "cobol").when(n % 9 == 1, "xml").otherwise(paths.language(F.col("path")))
    size = F.col("size") * F.when(n % 3 == 0, 1).when(n % 3 == 1, 20).otherwise(100000)
    f = b.files(spark, d).withColumn("load", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))))
    c = adaptive.choose(kind, (n % 11) / F.lit(10.0), n % 13 == 0, size, F.col("load"))
    return f.select("doc_id", "load", c["codec"].alias("codec"), c["level"].alias("level"))


@query("byte_analysis", """WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text <> ''),
s AS (SELECT doc_id, CASE WHEN length(x) <= 16384 THEN x ELSE substr(x, 1, 5460) || substr(x, 2 * (length(x) // 4 - 1365) + 1, 5460) || right(x, 5460) END AS x FROM h),
c AS (SELECT doc_id, v, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(x, '..')) AS v FROM s) GROUP BY ALL),
e AS (SELECT doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS entropy, 1 - count(*) / 256.0::DOUBLE AS structure,
  coalesce(sum(k) FILTER (WHERE v = '00'), 0) > sum(k) * 0.01 OR coalesce(sum(k) FILTER (WHERE v BETWEEN '20' AND '7E'), 0) < sum(k) * 0.75 AS "binary" FROM c GROUP BY 1),
p AS (SELECT doc_id, 1 - count(DISTINCT piece) / count(*)::DOUBLE AS repetition FROM (SELECT doc_id, substr(x, 2 * i::BIGINT + 1, 32) AS piece FROM s, generate_series(0, length(x) // 2 - 17, 16) g(i)) GROUP BY 1)
SELECT doc_id, round(entropy, 6) AS entropy, entropy / 8 > 0.95 AS likely_compressed, round(coalesce(repetition, 0), 6) AS repetition, structure, "binary",
  round((1 - entropy / 8) * 0.4::DOUBLE + coalesce(repetition, 0) * 0.3::DOUBLE + structure * 0.3::DOUBLE, 6) AS compressibility FROM e LEFT JOIN p USING (doc_id)""")
def _(spark, d):
    a = b.files(spark, d).where("text <> ''").select("doc_id", adaptive.analysis(F.col("text")).alias("a")).select("doc_id", "a.*").drop("top")
    return a.withColumns({k: F.round(k, 6) for k in ("entropy", "repetition", "compressibility")})


_CODECS = ["zstd", "zlib", "bzip2", "none", "lz4"]


@query("codec_round_trip", "SELECT doc_id, md5(text) AS body, octet_length(encode(text)) AS size FROM documents")
def _(spark, d):
    f = b.files(spark, d).withColumn("codec", F.element_at(F.array(*map(F.lit, _CODECS)), (F.col("doc_id") % len(_CODECS) + 1).cast("int")))
    back = f.withColumn("data", adaptive.compress("text", "codec", F.lit(5))).withColumn("back", adaptive.decompress("data", "codec"))
    return back.select("doc_id", F.md5("back").alias("body"), F.octet_length("back").cast("long").alias("size"))


@query("compressed_files", """SELECT source || '/' || lang || '/' || doc_id || ['.py', '.js', '.json', '.md', '.go', '.rs', '/__init__.py', '.ts'][doc_id % 8 + 1] AS path, octet_length(encode(text)) AS size, md5(text) AS body FROM documents""")
def _(spark, d):
    c = adaptive.compress_files(b.files(spark, d).withColumn("language", paths.language(F.col("path"))))
    return c.select("path", "size", F.md5(adaptive.decompress("data", "codec")).alias("body"))


@query("checksummed_json", """WITH j AS (SELECT doc_id, json_object('doc_id', doc_id, 'lang', lang, 'size', length(text))::VARCHAR AS j FROM documents)
SELECT doc_id, j AS json, sha256(j) AS checksum FROM j WHERE doc_id % 7 <> 0""")
def _(spark, d):
    c = src.checksummed(b.files(spark, d).select("doc_id", F.col("language").alias("lang"), "size"), ["doc_id", "lang", "size"])
    spoilt = c.withColumn("json", F.when(F.col("doc_id") % 7 == 0, F.concat("json", F.lit(" "))).otherwise(F.col("json")))
    return src.verified(spoilt).select("doc_id", "json", "checksum")


@query("text_entropy", """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL)
SELECT doc_id, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS entropy FROM n GROUP BY doc_id""")
def _(spark, d):
    e = adaptive.text_entropy(b.files(spark, d))
    return e.select("doc_id", F.round("entropy", 6).alias("entropy"))


@query("byte_frequencies", "WITH v AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) SELECT ('0x' || h)::INT AS byte, count(*) AS n FROM v GROUP BY 1 ORDER BY n DESC, byte LIMIT 10")
def _(spark, d):
    return adaptive.byte_frequencies(b.files(spark, d))


@query("safe_json_depth", "SELECT event_id, event_id % 130 + 1 <= 100 AS taken FROM events")
def _(spark, d):
    from lodestone.operators.security import safe_json

    k = (F.col("event_id") % 130 + 1).cast("int")
    nested = F.concat(F.repeat(F.lit('{"a": '), k), F.lit('"}]{["'), F.repeat(F.lit("}"), k))
    return b.table(spark, d, "events").select("event_id", safe_json(nested, "a string").isNotNull().alias("taken"))


@query("safe_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(spark, d):
    from lodestone.operators.security import safe_json

    return b.table(spark, d, "events").select("event_id", safe_json(F.col("props"), "k long")["k"].alias("k"))
