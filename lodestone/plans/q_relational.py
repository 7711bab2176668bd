"""Queries of aggregates, joins, windows, set operations, incremental and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import paths, text as tx
from lodestone.operators import adaptive, chunking, codemap, incremental, monitoring, store
from lodestone.operators.graph import connected_components
from lodestone.plans import bindings as b
from lodestone.sources.files import spread

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("corpus_totals", f"WITH {b.MEASURED} SELECT count(*) AS files, sum(size)::BIGINT AS size, sum(token_count)::BIGINT AS tokens FROM measured")
def _(spark, d):
    return codemap.totals(b.measured(spark, d))


def _typed(spark, d):
    f = b.measured(spark, d)
    return f.withColumn("file_type", paths.file_type(F.col("path")))


_TYPED = f"{b.MEASURED}, typed AS (SELECT *, CASE WHEN doc_id % 8 = 6 THEN 'init' ELSE 'source' END AS file_type FROM measured)"


@query("language_counts", f"WITH {_TYPED} SELECT 'language' AS kind, language AS value, count(*) AS n FROM typed GROUP BY language UNION ALL SELECT 'file_type', file_type, count(*) FROM typed GROUP BY file_type")
def _(spark, d):
    return codemap.counts(_typed(spark, d))


@query("complexity_stats", f"WITH {b.MEASURED} SELECT coalesce(avg(complexity) FILTER (WHERE complexity > 0), 0) AS average, coalesce(max(complexity), 0) AS maximum FROM measured")
def _(spark, d):
    return codemap.complexity_stats(b.measured(spark, d))


@query("complexity_histogram", f"""WITH {b.MEASURED}, b(b, bin) AS (VALUES (0, '0-5'), (1, '5-10'), (2, '10-20'), (3, '20-50'), (4, '50+')),
n AS (SELECT CASE WHEN c < 5 THEN 0 WHEN c < 10 THEN 1 WHEN c < 20 THEN 2 WHEN c < 50 THEN 3 ELSE 4 END AS b, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 0 ELSE complexity * (1 + doc_id % 12) END AS c FROM measured) WHERE c > 0 GROUP BY 1)
SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN n USING (b)""")
def _(spark, d):
    c = F.when(F.col("doc_id") % 9 == 0, 0.0).otherwise(F.col("complexity") * (1 + F.col("doc_id") % 12))
    return codemap.complexity_histogram(b.measured(spark, d).withColumn("complexity", c))


@query("largest_and_most_complex", f"""WITH {b.MEASURED}, r AS (
  SELECT 'largest' AS kind, row_number() OVER (ORDER BY size DESC, path) AS rank, path, size::DOUBLE AS value FROM measured
  UNION ALL SELECT 'most_complex', row_number() OVER (ORDER BY complexity DESC, path), path, complexity FROM measured)
SELECT * FROM r WHERE rank <= 5""")
def _(spark, d):
    return codemap.extremes(b.measured(spark, d))


@query("store_statistics", f"""WITH {b.CODED} SELECT count(*) AS files, sum(size)::BIGINT AS size, avg(size) AS avg_size, avg(complexity) AS avg_complexity, avg(token_count) AS avg_tokens, count(DISTINCT language) AS languages,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(imports) AS x FROM coded)) AS unique_imports, (SELECT count(DISTINCT x) FROM (SELECT unnest(exports) AS x FROM coded)) AS unique_exports,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(functions) AS x FROM coded)) AS unique_functions, (SELECT count(DISTINCT x) FROM (SELECT unnest(classes) AS x FROM coded)) AS unique_classes FROM coded""")
def _(spark, d):
    return store.statistics(b.coded(spark, d))


@query("token_batch", r"""WITH t AS (SELECT greatest(1, floor(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE)::BIGINT) AS t, len(regexp_extract_all(text, '\S+')) AS w, length(text) AS n FROM documents)
SELECT sum(t)::BIGINT AS tokens, sum(w)::BIGINT AS words, sum(n)::BIGINT AS chars, count(*) AS texts, sum(t)::DOUBLE / count(*) AS average FROM t""")
def _(spark, d):
    return tx.token_statistics(b.files(spark, d))


@query("percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1")
def _(spark, d):
    return monitoring.percentiles(b.table(spark, d, "events"), ["event_type"])


@query("batch_size", "SELECT event_type, greatest(1, least(1000, floor(1e6::DOUBLE * 0.5::DOUBLE / (avg(value) * 2))))::BIGINT AS batch FROM events GROUP BY 1")
def _(spark, d):
    return monitoring.batch_size(b.table(spark, d, "events"), ["event_type"], 1e6)


@query("dependency_counts", f"""WITH {b.DEPS} SELECT (SELECT count(DISTINCT symbol) FROM exp) AS internal, (SELECT count(DISTINCT symbol) FROM imp) AS external""")
def _(spark, d):
    x = b.deps(spark, d).select(F.col("exports").alias("internal_dependencies"), F.col("imports").alias("external_dependencies"))
    return codemap.distinct_dependencies(x)


@query("top_imports", f"WITH {b.DEPS} SELECT symbol AS \"import\", count(*) AS n FROM imp GROUP BY 1 ORDER BY n DESC, symbol LIMIT 10")
def _(spark, d):
    return codemap.top_imports(b.deps(spark, d))


@query("symbol_index", f"WITH {b.DEPS} SELECT kind, symbol, count(*) AS n FROM (SELECT 'import' AS kind, symbol FROM imp UNION ALL SELECT 'export', symbol FROM exp) GROUP BY ALL")
def _(spark, d):
    return store.symbols(b.deps(spark, d)).groupBy("kind", "symbol").agg(F.count("*").alias("n"))


@query("index_probe", f"WITH {b.DEPS} SELECT DISTINCT path FROM imp WHERE symbol = '300'")
def _(spark, d):
    f = b.deps(spark, d)
    return store.probe(f, store.symbols(f), "import", "300").select("path")


@query("import_edges", f"""WITH {b.DEPS}, o AS (SELECT symbol, max(path) AS dst FROM exp GROUP BY 1)
SELECT DISTINCT imp.path AS src, dst FROM imp JOIN o USING (symbol) WHERE imp.path <> dst""")
def _(spark, d):
    return codemap.export_edges(b.deps(spark, d))


@query("components", f"""WITH RECURSIVE {b.DEPS}, o AS (SELECT symbol, max(path) AS dst FROM exp GROUP BY 1),
e AS (SELECT DISTINCT imp.path AS a, dst AS b FROM imp JOIN o USING (symbol) WHERE imp.path <> dst),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, lab) AS (SELECT a, a FROM u UNION SELECT u.b, r.lab FROM r JOIN u ON u.a = r.node)
SELECT node, min(lab) AS component FROM r GROUP BY node""")
def _(spark, d):
    f = b.deps(spark, d)
    return connected_components(spark, codemap.export_edges(f).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("top_importers", f"""WITH {b.DEPS}, o AS (SELECT symbol, max(path) AS dst FROM exp GROUP BY 1),
e AS (SELECT DISTINCT imp.path AS src, dst FROM imp JOIN o USING (symbol) WHERE imp.path <> dst),
g AS (SELECT src, list(dst ORDER BY dst) AS t FROM e GROUP BY 1)
SELECT src, t[1:3] AS targets, greatest(len(t) - 3, 0)::INT AS more FROM g ORDER BY len(t) DESC, src LIMIT 10""")
def _(spark, d):
    return codemap.top_importers(codemap.export_edges(b.deps(spark, d)))


def _named(spark, d):
    """Parts as files: path from brand, name and key; a part imports its key, which is in its own path, and a key below 50 after its name, which others' begin with."""
    p = spread(b.table(spark, d, "part"))
    return p.select(
        F.concat_ws("/", "p_brand", F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".py"))).alias("path"),
        F.array(F.concat(F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".")), F.concat(F.translate("p_name", " ", "_"), F.lit("_"), (F.col("p_partkey") % 50).cast("string"))).alias("imports"),
    )


@query("dependency_edges", """WITH f AS (SELECT p_brand || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.py' AS path,
  ['_' || p_partkey || '.', replace(p_name, ' ', '_') || '_' || (p_partkey % 50)] AS imports FROM part),
dep AS (SELECT path AS src, unnest(imports) AS dep FROM f)
SELECT DISTINCT src, f.path AS dst FROM dep JOIN f ON contains(f.path, dep)""")
def _(spark, d):
    return codemap.dependency_edges(_named(spark, d))


@query("import_matrix", """WITH n AS (SELECT n_name || '.py' AS path, n_name AS stem, n_nationkey AS k FROM nation), f AS (SELECT path, stem, (SELECT m.stem FROM n m WHERE m.k = (n.k + 1) % 25) AS dep FROM n)
SELECT a.path AS src, x.path AS dst, contains(x.path, a.dep) AS imports, (SELECT count(*) FROM f a, f x WHERE contains(x.path, a.dep)) AS total FROM f a, f x""")
def _(spark, d):
    return codemap.import_matrix(_import_files(spark, d))


def _import_files(spark, d):
    n = b.table(spark, d, "nation")
    nxt = n.select(((F.col("n_nationkey") + 24) % 25).alias("k"), F.array("n_name").alias("imports"))
    return n.join(F.broadcast(nxt), n["n_nationkey"] == nxt["k"]).select(F.concat("n_name", F.lit(".py")).alias("path"), "imports")


@query("import_counts", """WITH n AS (SELECT n_name || '.py' AS path, n_name AS stem, n_nationkey AS k FROM nation), f AS (SELECT path, stem, (SELECT m.stem FROM n m WHERE m.k = (n.k + 1) % 25) AS dep FROM n),
e AS (SELECT a.path AS src, x.path AS dst FROM f a JOIN f x ON contains(x.path, a.dep)), o AS (SELECT src AS path, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS path, count(*) AS n FROM e GROUP BY 1)
SELECT coalesce(o.path, i.path) AS path, coalesce(o.n, 0) AS imports, coalesce(i.n, 0) AS imported_by FROM o FULL JOIN i ON o.path = i.path""")
def _(spark, d):
    return codemap.import_counts(_import_files(spark, d))


@query("module_clusters", f"""WITH {b.FILES}, m AS (SELECT path, CASE WHEN doc_id % 8 IN (0, 6) THEN regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '(^|\\.)__init__$', '') ELSE path END AS module FROM files)
SELECT regexp_extract(module, '^(.+)\\.[^.]*$', 1) AS module, count(*) AS n, list(path ORDER BY path) AS paths FROM m WHERE contains(module, '.') GROUP BY 1""")
def _(spark, d):
    f = b.files(spark, d)
    return codemap.module_clusters(f.withColumn("module_path", paths.module(F.col("path"), paths.language(F.col("path")))))


@query("directory_tree", f"""WITH {b.FILES}, n AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS path, array_to_string(p[1:k - 1], '/') AS parent, p[k] AS name, k::INT AS depth
  FROM (SELECT string_split(path, '/') AS p FROM files), generate_series(1, len(p)) g(k))
SELECT *, lead(name) OVER (PARTITION BY parent ORDER BY name) IS NULL AS is_last FROM n""")
def _(spark, d):
    return codemap.tree(b.files(spark, d))


def _snapshots(spark, d):
    now = b.files(spark, d).select("path", tx.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    old = now.where("doc_id % 10 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("content_hash")))
    gone = now.where("doc_id % 50 = 3").select(F.concat(F.lit("gone/"), "path").alias("path"), "content_hash")
    return now.select("path", "content_hash"), old.select("path", "content_hash").unionByName(gone)


_SNAP = f"""{b.FILES}, now AS (SELECT path, sha256(text) AS h, doc_id FROM files),
before AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE h END AS h FROM now WHERE doc_id % 10 <> 0 UNION ALL SELECT 'gone/' || path, h FROM now WHERE doc_id % 50 = 3)"""


@query("change_detection", f"""WITH {_SNAP} SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.h <> o.h THEN 'modified' ELSE 'unchanged' END AS change
FROM now n FULL JOIN before o ON n.path = o.path""")
def _(spark, d):
    return incremental.diff(*_snapshots(spark, d))


@query("to_parse", f"WITH {_SNAP} SELECT n.path FROM now n LEFT JOIN before o USING (path) WHERE o.path IS NULL OR o.h <> n.h")
def _(spark, d):
    return incremental.to_parse(*_snapshots(spark, d))


@query("set_operations", f"""WITH {_SNAP} SELECT 'added' AS op, count(*) AS n FROM (SELECT path FROM now EXCEPT SELECT path FROM before) UNION ALL
SELECT 'deleted', count(*) FROM (SELECT path FROM before EXCEPT SELECT path FROM now) UNION ALL SELECT 'common', count(*) FROM (SELECT path FROM now INTERSECT SELECT path FROM before)
UNION ALL SELECT 'all', count(*) FROM (SELECT path FROM now UNION SELECT path FROM before)""")
def _(spark, d):
    return incremental.set_changes(*_snapshots(spark, d))


@query("merge_cached", f"WITH {_SNAP} SELECT path, h AS content_hash FROM now UNION ALL SELECT path, h FROM before WHERE path NOT IN (SELECT path FROM now)")
def _(spark, d):
    x, y = _snapshots(spark, d)
    return incremental.merge(y, x)


@query("cache_expiry", "SELECT event_id, epoch_us(TIMESTAMP '2024-01-10') / 1e6 - epoch_us(ts) / 1e6 < 86400 AS valid, epoch_us(TIMESTAMP '2024-01-10') / 1e6 - epoch_us(ts) / 1e6 < 86400 AND event_id % 4 <> 0 AS usable FROM events")
def _(spark, d):
    e = b.events(spark, d)
    now, same = F.lit("2024-01-10").cast("timestamp"), F.when(F.col("event_id") % 4 != 0, True)  # a hash that isn't known is no match
    return e.select("event_id", incremental.valid(F.col("ts"), now, 86400).alias("valid"), incremental.valid(F.col("ts"), now, 86400, same).alias("usable"))


@query("cache_expired", "SELECT event_id FROM events WHERE (epoch_us(TIMESTAMP '2024-01-10') - epoch_us(ts)) / 1e6 > 86400")
def _(spark, d):
    e = b.events(spark, d).withColumn("cached_at", F.col("ts"))
    return incremental.expired(e, F.lit("2024-01-10").cast("timestamp"), 86400).select("event_id")


@query("cache_statistics", "SELECT count(*) AS entries, sum(value) / 1048576 AS mb, epoch_us(min(ts)) AS oldest_us FROM events")
def _(spark, d):
    c = incremental.cache_statistics(b.events(spark, d).select(F.col("value").alias("size"), F.col("ts").alias("cached_at")))
    return c.select("entries", "mb", F.unix_micros("oldest").alias("oldest_us"))


@query("upsert_latest", "SELECT user_id::VARCHAR AS path, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    e = b.events(spark, d).select(F.col("user_id").cast("string").alias("path"), "ts", "event_id")
    out = incremental.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), [F.desc("ts"), F.desc("event_id")])
    return out.select("path", "event_id")


@query("read_through", """SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'far ' || c_name END AS value,
  CASE WHEN c_custkey % 2 = 0 THEN 'local' WHEN c_custkey % 3 = 0 THEN 'remote' ELSE 'none' END AS found_in FROM customer""")
def _(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    far = c.where("key % 3 = 0").withColumn("value", F.concat(F.lit("far "), "value"))
    return incremental.read_through(c.select("key"), c.where("key % 2 = 0"), far)


def _kv(spark, d):
    """Customers as a table of keys and values, and the customers of finished orders as keys."""
    keys = b.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return b.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")), keys


_KV = "kv AS (SELECT c_custkey AS key, c_name AS value FROM customer), k AS (SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F')"


@query("bulk_get", f"WITH {_KV} SELECT * FROM kv WHERE key IN (SELECT key FROM k)")
def _(spark, d):
    return incremental.get_many(*_kv(spark, d))


@query("bulk_delete", f"WITH {_KV} SELECT * FROM kv WHERE key NOT IN (SELECT key FROM k)")
def _(spark, d):
    return incremental.delete_many(*_kv(spark, d))


@query("key_exists", f"WITH {_KV} SELECT DISTINCT key, key IN (SELECT key FROM kv WHERE key % 2 = 0) AS found FROM k")
def _(spark, d):
    kv, keys = _kv(spark, d)
    return incremental.exists(kv.where("key % 2 = 0"), keys)


@query("bulk_put", f"WITH {_KV}, new AS (SELECT DISTINCT key, CASE WHEN key % 5 = 0 THEN repeat('x', 99) ELSE 'n' || key END AS value FROM k) SELECT * FROM kv WHERE key NOT IN (SELECT key FROM new WHERE key % 5 <> 0) UNION ALL SELECT * FROM new WHERE key % 5 <> 0")
def _(spark, d):
    kv, keys = _kv(spark, d)
    value = F.when(F.col("key") % 5 == 0, F.lit("x" * 99)).otherwise(F.concat(F.lit("n"), F.col("key").cast("string")))
    return incremental.put_many(kv, keys.distinct().withColumn("value", value), 50)


@query("cleared_keys", "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'a')")
def _(spark, d):
    return incremental.cleared(b.table(spark, d, "part").select(F.col("p_name").alias("key")), "a")


@query("clear_prefix", "SELECT p_name AS key, p_size AS value FROM part WHERE NOT starts_with(p_name, 'a')")
def _(spark, d):
    return incremental.clear_prefix(b.table(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_size").alias("value")), "a")


@query("registry_priority", "SELECT p_brand AS name, p_partkey AS seq, p_size AS priority FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1")
def _(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("priority"))
    return store.latest(p, ["name"], [F.desc("priority"), F.col("seq")])


@query("registry_statistics", "SELECT p_brand AS source, count(*) AS n, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1")
def _(spark, d):
    return b.table(spark, d, "part").groupBy(F.col("p_brand").alias("source")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("kinds"))


@query("rows_by_id", f"WITH {b.FILES} SELECT path, size FROM files WHERE path IN (SELECT path FROM files WHERE doc_id % 3 = 0)")
def _(spark, d):
    f = b.files(spark, d)
    ids = f.where("doc_id % 3 = 0").select("path").union(spark.createDataFrame([("no/such.py",)], "path string"))
    return store.fetch(f, ids).select("path", "size")


@query("compression_cube", """SELECT CASE WHEN grouping(n_regionkey) = 0 THEN n_regionkey::VARCHAR ELSE '*' END AS ext, CASE WHEN grouping(c_mktsegment) = 0 THEN c_mktsegment ELSE '*' END AS codec,
  count(*) AS n, sum(c_custkey)::BIGINT AS size, sum(c_custkey // 3)::BIGINT AS packed FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)""")
def _(spark, d):
    c = b.table(spark, d, "customer").join(F.broadcast(b.table(spark, d, "nation")), F.expr("c_nationkey = n_nationkey"))
    rows = c.select(F.col("n_regionkey").cast("string").alias("ext"), F.col("c_mktsegment").alias("codec"), F.col("c_custkey").alias("size"), F.expr("c_custkey div 3").alias("packed"))
    return adaptive.compression_stats(rows)


@query("ext_report", """SELECT ext, files, files / sum(files) OVER () AS share, p / s AS ratio FROM (SELECT p_brand AS ext, count(*) AS files, sum(p_retailprice) AS s, sum(p_size)::DOUBLE AS p FROM part GROUP BY 1) ORDER BY ratio, ext LIMIT 10""")
def _(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_brand").alias("ext"), F.col("p_retailprice").alias("size"), F.col("p_size").cast("double").alias("packed"))
    return adaptive.compression_report(p)


@query("codec_table", "SELECT * FROM (VALUES ('none', 'fastest', 'none', 'least'), ('lz4', 'fastest', 'low', 'low'), ('zlib', 'medium', 'medium', 'low'), ('bzip2', 'slow', 'high', 'medium'), ('zstd', 'fast', 'high', 'medium'), ('brotli', 'slow', 'high', 'medium')) t(codec, speed, ratio, memory)")
def _(spark, d):
    return spark.createDataFrame([(k, *v) for k, v in adaptive.ALGORITHMS.items()], "codec string, speed string, ratio string, memory string")


@query("codec_benchmark")
def _(spark, d):
    return adaptive.benchmark(b.files(spark, d)).select("codec", "level", "size", "packed")


_CHUNK = f"""{b.MEASURED}, o AS (SELECT language, path, size, row_number() OVER (PARTITION BY language ORDER BY @key) AS i FROM measured),
r(language, path, size, i, chunk, fill) AS (SELECT language, path, size, i, 0, size FROM o WHERE i = 1 UNION ALL
  SELECT o.language, o.path, o.size, o.i, CASE WHEN r.fill + o.size > MAX THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.fill + o.size > MAX THEN o.size ELSE r.fill + o.size END
  FROM r JOIN o ON o.language = r.language AND o.i = r.i + 1)
SELECT language, path, chunk::INT AS chunk FROM r"""


@query("next_fit_chunks", "WITH RECURSIVE " + _CHUNK.replace("@key", "path").replace("MAX", "10000"))
def _(spark, d):
    f = b.measured(spark, d).select("language", "path", "size")
    return chunking.next_fit(f, ["language"], ["path"], "size", 10000).select("language", "path", "chunk")


@query("metadata_chunks", "WITH RECURSIVE " + _CHUNK.replace("@key", "complexity DESC, path").replace("MAX", "20000"))
def _(spark, d):
    f = b.measured(spark, d).select("language", "path", "size", "complexity")
    return chunking.metadata_chunks(f, ["language"], 20000).select("language", "path", "chunk")


@query("balanced_chunks", f"""WITH RECURSIVE {b.MEASURED}, o AS (SELECT language, path, size, row_number() OVER (PARTITION BY language ORDER BY complexity DESC, path) AS i FROM measured),
n AS (SELECT language, (sum(size) // 50000 + 1)::BIGINT AS n FROM measured GROUP BY 1),
r(language, path, i, chunk, loads) AS (SELECT language, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, [0::BIGINT FOR k IN range(n)] FROM n UNION ALL
  SELECT language, path, i, c, list_transform(loads, lambda x, k: CASE WHEN k = c THEN x + size ELSE x END)
  FROM (SELECT o.language, o.path, o.i, o.size, r.loads, list_position(r.loads, list_min(r.loads)) AS c FROM r JOIN o ON o.language = r.language AND o.i = r.i + 1))
SELECT language, path, (chunk - 1)::INT AS chunk FROM r WHERE i > 0""")
def _(spark, d):
    f = b.measured(spark, d).select("language", "path", "size", "complexity")
    return chunking.balanced(f, ["language"], 50000).select("language", "path", "chunk")


@query("semantic_chunks")
def _(spark, d):
    f = b.deps(spark, d)
    items = f.select("path", F.size("imports").cast("long").alias("size"))
    return chunking.semantic(spark, items, codemap.export_edges(f), 1000)


_WINDOWS = """h AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS len FROM documents WHERE text <> ''),
w AS (SELECT doc_id, (k * 256)::BIGINT AS start, md5(unhex(CASE WHEN k < n THEN substr(x, k::BIGINT * 512 + 1, 2048) ELSE substr(x, k::BIGINT * 512 + 1) END)) AS hash, k = n AS is_tail
  FROM (SELECT *, CASE WHEN len >= 1024 THEN (len - 1024) // 256 + 1 ELSE 0 END AS n FROM h), generate_series(0, n) g(k) WHERE k < n OR k * 256 < len)"""


def _windows(spark, d):
    return chunking.byte_windows(spread(b.table(spark, d, "documents").select("doc_id", "text")), 1024, 256)


@query("byte_windows", f"WITH {_WINDOWS} SELECT doc_id, start, hash, is_tail FROM w")
def _(spark, d):
    return _windows(spark, d)


@query("window_dedup", f"WITH {_WINDOWS} SELECT doc_id, start, is_tail FROM w WHERE NOT is_tail QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id, start) = 1 UNION ALL SELECT doc_id, start, is_tail FROM w WHERE is_tail")
def _(spark, d):
    return chunking.dedup_windows(_windows(spark, d)).select("doc_id", "start", "is_tail")


@query("dedup_statistics", f"WITH {_WINDOWS} SELECT count(*) AS windows, count(DISTINCT hash) AS hashes, count(*) - count(DISTINCT hash) AS duplicates, 100000 AS max_hashes, least(count(DISTINCT hash), 100000) * 100.0::DOUBLE / 100000 AS utilization FROM w WHERE NOT is_tail")
def _(spark, d):
    return chunking.dedup_statistics(_windows(spark, d))


@query("lru_windows", f"WITH {_WINDOWS} SELECT doc_id, start, is_tail OR row_number() OVER (PARTITION BY source, is_tail, hash ORDER BY doc_id, start) = 1 AS kept FROM w JOIN documents USING (doc_id)")
def _(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "source")
    return chunking.lru_windows(_windows(spark, d).join(docs, "doc_id"), ["source"], 10_000_000).select("doc_id", "start", "kept")


@query("compressed_windows", f"WITH {_WINDOWS}, k AS (SELECT w.* FROM w WHERE NOT is_tail QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id, start) = 1 UNION ALL SELECT w.* FROM w WHERE is_tail) SELECT doc_id, start, least(1024, octet_length(encode(text)) - start) AS size, hash AS body FROM k JOIN documents USING (doc_id)")
def _(spark, d):
    w = chunking.byte_windows(spread(b.table(spark, d, "documents").select("doc_id", "text")), 1024, 256, pieces=True)
    packed = adaptive.compress_windows(chunking.dedup_windows(w))
    return packed.select("doc_id", "start", "size", F.md5(adaptive.decompress_bytes("data", "codec")).alias("body"))


@query("usage_totals", "SELECT p_brand AS codec, p_type AS kind, 2 * count(*) AS files, 2 * sum(p_size)::BIGINT AS size, 2 * sum(p_partkey)::BIGINT AS packed FROM part GROUP BY 1, 2")
def _(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_brand").alias("codec"), F.col("p_type").alias("language"), F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("packed"))
    run = adaptive.usage_totals(p)
    return adaptive.add_totals(run, run)


@query("stream_union", "SELECT page_id AS id, length(html)::BIGINT AS n FROM pages UNION ALL SELECT item_id, length(text) FROM benchmark")
def _(spark, d):
    p = b.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("n"))
    return p.unionByName(b.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("n")))
