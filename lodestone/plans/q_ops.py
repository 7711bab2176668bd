"""Queries of security, monitoring, formatting, parsing and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx
from lodestone.operators import codemap, formats, monitoring, parsers, security, store
from lodestone.plans import bindings as b
from lodestone.plans.q_text import STRUCTURAL
from lodestone.streaming import jobs

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_PATTERNS = ", ".join("('{}', '{}', '{}')".format(k, t, p.replace("'", "''")) for k, t, p in security.PATTERNS)
_LINES = f"""{b.CODE}, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line FROM code),
p(kind, type, pattern) AS (VALUES {_PATTERNS}), hits AS (SELECT doc_id, line, kind, type FROM lines, p WHERE regexp_matches(line_text, pattern))"""


@query("security_findings", f"WITH {_LINES} SELECT * FROM hits")
def _(spark, d):
    return security.findings(b.code(spark, d), "doc_id")


@query("security_verdicts", f"""WITH {_LINES}, h AS (SELECT doc_id, count(DISTINCT line) FILTER (WHERE kind = 'sensitive') AS s, count(DISTINCT line) FILTER (WHERE kind = 'malicious') AS m FROM hits GROUP BY 1),
l AS (SELECT doc_id, count(*) > 100000 AS too_many_lines, coalesce(bool_or(length(line_text) > 10000) FILTER (WHERE line <= 1000), false) AS long_line FROM lines GROUP BY 1)
SELECT doc_id, too_many_lines, long_line, coalesce(s, 0) AS sensitive, coalesce(m, 0) AS malicious, NOT (coalesce(s, 0) > 0 OR too_many_lines) AS safe FROM l LEFT JOIN h USING (doc_id)""")
def _(spark, d):
    return security.verdicts(b.code(spark, d), "doc_id")


@query("pages_scan", f"""WITH p(kind, type, pattern) AS (VALUES {_PATTERNS}), l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x FROM pages)
SELECT type, count(*) AS n FROM l, p WHERE regexp_matches(x, pattern) GROUP BY 1""")
def _(spark, d):
    return security.findings(b.table(spark, d, "pages").withColumnRenamed("html", "text"), "page_id").groupBy("type").agg(F.count("*").alias("n"))


@query("combined_validation", f"""WITH {_LINES}, h AS (SELECT doc_id, bool_or(kind = 'sensitive') AS s, bool_or(kind = 'malicious') AS m FROM hits GROUP BY 1),
l AS (SELECT doc_id, bool_or(length(line_text) > 10000 AND line <= 1000) AS long_line FROM lines GROUP BY 1),
e AS (SELECT path, doc_id, text, CASE WHEN NOT starts_with(path, 'src1') THEN 'outside its base' WHEN length(text) > 104857600 THEN 'too large' END AS error FROM code)
SELECT path, error, error IS NULL AS valid, list_filter([CASE WHEN text = '' THEN 'empty file' END, CASE WHEN s THEN 'sensitive content' END, CASE WHEN m THEN 'suspicious content' END, CASE WHEN long_line THEN 'line too long' END], lambda x: x IS NOT NULL) AS warnings
FROM e LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)""")
def _(spark, d):
    return security.validate(b.code(spark, d), "src1")


_M, _CLASS = "(doc_id % 4 + 1)", "(CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END)"


@query("ast_security", f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ['can''t be parsed'] ELSE ['line 1: import of os']
  || CASE WHEN doc_id % 3 = 0 THEN ['line ' || (7 + 4 * {_M}) || ': call of getattr'] ELSE [] END
  || CASE WHEN doc_id % 5 = 0 THEN ['line ' || (4 + 4 * {_M} + {_CLASS}) || ': call of eval', 'line ' || (5 + 4 * {_M} + {_CLASS}) || ': call of os.remove'] ELSE [] END END AS issues FROM documents""")
def _(spark, d):
    return b.python_code(spark, d).select("doc_id", security.ast_issues("text").alias("issues"))


@query("normalised_paths", f"WITH {b.FILES} SELECT doc_id, path AS clean FROM files")
def _(spark, d):
    # Suffix letters in full width come back as ASCII.
    return b.files(spark, d).select("doc_id", security.nfkc(F.translate("path", "pyjson", "ｐｙｊｓｏｎ")).alias("clean"))


_KINDS = ["FileNotFoundError", "PermissionError", "ValueError", "MemoryError", "TimeoutError", "KeyError"]


@query("error_messages", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'file not found' WHEN 1 THEN 'not permitted' WHEN 2 THEN 'invalid value' WHEN 3 THEN 'out of memory' WHEN 4 THEN 'timed out' ELSE 'an error occurred' END AS message FROM events")
def _(spark, d):
    kind = F.when(F.col("event_id") % 7 < 6, F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 7 % 6 + 1).cast("int")))
    return b.table(spark, d, "events").select("event_id", security.sanitized_error(kind).alias("message"))


def _calls(spark, d):
    e = b.events(spark, d)
    return e.select("user_id", "event_id", "t", (F.col("event_type") == "error").alias("failed"))


_RANKED = f"{b.EVENTS}, o AS (SELECT user_id, event_id, t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev)"


@query("rate_limit", f"""WITH RECURSIVE {_RANKED}, r(user_id, i, event_id, allowed, times) AS (SELECT user_id, i, event_id, true, [t] FROM o WHERE i = 1 UNION ALL
  SELECT user_id, i, event_id, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END
  FROM (SELECT o.user_id, o.i, o.event_id, o.t, list_filter(r.times, lambda x: x > o.t - 86400.0) AS live FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT event_id, allowed FROM r""")
def _(spark, d):
    return security.admitted(_calls(spark, d), 3, 86400.0).select("event_id", "allowed")


@query("call_rate", f"WITH {b.EVENTS} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS in_window FROM ev")
def _(spark, d):
    return security.call_rate(_calls(spark, d)).select("event_id", "in_window")


@query("circuit_breaker", f"""WITH RECURSIVE {_RANKED}, r(user_id, i, event_id, seen, state, bad, good, since) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, '', 'closed', 0, 0, 0.0::DOUBLE FROM o UNION ALL
  SELECT user_id, i, event_id, st, CASE WHEN st = 'open' THEN st WHEN failed AND (st = 'half_open' OR bad + 1 >= 2) THEN 'open' WHEN NOT failed AND st = 'half_open' AND g + 1 >= 2 THEN 'closed' ELSE st END,
    CASE WHEN st = 'open' THEN bad WHEN failed THEN bad + 1 ELSE 0 END, CASE WHEN st = 'open' OR failed THEN g ELSE g + 1 END,
    CASE WHEN st <> 'open' AND failed AND (st = 'half_open' OR bad + 1 >= 2) THEN t ELSE since END
  FROM (SELECT o.user_id, o.i, o.event_id, o.t, o.failed, r.bad, r.since, CASE WHEN r.state = 'open' AND o.t - r.since >= 86400.0 THEN 'half_open' ELSE r.state END AS st,
      CASE WHEN r.state = 'open' AND o.t - r.since >= 86400.0 THEN 0 ELSE r.good END AS g FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT event_id, seen AS state, seen <> 'open' AS passed FROM r WHERE i > 0""")
def _(spark, d):
    return monitoring.breaker(_calls(spark, d), 2, 86400.0).select("event_id", "state", "passed")


@query("consecutive_failures", f"""WITH {b.EVENTS}, p AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY t, event_id) AS part FROM ev),
s AS (SELECT event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, part ORDER BY t, event_id) AS streak FROM p)
SELECT event_id, streak, streak = 3 AS recover FROM s""")
def _(spark, d):
    return monitoring.failure_streaks(_calls(spark, d)).select("event_id", "streak", "recover")


@query("metric_retention", "SELECT event_type AS metric, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000")
def _(spark, d):
    return monitoring.last_points(b.metrics(spark, d)).select("metric", "id")


@query("latest_metric", "SELECT event_type AS metric, arg_max(value, ts) AS value FROM events GROUP BY 1")
def _(spark, d):
    return monitoring.latest(b.metrics(spark, d))


@query("metric_export", """WITH l AS (SELECT event_type AS metric, event_id AS id, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100)
SELECT metric, count(*) AS n, sum(value) AS total FROM l GROUP BY 1""")
def _(spark, d):
    j = F.from_json("json", "array<struct<id:long,value:double>>")
    return monitoring.to_json(b.metrics(spark, d)).select("metric", F.explode(j).alias("x")).groupBy("metric").agg(F.count("*").alias("n"), F.sum("x.value").alias("total"))


@query("prometheus", """WITH l AS (SELECT event_type AS metric, arg_max(value, ts) AS value FROM events GROUP BY 1)
SELECT string_agg('# TYPE ' || metric || ' gauge' || chr(10) || metric || ' ' || value, chr(10) ORDER BY metric) AS value FROM l""")
def _(spark, d):
    return monitoring.prometheus(b.metrics(spark, d))


@query("stage_summary", f"""WITH {b.STAGES} SELECT stage, count(*) AS n, avg("end" - start) AS avg_s, min("end" - start) AS min_s, max("end" - start) AS max_s, sum(items)::BIGINT AS items, sum(bytes)::BIGINT AS bytes, sum(errors)::BIGINT AS errors FROM stages GROUP BY 1""")
def _(spark, d):
    return monitoring.stage_summary(b.stages(spark, d))


@query("stage_memory", f"""WITH {b.STAGES} SELECT stage, avg("end" - start) AS avg_s, max("end" - start) AS max_s, min("end" - start) AS min_s, avg(memory_peak - memory_start) AS memory_delta, count(*) AS n FROM stages GROUP BY 1""")
def _(spark, d):
    return monitoring.memory_report(b.stages(spark, d))


@query("stage_rates", f"""WITH {b.STAGES}, x AS (SELECT stage_id, items, bytes, CASE WHEN "end" IS NULL THEN 0.0 ELSE "end" - start END AS duration FROM stages)
SELECT stage_id, duration, CASE WHEN duration > 0 THEN items / duration ELSE 0 END AS items_per_s, CASE WHEN duration > 0 THEN bytes / duration ELSE 0 END AS bytes_per_s FROM x""")
def _(spark, d):
    return monitoring.derived(b.stages(spark, d)).select("stage_id", "duration", "items_per_s", "bytes_per_s")


def _system(spark, d):
    return b.stages(spark, d).select(F.col("start").alias("ts"), F.col("stage_id").alias("id"), "cpu", F.col("memory_peak").alias("memory"))


@query("system_summary", f"""WITH {b.STAGES} SELECT avg(cpu) AS cpu_avg, max(cpu) AS cpu_max, avg(memory_peak) AS memory_avg, max(memory_peak) AS memory_max, arg_max(memory_peak, start) - arg_min(memory_peak, start) AS memory_growth FROM stages""")
def _(spark, d):
    return monitoring.system_summary(_system(spark, d))


def _errors(spark, d):
    return b.events(spark, d).where("event_type = 'error'").select(((F.col("event_id") * 7) % 1500).alias("stage_id"))


_ERRORS = "er AS (SELECT (event_id * 7) % 1500 AS stage_id FROM events WHERE event_type = 'error')"


@query("bottlenecks", f"""WITH {b.STAGES}, {_ERRORS}, per AS (SELECT stage, avg("end" - start) AS v FROM stages WHERE "end" IS NOT NULL GROUP BY 1), t AS (SELECT *, max(v) OVER () AS top FROM per)
SELECT 'slow_stage' AS type, stage, CASE WHEN v = top THEN 'high' ELSE 'medium' END AS severity, v AS value, 'optimise ' || stage AS suggestion FROM t WHERE v > 0.5 * top
UNION ALL SELECT 'memory_growth', stage, 'high', memory_peak - memory_start, 'stream or split the input of ' || stage FROM stages WHERE memory_peak > 2 * memory_start
UNION ALL SELECT 'high_error_rate', stage, 'high', count(*), 'look into the errors of ' || stage FROM er JOIN stages USING (stage_id) GROUP BY stage HAVING count(*) > 10
UNION ALL SELECT 'io_bottleneck', NULL, 'medium', count(*), 'little CPU at low throughput: the input is the limit' FROM stages
  WHERE cpu < 50 AND (CASE WHEN "end" IS NULL OR "end" = start THEN 0 ELSE bytes / 1048576.0 / ("end" - start) END) < 10 HAVING count(*) > 0""")
def _(spark, d):
    return monitoring.bottlenecks(b.stages(spark, d), _errors(spark, d))


@query("errors_by_stage", f"WITH {b.STAGES}, {_ERRORS} SELECT stage, count(*) AS n FROM er JOIN stages USING (stage_id) GROUP BY 1")
def _(spark, d):
    return monitoring.errors_by_stage(b.stages(spark, d), _errors(spark, d))


@query("waiting_stages", f"""WITH {b.STAGES} SELECT stage, count(*) AS n FROM stages WHERE cpu < 50 AND (CASE WHEN "end" IS NULL OR "end" = start THEN 0 ELSE bytes / 1048576.0 / ("end" - start) END) < 10 GROUP BY 1""")
def _(spark, d):
    return monitoring.waiting_stages(b.stages(spark, d))


@query("suggestions", f"""WITH {b.STAGES}, s AS (SELECT avg(cpu) AS cpu_avg, max(cpu) AS cpu_max FROM stages), r AS (SELECT stage, avg(items / ("end" - start)) AS r FROM stages WHERE "end" IS NOT NULL AND items > 0 GROUP BY 1)
SELECT 'resource_utilization' AS category, 'more workers: the CPUs are idle' AS advice FROM s WHERE cpu_avg < 50
UNION ALL SELECT 'resource_utilization', 'CPU bound: a lower level or a faster codec' FROM s WHERE cpu_avg >= 50 AND cpu_max > 90
UNION ALL SELECT 'stage_optimization', 'parsing is slow: use expressions instead of a full parser' FROM r WHERE r < 100
UNION ALL SELECT 'batching', 'batches are small' FROM (SELECT avg(value) AS a FROM events WHERE event_type = 'view') WHERE a < 10
UNION ALL SELECT 'batching', 'batches are large' FROM (SELECT avg(value) AS a FROM events WHERE event_type = 'view') WHERE a > 1000
UNION ALL SELECT 'caching', 'few cache hits: a larger cache or longer life' FROM (SELECT avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS a FROM events WHERE event_type = 'click') WHERE a < 0.5""")
def _(spark, d):
    m = b.metrics(spark, d).select(
        F.when(F.col("metric") == "view", "batch_size").when(F.col("metric") == "click", "cache_hit").otherwise(F.col("metric")).alias("metric"),
        F.when(F.col("metric") == "click", F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0)).otherwise(F.col("value")).alias("value"),
    )
    return monitoring.suggestions(b.stages(spark, d), monitoring.system_summary(_system(spark, d)), m)


@query("config_advice", "SELECT 'compression' AS category, 'a lower compression level' AS advice FROM nation WHERE n_nationkey * 10 < 100 UNION ALL SELECT 'throughput', 'more workers' FROM nation WHERE n_nationkey * 100 < 1000 UNION ALL SELECT 'memory', 'smaller batches or windows' FROM nation WHERE n_nationkey > 0.8 * 20")
def _(spark, d):
    r = b.table(spark, d, "nation").select((F.col("n_nationkey") * 10).alias("mb_per_s"), (F.col("n_nationkey") * 100).alias("files_per_min"), F.col("n_nationkey").alias("memory_mb"), F.lit(20).alias("memory_limit_mb"))
    return monitoring.config_advice(r)


@query("hit_rate", "SELECT user_id, hits, misses, round(hits * 100.0::DOUBLE / (hits + misses), 2) AS hit_rate FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type <> 'view') AS misses FROM events GROUP BY 1)")
def _(spark, d):
    c = b.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") != "view").alias("misses"))
    return monitoring.hit_rate(c)


def _rendered(spark, d, fmt):
    """All documents at all levels."""
    return formats.render_levels(store.levels(b.coded(spark, d)), fmt)


def _list(*parts):
    return "array_to_string(" + " || ".join(parts) + ", chr(10))"


def _section(title, items, mark=""):
    return f"CASE WHEN len({items}) > 0 THEN ['{title}'] || ['{mark}' || x FOR x IN {items}] || [''] ELSE [] END"


def _tags(*names, lists=()):
    esc = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return " || ".join([f"'<{n}>' || {esc(n if n not in _COUNTS else _COUNTS[n])} || '</{n}>'" if n not in lists else f"array_to_string(['<{n}>' || {esc('x')} || '</{n}>' FOR x IN {n}], '')" for n in names])


_COUNTS = {f"{k}_count": f"len({k})::VARCHAR" for k in ("imports", "exports", "functions", "classes")} | {"size": "size::VARCHAR", "complexity": "complexity::VARCHAR"}
#: The four levels of all code: minified text, the structural columns, and the symbols that a summary counts.
_ALL = f"""{STRUCTURAL}, ml AS (SELECT path, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM
  (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM code)),
mini AS (SELECT path, string_agg(line, chr(10) ORDER BY i) AS content FROM ml WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY path),
every AS (SELECT t.*, coalesce(content, '') AS content FROM structural t LEFT JOIN mini USING (path))"""
_HEAD = "['## ' || path || chr(10)]"
_CUSTOM = "['[FILE: ' || path || ']', '[TYPE: ' || upper(type) || ']'"
_ABOUT = ", '[LANG: ' || language || ' | SIZE: ' || size || ' | COMPLEXITY: ' || printf('%.1f', complexity) || ']', '']"


@query("format_markdown", f"""WITH {_ALL}
SELECT 'full' AS level, path, {_list(f"{_HEAD}", "['```', content, '```' || chr(10)]")} AS rendered FROM every
UNION ALL SELECT 'structural', path, {_list(_HEAD, *[_section('### ' + k.capitalize(), k, '- ') for k in ('imports', 'functions', 'classes')])} FROM every
UNION ALL SELECT 'signature', path, {_list(_HEAD, "['### Signatures']", "['- ' || x FOR x IN functions || classes]", "['']")} FROM every
UNION ALL SELECT 'summary', path, {_list(_HEAD, "['- Language: ' || language, '- Size: ' || size || ' bytes', '- Complexity: ' || printf('%.2f', complexity), '- Functions: ' || len(functions), '- Classes: ' || len(classes), '']")} FROM coded""")
def _(spark, d):
    return _rendered(spark, d, "markdown")


@query("format_xml", f"""WITH {_ALL}
SELECT 'full' AS level, path, '<file>' || {_tags('path', 'type', 'content')} || '</file>' AS rendered FROM (SELECT *, 'full' AS type FROM every)
UNION ALL SELECT 'structural', path, '<file>' || {_tags('path', 'type')} || '<structure>' || {_tags('imports', 'exports', 'functions', 'classes', 'constants', lists=('imports', 'exports', 'functions', 'classes', 'constants'))} || '</structure></file>' FROM (SELECT *, 'structural' AS type FROM every)
UNION ALL SELECT 'signature', path, '<file>' || {_tags('path', 'type')} || '<signatures>' || {_tags('functions', 'classes', lists=('functions', 'classes'))} || '</signatures></file>' FROM (SELECT *, 'signature' AS type FROM every)
UNION ALL SELECT 'summary', path, '<file>' || {_tags('path', 'type')} || '<summary>' || {_tags('language', 'size', 'complexity', *[k for k in _COUNTS if k.endswith('_count')])} || '</summary></file>' FROM (SELECT *, 'summary' AS type FROM coded)""")
def _(spark, d):
    return _rendered(spark, d, "xml")


@query("format_json", f"WITH {_ALL} SELECT path, 'structural' AS type, imports, exports, functions, classes, constants, language, size FROM every")
def _(spark, d):
    j = formats.render(store.structural(b.coded(spark, d)), "json", "structural")
    schema = "path string, type string, structure struct<imports:array<string>,exports:array<string>,functions:array<string>,classes:array<string>,constants:array<string>>, metadata struct<language:string,size:long>"
    return j.select(F.from_json("rendered", schema).alias("j")).select("j.path", "j.type", "j.structure.*", "j.metadata.*")


@query("format_custom", f"""WITH {_ALL}
SELECT 'full' AS level, path, {_list(_CUSTOM + _ABOUT)} AS rendered FROM (SELECT *, 'full' AS type FROM every)
UNION ALL SELECT 'structural', path, {_list(_CUSTOM + _ABOUT, *[_section(f'[{k.upper()}]', k) for k in ('imports', 'functions', 'classes')])} FROM (SELECT *, 'structural' AS type FROM every)
UNION ALL SELECT 'signature', path, {_list(_CUSTOM + _ABOUT)} FROM (SELECT *, 'signature' AS type FROM every)
UNION ALL SELECT 'summary', path, {_list(_CUSTOM + ", '']")} FROM (SELECT *, 'summary' AS type FROM coded)""")
def _(spark, d):
    return _rendered(spark, d, "custom")


def _stats(spark, d):
    t = tx.token_statistics(b.table(spark, d, "documents").select("text"))
    return t.select((F.col("tokens") * 3).alias("original"), "tokens", "words", "chars")


_STATS = r"""t AS (SELECT sum(greatest(1, floor(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE)::BIGINT))::BIGINT AS t, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS w, sum(length(text))::BIGINT AS n FROM documents)"""
_BOLD = lambda label, c: f"'- **{label}**: ' || {c}"
_NUM = lambda c: f"format('{{:,}}', {c})"
_USE = "t * 100.0::DOUBLE / 128000"
_COUNTED = f"""{_BOLD('Word Count', _NUM('w'))}, {_BOLD('Character Count', _NUM('n'))}, {_BOLD('Encoding Method', "'word_fallback'")}"""


@query("token_header", f"""WITH {_STATS} SELECT 'markdown' AS fmt, array_to_string(['# Token Report', '', '## Token Statistics', '', {_BOLD('Output Tokens', _NUM('t'))}, {_COUNTED}, '', '## Context Window Analysis', '',
  {_BOLD('Context Usage', f"printf('%.1f', {_USE}) || '% of 128K tokens'")}, {_BOLD('Remaining Capacity', _NUM('greatest(0, 128000 - t)') + " || ' tokens'")}, {_BOLD('Fits in Single Context', "CASE WHEN t <= 128000 THEN 'Yes' ELSE 'No' END")}, '']
  || CASE WHEN t > 128000 THEN ['- **Estimated Chunks Needed**: ' || ((t + 127999) // 128000), ''] ELSE [] END || ['## Compression Analysis', '', {_BOLD('Original Tokens', _NUM('3 * t'))}, {_BOLD('Compressed Tokens', _NUM('t'))},
  {_BOLD('Compression Ratio', "'3.00:1'")}, {_BOLD('Token Reduction', "'66.7%'")}, '', '---', ''], chr(10)) AS value FROM t
UNION ALL SELECT 'xml', array_to_string(['<tokenAnalysis>', '  <outputStats>', '    <totalTokens>' || t || '</totalTokens>', '    <wordCount>' || w || '</wordCount>', '    <charCount>' || n || '</charCount>', '    <encodingUsed>word_fallback</encodingUsed>', '  </outputStats>',
  '  <contextAnalysis>', '    <usagePercent>' || printf('%.1f', {_USE}) || '</usagePercent>', '    <remainingTokens>' || greatest(0, 128000 - t) || '</remainingTokens>', '    <fitsInContext>' || (t <= 128000) || '</fitsInContext>', '  </contextAnalysis>',
  '  <compressionAnalysis>', '    <originalTokens>' || 3 * t || '</originalTokens>', '    <compressedTokens>' || t || '</compressedTokens>', '    <compressionRatio>3.00</compressionRatio>', '    <tokenReductionPercent>66.7</tokenReductionPercent>', '  </compressionAnalysis>', '</tokenAnalysis>', ''], chr(10)) FROM t
UNION ALL SELECT 'json', t || ' ' || w || ' ' || n || ' ' || greatest(0, 128000 - t) || ' ' || (t <= 128000) || ' ' || 3 * t FROM t""")
def _(spark, d):
    out = None
    for fmt in ("markdown", "xml", "json"):
        h = formats.token_header(_stats(spark, d), fmt)
        if fmt == "json":
            at = lambda p: F.get_json_object(F.substring("value", 4, 1 << 20), "$.token_analysis." + p)
            h = h.select(F.concat_ws(" ", *[at(p) for p in ("output_stats.total_tokens", "output_stats.word_count", "output_stats.char_count", "context_analysis.remaining_tokens", "context_analysis.fits_in_context", "original_stats.total_tokens")]).alias("value"))
        part = h.withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query("token_summary", f"""WITH {_STATS} SELECT array_to_string(['## Token Statistics', '', {_BOLD('Total Tokens', _NUM('t'))}, {_COUNTED}, {_BOLD('Compression Ratio', "'3.00:1'")}, {_BOLD('Space Savings', "'66.7%'")}], chr(10)) AS value FROM t""")
def _(spark, d):
    return formats.token_summary(_stats(spark, d))


_TREE = """n AS (SELECT DISTINCT p[1:k] AS pp, k::INT AS k FROM (SELECT string_split(path, '/') AS p FROM files), generate_series(1, len(p)) g(k)),
m AS (SELECT *, lead(pp[k]) OVER (PARTITION BY pp[1:k - 1] ORDER BY pp[k]) IS NULL AS last FROM n),
x AS (SELECT pp, k, unnest(generate_series(1, k)) AS d FROM n),
tree AS (SELECT x.pp, string_agg(CASE WHEN d < x.k THEN (CASE WHEN last THEN '    ' ELSE '│   ' END) ELSE (CASE WHEN last THEN '└── ' ELSE '├── ' END) || x.pp[x.k] END, '' ORDER BY d) AS line FROM x JOIN m ON m.pp = x.pp[1:x.d] GROUP BY x.pp)"""


@query("directory_tree_text", f"WITH {b.FILES}, {_TREE} SELECT array_to_string(pp, '/') AS path, line FROM tree")
def _(spark, d):
    return codemap.tree_text(b.files(spark, d))


@query("corpus_map", f"""WITH {b.CODED}, {_TREE}, {b.DEPS}, o AS (SELECT symbol, max(path) AS dst FROM exp GROUP BY 1), e AS (SELECT DISTINCT imp.path AS src, dst FROM imp JOIN o USING (symbol) WHERE imp.path <> dst),
gr AS (SELECT src, list(dst ORDER BY dst) AS t FROM e GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 10),
lang AS (SELECT language, count(*) AS n FROM coded GROUP BY 1), im AS (SELECT i, count(*) AS n FROM (SELECT unnest(imports) AS i FROM coded) GROUP BY 1 ORDER BY n DESC, i LIMIT 10),
r AS (SELECT (SELECT list(language || ' (' || n || ')' ORDER BY language) FROM lang) AS l, (SELECT list(line ORDER BY pp) FROM tree) AS t, (SELECT list('- ' || src || ' → ' || array_to_string(t[1:3], ', ') || CASE WHEN len(t) > 3 THEN chr(10) || '  (and ' || (len(t) - 3) || ' more)' ELSE '' END ORDER BY src) FROM gr) AS g,
  (SELECT list('- ' || i || ' (' || n || ' files)' ORDER BY n DESC, i) FROM im) AS u, (SELECT avg(complexity) FROM coded WHERE complexity > 0) AS a, (SELECT count(*) FROM coded) AS f, (SELECT sum(size)::BIGINT FROM coded) AS s, (SELECT sum(token_count)::BIGINT FROM coded) AS k)
SELECT array_to_string(['# Codebase Analysis' || chr(10), '## Overview' || chr(10), {_BOLD('Total Files', 'f')}, {_BOLD('Total Size', _NUM('s') + " || ' bytes'")}, {_BOLD('Total Lines', _NUM('k'))}, '- **Languages**: ' || array_to_string(l, ', '), '- **Average Complexity**: ' || printf('%.1f', a), '',
  '## Project Structure' || chr(10), '```'] || t || ['```' || chr(10), '## Dependency Graph' || chr(10), '### Import Relationships'] || g || ['', '## External Dependencies' || chr(10) || chr(10) || '### Most Used Imports'] || u || ['', '## File Organization' || chr(10)], chr(10)) AS value FROM r""")
def _(spark, d):
    f = b.coded(spark, d)
    importers = codemap.top_importers(codemap.export_edges(b.deps(spark, d)))
    return formats.corpus_map(codemap.overview(f), codemap.tree_text(f), importers, codemap.top_imports(f))


@query("parse_files")
def _(spark, d):
    """Every document, whole and with its snippet, through the parser of its path's suffix."""
    p = parsers.Registry().parse(b.code(spark, d).select("path", "language", "text"))
    return p.select("path", "parser", "imports", "exports", F.col("functions.name").alias("functions"), F.col("classes.name").alias("classes"), "complexity", "parse_error")


_PYTHON = f"""p AS (SELECT doc_id, {_M} AS m, CASE WHEN doc_id % 7 = 0 THEN 'def (:' || chr(10) ELSE '' END || 'import os, json' || chr(10) || 'from a.b import c' || chr(10) || 'LIMIT = 1' || chr(10)
  || array_to_string(['@wraps' || chr(10) || 'def f' || i || '(a, b):' || chr(10) || '    if a and b:' || chr(10) || '        return [x for x in a]' || chr(10) FOR i IN range(0, doc_id % 4 + 1)], '')
  || CASE WHEN doc_id % 3 = 0 THEN 'class Box(Base):' || chr(10) || '    size: int = 1' || chr(10) || '    def get(self):' || chr(10) || '        return getattr(self, ''size'')' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN 'x = eval(''1'')' || chr(10) || 'os.remove(''y'')' || chr(10) ELSE '' END || '# ' || replace(text, chr(10), chr(10) || '# ') AS text FROM documents)"""


@query("python_ast", f"""WITH {_PYTHON} SELECT doc_id, ['os', 'json', 'a.b'] AS imports, ['f' || i FOR i IN range(0, m)] || CASE WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN ['get'] ELSE [] END AS functions,
  CASE WHEN doc_id % 3 = 0 THEN ['Box'] ELSE [] END AS classes, CASE WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN ['size: int'] ELSE [] END AS attributes, CASE WHEN doc_id % 7 = 0 THEN {b.COMPLEXITY_SQL} ELSE (1 + 3 * m)::DOUBLE END AS complexity, doc_id % 7 = 0 AS failed FROM p""")
def _(spark, d):
    p = parsers.PythonParser().parse(b.python_code(spark, d))
    typed = F.flatten(F.transform("classes", lambda c: F.coalesce(F.transform(c["attributes"], lambda a: F.concat(a["name"], F.lit(": "), a["type"])), F.array().cast("array<string>"))))
    return p.select("doc_id", "imports", F.col("functions.name").alias("functions"), F.col("classes.name").alias("classes"), typed.alias("attributes"), "complexity", F.col("parse_error").isNotNull().alias("failed"))


@query("python_structure", f"""WITH p AS (SELECT doc_id, doc_id || '.py' AS path, {_M} AS m, doc_id % 7 = 0 AS broken, {_CLASS} AS c FROM documents), f AS (SELECT *, unnest(range(0, m)) AS i FROM p)
SELECT path, 'import' AS kind, name, line, NULL AS type FROM p, (VALUES ('os', 1), ('json', 1), ('a.b:c', 2)) v(name, line) WHERE NOT broken
UNION ALL SELECT path, 'import', name, line, NULL FROM p, (VALUES ('import os, json', 2), ('from a.b import c', 3)) v(name, line) WHERE broken
UNION ALL SELECT path, 'function', 'f' || i, 5 + 4 * i + broken::INT, NULL FROM f UNION ALL SELECT path, 'function', 'get', 6 + 4 * m, NULL FROM p WHERE c > 0 AND NOT broken
UNION ALL SELECT path, 'class', 'Box', 4 + 4 * m + broken::INT, NULL FROM p WHERE c > 0
UNION ALL SELECT path, 'decorator', 'wraps', 4, NULL FROM p WHERE NOT broken UNION ALL SELECT path, 'decorator', 'wraps', 5 + 4 * i, NULL FROM f WHERE broken
UNION ALL SELECT path, 'global', 'LIMIT', 3, NULL FROM p WHERE NOT broken UNION ALL SELECT path, 'global', 'x', 4 + 4 * m + c, NULL FROM p WHERE NOT broken AND doc_id % 5 = 0""")
def _(spark, d):
    return parsers.Registry().structures(b.python_code(spark, d))


def _lines(*rows):
    return " || chr(10) || ".join("'" + r.replace("'", "''") + "'" for r in rows)


_GO = ["package shapes", "import (", '\t"fmt"', '\tx "net/http"', ")", "type Point struct {", "}", "type shape interface {", "}"]
_GO_FUNC = r"func\s+(?:\(([^)]+)\)\s+)?(\w+)\s*\([^)]*\)(?:\s*(?:\([^)]*\)|[^{]*))?"


@query("go_parse", f"""WITH g AS (SELECT doc_id, {_lines(*_GO)} || chr(10) || array_to_string(['func (p *Point) M' || i || '(a int) int {{' || chr(10) || 'if a > 0 {{ return 1 }}' || chr(10) || '}}' || chr(10) FOR i IN range(0, doc_id % 4)], '') || 'func help() {{}}' || chr(10) || text AS text FROM documents)
SELECT doc_id, 'shapes' AS package, ['fmt', 'net/http'] AS imports, regexp_extract_all(text, '{_GO_FUNC}', 2) AS functions, ['M' || i FOR i IN range(0, doc_id % 4)] AS methods,
  regexp_extract_all(text, 'type\\s+(\\w+)\\s+(?:struct|interface)', 1) AS classes, (1 + {" + ".join(f"len(regexp_extract_all(text, '{chr(92)}b{w}{chr(92)}b'))" for w in ("if", "for", "switch", "select"))})::DOUBLE AS complexity FROM g""")
def _(spark, d):
    each = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), lambda i: F.concat(F.lit("func (p *Point) M"), i.cast("string"), F.lit("(a int) int {\nif a > 0 { return 1 }\n}\n")))
    own = F.slice(each, F.lit(1), (F.col("doc_id") % 4).cast("int"))
    text = F.concat(F.lit("\n".join(_GO) + "\n"), F.array_join(own, ""), F.lit("func help() {}\n"), "text")
    p = parsers.GoParser().parse(b.files(spark, d).select("doc_id", "path", text.alias("text")))
    methods = F.transform(F.filter("classes", lambda c: c["name"] == "Point")[0]["methods"], lambda m: m["name"])
    return p.select("doc_id", F.col("module_path").alias("package"), "imports", F.col("functions.name").alias("functions"), methods.alias("methods"), F.col("classes.name").alias("classes"), "complexity")


_RUST = ["mod shapes;", "use crate::a::B;", "use std::fmt;", "pub struct A;", "enum C { X }", "pub trait D {}", "pub async fn go() {}", "unsafe fn no() {}", "pub const fn k() {}"]


@query("rust_parse", f"""WITH g AS (SELECT doc_id, {_lines(*_RUST)} || chr(10) || text AS text FROM documents), u AS (SELECT *, [trim(x) FOR x IN regexp_extract_all(text, 'use\\s+([^;]+);', 1)] AS uses FROM g)
SELECT doc_id, 'shapes' AS module, uses AS imports, [x FOR x IN uses IF starts_with(x, 'crate::') OR starts_with(x, 'super::') OR starts_with(x, 'self::')] AS internal,
  regexp_extract_all(text, 'fn\\s+(\\w+)', 1) AS functions, ['pub async', 'unsafe', 'pub const'] AS flags,
  regexp_extract_all(text, 'struct\\s+(\\w+)', 1) || regexp_extract_all(text, 'enum\\s+(\\w+)', 1) || regexp_extract_all(text, 'trait\\s+(\\w+)', 1) AS classes,
  (1 + {" + ".join(f"len(regexp_extract_all(text, '{chr(92)}b{w}{chr(92)}b'))" for w in ("if", "match", "for", "while", "loop"))})::DOUBLE AS complexity FROM u""")
def _(spark, d):
    text = F.concat(F.lit("\n".join(_RUST) + "\n"), "text")
    p = parsers.RustParser().parse(b.files(spark, d).select("doc_id", "path", text.alias("text")))
    flags = F.transform(F.slice("functions", 1, 3), lambda f: F.array_join(f["flags"], " "))
    return p.select("doc_id", F.col("module_path").alias("module"), "imports", F.col("internal_dependencies").alias("internal"), F.col("functions.name").alias("functions"), flags.alias("flags"), F.col("classes.name").alias("classes"), "complexity")


_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _event_stream(spark, d):
    s = jobs.table_stream(spark, d, _EVENT, "events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _name() -> str:
    return "q" + uuid.uuid4().hex[:12]


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def _(spark, d):
    out = jobs.run_once(jobs.tumbling(_event_stream(spark, d)), _name(), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("sliding_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour * k AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events, range(2) r(k) GROUP BY ALL")
def _(spark, d):
    out = jobs.tumbling(b.events(spark, d), "2 hours", "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 minutes OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 minutes AS session_end, count(*) AS n FROM g GROUP BY user_id, k""")
def _(spark, d):
    s = jobs.sessions(b.events(spark, d))
    return s.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))


@query("stream_dedup", "SELECT DISTINCT md5(event_type || user_id) AS hash FROM events")
def _(spark, d):
    s = _event_stream(spark, d).select("ts", F.concat("event_type", F.col("user_id").cast("string")).alias("piece"))
    return jobs.run_once(jobs.dedup_stream(s, delay="400 days"), _name()).select("hash")


@query("stream_stages", "SELECT user_id::VARCHAR AS stage_id, sum(CASE WHEN event_type IN ('view', 'click') THEN event_id % 5 ELSE 0 END)::BIGINT AS items, count(*) FILTER (WHERE event_type = 'error') AS errors, false AS done FROM events GROUP BY 1")
def _(spark, d):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("view", "click"), "progress").otherwise("other")
    s = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("stage_id"), kind.alias("kind"), (F.col("event_id") % 5).alias("items"))
    return jobs.run_once(jobs.track_stages(s), _name(), "update")
