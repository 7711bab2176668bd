"""Rendering of projected items as Markdown, JSON, XML or plain sections; corpus map, token report and summary.

Items are rows of a projection level (operators.store): its ``type`` decides what there is to render.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx

WINDOW = 128_000
#: Columns of a level beside path and type.
_LEVELS = {
    "full": ("content",), "structural": ("imports", "exports", "functions", "classes", "constants"), "signature": ("functions", "classes"),
    "summary": ("language", "size", "complexity", "imports_count", "exports_count", "functions_count", "classes_count"),
}


def _lines(*parts: Column | str) -> Column:
    """Arrays of lines one after another, as one text."""
    each = [F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.flatten(F.array(*each)), "\n")


def _one(c: Column) -> Column:
    return F.array(c)


def _section(title: str, items: Column, mark: str = "") -> Column:
    body = F.transform(items, lambda x: F.concat(F.lit(mark), x)) if mark else items
    return F.when(F.size(items) > 0, F.concat(F.array(F.lit(title)), body, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def decimals(c: Column, n: int) -> Column:
    """A number with n decimals, ties to the even digit, and no separators."""
    return F.translate(F.format_number(c.cast("double"), n), ",", "")


def markdown(level: str) -> Column:
    head = _one(F.concat(F.lit("## "), F.col("path"), F.lit("\n")))
    if level == "full":
        return _lines(head, "```", _one(F.col("content")), "```\n")
    if level == "structural":
        return _lines(head, *[_section(f"### {k.capitalize()}", F.col(k), "- ") for k in ("imports", "functions", "classes")])
    if level == "signature":
        return _lines(head, "### Signatures", F.transform(F.concat("functions", "classes"), lambda x: F.concat(F.lit("- "), x)), "")
    say = lambda label, c: _one(F.concat(F.lit(f"- {label}: "), c))
    return _lines(
        head, say("Language", F.col("language")), say("Size", F.concat(F.col("size").cast("string"), F.lit(" bytes"))),
        say("Complexity", decimals(F.col("complexity"), 2)), say("Functions", F.col("functions_count").cast("string")),
        say("Classes", F.col("classes_count").cast("string")), "",
    )


def json(level: str, meta: bool = True) -> Column:
    own = [F.col(c) for c in _LEVELS[level]]
    inner = {"full": own, "structural": [F.struct(*own).alias("structure")], "signature": [F.struct(*own).alias("signatures")], "summary": [F.struct(*own).alias("summary")]}
    return F.to_json(F.struct("path", "type", *inner[level], *(["metadata"] if meta and level != "summary" else [])))


def _escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def _tag(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


_LISTS = ("imports", "exports", "functions", "classes", "constants")


def xml(level: str) -> Column:
    """Nested tags, text escaped; a list is its tag again and again."""
    one = lambda k: F.array_join(F.transform(k, lambda x: _tag(k, _escape(x))), "") if k in _LISTS else _tag(k, _escape(F.col(k).cast("string")))
    own = F.concat(*[one(k) for k in _LEVELS[level]])
    inner = {"full": own, "structural": _tag("structure", own), "signature": _tag("signatures", own), "summary": _tag("summary", own)}[level]
    return _tag("file", F.concat(one("path"), one("type"), inner))


def plain(level: str) -> Column:
    """Bracketed headings, which cost few tokens."""
    head = [_one(F.concat(F.lit("[FILE: "), F.col("path"), F.lit("]"))), _one(F.concat(F.lit("[TYPE: "), F.upper("type"), F.lit("]")))]
    if level != "summary":
        m = lambda k: F.col("metadata")[k]
        about = F.concat(F.lit("[LANG: "), m("language"), F.lit(" | SIZE: "), m("size").cast("string"), F.lit(" | COMPLEXITY: "), decimals(m("complexity"), 1), F.lit("]"))
        head.append(_one(about))
    body = [_section(f"[{k.upper()}]", F.col(k)) for k in ("imports", "functions", "classes")] if level == "structural" else []
    return _lines(*head, "", *body)


FORMATS = {"markdown": markdown, "json": json, "xml": xml, "custom": plain}


def render(items: DataFrame, fmt: str, level: str) -> DataFrame:
    """Rows (path, rendered) of a level's rows; an unknown format is Markdown."""
    return items.select("path", FORMATS.get(fmt, markdown)(level).alias("rendered"))


def render_levels(items: DataFrame, fmt: str) -> DataFrame:
    """Rows (level, path, rendered) of rows of several levels (store.levels), each as its ``type`` asks."""
    one = FORMATS.get(fmt, markdown)
    rendered = F.lit(None).cast("string")
    for level in _LEVELS:
        rendered = F.when(F.col("type") == level, one(level)).otherwise(rendered)
    return items.select(F.col("type").alias("level"), "path", rendered.alias("rendered"))


def _number(c: Column) -> Column:
    return F.format_number(c, 0)


def _bold(label: str, c: Column) -> Column:
    return _one(F.concat(F.lit(f"- **{label}**: "), c))


def token_summary(stats: DataFrame, title: str = "Token Statistics", encoding: str = "word_fallback") -> DataFrame:
    """Rows (value): a summary of rows (tokens, words, chars), and of their ratio to ``original`` tokens if there is such a column."""
    parts = [
        _one(F.lit(f"## {title}")), "", _bold("Total Tokens", _number(F.col("tokens"))), _bold("Word Count", _number(F.col("words"))),
        _bold("Character Count", _number(F.col("chars"))), _bold("Encoding Method", F.lit(encoding)),
    ]
    if "original" in stats.columns:
        ratio = tx.compression_ratio(F.col("original").cast("double"), F.col("tokens"))
        parts += [_bold("Compression Ratio", F.concat(decimals(ratio, 2), F.lit(":1"))), _bold("Space Savings", F.concat(decimals((1 - 1 / ratio) * 100, 1), F.lit("%")))]
    return stats.select(_lines(*parts).alias("value"))


def token_header(stats: DataFrame, fmt: str = "markdown", encoding: str = "word_fallback") -> DataFrame:
    """Rows (value): the token report of rows (original, tokens, words, chars): counts, use of the context window, compression.

    Without the time of the run, so that equal inputs give equal outputs. An unknown format is Markdown.
    """
    t, o = F.col("tokens"), F.col("original")
    use = tx.context_usage(t, WINDOW)
    remaining = F.greatest(F.lit(0).cast("long"), F.lit(WINDOW) - t)
    ratio = tx.compression_ratio(o.cast("double"), t)
    saved = (1 - 1 / ratio) * 100
    if fmt == "json":
        inner = F.struct(
            F.struct(t.alias("total_tokens"), F.col("words").alias("word_count"), F.col("chars").alias("char_count"), F.lit(encoding).alias("encoding_used")).alias("output_stats"),
            F.struct(use["percent"].alias("usage_percent"), remaining.alias("remaining_tokens"), use["fits"].alias("fits_in_context"), use["chunks"].alias("estimated_chunks_needed")).alias("context_analysis"),
            F.struct(o.alias("total_tokens")).alias("original_stats"), ratio.alias("compression_ratio"), saved.alias("token_reduction_percent"),
        )
        return stats.select(F.concat(F.lit("// "), F.to_json(F.struct(inner.alias("token_analysis")))).alias("value"))
    if fmt == "xml":
        tag = lambda n, c: _one(F.concat(F.lit("    "), _tag(n, c.cast("string"))))
        return stats.select(_lines(
            "<tokenAnalysis>", "  <outputStats>", tag("totalTokens", t), tag("wordCount", F.col("words")), tag("charCount", F.col("chars")), tag("encodingUsed", F.lit(encoding)), "  </outputStats>",
            "  <contextAnalysis>", tag("usagePercent", decimals(use["percent"], 1)), tag("remainingTokens", remaining), tag("fitsInContext", use["fits"]), "  </contextAnalysis>",
            "  <compressionAnalysis>", tag("originalTokens", o), tag("compressedTokens", t), tag("compressionRatio", decimals(ratio, 2)), tag("tokenReductionPercent", decimals(saved, 1)), "  </compressionAnalysis>",
            "</tokenAnalysis>", "",
        ).alias("value"))
    chunks = F.when(use["fits"], F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("- **Estimated Chunks Needed**: "), use["chunks"].cast("string")), F.lit("")))
    return stats.select(_lines(
        "# Token Report", "", "## Token Statistics", "", _bold("Output Tokens", _number(t)), _bold("Word Count", _number(F.col("words"))),
        _bold("Character Count", _number(F.col("chars"))), _bold("Encoding Method", F.lit(encoding)), "", "## Context Window Analysis", "",
        _bold("Context Usage", F.concat(decimals(use["percent"], 1), F.lit(f"% of {WINDOW // 1000}K tokens"))), _bold("Remaining Capacity", F.concat(_number(remaining), F.lit(" tokens"))),
        _bold("Fits in Single Context", F.when(use["fits"], "Yes").otherwise("No")), "", chunks, "## Compression Analysis", "", _bold("Original Tokens", _number(o)),
        _bold("Compressed Tokens", _number(t)), _bold("Compression Ratio", F.concat(decimals(ratio, 2), F.lit(":1"))), _bold("Token Reduction", F.concat(decimals(saved, 1), F.lit("%"))), "", "---", "",
    ).alias("value"))


def _gathered(rows: DataFrame, line: Column, *order: str | Column) -> DataFrame:
    """One row, x: the lines of a small report in order."""
    keyed = rows.select(F.struct(*order, line.alias("line")).alias("k"))
    return keyed.agg(F.transform(F.array_sort(F.collect_list("k")), lambda x: x["line"]).alias("x"))


def corpus_map(overview: DataFrame, tree: DataFrame, importers: DataFrame, imports: DataFrame) -> DataFrame:
    """One row, value: overview, tree, top importers and most used imports of a corpus, as Markdown.

    overview: one row (files, size, tokens, average, languages); tree: rows (path, line), which all go into the report;
    importers: at most ten rows (src, targets, more); imports: at most ten (import, n).
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    languages = F.transform("languages", lambda x: F.concat(x["value"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    drawn = _gathered(tree, F.col("line"), F.split("path", "/").alias("p"))
    arrows = F.concat(
        F.lit("- "), name(F.col("src")), F.lit(" → "), F.array_join(F.transform("targets", name), ", "),
        F.when(F.col("more") > 0, F.concat(F.lit("\n  (and "), F.col("more").cast("string"), F.lit(" more)"))).otherwise(""),
    )
    graph = _gathered(importers, arrows, "src")
    used = _gathered(imports, F.concat(F.lit("- "), "import", F.lit(" ("), F.col("n").cast("string"), F.lit(" files)")), (-F.col("n")).alias("m"), "import")
    out = drawn.withColumnRenamed("x", "drawn")  # the only row that may be large: it stays where it is made
    for df in (overview.withColumn("languages", languages), graph.withColumnRenamed("x", "graph"), used.withColumnRenamed("x", "used")):
        out = out.join(F.broadcast(df), F.lit(True))  # one row each
    average = F.when(F.col("average") > 0, F.array(F.concat(F.lit("- **Average Complexity**: "), decimals(F.col("average"), 1)))).otherwise(F.array().cast("array<string>"))
    spoken = F.when(F.size("languages") > 0, F.array(F.concat(F.lit("- **Languages**: "), F.array_join("languages", ", ")))).otherwise(F.array().cast("array<string>"))
    return out.select(_lines(
        "# Codebase Analysis\n", "## Overview\n", _bold("Total Files", F.col("files").cast("string")), _bold("Total Size", F.concat(_number(F.col("size")), F.lit(" bytes"))),
        _bold("Total Lines", _number(F.col("tokens"))), spoken, average, "", "## Project Structure\n", "```", F.col("drawn"), "```\n", "## Dependency Graph\n",
        _section("### Import Relationships", F.col("graph")), _section("## External Dependencies\n\n### Most Used Imports", F.col("used")), "## File Organization\n",
    ).alias("value"))
