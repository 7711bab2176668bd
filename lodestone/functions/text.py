"""Column expressions over source text: hashes, tokens, complexity, signatures, comments, estimates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{M}\\p{N}_]"
TOKEN = f"{WORD}+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]"
QUOTED_TOKEN = f"\"[^\"]*\"|'[^']*'|{TOKEN}"
KEYWORDS = ("if", "else", "elif", "while", "for", "case", "catch", "except", "switch", "try", "finally")

#: Language to the patterns of its functions: (pattern, group kept).
FUNCTION_PATTERNS = {
    "python": [(r"def\s+\w+\s*\([^)]*\)(?:\s*->\s*[^:]+)?(?=:)", 0)],
    "javascript": [
        (r"function\s+(\w+)\s*\([^)]*\)", 1),
        (r"(?:let|var|const)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=]+)\s*=>", 1),
    ],
}
CLASS_PATTERNS = {
    "python": [(r"class\s+\w+(?:\([^)]*\))?(?=:)", 0)],
    "javascript": [(r"class\s+(\w+)(?:\s+extends\s+\w+)?", 1)],
}
CONSTANT_PATTERNS = [r"(?:final|static\s+final|const)\s+\w+\s*=", r"[A-Z_]+\s*=\s*['\"\d]"]


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip(s: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def window_hash(s: Column) -> Column:
    return F.md5(s)


def tokens(text: Column, strings: bool = True) -> Column:
    """Tokens line by line; a quoted string on one line is one token if ``strings``."""
    pattern = QUOTED_TOKEN if strings else TOKEN
    return F.flatten(F.transform(lines(text), lambda x: F.regexp_extract_all(strip(x), F.lit(pattern), 0)))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def estimate_tokens(text: Column) -> Column:
    """Words times 1.3, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.regexp_count(text, F.lit(r"\S+")) * F.lit(1.3)).cast("long"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def basic_complexity(text: Column) -> Column:
    """One, and one for every control keyword (in any case) and logical operator: both in one scan, as no match of the one is inside one of the other."""
    first = "".join(sorted({w[0] for w in KEYWORDS} | {w[0].upper() for w in KEYWORDS} | set("ao&|")))
    return (_count(text, rf"(?=[{first}])\b(?:(?i:{'|'.join(KEYWORDS)})|and|or|&&|\|\|)\b") + 1).cast("double")


#: What counts beside the first point, by language: words, then other patterns.
COMPLEXITY = {
    "javascript": (("if", r"else\s+if", "for", "while", "case", "catch"), (r"\?\s*[^:]+\s*:", "&&", r"\|\|")),
    "go": (("if", "for", "switch", "select"), ()),
    "rust": (("if", "match", "for", "while", "loop"), ()),
}
COMPLEXITY["typescript"] = COMPLEXITY["javascript"]


def complexity_patterns(language: str) -> list[str]:
    words, others = COMPLEXITY[language]
    return [rf"\b{w}\b" for w in words] + list(others)


def language_complexity(text: Column, language: str) -> Column:
    """One, and one for every decision that the language's patterns find; an ``else if`` counts as if, too."""
    out = F.lit(1)
    for p in complexity_patterns(language):
        out = out + _count(text, p)
    return out.cast("double")


_OPERATORS, _DELIMITERS, _STRINGS = r"[=<>!+\-*/&|^~%]+", r"[(){}\[\];,.:]", "'[^']*'|\"[^\"]*\"|`[^`]*`"
#: A language's tokens after its words, in order of precedence. Rust has no string tokens: their words count.
TOKENS = {
    "javascript": ["=>", r"\.\.\.", r"\?\.", r"\?\?", _OPERATORS, _DELIMITERS, _STRINGS],
    "typescript": ["<[^>]+>", r"\?\.", r"\?\?", "=>", r"\.\.\.", _OPERATORS, _DELIMITERS, f"@{WORD}+", _STRINGS],
    "go": ["<-", ":=", r"\.\.\.", _OPERATORS, _DELIMITERS, _STRINGS],
    "rust": ["::", "->", "=>", r"\?", r"\.\.", "&mut|&", f"'{WORD}+", _OPERATORS, _DELIMITERS],
}


def token_pattern(language: str) -> str:
    return "|".join([f"{WORD}+", *TOKENS[language]])


def _bare(text: Column, language: str) -> Column:
    """Without the language's comments."""
    if language == "python":
        return F.regexp_replace(text, "(?dm)#.*$", "")
    line = "(?<!:)//" if language in ("javascript", "typescript") else "//"
    return F.regexp_replace(F.regexp_replace(text, f"(?dm){line}.*$", ""), r"(?s)/\*.*?\*/", "")


def language_tokens(text: Column, language: str) -> Column:
    """Tokens of one language's text, without comments; languages without rules of their own have the general ones."""
    if language not in TOKENS:
        return tokens(_bare(text, "python") if language == "python" else text)
    return F.regexp_extract_all(_bare(text, language), F.lit(token_pattern(language)), 0)


def count_language_tokens(text: Column, language: Column) -> Column:
    """How many tokens each text has in its language."""
    out = F.size(tokens(text)).cast("long")
    out = F.when(language == "python", F.size(language_tokens(text, "python")).cast("long")).otherwise(out)
    for name in TOKENS:
        n = F.regexp_count(_bare(text, name), F.lit(token_pattern(name))).cast("long")
        out = F.when(language == name, n).otherwise(out)
    return out


def minify(text: Column) -> Column:
    """Lines without outer white space; blank ones and those that begin with # are gone."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.array_join(kept, "\n")


def remove_comments(text: Column, single: str, block: str | None = None) -> Column:
    out = F.regexp_replace(text, "(?m)" + single, "")
    return F.regexp_replace(out, "(?s)" + block, "") if block else out


def remove_c_comments(text: Column) -> Column:
    """// to the end of a line unless it follows a colon, and /* .. */."""
    return remove_comments(text, r"(?<!:)//.*$", r"/\*.*?\*/")


#: Pattern to literals that each of its matches has one of: a text without any isn't read.
_LITERALS = {
    r"(?:def|function)\s+(\w+)": ("def", "function"),
    r"(?:let|var|const)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=]+)\s*=>": ("=>",),
    r"(?:var|let|const)\s+\w+\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)": ("require",),
    CONSTANT_PATTERNS[0]: ("final", "const"),
    CONSTANT_PATTERNS[1]: ("=",),
}


def _any(text: Column, *literals: str) -> Column:
    """Whether a text has one of the literals."""
    out = text.contains(literals[0])
    for x in literals[1:]:
        out = out | text.contains(x)
    return out


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a pattern."""
    every = F.regexp_extract_all(text, F.lit(pattern), group)
    if pattern not in _LITERALS:
        return every
    return F.when(~_any(text, *_LITERALS[pattern]), F.array().cast("array<string>")).otherwise(every)


def matches(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """All matches of one pattern after those of the other."""
    return F.concat(*[found(text, p, g) for p, g in patterns])


def by_language(text: Column, language: Column, table: dict[str, list[tuple[str, int]]]) -> Column:
    out = F.array().cast("array<string>")
    for name, patterns in table.items():
        out = F.when(language == name, matches(text, patterns)).otherwise(out)
    return out


def function_signatures(text: Column, language: Column) -> Column:
    return by_language(text, language, FUNCTION_PATTERNS)


def class_signatures(text: Column, language: Column) -> Column:
    return by_language(text, language, CLASS_PATTERNS)


def tagged(items: Column, tag: str, value: str, name: str) -> Column:
    """array<struct<tag,name>> of an array, with one value for the tag."""
    return F.transform(items, lambda x: F.struct(F.lit(value).alias(tag), x.alias(name)))


def named_signatures(text: Column, hints: dict[str, str]) -> Column:
    """array<struct<hint,signature>> of all matches, hint by hint."""
    return F.concat(*[tagged(F.regexp_extract_all(text, F.lit(p), 0), "hint", h, "signature") for h, p in hints.items()])


def constants(text: Column, most: int = 10) -> Column:
    return F.slice(matches(text, [(p, 0) for p in CONSTANT_PATTERNS]), 1, most)


def python_imports(text: Column) -> Column:
    """Modules of import lines: X of ``from X import``, each name (not its alias) of ``import a as b, c``."""
    line = r"(?m)^\s*((?:from\s+\S+\s+)?import\s+.+)$"
    found = F.regexp_extract_all(text, F.lit(line), 1)
    each = F.transform(
        found,
        lambda s: F.when(s.startswith("from"), F.array(F.regexp_extract(s, r"^from\s+(\S+)", 1))).otherwise(
            F.transform(F.split(F.regexp_replace(s, r"^import\s+", ""), ","), lambda n: F.element_at(F.split(strip(n), r"\s+"), 1))
        ),
    )
    return F.flatten(each)


def javascript_imports(text: Column) -> Column:
    """Modules of ES6 imports, then those of require calls."""
    es6 = r"import\s+(?:\{[^}]+\}|[*\w]+(?:\s+as\s+\w+)?)\s+from\s+['\"]([^'\"]+)['\"]"
    cjs = r"(?:var|let|const)\s+\w+\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
    return matches(text, [(es6, 1), (cjs, 1)])


def go_imports(text: Column) -> Column:
    """Single imports, then the members of import blocks."""
    blocks = F.regexp_extract_all(text, F.lit(r"import\s*\([^)]+\)"), 0)
    inner = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'"([^"]+)"'), 1)))
    return F.concat(F.regexp_extract_all(text, F.lit(r'import\s+"([^"]+)"'), 1), inner)


def rust_imports(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);"), 1), strip)


#: Language to its features: literals, and the pattern that shows the feature. A text without any of the literals of each group can't
#: show it, which is known without reading it by the pattern. Patterns begin with a literal or one character, so that no run of word
#: characters is tried again from each of its places.
FEATURES = {
    "typescript": {
        "generics": ("< >", rf"<[A-Z]{WORD}*(?:\s+extends\s+{WORD}+)?>|{WORD}<[^>]+>"),
        "decorators": ("@", rf"@{WORD}+\s*(?:\([^)]*\))?\s*(?:class|function|get|set|method)"),
    },
    "go": {
        "goroutines": ("go (", rf"\bgo\s+{WORD}+\s*\("),
        "channels": ("chan|<-", r"\bchan\b|<-"),
        "generics": ("[ ]", rf"\[\s*{WORD}+\s+{WORD}+(?:\s*,\s*{WORD}+\s+{WORD}+)*\s*\]"),
    },
    "rust": {
        "unsafe": ("unsafe", r"\bunsafe\s*\{"),
        "async": ("async|await", r"\basync\b|\bawait\b"),
        "macros": ("!", f"{WORD}!"),
        "generics": ("< >", rf"<(?=[^>]*>)[^>]*?(?:[A-Z]|'{WORD})"),
    },
}


def features(text: Column, language: str) -> Column:
    """Names of the features of a language that a text shows, in the table's order."""
    each = []
    for name, (literals, pattern) in FEATURES[language].items():
        shown = text.rlike(pattern)
        for x in reversed(literals.split(" ")):
            shown = _any(text, *x.split("|")) & shown
        each.append(F.when(shown, F.lit(name)))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def yaml_structure(text: Column) -> Column:
    """struct<keys,variables,complexity> of a YAML text."""
    keys = F.regexp_extract_all(text, F.lit(r"(?m)^(\w[\w-]*):"), 1)
    variables = F.regexp_extract_all(text, F.lit(r"\$\{(\w+)\}"), 1)
    indent = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^( *)\S"), 1), F.length)), F.lit(0))
    items, multi = _count(text, r"(?m)^\s*-\s"), _count(text, r"(?m):\s*[|>]\s*$")
    every = _count(text, r"(?m)^\s*\w[\w-]*:")
    score = F.lit(1.0) + indent / F.lit(2.0) + every * F.lit(0.1) + items * F.lit(0.05) + multi * F.lit(0.5)
    return F.struct(keys.alias("keys"), variables.alias("variables"), score.alias("complexity"))


def parse_set(s: Column) -> Column:
    """The members of a Python set of strings written as text; empty if it can't be read."""
    return F.regexp_extract_all(s, F.lit("'([^']*)'"), 1)


def compression_ratio(original: Column, compressed: Column) -> Column:
    """Original over compressed; infinite if nothing is left of something, 1 if there was nothing."""
    return (
        F.when(compressed > 0, original / compressed)
        .when(original > 0, F.lit(float("inf")))
        .otherwise(F.lit(1.0))
    )


def context_usage(tokens_: Column, window: int) -> Column:
    """struct<percent,fits,chunks>: how a text of so many tokens uses a context window."""
    chunks = F.greatest(F.lit(1).cast("long"), F.floor((tokens_ + window - 1) / window).cast("long"))
    return F.struct(
        (tokens_ * F.lit(100.0) / window).alias("percent"), (tokens_ <= window).alias("fits"), chunks.alias("chunks")
    )


def compression_level(size: Column) -> Column:
    """A codec's level by size: none for tiny texts, fast for huge ones."""
    return F.when(size < 1024, 0).when(size > 10 * 1024 * 1024, 1).when(size > 1024 * 1024, 6).otherwise(9)


def retry_delay(attempt: Column, first: float = 1.0, base: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(base), attempt - 1), F.lit(most))


def time_until_recovery(timeout: Column, waited: Column) -> Column:
    return F.greatest(F.lit(0.0), timeout - waited)


def vocabulary_tokens(path: str):
    """A pandas UDF that counts a text's tokens by the vocabulary file at ``path`` (a byte-pair tokenizer's JSON), in batches.

    The file is read once per worker, so it has to be there on every executor. Null: 0 tokens.
    """
    held: list = []

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
            held[0].encode_special_tokens = True
        found = held[0].encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(e.ids) for e in found], dtype="int64")

    return count


def token_statistics(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row (tokens, words, chars, texts, average) over all texts, tokens by estimate; zeros and a null average of nothing."""
    t = texts.select(estimate_tokens(F.col(text)).alias("t"), F.regexp_count(text, F.lit(r"\S+")).alias("w"), F.length(text).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return t.agg(
        total("t").alias("tokens"), total("w").alias("words"), total("n").alias("chars"), F.count("*").alias("texts"),
        (F.sum("t").cast("double") / F.count("*")).alias("average"),
    )
