"""Rows for the edge cases, and brute-force versions."""

import random

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use inside.
CLASH = ["bucket", "h", "f", "at", "rows", "links", "root", "pos", "line", "group_id", "keep", "shard", "block", "score", "id", "n", "w", "same", "size", "tokens"]
WORDS = [a + b for a in "ka lo mi ne pu ra si to vu we".split() for b in "ba de fi go hu ja ke li mo nu".split()]


def prose(seed: int, n: int = 120, per_line: int = 12) -> str:
    r = random.Random(seed)
    w = [r.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + per_line]) for i in range(0, n, per_line))


def documents(spark, texts, first=1):
    """Rows of documents; a text may be a (doc_id, text, source) tuple."""
    rows = []
    for i, t in enumerate(texts):
        d, t, s = t if isinstance(t, tuple) else (first + i, t, f"s{i % 3}")
        rows.append((d, t, "en", s, None if t is None else len(t)))
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, a doc_id of two texts and clashing columns."""
    a, b = prose(1), prose(2)
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "x"), (3, b, None), (None, b, "y"), (4, None, "y"), (5, "", "y"), (6, " \n ", "y"), (7, "!!!", "z"), (8, prose(3, 60_000), "z"), (None, None, None), (9, "ka lo", "z"), (10, prose(11), "x"), (10, prose(12), "x"), (11, prose(11), "x"), (12, prose(12), "x")]
    df = documents(spark, rows)
    out = df
    for c in CLASH:
        out = out.selectExpr("*", f"cast(doc_id as string) as {c}")
    return out


def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


def edit(a: str, b: str) -> int:
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def components(nodes, pairs):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def changed(text: str, words: int, seed: int) -> str:
    r = random.Random(seed)
    lines = [x.split(" ") for x in text.split("\n")]
    for _ in range(words):
        row = r.choice(lines)
        row[r.randrange(len(row))] = r.choice(WORDS)
    return "\n".join(" ".join(x) for x in lines)
