"""Comparison of a Spark result with DuckDB's."""


def plain(v):
    """A value without the difference between the engines' types."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return [plain(x) for x in v]
    if isinstance(v, dict) or hasattr(v, "asDict"):
        return {k: plain(x) for k, x in (v if isinstance(v, dict) else v.asDict()).items()}
    if type(v).__name__ in ("bool_",):
        return bool(v)
    try:
        f = float(v)
        return None if f != f else float(f"{f:.9g}")
    except (TypeError, ValueError):
        return str(v)


def same(df, con, sql):
    """Both results as sorted rows of text, by columns in order of name."""
    a, b = df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    c = sorted(a.columns)
    rows = lambda x: sorted(repr([plain(v) for v in r]) for r in x[c].itertuples(index=False))
    assert rows(a) == rows(b)
