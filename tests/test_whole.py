"""Queries without SQL read whole texts and every row."""

from lodestone.plans import catalog


def test_parse_files_reads_whole_texts(spark, tmp_path):
    text = "word " * 200 + "\nconst late = require('late-module')\nfunction last(x) { return x }\n"
    rows = [(1, text, "en", "s", len(text)), (9, text, "en", "s", len(text))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["parse_files"](spark, str(tmp_path)).collect()
    assert len(got) == 2 and all("late-module" in r["imports"] and "last" in r["functions"] for r in got)


def test_semantic_chunks_read_every_row(spark, tmp_path):
    # A sparse graph, so that there are several components; lines from 1 to 4.
    rows = [(s, 3 * p if s % 2 else p, s % 4 + 1) for s in range(1, 41) for p in ((s + 1) // 2 // 3 * 3 + 1,)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    owner, up = {}, {f"s{s}": f"s{s}" for s, _, _ in rows}
    for s, p, _ in rows:
        if p % 3:
            owner[p * 3] = max(owner.get(p * 3, ""), f"s{s}")

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for s, p, _ in rows:
        if p in owner:
            a, b = find(f"s{s}"), find(owner[p])
            up[max(a, b)] = min(a, b)
    got = {r["path"]: r["cluster"] for r in catalog.queries()["semantic_chunks"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in up} and 5 < len(set(got.values())) < len(got)
