"""The corpus pipeline: its stages one after another on planted documents, and the contract of STAGES."""

import __spark_entry__ as entry
import pytest
from helpers import changed, prose

import corpus_pipeline as cp
from lodestone.llm import minhash, mixing, packing, toxicity

BAD = ["idiot", "moron", "scum"]


def poison(text, seed):
    w = text.split(" ")
    for i in range(3, len(w), 9):
        w[i] = BAD[(seed + i) % 3]
    return " ".join(w)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """120 clean documents, 40 toxic ones, 20 exact and 20 near copies; labels for most."""
    d = str(tmp_path_factory.mktemp("sf"))
    clean = [prose(i, 150) for i in range(120)]
    toxic = [poison(prose(500 + i, 150), i) for i in range(40)]
    texts = clean + toxic + clean[:20] + [changed(t, 3, i) for i, t in enumerate(clean[20:40])]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(120 <= i < 160)) for i in range(160) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r["doc_id"] for r in docs.collect()} if k < 4 else docs.collect()
        if k < 4:
            assert docs.columns == columns
    clean = set(range(120))
    assert len(clean & kept["toxicity"]) >= 116 and len({*range(120, 160)} & kept["toxicity"]) <= 4
    # Exact copies lose all their lines; the near ones keep the changed lines, and aren't copies of their first any more.
    assert not {*range(160, 180)} & kept["line_dedup"] and kept["toxicity"] & clean <= kept["line_dedup"]
    assert kept["near_dedup"] <= kept["line_dedup"] and clean & kept["line_dedup"] <= kept["near_dedup"]
    assert kept["mixing"] and kept["mixing"] <= kept["near_dedup"]
    # Packing: every word of the mix once, no bin over capacity.
    words = sum(len(r["text"].split()) for r in spark.read.parquet(str(tmp_path / "3")).collect())
    assert sum(r["n_tokens"] for r in kept["packing"]) == words == sum(len(r["text"].split()) for r in kept["packing"])
    assert max(r["n_tokens"] for r in kept["packing"]) <= packing.CAPACITY


def test_run_is_the_stages(spark, folder):
    by_hand = spark.read.parquet(f"{folder}/documents.parquet")
    by_hand = toxicity.reject(by_hand, toxicity.sample_of(spark, folder))
    by_hand = packing.pack(mixing.mix(minhash.keep_one(cp.dedup_lines(spark, by_hand, folder))))
    key = lambda df: sorted((r["bin"], r["n_tokens"], r["text"]) for r in df.collect())
    assert key(cp.run(spark, folder)) == key(by_hand)


def test_entry():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"] and cp.ORACLE_SQL is None
    assert set(entry.oracle_sql()) <= set(names)
