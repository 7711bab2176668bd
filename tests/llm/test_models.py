"""The fitted models: held-out accuracy on the test tables, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import empty, odd, prose
from pyspark.sql import functions as F

from lodestone.llm import language, quality_mil, quality_rules, toxicity, vec
from lodestone.llm.fit import labelled

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def truth(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.mark.parametrize("module", [quality_mil, quality_rules])
def test_quality(spark, docs, truth, module):
    # Fitted to 300 of either class, held against all labelled documents.
    own = docs.join(F.broadcast(truth), "doc_id").select("doc_id", "text")
    scored = module.score(own, labelled(spark, DIR, "quality", 300)).select("doc_id", F.col("quality").alias("p"))
    rows = scored.join(truth, "doc_id").select("p", "quality").toPandas()
    good, bad = rows.p[rows.quality == 1] >= 0.5, rows.p[rows.quality == 0] >= 0.5
    assert good.mean() > 0.97 and bad.mean() < 0.1


def test_toxicity(spark, docs, truth):
    # The production sample; clean documents outside it, and the toxic fifth of it that training doesn't see.
    sample = toxicity.sample_of(spark, DIR)
    model = toxicity.fit(sample, toxicity.train)
    own = docs.join(F.broadcast(truth), "doc_id").select("doc_id", "text")
    out = own.mapInArrow(toxicity._score(model), "doc_id long, toxicity double, toxic boolean, windows long, top_window long")
    rows = out.join(truth.select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    seen = {r["doc_id"] for r in sample.select("doc_id").collect()}
    fresh = rows[~rows.doc_id.isin(seen)]
    # 0.86 of 93 here, where training has but 356 toxic documents; all of about 240 on check_s, where it has about 960.
    assert model["held_out"][0] > 0.8 and rows.toxic[rows.y == 1].mean() > 0.9
    assert (fresh.y == 0).sum() > 1000 and fresh.toxic[fresh.y == 0].mean() < 0.02


def test_language(spark, docs):
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.language == rows.lang).mean() > 0.98
    other = spark.createDataFrame([(1, "щука и рак тянут воз " * 9)], "doc_id long, text string")
    sample = docs.select("doc_id", "text", F.col("lang").alias("y")).limit(500)
    assert language.identify(other, sample).first()["language"] == "und"


def _sample(spark):
    rows = [(i, prose(i) if i % 2 else prose(i).upper().replace(" ", "!! "), i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


@pytest.mark.parametrize("module", [quality_mil, quality_rules, toxicity])
def test_odd_rows(spark, module):
    sample = _sample(spark)
    rows = module.score(odd(spark), sample).collect()
    assert len(rows) == odd(spark).count() and sum(r["doc_id"] is None for r in rows) == 2
    blank = [r for r in rows if r["doc_id"] in (4, 5, 6)]
    assert all(r[1] == 0 for r in blank) and len({r[1] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert module.score(empty(spark), sample).count() == 0
    with pytest.raises(ValueError):
        module.score(odd(spark), sample.limit(0))
    with pytest.raises(Exception, match="both classes"):
        module.score(odd(spark), sample.where("y = 1")).count()


def test_language_odd_rows(spark):
    rows = {(r["doc_id"]): r for r in language.identify(odd(spark)).collect()}
    assert rows[4]["language"] == rows[5]["language"] == rows[6]["language"] == "und" and rows[1]["language"] == "en"
    assert language.identify(empty(spark)).count() == 0


def test_reject_keeps_columns(spark):
    sample = _sample(spark).withColumn("y", 1 - F.col("y"))
    out = toxicity.reject(odd(spark), sample)
    assert out.columns == odd(spark).columns and out.count() >= 10


def test_gru_gradient():
    # The hand-written backward pass against differences.
    rng = np.random.default_rng(0)
    x, u, d = rng.standard_normal((4, 2, 24)).astype(np.float32), (rng.standard_normal((8, 24)) * 0.3).astype(np.float32), rng.standard_normal((4, 2, 8)).astype(np.float32)
    for back in (False, True):
        _, held = toxicity._gru(x, u, back, True)
        dx, du = toxicity._gru_back(u, held, d)
        for a, g in ((x, dx), (u, du)):
            for i in rng.choice(a.size, 6, replace=False):
                at, eps = np.unravel_index(i, a.shape), 1e-2
                keep = a[at]
                a[at] = keep + eps
                hi = (toxicity._gru(x, u, back, False)[0] * d).sum()
                a[at] = keep - eps
                lo = (toxicity._gru(x, u, back, False)[0] * d).sum()
                a[at] = keep
                assert abs((hi - lo) / (2 * eps) - g[at]) < 0.02


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        start, doc = toxicity.windows(np.array([n]))
        covered = {w for s in start for w in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and len(start) == len(set(start))


def test_words_and_hashes():
    texts = ["Ab cd", None, "", "ab  CD\nab", "x" * 3_000_000]
    got = list(vec.chunks(pa.array(texts)))
    count, hashes = [], []
    for c in got:
        c.words()
        count += list(np.diff(c.woff))
        hashes += list(c.hashes())
    assert count == [2, 0, 0, 3, 1] and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3]
