"""Line dedup, fingerprints and MinHash against brute force."""

import re

import numpy as np
import pytest
from compare import same
from helpers import changed, components, documents, edit, empty, odd, prose

from lodestone.llm import fingerprints, lines, minhash, queries, vec
from lodestone.llm.groups import resolve
from lodestone.workdir import Stash


def shingles(t):
    w = re.findall(r"\w+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def family(n, copies, words, length=120):
    return [t for i in range(n) for t in [prose(100 + i, length), *[changed(prose(100 + i, length), words, 7 * i + k) for k in range(copies)]]]


@pytest.mark.parametrize("name", ["op2_line_dedup", "op9_mixing", "op3_chat_formatting"])
def test_sql(spark, duck, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


def test_minhash_groups(spark):
    texts = family(12, 6, 6)
    s = [shingles(t) for t in texts]
    pairs = [(i + 1, j + 1) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) >= 0.7 * len(s[i] | s[j])]
    want = components(range(1, len(s) + 1), pairs)
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    found = sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    assert found >= 0.9
    assert all(want[d] == want[g] for d, g in got.items())  # nothing is joined that brute force doesn't join


def test_signature_estimates_jaccard():
    import pyarrow as pa

    a, b = prose(5, 400), changed(prose(5, 400), 25, 1)
    (c,) = vec.chunks(pa.array([a, b]))
    sh, off = minhash.shingle_sets(c)
    sig = minhash.signatures(sh, off, 128)
    x, y = shingles(a), shingles(b)
    assert off[1] == len(x) and abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.15
    # Coordinate k is the least of the second permutation shifted by k.
    place = (vec.mix(sh[: off[1]] ^ vec.U(minhash.SEED)) >> vec.U(64 - minhash.UNIVERSE_BITS)).astype(np.int64)
    pi = np.random.default_rng(minhash.SEED).permutation(1 << minhash.UNIVERSE_BITS)
    assert [pi[(place + k) % len(pi)].min() for k in (0, 5, 127)] == [sig[0][k] for k in (0, 5, 127)]


def test_minhash_odd_rows(spark):
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(odd(spark)).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and got[8] == 8 and got[9] == 9 and not {4, 5, 6, 7} & set(got)
    kept = minhash.keep_one(odd(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd(spark).columns and {1, 3, 4, 5, 6, 7, 8, 9, 10} <= set(ids) and 2 not in ids and len({11, 12} & set(ids)) == 1 and ids.count(None) == 2
    assert minhash.near_duplicates(empty(spark)).count() == 0 and minhash.keep_one(empty(spark)).count() == 0


def test_edit_copies(spark):
    texts = family(10, 3, 1, 300)
    n = len(texts)
    pairs = [(i + 1, j + 1) for i in range(n) for j in range(i + 1, n) if i // 4 == j // 4 and edit(texts[i], texts[j]) <= fingerprints.bound(max(len(texts[i]), len(texts[j])))]
    want = components(range(1, n + 1), pairs)
    got = {r["doc_id"]: r["group_id"] for r in fingerprints.edit_copies(documents(spark, texts)).collect()}
    assert pairs and sum(got[a] == got[b] for a, b in pairs) / len(pairs) >= 0.9
    assert all(want[d] == want[g] for d, g in got.items())


def test_sieve_is_exact():
    for i in range(30):
        a, b = prose(i, 40), changed(prose(i, 40), i % 7, i)
        assert np.abs(fingerprints.histogram(a) - fingerprints.histogram(b)).sum() <= 2 * edit(a, b)


def band_hits(spark, pairs):
    """How many of the pairs share a band and pass the sieves that come before verification."""
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "struct(doc_id as h1, doc_id as h2) same")
    sketches = df.mapInArrow(fingerprints._sketch, fingerprints.SKETCH).withColumnRenamed("doc_id", "id")
    keys, places = {}, {r["id"]: r for r in sketches.collect()}
    for r in fingerprints.bands(sketches).collect():
        keys.setdefault(r["id"], set()).add(r["bucket"])
    agree = lambda a, b: max(sum(x == y for x, y in zip(a[c] or [], b[c] or [])) for c in ("short", "long"))
    return sum(bool(keys[i] & keys[i + 1]) and agree(places[i], places[i + 1]) >= fingerprints.MIN_AGREE for i in range(0, len(rows), 2))


def test_band_recall_and_whole_text(spark):
    # Copies at half the bound share a band; an edit at the very end changes the embedding as one at the start does.
    pairs = [(prose(i, n), changed(prose(i, n), k, i)) for i in range(20) for n, k in ((20, 1), (60, 2), (300, 8), (1500, 40))]
    assert band_hits(spark, pairs) >= 0.95 * len(pairs)
    a = prose(1, 300)
    x, y = (fingerprints.signatures([t])[1][0].tolist() for t in (a, a[:-150] + prose(2, 300)[:150]))
    assert x != y


def test_edit_bound_of_long_and_loose_copies(spark):
    # 3 % of a long text (more than 200 edits) and about 7 % of a short one.
    long, short = prose(31, 6000), prose(32, 300)
    far, loose = changed(long, 200, 1), changed(short, 24, 1)
    assert 200 < fingerprints._distance(long, far) and 0.04 * len(short) < fingerprints._distance(short, loose) <= 0.1 * len(short)
    got = {r["doc_id"]: r["group_id"] for r in fingerprints.edit_copies(documents(spark, [long, far, short, loose, prose(33, 300)])).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


@pytest.mark.parametrize("where", ["prefix", "suffix", "middle", "deletion"])
def test_block_edits_share_a_band(spark, where):
    pairs = []
    for share in (0.2, 0.5, 0.95):
        for i in range(20):
            a, block = prose(i, 1000), prose(900 + i, 1000)
            k, m = int(share * fingerprints.bound(len(a))), len(a) // 2
            pairs.append((a, {"prefix": block[:k] + a, "suffix": a + block[:k], "middle": a[:m] + block[:k] + a[m:], "deletion": a[:m] + a[m + k :]}[where]))
    assert band_hits(spark, pairs) >= 57


def test_within_is_exact():
    for i in range(40):
        a = prose(i, 5 + 3 * i)
        b = changed(a, i % 12, i)[i % 5 * 4 :]
        b = b[len(b) // 2 :] + b[: len(b) // 2] if i % 7 == 0 else b
        assert fingerprints._distance(a, b) == edit(a, b)
        assert fingerprints.within(a, b) == (edit(a, b) <= fingerprints.bound(max(len(a), len(b))))


@pytest.mark.parametrize("find", [fingerprints.edit_copies, minhash.near_duplicates])
def test_a_doc_id_of_two_texts(spark, find):
    # One of the texts stands for it, whichever row comes first; its near copy is found, the other's isn't.
    a, b = prose(50, 300), prose(51, 300)
    rows = [(1, a, "x"), (1, b, "x"), (2, changed(a, 2, 1), "x"), (3, changed(b, 2, 1), "x"), (4, prose(52, 300), "x")]
    want = None
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = {r["doc_id"]: (r["group_id"], r["links"]) for r in find(documents(spark, order).coalesce(1)).collect()}
        assert sorted(got.values()) == [(1, 1), (1, 1), (3, 0), (4, 0)] or sorted(got.values()) == [(1, 1), (1, 1), (2, 0), (4, 0)]
        assert want in (None, got)
        want = got


def test_hot_bucket_of_texts_that_differ(spark):
    # 300 ids share one bucket; only neighbours of a chain are copies, and every tenth has none.
    members = spark.range(300).selectExpr("cast(7 as long) bucket", "id")
    kept = lambda pairs: pairs.where("b - a = 1 and a % 10 < 8")
    got = {r["id"]: (r["root"], r["links"]) for r in resolve(spark, members, kept, Stash(spark)).collect()}
    want = components(range(300), [(i, i + 1) for i in range(299) if i % 10 < 8])
    assert {i: got.get(i, (i, 0))[0] for i in range(300)} == want and got[0][1] == 1 and got[4][1] >= 1


def test_edit_copies_odd_rows(spark):
    got = {r["doc_id"]: r["group_id"] for r in fingerprints.edit_copies(odd(spark)).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and got[7] == 7 and not {4, 5} & set(got)
    assert fingerprints.edit_copies(empty(spark)).count() == 0


def test_lines_brute_force(spark):
    texts = [
        prose(1), prose(2), prose(1)[:60] + "x" + prose(1)[60:], prose(2).replace("ka", "kaa", 1), "short\nshort", prose(3),
        "\t" + prose(5) + " \t", prose(5), "Short \n\n" + prose(6), "\n\nshort\n", "shorx", (7, prose(8), "s"), (7, prose(9), "s"), (20, prose(8), "s"), (20, prose(9), "s"),
    ]
    df = documents(spark, texts)
    rows = df.selectExpr("doc_id", "xxhash64(text) h", "text").collect()
    lines_of = [(r["doc_id"], r["h"], p, x.strip(" \t\r\v\f").lower()) for r in rows for p, x in enumerate(r["text"].split("\n"))]
    lines_of = sorted(x for x in lines_of if x[3])

    def copy(x, y):
        return x == y or (min(len(x), len(y)) >= lines.MIN_CHARS and abs(len(x) - len(y)) <= 1 and edit(x, y) <= 1)

    want = {x[:3] for i, x in enumerate(lines_of) if any(copy(x[3], y[3]) for y in lines_of[:i])}
    assert {(r["doc_id"], r["h"], r["pos"]) for r in lines.dropped_lines(df).collect()} == want and len(want) > 40
    left = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(df).collect()}
    text = lambda r: "\n".join(x for p, x in enumerate(r["text"].split("\n")) if (r["doc_id"], r["h"], p) not in want)
    assert left == {(r["doc_id"], text(r)) for r in rows if text(r).strip()}


def test_variants_join_one_edit():
    a = "the quick brown fox"
    for b in (a[:-1], a + "s", a.replace("q", "k"), "x" + a, a):
        assert set(lines.variants(a)) & set(lines.variants(b))
    assert not set(lines.variants(a)) & set(lines.variants("the quack brawn fox"))


def test_lines_odd_rows(spark):
    out = lines.dedup_lines(odd(spark))
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert out.columns == odd(spark).columns and ids.count(1) == 2 and 2 not in ids and ids.count(None) == 2
    assert {4, 5, 6, 7, 8, 9} <= set(ids) and next(r for r in rows if r["doc_id"] == 4)["text"] is None
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert lines.dedup_lines(empty(spark)).count() == 0
