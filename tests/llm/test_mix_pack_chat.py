"""Mixing, packing and chat templates."""

import math

import numpy as np
import pytest
from helpers import documents, empty, odd, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chat, mixing, packing
from lodestone.llm.template import TemplateError, compile_template, fold, parse


def sainte_lague(blocks, weights, seats):
    """Seats by highest quotient, one after another; a source without blocks left is passed over."""
    have = dict.fromkeys(blocks, 0)
    for _ in range(seats):
        left = [s for s in blocks if weights[s] and have[s] < blocks[s]]
        if left:
            have[max(left, key=lambda s: (weights[s] / (2 * have[s] + 1), s))] += 1
    return have


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 1, "b": 1, "c": 1, "d": 1}, {"a": 0.9, "b": 0.1}])
@pytest.mark.parametrize("share", [0.3, 0.9])
def test_quotas(spark, weights, share):
    # Sources of 40 to 900 words a document; the second weights are ties.
    texts = [(i, prose(i, 1500 if i % 3 else 300), "abc"[i % 3] if i % 7 else "d") for i in range(90)]
    rows = mixing.mark(documents(spark, texts), weights, share=share).toPandas()
    have = {s: max(1, -(-int(t) // mixing.BLOCK_TOKENS)) for s, t in rows.groupby("source").tokens.sum().items()}
    want = sainte_lague(have, {"c": 0, "d": 0} | weights, math.ceil(sum(have.values()) * share))
    got = rows[rows.picked].groupby("source").block.nunique().to_dict()
    there = rows.groupby("source").block.nunique().to_dict()
    for s in "abcd":  # a block without a first word has no row, and may be among the drawn ones
        assert want[s] - (have[s] - there[s]) <= got.get(s, 0) <= want[s]


def test_a_small_source_does_not_end_the_mix(spark):
    texts = [(i, prose(i, 1500), "ab"[i % 2]) for i in range(60)]
    share = lambda t: mixing.mark(documents(spark, t)).selectExpr("sum(if(picked, tokens, 0)) / sum(tokens)").first()[0]
    assert share(texts) > 0.85 and share([*texts, (99, prose(99, 20), "c")]) > 0.85


def test_mix_odd_rows(spark):
    out = mixing.mix(odd(spark))
    assert out.columns == odd(spark).columns and 0 < out.count() <= odd(spark).count()
    marks = mixing.mark(odd(spark))
    assert marks.count() == odd(spark).count() and marks.where("source = '(null)'").count() == 2
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(odd(spark), {}).count() == 0


def test_mix_is_stable(spark):
    d = documents(spark, [prose(i, 600) for i in range(40)])
    ids = lambda df: sorted(r["doc_id"] for r in mixing.mix(df).collect())
    assert ids(d) == ids(d.repartition(7).orderBy(F.rand(3)))


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), min_size=1, max_size=12))
def test_patterns(demand):
    sizes = np.array(sorted(demand), np.int64)
    d = np.array([demand[s] for s in sizes])
    cols, use, bound = packing.patterns(sizes, d, 32)
    assert (sum(c * u for c, u in zip(cols, use)) == d).all() and all((c * sizes).sum() <= 32 for c in cols)
    assert bound - 1e-6 <= use.sum() <= bound + len(sizes) + 1 and bound >= (sizes * d).sum() / 32 - 1e-6


def test_knapsack_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes, values, room = np.array([2, 3, 5]), rng.random(3), 11
        best = max(a * values[0] + b * values[1] + c * values[2] for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= room)
        v, n = packing.knapsack(values, sizes, room)
        assert abs(v - best) < 1e-9 and abs(n @ values - v) < 1e-9 and n @ sizes <= room


def test_pack_round_trip(spark):
    texts = [prose(i, 5 + 37 * i % 900) for i in range(60)]
    rows = packing.pack(documents(spark, texts), 256, 8).collect()
    pieces = {}
    for r in rows:
        w = r["text"].split()
        assert len(w) == r["n_tokens"] <= 256
        for k, (d, p, s) in enumerate(zip(r["doc_ids"], r["pieces"], r["starts"])):
            pieces[d, p] = w[s : r["starts"][k + 1] if k + 1 < len(r["starts"]) else None]
    for i, t in enumerate(texts, 1):
        own = sorted(p for d, p in pieces if d == i)
        assert own == list(range(len(own))) and sum((pieces[i, p] for p in own), []) == t.split()
    assert len(rows) <= 1.1 * sum(len(t.split()) for t in texts) / 256 + 32


def test_pack_odd_rows(spark):
    rows = packing.pack(odd(spark)).collect()
    ids = [d for r in rows for d in r["doc_ids"]]
    assert ids.count(1) == 2 and ids.count(None) == 1 and not {4, 5, 6} & set(ids) and ids.count(8) == -(-60_000 // packing.CAPACITY)
    assert packing.pack(empty(spark)).count() == 0


def test_template():
    t = compile_template("{% for m in xs -%}\n {{ m.a|upper }}{% if not loop.last %}, {% endif %}{% endfor %}{# note #}{% set y = 1 + 2 %}{{ y % 2 }}")
    assert t({"xs": [{"a": "x"}, {"a": "y"}]}) == ("X, Y1", [])
    assert compile_template("a{% generation %}{{ b }}{% endgeneration %}c")({"b": "xy"}) == ("axyc", [(1, 3)])
    assert fold(parse("{% if 1 == 1 %}a{{ 'b' ~ 'c' }}{% else %}{{ x }}{% endif %}d")) == [("text", "abcd")]
    assert compile_template("{{ x.y['z']|default('n') }}{{ 'a' in s }}")({"x": {"y": {}}, "s": "cat"})[0] == "ntrue"


@pytest.mark.parametrize("bad", ["{{ x( }}", "{% if x %}", "{% for x %}{% endfor %}", "{{ x.__class__() }}", "{% include 'x' %}", "{{ x|eval }}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}"])
def test_template_errors(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_template_is_a_sandbox():
    t = compile_template("{{ x.__class__ }}{{ x['__globals__'] }}{{ y.real }}")
    assert t({"x": "s", "y": 1})[0] == ""


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "user", "x"), (None, 0, "user", "y"), (1, 1, "assistant", "b"), (3, 0, "assistant", "z" * 500_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("messages", F.lit("x"))
    whole = chat.render_chats(df).collect()
    got = {r["conv_id"]: r for r in whole}
    assert sorted(r["text"] for r in whole if r["conv_id"] is None) == ["<|im_start|>user\nx<|im_end|>\n", "<|im_start|>user\ny<|im_end|>\n"]
    assert got[1]["text"] == "<|im_start|>user\na<|im_end|>\n" + "<|im_start|>assistant\nb<|im_end|>\n" * 2
    assert [got[1]["text"][a:b] for a, b in zip(got[1]["starts"], got[1]["ends"])] == ["b<|im_end|>"] * 2
    assert got[2]["text"] == "<|im_start|>user\n<|im_end|>\n" and None in got and got[3]["n_generated"] == 500_010
    assert chat.render_chats(df.limit(0)).count() == 0
