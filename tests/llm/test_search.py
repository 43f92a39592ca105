"""Ranked search against the plain formula."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from check_oracle import compare, connect
from tests.conftest import SF
from xtalframe.llm import lexical_search
from xtalframe.llm.common import ship

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(words(t))
    out = []
    for i, asked in terms.items():
        found = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in asked
                if t in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def corpus(n=160):
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(40)] + ["Straße", "naïve", "日本", "X9"]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 30))) for _ in range(n)]
    texts[10:40] = [texts[3] + " w1 w2"] * 30  # copies: ties
    texts[50] = "w1,w2;W3_w4 " * 3000
    docs = [(n - k, t) for k, t in enumerate(texts)]
    docs += [(None, texts[3]), (None, "w5"), (7, None), (8, ""), (9, "w1"), (9, "w1"), (9, "w2 w3")]
    items = [(k, " ".join(rng.choice(vocab, rng.integers(1, 12)))) for k in range(25)]
    items += [(3, "w7 w8"), (3, "w7 w8"), (None, "w9 w10"), (30, None), (31, ""), (32, "nobody-has this"), (33, " ".join(vocab))]
    return docs, items


@pytest.mark.parametrize("top, pairs", [(5, 1 << 18), (20, 40)])
def test_ranks_and_ties(spark, top, pairs, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as TEXT", "2 as n")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id", "'y' as term")
    got = lexical_search.search(d, i, top=top, block_pairs=pairs).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == plain(docs, items, top)


def test_text_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, text string")
    i = spark.createDataFrame([("q", "Beta"), (None, "alpha")], "item_id string, text string")
    got = [tuple(r)[:3] for r in lexical_search.search(d, i).collect()]
    assert sorted(got, key=str) == [("q", 1, 2), ("q", 2, 1), (None, 1, 1)]
    assert lexical_search.search(d.limit(0), i).collect() == []
    assert lexical_search.search(d, i.limit(0)).collect() == []


def test_products_stay_exact():
    """Sums beyond 2**53 are whole when terms are cut; cuts follow the bound."""
    rng = np.random.default_rng(1)
    weight = np.full(3000, (1 << 53) // lexical_search.MOST_IMPACT // 7, np.int64) + rng.integers(0, 3, 3000)
    weight[5] = 0
    item = np.repeat(np.arange(4), 3000)
    term = np.tile(np.arange(3000), 4)
    (tile,) = lexical_search.tiles(item, term, weight, cells=1 << 20)
    assert len(tile.terms) == 2999 and len(lexical_search.tiles(item, term, weight, cells=1)) == 4
    cuts = tile.cuts()
    assert all(w.sum(1).max() * lexical_search.MOST_IMPACT < 1 << 53 for _, w in cuts) and len(cuts) > 400
    value = rng.integers(1, lexical_search.MOST_IMPACT, len(tile.terms))
    got = lexical_search.scores_of(cuts, tile.terms, 4, tile.terms, np.zeros(len(value), int), value, 1)
    assert got[:, 0].tolist() == [sum(int(weight[t]) * int(v) for t, v in zip(tile.terms, value))] * 4


def test_registered_against_sql(spark):
    assert compare(spark, connect(SF), "op12_lexical_search", SF) == ""
