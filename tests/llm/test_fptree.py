"""Ranked search against brute force: ties, copies, odd rows, several sets of items, exact bounds."""

import math
import re

import numpy as np
import pytest

from gleanery.llm import fptree
from gleanery.llm.scratch import ship_package

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=10):
    split = lambda t: [w.translate(FOLD) for w in TERM.findall(t or "")]
    bags = [(d, split(t)) for d, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    df: dict = {}
    for _, b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    merged: dict = {}
    for i, t in items:
        if i is not None:
            merged.setdefault(i, set()).update(split(t))
    out = []
    for i, terms in merged.items():
        scores = []
        for d, b in bags:
            m = 100 - 90 + (90 * len(b) * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * b.count(w)) // (1000 * b.count(w) + 8 * m)) for w in terms & set(b))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out)


def corpus(seed, n=400):
    rng = np.random.default_rng(seed)
    words = ["W%d" % k for k in range(150)] + ["é%d" % k for k in range(10)]
    weights = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(0, 60), p=weights / weights.sum())) for _ in range(n)]
    texts += [texts[3]] * 80 + [None, "", " !! ", "w0", "unknown words only", "a" * 5000 + " w1", "w2 " * 4000]
    return texts, rng


@pytest.mark.parametrize("seed, set_terms", [(1, 500_000), (2, 20)])
def test_ranks_equal_brute_force(spark, seed, set_terms, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(fptree, "SET_TERMS", set_terms)
    texts, rng = corpus(seed)
    docs = [*enumerate(texts), (3, "w5 w6 w7"), (None, texts[5]), (None, "w9 w9 W9 é3")]
    items = [(10 * k, " ".join(rng.choice(["w%d" % x for x in range(160)] + ["É1", "é2,é3", "none"], 12))) for k in range(25)]
    items += [(7, None), (8, "..."), (None, "w1"), (10, "w99 é4"), (9, texts[3])]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, `score.x` string").repartition(3)
    got = sorted(map(tuple, fptree.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == brute(docs, items)


def test_nothing_to_search_or_find(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "a c")], "item_id string, text string")
    one = fptree.rank_documents(docs, items)
    assert one.columns == ["item_id", "rank", "doc_id", "score"] and [tuple(r) for r in one.collect()] == brute([(1, "a b")], [("x", "a c")])
    assert fptree.rank_documents(docs.limit(0), items).count() == 0 and fptree.rank_documents(docs, items.limit(0)).count() == 0
    assert fptree.rank_documents(docs, spark.createDataFrame([("y", "zz")], "item_id string, text string")).count() == 0


@pytest.mark.parametrize("levels, leaf", [(32, 64), (3, 4), (1, 1)])
def test_trees_are_pruned_without_a_loss(monkeypatch, levels, leaf):
    monkeypatch.setattr(fptree, "LEVELS", levels)
    monkeypatch.setattr(fptree, "LEAF", leaf)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 600)
    terms = np.concatenate([np.sort(rng.choice(80, s, replace=False, p=np.arange(80, 0, -1) / 3240)) for s in sizes])
    tfs = rng.integers(1, 9, len(terms))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    m, ids = rng.integers(10, 300, len(sizes)), rng.permutation(len(sizes))
    tree = fptree.DocumentTree(ids, m, bounds, terms.astype(np.int32), tfs.astype(np.int32))
    assert tree.leaves[-1] == 600 and (np.diff(tree.leaves) <= max(leaf, 1)).all()
    weights = np.arange(1, 81) * 50
    looked = 0
    for _ in range(40):
        asked = np.sort(rng.choice(80, 8, replace=False))
        exact = {}
        for d in range(len(sizes)):
            own = dict(zip(terms[bounds[d] : bounds[d + 1]].tolist(), tfs[bounds[d] : bounds[d + 1]].tolist()))
            exact[int(ids[d])] = sum(int(weights[t]) * ((10**9 * own[t]) // (1000 * own[t] + 8 * int(m[d]))) for t in asked.tolist() if t in own)
        want = sorted(((s, i) for i, s in exact.items() if s > 0), key=lambda x: (-x[0], x[1]))[:10]
        found, leaves = tree.search(asked, weights[asked], np.zeros(81, np.int64), 10)
        assert found == want
        looked += leaves
    assert leaf == 64 or looked < 0.7 * 40 * (len(tree.leaves) - 1)


def test_norms_do_not_overflow():
    n, documents, total = np.array([1, 10**7]), 10**11, 10**14
    assert fptree.norms(n, documents, total).tolist() == [10 + 90 * x * documents // total for x in (1, 10**7)]


def test_query_equals_sql(spark):
    from conftest import DATA, duck

    from gleanery.llm import registry

    names = ["item_id", "rank", "doc_id", "score"]
    got = registry.QUERIES["op11_ranked_search"](spark, DATA).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, duck(fptree.OP11_SQL)[names].values.tolist()))
