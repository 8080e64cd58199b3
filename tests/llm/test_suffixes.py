"""Repeated byte strings against brute force: overlaps, periodic and very long texts, groups of copies,
odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import suffixes
from gleanery.llm.scratch import ship_package


def brute(texts, length):
    """Kept bytes and spans of texts in order."""
    seen, out = set(), []
    for text in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out.append((bytes(np.frombuffer(text, np.uint8)[~gone]), edges.reshape(-1, 2).tolist()))
    return out


def corpus(rng):
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(18), prose(60)
    texts = [passage, passage, passage[1:], prose(30) + passage + prose(30), prose(5) + passage[40:] + prose(5), "x" * 700, "x" * 99, "x" * 100, "x" * 101, "ab" * 300, "abc" * 200, None, "", " "]
    texts += [prose(rng.integers(1, 12)) + line + prose(rng.integers(1, 12)) for _ in range(40)]
    edits = prose(120)
    for _ in range(40):
        at = int(rng.integers(0, len(edits)))
        texts.append(edits[:at] + "#" + edits[at + 1 :])
    repeated = prose(40)
    texts += [repeated + word() + repeated + word() + repeated, " ".join([prose(2000), line, prose(300), repeated])]
    return texts


@pytest.mark.parametrize("length, seed", [(100, 1), (16, 2), (3, 3)])
def test_kept_bytes_equal_brute_force(spark, length, seed):
    ship_package(spark)
    rng = np.random.default_rng(seed)
    texts = corpus(rng)
    ids = rng.permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in zip(ids, texts)], "doc_id long, text string, kept string, `a.place` string").repartition(5)
    out = suffixes.remove_repeats(docs, length=length)
    assert out.columns == ["doc_id", "a.place", "kept", "spans"]
    got = {r[0]: (bytes(r[2]), r[3]) for r in out.collect()}
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    assert len(got) == len(texts)
    for k, want in zip(order, brute([(texts[k] or "").encode() for k in order], length)):
        assert got[ids[k]] == want, texts[k]


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(4)
    a, b = ("".join(rng.choice(list("abcdefgh "), 300)) for _ in range(2))
    docs = spark.createDataFrame([(None, a), (1, a + b), (1, a + b), (1, a + b), (2, b)], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, len(r.kept)) for r in suffixes.remove_repeats(docs).collect())
    assert [g[0::2] for g in got] == [(False, 300), (True, 0), (True, 0), (True, 300), (True, 0)]
    none = suffixes.remove_repeats(docs.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "kept", "spans"]


def test_samples_are_chosen_by_content_alone():
    rng = np.random.default_rng(5)
    shared = rng.integers(97, 101, 150).astype(np.uint8)
    for _ in range(20):
        ranks = []
        for _ in range(2):
            data = np.concatenate([rng.integers(97, 101, rng.integers(0, 200)).astype(np.uint8), shared, rng.integers(97, 101, 50).astype(np.uint8)])
            start = int(np.flatnonzero([data[i : i + 150].tobytes() == shared.tobytes() for i in range(len(data) - 149)])[0])
            s = suffixes.Samples(data, np.array([0, len(data)]), 100)
            of = np.searchsorted(s.low, np.arange(start, start + 51), side="right") - 1
            ranks.append((s.rank[of].tolist(), (s.at[of] - start).tolist()))
        assert ranks[0] == ranks[1]


def test_long_texts_are_sampled_in_segments(monkeypatch):
    data = np.concatenate([np.random.default_rng(6).integers(97, 99, 3000).astype(np.uint8), np.full(500, 97, np.uint8)])
    whole = suffixes.Samples(data, np.array([0, 1000, 3500]), 100)
    monkeypatch.setattr(suffixes, "SEGMENT", 128)
    parts = suffixes.Samples(data, np.array([0, 1000, 3500]), 100)
    assert whole.at.tolist() == parts.at.tolist() and whole.high.tolist() == parts.high.tolist() and len(whole.at) > 400


def test_lists_of_ranks():
    column = pa.array([[1, 2], [], [-3]], pa.list_(pa.int64()))
    text, rank = np.array([0, 0, 1, 2, 2]), np.array([2, 3, 1, -3, 1], np.int64).view(np.uint64)
    assert suffixes._listed(text, rank, column).tolist() == [True, False, False, True, False]
    assert suffixes._listed(text[2:] - 1, rank[2:], column.slice(1)).tolist() == [False, True, False]


def test_query_equals_sql(spark):
    from conftest import DATA, duck

    from gleanery.llm import registry

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = registry.QUERIES["op13_suffix_array"](spark, DATA).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, duck(suffixes.OP13_SQL)[names].values.tolist()))
