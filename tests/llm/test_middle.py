"""Fill-in-the-middle against regular expressions, on odd rows and around chunk ends."""

import hashlib
import re

import numpy as np
import pytest

from gleanery.llm import middle
from gleanery.llm.scratch import ship_package

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def wanted(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = np.random.default_rng(7)
    shared = " ".join("word%d" % k for k in rng.integers(0, 5000, 3000))
    odd = ["", " ", "a", " a", "a ", "\t a\n\nb  ", "x" * 20_000, " " * 20_000, "é" * 5000, "　 x 　", "<P> a b", "a <S>", "<M", "<<P", "a<", "S>b", "P><S"]
    return [None, *odd, *(" ".join(["fresh%d" % k, shared, "end"]) for k in range(40)), *("".join(rng.choice(list("ab é　\n\t<>PSM"), 300)) for _ in range(200))]


def test_transform_equals_regular_expressions(spark):
    ship_package(spark)
    rows = [(i, t, "x", 1.5, "y") for i, t in enumerate(texts())]
    rows += [rows[30], (None, "no id of its own", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, `a.b` double, output string").repartition(3)
    out = middle.transform(docs)
    assert out.columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.select("*", middle.restored(out.output, out.form).alias("back")).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == wanted(r.doc_id, r.text) and r.back == (r.text or "")
    assert middle.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cuts_lie_in_any_chunk(monkeypatch, seed):
    monkeypatch.setattr(middle, "CHUNK_BITS", 3)
    monkeypatch.setattr(middle, "LONGEST", 7)
    rng = np.random.default_rng(seed)
    for _ in range(300):
        text = "".join(rng.choice(list("abé  　\n"), rng.integers(1, 60)))
        units = TOKEN.findall(text)
        cuts = middle.TextCuts(text.encode(), middle.ChunkCache())
        assert cuts.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert cuts.place(k) == (len(head.encode()), len(head))


def test_shared_passages_are_summarised_once_and_memory_is_bounded():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 50_000).astype(np.uint8).tobytes()
    cache = middle.ChunkCache()
    for k in range(20):
        middle.TextCuts(rng.integers(97, 123, 300 + k).astype(np.uint8).tobytes() + passage, cache)
    assert cache.hits > 10 * cache.misses
    small = middle.ChunkCache(most=20_000)
    for _ in range(3):
        middle.TextCuts(passage, small)
        assert small.held + sum(map(len, small.old)) <= 20_000 + 2 * (middle.LONGEST + 200)
    ends = middle.chunk_ends(np.frombuffer(passage, np.uint8))
    assert ends[-1] == len(passage) and np.diff(ends, prepend=0).max() <= middle.LONGEST


def test_query_equals_sql(spark):
    from conftest import DATA, duck

    from gleanery.llm import registry

    rows = sorted(tuple(r) for r in registry.QUERIES["op12_fill_in_middle"](spark, DATA).collect())
    frame = duck(middle.OP12_SQL).astype(object)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert rows == sorted(tuple(r) for r in frame.where(frame.notna(), None)[names].values.tolist())
