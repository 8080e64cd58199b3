"""The training-data operators against brute force, and on nulls, ties and odd tables."""

import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import arrays, dac, decontaminate, language, lattice, overlap, packing, pitman_yor, sharding, substrings, toxicity
from gleanery.llm.components import connected_components
from gleanery.llm.scratch import materialise, ship_package

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 6))) for _ in range(n))


def documents():
    base = text(1, 150)
    near = base.split()
    near[75] = "other"
    passage = text(2, 60)
    texts = [base, base, " ".join(near), None, "", " \n\t", "One", "one two", "ONE two", "the " * 300, text(3, 40) + " " + passage + " " + text(4, 30), text(5, 20) + " " + passage, text(6, 5000), "Éa　b  c", "!!! ..."]
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "lost row of words", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_windows_equal_regular_expressions():
    texts = [t for _, t, *_ in documents()]
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(texts)})
    for size in (10, 1 << 20):
        got = []
        for _, data, offsets in arrays.text_chunks([batch], max_bytes=size):
            low = arrays.lower(data)
            starts, ends, first = arrays.find_words(low, offsets, arrays.BLANK_WORDS)
            found = [low[s:e].tobytes().decode() for s, e in zip(starts, ends)]
            got += [found[a:b] for a, b in zip(first[:-1], first[1:])]
        assert got == [words_of(t) for t in texts]


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (7, 6), (6, 9), (2, 1)]
    out = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(width, percent):
    rows = [(d, t) for d, t, *_ in documents()]
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    least = {p: min((rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None), default=None) for p in part}
    return sorted((str(rows[k][0]), len(sets[k]), least[part[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_jaccard_components(docs, empty, width, percent):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in overlap.jaccard_components(docs, width, percent).collect())
    assert got == jaccard(width, percent)
    assert overlap.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("hot, asks", [(64, 2), (64, 0), (5, 0)])
def test_jaccard_in_blocks(spark, monkeypatch, hot, asks):
    """Clusters of several blocks give the components of all pairs, whether their shingles are rare or
    common, and few or many of their sets are outside of the largest part; rows of a doc_id repeat."""
    monkeypatch.setattr(overlap, "ASKS", asks)
    monkeypatch.setattr(overlap, "BLOCK", 4 * 118)
    monkeypatch.setattr(overlap, "HOT", hot)
    monkeypatch.setattr(overlap, "FLUSH", 300)
    base = text(9, 120).split()
    rng = np.random.default_rng(0)
    rows = []
    for i in range(40):
        w = list(base)
        for k in rng.choice(120, rng.integers(1, 6), replace=False):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    again = rows + [rows[0]] * 200 + rows[5:9]
    got = {r.doc_id: r.component_id for r in overlap.jaccard_components(spark.createDataFrame(again, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for _, t in rows]
    part = list(range(40))
    for i in range(40):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    least = {p: part.index(p) for p in part}
    assert got == {i: least[part[i]] for i in range(40)}


def test_sets_of_common_shingles_ask_in_blocks_of_their_own(spark, monkeypatch):
    """Of 63 sets in one cluster the 15 without rare shingles, copies of two texts, are left when the other text's
    are asked about, in the four blocks that they fill and not in the cluster's."""
    for name, value in (("ASKS", 0), ("BLOCK", 4 * 118), ("HOT", 5)):
        monkeypatch.setattr(overlap, name, value)
    seen, plain = [], overlap._questions
    monkeypatch.setattr(overlap, "_questions", lambda rest: seen.append(plain(rest).count()) or plain(rest))
    base = text(9, 120).split()
    rows = []
    for i in range(63):
        w = list(base)
        for k in range(4 + i % 7, 116, 8) if i < 48 else [i]:
            w[k] = f"x{i}y{k}"
        for k in (5, 25, 100, 110) if i >= 56 else []:
            w[k] = f"z{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in overlap.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 48 else 48 if i < 56 else 56 for i in range(63)}
    assert 0 < seen[-1] <= 15 * 2 + 7 * 4


def test_rarest_shingles(spark, monkeypatch):
    """The places of shingles in order of their sets, those of one set first; of two sets of one doc_id, all that either has."""
    monkeypatch.setattr(overlap, "HOT", 4)
    monkeypatch.setattr(overlap, "FLUSH", 40)
    rng = np.random.default_rng(4)
    sets = [(i, i % 3, np.unique(rng.zipf(1.3, 30) % 500 + 1000 * (i % 2) * (rng.random(30) < 0.2)).astype(np.int64)) for i in range(40)]
    df = spark.createDataFrame([(i, g, len(h), h.tobytes()) for i, g, h in sets], "doc_id long, grp long, n long, shingles binary")
    count = {}
    for *_, h in sets:
        for x in h.tolist():
            count[x] = min(count.get(x, 0) + 1, 5)
    want = []
    for i, g, h in sets:
        order = sorted(h.tolist(), key=lambda x: (count[x], x))[: len(h) - -(-len(h) * 80 // 100) + 1]
        want += [(x, i, g, len(h), count[x]) for x in order if count[x] > 1]
    assert sorted(map(tuple, overlap.rarest_shingles(df, 80).collect())) == sorted(want)


def test_short_sets_share_no_signature_of_an_empty_part(spark):
    rows = [(i, text(i, 12 + i % 20)) for i in range(400)]
    rows += [(1000 + i, t + " more") for i, t in rows]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    links = overlap.candidate_links(overlap.part_signatures(got, 5, 80))
    assert overlap.connected_components(links).groupBy("component").count().agg({"count": "max"}).first()[0] == 2
    assert all(r.component_id == r.doc_id % 1000 for r in overlap.jaccard_components(got, 5, 80).collect())


@pytest.mark.parametrize("width, percent", [(1, 80), (1, 90), (2, 80)])
def test_jaccard_of_small_sets_with_scattered_differences(spark, width, percent):
    """Sets of few shingles, whose parts are often empty, with as many differences as a link allows."""
    rng, rows = np.random.default_rng(5), []
    for i in range(250):
        words = [f"w{k}" for k in rng.choice(100_000, rng.integers(3, 40), replace=False)]
        rows += [words, [*words[: len(words) - int(rng.integers(0, 3))], *(f"x{i}y{k}" for k in range(int(len(words) * 0.26)))]]
        rows.append([w if rng.random() < 0.93 else f"z{i}{w}" for w in words])
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i - i % 3, i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in overlap.jaccard_components(docs, width, percent).collect()}
    assert got == {i: part.index(p) for i, p in enumerate(part)}


def test_sets_that_differ_once_in_every_part_but_an_empty_one(spark):
    """44 words, none of which falls in one of the 12 parts of its level, and the same with 11 more words,
    one in each other part: the Jaccard similarity is 44 / 55."""
    level = int(np.searchsorted(tops := overlap.size_bands(60, 80), 44))
    m = int(overlap.level_parts(tops, 80)[level])

    def part(word):
        data = np.frombuffer(word.encode(), np.uint8)
        h = arrays.window_hashes(arrays.slice_hashes(data, np.array([0]), np.array([len(data)])), 1)[0]
        return int((arrays.mix(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32))

    words = {k: [w for w in (f"w{i}" for i in range(3000)) if part(w) == k][:10] for k in range(1, m)}
    more = [w.pop() for w in words.values()][:11]
    base = [words[1 + i % (m - 1)][i // (m - 1)] for i in range(44)]
    rows = [(0, " ".join(base)), (1, " ".join(base + more))]
    got = overlap.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80)
    assert len(more) == 11 and {r.component_id for r in got.collect()} == {0}


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(80)]
    index = overlap.DivideSkip(sets)
    for q in sets[:20]:
        for least in (1, 5, 20):
            want = [(i, len(np.intersect1d(q, s))) for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= least]
            assert index.search(q, least) == want


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(25):
        n, m, length = int(rng.integers(0, 50)), int(rng.integers(0, 30)), int(rng.integers(1, 9))
        h, want = arrays.mix(rng.integers(0, 25, n + m).astype(np.uint64)), set()
        for a, b in ((0, n), (n, n + m)):
            for i in range(a, b):
                for j in range(i + length - 1, b):
                    c = lo = hi = i + int(np.argmin(h[i : j + 1]))
                    while lo > a and h[lo - 1] > h[c]:
                        lo -= 1
                    while hi < b - 1 and h[hi + 1] >= h[c]:
                        hi += 1
                    want.add((lo, c, hi))
        assert sorted(zip(*(x.tolist() for x in substrings.compact_windows(h, np.array([0, n, n + m]), length)))) == sorted(want)


def test_repeated_passages(docs, empty):
    found = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(docs).collect()}
    assert {(1, 0), (2, 0), (11, 10)} <= found and {a for a, _ in found} <= {1, 2, 11}
    assert substrings.repeated_passages(empty).count() == 0
    left = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert 1 not in left and left[10].text == documents()[10][1] and words_of(left[11].text) == text(5, 20).split()
    assert left[11].n_chars == len(left[11].text) and substrings.remove_repeats(docs).columns == docs.columns


def test_passage_whose_line_the_source_repeats_earlier():
    def fresh(n):
        return rng.integers(0, 2**60, n).astype(np.uint64)

    rng = np.random.default_rng(0)
    p, q = fresh(60), fresh(56)
    a, b = np.concatenate([fresh(15), p, fresh(10)]), np.concatenate([fresh(20), p[28:32], fresh(200), p, fresh(30)])
    assert substrings.shared_passages(a, b) == [(15, 60, 224, 60, 1.0)]
    a, b = np.concatenate([fresh(15), q, fresh(10)]), np.concatenate([fresh(20), q[40:41], fresh(19), q, fresh(30)])
    assert substrings.shared_passages(a, b) == [(15, 56, 40, 56, 1.0)]
    same = np.full(300, 7, np.uint64)
    assert substrings.shared_passages(same, same) == [(0, 300, 0, 300, 1.0)]


def test_passages_around_a_line_that_all_documents_have(spark):
    line, rows = text(1000, 42), []
    for i in range(100):
        own = text(2000 + i, 10)
        rows += [(i, f"{text(3000 + i, 40)} {line} {own} {text(4000 + i, 40)}"), (100 + i, f"{text(5000 + i, 40)} {line} {own} {text(6000 + i, 40)}")]
    found = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {(100 + i, i) for i in range(100)} and len(found) >= 85


def test_all_partners_around_a_common_line_are_found(spark, monkeypatch):
    line, rows = text(1000, 42), []
    for i in range(150):
        own = text(2000 + i, 10)
        rows += [(i, f"{text(3000 + i, 40)} {line} {own} {text(4000 + i, 40)}"), (150 + i, f"{text(5000 + i, 40)} {line} {own} {text(6000 + i, 40)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(docs).collect()} == {(150 + i, i) for i in range(150)}
    monkeypatch.setattr(substrings, "FLUSH", 500)
    assert {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(docs).collect()} == {(150 + i, i) for i in range(150)}


def test_partners_that_share_common_words_only(spark):
    """Of 60 words, 25 documents have the first 40 and 25 others the last 40; two have all of them."""
    rows, want = [], set()
    for i in range(12):
        words = text(7000 + i, 60).split()
        parts = [words[:40]] * 25 + [words[20:]] * 25 + [words] * 2
        rows += [(100 * i + k, f"{text(100 * i + k, 30)} {' '.join(part)} {text(50_000 + 100 * i + k, 30)}") for k, part in enumerate(parts)]
        want.add((100 * i + 51, 100 * i + 50))
    rows += [(row[0], row[1]) for row in rows[50:52]]
    found = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want


def test_pairs_that_add_nothing_are_not_compared(spark):
    """60 documents repeat one word, each more often than the one before; the first document has too few of it."""
    rows = [(i, f"{text(60_000 + i, 40)} {' '.join(['word'] * (60 + i if i else 8))} {text(61_000 + i, 40)}") for i in range(61)]
    out = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered: dict[int, set[int]] = {}
    for r in out:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert set(covered) == set(range(2, 61)) and all(set(range(40, 100 + i)) <= words for i, words in covered.items())
    assert len({(r.doc_id, r.source_doc_id) for r in out}) <= 59 * (substrings.BEST + 2)


def test_texts_with_open_places():
    h = np.arange(200, dtype=np.uint64)
    spans = pa.array([[], [10, 190], [0, 200], [0, 50, 50, 200], [0, 40], [0, 200]], pa.list_(pa.int64()))
    known = h[10:190]
    assert substrings.open_texts([h] * 4 + [h[:40], h[:0]], known, spans) == [0]
    assert substrings.open_texts([h] * 2, known, pa.array([[10, 189], [11, 190]], pa.list_(pa.int64()))) == [0, 1]


def test_passages_that_add_no_place_are_left_out():
    a = np.arange(200, dtype=np.uint64)
    texts = [a[:100], a[50:], a[:100], a]
    index = substrings.shingle_index(texts)
    assert list(substrings.new_passages(a, np.ones(200, bool), texts, index)) == [(3, (0, 200, 0, 200, 1.0))]
    assert list(substrings.new_passages(a, np.arange(200) > 150, texts[:2], index)) == [(1, (50, 150, 0, 150, 1.0))]
    assert list(substrings.new_passages(a, np.zeros(200, bool), texts, index)) == []


def test_only_stretches_with_open_places_are_compared(monkeypatch):
    a, lengths, compare = np.arange(400, dtype=np.uint64), [], substrings.shared_passages
    texts = [np.concatenate([a[:100], a[100:200] + np.uint64(1000), a[300:]])]
    monkeypatch.setattr(substrings, "shared_passages", lambda x, y: lengths.append(len(x)) or compare(x, y))
    assert list(substrings.new_passages(a, np.arange(400) > 350, texts, substrings.shingle_index(texts))) == [(0, (300, 100, 200, 100, 1.0))]
    assert lengths == [100]


def test_meetings_grow_with_homes_not_with_pairs(spark):
    """40 documents of the same 20 runs, each with five of its own."""
    rows = [(run, d, 0, 60, 1) for d in range(40) for run in [*range(20), *range(1000 + 5 * d, 1005 + 5 * d)]]
    homes, asked = substrings.meetings(spark.createDataFrame(rows, "run long, doc_id long, low long, high long, open long"))
    assert homes.count() == asked.count() == 40 and homes.select("home").distinct().count() == 1


def test_rows_of_one_id_lose_only_what_their_own_text_repeats(spark):
    a, b, other, more = text(50, 120), text(51, 60), text(52, 200), text(53, 70)
    rows = [(1, a), (2, b + " " + a), (2, other), (2, "three short words"), (3, other), (4, more), (2, more), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r.doc_id or 0, r.text) for r in substrings.remove_repeats(docs).collect())
    assert [(d, t.strip()) for d, t in left] == sorted([(0, a), (1, a), (2, b), (2, other), (2, "three short words"), (2, more)])


def test_near_passages_are_found(spark):
    """Passages of 60 to 200 words with changed words, at similarities from 0.8 up, in texts that share
    nothing else and that all have one line of 30 words. Brute force knows what was planted."""
    rng, rows, want = np.random.default_rng(7), [], []
    line = text(99, 30)
    for i in range(150):
        passage = text(10_000 + i, int(rng.integers(60, 200))).split()
        other = [w if rng.random() > 0.02 else f"x{k}" for k, w in enumerate(passage)]
        grams = [{tuple(p[k : k + 5]) for k in range(len(p) - 4)} for p in (passage, other)]
        if len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1]):
            want.append((1000 + i, i))
        for d, p in ((i, passage), (1000 + i, other)):
            rows.append((d, f"{text(20_000 + d, 50)} {line} {text(30_000 + d, 20)} {' '.join(p)} {text(40_000 + d, 30)}"))
    found = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 60 and len(found & set(want)) >= 0.9 * len(want)
    assert all(a - b == 1000 for a, b in found)


def test_groups_that_exceed_a_piece(spark, docs, monkeypatch):
    """The links do not depend on how much a task holds at once."""
    rows = [(i, f"{text(i, 20)} {text(77, 60)} {text(500 + i, 20)}") for i in range(60)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(many).collect()}
    monkeypatch.setattr(substrings, "FLUSH", 25)
    parted = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(many).collect()}
    assert {a for a, _ in whole} == {a for a, _ in parted} == set(range(1, 60)) and {(i, 0) for i in range(1, 60)} <= whole & parted


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(text(2, 60).upper().split()[10:40])), (2, "one TWO"), (3, None), (4, ""), (None, "x"), (5, "zz zz")], "item_id long, text string")
    rows = {(r.doc_id, r.text): r for r in decontaminate.mark_contamination(docs, bench).collect()}
    by = {d: r for (d, _), r in rows.items()}
    assert (by[10].n_hit, by[10].hit_items, by[10].contaminated) == (30, ["1"], True)
    assert by[7].hit_items == by[8].hit_items == ["2"] and not by[3].contaminated and by[3].n_words == 0 and by[12].n_hit == 0
    assert decontaminate.mark_contamination(empty, bench).count() == 0
    assert decontaminate.mark_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.remove_contamination(docs, bench)
    assert kept.columns == docs.columns and not {7, 8, 10, 11} & {r.doc_id for r in kept.collect()}
    cut = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs, bench, action="span").collect()}
    assert len(words_of(cut[10])) == 100 and cut[3] is None


def test_shards_are_exact(spark, docs, empty):
    for df in (docs, empty, docs.withColumnRenamed("source", "shard"), spark.range(1000)):
        out = sharding.shuffle_into_shards(df, 7, 3, part_rows=20).toPandas()
        assert len(out) == df.count()
        sizes = out.groupby("shard").size() if len(out) else []
        assert not len(out) or max(sizes) - (min(sizes) if len(sizes) == 7 else 0) <= 1
        for _, g in out.groupby("shard") if len(out) else []:
            assert sorted(g["slot"]) == list(range(len(g)))
    m = sharding.communication_matrix(np.array([5, 0, 9]), np.array([7, 7]), 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9] and m.sum(axis=0).tolist() == [7, 7]


def test_matrix_of_billions_of_rows():
    m = sharding.communication_matrix(np.full(16, 10**9), np.full(16, 10**9), 3)
    assert (m.sum(axis=0) == 10**9).all() and (m.sum(axis=1) == 10**9).all()
    assert abs(m - 62_500_000).max() < 6 * 62_500_000**0.5


def test_large_hypergeometric_draws(monkeypatch):
    """Draws beyond numpy's limit against numpy's own, where both can be made, and against the mean and
    the variance where only they can."""
    rng = np.random.default_rng(0)
    monkeypatch.setattr(sharding, "_LIMIT", 10)
    for good, bad, draws in ((30, 50, 20), (5, 400, 60), (1000, 1000, 1999)):
        got = np.bincount([sharding.hypergeometric(rng, good, bad, draws) for _ in range(6000)], minlength=good + 1)
        want = np.bincount(rng.hypergeometric(good, bad, draws, 6000), minlength=good + 1)
        assert ((got - want) ** 2 / np.maximum(got + want, 1)).sum() < 2.5 * np.count_nonzero(got + want) + 20
    n = 10**12
    some = np.array([sharding.hypergeometric(rng, n, n, n) for _ in range(800)], float)
    assert abs(some.mean() - n / 2) < 5 * (n / 8 / 800) ** 0.5 and 0.8 < some.var() / (n / 8) < 1.25


def test_shuffle_is_uniform(spark):
    """Which shard a row gets does not depend on its place, copies included."""
    df = spark.range(1600).selectExpr("id % 8 as kind", "if(id % 3 = 0, 0, id) as v")
    out = [sharding.shuffle_into_shards(df, 4, seed, part_rows=100).groupBy("kind", "shard").count().collect() for seed in (1, 2, 3)]
    assert all(20 < r["count"] < 85 for rows in out for r in rows) and all(len(rows) == 32 for rows in out)


def test_lattice_links(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 32))
    near = a + 0.1 * rng.normal(size=a.shape)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(np.concatenate([a, near]))]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 32, 0), (205, [float("nan")] * 32, 0), (206, [1.0], 0), (207, [], 0), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links) for r in lattice.near_duplicates(df).collect())
    fine = [(k, np.array(v), y) for k, (_, v, y) in enumerate(rows) if v and y is not None and np.isfinite(v).all() and any(v)]
    n = dict.fromkeys(range(len(rows)), 0)
    for k, v, y in fine:
        for o, w, z in fine:
            n[k] += k != o and y == z and len(v) == len(w) and float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)) >= 0.98
    want = sorted((r[0], n[k]) for k, r in enumerate(rows))
    assert sum(x[1] for x in got) >= 0.9 * sum(x[1] for x in want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    out = dac.read_token_files(dac.write_token_files(docs, tmp_path.as_uri() + "/a", path, 2, False)).collect()
    t = Tokenizer.from_file(path)
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows]
    starts = np.cumsum([0] + [len(i) for i in ids])
    want = [(r[0], s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, s, i in zip(rows, starts, ids)]
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == sorted((s, d, n, c) for d, s, n, c in want)
    assert dac.read_token_files(dac.write_token_files(empty, tmp_path.as_uri() + "/b", path, 2, False)).count() == 0


@pytest.mark.parametrize("name, drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_the_librarys(name, drops):
    """Special tokens, in any case and beside anything, and blanks and marks of all kinds."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from gleanery.llm.tokens import PieceTokenizer

    plain, rng = Tokenizer.from_file(P.path(name)), np.random.default_rng(3)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "\n", "a", "it's", "B", "7", "...", "é", "\u3000", "\u00a0", "<", "|"]
    texts = ["hello <|endoftext|> world", "<|startoftext|>a  ", "  <|endoftext|>b", "", "<|endoftext|>", "x<|endof", "text|>y", *("".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(400))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, bounds = PieceTokenizer(P.path(name), drops).encode(data, np.cumsum([0] + [len(t.encode()) for t in texts]))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_directly_addressable_codes(monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT", 100)
    rng = np.random.default_rng(0)
    ids, sink = rng.integers(0, 70_000, 1234).astype(np.uint32), io.BytesIO()
    writer = dac.DacWriter(sink)
    writer.add([1, None], ids, np.array([1000, 234]))
    writer.close()
    reader = dac.DacReader(sink)
    assert [reader.get(i) for i in range(0, 1234, 13)] == ids[::13].tolist() and reader.doc_ids == [1, None]
    assert np.array_equal(np.concatenate(list(reader.documents())), ids)


def test_packing(docs, empty):
    pytest.importorskip("public_tokenizers")
    out = packing.pack_documents(docs).toPandas()
    assert len(out) >= len(documents()) and packing.pack_documents(empty).count() == 0
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and (g.length.cumsum() - g.length == g.offset).all()
    total = out.length.sum()
    assert out.sequence_id.nunique() <= -(-total // 2048) + 1
    for rule in ("norm", "dot"):
        cap = packing.Capacity(tokens=20, documents=3, attention=150, rule=rule)
        used: dict[int, list[int]] = {}
        for length, _, n, first, _ in packing.best_fit({1: 30, 7: 11, 12: 5}, cap):
            for b in range(first, first + n):
                used.setdefault(b, []).append(length)
        assert sum(map(len, used.values())) == 46
        assert all(sum(v) <= 20 and len(v) <= 3 and sum(x * x for x in v) <= 150 for v in used.values())


def test_language(spark, docs, empty):
    dictionaries = language.train_dictionaries(docs)
    assert set(dictionaries) == {"en", "de"}
    rows = {r.doc_id: r for r in language.identify_languages(docs, dictionaries).collect()}
    assert [rows[i].lang_pred for i in (3, 4, 5, 14)] == ["und"] * 4 and rows[0].lang_pred in ("en", "de") and rows[0].text == documents()[0][1]
    assert language.identify_languages(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language.train_dictionaries(empty) == {} and language.identify_languages(empty, dictionaries).count() == 0
    made = [(i, " ".join(["the of and", "der die und"][i % 2] + str(k) for k in range(30)), ["en", "de"][i % 2]) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    assert language.identify_languages(df, language.train_dictionaries(df.where("doc_id < 40"))).where("doc_id >= 40 and lang <> lang_pred").count() == 0


def test_pitman_yor(spark, docs, empty):
    from pyspark.sql import functions as F

    held = F.col("doc_id") % 4 == 1
    out = pitman_yor.score_documents(docs, held).collect()
    rows = documents()
    train = [t for d, t, *_ in rows if d is None or d % 4 != 1]
    counts: dict = {}
    for t in train:
        for w in [*words_of(t), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*words_of(t), None])
    assert sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6)) for r in out) == sorted((str(d), len(words_of(t)) + 1, round(base(t), 6)) for d, t, *_ in rows)
    assert {r.train_tokens for r in out} == {n} and all(r.score < 0 for r in out)
    assert pitman_yor.score_documents(empty, held).count() == 0


def test_seating_probabilities_sum_to_one():
    """Over all training dishes and the unknown one, in every context."""
    rng = np.random.default_rng(2)
    pairs = sorted({(int(w), int(c)) for w, c in zip(rng.integers(0, 9, 60), rng.choice(3, 60))})
    customers = rng.integers(1, 400, len(pairs))
    every = sorted({(w, c) for w in range(10) for c in range(3)})
    n = np.array([dict(zip(pairs, customers)).get(p, 0) for p in every])
    s = pitman_yor.Seating(np.array([p[0] for p in every]), np.array([p[1] for p in every]), n, np.array([7, 7, 200]), 10)
    totals = pitman_yor.Totals(s.totals()).with_contexts(*s.shares())
    for k in range(3):
        s.sweep(np.random.default_rng(k), totals)
        totals = pitman_yor.Totals(s.totals(), totals.discounts).with_contexts(*s.shares())
        assert all(((1 <= t) & (t <= c)).sum() == (c > 0).sum() for t, c in zip(s.t, s.c))
    p = s.probabilities(totals, 2)
    known = {w for w, c in pairs}
    for context in range(3):
        total = sum(x for x, (w, c) in zip(p, every) if c == context and w in known)
        unknown = next(x for x, (w, c) in zip(p, every) if c == context and w == 9)
        assert abs(total + unknown - 1) < 1e-9


def test_table_counts_follow_their_conditional():
    """Means of draws against the conditional from Stirling numbers, summed in plain Python."""
    c, d, others, parent = 6, 0.5, 4, 0.1
    s = [[0.0] * (c + 1) for _ in range(c + 1)]
    s[0][0] = 1.0
    for n in range(c):
        for t in range(c):
            s[n + 1][t + 1] += s[n][t]
            s[n + 1][t] += s[n][t] * (n - d * t)
    weights = [s[c][t] * np.prod([(pitman_yor.STRENGTH + d * (others + i)) * parent for i in range(t)]) for t in range(1, c + 1)]
    mean = sum(t * w for t, w in enumerate(weights, 1)) / sum(weights)
    m = 40_000
    got = pitman_yor.reseat(np.full(m, c), d, np.full(m, others), np.full(m, parent), np.random.default_rng(0)).mean()
    assert abs(got - mean) < 0.02


def test_scores_equal_a_dictionary_model(spark, monkeypatch):
    """The score of each text against a hierarchical Pitman-Yor model in dictionaries, with one table a
    dish (no sweeps), over several flushes and buckets."""
    monkeypatch.setattr(pitman_yor, "FLUSH_DOCS", 5)
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 200)
    monkeypatch.setattr(pitman_yor, "POSTINGS", 2)
    monkeypatch.setattr(pitman_yor, "BURN_IN", -1)
    monkeypatch.setattr(pitman_yor, "SAMPLES", 1)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["a", "bb", "cab", "dd", "Ea"], rng.integers(0, 12)))) for i in range(30)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(df, F.col("doc_id") % 5 == 1).collect()}
    end = "\0"
    tokens = {i: [*words_of(t), end] for i, t in rows}
    c = [{}, {}, {}]
    for i, of in tokens.items():
        if i % 5 != 1:
            for before, w in zip([end, *of], of):
                c[2][before, w] = c[2].get((before, w), 0) + 1
    for b, w in c[2]:
        c[1][b[-1], w] = c[1].get((b[-1], w), 0) + 1
    for _, w in c[1]:
        c[0]["", w] = c[0].get(("", w), 0) + 1
    discounts = [np.clip(sum(n == 1 for n in x.values()) / max(sum(n == 1 for n in x.values()) + 2 * sum(n == 2 for n in x.values()), 1), 0.1, 0.95) for x in c]

    def p(level, before, w):
        if level < 0:
            return 1 / (len(c[0]) + 1)
        u = ["", before[-1], before][level]
        mine = {x: n for (v, x), n in c[level].items() if v == u}
        d, t = discounts[level], len(mine)
        return (max(mine.get(w, 0) - d * (w in mine), 0) + (pitman_yor.STRENGTH + d * t) * p(level - 1, before, w)) / (pitman_yor.STRENGTH + sum(mine.values()))

    for i, of in tokens.items():
        want = sum(np.log10(p(2, b, w)) for b, w in zip([end, *of], of))
        assert abs(got[i] - want) < 1e-9, i


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(4)
    made = [(i, text(100 + i, 40) + (" vilestuff " if i % 2 else " ") + text(300 + i, int(rng.integers(1, 40)))) for i in range(560)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.train(toxicity.training_windows(df, labels))
    out = {r.doc_id: r.toxicity for r in toxicity.score_texts(df.where("doc_id >= 500"), net).collect()}
    order = sorted(out, key=out.get)
    assert sum(i % 2 for i in order[30:]) >= 24
    odd = {r.doc_id: r.toxicity for r in toxicity.score_texts(docs, net).collect()}
    assert odd[3] == odd[4] == odd[5] == 0.0 and all(0 <= x <= 1 for x in odd.values())
    assert toxicity.score_texts(empty, net).count() == 0


def test_all_labelled_documents_set_the_threshold(spark, monkeypatch):
    from pyspark.sql import functions as F

    ids = range(16_000)
    docs = spark.createDataFrame([(i, "a") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    read = []

    def scored(some, net):
        read.append(some.count())
        return some.withColumn("toxicity", F.when(F.col("toxic") == 1, F.lit(0.4)).otherwise(F.lit(0.2)))

    monkeypatch.setattr(toxicity, "score_texts", scored)
    net = toxicity.set_threshold(toxicity.ToxicityNetwork(np.zeros(0, np.uint64), np.zeros(0, np.uint64)), docs, labels)
    assert read[0] == docs.where("pmod(xxhash64(doc_id, 1), 4) = 0").count() > 3_000
    assert abs(net.p["bias"][0] + (np.log(0.2 / 0.8) + np.log(0.4 / 0.6)) / 2) < 0.01


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.ToxicityNetwork(np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs = (np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([0, 1, 1]), np.array([1.0, 0.5, 1.0]))
    index, mask, label = rng.integers(0, 3, (4, 6)), np.arange(6) < np.array([[6], [3], [1], [5]]), np.array([1.0, 0, 1, 0])

    def loss():
        logit, made = net.forward(net.embed(*inputs).astype(np.float64), index, mask, keep=True)
        return np.log1p(np.exp(logit)).sum() - (label * logit).sum(), logit, made

    _, logit, made = loss()
    g = net.gradients(net.embed(*inputs), index, mask, made, toxicity._sigmoid(logit) - label, inputs)
    for name in ("out", "query", "attend", "hf", "hb", "xf", "cb"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        net.p[name][at] += 1e-3
        up = loss()[0]
        net.p[name][at] -= 2e-3
        down = loss()[0]
        net.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-2 * max(1, abs(g[name][at])), name


def test_pipeline(spark):
    import corpus_pipeline
    from conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ship_package(spark)
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, DATA))
        assert out.columns == docs.columns and 0.7 * n <= out.count() <= n
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
