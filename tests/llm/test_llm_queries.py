"""The opN_ queries and the pipeline's stages on a folder of small tables: folds, digests, odd columns,
long texts, ties."""

import math
import zlib

import numpy as np
import pytest
from test_llm_operators import text, words_of

from gleanery.llm import decontaminate, language, lattice, overlap, packing, registry, substrings
from gleanery.llm.scratch import ship_package

ROWS = [
    *((i, text(i, 5 + 7 * i % 90), ["en", "de", "fr", None][i % 4], f"s{i % 3}") for i in range(60)),
    (60, None, "en", "s0"), (61, "", "en", "s0"), (62, " \n", "de", None), (63, "1234 !!", "fr", "s1"), (64, text(3, 26), "en", "s1"), (65, text(3, 26), "en", "s1"),
    (66, text(900, 200) + " end", "de", "s2"), (67, text(900, 200) + " fin", "de", "s2"), (68, text(5000, 3000), "en", "s0"), (None, "no id at all", "en", "s0"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    ship_package(spark)
    path = tmp_path_factory.mktemp("tables").as_uri()
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, text(900, 40)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def fold(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def run(spark, folder, name):
    return registry.QUERIES[name](spark, folder).collect()


def test_op1(spark, folder):
    out = {r.doc_id: r for r in run(spark, folder, "op1_pitman_yor")}
    train: dict = {}
    for d, t, *_ in ROWS:
        if fold(d, 5) != 1:
            for w in [*words_of(t), None]:
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()), len(train)
    assert len(out) == len(ROWS)
    for d, t, *_ in ROWS:
        tokens = [*words_of(t), None]
        r = out[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d, 5) == 1, len(tokens), sum(w in train for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((train.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), abs_tol=1e-9) and r.score < 0
    assert out[64].score == out[65].score or out[64].held_out != out[65].held_out


def test_op2(spark, folder):
    out = run(spark, folder, "op2_shards")
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    per: dict = {}
    for r in out:
        per.setdefault(r.shard, []).append(r.slot)
    assert {r.law for r in out} == {"rows"} and {len(s) for s in per.values()} <= {len(ROWS) // 16, len(ROWS) // 16 + 1} and set(per) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and all(r.grown_shard is None for r in out)


def test_op3(spark, folder):
    found = {(r.doc_id, r.source_doc_id) for r in run(spark, folder, "op3_repeated_passages")}
    assert found == {(67, 66)}


def test_op5(spark):
    from conftest import DATA

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = run(spark, DATA, "op5_toxicity")
    assert len(out) == len(docs) and all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_op7(spark, folder):
    out = {r.doc_id: r for r in run(spark, folder, "op7_language")}
    assert len(out) == len(ROWS) and all(out[d].held_out == (fold(d, 4) == 2) for d, *_ in ROWS)
    learned = {lang for d, t, lang, _ in ROWS if lang and fold(d, 4) != 2}
    assert [out[d].lang_pred for d in (60, 61, 62, 63)] == ["und"] * 4 and {r.lang_pred for r in out.values()} <= learned | {"und"}
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_ties_go_to_the_commoner_language(spark):
    same = "one two three four five six"
    df = spark.createDataFrame([(same, "aa"), (same, "bb"), (same + " seven", "bb")], "text string, lang string")
    dictionaries = language.train_dictionaries(df)
    assert list(dictionaries) == ["bb", "aa"]
    equal = language.CompressionClassifier({"bb": b"one two three", "aa": b"one two three"})
    assert equal.judge("one two")[0] == "bb" and equal.judge("one two")[2]


def test_all_training_texts_teach_a_language(spark):
    """Each of 600 long texts has three words of its own, in all 1,800 words a language that no sample of them holds."""
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + k) for k in rng.integers(0, 26, 8)) for _ in range(3700)]
    filler, own = " ".join(words[3600:]), [words[3 * i : 3 * i + 3] for i in range(1200)]
    rows = [(f"{filler} {' '.join(w)} {filler}", ("aa", "bb")[i % 2]) for i, w in enumerate(own)]
    dictionaries = language.train_dictionaries(spark.createDataFrame(rows, "text string, lang string"))
    judge = language.CompressionClassifier(dictionaries).judge
    assert all(w.encode() in dictionaries[("aa", "bb")[i % 2]] for i, group in enumerate(own) for w in group)
    assert all(judge(" ".join(w for group in own[i : i + 20 : 2] for w in group))[0] == ("aa", "bb")[i % 2] for i in range(1180))
    assert all(len(d) <= language.DICTIONARY_BYTES for d in dictionaries.values())


def test_dictionaries_hold_the_commonest_words_last(spark, monkeypatch):
    monkeypatch.setattr(language, "DICTIONARY_BYTES", 20)
    long = "abcdefghijklmnopqrstuvwxyz"
    rows = [("one two two 3 four", "xx"), ("one two", "xx"), ("one, three", "xx"), (None, "xx"), ("--", "xx"), ("one", None), (long, "yy")]
    made = language.train_dictionaries(spark.createDataFrame(rows, "text string, lang string"))
    assert made["xx"] == b"three four two one " and made["yy"] == b"defg cdef bcde abcd "


def _mixed_languages():
    """900 texts of two languages, some of these shorter, and texts whose words are half of one, half of the other."""
    rng = np.random.default_rng(8)
    letters = rng.integers(0, 13, (400, 6))
    words = {lang: ["".join(chr(97 + low + k) for k in w) for w in letters.tolist()] for lang, low in (("aa", 0), ("bb", 13))}
    rows = [(i, " ".join(words[("aa", "bb")[i % 2]][k] for k in rng.integers(0, 400, 20 + i % 60)), ("aa", "bb")[i % 2]) for i in range(900)]
    some = [np.concatenate([rng.permutation(400) for _ in range(6)]) for _ in range(30)]
    return rows, [(900 + i, " ".join(words[lang][k] for p in zip(s, s[::-1]) for lang, k in zip(("aa", "bb"), p)), None) for i, s in enumerate(some)]


def test_narrow_margins_are_rejected(spark, tmp_path):
    rows, mixed = _mixed_languages()
    spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in run(spark, str(tmp_path), "op7_language")}
    assert all(out[d].lang_pred == lang and not out[d].rejected for d, _, lang in rows)
    assert sum(out[d].rejected for d, *_ in mixed) >= 25
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    dictionaries, narrow = language.train_with_margin(docs)
    assert dictionaries == language.train_dictionaries(docs) and narrow == language.NARROW  # too few held texts


def test_margin_that_held_texts_tell(spark, monkeypatch):
    """At most LOST of the right decisions are under it, and one more would be too many."""
    rows, _ = _mixed_languages()
    monkeypatch.setattr(language, "LOST", 0.05)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries, narrow = language.train_with_margin(df)
    held = [(r.lang, r.text) for r in language._teaching(df, "text", "lang").where("held").collect()]
    rest = language.train_dictionaries(language._teaching(df, "text", "lang").where("not held"))
    judge = language.CompressionClassifier(rest)
    right = [m for lang, text in held for got, m in [judge.decide(text)] if got == lang and m > 0]
    assert narrow > 0.02 and dictionaries == language.train_dictionaries(df)
    assert sum(m < narrow for m in right) <= 0.05 * len(right) < sum(m < narrow + language.STEP for m in right)


def test_stage_rejects_mixed_languages(spark, tmp_path):
    import corpus_pipeline

    rows, mixed = _mixed_languages()
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    left = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, str(tmp_path)).collect()}
    assert {d for d, *_ in rows} <= left and len(left) <= 905


def test_op8(spark, folder):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for d, x, *_ in ROWS:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(str(d), k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    out = run(spark, folder, "op8_best_fit")
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    per: dict = {}
    for r in out:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in per.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(per) <= packing.least_sequences({length: sum(w[3] == length for w in want) for length in {w[3] for w in want}}, 2048) + 1


def test_op6_op9_op10_have_a_row_for_each_document(spark, folder):
    pytest.importorskip("public_tokenizers")
    for name in ("op6_jaccard_join", "op9_decontaminate", "op10_token_files"):
        assert sorted(str(r.doc_id) for r in run(spark, folder, name)) == sorted(str(d) for d, *_ in ROWS), name


CLASHING = ["score", "rejected", "lang_pred", "_lang", "n_words", "hit_spans", "n_hit", "contaminated", "_spans", "spans", "component_id", "n_shingles", "c0", "c1", "set_id", "shard", "kind", "a.b", "odd name", "kept_id", "x_tie"]


def test_stages_keep_columns_of_any_name(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from pyspark.sql import functions as F

    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[name] == f"{k}:{'none' if r.doc_id is None else r.doc_id}" for r in rows for k, name in enumerate(CLASHING))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(ROWS)


def test_stages_on_empty_tables(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert all(stage(spark, docs, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_decisions(spark, folder):
    """What each stage must do to rows whose fate is known."""
    import corpus_pipeline

    stage = {name: f for name, f in corpus_pipeline.STAGES}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    every = {d for d, *_ in ROWS}
    assert every - ids(stage["language ID"](spark, docs, folder)) >= {60, 61, 62, 63}
    copies = every - ids(stage["n-gram Jaccard join"](spark, docs, folder))
    sets = {d: {tuple(words_of(t)[i : i + 5]) for i in range(max(1, len(words_of(t)) - 4))} if words_of(t) else set() for d, t, *_ in ROWS}
    near = {b for a in sets for b in sets if None not in (a, b) and a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert copies == near
    left = {r.doc_id: r.text for r in stage["substring dedup"](spark, docs, folder).collect()}
    assert left[66] == ROWS[66][1] and words_of(left[67]) == ["fin"] and all(left[d] == t for d, t, *_ in ROWS if d not in (60, 61, 62, 67))
    assert ids(stage["benchmark decontamination"](spark, docs, folder)) == every - {66, 67}


def test_texts_of_megabytes(spark):
    """A text that is more than a chunk, by itself and beside others, with a copy that has a new end."""
    rng = np.random.default_rng(3)
    long = " ".join(f"w{k}" for k in rng.integers(0, 10**9, 150_000))
    rows = [(1, long), (2, long + " more"), (3, "short one"), (4, None), (5, "a" * 2_000_000)]
    assert len(long) > 1_500_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in overlap.jaccard_components(docs).collect()}
    assert got == {1: (149_998, 1), 2: (149_999, 1), 3: (1, 3), 4: (0, 4), 5: (1, 5)}
    passages = substrings.repeated_passages(docs).collect()
    assert [(r.doc_id, r.source_doc_id, r.n_words) for r in passages] == [(2, 1, 150_000)]
    bench = spark.createDataFrame([(7, " ".join(long.split()[140_000:140_020]))], "item_id long, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.mark_contamination(docs, bench).collect()}
    assert hit == {1: (150_000, 20), 2: (150_001, 20), 3: (2, 0), 4: (0, 0), 5: (1, 0)}


def test_benchmark_of_several_sets(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{text(i, 30)} {text(700 + i % 5, 20)}") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, text(700 + k, 20)) for k in range(4)], "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "hit_items", "contaminated")
    whole = sorted(decontaminate.mark_contamination(docs, bench).select(*columns).collect())
    monkeypatch.setattr(decontaminate, "SET_WINDOWS", 8)
    assert sorted(decontaminate.mark_contamination(docs, bench).select(*columns).collect()) == whole and sum(r.n_hit == 20 for r in whole) == 16


def test_lattice_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], 0) for i in range(40)] + [(100, [0.98, 0.2], 0), (None, [1.0, 0.0], 0)]
    out = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(out[i].component_id == i % 2 and out[i].kept == (i < 2) for i in range(40))
    assert out[1].n_links == 20 + (1 if 0.98 / math.hypot(0.98, 0.2) >= 0.98 else 0) and out[0].n_links == 19
