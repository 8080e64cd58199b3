"""Boundaries and ties of operators, on rows written here."""

import math

import pytest
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.functions.text import balanced_json, concept_slug
from gleanery.operators import discovery, health, landing, learning, queues, ranking, vectors


def test_entities_are_replaced_in_order(spark):
    df = spark.createDataFrame([("<p>a&amp;lt;b</p><script>x<y</script>",), (None,)], "html string")
    assert [r[0] for r in df.select(landing.plain_text(df.html)).collect()] == ["a<b", None]


def test_empty_guid_does_not_fall_through(spark):
    raw = spark.createDataFrame([("f", "", "l", None, "c", 1), ("f", None, "l", "e", "c", 2), ("f", None, "l", "e2", "c", 3), ("g", "x", None, None, "c", 4)], "feed_id string, guid string, link string, encoded string, content string, pos long")
    feeds = spark.createDataFrame([("f", True), ("g", False)], "feed_id string, active boolean")
    out = landing.land_items(raw, feeds, raw.limit(0)).collect()
    assert [(r.guid, r.content, r.pos) for r in out] == [("l", "e", 2)]


def test_silence_at_the_threshold_is_not_dead(spark):
    rows = [("a", 14.0, 0.0), ("b", 14.0001, 0.0), ("c", None, 0.0), ("d", 1.0, -0.4), ("e", 1.0, -0.41)]
    df = spark.createDataFrame(rows, "feed_id string, silence double, credibility double").selectExpr(
        "*", "timestamp '2023-01-01' as created_at", "cast(null as double) as near_dup_rate", "0D as source_pref", "14D as dead_after", "true as cadence_known"
    )
    got = {r.feed_id: r.reasons for r in health.evaluate_feeds(df).collect()}
    assert got == {"a": [], "b": ["dead"], "c": ["dead"], "d": [], "e": ["low_credibility"]}


def test_claim_needs_a_positive_share(spark):
    with pytest.raises(ValueError):
        queues.claim_work(None, None, None, per_feed=0, max_rows=1)


def test_oversize_text_is_a_batch_of_its_own(spark):
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate([10, 3000, 1, 2999, 1, 5000, 1])], "queue string, id long, tokens long")
    assert [r.batch for r in queues.token_batches(df).orderBy("id").collect()] == [0, 1, 2, 2, 3, 4, 5]


def test_mastery_is_the_fold(spark):
    rows = [("t", "c", i, ["easy", "medium", "hard", "odd"][i % 4], i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "tenant string, concept_key string, attempt_id long, difficulty string, is_correct boolean").selectExpr("*", "timestamp '2024-01-01' as created_at")
    m = K.PRIOR_MASTERY
    for *_, level, right in rows:
        up, down = K.ALPHAS.get(level, K.ALPHAS["medium"])
        m += (up if right else down) * (right - m)
    got = learning.mastery_fold(df).first()
    assert math.isclose(got.mastery, m, rel_tol=1e-9) and got.attempts == 40


def test_deck_skips_duplicates_and_caps_sources(spark):
    e = [[1.0, 0.0], [math.cos(0.5), math.sin(0.5)], [0.0, 1.0]]  # cos 0.5 is over 0.86
    rows = [(1, i, "f", e[i % 3] if i < 3 else None, 1.0, 0.5, 10.0 - i) for i in range(6)] + [(1, 9, "g", None, 1.0, 0.5, 0.0)]
    cands = spark.createDataFrame(rows, "tenant long, article_id long, feed_id string, vec array<double>, pref double, recency double, value double")
    seeds = spark.createDataFrame([], "tenant long, feed_id string, vec array<double>, pref double, judged boolean")
    out = ranking.pick_decks(cands, seeds).orderBy("place").collect()
    assert [r.article_id for r in out] == [0, 2, 3, 9, 4, 5] and {r.deduped for r in out} == {2}


def test_explore_picks_keep_the_cap_of_a_source_and_the_order_of_values(spark):
    schema = "tenant long, article_id long, feed_id string, vec array<double>, pref double, recency double, value double"
    rows = [(1, 1, "f", None, 0.0, 0.9, 5.0), (1, 2, "g", None, 0.1, 0.8, 3.0), (1, 3, "h", None, 0.1, 0.8, 4.0), (1, 4, "i", None, 2.0, 0.1, 9.0)]
    seeds = spark.createDataFrame([(1, "f", None, 3.0, True)] * 3, "tenant long, feed_id string, vec array<double>, pref double, judged boolean")
    out = ranking.pick_decks(spark.createDataFrame(rows, schema), seeds).orderBy("place").collect()
    # f has its three already: neither explore nor value takes it; of two as recent the better one comes first
    assert [(r.article_id, r.reason) for r in out] == [(3, "explore"), (2, "explore"), (4, "value"), (1, "fill")]


def _deck_by_hand(cands, seeds):
    """The three passes of a deck, pick by pick, over plain rows."""
    near = lambda a, b: a is not None and b is not None and sum(x * y for x, y in zip(a, b)) >= K.DUPLICATE_COSINE
    feeds, vecs, picks = [s[0] for s in seeds], [s[1] for s in seeds], []
    need = K.DECK_SIZE - len(seeds)
    explored = sum(abs(s[2]) <= K.NEUTRAL_BAND and not s[3] for s in seeds)
    ranked = sorted(cands, key=lambda c: (-c[5], c[0]))
    neutral = sorted((c for c in ranked if abs(c[3]) <= K.NEUTRAL_BAND), key=lambda c: -c[4])
    room = max(0, min(K.DECK_EXPLORE - explored, need)) if any(c[3] for c in cands) else 0
    for rows, most, capped in ((neutral, room, True), (ranked, need, True), (ranked, need, False)):
        taken = 0
        for c in rows:
            if len(picks) >= need or taken >= most:
                break
            if c[0] in picks or (capped and feeds.count(c[1]) >= K.DECK_PER_SOURCE) or any(near(c[2], v) for v in vecs):
                continue
            picks.append(c[0])
            feeds.append(c[1])
            vecs.append(c[2])
            taken += 1
    return picks


def test_decks_equal_picks_by_hand(spark):
    import random

    rng = random.Random(4)
    cands, seeds, want = [], [], {}
    for tenant in range(12):
        unit = lambda: (lambda t: [math.cos(t), math.sin(t)])(rng.random() * 6.3)
        mine = [(k, f"f{rng.randrange(4)}", unit() if rng.random() < 0.5 else None, rng.choice([0.0, 0.2, -0.4, 1.5]), rng.randrange(9) / 10, float(rng.randrange(20))) for k in range(30)]
        old = [(f"f{rng.randrange(4)}", unit() if rng.random() < 0.3 else None, rng.choice([0.0, 2.0]), rng.random() < 0.5) for _ in range(rng.randrange(5))]
        cands += [(tenant, *c) for c in mine]
        seeds += [(tenant, *s) for s in old]
        want[tenant] = _deck_by_hand(mine, old)
    c = spark.createDataFrame(cands, "tenant long, article_id long, feed_id string, vec array<double>, pref double, recency double, value double")
    s = spark.createDataFrame(seeds, "tenant long, feed_id string, vec array<double>, pref double, judged boolean")
    got: dict = {}
    for r in ranking.pick_decks(c, s).orderBy("tenant", "place").collect():
        got.setdefault(r.tenant, []).append(r.article_id)
    assert got == want


def test_zero_vectors_are_like_nothing(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([1.0, 0.0], [2.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(df.a, df.b)).collect()] == [0.0, 0.0, 1.0, None]


def test_urls(spark):
    cases = {
        "HTTP://WWW.Example.com/a/?b=2&utm_source=x&a=1#f": "http://example.com/a?a=1&b=2", "https://e.com": "https://e.com/", "ftp://e.com/": None, "mailto:x": None,
        "https://e.com/a//?": "https://e.com/a", "https://e.com:443/x?ref_src=tw&utm_id=1&flag": "https://e.com/x?flag=&utm_id=1", "http://e.com:8080/": "http://e.com:8080/",
        "http://[2001:DB8::1]:80/a/": "http://[2001:db8::1]/a", "http://e.com:443/": "http://e.com:443/",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r[0]: r[1] for r in df.select("url", discovery.canonical_url(df.url)).collect()} == cases
    bad = ["http://127.0.0.1/", "http://172.16.0.1/", "http://[::1]/", "http://a.internal/", "file:///x", "http://[::ffff:10.1.2.3]/", "http://[::ffff:7f00:1]/", "http://[fe90::1]/"]
    good = ["http://172.32.0.1/", "http://100.63.0.1/", "https://e.com/", "http://[::ffff:8.8.8.8]/", "http://[::ffff:808:808]/", "http://224.0.0.1/", "http://[2001:db8::1]/"]
    df = spark.createDataFrame([(u,) for u in bad + good], "url string")
    assert [r[0] is None for r in df.select(discovery.rejection(df.url)).collect()] == [False] * len(bad) + [True] * len(good)
    assert df.where(discovery.rejection(df.url, reserved=True) == "private address").where("url = 'http://224.0.0.1/'").count() == 1


def test_domains_of_their_own(spark):
    cases = {"thezvi.substack.com": "thezvi.substack.com", "a.b.github.io": "b.github.io", "www.bbc.co.uk": "bbc.co.uk", "x.y.example.com": "example.com", "github.io": "github.io", "a.co.kr": "co.kr"}
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    assert {r[0]: r[1] for r in df.select("host", discovery.registrable(df.host)).collect()} == cases


def test_evidence_leaves_out_platforms_and_own_links(spark):
    links = [("http://s.com/1", "https://twitter.com/u"), ("http://s.com/1", "http://s.com/2"), ("http://s.com/1", "http://blog.new.dev/2024/01/x"), ("http://t.com/1", "https://new.dev/"), (None, "https://www.odd.io/notes"), ("http://s.com/1", "http://w.ghost.io/")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(links)], "page_id long, source_url string, target_url string")
    out = {r.domain: r for r in discovery.gate_domains(discovery.domain_evidence(df, spark.createDataFrame([], "domain string"))).collect()}
    assert set(out) == {"new.dev", "odd.io", "w.ghost.io"}
    assert (out["new.dev"].sources, out["new.dev"].main_host, out["new.dev"].site, out["new.dev"].blog_score) == (2, "blog.new.dev", "http://blog.new.dev", 2)
    assert out["odd.io"].sources == 0 and not out["odd.io"].passes and out["w.ghost.io"].blog_score == 2 and out["w.ghost.io"].passes


def test_discovered_feeds_land_once(spark):
    found = spark.createDataFrame([("a", "u1", 1), ("a", "u2", 2), ("b", "u1", 3), ("c", "u3", 4), ("d", "u4", 5), ("e", "u5", 6)], "domain string, url string, pos long")
    feeds, known = spark.createDataFrame([("c",)], "domain string"), spark.createDataFrame([("d", "x"), ("z", "u5")], "domain string, url string")
    out = discovery.land_discovered(found, feeds, known)
    assert [r.outcome for r in out.orderBy("pos").collect()] == ["inserted", "candidate", "same url", "existing", "candidate", "same url"]
    assert discovery.landing_counts(out).first().asDict() == {"discovered": 6, "inserted": 1, "skipped_existing": 1, "skipped_candidate": 2}


def test_feed_links_of_a_page(spark):
    html = '<link rel="alternate" type="application/rss+xml" href="f.xml"><link type="application/atom+xml" rel=alternate href="http://10.0.0.1/x"><link rel="alternate" href="/no">'
    out = discovery.feed_links(spark.createDataFrame([(1, "http://h.com/a/b", html)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [r.feed_url for r in out][:2] == ["http://h.com/f.xml", "http://h.com/feed"] and len(out) == 14


def test_body_windows(spark):
    texts = [(i, f" {'word ' * n}x{'y' * 300}z" if i % 2 else "w " * n) for i, n in enumerate((10, 40, 300, 700, 2000))]
    out = {r.source_id: r for r in learning.body_windows(spark.createDataFrame(texts, "source_id long, text string"), 200, 7).collect()}
    for i, t in texts:
        start, body = out[i].start, out[i].body
        if len(t) <= 200:
            assert (start, body) == (0, t)
        else:
            assert body == t[start : start + 200].strip() and (start == 0 or t[start - 1] == " " or " " not in t[start : start + 199])


def test_learn_sources(spark):
    long = "<p>" + "text " * 40 + "</p>"
    rows = [("b", 1, "http://e.com/a", long), ("b", 2, "http://www.e.com/a/", long), ("b", 3, "http://e.com/b", "<p>short</p>"), ("b", 4, "http://e.com/c", "<a href='x'>" + "link " * 40 + "</a>"),
            ("b", 5, "nothing", long), ("b", 6, "http://e.com/late", long), ("c", 1, "http://k.com/", long)]
    known = spark.createDataFrame([("http://k.com/",)], "key string")
    out = discovery.validate_learn_sources(spark.createDataFrame(rows, "batch string, pos long, url string, html string"), known, chars=100)
    assert [(r.batch, r.outcome) for r in out.orderBy("batch", "pos").collect()] == [("b", "inserted"), ("b", "known"), ("b", "short"), ("b", "links"), ("b", "invalid"), ("c", "known")]


def test_guards(spark):
    one = spark.createDataFrame([(-1, 5, 5, None, 0)], "prune_remaining long, fetch_results long, fetch_failed long, embed_skip_reason string, embedded_recent long").withColumns(
        {"embed_waiting": F.lit(3), "embed_pending": F.lit(3), "embed_eligible": F.lit(0)}
    )
    fails = {r.guard for r in queues.run_guards(one).where("fails").collect()}
    assert fails == {"prune_stalled", "all_failed", "embed_stalled", "embed_gate_stuck"}
    full = one.withColumns({"embed_skip_reason": F.lit("disk_ceiling"), "prune_remaining": F.lit(0)})
    assert {r.guard for r in queues.run_guards(full).where("fails").collect()} == {"all_failed"}


def test_script_blocks_end_at_their_own_tag(spark):
    df = spark.createDataFrame([("<script>a</style>b</script>c<STYLE x>d</Style >e</style>f",)], "html string")
    assert df.select(landing.plain_text(df.html)).first()[0] == "c f"


def test_links_resolve(spark):
    cases = {"/x": "http://h.com/x", "y": "http://h.com/a/y", "//o.com/z": "http://o.com/z", "#f": None, "mailto:q": None, "https://p.com": "https://p.com"}
    df = spark.createDataFrame([(h, "http://h.com/a/b") for h in cases], "href string, base string")
    assert {r[0]: r[1] for r in df.select("href", discovery.resolve(df.href, df.base)).collect()} == cases


def test_model_text(spark):
    df = spark.createDataFrame([('so: {"a": "}"} ok',), ('{"a": ',), ("[1, 2] and",), (None,)], "t string")
    assert [r[0] for r in df.select(balanced_json("t")).collect()] == ['{"a": "}"}', None, "[1, 2]", None]
    df = spark.createDataFrame([("ＡＢ c!",), ("  ",)], "t string")
    assert [r[0] for r in df.select(concept_slug("t")).collect()] == ["ab-c", ""]


def test_streams_equal_batches(spark):
    from conftest import DATA, duck, rows_of

    from gleanery.plans import registry

    for name in ("s2_stream_preferences", "s3_stream_mastery"):
        assert rows_of(registry.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck(registry.ORACLE_SQL[name]))


def _next_fit(tokens, budget, most):
    out, batch, used, n = [], 0, 0, 0
    for t in tokens:
        if n and (used + t > budget or n + 1 > most):
            batch, used, n = batch + 1, 0, 0
        used, n = used + t, n + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("seed, most, block", [(0, 5, 3), (1, 4, 7), (2, 128, 50), (3, 1, 4)])
def test_batches_in_blocks_equal_the_fold(spark, monkeypatch, seed, most, block):
    import numpy as np

    monkeypatch.setattr(queues, "BLOCK_TEXTS", block)
    rng = np.random.default_rng(seed)
    rows = [(q, int(i), int(t)) for q, n in (("a", 400), ("b", 7), (None, 60), ("c", 1)) for i, t in zip(rng.permutation(n), rng.choice([0, 1, 3, 9, 12, 40], n))]
    got = queues.token_batches(spark.createDataFrame(rows, "queue string, id long, tokens long").repartition(5), budget=20, most=most).collect()
    assert len(got) == len(rows)
    for q in ("a", "b", None, "c"):
        mine = sorted((r.id, r.tokens, r.batch) for r in got if r.queue == q)
        assert [m[2] for m in mine] == _next_fit([m[1] for m in mine], 20, most)


def test_one_long_queue_is_many_tasks(spark):
    df = spark.range(1_000_000).selectExpr("'q' as queue", "id", "pmod(hash(id), 700) as tokens")
    batches = queues.token_batches(df)
    got = batches.toPandas().sort_values("id")
    assert got["batch"].tolist() == _next_fit(got["tokens"].tolist(), 3000, 128)
    sizes = batches.withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 900_000


def _failures(spark, types):
    rows = [(1, k, t) for k, t in enumerate(types)] + [(2, 99, "refusal")]
    return spark.createDataFrame(rows, "round_id long, item_id long, error_type string")


def test_outages_are_not_charged(spark):
    free = ["rate_limit_error", "overloaded_error", "api_error", "timeout_error", "authentication_error", "billing_error", "connection_error", "401", "429", "500", "503", "529"]
    charged = ["invalid_request_error", "permission_error", "not_found_error", "rate_limit", "400", "403", "499", "", None]
    results = spark.createDataFrame([(1, "succeeded"), (1, "errored"), (2, "errored")], "round_id long, outcome string")
    got = {r.item_id: r.charged for r in queues.attribute_failures(_failures(spark, free + charged), results).collect()}
    assert [got[k] for k in range(len(free) + len(charged))] == [False] * len(free) + [True] * len(charged) and got[99] is False


def _table(spark, tmp_path, schema="k long, v string"):
    from gleanery.sources.partitions import PartitionTable

    return PartitionTable(spark, (tmp_path / "t").as_uri(), schema, "day")


def test_a_run_that_dies_leaves_the_old_deck(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path, ranking.DECK_SCHEMA)
    deck = lambda *rows: spark.createDataFrame([(t, a, 1, 0.5) for t, a in rows], ranking.DECK_SCHEMA)
    read = lambda: sorted((r.day, r.tenant, r.article_id) for r in table.read().collect())
    assert read() == []
    ranking.save_decks(table, "2024-01-30", deck((1, 10), (2, 20)))
    ranking.save_decks(table, "2024-01-31", deck((1, 11), (1, 12), (2, 21)))
    before = [("2024-01-30", 1, 10), ("2024-01-30", 2, 20), ("2024-01-31", 1, 11), ("2024-01-31", 1, 12), ("2024-01-31", 2, 21)]
    assert read() == before

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # between writing the rows and letting them count
        m.setattr(type(table), "publish", die)
        with pytest.raises(RuntimeError):
            ranking.save_decks(table, "2024-01-31", deck((1, 99)))
    assert read() == before
    ranking.save_decks(table, "2024-01-31", deck((1, 99)).limit(0))
    assert read() == before
    ranking.save_decks(table, "2024-01-31", deck((1, 13)))
    after = [*before[:2], ("2024-01-31", 1, 13), ("2024-01-31", 2, 21)]
    assert read() == after
    table.sweep()
    assert read() == after and len(list((tmp_path / "t/data").glob("day=*/version=*"))) == 2


def test_pruning_leaves_young_partitions_alone(spark, tmp_path):
    table = _table(spark, tmp_path, "article_id long, published_at timestamp, embedding array<float>")
    rows = spark.range(40).selectExpr("id as article_id", "timestamp '2024-01-31 00:00:00' - make_dt_interval(id) - interval 6 hours as published_at", "array(1f) as embedding")
    rows = rows.union(spark.sql("select 100L, cast(null as timestamp), array(2f)")).union(spark.sql("select 101L, timestamp '2023-12-27 00:00:00', array(2f)"))
    table.load(rows.withColumn("day", F.coalesce(F.to_date("published_at").cast("string"), F.lit("none"))))
    files = lambda: {p.relative_to(tmp_path).as_posix() for p in (tmp_path / "t/data").rglob("part-*.parquet")}
    before, versions = files(), table.versions()
    assert landing.prune_vector_partitions(table) == (6, 36)
    left = table.versions()
    assert set(versions) - set(left) == {d for d in versions if d == "none" or d < "2023-12-27"}
    young = {d: v for d, v in versions.items() if "2023-12-27" < d < "none"}
    kept = {f for f in before if any(f"day={d}/version={v}" in f for d, v in young.items())}
    assert len(young) == 34 and all(left[d] == v for d, v in young.items()) and len(kept) == 34 and kept <= files()
    assert all("day=2024-01-30/" in f for f in table.read(["2024-01-30"]).inputFiles())
    plan = table.read().where("day = '2024-01-30'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert landing.prune_vector_partitions(table) == (0, 36)


def test_commands_of_one_log_fold_into_feeds_candidates_and_cards(spark):
    feeds = spark.createDataFrame([("u1", True, "One", 0.5), ("u2", False, "Two", 0.0), ("u3", True, "Three", 1.0)], "url string, active boolean, title string, credibility double")
    candidates = spark.createDataFrame([("c1", "u4", "Four", -0.3, "pending"), ("c2", "u1", "Uno", 9.0, "pending"), ("c3", "u3", "Tres", 0.3, "pending"), ("c4", "u5", "Five", 0.1, "pending")], "candidate_id string, url string, title string, credibility double, status string")
    cards = spark.createDataFrame([("k1", "pending"), ("k2", "pending"), ("k3", "approved")], "card_id string, status string")
    log = [
        ("candidate", "c1", "approve"), ("candidate", "c2", "approve"), ("feed", "u3", "delete"), ("candidate", "c3", "approve"), ("candidate", "c4", "approve"), ("candidate", "c4", "reject"),
        ("feed", "u1", "deactivate"), ("feed", "u1", "add"), ("feed", "u2", "activate"), ("feed", "u6", "deactivate"), ("feed", "u6", "add"), ("feed", "u7", "add"), ("feed", "u7", "delete"),
        ("feed", "u4", "deactivate"), ("card", "k1", "approve"), ("card", "k1", "reject"), ("card", "k2", "approve"), ("card", "none", "approve"), ("candidate", "none", "approve"),
    ]
    commands = spark.createDataFrame([(*c, k // 4, k) for k, c in enumerate(log)], "target string, key string, command string, ts long, seq long")
    f, c, k = landing.registry_fold(feeds, candidates, cards, commands)
    # u1 stays off: adding what is there does nothing. u3 is new after its deletion. u4 is off after its approval.
    assert sorted(map(tuple, f.select("url", "active", "title", "credibility", "kept").collect())) == [
        ("u1", False, "One", 0.5, True), ("u2", True, "Two", 0.0, True), ("u3", True, "Tres", 0.3, False), ("u4", False, "Four", -0.3, False),
        ("u5", True, "Five", 0.1, False), ("u6", True, None, 0.0, False),
    ]
    assert sorted((r.candidate_id, r.status) for r in c.collect()) == [("c1", "approved"), ("c2", "approved"), ("c3", "approved"), ("c4", "rejected")]
    assert sorted((r.card_id, r.status) for r in k.collect()) == [("k1", "rejected"), ("k2", "approved"), ("k3", "approved")]


def _fed(spark, folder, schema, batches):
    """A stream of files, one a micro-batch, in the order of the batches."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/x{k}")
        (part,) = (folder / f"x{k}").glob("part-*.parquet")
        (folder / "in").mkdir(exist_ok=True)
        part.rename(folder / "in" / f"{k}.parquet")
        os.utime(folder / "in" / f"{k}.parquet", (time.time() - 100 + k,) * 2)
    plain = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(plain).option("maxFilesPerTrigger", 1).parquet((folder / "in").as_uri())


def test_late_copies_inside_the_bound_are_dropped_and_state_is_bounded(spark, tmp_path):
    from datetime import datetime, timedelta

    from gleanery.streaming import jobs

    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [[("f", f"k{h}-{i}", None, at(h)) for i in range(20)] + [("f", f"k{h - 1}-0", None, at(h - 1.5))] for h in range(2, 30)]
    rows.append([("f", "k2-0", None, at(29.5)), ("f", None, "k29-0", at(29)), ("f", "", "k", at(29)), ("f", None, None, at(29))])
    stream = _fed(spark, tmp_path, "feed_id string, guid string, link string, seen_at timestamp", rows)
    query = jobs.run_to_table(jobs.stream_first_copies(stream), (tmp_path / "out").as_uri(), (tmp_path / "state").as_uri())
    got = [(r.guid, r.seen_at) for r in spark.read.parquet((tmp_path / "out").as_uri()).collect()]
    # copies one batch late are dropped, but for the first batch's, whose first copy is not in the stream; k2-0 is forgotten after 27 hours
    assert len(got) == 28 * 20 + 2 and sum(g == "k2-0" for g, _ in got) == 2 and sum(g == "k29-0" for g, _ in got) == 1
    held = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert held and max(held) <= 7 * 20


def test_silence_is_told_once_when_its_time_comes(spark, tmp_path):
    from datetime import datetime, timedelta

    from gleanery.streaming import jobs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [
        [("a", "made", at(0)), ("b", "made", at(0)), ("c", "made", at(5)), ("b", "fetched", at(10)), ("", "tick", at(20))],
        [("b", "failed", at(21)), ("", "tick", at(25))],  # a is silent since 0
        [("b", "fetched", at(30)), ("c", "fetched", at(28)), ("", "tick", at(40))],  # b and c were in time
        [("a", "fetched", at(41)), ("", "tick", at(60))],  # b and c are silent since 30 and 28
        [("c", "failed", at(61)), ("", "tick", at(66))],  # a is silent again, since 41
    ]
    stream = _fed(spark, tmp_path, "feed_id string, kind string, at timestamp", batches)
    jobs.run_to_table(jobs.stream_silent_feeds(stream), (tmp_path / "out").as_uri(), (tmp_path / "state").as_uri())
    got = sorted((r.feed_id, r.last_seen) for r in spark.read.parquet((tmp_path / "out").as_uri()).collect())
    assert got == [("a", at(0)), ("a", at(41)), ("b", at(30)), ("c", at(28))]


@pytest.mark.parametrize("other_group", [None, True])
def test_earlier_maximum_in_blocks_of_time_equals_all_pairs(spark, monkeypatch, other_group):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(int(i), f"g{i % 3}", float(o), rng.normal(size=4).tolist()) for i, o in enumerate(rng.choice([-np.inf, 1.0, 1.0, 2.0, 5.0, *range(10, 40)], 300))]
    rows += [(900, "g0", 3.0, [0.0] * 4), (901, "g1", 4.0, [1.0] * 3)]
    schema = "id long, grp string, ord double, v array<double>"
    few, df = spark.createDataFrame(rows[:150] + rows[-2:], schema), spark.createDataFrame(rows, schema)

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if len(a) == len(b) and n else 0.0

    want = {}
    for i, g, o, v in rows[:150] + rows[-2:]:
        found = [cos(v, w) for j, h, p, w in rows if p < o and not (other_group and g == h)]
        want[i] = max(found) if found else None
    for size in (2000, 20):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", size)
        got = {r.id: r.best for r in vectors.earlier_maximum(few, df, other_group).collect()}
        assert set(got) == set(want) and all((got[i] is None) == (want[i] is None) and (got[i] is None or math.isclose(got[i], want[i], abs_tol=1e-9)) for i in want)

    def products(a, b):
        import pandas as pd

        return pd.DataFrame({"id": a["id"], "best": np.full(len(a), float(len(b)))})

    distinct = spark.range(600).selectExpr("id", "'g' as grp", "cast(id as double) as ord", "array(1d) as v")
    count = lambda f: f(distinct, distinct, products, "id long, best double", [F.sum("best").alias("n")]).agg(F.sum("n")).first()[0]
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    assert count(vectors.blocked) == 600 * 600 and count(vectors.blocked_by_order) <= 0.55 * 600 * 600


def test_model_rows_of_three_kinds_are_typed_and_the_rest_dropped(spark):
    import json

    card = {"type": "qa", "front": "f", "back": 7, "source_quote": " q ", "concept_tag": "c"}
    cloze = {"type": "cloze", "cloze_text": "a {{c1::b}}", "source_quote": "q"}
    choice = {"stem": " s ", "choices": ["a ", "b", "c", " d"], "answer_index": 3, "explanation": "e", "source_quote": "q", "concept_label": "k", "difficulty": "odd"}
    bad = [5, "qa", None, [card], {"type": "other", "source_quote": "q"}, {**card, "source_quote": "  "}, {**choice, "choices": ["a", "b", " ", "d"]}, {**choice, "choices": ["a", "b", "c"]},
           {**choice, "choices": ["a", "b", "c", 4]}, {**choice, "answer_index": 4}, {**choice, "answer_index": 1.5}, {**choice, "answer_index": "1"}, {**choice, "stem": ""}, {**choice, "explanation": 1}]
    texts = [(1, json.dumps([card, cloze, choice, *bad])), (2, "Here: ```json " + json.dumps(choice) + "``` done"), (3, '[{"type": "qa"'), (4, None), (5, "[]")]
    got = sorted((r.id, r.pos, r.kind, r.quote, r.front, r.back, r.cloze_text, r.concept, r.stem, r.choices, r.answer, r.difficulty) for r in learning.land_model_rows(spark.createDataFrame(texts, "id long, text string")).collect())
    made = ("choice", "q", None, None, None, "k", "s", ["a", "b", "c", "d"], 3, "medium")
    assert got == [(1, 0, "qa", "q", "f", None, None, "c", None, None, None, None), (1, 1, "cloze", "q", None, None, "a {{c1::b}}", None, None, None, None, None), (1, 2, *made), (2, 0, *made)]


def test_cards_need_what_their_kind_shows(spark):
    rows = [(1, "qa", "f", "b", None), (2, "qa", " ", "b", None), (3, "qa", "f", None, None), (4, "cloze", None, None, "a {{c1::b::hint}} c {{c2::d}}"), (5, "cloze", None, None, "{{c1:: }} x"),
            (6, "cloze", "f", "b", None), (7, "cloze", None, None, "no mark"), (8, "cloze", None, None, "{{cx::b}}")]
    df = spark.createDataFrame(rows, "k long, kind string, front string, back string, cloze_text string")
    got = {r.k: (r.ok, r.target) for r in df.select("k", learning.card_format_ok().alias("ok"), learning.card_target().alias("target")).collect()}
    assert {k for k, (ok, _) in got.items() if ok} == {1, 4} and got[1][1] == "f b" and got[4][1] == "a b c d"


def test_folding_mends_quotes(spark):
    body = "He said: “It’s a long—very long—way…” and ＡＢＣ１２３ went home at last."
    quotes = [(1, 'it\'s a long-very long-way..." and abc123'), (2, "it was a short way, and nobody went home"), (3, "went home at last.")]
    df = spark.createDataFrame([(k, q, 1, q) for k, q in quotes], "id long, quote string, source long, target string")
    got = {r.id: (r.reason, r.fixable) for r in learning.ground_quotes(df, spark.createDataFrame([(1, body)], "source long, body string"), 0).collect()}
    assert got == {1: ("not_verbatim", True), 2: ("not_verbatim", False), 3: ("too_short", False)}


def test_selections_that_can_not_be_read(spark):
    fine = '{"mode": "batch", "ids": ["a", "b"], "lease_deadline": "t"}'
    cases = [(fine, None), (None, "selection"), ("x", "selection"), ("[]", "selection"), ('"batch"', "selection"), ("{}", "mode"), ('{"mode": "sync"}', "mode"), ('{"mode": 1}', "mode"),
             ('{"mode": "batch"}', "ids"), ('{"mode": "batch", "ids": []}', "ids"), ('{"mode": "batch", "ids": ["a", null]}', "ids"), ('{"mode": "batch", "ids": ["a", 1], "lease_deadline": "t"}', "ids"),
             ('{"mode": "batch", "ids": ["a"]}', "lease_deadline"), ('{"mode": "batch", "ids": ["a"], "lease_deadline": ""}', "lease_deadline"), ('{"mode": "batch", "ids": ["a"], "lease_deadline": 5}', "lease_deadline")]
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(cases)], "k long, s string")
    got = {r.k: r.p for r in df.select("k", queues.selection_problem(F.col("s")).alias("p")).collect()}
    assert [got[k] for k in range(len(cases))] == [p for _, p in cases]


def test_best_articles_by_thresholds_equal_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    n = 400
    articles = spark.createDataFrame([(i, f"f{i % 7}") for i in range(n)], "article_id long, feed_id string").selectExpr("*", "if(article_id % 11 = 0, null, timestamp '2024-01-31 00:00:00' - make_dt_interval(0, cast(article_id * 37 % 200 as int))) as published_at")
    tags = spark.createDataFrame([(int(i), f"t{int(t)}") for i in range(n) if i % 5 for t in rng.choice(12, rng.integers(1, 4), replace=False)], "article_id long, tag string")
    prefs = [(u, "tag", f"t{t}", float(np.round(rng.normal(), 1))) for u in range(20) for t in rng.choice(14, 5, replace=False)] + [(u, "source", f"f{f}", float(np.round(rng.normal(), 1))) for u in range(20) for f in rng.choice(9, 3, replace=False)]
    prefs = spark.createDataFrame([*prefs, (50, "source", "none", 1.0), (51, "tag", "t1", -9.0)], "tenant long, kind string, pref_key string, weight double")
    feeds = spark.createDataFrame([(f"f{k}", [0.0, 0.5, -0.3][k % 3]) for k in range(6)], "feed_id string, credibility double")
    for k in (3, 10):
        got = ranking.top_articles(articles, tags, prefs, feeds, k)
        full = ranking.score_articles(articles, tags, prefs, feeds).withColumn("score", F.round("score", 6)).join(articles.select("article_id", "published_at"), "article_id")
        want = full.selectExpr("tenant", "article_id", "score", "row_number() over (partition by tenant order by score desc, published_at desc nulls last, article_id) as place").where(f"place <= {k}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    few = ranking.top_articles(articles.where("article_id < 4"), tags, prefs, feeds, 10)
    assert few.groupBy("tenant").count().select("count").distinct().first()[0] == 4


def test_scores_of_pairs_that_do_not_move(spark):
    """Tags and preferences that repeat, nulls and unknown keys count as in a plain loop, and no pair of tenant and article is shuffled."""
    import re

    articles = [(i, [None, "f0", "f1", "f2"][i % 4]) for i in range(30)] + [(None, "f1"), (3, "f2")]
    tags = [(i, f"t{i % 3}") for i in range(0, 30, 2)] + [(2, "t2"), (4, "t0"), (6, None), (None, "t1")]
    prefs = [(1, "tag", "t0", 1.0), (1, "tag", "t0", 0.5), (1, "tag", "t2", -2.0), (1, "source", "f0", 0.25), (2, "source", "f1", 4.0), (2, "source", "f1", 5.0), (2, "tag", "t1", None), (None, "tag", "t0", 9.0), (3, "other", "t0", 7.0)]
    feeds = [("f0", 0.5), ("f2", None), (None, 3.0)]
    frames = (("article_id long, feed_id string", articles), ("article_id long, tag string", tags), ("tenant long, kind string, pref_key string, weight double", prefs), ("feed_id string, credibility double", feeds))
    a, t, p, f = (spark.createDataFrame(rows, schema) for schema, rows in frames)
    a = a.withColumn("published_at", F.expr("if(article_id % 5 = 0, null, timestamp '2024-01-31 00:00:00' - make_dt_interval(0, cast(article_id * 37 % 200 as int)))"))
    out = ranking.score_articles(a, t, p, f)
    want = []
    for i, feed in articles:
        for tenant in (1, 2, 3, None):
            by_tag = sum(w or 0 for j, tag in tags for u, kind, key, w in prefs if None not in (i, tag, tenant) and i == j and u == tenant and kind == "tag" and key == tag)
            sources = [w for u, kind, key, w in prefs if None not in (tenant, feed) and u == tenant and kind == "source" and key == feed] or [0]
            fresh = 0.0 if i is None or i % 5 == 0 else 0.5 ** (i * 37 % 200 / 24)
            for w in sources:
                credible = sum(c or 0 for g, c in feeds if feed is not None and g == feed)
                want.append((str(tenant), str(i), str(feed), round(fresh, 5), round(by_tag + w, 5), round(fresh + by_tag + w + credible, 5)))
    got = [(str(r.tenant), str(r.article_id), str(r.feed_id), round(r.recency, 5), round(r["pref"], 5), round(r.score, 5)) for r in out.collect()]
    assert sorted(got) == sorted(want)
    three = ("recency", "pref", "score")
    rounded = out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in three}).collect()
    assert sorted(map(repr, ranking.score_articles(a, t, p, f, digits=6).collect())) == sorted(map(repr, rounded))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*tenant#[^)]*article_id#", plan)
    assert ranking.score_articles(a.limit(0), t, p, f).count() == 0 and ranking.score_articles(a, t, p.limit(0), f).count() == 0


@pytest.mark.parametrize("rows_of_block, tile, threshold", [(5, (3, 4), 0.2), (2000, (1000, 4000), 0.2), (5, (3, 4), -0.5)])
def test_pairs_are_made_where_blocks_meet(spark, monkeypatch, rows_of_block, tile, threshold):
    """Null ids, vectors and groups, vectors of other lengths and zero ones, in blocks and tiles of any size; no pair is sent."""
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK_ROWS", rows_of_block)
    monkeypatch.setattr(vectors, "PAIR_BLOCKS", 4)
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3 + (i % 9 == 0)).round(2).tolist() if i % 13 else [0.0] * 3, [None, "x", "y"][i % 3], i) for i in range(60)]
    rows += [(7, None, "z", 7), (8, [1.0, 0.0, 0.5], "x", 8), (None, [1.0, 1.0, 1.0], "x", 1), (61, [], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, grp string, ord long")
    found = vectors.pairs_over(df, threshold)
    assert found._jdf.queryExecution().executedPlan().toString().split("\n")[1].strip().startswith("+- MapInArrow")
    want = []
    for i, v, *_ in rows:
        for j, w, *_ in rows:
            if None not in (i, j, v, w) and i < j:
                s = 0.0
                if len(v) == len(w) and any(v) and any(w):
                    s = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
                if s >= threshold:
                    want += [(i, j, round(s, 6), None if None in (g, h) else g == h) for a, _, g, _ in rows if a == i for b, _, h, _ in rows if b == j]
    assert sorted(map(repr, ((r.a, r.b, round(r.similarity, 6) + 0.0, r.same) for r in found.collect()))) == sorted(map(repr, want))
    assert vectors.pairs_over(df.limit(0), threshold).count() == 0


def test_band_is_one_pass(spark, tmp_path):
    """Ties go by ids; the pairs are read once, and none is sent but the best of a task."""
    rows = [(i, i + 1 + k, round(0.2 + (i * 7 + k) % 20 / 50, 6), (None, True, False)[i % 3]) for i in range(40) for k in range(5)]
    pairs = spark.createDataFrame(rows, "a long, b long, similarity double, same boolean")
    pairs.write.parquet(f"{tmp_path}/pairs")
    top = vectors.pairs_in_band(spark.read.parquet(f"{tmp_path}/pairs"), 0.3, 0.5, 7)
    assert top._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    band = sorted((-s, a, b, same) for a, b, s, same in rows if 0.3 <= s <= 0.5)
    assert sorted((-r.similarity, r.a, r.b, r.same) for r in top.collect()) == band[:7] and {r.total for r in top.collect()} == {len(band)}
    assert vectors.pairs_in_band(pairs, 2.0, 3.0).count() == 0


def _state_rows(spark, folder):
    return spark.read.format("statestore").option("stateVarName", "rows").load(folder).count()


def test_preferences_of_micro_batches(spark, tmp_path, monkeypatch):
    """Judgements of several batches, out of order within one, with null tenants: deltas add up to the last
    judgements' weights after each batch, and the store has a row a bucket, not a key."""
    import random

    from gleanery.streaming import jobs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    monkeypatch.setattr(jobs, "BUCKETS", 5)
    random.seed(4)
    rows = [(i, random.choice([None, 1, 2, 2**53 + 1]), random.choice([None, *range(9)]), random.choice(["open", "useful", "dismiss"]), f"2024-01-0{1 + i // 100} 00:00:{random.randrange(60):02}", [f"k{random.randrange(5)}", "all"][: random.randrange(3)]) for i in range(300)]
    batches = [rows[:100], rows[100:200], rows[200:]]
    stream = _fed(spark, tmp_path, "event_id long, tenant long, article_id long, action string, created_at string, keys array<string>", batches)
    stream = stream.withColumn("created_at", F.col("created_at").cast("timestamp"))
    jobs.run_to_table(jobs.stream_preferences(stream), (tmp_path / "out").as_uri(), (tmp_path / "state").as_uri())
    deltas = spark.read.parquet((tmp_path / "out").as_uri()).collect()
    assert {r.batch for r in deltas} == {0, 1, 2} and _state_rows(spark, (tmp_path / "state").as_uri()) <= 5
    last = {}
    for k, batch in enumerate(batches):
        for _, tenant, article, action, _, keys in sorted(batch, key=lambda r: (r[4], r[0])):
            last[tenant, article] = (K.FEEDBACK_WEIGHTS[action], keys)
        want, got = {}, {}
        for (tenant, _), (weight, keys) in last.items():
            for x in keys:
                want[tenant, x] = want.get((tenant, x), 0) + weight
        for r in deltas:
            if r.batch <= k:
                got[r.tenant, r.pref_key] = got.get((r.tenant, r.pref_key), 0) + r.delta
        assert {x: round(w, 6) + 0.0 for x, w in got.items() if round(w, 6)} == {x: round(w, 6) + 0.0 for x, w in want.items() if round(w, 6)}


def test_mastery_of_micro_batches(spark, tmp_path, monkeypatch):
    """After each batch the mastery of its concepts is that of a plain loop over all attempts so far, and the store has
    a row a bucket, not a key."""
    import random

    from gleanery.streaming import jobs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    monkeypatch.setattr(jobs, "BUCKETS", 5)
    random.seed(5)
    rows = [(i, random.choice([None, 1, 2, 2**53 + 1]), random.choice([None, "a", "b", "c"]), random.choice([None, "easy", "medium", "hard"]), random.choice([True, False, None]), f"2024-01-0{1 + i // 100} 00:00:{random.randrange(60):02}") for i in range(300)]
    batches = [rows[:100], rows[100:200], rows[200:]]
    stream = _fed(spark, tmp_path, "attempt_id long, tenant long, concept_key string, difficulty string, is_correct boolean, created_at string", batches)
    stream = stream.withColumn("created_at", F.col("created_at").cast("timestamp"))
    jobs.run_to_table(jobs.stream_mastery(stream), (tmp_path / "out").as_uri(), (tmp_path / "state").as_uri(), "update")
    out = spark.read.parquet((tmp_path / "out").as_uri()).collect()
    assert _state_rows(spark, (tmp_path / "state").as_uri()) <= 5
    known = {}
    for k, batch in enumerate(batches):
        touched = set()
        for _, tenant, concept, level, right, _ in sorted(batch, key=lambda r: (r[5], r[0])):
            m, n = known.get((tenant, concept), (K.PRIOR_MASTERY, 0))
            up, down = K.ALPHAS.get(level, K.ALPHAS["medium"])
            known[tenant, concept] = (m + (up if right else down) * ((1.0 if right else 0.0) - m), n + 1)
            touched.add((tenant, concept))
        assert {(r.tenant, r.concept_key): (round(r.mastery, 9), r.attempts) for r in out if r.batch == k} == {c: (round(known[c][0], 9), known[c][1]) for c in touched}
