"""Queries of feed health."""

from pyspark.sql import functions as F

from gleanery.constants import NOW
from gleanery.operators import health as op
from gleanery.plans.registry import query
from gleanery.sources.views import Views

EPOCH = "2024-01-15 00:00:00"
T, E = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{EPOCH}'"
RECENT = """recent AS (SELECT a.feed_id, article_id, published_at, row_number() OVER (PARTITION BY a.feed_id ORDER BY published_at DESC, article_id) AS place
  FROM articles a JOIN feeds f ON f.feed_id = a.feed_id WHERE published_at IS NOT NULL QUALIFY place <= 15)"""
CADENCE = f"""{RECENT}, gaps AS (SELECT feed_id, published_at, (epoch_us(lag(published_at) OVER (PARTITION BY feed_id ORDER BY published_at DESC, article_id)) - epoch_us(published_at)) / 86400000000.0 AS gap FROM recent),
cad AS (SELECT f.feed_id, median_gap, coalesce(greatest(14.0, median_gap * 2.5), 14.0) AS dead_after, (epoch_us({T}) - epoch_us(newest)) / 86400000000.0 AS silence
  FROM feeds f LEFT JOIN (SELECT feed_id, median(gap) AS median_gap, max(published_at) AS newest FROM gaps GROUP BY 1) g ON g.feed_id = f.feed_id)"""
#: Rates and preferences of feeds, so that every signal occurs.
SIGNALS = """SELECT feed_id, CASE WHEN idx % 6 = 5 THEN NULL ELSE CAST(idx % 5 AS DOUBLE) / 10 END AS near_dup_rate, CAST(idx % 7 AS DOUBLE) - 4.5 AS source_pref FROM {feeds}"""
EVAL = f"""{CADENCE}, sig AS ({SIGNALS.replace('{feeds}', 'feeds')}), ev0 AS (
  SELECT f.feed_id, f.created_at, f.active, f.credibility, near_dup_rate, source_pref, dead_after, silence,
    (epoch_us({T}) - epoch_us(f.created_at)) / 86400000000.0 >= 3 AND (silence IS NULL OR silence > dead_after) AS d,
    f.credibility < -0.4 AS c, source_pref < -2.0 AS p, coalesce(near_dup_rate >= 0.2, false) AS n
  FROM feeds f JOIN cad ON cad.feed_id = f.feed_id JOIN sig ON sig.feed_id = f.feed_id),
ev AS (SELECT *, concat_ws(',', CASE WHEN d THEN 'dead' END, CASE WHEN c THEN 'low_credibility' END, CASE WHEN p THEN 'low_pref' END, CASE WHEN n THEN 'near_dup' END) AS reasons,
  CAST(3.0 * d::INT + 2.5 * c::INT + 2.0 * p::INT + 1.5 * n::INT AS DOUBLE) AS score FROM ev0)"""
WIN = f"""win AS (SELECT * FROM articles WHERE published_at >= {T} - INTERVAL 30 DAY),
counts AS (SELECT feed_id, count(*) AS embedded, count(*) FILTER (embedded_at >= {E}) AS lead, count(*) FILTER (NOT coalesce(embedded_at >= {E}, false)) AS legacy FROM win WHERE embedding IS NOT NULL GROUP BY 1),
gates AS (SELECT feed_id, count(*) AS items, count(*) FILTER (coalesce(body_len, 0) >= 250) AS eligible FROM win GROUP BY 1)"""
OBS = f"""{EVAL}, {WIN}, obs AS (SELECT ev.*, coalesce(embedded, 0) AS embedded, coalesce(lead, 0) AS lead, coalesce(legacy, 0) AS legacy, coalesce(items, 0) AS items, coalesce(eligible, 0) AS eligible,
  least(coalesce(embedded, 0), 100) AS own, CASE WHEN items > 0 THEN coalesce(embedded, 0) / items ELSE 0.0 END AS coverage
  FROM ev LEFT JOIN counts k ON k.feed_id = ev.feed_id LEFT JOIN gates g ON g.feed_id = ev.feed_id WHERE active)"""


def evaluated(v: Views):
    cad = op.cadence(v.feeds, op.recent_published(v.feeds, v.articles))
    inputs = v.feeds.select("feed_id", "created_at", "credibility").join(cad, "feed_id").join(v.sql(SIGNALS), "feed_id")
    return op.evaluate_feeds(inputs.withColumn("cadence_known", F.lit(True)))


def observation(v: Views):
    return op.health_observation(v.feeds, evaluated(v), op.window_feed_counts(v.articles, EPOCH), op.window_gate_counts(v.articles))


def joined(df):
    return df.withColumn("reasons", F.concat_ws(",", "reasons"))


@query("e1_recent_published", f"WITH {RECENT} SELECT feed_id, article_id, CAST(published_at AS VARCHAR) AS published_at, place FROM recent")
def e1(v: Views):
    out = op.recent_published(v.feeds, v.articles)
    return out.select("feed_id", "article_id", F.col("published_at").cast("string").alias("published_at"), F.col("place").cast("long"))


@query("e2_cadence", f"WITH {CADENCE} SELECT feed_id, round(median_gap, 6) AS median_gap, round(dead_after, 6) AS dead_after, round(silence, 6) AS silence FROM cad")
def e2(v: Views):
    return op.cadence(v.feeds, op.recent_published(v.feeds, v.articles)).select("feed_id", *[F.round(c, 6).alias(c) for c in ("median_gap", "dead_after", "silence")])


@query("e3_evaluate_feeds", f"WITH {EVAL} SELECT feed_id, reasons, score FROM ev")
def e3(v: Views):
    return joined(evaluated(v)).select("feed_id", "reasons", "score")


@query("e4_retire_suggestions", f"WITH {EVAL} SELECT feed_id, reasons, score, row_number() OVER (ORDER BY score DESC, created_at DESC, feed_id) AS place FROM ev WHERE reasons <> ''")
def e4(v: Views):
    return joined(op.retire_suggestions(evaluated(v))).select("feed_id", "reasons", "score", "place")


@query("e5_window_feed_counts", f"WITH {WIN} SELECT feed_id, embedded, lead, legacy, CAST((SELECT sum(embedded) FROM counts) AS BIGINT) AS total, (SELECT sum(embedded) FROM counts) > 20000 AS truncated FROM counts")
def e5(v: Views):
    return op.window_feed_counts(v.articles, EPOCH, cap=20_000)


@query("e6_window_gate_counts", f"WITH {WIN} SELECT feed_id, items, eligible FROM gates")
def e6(v: Views):
    return op.window_gate_counts(v.articles)


@query("e7_health_observation", f"WITH {OBS} SELECT feed_id, reasons, score, own, embedded, lead, legacy, items, eligible, round(coverage, 6) AS coverage FROM obs")
def e7(v: Views):
    out = joined(observation(v)).withColumn("coverage", F.round("coverage", 6))
    return out.select("feed_id", "reasons", "score", "own", "embedded", "lead", "legacy", "items", "eligible", "coverage")


@query("e7_window_observation", f"""WITH {OBS}, w AS (SELECT count(*) AS articles, count(embedding) AS embedded, count(*) FILTER (embedding IS NOT NULL AND NOT coalesce(embedded_at >= {E}, false)) AS legacy,
  count(*) FILTER (embedding IS NOT NULL AND embedded_at >= {E}) AS lead, count(*) FILTER (coalesce(body_len, 0) >= 250) AS eligible FROM win),
s AS (SELECT *, embedded / articles AS c, legacy / articles AS cg, lead / articles AS cl, CASE WHEN lead > legacy THEN 'lead' ELSE 'legacy' END AS majority, greatest(lead, legacy) / embedded AS ms FROM w)
SELECT articles, embedded, legacy, lead, eligible, round(c, 6) AS coverage, round(cg, 6) AS coverage_legacy, round(cl, 6) AS coverage_lead, majority, round(ms, 6) AS majority_share, embedded > 20000 AS truncated,
  printf('last 30 days: %d articles, %d with a vector (%.1f %%)', articles, embedded, c * 100) || CASE WHEN ms < 1 THEN printf('; %d legacy (%.1f %%), %d lead (%.1f %%), mostly %s (%.2f)', legacy, cg * 100, lead, cl * 100, majority, ms) ELSE '' END AS description,
  (SELECT count(near_dup_rate) FROM obs) AS feeds_with_rate FROM s""")
def e7_window(v: Views):
    out = op.window_observation(observation(v), v.articles, EPOCH, cap=20_000)
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "coverage_legacy", "coverage_lead", "majority_share")})


@query("e8_rate_floor_guard", f"WITH {OBS} SELECT count(near_dup_rate) AS feeds_with_rate, count(near_dup_rate) < 12 AS fails FROM obs")
def e8(v: Views):
    return op.rate_floor_guard(observation(v))


@query("e9_null_rate_reasons", f"""WITH {OBS} SELECT CASE WHEN own >= 20 THEN 'enough but null' WHEN own > 0 THEN 'too few' WHEN coalesce(total, 0) = 0 THEN 'no article' WHEN dated = 0 THEN 'no date'
  WHEN eligible = 0 THEN 'fails the gate' ELSE 'not embedded' END AS why, count(*) AS feeds FROM obs o LEFT JOIN (SELECT feed_id, count(*) AS total, count(published_at) AS dated FROM articles GROUP BY 1) d ON d.feed_id = o.feed_id
WHERE near_dup_rate IS NULL GROUP BY 1""")
def e9(v: Views):
    return op.null_rate_reasons(observation(v), v.articles)


@query("e10_distance_to_thresholds", f"""WITH {OBS}, g AS (SELECT feed_id, CASE WHEN credibility + 0.4 >= 0 THEN credibility + 0.4 END AS tc, CASE WHEN source_pref + 2 >= 0 THEN source_pref + 2 END AS tp,
  CASE WHEN (epoch_us({T}) - epoch_us(created_at)) / 86400000000.0 >= 3 AND dead_after - silence >= 0 THEN dead_after - silence END AS td FROM obs)
SELECT feed_id, round(least(tc, tp, td), 6) AS nearest, coalesce(CAST(floor(tp / 1.1) + 1 AS BIGINT), -1) AS dismisses_left FROM g WHERE least(tc, tp, td) IS NOT NULL ORDER BY least(tc, tp, td), feed_id LIMIT 12""")
def e10(v: Views):
    out = op.distance_to_thresholds(observation(v))
    return out.select("feed_id", F.round("nearest", 6).alias("nearest"), F.coalesce("dismisses_left", F.lit(-1)).cast("long").alias("dismisses_left"))


@query("e11_stale_fetch", f"""SELECT feed_id, round((epoch_us({T}) - epoch_us(coalesce(last_fetched_at, created_at))) / 3600000000.0, 6) AS hours, error FROM fetches
WHERE error IS NOT NULL AND (epoch_us({T}) - epoch_us(coalesce(last_fetched_at, created_at))) / 3600000000.0 >= 24""")
def e11(v: Views):
    return op.stale_fetch(v.fetches).withColumn("hours", F.round("hours", 6))


@query("a10_append_health_snapshot", f"""WITH {OBS} SELECT '{NOW}' AS captured_at, '{NOW[:10]}' AS captured_date, feed_id, score, reasons, round(silence, 6) AS silence, embedded, items,
  '{{"dead_days":14,"near_dup":0.2}}' AS thresholds FROM obs""")
def a10(v: Views):
    out = joined(op.health_snapshot(observation(v), prefs_ok=True)).withColumn("silence", F.round("silence", 6))
    return out.drop("near_dup_rate")
