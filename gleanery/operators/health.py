"""Feed health: cadence, signals, observations and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.operators.landing import at
from gleanery.operators.ranking import hours_since


def recent_published(feeds: DataFrame, articles: DataFrame, n: int = K.CADENCE_SAMPLE) -> DataFrame:
    """The newest n (kept within 2 to 50) dates of each feed."""
    n = max(2, min(50, n))
    order = Window.partitionBy("feed_id").orderBy(F.desc("published_at"), "article_id")
    dated = articles.where("published_at is not null").select("feed_id", "article_id", "published_at")
    top = dated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return top.join(feeds.select("feed_id"), "feed_id", "left_semi")


def cadence(feeds: DataFrame, recent: DataFrame, now: str = K.NOW) -> DataFrame:
    """Median gap in days of each feed's dates (null under two), the silence that makes it dead
    (STALL_FACTOR gaps, DEAD_DAYS at least) and its silence in days (null without dates)."""
    gap = (F.unix_micros(F.lag("published_at").over(Window.partitionBy("feed_id").orderBy(F.desc("published_at"), "article_id"))) - F.unix_micros("published_at")) / F.lit(86_400_000_000.0)
    per = recent.withColumn("gap", gap).groupBy("feed_id").agg(F.median("gap").alias("median_gap"), F.max("published_at").alias("newest"))
    out = feeds.select("feed_id").join(per, "feed_id", "left")
    dead = F.coalesce(F.greatest(F.lit(float(K.DEAD_DAYS)), F.col("median_gap") * K.STALL_FACTOR), F.lit(float(K.DEAD_DAYS)))
    return out.select("feed_id", "median_gap", dead.alias("dead_after"), (hours_since("newest", now) / 24).alias("silence"))


def evaluate_feeds(inputs: DataFrame, now: str = K.NOW) -> DataFrame:
    """reasons (in a fixed order) and score. inputs: feed_id, created_at, credibility, near_dup_rate,
    source_pref, dead_after, silence (null: endless), cadence_known."""
    age = hours_since("created_at", now) / 24
    signs = {
        "dead": (age >= K.GRACE_DAYS) & F.col("cadence_known") & (F.col("silence").isNull() | (F.col("silence") > F.col("dead_after"))),
        "low_credibility": F.col("credibility") < K.LOW_CREDIBILITY, "low_pref": F.col("source_pref") < K.LOW_PREFERENCE,
        "near_dup": F.col("near_dup_rate") >= K.HIGH_NEAR_DUP,
    }
    score = sum((F.when(c, K.HEALTH_WEIGHTS[n]).otherwise(0.0) for n, c in signs.items()), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in signs.items()]))
    return inputs.withColumns({"reasons": reasons, "score": score})


def retire_suggestions(evaluated: DataFrame) -> DataFrame:
    """Feeds with a reason, worst first; ties by newest, then id."""
    order = Window.orderBy(F.desc("score"), F.desc("created_at"), "feed_id")
    return evaluated.where(F.size("reasons") > 0).withColumn("place", F.row_number().over(order).cast("long"))


def in_window(articles: DataFrame, now: str = K.NOW) -> DataFrame:
    return articles.where(F.col("published_at") >= at(now) - F.expr(f"interval {K.WINDOW_DAYS} days"))


def recipe(epoch: str):
    """"lead" from the epoch on, else (and without a date) "legacy"."""
    return F.when(F.col("embedded_at") >= at(epoch), "lead").otherwise("legacy")


def window_feed_counts(articles: DataFrame, epoch: str, now: str = K.NOW, cap: int | None = None) -> DataFrame:
    """Embedded articles of the window by feed and recipe, and whether `cap` would cut them."""
    rows = in_window(articles, now).where("embedding is not null").withColumn("recipe", recipe(epoch))
    per = rows.groupBy("feed_id").agg(
        F.count("*").alias("embedded"), F.count_if(F.col("recipe") == "lead").alias("lead"), F.count_if(F.col("recipe") == "legacy").alias("legacy")
    )
    total = per.agg(F.sum("embedded").alias("total"))
    return per.crossJoin(F.broadcast(total)).withColumn("truncated", F.lit(False) if cap is None else F.col("total") > cap)


def window_gate_counts(articles: DataFrame, now: str = K.NOW, gate: int = K.EMBED_GATE) -> DataFrame:
    return in_window(articles, now).groupBy("feed_id").agg(
        F.count("*").alias("items"), F.count_if(F.coalesce("body_len", F.lit(0)) >= gate).alias("eligible")
    )


def health_observation(feeds: DataFrame, evaluated: DataFrame, counts: DataFrame, gates: DataFrame) -> DataFrame:
    """One row per active feed: signals, window counts, own articles and how much of the window is
    embedded (0 when it is empty)."""
    out = feeds.where("active").select("feed_id").join(evaluated, "feed_id").join(counts.select("feed_id", "embedded", "lead", "legacy"), "feed_id", "left")
    out = out.join(gates, "feed_id", "left").na.fill(0, ["embedded", "lead", "legacy", "items", "eligible"])
    share = F.when(F.col("items") > 0, F.col("embedded") / F.col("items")).otherwise(0.0)
    return out.withColumns({"own": F.least("embedded", F.lit(K.OWN_CAP)).cast("long"), "coverage": share})


def window_observation(observation: DataFrame, articles: DataFrame, epoch: str, now: str = K.NOW, gate: int = K.EMBED_GATE, cap: int | None = None) -> DataFrame:
    """One row for the whole window: articles, how many and what share of them are embedded, by recipe
    too, the majority recipe, how many pass the gate, feeds with a rate, and a line that says so.
    Shares of an empty window are 0."""
    embedded = F.col("embedding").isNotNull()
    rows = in_window(articles, now).withColumn("recipe", F.when(embedded, recipe(epoch)))
    w = rows.agg(
        F.count("*").alias("articles"), F.count_if(embedded).alias("embedded"), F.count_if(F.col("recipe") == "legacy").alias("legacy"), F.count_if(F.col("recipe") == "lead").alias("lead"),
        F.count_if(F.coalesce("body_len", F.lit(0)) >= gate).alias("eligible"),
    )
    share = lambda c: F.when(F.col("articles") > 0, F.col(c) / F.col("articles")).otherwise(0.0)
    w = w.withColumns({"coverage": share("embedded"), "coverage_legacy": share("legacy"), "coverage_lead": share("lead")})
    w = w.withColumn("majority", F.when(F.col("lead") > F.col("legacy"), "lead").otherwise("legacy"))
    w = w.withColumn("majority_share", F.when(F.col("embedded") > 0, F.greatest("lead", "legacy") / F.col("embedded")))
    percent = lambda c: F.format_string("%.1f", F.col(c) * 100)
    text = F.concat(
        F.format_string(f"last {K.WINDOW_DAYS} days: %d articles, %d with a vector (", "articles", "embedded"), percent("coverage"), F.lit(" %)"),
        F.when(F.col("majority_share") < 1, F.concat(
            F.format_string("; %d legacy (", "legacy"), percent("coverage_legacy"), F.format_string(" %%), %d lead (", "lead"), percent("coverage_lead"),
            F.format_string(" %%), mostly %s (%.2f)", "majority", "majority_share"),
        )).otherwise(""),
    )
    w = w.withColumns({"description": text, "truncated": F.lit(False) if cap is None else F.col("embedded") > cap})
    return w.crossJoin(observation.agg(F.count("near_dup_rate").alias("feeds_with_rate")))


def rate_floor_guard(observation: DataFrame, fresh: bool = True, floor: int = K.RATE_FLOOR) -> DataFrame:
    n = observation.agg(F.count("near_dup_rate").alias("feeds_with_rate"))
    return n.withColumn("fails", F.lit(fresh) & (F.col("feeds_with_rate") < floor))


def health_snapshot(observation: DataFrame, prefs_ok: bool, now: str = K.NOW) -> DataFrame:
    """Rows to append to the snapshot table; none if preferences failed to load."""
    return observation.where(F.lit(prefs_ok)).select(
        F.lit(now).alias("captured_at"), F.lit(now[:10]).alias("captured_date"), "feed_id", "score", "reasons", "silence", "near_dup_rate", "embedded", "items",
        F.to_json(F.struct(F.lit(K.DEAD_DAYS).alias("dead_days"), F.lit(K.HIGH_NEAR_DUP).alias("near_dup"))).alias("thresholds"),
    )


def append_health_snapshot(snapshot: DataFrame, path: str) -> None:
    if snapshot.isEmpty():
        raise ValueError("an empty snapshot is not appended")
    snapshot.write.mode("append").partitionBy("captured_date").parquet(path)


def null_rate_reasons(observation: DataFrame, articles: DataFrame) -> DataFrame:
    """Why feeds have no near-duplicate rate: the first that holds."""
    dates = articles.groupBy("feed_id").agg(F.count("*").alias("all"), F.count("published_at").alias("dated"))
    why = F.when(F.col("own") >= K.MIN_OWN, "enough but null").when(F.col("own") > 0, "too few").when(F.coalesce("all", F.lit(0)) == 0, "no article")
    why = why.when(F.col("dated") == 0, "no date").when(F.col("eligible") == 0, "fails the gate").otherwise("not embedded")
    missing = observation.where("near_dup_rate is null").join(dates, "feed_id", "left")
    return missing.withColumn("why", why).groupBy("why").agg(F.count("*").alias("feeds"))


def distance_to_thresholds(observation: DataFrame, k: int = 12, now: str = K.NOW) -> DataFrame:
    """Feeds nearest to a signal they do not have: gaps to each (null where it has passed, or for a
    new feed's silence), nearest first, and the dismissals left until low_pref."""
    new = hours_since("created_at", now) / 24 < K.GRACE_DAYS
    gaps = {
        "to_credibility": F.col("credibility") - K.LOW_CREDIBILITY, "to_pref": F.col("source_pref") - K.LOW_PREFERENCE,
        "to_dead": F.when(~new, F.col("dead_after") - F.col("silence")),
    }
    out = observation.select("feed_id", "source_pref", *[F.when(c >= 0, c).alias(n) for n, c in gaps.items()])
    nearest = F.least(*gaps)
    left = F.floor(F.col("to_pref") / 1.1) + 1
    return out.withColumns({"nearest": nearest, "dismisses_left": left}).where("nearest is not null").orderBy("nearest", "feed_id").limit(k)


def stale_fetch(fetches: DataFrame, now: str = K.NOW, hours: int = K.STALE_HOURS) -> DataFrame:
    """Feeds with an error whose last success (or creation) is `hours` or more ago, longest first."""
    waited = hours_since("anchor", now)
    stale = fetches.where("error is not null").withColumn("anchor", F.coalesce("last_fetched_at", "created_at")).where("anchor is not null")
    return stale.withColumn("hours", waited).where(F.col("hours") >= hours).orderBy(F.desc("hours"), "feed_id").select("feed_id", "hours", "error")
