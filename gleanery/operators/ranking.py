"""Preferences, scores and daily decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.operators.landing import at
from gleanery.sources.partitions import PartitionTable
from gleanery.sources.shared import written


def hours_since(column: str, now: str):
    return (F.unix_micros(at(now)) - F.unix_micros(F.col(column).cast("timestamp"))) / F.lit(3_600_000_000.0)


def recency(column: str = "published_at", now: str = K.NOW):
    """Halves every HALF_LIFE_HOURS; 0 without a date, 1 for the future."""
    age = F.greatest(hours_since(column, now), F.lit(0.0))
    return F.when(F.col(column).isNull(), 0.0).otherwise(F.pow(F.lit(0.5), age / K.HALF_LIFE_HOURS))


def score_articles(articles: DataFrame, tags: DataFrame, prefs: DataFrame, feeds: DataFrame, now: str = K.NOW, digits: int | None = None) -> DataFrame:
    """tenant, article_id, feed_id, recency, pref and score = recency + tag and source preferences +
    credibility, for every article and every tenant of `prefs` (tenant, kind, pref_key, weight).
    Unknown tags, sources and feeds count 0.

    Articles of one feed and one set of tags, a class, have one preference, so tenants are multiplied by
    classes, and preferences are joined with these. Articles then meet the tenants of their class in one
    join, after which no pair moves: a class is parted by tenants, in as many parts as its share of the
    articles asks for. With `digits` the three figures are rounded, what is not of a pair before the join."""
    shown = lambda c: c if digits is None else F.round(c, digits) + F.lit(0.0)
    n = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = tags.groupBy("article_id").agg(F.sort_array(F.collect_list("tag")).alias("names"))
    rows = articles.select("article_id", "feed_id", "published_at").join(sets, "article_id", "left")
    rows = written(rows.withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("recency", recency(now=now)))
    prefs = written(prefs.select("tenant", "kind", "pref_key", "weight"))
    tenants = written(prefs.select("tenant").distinct())
    total, most = rows.count(), max(tenants.count(), 1)
    parts = F.least(F.ceil(F.count("*") * (4 * n) / max(total, 1)), F.lit(most)).cast("int")
    classes = written(rows.groupBy("feed_id", "names").agg(parts.alias("parts")).withColumn("class", F.monotonically_increasing_id()))

    by_set = classes.select("names", F.explode("names").alias("pref_key"), "class").join(prefs.where("kind = 'tag'").select("tenant", "pref_key", "weight"), "pref_key")
    by_set = by_set.groupBy("tenant", "class").agg(F.sum("weight").alias("by_tag"))
    source = prefs.where("kind = 'source'").select("tenant", F.col("pref_key").alias("feed_id"), F.col("weight").alias("by_source"))
    known = classes.select("class", "feed_id", "parts").crossJoin(tenants).join(by_set, ["tenant", "class"], "left").join(source, ["tenant", "feed_id"], "left")
    known = known.na.fill(0.0, ["by_tag", "by_source"]).select("class", F.pmod(F.xxhash64("tenant"), "parts").cast("int").alias("part"), "tenant", (F.col("by_tag") + F.col("by_source")).alias("pref"))
    known = known.withColumn("shown_pref", shown(F.col("pref")))

    own = classes.select(F.col("feed_id").alias("class_feed"), F.col("names").alias("class_names"), "class", "parts")
    rows = rows.join(own, F.col("feed_id").eqNullSafe(F.col("class_feed")) & (F.col("names") == F.col("class_names")))
    rows = rows.select("class", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "article_id", "feed_id", "recency", shown(F.col("recency")).alias("shown_recency"))
    rows = rows.join(feeds.select("feed_id", "credibility"), "feed_id", "left").na.fill(0.0, ["credibility"])
    pairs = known.repartition(n, "class", "part").hint("merge").join(rows.repartition(n, "class", "part"), ["class", "part"])
    score = shown(F.col("recency") + F.col("pref") + F.col("credibility")).alias("score")
    return pairs.select("tenant", "article_id", "feed_id", F.col("shown_recency").alias("recency"), F.col("shown_pref").alias("pref"), score)


def top_articles(articles: DataFrame, tags: DataFrame, prefs: DataFrame, feeds: DataFrame, k: int = 10, now: str = K.NOW) -> DataFrame:
    """Each tenant's k best articles by score to six places; ties go to the newer, then by article_id.

    Articles of one feed and one set of tags, a class, differ in recency alone, so only the k newest of
    a class can be among the best, and only of the k classes with the best newest articles. These come
    from two lists a tenant, which are all that tenants multiply: feeds (source preference, credibility
    and recency of their newest article) and sets of tags (sum of the preferences). A class is worth no
    more than its feed with the tenant's best set, or its set with the best feed, so the threshold
    algorithm takes the classes of the best sets first, whose k-th best newest article is a score to
    reach, and then only feeds and sets that can reach it.
    """
    sets = tags.groupBy("article_id").agg(F.array_sort(F.collect_set("tag")).alias("names"))
    newest = Window.partitionBy("feed_id", "tags").orderBy(F.desc_nulls_last("published_at"), "article_id")
    rows = articles.select("article_id", "feed_id", "published_at").join(sets, "article_id", "left").withColumn("tags", F.coalesce(F.array_join("names", "\x00"), F.lit("")))
    rows = rows.withColumn("fresh", recency(now=now)).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= k)
    some, prefs, feeds = written(rows), written(prefs.select("tenant", "kind", "pref_key", "weight")), written(feeds.select("feed_id", "credibility"))
    classes = some.where("n = 1").select("feed_id", "tags", "fresh")

    tenants = prefs.select("tenant").distinct()
    of_tag, of_source = (prefs.where(F.col("kind") == kind).select("tenant", "pref_key", "weight") for kind in ("tag", "source"))
    by_set = some.select("tags", F.explode("names").alias("pref_key")).distinct().join(of_tag, "pref_key").groupBy("tenant", "tags").agg(F.sum("weight").alias("by_tag"))
    by_set = tenants.crossJoin(classes.select("tags").distinct()).join(by_set, ["tenant", "tags"], "left").na.fill(0.0, ["by_tag"])
    by_feed = classes.groupBy("feed_id").agg(F.max("fresh").alias("fresh")).join(feeds.select("feed_id", "credibility"), "feed_id", "left").crossJoin(tenants)
    by_feed = by_feed.join(of_source.withColumnRenamed("pref_key", "feed_id"), ["tenant", "feed_id"], "left").na.fill(0.0, ["weight", "credibility"])
    by_feed = by_feed.select("tenant", "feed_id", (F.col("weight") + F.col("credibility")).alias("by_feed"), (F.col("weight") + F.col("credibility") + F.col("fresh")).alias("most"))
    by_set, by_feed = written(by_set), written(by_feed)

    def worth(sets_: DataFrame, feeds_: DataFrame) -> DataFrame:
        return sets_.join(classes, "tags").join(feeds_, ["tenant", "feed_id"]).withColumn("best", F.col("fresh") + F.col("by_tag") + F.col("by_feed"))

    first = Window.partitionBy("tenant").orderBy(F.desc("by_tag"), "tags")
    seen = worth(by_set.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n"), by_feed)
    reach = seen.withColumn("n", F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("best")))).where(F.col("n") == k).select("tenant", F.col("best").alias("reach"))
    bounds = by_set.groupBy("tenant").agg(F.max("by_tag").alias("best_set")).join(by_feed.groupBy("tenant").agg(F.max("most").alias("best_feed")), "tenant").join(reach, "tenant", "left")
    low = F.coalesce(F.col("reach") - 1e-5, F.lit(float("-inf")))  # scores are compared to six places
    can = lambda df, bound: df.join(bounds, "tenant").where(bound >= low).select(df.columns)
    sets_, feeds_ = can(by_set, F.col("by_tag") + F.col("best_feed")), can(by_feed, F.col("most") + F.col("best_set"))
    place = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc(F.round("best", 6)), F.desc("fresh")))
    left = worth(sets_, feeds_).withColumn("place", place)
    # of classes whose best articles are equal to six places, any may go on
    edge = left.where(F.col("place") == k).select("tenant", F.col("best").alias("edge"))
    left = left.join(edge, "tenant", "left").where(F.col("edge").isNull() | (F.col("best") >= F.col("edge") - 1e-5))

    scored = left.select("tenant", "feed_id", "tags", "by_tag", "by_feed").join(some, ["feed_id", "tags"])
    # the sum in the order of score_articles; a tenant's best pairs only
    source = of_source.withColumnRenamed("pref_key", "feed_id").withColumnRenamed("weight", "by_source")
    scored = scored.join(source, ["tenant", "feed_id"], "left").join(feeds.select("feed_id", "credibility"), "feed_id", "left").na.fill(0.0, ["by_source", "credibility"])
    scored = scored.withColumn("score", F.round(F.col("fresh") + (F.col("by_tag") + F.col("by_source")) + F.col("credibility"), 6))
    best = Window.partitionBy("tenant").orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "article_id")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("tenant", "article_id", "score", "place")


def rebuild_preferences(feedback: DataFrame, tags: DataFrame, articles: DataFrame) -> DataFrame:
    """(tenant, kind, pref_key, weight): the weight of each article's latest action, summed over its
    tags and its feed. Adding the difference of weights at every new judgement gives the same sums
    as long as an article's tags do not change between judgements."""
    last = feedback.groupBy("tenant", "article_id").agg(F.max_by("action", F.struct("created_at", "event_id")).alias("action"))
    weights = F.create_map(*[F.lit(x) for kv in K.FEEDBACK_WEIGHTS.items() for x in kv])
    last = last.withColumn("w", weights[F.col("action")])
    by_tag = last.join(tags, "article_id").select("tenant", F.lit("tag").alias("kind"), F.col("tag").alias("pref_key"), "w")
    by_feed = last.join(articles.select("article_id", "feed_id"), "article_id").select("tenant", F.lit("source"), "feed_id", "w")
    return by_tag.union(by_feed).groupBy("tenant", "kind", "pref_key").agg(F.sum("w").alias("weight"))


def load_preferences(prefs: DataFrame, kind: str) -> DataFrame:
    return prefs.where(F.col("kind") == kind).select("tenant", "pref_key", "weight")


def deck_candidates(articles: DataFrame, picked: DataFrame, now: str = K.NOW, hours: int = K.DECK_HOURS, limit: int = K.DECK_CANDIDATES) -> DataFrame:
    """The newest `limit` summarised articles of the last `hours` that no deck has, with the
    unlimited count."""
    fresh = articles.where(F.col("summary").isNotNull() & (F.col("published_at") >= at(now) - F.expr(f"interval {hours} hours")))
    fresh = fresh.join(picked.select("article_id"), "article_id", "left_anti")
    total = fresh.agg(F.count("*").alias("available"))
    return fresh.orderBy(F.desc("published_at"), "article_id").limit(limit).crossJoin(F.broadcast(total))


def pick_decks(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """Decks of DECK_SIZE per tenant: (tenant, article_id, place, reason, deduped).

    candidates: tenant, article_id, feed_id, vec, pref, recency, value; seeds: the day's picks so
    far (tenant, feed_id, vec, pref, judged). Three passes: up to DECK_EXPLORE neutral articles by
    recency, then value (none for a tenant without preferences; seeds that are neutral and not judged
    count), then by value, both with at most DECK_PER_SOURCE of a feed, then without that cap. A candidate whose
    cosine with a pick or seed reaches DUPLICATE_COSINE is skipped, once a pass (`deduped` counts
    these). Ties go by article_id. The fold sees at most DECK_CANDIDATES rows a tenant.
    """
    import numpy as np
    import pandas as pd

    def unit(v):
        x = np.array(v, float) if v is not None and len(v) else None
        n = np.linalg.norm(x) if x is not None else 0
        return x / n if n > 0 else None

    def fold(key, rows, old):
        rows = rows.sort_values("article_id", kind="stable").to_dict("records")
        for r in rows:
            r["unit"] = unit(r["vec"])
        per_feed: dict[str, int] = {}
        units, explored = [], 0
        for s in old.to_dict("records"):
            per_feed[s["feed_id"]] = per_feed.get(s["feed_id"], 0) + 1
            u = unit(s["vec"])
            if u is not None:
                units.append(u)
            explored += abs(s["pref"]) <= K.NEUTRAL_BAND and not s["judged"]
        need, picks, deduped, taken = K.DECK_SIZE - len(old), [], 0, set()

        def take(order, reason, most, capped):
            nonlocal deduped
            for r in order:
                if len(picks) >= need or most <= 0:
                    return
                if r["article_id"] in taken or capped and per_feed.get(r["feed_id"], 0) >= K.DECK_PER_SOURCE:
                    continue
                if r["unit"] is not None and any(len(u) == len(r["unit"]) and float(u @ r["unit"]) >= K.DUPLICATE_COSINE for u in units):
                    deduped += 1
                    continue
                taken.add(r["article_id"])
                picks.append((r["article_id"], reason))
                per_feed[r["feed_id"]] = per_feed.get(r["feed_id"], 0) + 1
                if r["unit"] is not None:
                    units.append(r["unit"])
                most -= 1

        by_value = sorted(rows, key=lambda r: -r["value"])
        if any(r["pref"] != 0 for r in rows):
            neutral = [r for r in by_value if abs(r["pref"]) <= K.NEUTRAL_BAND]
            take(sorted(neutral, key=lambda r: -r["recency"]), "explore", max(0, min(K.DECK_EXPLORE - explored, need)), True)
        take(by_value, "value", need, True)
        take(by_value, "fill", need, False)
        return pd.DataFrame(
            [(key[0], a, k + 1, reason, deduped) for k, (a, reason) in enumerate(picks)], columns=["tenant", "article_id", "place", "reason", "deduped"]
        )

    return candidates.groupBy("tenant").cogroup(seeds.groupBy("tenant")).applyInPandas(
        fold, "tenant long, article_id long, place long, reason string, deduped long"
    ).where("place is not null")


def curate_day(articles: DataFrame, tags: DataFrame, prefs: DataFrame, feeds: DataFrame, picked: DataFrame, seeds: DataFrame, now: str = K.NOW) -> DataFrame:
    """Decks of the day: the candidates alone (at most DECK_CANDIDATES) are scored for all tenants and
    dealt to decks. A tenant whose deck is full gets none."""
    candidates = written(deck_candidates(articles, picked, now).select("article_id", "feed_id", "published_at", F.col("embedding").alias("vec")))
    ids = F.broadcast(candidates.select("article_id"))  # bounded
    scored = score_articles(candidates, tags.join(ids, "article_id", "left_semi"), prefs, feeds, now)
    rows = scored.join(F.broadcast(candidates.select("article_id", "vec")), "article_id")
    best = rows.select("tenant", "article_id", "feed_id", "vec", "pref", "recency", F.col("score").alias("value"))
    return pick_decks(best, seeds)


def deck_summary(decks: DataFrame) -> DataFrame:
    return decks.groupBy("tenant").agg(
        F.count("*").alias("picked"), F.max("deduped").alias("deduped"), F.count_if(F.col("reason") == "explore").alias("explored")
    )


#: Columns of a table of decks, which is partitioned by "day".
DECK_SCHEMA = "tenant long, article_id long, place long, score double"


def save_decks(table: PartitionTable, day: str, decks: DataFrame) -> None:
    """Let the decks (DECK_SCHEMA) count as those of their tenants on a day, in one step: whoever reads
    meanwhile, or after this failed, sees the old decks of all tenants. Tenants without rows in `decks`
    keep theirs, so a run that finds nothing changes nothing, and a run that is repeated gives the same."""
    table.replace_keys(decks, day, "tenant")


def recurate_day(decks: DataFrame, day: str, remade: DataFrame) -> DataFrame:
    """The deck table with one day made anew: that day's rows are replaced by `remade` if that has
    any (else they stay, as after a failed run)."""
    any_new = remade.agg((F.count("*") > 0).alias("ok"))
    old = decks.crossJoin(F.broadcast(any_new)).where((F.col("day") != F.lit(day)) | ~F.col("ok")).drop("ok")
    return old.unionByName(remade.withColumn("day", F.lit(day)).select(decks.columns))


def deck_view(decks: DataFrame, feedback: DataFrame, tags: DataFrame, articles: DataFrame, feeds: DataFrame, labels: DataFrame) -> DataFrame:
    """Picks (tenant, article_id, score) that their tenant has not judged, each tenant's by score (nulls
    last, ties by article_id), with title and feed_title, their tags in order, the tags' labels (slug,
    label; an unknown slug is its own) and categories ("TECH / AI" of tech/ai), and the size of the
    whole deck."""
    size = decks.groupBy("tenant").agg(F.count("*").alias("total"))
    left = decks.join(feedback.select("tenant", "article_id").distinct(), ["tenant", "article_id"], "left_anti").join(size, "tenant")
    named = tags.join(decks.select("article_id").distinct(), "article_id", "left_semi").join(labels.select(F.col("slug").alias("tag"), "label"), "tag", "left")
    one = F.struct("tag", F.coalesce("label", "tag").alias("label"), F.upper(F.replace("tag", F.lit("/"), F.lit(" / "))).alias("category"))
    named = named.groupBy("article_id").agg(F.array_sort(F.collect_set(one)).alias("t"))
    full = left.join(articles.select("article_id", "feed_id", "title"), "article_id", "left").join(feeds.select("feed_id", F.col("title").alias("feed_title")), "feed_id", "left").join(named, "article_id", "left")
    none = F.array().cast("array<string>")
    place = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc_nulls_last("score"), "article_id"))
    return full.select(
        "tenant", "article_id", place.cast("long").alias("place"), "score", "title", "feed_title", "total",
        *(F.coalesce(f"t.{c}", none).alias(name) for c, name in (("tag", "tags"), ("label", "labels"), ("category", "categories"))),
    )


def saved_view(articles: DataFrame, feeds: DataFrame, limit: int = 100) -> DataFrame:
    """Starred articles with their feed's title, newest first (nulls last, ties by id)."""
    best = articles.where("is_starred").orderBy(F.desc_nulls_last("published_at"), "article_id").limit(limit)
    return best.join(feeds.select("feed_id", F.col("title").alias("feed_title")), "feed_id", "left")


def preference_themes(prefs: DataFrame, k: int = 5, labels: DataFrame | None = None) -> DataFrame:
    """Each tenant's k highest tags of positive weight (ties by slug), their labels (slug, label; the
    slug where there is none) and a query text for them."""
    order = Window.partitionBy("tenant").orderBy(F.desc("weight"), "pref_key")
    best = prefs.where("kind = 'tag' and weight > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    named = best.withColumn("label", F.col("pref_key")) if labels is None else best.join(labels.select(F.col("slug").alias("pref_key"), "label"), "pref_key", "left")
    label = F.coalesce("label", "pref_key")
    return named.select("tenant", F.col("pref_key").alias("theme"), label.alias("label"), F.concat(label, F.lit(" ブログ おすすめ")).alias("query"))
