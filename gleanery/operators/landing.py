"""Landing, snapshots and flags of feed items. Updates are new snapshots or folded event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.constants import EMBED_GATE, NOW, RETENTION_DAYS, THIN_BODY
from gleanery.functions.text import text_tokens
from gleanery.sources.partitions import PartitionTable


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def land_items(raw: DataFrame, feeds: DataFrame, landed: DataFrame) -> DataFrame:
    """New items of active feeds: key guid, or else link, or else "" (only null falls through); ""
    is dropped; of one (feed, key) the first by pos lands, if not there already."""
    keyed = raw.withColumn("guid", F.coalesce("guid", "link", F.lit(""))).where("guid <> ''")
    keyed = keyed.withColumn("content", F.coalesce("encoded", "content")).join(feeds.where("active").select("feed_id"), "feed_id", "left_semi")
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("feed_id", "guid").orderBy("pos"))).where("n = 1")
    return first.join(landed.select("feed_id", "guid"), ["feed_id", "guid"], "left_anti").select("feed_id", "guid", "link", "content", "pos")


def feed_fetch_summary(feeds: DataFrame, fetches: DataFrame, now: str = NOW) -> DataFrame:
    """Feeds (feed_id, title, site_url, last_fetched_at) after fetches (feed_id, error, inserted,
    new_title, new_site_url): inserted counts; on success alone last_fetched_at moves, a title is filled
    in where there is none, and site_url is the new one, even if that is null. A feed that was not
    fetched stays as it is."""
    both = feeds.select("feed_id", "title", "site_url", "last_fetched_at").join(fetches.withColumn("fetched", F.lit(True)), "feed_id", "left")
    good = F.coalesce(F.col("fetched") & F.col("error").isNull(), F.lit(False))
    return both.select(
        "feed_id", F.when(good, F.coalesce("title", "new_title")).otherwise(F.col("title")).alias("title"),
        F.when(good, F.col("new_site_url")).otherwise(F.col("site_url")).alias("site_url"), F.coalesce("inserted", F.lit(0)).alias("inserted"),
        F.when(good, at(now)).otherwise(F.col("last_fetched_at")).alias("last_fetched_at"),
    )


def plain_text(html: Column) -> Column:
    """Text of HTML: script and style blocks go, then tags, then six entities in a fixed order (so
    `&amp;lt;` gives `<`), blanks are collapsed and cut at the ends."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    text = F.regexp_replace(text, r"(?i)&nbsp;", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def text_profile(docs: DataFrame, html: str = "html") -> DataFrame:
    """The rows with text, body_len and tokens (null for a null body), thin and gate_ok."""
    out = docs.withColumn("text", plain_text(F.col(html))).withColumn("body_len", F.length("text").cast("long")).withColumn("tokens", text_tokens(F.col("text")))
    return out.withColumn("thin", F.coalesce("body_len", F.lit(0)) < THIN_BODY).withColumn("gate_ok", F.coalesce("body_len", F.lit(0)) >= EMBED_GATE)


def text_profile_report(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.count("*").alias("n"), F.count_if(F.col("body_len").isNull()).alias("unknown"), F.count_if(F.col("body_len") >= EMBED_GATE).alias("over_gate"),
        F.count_if("thin").alias("thin"),
    )


def enrich_candidates(articles: DataFrame, limit: int = 20) -> DataFrame:
    """Thin articles (a body of unknown length is thin) without summary, with a url, that were not
    enriched before: each is tried once. Newest first (nulls last, ties by id)."""
    thin = articles.where(F.col("summary").isNull() & F.col("enriched_at").isNull() & F.col("url").isNotNull() & (F.coalesce("body_len", F.lit(0)) < THIN_BODY))
    return thin.orderBy(F.desc_nulls_last("published_at"), "article_id").limit(limit)


def replace_bodies(articles: DataFrame, fetched: DataFrame, cap: int = 2000) -> DataFrame:
    """Bodies replaced by fetched ones (article_id, new_text) that are strictly longer, both cut at
    `cap` characters; a replaced one loses its vector. outcome: enriched, failed or kept."""
    joined = articles.join(fetched, "article_id", "left")
    longer = F.least(F.length("new_text"), F.lit(cap)) > F.coalesce(F.least(F.length("content"), F.lit(cap)), F.lit(0))
    outcome = F.when(F.col("new_text").isNull(), "kept").when(longer, "enriched").otherwise("failed")
    out = joined.withColumn("outcome", outcome)
    accepted = F.col("outcome") == "enriched"
    return out.withColumns({
        "content": F.when(accepted, F.col("new_text")).otherwise(F.col("content")),
        "embedding": F.when(~accepted, F.col("embedding")), "embedded_at": F.when(~accepted, F.col("embedded_at")),
    }).drop("new_text")


def prune_embeddings(articles: DataFrame, now: str = NOW, days: int = RETENTION_DAYS) -> DataFrame:
    """Vectors of articles older than `days`, or without a date, go; embedded_at stays."""
    old = F.col("published_at").isNull() | (F.col("published_at") < at(now) - F.expr(f"interval {days} days"))
    pruned = old & F.col("embedding").isNotNull()
    return articles.withColumn("pruned", pruned).withColumn("embedding", F.when(~old, F.col("embedding")))


def registry_apply(feeds: DataFrame, commands: DataFrame) -> DataFrame:
    """Feeds after a command log (feed_id, command, ts, seq): the latest command of a feed wins. add
    inserts if absent, activate and deactivate set the flag, delete removes."""
    last = commands.groupBy("feed_id").agg(F.max_by("command", F.struct("ts", "seq")).alias("command"))
    both = feeds.select("feed_id", "active").withColumn("known", F.lit(True)).join(last, "feed_id", "full")
    both = both.where("command is null or command <> 'delete'").where("known or command = 'add'")
    active = F.when(F.col("command") == "deactivate", False).when(F.col("command") == "activate", True).otherwise(F.coalesce("active", F.lit(True)))
    return both.select("feed_id", active.alias("active"), F.coalesce("known", F.lit(False)).alias("known"))


def cascade_delete(children: DataFrame, feeds: DataFrame) -> DataFrame:
    return children.join(feeds.select("feed_id"), "feed_id", "left_semi")


def prune_vector_partitions(vectors: PartitionTable, now: str = NOW, days: int = RETENTION_DAYS) -> tuple[int, int]:
    """Vectors of articles older than `days`, or without a date, leave a table (article_id,
    published_at, embedding) that is partitioned by day ("none" without a date); how many went and how
    many are left. Whole old days go unread; only the day that the limit falls into is written anew,
    and younger ones keep their files."""
    limit = vectors.spark.range(1).select((at(now) - F.expr(f"interval {days} days")).alias("t")).select("t", F.to_date("t").cast("string").alias("day")).first()
    old = [day for day in vectors.versions() if day == "none" or day < limit["day"]]
    gone = vectors.read(old).count()
    for day in old:
        vectors.drop(day)
    if limit["day"] in vectors.versions():
        rows = vectors.read([limit["day"]])
        young = rows.where(F.col("published_at") >= F.lit(limit["t"]))
        late = rows.count() - young.count()
        if late:
            vectors.replace(young, limit["day"])
            gone += late
    return gone, vectors.read().count()


def registry_fold(feeds: DataFrame, candidates: DataFrame, cards: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feeds, candidates and cards after one log of commands (target, key, command, ts, seq) on all three.

    Feeds (url, active, title, credibility): add inserts an active one if absent; activate and
    deactivate set the flag of a feed that is there; delete removes it. Candidates (candidate_id, url,
    title, credibility, status): approve makes it approved and inserts its feed, if absent, with its
    title and credibility; reject makes it rejected. Cards (card_id, status): approve and reject. The
    latest command of a key decides its flag or status; a feed that was deleted is new when it is
    inserted again, so `kept` (its articles stay) is only true of feeds that no command deleted.
    Commands on keys that are not there do nothing. No key's commands are gathered: each step is a
    partially aggregated minimum or maximum.
    """
    order = F.struct("ts", "seq")
    log = commands.select("target", "key", "command", order.alias("at"))
    latest = lambda target: log.where(F.col("target") == target).groupBy("key").agg(F.max_by("command", "at").alias("command"))
    status = lambda old: F.when(F.col("command") == "approve", "approved").when(F.col("command") == "reject", "rejected").otherwise(F.col(old))
    of_candidate, of_card = latest("candidate").withColumnRenamed("key", "candidate_id"), latest("card").withColumnRenamed("key", "card_id")
    new_candidates = candidates.join(of_candidate, "candidate_id", "left").withColumn("status", status("status")).drop("command")
    new_cards = cards.join(of_card, "card_id", "left").withColumn("status", status("status")).drop("command")

    approvals = log.where("target = 'candidate' and command = 'approve'").join(candidates.withColumnRenamed("candidate_id", "key"), "key")
    events = log.where("target = 'feed'").select(F.col("key").alias("url"), "command", "at", F.lit(None).cast("string").alias("title"), F.lit(0.0).alias("credibility"))
    events = events.union(approvals.select("url", F.lit("add"), "at", "title", "credibility"))
    deleted = events.where("command = 'delete'").groupBy("url").agg(F.max("at").alias("deleted"))
    rest = events.where("command <> 'delete'").join(deleted, "url", "left").where(F.col("deleted").isNull() | (F.col("at") > F.col("deleted")))
    added = rest.where("command = 'add'").groupBy("url").agg(F.min_by(F.struct("at", "title", "credibility"), "at").alias("made"))
    known = feeds.select("url", "active", "title", "credibility").withColumn("known", F.lit(True)).join(deleted, "url", "full")
    known = known.withColumn("known", F.coalesce("known", F.lit(False)) & F.col("deleted").isNull()).join(added, "url", "full").withColumn("known", F.coalesce("known", F.lit(False)))
    there = known.where(F.col("known") | F.col("made").isNotNull())
    flags = rest.where("command in ('activate', 'deactivate')").join(there.select("url", F.when(~F.col("known"), F.col("made.at")).alias("born")), "url")
    flags = flags.where(F.col("born").isNull() | (F.col("at") > F.col("born"))).groupBy("url").agg((F.max_by("command", "at") == "activate").alias("flag"))
    mine = lambda c: F.when(F.col("known"), F.col(c)).otherwise(F.col(f"made.{c}")).alias(c)
    active = F.coalesce("flag", F.when(F.col("known"), F.col("active")), F.lit(True)).alias("active")
    new_feeds = there.join(flags, "url", "left").select("url", active, mine("title"), mine("credibility"), F.col("known").alias("kept"))
    return new_feeds, new_candidates, new_cards


def article_flags(articles: DataFrame, toggles: DataFrame) -> DataFrame:
    """is_read and is_starred after (article_id, flag) events: an odd number of toggles turns a flag,
    an "open" makes an article read."""
    counts = toggles.groupBy("article_id").agg(
        F.count_if(F.col("flag") == "read").alias("r"), F.count_if(F.col("flag") == "star").alias("s"), F.count_if(F.col("flag") == "open").alias("o")
    )
    out = articles.select("article_id", "is_read", "is_starred").join(counts, "article_id", "left").na.fill(0, ["r", "s", "o"])
    turned = lambda flag, n: F.col(flag) != (F.col(n) % 2 == 1)
    return out.select("article_id", (turned("is_read", "r") | (F.col("o") > 0)).alias("is_read"), turned("is_starred", "s").alias("is_starred"))


def credibility_label(column: str = "credibility") -> Column:
    return F.when(F.col(column) >= 1.0, "high").when(F.col(column) >= 0.3, "mid").otherwise("low")


def pending_lists(candidates: DataFrame, learn_sources: DataFrame) -> DataFrame:
    """What waits for a decision, newest first: candidates (candidate_id, status, credibility,
    discovered_from, created_at) with credibility in words and where they are from, and learning
    sources (source_id, status, created_at). kind, id, place, label, from_kind, sources, slug."""
    found = parse_provenance(candidates.where("status = 'pending'")).select(
        F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id"), "created_at", credibility_label().alias("label"), F.col("kind").alias("from_kind"), "sources", "slug"
    )
    none = F.lit(None)
    learn = learn_sources.where("status = 'pending'").select(F.lit("learn_source"), "source_id", "created_at", none, none, none, none)
    order = Window.partitionBy("kind").orderBy(F.desc("created_at"), "id")
    return found.union(learn).withColumn("place", F.row_number().over(order).cast("long")).drop("created_at")


def source_lists(feeds: DataFrame) -> DataFrame:
    """Feeds, active ones first, newest first in each; credibility in words."""
    label = credibility_label()
    order = Window.orderBy(F.desc("active"), F.desc("created_at"), "feed_id")
    return feeds.select("feed_id", "active", label.alias("label"), F.row_number().over(order).cast("long").alias("place"))


def parse_provenance(candidates: DataFrame, column: str = "discovered_from") -> DataFrame:
    """kind, count and slug of `article-links:{n}src` (n > 0) and `preference:{slug}`; else other."""
    n = F.regexp_extract(column, r"^article-links:(\d+)src$", 1).try_cast("long")
    slug = F.regexp_extract(column, r"^preference:(.+)$", 1)
    kind = F.when(n > 0, "article-links").when(slug != "", "preference").otherwise("other")
    return candidates.withColumns({"kind": kind, "sources": F.when(n > 0, n), "slug": F.when(slug != "", slug)})
