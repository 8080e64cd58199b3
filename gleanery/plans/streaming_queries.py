"""Queries that run a stream over a table's files and return what it wrote."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.constants import NOW
from gleanery.plans.landing_queries import a1  # noqa: F401
from gleanery.plans.learning_queries import FOLD
from gleanery.plans.ranking_queries import REBUILT
from gleanery.plans.registry import query
from gleanery.sources.shared import shared_folder
from gleanery.sources.views import Views
from gleanery.streaming import jobs


def _folder(v: Views) -> str:
    return shared_folder(v.spark, "stream")


def _as_stream(v: Views, df, folder: str):
    """The rows as a file source."""
    df.write.parquet(f"{folder}/in")
    return v.spark.readStream.schema(df.schema).parquet(f"{folder}/in")


def _rocksdb(v: Views):
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("s1_stream_land_items", """WITH keyed AS (
  SELECT r.feed_id, coalesce(guid, link, '') AS guid, link, coalesce(encoded, content) AS content, pos FROM raw_items r JOIN feeds f ON f.feed_id = r.feed_id AND f.active)
SELECT feed_id, guid, link, content, pos FROM keyed k WHERE guid <> '' QUALIFY row_number() OVER (PARTITION BY feed_id, guid ORDER BY pos) = 1""")
def s1(v: Views):
    folder = _folder(v)
    feeds = v.feeds.select("feed_id", "active")
    jobs.stream_land_items(_as_stream(v, v.raw_items, folder), feeds, f"{folder}/out", f"{folder}/state").awaitTermination()
    return v.spark.read.schema("feed_id string, guid string, link string, content string, pos long").parquet(f"{folder}/out")


@query("s2_stream_preferences", f"""WITH {REBUILT} SELECT tenant, pref_key, round(CAST(sum(w) AS DOUBLE) + 0.0000001, 4) AS weight FROM each GROUP BY 1, 2""")
def s2(v: Views):
    _rocksdb(v)
    folder = _folder(v)
    keys = v.article_tags.select("article_id", F.col("tag").alias("k")).union(v.articles.select("article_id", F.col("feed_id")))
    keys = keys.groupBy("article_id").agg(F.sort_array(F.collect_list("k")).alias("keys"))
    stream = _as_stream(v, v.feedback.join(keys, "article_id"), folder)
    jobs.run_to_table(jobs.stream_preferences(stream), f"{folder}/out", f"{folder}/state")
    deltas = v.spark.read.parquet(f"{folder}/out")
    return deltas.groupBy("tenant", "pref_key").agg(F.round(F.sum("delta") + 1e-7, 4).alias("weight"))


@query("s3_stream_mastery", f"WITH RECURSIVE {FOLD} SELECT tenant, concept_key, round(mastery + 0.00000003, 6) AS mastery, attempts FROM mas")
def s3(v: Views):
    _rocksdb(v)
    folder = _folder(v)
    jobs.run_to_table(jobs.stream_mastery(_as_stream(v, v.attempts, folder)), f"{folder}/out", f"{folder}/state", "update")
    rows = v.spark.read.parquet(f"{folder}/out")
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy("tenant", "concept_key").orderBy(F.desc("batch")))).where("n = 1")
    return last.select("tenant", "concept_key", F.round(F.col("mastery") + 3e-8, 6).alias("mastery"), "attempts")


#: The log of feeds: when they were made, last fetched and, some of them, failed since; then the time passes.
FEED_LOG = """SELECT feed_id, 'made' AS kind, created_at AS at FROM {fetches} UNION ALL SELECT feed_id, 'fetched', last_fetched_at FROM {fetches} WHERE last_fetched_at IS NOT NULL
UNION ALL SELECT feed_id, 'failed', coalesce(last_fetched_at, created_at) + INTERVAL '1' MINUTE FROM {fetches} WHERE error IS NOT NULL"""
TICK = f"SELECT '', 'tick', TIMESTAMP '{NOW}' + INTERVAL '1' SECOND"


@query("s4_stream_silent_feeds", f"""SELECT feed_id, CAST(coalesce(last_fetched_at, created_at) AS VARCHAR) AS last_seen FROM fetches
WHERE error IS NOT NULL AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(last_fetched_at, created_at))) / 3600000000.0 >= 24""")
def s4_silent(v: Views):
    _rocksdb(v)
    folder = _folder(v)
    log = v.sql(f"{FEED_LOG} UNION ALL {TICK}").withColumn("at", F.col("at").cast("timestamp"))
    jobs.run_to_table(jobs.stream_silent_feeds(_as_stream(v, log, folder)), f"{folder}/out", f"{folder}/state")
    silent = v.spark.read.schema("feed_id string, last_seen timestamp, failed boolean, batch int").parquet(f"{folder}/out").where("failed")
    return silent.select("feed_id", F.col("last_seen").cast("string").alias("last_seen"))


@query("s1_stream_first_copies", """SELECT feed_id, coalesce(guid, link, '') AS guid, count(*) - count(*) + 1 AS copies FROM raw_items WHERE coalesce(guid, link, '') <> '' GROUP BY 1, 2""")
def s1_bounded(v: Views):
    folder = _folder(v)
    rows = v.raw_items.withColumn("seen_at", F.expr(f"timestamp '{NOW}' + make_dt_interval(0, 0, 0, pos % 3000)"))
    jobs.run_to_table(jobs.stream_first_copies(_as_stream(v, rows, folder)), f"{folder}/out", f"{folder}/state")
    return v.spark.read.parquet(f"{folder}/out").groupBy("feed_id", "guid").agg(F.count("*").alias("copies"))


@query("s4_stream_source_activity", """SELECT feed_id, CAST(date_trunc('day', published_at) AS VARCHAR) AS day, count(*) AS items FROM articles WHERE published_at IS NOT NULL GROUP BY 1, 2""")
def s4(v: Views):
    folder = _folder(v)
    rows = v.articles.where("published_at is not null").select("feed_id", F.col("published_at").cast("timestamp").alias("published_at"))
    jobs.run_to_table(jobs.stream_source_activity(_as_stream(v, rows, folder)), f"{folder}/out", f"{folder}/state", "update")
    last = Window.partitionBy("feed_id", "window").orderBy(F.desc("batch"))
    counts = v.spark.read.parquet(f"{folder}/out").withColumn("n", F.row_number().over(last)).where("n = 1")
    day = F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")
    return counts.select("feed_id", day.alias("day"), "items")
