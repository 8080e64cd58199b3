"""Queries of landing and snapshots."""

from pyspark.sql import functions as F

from gleanery.constants import NOW
from gleanery.operators import landing as op
from gleanery.plans.registry import query
from gleanery.sources.partitions import PartitionTable
from gleanery.sources.shared import shared_folder
from gleanery.sources.views import Views

NOW_SQL = f"TIMESTAMP '{NOW}'"


@query("a1_land_items", """WITH keyed AS (
  SELECT r.feed_id, coalesce(guid, link, '') AS guid, link, coalesce(encoded, content) AS content, pos FROM raw_items r JOIN feeds f ON f.feed_id = r.feed_id AND f.active)
SELECT feed_id, guid, link, content, pos FROM keyed k WHERE guid <> '' AND NOT EXISTS (SELECT 1 FROM landed l WHERE l.feed_id = k.feed_id AND l.guid = k.guid)
QUALIFY row_number() OVER (PARTITION BY feed_id, guid ORDER BY pos) = 1""")
def a1(v: Views):
    return op.land_items(v.raw_items, v.feeds, v.landed)


@query("a2_feed_fetch_summary", f"""SELECT feed_id, CASE WHEN idx % 6 <> 1 AND error IS NULL THEN coalesce(title, new_title) ELSE title END AS title,
  CASE WHEN idx % 6 <> 1 AND error IS NULL THEN new_site_url ELSE site_url END AS site_url, CASE WHEN idx % 6 <> 1 THEN inserted ELSE 0 END AS inserted,
  CAST(CASE WHEN idx % 6 <> 1 AND error IS NULL THEN {NOW_SQL} ELSE last_fetched_at END AS VARCHAR) AS last_fetched_at FROM fetches JOIN (SELECT feed_id, idx FROM feeds) f USING (feed_id)""")
def a2(v: Views):
    fetched = v.fetches.join(v.feeds.where("idx % 6 <> 1"), "feed_id", "left_semi").select("feed_id", "error", "inserted", "new_title", "new_site_url")
    out = op.feed_fetch_summary(v.fetches.select("feed_id", "title", "site_url", "last_fetched_at"), fetched)
    return out.withColumn("last_fetched_at", F.col("last_fetched_at").cast("string"))


_TEXT = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<script.*?</script>|<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '&nbsp;', ' ', 'gi'),
  '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM pages"""


@query("a3_text_profile", f"""SELECT page_id, text, length(text) AS body_len, CAST(ceil(CAST(0.4 AS DOUBLE) * length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + CAST(1.5 AS DOUBLE) * (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))) AS BIGINT) AS tokens,
  length(text) < 300 AS thin, length(text) >= 250 AS gate_ok FROM ({_TEXT})""")
def a3(v: Views):
    return op.text_profile(v.pages).select("page_id", "text", "body_len", "tokens", "thin", "gate_ok")


@query("a4_text_profile_report", f"""SELECT count(*) AS n, count(*) FILTER (text IS NULL) AS unknown, count(*) FILTER (length(text) >= 250) AS over_gate,
  count(*) FILTER (coalesce(length(text), 0) < 300) AS thin FROM ({_TEXT})""")
def a4(v: Views):
    return op.text_profile_report(op.text_profile(v.pages))


@query("a5_enrich_candidates", """SELECT article_id, body_len FROM articles WHERE summary IS NULL AND enriched_at IS NULL AND url IS NOT NULL AND coalesce(body_len, 0) < 300
ORDER BY published_at DESC NULLS LAST, article_id LIMIT 20""")
def a5(v: Views):
    return op.enrich_candidates(v.articles).select("article_id", "body_len")


def fetched(v: Views):
    return v.pages.select(F.col("page_id").alias("article_id"), op.plain_text(F.col("html")).alias("new_text"))


@query("a6_replace_bodies", f"""SELECT article_id, outcome, CASE WHEN outcome = 'enriched' THEN length(t) ELSE length(content) END AS new_len,
  outcome <> 'enriched' AND embedding IS NOT NULL AS has_vector FROM (
  SELECT a.*, p.text AS t, CASE WHEN p.text IS NULL THEN 'kept' WHEN least(length(p.text), 2000) > coalesce(least(length(content), 2000), 0) THEN 'enriched' ELSE 'failed' END AS outcome
  FROM articles a LEFT JOIN ({_TEXT}) p ON p.page_id = a.article_id)""")
def a6(v: Views):
    out = op.replace_bodies(v.articles, fetched(v))
    return out.select("article_id", "outcome", F.length("content").cast("long").alias("new_len"), F.col("embedding").isNotNull().alias("has_vector"))


@query("a7_prune_embeddings", f"""SELECT article_id, embedding IS NOT NULL AND (published_at IS NULL OR published_at < {NOW_SQL} - INTERVAL 35 DAY) AS pruned,
  coalesce(embedding IS NOT NULL AND published_at >= {NOW_SQL} - INTERVAL 35 DAY, false) AS has_vector FROM articles""")
def a7(v: Views):
    out = op.prune_embeddings(v.articles)
    return out.select("article_id", "pruned", F.col("embedding").isNotNull().alias("has_vector"))


@query("a7_prune_partitions", f"""SELECT article_id, (SELECT count(*) FROM articles WHERE embedding IS NOT NULL AND NOT coalesce(published_at >= {NOW_SQL} - INTERVAL 35 DAY, false)) AS pruned
FROM articles WHERE embedding IS NOT NULL AND published_at >= {NOW_SQL} - INTERVAL 35 DAY""")
def a7_partitions(v: Views):
    table = PartitionTable(v.spark, shared_folder(v.spark, "vectors"), "article_id long, published_at timestamp, embedding array<float>", "day")
    dated = v.articles.where("embedding is not null").withColumn("published_at", F.col("published_at").cast("timestamp"))
    table.load(dated.withColumn("day", F.coalesce(F.to_date("published_at").cast("string"), F.lit("none"))))
    gone, _ = op.prune_vector_partitions(table)
    return table.read().select("article_id", F.lit(gone).cast("long").alias("pruned"))


LOG = """SELECT target, CASE target WHEN 'feed' THEN concat('https://src', CAST(user_id % 30 AS STRING), '.example.org/feed') WHEN 'candidate' THEN CAST(event_id % 90 AS STRING) ELSE CAST(user_id * 100 + event_id % 6 AS STRING) END AS key,
  CASE WHEN target = 'feed' THEN CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'activate' WHEN 'purchase' THEN 'deactivate' WHEN 'signup' THEN 'delete' ELSE 'add' END
    WHEN event_type IN ('view', 'click', 'purchase') THEN 'approve' ELSE 'reject' END AS command, ts, event_id AS seq
FROM (SELECT *, CASE event_id % 11 WHEN 0 THEN 'feed' WHEN 1 THEN 'candidate' ELSE 'card' END AS target FROM {events} WHERE event_id % 4 < 3) e"""


@query("a8_command_log", f"""WITH log AS ({LOG.replace('{events}', 'events')}),
cs AS (SELECT key, arg_max(command, seq) AS command FROM log WHERE target = 'candidate' GROUP BY 1), ks AS (SELECT key, arg_max(command, seq) AS command FROM log WHERE target = 'card' GROUP BY 1),
ev AS (SELECT key AS url, command, seq, CAST(NULL AS VARCHAR) AS title, CAST(0 AS DOUBLE) AS credibility FROM log WHERE target = 'feed'
  UNION ALL SELECT url, 'add', seq, title, credibility FROM log JOIN feed_candidates c ON target = 'candidate' AND command = 'approve' AND key = CAST(candidate_id AS VARCHAR)),
st AS (SELECT url, active, CAST(NULL AS VARCHAR) AS title, credibility, true AS known FROM feeds),
dl AS (SELECT url, max(seq) AS d FROM ev WHERE command = 'delete' GROUP BY 1),
re AS (SELECT ev.*, d FROM ev LEFT JOIN dl USING (url) WHERE command <> 'delete' AND (d IS NULL OR seq > d)),
ad AS (SELECT url, min(seq) AS born, arg_min(struct_pack(t := title, c := credibility), seq) AS made FROM re WHERE command = 'add' GROUP BY 1),
th AS (SELECT u.url, coalesce(known, false) AND d IS NULL AS kept, active, st.title, st.credibility, born, made FROM (SELECT url FROM st UNION SELECT url FROM ev) u LEFT JOIN st USING (url) LEFT JOIN dl USING (url) LEFT JOIN ad USING (url)
  WHERE (coalesce(known, false) AND d IS NULL) OR born IS NOT NULL),
fl AS (SELECT url, arg_max(command, seq) = 'activate' AS flag FROM re JOIN th USING (url) WHERE command IN ('activate', 'deactivate') AND (kept OR seq > th.born) GROUP BY 1),
nf AS (SELECT url, coalesce(flag, CASE WHEN kept THEN active END, true) AS active, CASE WHEN kept THEN title ELSE made.t END AS title, CASE WHEN kept THEN credibility ELSE made.c END AS credibility, kept FROM th LEFT JOIN fl USING (url))
SELECT 'feed' AS kind, nf.url AS key, CASE WHEN nf.active THEN 'active' ELSE 'inactive' END AS state, title, nf.credibility, coalesce(n, 0) AS articles
FROM nf LEFT JOIN (SELECT f.url, count(*) AS n FROM articles a JOIN feeds f ON f.feed_id = a.feed_id GROUP BY f.url) a ON a.url = nf.url AND kept
UNION ALL SELECT 'candidate', CAST(candidate_id AS VARCHAR), CASE command WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE status END, title, credibility, 0
FROM feed_candidates LEFT JOIN cs ON key = CAST(candidate_id AS VARCHAR)
UNION ALL SELECT 'card', CAST(card_id AS VARCHAR), CASE command WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE status END, NULL, NULL, 0 FROM cards LEFT JOIN ks ON key = CAST(card_id AS VARCHAR)""")
def a8_log(v: Views):
    known = v.feeds.select("url", "active", F.lit(None).cast("string").alias("title"), "credibility")
    candidates = v.feed_candidates.withColumn("candidate_id", F.col("candidate_id").cast("string"))
    feeds, candidates, cards = op.registry_fold(known, candidates, v.cards.withColumn("card_id", F.col("card_id").cast("string")), v.sql(LOG))
    per = v.articles.select("feed_id").join(v.feeds.select("feed_id", "url"), "feed_id").join(feeds.where("kept").select("url"), "url", "left_semi")
    feeds = feeds.join(per.groupBy("url").agg(F.count("*").alias("articles")), "url", "left").na.fill(0, ["articles"])
    none = F.lit(0).cast("long")
    return feeds.select(F.lit("feed").alias("kind"), F.col("url").alias("key"), F.when(F.col("active"), "active").otherwise("inactive").alias("state"), "title", "credibility", "articles").union(
        candidates.select(F.lit("candidate"), "candidate_id", "status", "title", "credibility", none)
    ).union(cards.select(F.lit("card"), "card_id", "status", F.lit(None), F.lit(None), none))


COMMANDS = """SELECT concat('src', CAST(user_id % 30 AS STRING)) AS feed_id, CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'activate'
  WHEN 'purchase' THEN 'deactivate' WHEN 'signup' THEN 'delete' ELSE 'add' END AS command, ts, event_id AS seq FROM {events}"""


@query("a8_registry_apply", f"""WITH c AS ({COMMANDS.replace('{events}', 'events')}), last AS (SELECT feed_id, arg_max(command, seq) AS command FROM c GROUP BY 1)
SELECT coalesce(f.feed_id, l.feed_id) AS feed_id, CASE l.command WHEN 'deactivate' THEN false WHEN 'activate' THEN true ELSE coalesce(f.active, true) END AS active,
  f.feed_id IS NOT NULL AS known, coalesce(n, 0) AS articles FROM feeds f FULL JOIN last l ON f.feed_id = l.feed_id
  LEFT JOIN (SELECT feed_id, count(*) AS n FROM articles GROUP BY 1) a ON a.feed_id = coalesce(f.feed_id, l.feed_id)
WHERE (l.command IS NULL OR l.command <> 'delete') AND (f.feed_id IS NOT NULL OR l.command = 'add')""")
def a8(v: Views):
    feeds = op.registry_apply(v.feeds, v.sql(COMMANDS))
    n = op.cascade_delete(v.articles, feeds).groupBy("feed_id").agg(F.count("*").alias("articles"))
    return feeds.join(n, "feed_id", "left").na.fill(0, ["articles"])


TOGGLES = """SELECT (event_id * 17) % c.n AS article_id, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'read' ELSE 'star' END AS flag
FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {documents}) c WHERE event_id % 3 = 0"""


@query("a9_article_flags", f"""WITH t AS ({TOGGLES.replace('{events}', 'events').replace('{documents}', 'documents')}),
n AS (SELECT article_id, count(*) FILTER (flag = 'read') AS r, count(*) FILTER (flag = 'star') AS s, count(*) FILTER (flag = 'open') AS o FROM t GROUP BY 1)
SELECT a.article_id, (is_read <> (coalesce(r, 0) % 2 = 1)) OR coalesce(o, 0) > 0 AS is_read, is_starred <> (coalesce(s, 0) % 2 = 1) AS is_starred
FROM articles a LEFT JOIN n ON n.article_id = a.article_id""")
def a9(v: Views):
    return op.article_flags(v.articles, v.sql(TOGGLES))


@query("a11_source_lists", """SELECT feed_id, active, CASE WHEN credibility >= 1 THEN 'high' WHEN credibility >= 0.3 THEN 'mid' ELSE 'low' END AS label,
  row_number() OVER (ORDER BY active DESC, created_at DESC, feed_id) AS place FROM feeds""")
def a11(v: Views):
    return op.source_lists(v.feeds)


@query("a11_pending_lists", """WITH p AS (SELECT *, TRY_CAST(regexp_extract(discovered_from, '^article-links:(\\d+)src$', 1) AS BIGINT) AS n, regexp_extract(discovered_from, '^preference:(.+)$', 1) AS s FROM feed_candidates WHERE status = 'pending')
SELECT 'candidate' AS kind, candidate_id AS id, CASE WHEN credibility >= 1 THEN 'high' WHEN credibility >= 0.3 THEN 'mid' ELSE 'low' END AS label,
  CASE WHEN n > 0 THEN 'article-links' WHEN s <> '' THEN 'preference' ELSE 'other' END AS from_kind, CASE WHEN n > 0 THEN n ELSE 0 END AS sources, CASE WHEN s <> '' THEN s END AS slug,
  row_number() OVER (ORDER BY created_at DESC, candidate_id) AS place FROM p
UNION ALL SELECT 'learn_source', source_id, NULL, NULL, 0, NULL, row_number() OVER (ORDER BY created_at DESC, source_id) FROM learn_sources WHERE status = 'pending'""")
def a11_pending(v: Views):
    return op.pending_lists(v.feed_candidates, v.learn_sources).na.fill(0, ["sources"])


PROVENANCE = """SELECT s_suppkey AS candidate_id, CASE WHEN s_suppkey % 3 = 0 THEN concat('article-links:', CAST(s_suppkey % 5 AS STRING), 'src')
  WHEN s_suppkey % 3 = 1 THEN concat('preference:tech/', CAST(s_nationkey AS STRING)) ELSE s_name END AS discovered_from FROM {supplier}"""


@query("a11_provenance", f"""WITH c AS ({PROVENANCE.replace('{supplier}', 'supplier')}),
p AS (SELECT *, TRY_CAST(regexp_extract(discovered_from, '^article-links:(\\d+)src$', 1) AS BIGINT) AS n, regexp_extract(discovered_from, '^preference:(.+)$', 1) AS s FROM c)
SELECT candidate_id, discovered_from, CASE WHEN n > 0 THEN 'article-links' WHEN s <> '' THEN 'preference' ELSE 'other' END AS kind,
  CASE WHEN n > 0 THEN n ELSE 0 END AS sources, CASE WHEN s <> '' THEN s END AS slug FROM p""")
def a11b(v: Views):
    return op.parse_provenance(v.sql(PROVENANCE)).na.fill(0, ["sources"])
