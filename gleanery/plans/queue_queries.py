"""Queries of work queues, ledgers and guards."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from gleanery.constants import NOW
from gleanery.functions.text import text_tokens
from gleanery.operators import queues as op
from gleanery.operators.health import hours_since, stale_fetch
from gleanery.operators.landing import at
from gleanery.plans.registry import query
from gleanery.sources.shared import written
from gleanery.sources.views import Views

T = f"TIMESTAMP '{NOW}'"
#: The ledger of rounds is of the nineties.
LEDGER_NOW = "1998-07-01 12:00:00"


def text(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


ELIGIBLE = f"""el AS (SELECT a.article_id, a.feed_id, a.published_at, f.credibility FROM articles a JOIN feeds f ON f.feed_id = a.feed_id AND f.active
  JOIN leases l ON l.article_id = a.article_id AND attempts < 3 AND (reserved_until IS NULL OR reserved_until < {T}) WHERE summary IS NULL AND content IS NOT NULL),
pool AS (SELECT CAST(sum(least(n, 4)) AS BIGINT) AS pool, bool_or(n > 4) AS pool_capped FROM (SELECT feed_id, count(*) AS n FROM el GROUP BY 1))"""


@query("f1_claim_work", f"""WITH {ELIGIBLE} SELECT article_id, feed_id, rank, '2024-02-01 06:00:00' AS reserved_until, pool, pool_capped FROM (
  SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC NULLS LAST, article_id) AS rank FROM el QUALIFY rank <= 4) r CROSS JOIN pool
ORDER BY rank, credibility DESC, published_at DESC NULLS LAST, article_id LIMIT 30""")
def f1(v: Views):
    out = op.claim_work(v.articles, v.feeds, v.leases, per_feed=4, max_rows=30)
    return text(out, "reserved_until").select("article_id", "feed_id", F.col("rank").cast("long"), "reserved_until", "pool", "pool_capped")


OUTCOMES = """SELECT doc_id AS article_id, CASE WHEN doc_id % 12 = 0 THEN TIMESTAMP '2024-01-31 07:00:00' ELSE TIMESTAMP '2024-01-31 06:00:00' END AS lease, doc_id % 18 = 0 AS charged,
  text AS error FROM {documents} WHERE doc_id % 3 = 0"""


@query("f2_settle_work", f"""WITH o AS ({OUTCOMES.replace('{documents}', 'documents')}), j AS (SELECT l.*, o.charged, o.error, coalesce(l.reserved_until = o.lease, false) AS hit FROM leases l LEFT JOIN o ON o.article_id = l.article_id)
SELECT article_id, CAST(attempts + CASE WHEN hit AND charged THEN 1 ELSE 0 END AS INT) AS attempts, CAST(CASE WHEN NOT hit THEN reserved_until END AS VARCHAR) AS reserved_until,
  CAST(CASE WHEN hit THEN {T} ELSE failed_at END AS VARCHAR) AS failed_at, md5(CASE WHEN hit THEN substr(error, 1, 500) ELSE last_error END) AS last_error, CASE WHEN hit AND charged THEN 'charged' WHEN hit THEN 'released' END AS settled FROM j""")
def f2(v: Views):
    return text(op.settle_work(v.leases, v.sql(OUTCOMES)), "reserved_until", "failed_at").withColumn("last_error", F.md5("last_error"))


@query("f2_settle_counts", """SELECT count(*) FILTER (doc_id % 18 = 0) AS charged, count(*) FILTER (doc_id % 18 <> 0) AS released FROM documents WHERE doc_id % 6 = 0 AND doc_id % 12 <> 0""")
def f2_counts(v: Views):
    return op.settle_counts(op.settle_work(v.leases, v.sql(OUTCOMES)))


FAILURES = """SELECT round_id, item_id, CASE (round_id + item_id) % 17 WHEN 0 THEN 'rate_limit_error' WHEN 1 THEN 'overloaded_error' WHEN 2 THEN 'api_error' WHEN 3 THEN 'timeout_error'
  WHEN 4 THEN 'authentication_error' WHEN 5 THEN 'billing_error' WHEN 6 THEN 'connection_error' WHEN 7 THEN '401' WHEN 8 THEN '429' WHEN 9 THEN '500' WHEN 10 THEN '503' WHEN 11 THEN '529'
  WHEN 12 THEN '400' WHEN 13 THEN '403' WHEN 14 THEN 'invalid_request_error' WHEN 15 THEN 'permission_error' ELSE NULL END AS error_type
FROM {round_results} WHERE outcome = 'errored'"""


@query("f3_attribute_failures", f"""WITH f AS ({FAILURES.replace('{round_results}', 'round_results')}), w AS (SELECT DISTINCT round_id FROM round_results WHERE outcome = 'succeeded')
SELECT f.*, round_id IN (SELECT round_id FROM w) AND (error_type IS NULL OR error_type IN ('400', '403', 'invalid_request_error', 'permission_error')) AS charged FROM f""")
def f3(v: Views):
    return op.attribute_failures(v.sql(FAILURES), v.round_results)


#: Items 1 to 5 of each round are expected; some results come twice.
EXPECTED = "SELECT r.round_id, i.item_id FROM {rounds} r CROSS JOIN (SELECT DISTINCT item_id FROM {round_results} WHERE item_id <= 3) i WHERE r.round_id % 7 = 0"
RESULTS = """SELECT round_id, item_id, outcome, tokens, 1 AS pos FROM {round_results} WHERE round_id % 7 = 0
UNION ALL SELECT round_id, item_id, 'errored', tokens, 2 FROM {round_results} WHERE round_id % 21 = 0 AND item_id = 1"""
FIRST = f"""ex AS ({EXPECTED.replace('{', '').replace('}', '')}), res AS ({RESULTS.replace('{', '').replace('}', '')}),
fi AS (SELECT *, row_number() OVER (PARTITION BY round_id, item_id ORDER BY pos, tokens, outcome) AS n FROM res),
bo AS (SELECT coalesce(e.round_id, f.round_id) AS round_id, e.round_id IS NOT NULL AS asked, outcome, tokens, n FROM ex e FULL JOIN fi f ON e.round_id = f.round_id AND e.item_id = f.item_id),
rec AS (SELECT round_id, count(*) FILTER (asked AND n = 1 AND outcome = 'succeeded') AS succeeded, count(*) FILTER (asked AND n = 1 AND outcome = 'errored') AS errored,
  count(*) FILTER (asked AND n = 1 AND outcome = 'expired') AS expired, count(*) FILTER (asked AND outcome IS NULL) AS missing, count(*) FILTER (NOT asked OR n > 1) AS unknown,
  CAST(coalesce(sum(tokens) FILTER (asked AND n = 1 AND outcome = 'succeeded'), 0) AS BIGINT) AS tokens, count(*) FILTER (asked AND n = 1 AND outcome = 'expired') AS release FROM bo GROUP BY 1)"""


def reconciled(v: Views):
    return op.reconcile_results(v.sql(EXPECTED), v.sql(RESULTS))


@query("f4_reconcile_results", f"WITH {FIRST} SELECT * FROM rec")
def f4(v: Views):
    return reconciled(v)


ANNOTATIONS = """SELECT doc_id AS article_id, concat('s', CAST(doc_id AS STRING)) AS summary_text, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-01-31 06:00:00' END AS lease,
  CASE WHEN doc_id % 3 = 0 THEN array(concat('tech/', CAST(doc_id % 8 AS STRING)), 'tech/1', 'tech/1') WHEN doc_id % 3 = 1 THEN array(CASE WHEN doc_id % 23 < 8 THEN concat('tech/', CAST(doc_id % 23 AS STRING)) ELSE concat('misc/', CAST(doc_id % 23 AS STRING)) END, NULL) END AS tags
FROM {documents} WHERE doc_id % 10 IN (0, 1, 5)"""


APPLIED = f"""an AS ({ANNOTATIONS.replace('{documents}', 'documents').replace('array(', 'list_value(')}), j AS (SELECT an.article_id, a.summary, summary_text,
  a.summary IS NULL AND NOT coalesce(reserved_until >= {T} AND (lease IS NULL OR lease <> reserved_until), false) AS ok
  FROM an JOIN articles a ON a.article_id = an.article_id LEFT JOIN leases l ON l.article_id = an.article_id)"""


@query("f5_apply_annotations", f"""WITH {APPLIED} SELECT article_id, CASE WHEN ok THEN summary_text ELSE summary END AS new_summary, CASE WHEN ok THEN 'applied' ELSE 'superseded' END AS outcome FROM j""")
def f5(v: Views):
    return op.apply_annotations(v.articles, v.leases, v.sql(ANNOTATIONS))


@query("f5_insert_tags", f"""WITH {APPLIED} SELECT DISTINCT article_id, tag, 'llm' AS source FROM (SELECT an.article_id, unnest(tags) AS tag FROM an JOIN j USING (article_id) WHERE ok) t
WHERE tag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM article_tags g WHERE g.article_id = t.article_id AND g.tag = t.tag)""")
def f5_tags(v: Views):
    annotations = v.sql(ANNOTATIONS)
    applied = op.apply_annotations(v.articles, v.leases, annotations).where("outcome = 'applied'")
    return op.insert_tags(v.article_tags, annotations.join(applied, "article_id", "left_semi"))


USAGE = f"""us AS (SELECT CAST(coalesce(sum(request_count) FILTER (submitted_at >= date_trunc('day', TIMESTAMP '{LEDGER_NOW}')), 0) AS BIGINT) AS used,
  CAST(coalesce(sum(request_count) FILTER (submitted_at >= date_trunc('day', TIMESTAMP '{LEDGER_NOW}') AND mode = 'batch'), 0) AS BIGINT) AS batch_used, count(*) FILTER (status = 'submitted') AS in_flight FROM rounds)"""


@query("f6_usage_and_plan", f"""WITH {USAGE} SELECT *, CASE WHEN in_flight >= 12 THEN 'inflight' WHEN 120 - used <= 0 THEN 'daily' WHEN 120 - batch_used <= 0 THEN 'batch' END AS reason,
  CAST(CASE WHEN in_flight >= 12 OR used >= 120 OR batch_used >= 120 THEN 0 ELSE least(20, 120 - used, 120 - batch_used) END AS BIGINT) AS submit, CAST(least(20, greatest(120 - used, 0)) AS BIGINT) AS sync FROM us""")
def f6(v: Views):
    return op.plan_submit(op.usage_today(v.rounds, LEDGER_NOW))


@query("f7_open_rounds", """SELECT *, problem IS NOT NULL AS malformed, CASE WHEN problem IS NULL THEN concat(round_id, ',x') END AS ids, CASE WHEN problem IS NULL THEN concat('t', round_id) END AS lease_deadline FROM (
  SELECT round_id, mode, CASE WHEN batch_id IS NULL THEN 'batch_id' ELSE CASE round_id % 13 WHEN 0 THEN 'selection' WHEN 1 THEN 'mode' WHEN 2 THEN 'ids' WHEN 3 THEN 'ids' WHEN 4 THEN 'lease_deadline' WHEN 5 THEN 'selection' WHEN 6 THEN 'selection' WHEN 7 THEN 'ids' END END AS problem
  FROM rounds WHERE status IN ('submitted', 'unresolved') ORDER BY submitted_at, round_id LIMIT 60) r""")
def f7(v: Views):
    return op.open_rounds(v.rounds, 60).select("round_id", "mode", "problem", "malformed", F.array_join("ids", ",").alias("ids"), "lease_deadline")


@query("f7_backlog", "SELECT count(*) AS open, CAST(min(submitted_at) AS VARCHAR) AS oldest FROM rounds WHERE status IN ('submitted', 'unresolved')")
def f7b(v: Views):
    return text(op.round_backlog(v.rounds), "oldest")


@query("f8_resolve_stale_rounds", f"""WITH s AS (SELECT round_id, mode FROM rounds WHERE status = 'claimed' AND submitted_at < TIMESTAMP '{LEDGER_NOW}' - INTERVAL 36 HOUR ORDER BY submitted_at, round_id LIMIT 50)
SELECT s.round_id, mode, 'expired_unknown' AS status, coalesce(CASE WHEN mode = 'batch' THEN item_id END, 0) AS item_id FROM s LEFT JOIN round_results r ON r.round_id = s.round_id""")
def f8(v: Views):
    return op.resolve_stale_rounds(v.rounds, v.round_results, LEDGER_NOW).na.fill(0, ["item_id"])


@query("f9_close_round", f"""WITH {FIRST} SELECT r.round_id, CASE WHEN succeeded IS NOT NULL AND status <> 'collected' THEN 'collected' ELSE status END AS status, coalesce(succeeded, 0) AS succeeded,
  coalesce(tokens, 0) AS tokens, coalesce(succeeded IS NOT NULL AND status <> 'collected' AND succeeded + errored + expired + missing <> request_count, false) AS mismatch
FROM rounds r LEFT JOIN rec ON rec.round_id = r.round_id""")
def f9(v: Views):
    return op.close_rounds(v.rounds, reconciled(v)).withColumn("mismatch", F.coalesce("mismatch", F.lit(False)))


@query("f10_quarantine_report", f"""WITH q AS (SELECT * FROM leases WHERE attempts >= 3 AND failed_at >= {T} - INTERVAL 24 HOUR)
SELECT article_id, CAST(failed_at AS VARCHAR) AS failed_at, (SELECT count(*) FROM q) AS total FROM q ORDER BY q.failed_at DESC, article_id LIMIT 10""")
def f10(v: Views):
    return text(op.quarantine_report(v.leases).select("article_id", "failed_at", "total"), "failed_at")


@query("f10_unquarantine", """SELECT article_id, CASE WHEN attempts >= 3 AND failed_at IS NOT NULL THEN 0 ELSE attempts END AS attempts, attempts >= 3 AND failed_at IS NOT NULL AS released FROM leases""")
def f10b(v: Views):
    return op.unquarantine(v.leases).select("article_id", "attempts", "released")


@query("f11_embed_candidates", f"""WITH done AS (SELECT feed_id, count(*) AS done FROM articles WHERE embedded_at >= {T} - INTERVAL 24 HOUR GROUP BY 1),
r AS (SELECT a.article_id, a.feed_id, a.published_at, a.content, 5 - coalesce(done, 0) AS room FROM articles a JOIN feeds f ON f.feed_id = a.feed_id AND f.active LEFT JOIN done d ON d.feed_id = a.feed_id
  WHERE embedding IS NULL AND coalesce(body_len, 0) >= 250 AND published_at >= {T} - INTERVAL 30 DAY),
e AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC, article_id) AS n FROM r QUALIFY n <= room)
SELECT article_id, feed_id, md5(substr(content, 1, 8000)) AS body, (SELECT count(*) FROM e) AS eligible FROM e ORDER BY published_at DESC, article_id LIMIT 40""")
def f11(v: Views):
    return op.embed_candidates(v.articles, v.feeds, per_day=5, max_rows=40).select("article_id", "feed_id", F.md5("body").alias("body"), "eligible")


PENDING = f"""done AS (SELECT feed_id, count(*) AS done FROM articles WHERE embedded_at >= {T} - INTERVAL 24 HOUR GROUP BY 1),
mi AS (SELECT a.article_id, a.feed_id, a.published_at, coalesce(body_len, 0) AS len, coalesce(done, 0) AS done FROM articles a JOIN feeds f ON f.feed_id = a.feed_id AND f.active LEFT JOIN done d ON d.feed_id = a.feed_id
  WHERE embedding IS NULL AND published_at >= {T} - INTERVAL 30 DAY),
ra AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC, article_id) AS n FROM mi WHERE len >= 250),
pe AS (SELECT count(*) AS gated, count(*) FILTER (n <= 5 - done) AS eligible, (SELECT count(*) FROM mi) AS every FROM ra),
closed AS (SELECT count(*) AS gated, count(*) FILTER (n <= 0 - done) AS eligible, (SELECT count(*) FROM mi) AS every FROM ra)"""


@query("f11_embed_pending", f"""WITH {PENDING} SELECT per_day, CASE WHEN eligible > 0 THEN gated ELSE every END AS pending, eligible > 0 AS pending_capped, eligible FROM (SELECT 5 AS per_day, * FROM pe UNION ALL SELECT 0, * FROM closed)""")
def f11_pending(v: Views):
    one = op.embed_pending(v.articles, v.feeds, per_day=5).select(F.lit(5).alias("per_day"), "*")
    return one.union(op.embed_pending(v.articles, v.feeds, per_day=0).select(F.lit(0), "*"))


@query("f12_embed_inputs", """SELECT article_id, md5(concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(substr(content, 1, 250)), ''))) AS input FROM articles WHERE coalesce(trim(title), '') <> '' OR coalesce(trim(substr(content, 1, 250)), '') <> ''""")
def f12(v: Views):
    made = v.articles.select("article_id", op.embed_input(F.col("title"), F.col("content")).alias("input")).where("input is not null")
    return made.withColumn("input", F.md5("input"))


#: Turns as cards and questions: front, back and cloze texts, some empty, and quotes.
FACES = """SELECT conv_id * 100 + turn AS card_id, CASE turn % 3 WHEN 0 THEN 'cloze' WHEN 1 THEN 'qa' ELSE 'quiz' END AS kind, CASE WHEN conv_id % 5 = 0 THEN '' ELSE role END AS front, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE text END AS back,
  CASE WHEN conv_id % 4 = 1 THEN NULL ELSE concat('of ', text) END AS cloze, CASE WHEN conv_id % 6 = 2 THEN '' ELSE text END AS quote FROM {conversations}"""


@query("f12_card_inputs", f"""WITH c AS ({FACES.replace('{conversations}', 'conversations')}), i AS (SELECT card_id, CASE kind
  WHEN 'quiz' THEN concat_ws(chr(10), nullif(trim(concat(coalesce(front, ''), ' ', CASE WHEN card_id % 3 = 0 THEN '' ELSE concat('a ', coalesce(back, 'z')) END)), ''), nullif(substr(quote, 1, 200), ''))
  WHEN 'cloze' THEN concat_ws(chr(10), nullif(cloze, ''), nullif(quote, '')) ELSE concat_ws(chr(10), nullif(concat_ws(' ', nullif(front, ''), nullif(back, '')), ''), nullif(quote, '')) END AS input FROM c)
SELECT card_id, md5(input) AS input FROM i WHERE input <> ''""")
def f12_cards(v: Views):
    faces = v.sql(FACES)
    choices = F.when(F.col("card_id") % 3 != 0, F.array(F.lit("a"), F.coalesce("back", F.lit("z"))))
    made = F.when(F.col("kind") == "quiz", op.quiz_embed_input(F.coalesce("front", F.lit("")), choices, F.col("quote"))).otherwise(
        op.card_embed_input(F.col("kind"), F.col("front"), F.col("back"), F.col("cloze"), F.col("quote"))
    )
    return faces.select("card_id", made.alias("input")).where("input is not null").withColumn("input", F.md5("input"))


@query("f13_summary_queue", "SELECT article_id FROM articles WHERE summary IS NULL AND content IS NOT NULL ORDER BY published_at DESC NULLS LAST, article_id LIMIT 50")
def f13_queue(v: Views):
    return op.summary_queue(v.articles, 50).select("article_id")


@query("f13_backfill_candidates", "SELECT article_id FROM articles WHERE embedding IS NULL ORDER BY published_at DESC NULLS LAST, article_id LIMIT 50")
def f13(v: Views):
    return op.backfill_candidates(v.articles, 50).select("article_id")


def sized(v: Views):
    return v.documents.select(F.col("source").alias("queue"), F.col("doc_id").alias("id"), text_tokens(F.col("text")).alias("tokens"))


@query("f14_token_batches", r"""WITH RECURSIVE t AS (SELECT source AS queue, doc_id AS id, CAST(ceil(CAST(0.4 AS DOUBLE) * length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) + CAST(1.5 AS DOUBLE) * (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')))) AS BIGINT) AS tokens,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT queue, id, tokens, k, CAST(0 AS BIGINT) AS batch, tokens AS used, 1 AS n FROM t WHERE k = 1
  UNION ALL SELECT t.queue, t.id, t.tokens, t.k, f.batch + CASE WHEN f.used + t.tokens > 3000 OR f.n + 1 > 128 THEN 1 ELSE 0 END,
    CASE WHEN f.used + t.tokens > 3000 OR f.n + 1 > 128 THEN t.tokens ELSE f.used + t.tokens END, CASE WHEN f.used + t.tokens > 3000 OR f.n + 1 > 128 THEN 1 ELSE f.n + 1 END
  FROM f JOIN t ON t.queue = f.queue AND t.k = f.k + 1)
SELECT queue, id, tokens, batch FROM f""")
def f14(v: Views):
    return op.token_batches(sized(v))


@query("f15_untagged", "SELECT article_id FROM articles a WHERE summary IS NOT NULL AND NOT EXISTS (SELECT 1 FROM article_tags t WHERE t.article_id = a.article_id AND t.tag LIKE 'tech/%')")
def f15(v: Views):
    return op.untagged(v.articles, v.article_tags.where("tag like 'tech/%'")).select("article_id")


MARKED = """SELECT doc_id AS article_id, CASE WHEN doc_id % 15 = 0 THEN concat('{{"summary": ', text) WHEN doc_id % 31 = 0 THEN concat('```', text) ELSE text END AS summary FROM {documents}"""


@query("f15_broken_annotations", f"""WITH m AS ({MARKED.replace('{documents}', 'documents').replace('{{', '{')}) SELECT article_id FROM m WHERE regexp_matches(summary, '"(summary|tags)"\\s*:|```')""")
def f15b(v: Views):
    return op.broken_annotations(v.sql(MARKED)).select("article_id")


@query("f17_reset_annotations", """SELECT count(*) AS articles, count(summary) AS summaries, (SELECT count(*) FROM article_tags) AS tags FROM articles WHERE content IS NOT NULL""")
def f17(v: Views):
    return op.reset_annotations(v.articles, v.article_tags)


@query("f18_apply_reannotations", """SELECT article_id, CASE WHEN (article_id % 4 = 0 OR summary IS NULL) AND article_id % 7 <> 0 THEN concat('n', CAST(article_id AS VARCHAR)) ELSE summary END AS summary,
  CASE WHEN article_id % 7 = 0 THEN 'failed' WHEN article_id % 3 = 0 THEN 'tagged' ELSE 'empty' END AS outcome FROM articles WHERE article_id % 2 = 0""")
def f18(v: Views):
    made = v.documents.where("doc_id % 2 = 0").selectExpr(
        "doc_id as article_id", "if(doc_id % 7 = 0, null, concat('n', cast(doc_id as string))) as summary_text", "doc_id % 4 = 0 as replaced", "if(doc_id % 3 = 0, array('t'), array()) as tags"
    )
    return op.apply_reannotations(v.articles, made)


SOURCES = """SELECT page_id AS source_id, CASE page_id % 3 WHEN 0 THEN 'pending' ELSE 'approved' END AS status, concat('tech/', CAST(page_id % 8 AS STRING)) AS category, html AS body,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST((page_id * 7) % 500 AS INT) END AS last_generated_at FROM {pages}"""


@query("f18_insert_tags", """SELECT DISTINCT article_id, tag, 'llm' AS source FROM (SELECT doc_id AS article_id, unnest([concat('tech/', doc_id % 8), 'misc/9']) AS tag FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0) t
WHERE NOT EXISTS (SELECT 1 FROM article_tags g WHERE g.article_id = t.article_id AND g.tag = t.tag)""")
def f18_tags(v: Views):
    made = v.documents.where("doc_id % 2 = 0").selectExpr("doc_id as article_id", "doc_id % 7 <> 0 as landed", "array(concat('tech/', cast(doc_id % 8 as string)), 'misc/9') as tags")
    return op.insert_tags(v.article_tags, made.where("landed"))


@query("f19_stamp_sources", f"""WITH s AS ({SOURCES.replace('{pages}', 'pages')}), p AS (SELECT source_id FROM s WHERE status = 'approved' AND body IS NOT NULL ORDER BY last_generated_at NULLS FIRST, source_id LIMIT 15)
SELECT source_id, CAST(CASE WHEN source_id IN (SELECT source_id FROM p) THEN {T} ELSE last_generated_at END AS VARCHAR) AS last_generated_at FROM s""")
def f19_stamp(v: Views):
    sources = v.sql(SOURCES)
    return text(op.stamp_sources(sources, op.rotate_sources(sources, 15)).select("source_id", "last_generated_at"), "last_generated_at")


@query("f19_source_stock", f"WITH s AS ({SOURCES.replace('{pages}', 'pages')}) SELECT category, count(*) FILTER (status = 'approved' AND body IS NOT NULL) AS stock FROM s GROUP BY 1")
def f19_stock(v: Views):
    return op.source_stock(v.sql(SOURCES))


@query("f19_rotate_sources", f"""WITH s AS ({SOURCES.replace('{pages}', 'pages')}) SELECT source_id, category FROM s WHERE status = 'approved' AND body IS NOT NULL ORDER BY last_generated_at NULLS FIRST, source_id LIMIT 15""")
def f19(v: Views):
    return op.rotate_sources(v.sql(SOURCES), 15).select("source_id", "category")


ACTIVITY = f"""(SELECT count(*) FILTER (embedded_at >= {T} - INTERVAL 26 HOUR) AS embedded_recent, count(*) FILTER (embedding IS NULL AND body_len >= 250) AS embed_waiting FROM articles)"""


@query("j2_activity_counts", f"SELECT * FROM {ACTIVITY}")
def j2(v: Views):
    return op.activity_counts(v.articles)


METRIC = f"""m AS (SELECT *, (SELECT count(*) FROM articles WHERE summary IS NOT NULL AND published_at >= {T} - INTERVAL 72 HOUR) AS deck,
  (SELECT count(*) FROM leases WHERE attempts >= 3 AND failed_at >= {T} - INTERVAL 24 HOUR) AS q, (SELECT count(*) FROM fetches) AS fetched, (SELECT count(error) FROM fetches) AS failed,
  (SELECT count(*) FROM fetches WHERE error IS NOT NULL AND (epoch_us({T}) - epoch_us(coalesce(last_fetched_at, created_at))) / 3600000000.0 >= 24) AS stale,
  (SELECT max((epoch_us({T}) - epoch_us(submitted_at)) / 3600000000.0) FROM rounds WHERE status = 'submitted') AS oldest,
  (SELECT count(*) FROM round_results) AS n_results, (SELECT count(*) FROM round_results WHERE outcome = 'succeeded') AS applied,
  (SELECT count(*) FROM articles WHERE embedding IS NOT NULL AND published_at < {T} - INTERVAL 35 DAY) AS left_over, every, eligible, gated FROM {ACTIVITY} act, pe)"""


@query("j1_run_guards", f"""WITH {PENDING}, {METRIC}
SELECT unnest(['all_failed', 'stale_feeds', 'annotate_dead', 'selection_dead', 'cap_unavailable', 'ledger_failed', 'submit_dead', 'submit_settle_failed', 'orphaned', 'list_failed',
    'collect_settle_failed', 'collect_dead', 'batch_stuck', 'quarantine_surge', 'embed_dead', 'embed_stalled', 'embed_gate_stuck', 'embed_select_stalled', 'deck_starved', 'prune_stalled', 'quiz_dead']) AS guard,
  unnest([fetched > 0 AND failed = fetched, stale > 0, false, false, false, false, false, false, true, false, false, n_results > 0 AND applied = 0, oldest > 36, q > 5, false,
    embedded_recent = 0 AND embed_waiting > 0, CASE WHEN eligible > 0 THEN gated ELSE every END > 0 AND eligible = 0, false, deck < 40, left_over < 0 OR left_over > 1000, (SELECT count(*) FROM questions WHERE status = 'retired') > 0]) AS fails FROM m""")
def j1(v: Views):
    deck = v.articles.where(F.col("summary").isNotNull() & (F.col("published_at") >= at(NOW) - F.expr("interval 72 hours"))).agg(F.count("*").alias("deck_available"))
    full = op.quarantine_report(v.leases, samples=1).select(F.col("total").alias("quarantined"))
    fetched = v.fetches.agg(F.count("*").alias("fetch_results"), F.count("error").alias("fetch_failed"))
    stale = stale_fetch(v.fetches).agg(F.count("*").alias("stale_feeds"))
    oldest = v.rounds.where("status = 'submitted'").agg(F.max(hours_since("submitted_at", NOW)).alias("oldest_round_hours"))
    results = v.round_results.agg(
        F.count_if(F.col("outcome") == "succeeded").alias("collect_applied"), F.count_if(F.col("outcome") == "errored").alias("collect_attempted"),
        F.count_if(F.col("outcome") == "expired").alias("collect_expired"), F.lit(0).cast("long").alias("collect_canceled"), F.lit(0).cast("long").alias("collect_superseded"),
    ).withColumn("collect_attempted", F.col("collect_attempted") + F.col("collect_applied"))
    kept = v.articles.where(F.col("embedding").isNotNull() & (F.col("published_at") < at(NOW) - F.expr("interval 35 days"))).agg(F.count("*").alias("prune_remaining"))
    pending = op.embed_pending(v.articles, v.feeds, per_day=5).select(F.col("pending").alias("embed_pending"), F.col("eligible").alias("embed_eligible"))
    metrics = op.activity_counts(v.articles).join(full, F.lit(True), "left").withColumn("batch_id_write_error", F.lit("timeout"))
    quiz = v.questions.agg(F.count_if(F.col("status") == "retired").alias("quiz_deficit"), F.lit(0).cast("long").alias("quiz_generated"))
    for one in (quiz, deck, fetched, stale, oldest, results, kept, pending):
        metrics = metrics.crossJoin(one)
    return op.run_guards(metrics)


@query("j1_observed_guards", f"""WITH {PENDING}, {METRIC}
SELECT unnest([{', '.join(f"'{n}'" for n in sorted(op.GUARDS))}]) AS guard, unnest([{', '.join({
    'all_failed': 'fetched > 0 AND failed = fetched', 'quarantine_surge': 'q > 5', 'embed_stalled': 'embedded_recent = 0 AND embed_waiting > 0', 'deck_starved': 'deck < 40',
    'prune_stalled': 'left_over < 0 OR left_over > 1000', 'collect_dead': 'n_results > 0 AND applied = 0',
}.get(n, 'false') for n in sorted(op.GUARDS))}]) AS fails FROM m""")
def j1_observed(v: Views):
    """The run writes its snapshots; what the guards need is counted as the rows go by."""
    seen = {name: Observation() for name in ("fetches", "leases", "articles", "results")}
    within = lambda column, span: F.col(column) >= at(NOW) - F.expr(f"interval {span}")
    written(v.fetches.observe(seen["fetches"], F.count("*").alias("fetch_results"), F.count("error").alias("fetch_failed")))
    written(v.leases.observe(seen["leases"], F.count_if((F.col("attempts") >= 3) & within("failed_at", "24 hours")).alias("quarantined")))
    waiting, vector = F.col("embedding").isNull() & (F.col("body_len") >= 250), F.col("embedding").isNotNull()
    written(v.articles.drop("content", "summary_attempts").observe(
        seen["articles"], F.count_if(within("embedded_at", "26 hours")).alias("embedded_recent"), F.count_if(waiting).alias("embed_waiting"),
        F.count_if(F.col("summary").isNotNull() & within("published_at", "72 hours")).alias("deck_available"),
        F.count_if(vector & (F.col("published_at") < at(NOW) - F.expr("interval 35 days"))).alias("prune_remaining"),
    ))
    outcome = lambda *o: F.count_if(F.col("outcome").isin(*o))
    none = F.sum(F.lit(0)).cast("long")
    written(v.round_results.observe(
        seen["results"], outcome("succeeded").alias("collect_applied"), outcome("succeeded", "errored").alias("collect_attempted"), outcome("expired").alias("collect_expired"),
        none.alias("collect_canceled"), none.alias("collect_superseded"),
    ))
    return op.run_guards(op.metrics_of(v.spark, *seen.values()))


@query("j3_refresh_cooldown", """SELECT user_id AS tenant, max(ts) > TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 60 MINUTE AS skip FROM events GROUP BY 1""")
def j3(v: Views):
    return op.refresh_cooldown(v.events.select(F.col("user_id").alias("tenant"), "ts"), "2024-01-30 22:00:00").select("tenant", "skip")
