"""Queries of vector search and near-duplicates."""

from pyspark.sql import functions as F

from gleanery.operators import vectors as op
from gleanery.plans.health_queries import EPOCH, E, T
from gleanery.plans.registry import query
from gleanery.sources.views import Views

COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
AB = COS.format(a="a.embedding", b="b.embedding")
EARLIER = f"ea AS (SELECT a.vec_id, max({AB}) AS best FROM vectors a JOIN vectors b ON b.ord < a.ord GROUP BY 1)"
EDGES, STEPS = [0.1, 0.2, 0.25, 0.3, 0.35, 0.4], [0.2, 0.3, 0.35, 0.4]
PAIRS = f"pa AS (SELECT a.vec_id AS a, b.vec_id AS b, {AB} AS s, CASE WHEN a.vec_id % 50 = 0 OR b.vec_id % 50 = 0 THEN NULL ELSE a.grp = b.grp END AS same FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE {AB} >= 0.2)"
QUERIES = "qs AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
MATCHES = f"""{QUERIES}, ma AS (SELECT query_id, vec_id, {COS.format(a='q', b='embedding')} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {COS.format(a='q', b='embedding')} DESC, vec_id) AS place
  FROM qs CROSS JOIN embeddings WHERE {COS.format(a='q', b='embedding')} > 0.3 QUALIFY place <= 8)"""


def asked(v: Views):
    return v.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def rows_with_null_groups(v: Views):
    return v.vectors.withColumn("grp", F.when(F.col("vec_id") % 50 != 0, F.col("grp")))


def best(v: Views):
    rows = op.as_rows(v.vectors)
    return op.earlier_maximum(rows, rows, None)


@query("d1_vector_audit", """SELECT grp, count(*) AS n, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS missing, count(*) FILTER (len(embedding) NOT IN (0, 64)) AS off_dimension,
  count(*) FILTER (len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero, round(avg(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS mean_square FROM vectors GROUP BY 1""")
def d1(v: Views):
    return op.vector_audit(v.vectors, 64)


@query("d2_knn_search", f"WITH {MATCHES} SELECT query_id, vec_id, round(s, 6) AS similarity, place FROM ma")
def d2(v: Views):
    out = op.knn_search(v.embeddings, asked(v), threshold=0.3)
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long"))


SEARCHED = """row_number() OVER (PARTITION BY query_id ORDER BY s DESC, article_id) AS place, title, summary, feed_id
  FROM (SELECT query_id, a.*, list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM qs CROSS JOIN articles a WHERE embedding IS NOT NULL AND summary IS NOT NULL"""


@query("d2_search_articles", f"""WITH {QUERIES} SELECT query_id, article_id AS vec_id, round(s, 6) AS similarity, {SEARCHED} AND published_at >= {T} - INTERVAL 20 DAY AND feed_id = 'src0') WHERE s > 0.2 QUALIFY place <= 8""")
def d2_articles(v: Views):
    out = op.search_articles(v.articles, asked(v), threshold=0.2, after="2024-01-11 00:00:00", feed="src0")
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long"), "title", "summary", "feed_id")


#: Questions, some of which are opposed to everything.
QUESTIONS = """SELECT vec_id AS query_id, {turned} AS q FROM {embeddings} WHERE vec_id % 50 = 0"""


@query("d3_qa_context", rf"""WITH qs AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 150 = 0 THEN 0 ELSE x END) AS q FROM embeddings WHERE vec_id % 50 = 0),
ma AS (SELECT query_id, article_id AS vec_id, {SEARCHED}) WHERE s > 0.3 AND NOT isnan(s) QUALIFY place <= 8), ci AS (SELECT query_id, vec_id FROM ma WHERE query_id % 100 = 0 AND place <= 2),
cl AS (SELECT m.query_id, m.vec_id, m.place, trim(regexp_replace(regexp_replace(title, '[<>\[\]`*#]', ' ', 'g'), '\s+', ' ', 'g')) AS t, trim(regexp_replace(regexp_replace(summary, '[<>\[\]`*#]', ' ', 'g'), '\s+', ' ', 'g')) AS p,
  c.vec_id IS NOT NULL OR NOT bool_or(c.vec_id IS NOT NULL) OVER (PARTITION BY m.query_id) AS source FROM ma m LEFT JOIN ci c ON c.query_id = m.query_id AND c.vec_id = m.vec_id)
SELECT qs.query_id, vec_id, place, CASE WHEN vec_id IS NOT NULL THEN coalesce(nullif(t, ''), '(無題)') END AS title, CASE WHEN vec_id IS NOT NULL THEN concat_ws(chr(10), nullif(t, ''), nullif(p, '')) END AS passage, source,
  CASE WHEN vec_id IS NULL THEN 'abstain' ELSE 'answer' END AS outcome FROM qs LEFT JOIN cl ON cl.query_id = qs.query_id""")
def d3(v: Views):
    questions = v.sql(QUESTIONS.replace("{turned}", "transform(embedding, x -> CASE WHEN vec_id % 150 = 0 THEN 0 ELSE x END)"))
    found = op.search_articles(v.articles, questions, threshold=0.3)
    cited = found.where("query_id % 100 = 0 and place <= 2").select("query_id", "vec_id")
    return op.qa_context(questions, found.select("query_id", "vec_id", "place"), v.articles, cited).withColumn("place", F.col("place").cast("long"))


WINDOW = f"wi AS (SELECT article_id, feed_id, published_at, embedding, CASE WHEN embedded_at >= {E} THEN 'lead' ELSE 'legacy' END AS recipe FROM articles WHERE embedding IS NOT NULL AND published_at >= {T} - INTERVAL 30 DAY)"
RATE = f"""{WINDOW}, ow AS (SELECT w.* FROM wi w JOIN feeds f ON f.feed_id = w.feed_id AND f.active QUALIFY row_number() OVER (PARTITION BY w.feed_id ORDER BY published_at DESC, article_id) <= 100),
du AS (SELECT DISTINCT a.article_id FROM ow a JOIN wi b ON a.feed_id <> b.feed_id AND b.published_at < a.published_at WHERE {AB} >= 0.3)"""


@query("d4_near_dup_rate", f"""WITH {RATE}, n AS (SELECT feed_id, count(*) AS own, count(*) FILTER (article_id IN (SELECT article_id FROM du)) AS dups FROM ow GROUP BY 1)
SELECT f.feed_id, coalesce(own, 0) AS own, coalesce(dups, 0) AS dups, CASE WHEN own >= 10 THEN round(dups / own, 6) END AS rate FROM feeds f LEFT JOIN n ON n.feed_id = f.feed_id WHERE active""")
def d4(v: Views):
    return op.near_dup_rate(v.articles, v.feeds, threshold=0.3, min_own=10).withColumn("rate", F.round("rate", 6))


MIX = f"""mi AS (SELECT count(*) FILTER (recipe = 'lead') AS lead, count(*) FILTER (recipe = 'legacy') AS legacy FROM wi),
mx AS (SELECT *, CASE WHEN lead > legacy THEN 'lead' ELSE 'legacy' END AS majority, CASE WHEN lead + legacy > 0 THEN greatest(lead, legacy) / (lead + legacy) END AS share FROM mi)"""


@query("d5_recipe_mix", f"WITH {WINDOW}, {MIX} SELECT lead, legacy, majority, round(share, 6) AS share, CASE WHEN share >= 0.8 THEN 'compute' ELSE 'blank' END AS verdict FROM mx")
def d5(v: Views):
    return op.recipe_mix(v.articles, EPOCH).withColumn("share", F.round("share", 6))


@query("d6_near_dup_freshness", f"WITH {WINDOW}, {MIX} SELECT lead, legacy, CASE WHEN coalesce(share, 0) < 0.8 THEN 'recipe_mixed' ELSE 'fresh' END AS freshness, CASE WHEN lead + legacy = 0 THEN 'embedding_stopped' WHEN coalesce(share, 0) < 0.8 THEN 'recipe_mixed' ELSE 'too_few_own' END AS all_null_because FROM mx")
def d6(v: Views):
    return op.near_dup_freshness(op.recipe_mix(v.articles, EPOCH), True, 0, 18).select("lead", "legacy", "freshness", "all_null_because")


@query("d7_mark_duplicates", f"""WITH ca AS (SELECT * FROM vectors WHERE vec_id % 2 = 1), s AS (SELECT a.vec_id, max({AB}) AS best FROM ca a JOIN vectors b ON b.vec_id % 2 = 0 OR b.ord < a.ord GROUP BY 1)
SELECT c.vec_id, false AS embed_failed, round(greatest(0, coalesce(best, 0)), 6) AS similarity, coalesce(best, 0) >= 0.35 AS dup_flag FROM ca c LEFT JOIN s ON s.vec_id = c.vec_id""")
def d7(v: Views):
    return op.mark_duplicates(v.vectors.where("vec_id % 2 = 1"), v.vectors.where("vec_id % 2 = 0"), 0.35).withColumn("similarity", F.round("similarity", 6))


JUDGED = "SELECT vec_id, embedding, grp, ord, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(0.1 AS DOUBLE) END AS similarity, vec_id % 7 = 1 AS dup_flag FROM {vectors}"


@query("d8_rejudge_unjudged", f"""WITH j AS ({JUDGED.replace('{vectors}', 'vectors')}), un AS (SELECT * FROM j WHERE similarity IS NULL AND ord >= 100),
x AS (SELECT a.vec_id, greatest(0, coalesce(max({AB}), 0)) AS s, 'judged' AS kind FROM un a LEFT JOIN j b ON b.ord < a.ord GROUP BY 1
  UNION ALL SELECT a.vec_id, max({AB}), 'upgraded' FROM j a JOIN un b ON b.ord < a.ord WHERE a.similarity IS NOT NULL AND NOT a.dup_flag GROUP BY 1 HAVING max({AB}) >= 0.35)
SELECT vec_id, round(s, 6) AS similarity, s >= 0.35 AS dup_flag, kind FROM x""")
def d8(v: Views):
    return op.rejudge_unjudged(v.sql(JUDGED), 0.35, 100).withColumn("similarity", F.round("similarity", 6))


@query("d9_dup_sweep", f"WITH {EARLIER}, st AS (SELECT unnest({STEPS})::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (best >= threshold) AS dups, (SELECT count(*) FROM vectors) AS n FROM ea CROSS JOIN st GROUP BY 1")
def d9(v: Views):
    return op.dup_sweep(best(v), STEPS)


@query("d10_maxsim_histogram", f"WITH {EARLIER} SELECT CAST({' + '.join(f'(best >= {e})::INT' for e in EDGES)} AS INT) AS bucket, count(*) AS n FROM ea GROUP BY 1")
def d10(v: Views):
    return op.maxsim_histogram(best(v), EDGES)


@query("d10_quantiles", f"WITH {EARLIER}, so AS (SELECT list_sort(list(best)) AS l, count(*) AS n FROM ea), q AS (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS q) SELECT q, round(l[CAST(least(n - 1, floor(n * q)) AS BIGINT) + 1], 6) AS value FROM so, q")
def d10b(v: Views):
    return op.nearest_index_quantiles(best(v), [0.5, 0.9, 0.99]).withColumn("value", F.round("value", 6))


@query("d11_pairs_by_source", f"WITH {PAIRS}, st AS (SELECT unnest({STEPS})::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (same) AS same, count(*) FILTER (NOT same) AS \"cross\", count(*) FILTER (same IS NULL) AS unknown FROM pa JOIN st ON s >= threshold GROUP BY 1")
def d11(v: Views):
    return op.pairs_by_source(op.pairs_over(rows_with_null_groups(v), 0.2), STEPS)


@query("d12_pairs_in_band", f"WITH {PAIRS}, ba AS (SELECT * FROM pa WHERE s BETWEEN 0.3 AND 0.4) SELECT a, b, round(s, 6) AS similarity, coalesce(same, false) AS same, (SELECT count(*) FROM ba) AS total FROM ba ORDER BY s DESC, a, b LIMIT 40")
def d12(v: Views):
    out = op.pairs_in_band(op.pairs_over(rows_with_null_groups(v), 0.2), 0.3, 0.4)
    return out.withColumns({"similarity": F.round("similarity", 6), "same": F.coalesce("same", F.lit(False))})


@query("d13_stored_dup_report", f"WITH j AS ({JUDGED.replace('{vectors}', 'vectors')}), st AS (SELECT unnest([0.05, 0.2])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (dup_flag) AS flagged, count(*) FILTER (similarity >= threshold) AS over, count(*) FILTER (similarity IS NULL AND ord >= 100) AS unjudged FROM j CROSS JOIN st GROUP BY 1")
def d13(v: Views):
    return op.stored_dup_report(v.sql(JUDGED), [0.05, 0.2], 100)


@query("d13_card_counts", "SELECT status, count(*) AS n FROM cards GROUP BY 1")
def d13_cards(v: Views):
    return op.status_counts(v.cards)


@query("d14_cross_recipe_distribution", f"""WITH {WINDOW}, sa AS (SELECT * FROM wi QUALIFY row_number() OVER (PARTITION BY recipe ORDER BY published_at DESC, article_id) <= 1000),
di AS (SELECT a.article_id, concat(a.recipe, ' to ', r.recipe) AS direction, r.recipe AS other FROM sa a CROSS JOIN (SELECT unnest(['lead', 'legacy']) AS recipe) r),
be AS (SELECT d.article_id, d.direction, coalesce(max({AB}) FILTER (b.article_id IS NOT NULL), -1) AS best FROM di d JOIN sa a ON a.article_id = d.article_id
  LEFT JOIN sa b ON b.recipe = d.other AND b.feed_id <> a.feed_id AND b.published_at < a.published_at GROUP BY 1, 2),
so AS (SELECT direction, list_sort(list(best)) AS l, count(*) AS n, avg((best >= 0.35)::INT) AS share FROM be GROUP BY 1), q AS (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS q)
SELECT q, round(l[CAST(least(n - 1, floor(n * q)) AS BIGINT) + 1], 6) AS value, round(share, 6) AS share, n, direction FROM so, q""")
def d14(v: Views):
    return op.cross_recipe_distribution(v.articles, EPOCH, [0.5, 0.9, 0.95, 0.99], 0.35).withColumns({c: F.round(c, 6) for c in ("value", "share")})
