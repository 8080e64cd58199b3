"""Queries of grounding, mastery and quiz sessions."""

from pyspark.sql import functions as F

from gleanery.operators import learning as op
from gleanery.plans.queue_queries import SOURCES
from gleanery.plans.registry import query
from gleanery.sources.views import Views

NOW = "2024-01-31 00:00:00"
T = f"TIMESTAMP '{NOW}'"
NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
TOKENS = r"list_distinct(regexp_extract_all({}, '([a-z0-9]{{4,}}|[\x{{4E00}}-\x{{9FFF}}\x{{30A0}}-\x{{30FF}}]{{3,}})'))"
GROUND = f"""g0 AS (SELECT item_id, {NORM.format('quote')} AS q, {NORM.format('d.text')} AS b, {NORM.format("substr(quote, 20, 60)")} AS t FROM quotes q LEFT JOIN documents d ON d.doc_id = q.source_doc),
g1 AS (SELECT *, {TOKENS.format('q')} AS qt, {TOKENS.format('t')} AS tt FROM g0),
g2 AS (SELECT item_id, CASE WHEN len(qt) = 0 OR len(tt) = 0 THEN 0.0 ELSE len(list_intersect(qt, tt)) / len(list_distinct(list_concat(qt, tt))) END AS overlap, q, b, qt FROM g1),
gr AS (SELECT item_id, overlap, CASE WHEN length(q) < 24 THEN 'too_short' WHEN NOT contains(coalesce(b, ''), q) THEN 'not_verbatim' WHEN len(qt) = 0 THEN 'not_specific' WHEN overlap < 0.12 THEN 'low_overlap' ELSE 'pass' END AS reason FROM g2)"""


def grounded(v: Views):
    quotes = v.quotes.select("item_id", "quote", F.col("source_doc").alias("source"), F.substring("quote", 20, 60).alias("target"))
    return op.ground_quotes(quotes, v.documents.select(F.col("doc_id").alias("source"), F.col("text").alias("body")))


@query("g1_ground_quotes", f"WITH {GROUND} SELECT item_id, round(overlap, 6) AS overlap, reason FROM gr")
def g1(v: Views):
    return grounded(v).select("item_id", F.round("overlap", 6).alias("overlap"), "reason")


@query("g2_grounding_report", f"WITH {GROUND} SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM gr), 6) AS share FROM gr GROUP BY 1")
def g2(v: Views):
    return op.grounding_report(grounded(v)).withColumn("share", F.round("share", 6))


LENIENT = """SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'quiz' WHEN 1 THEN 'card' ELSE 'cloze' END AS kind, CASE WHEN item_id % 4 = 1 THEN translate(lower(quote), 'aeiou', 'ａｅｉｏｕ') WHEN item_id % 8 = 2 THEN concat('x', quote) WHEN item_id % 8 = 3 THEN substr(quote, 1, 20) ELSE quote END AS quote,
  source_doc, CASE WHEN item_id % 5 = 0 THEN 'something else' ELSE quote END AS target FROM {quotes}"""


@query("g2_grounding_detail", f"""WITH le AS ({LENIENT.replace('{quotes}', 'quotes')}),
g0 AS (SELECT kind, item_id, {NORM.format('quote')} AS q, {NORM.format('d.text')} AS b, {NORM.format('target')} AS t FROM le LEFT JOIN documents d ON d.doc_id = source_doc),
g1 AS (SELECT *, {TOKENS.format('q')} AS qt, {TOKENS.format('t')} AS tt FROM g0),
g2 AS (SELECT *, CASE WHEN length(q) < 24 THEN 'too_short' WHEN NOT contains(coalesce(b, ''), q) THEN 'not_verbatim' WHEN len(qt) = 0 THEN 'not_specific'
  WHEN (CASE WHEN len(tt) = 0 THEN 0 ELSE len(list_intersect(qt, tt)) / len(list_distinct(list_concat(qt, tt))) END) < 0.12 THEN 'low_overlap' ELSE 'pass' END AS reason FROM g1)
SELECT kind, count(*) AS n, count(*) FILTER (reason = 'too_short') AS too_short, count(*) FILTER (reason = 'not_verbatim') AS not_verbatim, count(*) FILTER (reason = 'not_specific') AS not_specific,
  count(*) FILTER (reason = 'low_overlap') AS low_overlap, count(*) FILTER (reason = 'not_verbatim' AND contains(coalesce(b, ''), translate(q, 'ａｅｉｏｕ', 'aeiou'))) AS fixable,
  round(count(*) FILTER (reason = 'pass') / count(*), 6) AS pass_rate, round(count(*) FILTER (reason IN ('pass', 'low_overlap')) / count(*), 6) AS pass_rate_without_overlap
FROM g2 GROUP BY ROLLUP (kind)""")
def g2_detail(v: Views):
    quotes = v.sql(LENIENT).withColumnRenamed("source_doc", "source")
    made = op.ground_quotes(quotes, v.documents.select(F.col("doc_id").alias("source"), F.col("text").alias("body")))
    return op.grounding_detail(made).withColumns({c: F.round(c, 6) for c in ("pass_rate", "pass_rate_without_overlap")})


#: Arrays of three kinds of rows, of turns with their whole texts (as JSON), and of rows that are none.
MIXED = """SELECT conv_id * 1000 + turn AS id, concat('[', concat_ws(', ',
  concat(chr(123), '"type": "qa", "front": "', role, '", "back": ', CASE WHEN conv_id % 4 = 0 THEN '7' ELSE t END, ', "source_quote": ', CASE WHEN conv_id % 7 = 0 THEN '"  "' ELSE t END, chr(125)),
  concat(chr(123), '"type": "cloze", "cloze_text": "of ', chr(123), chr(123), 'c1::', CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE role END, '::hint', chr(125), chr(125), ' it", "source_quote": ', t, ', "concept_tag": "k"', chr(125)),
  concat(chr(123), '"stem": ', t, ', "choices": ["a ", "b", "', CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE 'c' END, '", "d"], "answer_index": ', CASE WHEN turn % 2 = 0 THEN CAST(conv_id % 6 AS STRING) ELSE '1.5' END,
    ', "explanation": "e", "source_quote": ', t, ', "concept_label": "c", "difficulty": "', CASE WHEN conv_id % 2 = 0 THEN 'hard' ELSE 'odd' END, '"', chr(125)),
  '5', '"qa"', concat(chr(123), '"type": "other", "source_quote": "q"', chr(125)), concat(chr(123), '"type": "cloze"', chr(125))), ']') AS text FROM ({turns}) x"""
TURNS = "SELECT conv_id, turn, role, {quoted} AS t FROM {conversations}"


@query("g3_land_model_rows", f"""WITH x AS (SELECT * FROM ({MIXED.format(turns=TURNS.format(quoted="to_json(text)", conversations="conversations"))})),
r AS (SELECT id, unnest(CAST(text AS JSON[])) AS e, generate_subscripts(CAST(text AS JSON[]), 1) - 1 AS pos FROM x),
k AS (SELECT id, CAST(pos AS INT) AS pos, e, CASE WHEN json_type(e, '$.type') = 'VARCHAR' AND json_extract_string(e, '$.type') IN ('qa', 'cloze') THEN json_extract_string(e, '$.type') WHEN json_type(e, '$.choices') = 'ARRAY' THEN 'choice' END AS kind,
  nullif(trim(json_extract_string(e, '$.source_quote')), '') AS quote FROM r WHERE json_type(e) = 'OBJECT')
SELECT id, pos, kind, md5(quote) AS quote, CASE WHEN kind <> 'choice' AND json_type(e, '$.front') = 'VARCHAR' THEN json_extract_string(e, '$.front') END AS front,
  CASE WHEN kind <> 'choice' AND json_type(e, '$.back') = 'VARCHAR' THEN md5(json_extract_string(e, '$.back')) END AS back, CASE WHEN kind <> 'choice' THEN json_extract_string(e, '$.cloze_text') END AS cloze_text,
  CASE WHEN kind = 'choice' THEN json_extract_string(e, '$.concept_label') ELSE json_extract_string(e, '$.concept_tag') END AS concept, CASE WHEN kind = 'choice' THEN 'a,b,c,d' END AS choices,
  CASE WHEN kind = 'choice' THEN CAST(json_extract(e, '$.answer_index') AS INT) ELSE -1 END AS answer, CASE WHEN kind = 'choice' THEN CASE json_extract_string(e, '$.difficulty') WHEN 'hard' THEN 'hard' ELSE 'medium' END END AS difficulty
FROM k WHERE kind IS NOT NULL AND quote IS NOT NULL AND (kind <> 'choice' OR (nullif(trim(json_extract_string(e, '$.choices[2]')), '') IS NOT NULL AND nullif(trim(json_extract_string(e, '$.stem')), '') IS NOT NULL
  AND json_type(e, '$.answer_index') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(e, '$.answer_index') AS DOUBLE) BETWEEN 0 AND 3))""")
def g3_rows(v: Views):
    turns = v.conversations.select("conv_id", "turn", "role", F.to_json(F.struct("text")).alias("j")).selectExpr("conv_id", "turn", "role", "substr(j, 9, length(j) - 9) as t")
    raw = v.spark.sql(MIXED.replace("{turns}", "SELECT * FROM {turns}"), turns=turns)
    rows = op.land_model_rows(raw).withColumns({"quote": F.md5("quote"), "back": F.md5("back"), "choices": F.array_join("choices", ","), "answer": F.coalesce("answer", F.lit(-1))})
    return rows.select("id", "pos", "kind", "quote", "front", "back", "cloze_text", "concept", "choices", "answer", "difficulty")


#: Model texts: turns as JSON, some in fences, some with prose around, some broken.
MODEL_TEXT = """concat(CASE WHEN turn % 4 = 1 THEN '```json ' ELSE '' END, CASE WHEN turn % 4 = 2 THEN 'Here it is: ' ELSE '' END, {body}, CASE WHEN turn % 4 = 1 THEN ' ```' WHEN turn % 4 = 2 THEN ' Done.' ELSE '' END)"""


def model_texts(v: Views, annotation: bool):
    if annotation:
        body = """concat('{"summary": ', quoted, ', "tags": ["tech/', cast(conv_id % 12 as string), '", "tech/1", 5, "tech/1"]', if(turn % 4 = 3, '', '}'))"""
    else:
        body = """concat('[{"stem": ', quoted, ', "choices": ["a", "b", "', if(conv_id % 5 = 0, '', 'c'), '", "d"], "answer": ', cast(conv_id % 6 as string), ', "quote": "q", "explanation": "e", "concept": "k", "difficulty": "', if(conv_id % 2 = 0, 'hard', 'odd'), '"}]')"""
    json = v.conversations.withColumn("quoted", F.to_json(F.struct("text"))).withColumn("quoted", F.expr("substr(quoted, 9, length(quoted) - 9)"))
    return json.selectExpr("conv_id * 1000 + turn as id", "conv_id", "turn", f"{MODEL_TEXT.format(body=body)} as text")


@query("f16_land_annotations", f"""WITH a AS (SELECT conv_id * 1000 + turn AS id, trim(text) AS s, conv_id % 12 AS k, turn FROM conversations)
SELECT id, CASE WHEN turn % 4 = 3 OR s = '' THEN NULL ELSE s END AS summary, CASE WHEN turn % 4 = 3 THEN '' WHEN k < 8 AND k <> 1 THEN concat('tech/', k, ',tech/1') ELSE 'tech/1' END AS tags,
  CASE WHEN turn % 4 = 3 OR s = '' THEN 'failed' ELSE 'landed' END AS outcome FROM a""")
def f16(v: Views):
    vocabulary = v.article_tags.select("tag").where("tag like 'tech/%'").distinct()
    return op.land_annotations(model_texts(v, True), vocabulary).withColumn("tags", F.concat_ws(",", "tags"))


@query("g3_land_candidates", f"""SELECT conv_id * 1000 + turn AS id, text AS stem, CAST(conv_id % 6 AS INT) AS answer, CASE WHEN conv_id % 2 = 0 THEN 'hard' ELSE 'medium' END AS difficulty
FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 6 <= 3 AND trim(text) <> ''""")
def g3(v: Views):
    return op.land_candidates(model_texts(v, False)).select("id", "stem", "answer", "difficulty")


@query("g4_gate_candidates", f"""WITH {GROUND} SELECT item_id % 5 AS source, item_id, concat('topic-', item_id) AS slug FROM gr WHERE reason = 'pass' QUALIFY row_number() OVER (PARTITION BY item_id % 5 ORDER BY item_id) <= 2""")
def g4(v: Views):
    rows = grounded(v).withColumns({"source": F.col("item_id") % 5, "pos": F.col("item_id"), "concept": F.concat(F.lit(" Topic: "), F.col("item_id").cast("string"))})
    return op.gate_candidates(rows, 2).select("source", "item_id", "slug")


DRAFTS = """SELECT item_id * 10 + k AS card_id, item_id % 5 AS pos, source_doc % 9 AS of_source, source_doc AS source, CASE WHEN k % 2 = 0 THEN 'qa' ELSE 'cloze' END AS kind, CASE WHEN item_id % 6 = 0 THEN ' ' ELSE 'front' END AS front, quote AS back,
  CASE k WHEN 1 THEN concat('A ', chr(123), chr(123), 'c1::', CASE WHEN item_id % 4 = 0 THEN ' ' ELSE 'answer' END, '::hint', chr(125), chr(125), ' b') WHEN 3 THEN 'no mark' END AS cloze_text, quote
FROM {quotes} CROSS JOIN (SELECT explode(array(0, 1, 2, 3)) AS k) n"""


@query("g4_gate_cards", f"""WITH dr AS ({DRAFTS.replace('{quotes}', 'quotes').replace('array(', 'list_value(').replace('explode(', 'unnest(')}),
ok AS (SELECT *, CASE WHEN kind = 'cloze' THEN 'A answer b' ELSE concat('front ', back) END AS target FROM dr WHERE CASE WHEN kind = 'qa' THEN trim(front) <> '' ELSE cloze_text LIKE 'A %' AND item_id_of % 4 <> 0 END),
g0 AS (SELECT ok.*, {NORM.format("quote")} AS q, {NORM.format("d.text")} AS b FROM ok LEFT JOIN documents d ON d.doc_id = ok.source)
SELECT card_id, source, target, row_number() OVER (PARTITION BY g0.source ORDER BY pos, card_id) AS place FROM g0 WHERE length(q) >= 24 AND contains(coalesce(b, ''), q) AND len({TOKENS.format('q')}) > 0 QUALIFY place <= 5""".replace("item_id_of", "(card_id // 10)"))
def g4_cards(v: Views):
    bodies = v.documents.select(F.col("doc_id").alias("source"), F.col("text").alias("body"))
    return op.gate_cards(v.sql(DRAFTS), bodies).select("card_id", "source", "target", F.col("place").cast("long").alias("place"))


@query("g5_card_targets", """WITH last AS (SELECT tenant, article_id, arg_max(action, event_id) AS action FROM feedback GROUP BY 1, 2)
SELECT l.tenant, l.article_id, row_number() OVER (PARTITION BY l.tenant ORDER BY published_at DESC NULLS LAST, l.article_id) AS place FROM last l JOIN articles a ON a.article_id = l.article_id
WHERE action = 'useful' AND summary IS NOT NULL AND l.article_id % 17 <> 0 QUALIFY place <= 10""")
def g5(v: Views):
    cards = v.documents.where("doc_id % 17 = 0").select(F.col("doc_id").alias("article_id"))
    return op.card_targets(v.feedback, v.articles, cards).withColumn("place", F.col("place").cast("long"))


@query("g6_source_prompts", """SELECT source_ref, question_id, concat('stem ', CAST(question_id AS VARCHAR)) AS stem FROM questions WHERE status = 'active' AND source_ref IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source_ref ORDER BY question_id DESC) <= 30""")
def g6(v: Views):
    return op.source_prompts(v.questions.withColumn("stem", F.concat(F.lit("stem "), F.col("question_id").cast("string"))))


@query("g6_latest_concepts", """SELECT tenant, concept_key, row_number() OVER (PARTITION BY tenant ORDER BY max(created_at) DESC, concept_key) AS place FROM attempts GROUP BY 1, 2 QUALIFY place <= 40""")
def g6_concepts(v: Views):
    return op.latest_concepts(op.mastery_fold(v.attempts)).withColumn("place", F.col("place").cast("long"))


@query("g10_ledger_totals", """SELECT level, count(*) AS attempts, count(DISTINCT concat(tenant, ' ', concept_key)) AS concepts, round(avg(CAST(is_correct AS INT)), 9) AS correct_rate,
  CAST(CAST(min(created_at) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(created_at) AS DATE) AS VARCHAR) AS last_day FROM (SELECT *, coalesce(difficulty, 'unknown') AS level FROM attempts) GROUP BY ROLLUP (level)""")
def g10_totals(v: Views):
    return op.ledger_totals(v.attempts).withColumn("correct_rate", F.round("correct_rate", 9))


@query("g7_body_windows", r"""WITH s AS (SELECT doc_id, text, length(text) - 500 AS room, CAST(CAST('0x' || md5(concat('7:', doc_id))[1:15] AS BIGINT) % greatest(length(text) - 499, 1) AS INT) AS start FROM documents),
b AS (SELECT *, CASE WHEN room <= 0 THEN 0 WHEN start > 0 AND instr(substr(text, start + 1, 200), ' ') > 0 THEN start + instr(substr(text, start + 1, 200), ' ') ELSE start END AS begins FROM s)
SELECT doc_id AS source_id, CAST(begins AS BIGINT) AS start, md5(CASE WHEN room <= 0 THEN text ELSE regexp_replace(substr(text, begins + 1, 500), '^[\s\p{Z}\x{85}\x0B]+|[\s\p{Z}\x{85}\x0B]+$', '', 'g') END) AS body FROM b""")
def g7(v: Views):
    return op.body_windows(v.documents.select(F.col("doc_id").alias("source_id"), "text"), 500, 7).withColumn("body", F.md5("body"))


ALPHA = """CAST(CASE difficulty WHEN 'easy' THEN CASE WHEN is_correct THEN 0.15 ELSE 0.35 END WHEN 'medium' THEN 0.25 ELSE CASE WHEN is_correct THEN 0.35 ELSE 0.15 END END AS DOUBLE)"""
FOLD = f"""att AS (SELECT *, {ALPHA} AS al, row_number() OVER (PARTITION BY tenant, concept_key ORDER BY created_at, attempt_id) AS k FROM attempts),
fold(tenant, concept_key, k, m) AS (SELECT tenant, concept_key, k, CAST(0.3 AS DOUBLE) + al * (is_correct::INT - CAST(0.3 AS DOUBLE)) FROM att WHERE k = 1
  UNION ALL SELECT a.tenant, a.concept_key, a.k, f.m + a.al * (a.is_correct::INT - f.m) FROM fold f JOIN att a ON a.tenant = f.tenant AND a.concept_key = f.concept_key AND a.k = f.k + 1),
mas AS (SELECT tenant, concept_key, arg_max(m, k) AS mastery, max(k) AS attempts FROM fold GROUP BY 1, 2)"""


@query("g8_mastery_fold", f"WITH RECURSIVE {FOLD} SELECT tenant, concept_key, round(mastery + 0.00000003, 6) AS mastery, attempts FROM mas")
def g8(v: Views):
    return op.mastery_fold(v.attempts).select("tenant", "concept_key", F.round(F.col("mastery") + 3e-8, 6).alias("mastery"), "attempts")


@query("g9_mastery_replay", f"""WITH RECURSIVE sc AS (SELECT unnest([0.5, 0.75, 1.0, 1.25])::DOUBLE AS scale), att AS (SELECT *, {ALPHA} * scale AS al, row_number() OVER (PARTITION BY scale, tenant, concept_key ORDER BY created_at, attempt_id) AS k FROM attempts CROSS JOIN sc),
fold(scale, tenant, concept_key, k, m) AS (SELECT scale, tenant, concept_key, k, CAST(0.3 AS DOUBLE) + al * (is_correct::INT - CAST(0.3 AS DOUBLE)) FROM att WHERE k = 1
  UNION ALL SELECT a.scale, a.tenant, a.concept_key, a.k, f.m + a.al * (a.is_correct::INT - f.m) FROM fold f JOIN att a ON a.scale = f.scale AND a.tenant = f.tenant AND a.concept_key = f.concept_key AND a.k = f.k + 1),
mas AS (SELECT scale, tenant, concept_key, arg_max(m, k) AS m FROM fold GROUP BY 1, 2, 3)
SELECT scale, round(avg(m), 6) AS mean, round(list_sort(list(m))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 6) AS median, count(*) FILTER (m < 0.3) AS low, count(*) FILTER (m >= 0.7) AS high FROM mas GROUP BY 1""")
def g9(v: Views):
    return op.mastery_replay(v.attempts).withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query("g9_top_concepts", f"""WITH RECURSIVE best AS (SELECT tenant, concept_key, count(*) AS n FROM attempts GROUP BY 1, 2 ORDER BY n DESC, tenant, concept_key LIMIT 15),
sc AS (SELECT unnest([0.5, 0.75, 1.0, 1.25])::DOUBLE AS scale), att AS (SELECT t.*, n, scale, {ALPHA} * scale AS al, row_number() OVER (PARTITION BY scale, tenant, concept_key ORDER BY created_at, attempt_id) AS k FROM attempts t JOIN best USING (tenant, concept_key) CROSS JOIN sc),
fold(scale, tenant, concept_key, n, k, m) AS (SELECT scale, tenant, concept_key, n, k, CAST(0.3 AS DOUBLE) + al * (is_correct::INT - CAST(0.3 AS DOUBLE)) FROM att WHERE k = 1
  UNION ALL SELECT a.scale, a.tenant, a.concept_key, a.n, a.k, f.m + a.al * (a.is_correct::INT - f.m) FROM fold f JOIN att a ON a.scale = f.scale AND a.tenant = f.tenant AND a.concept_key = f.concept_key AND a.k = f.k + 1)
SELECT tenant, concept_key, n AS attempts, scale, round(arg_max(m, k), 4) AS mastery FROM fold GROUP BY ALL""")
def g9_top(v: Views):
    return op.replay_top_concepts(v.attempts).withColumn("mastery", F.round("mastery", 4))


@query("g10_mastery_drift", f"""WITH RECURSIVE {FOLD} SELECT coalesce(tenant, -1) AS tenant, concept_key, CASE WHEN tenant % 7 = 0 THEN 'missing' WHEN attempts % 3 = 0 THEN 'differs' ELSE 'matched' END AS state FROM mas
UNION ALL SELECT -1, concept_key, 'orphan' FROM (SELECT DISTINCT concept_key FROM questions)""")
def g10(v: Views):
    replayed = op.mastery_fold(v.attempts)
    stored = replayed.where("tenant % 7 <> 0").select("tenant", "concept_key", (F.col("mastery") + F.when(F.col("attempts") % 3 == 0, 0.1).otherwise(0.001)).alias("mastery"), "attempts")
    orphans = v.questions.select(F.lit(-1).cast("long").alias("tenant"), "concept_key", F.lit(0.5).alias("mastery"), F.lit(1).cast("long").alias("attempts")).distinct()
    return op.mastery_drift(replayed, stored.union(orphans)).select("tenant", "concept_key", "state")


@query("g11_category_mastery", f"""WITH RECURSIVE {FOLD}, con AS (SELECT DISTINCT concept_key, category FROM questions WHERE category LIKE 'tech/%'),
ro AS (SELECT tenant, category, m.concept_key, mastery, row_number() OVER (PARTITION BY tenant, category ORDER BY round(mastery, 9), m.concept_key) AS n FROM mas m JOIN con ON con.concept_key = m.concept_key)
SELECT tenant, category, round(avg(mastery) + 0.00000003, 6) AS mean, count(*) AS concepts, string_agg(concept_key, ',' ORDER BY n) FILTER (n <= 3) AS weakest FROM ro GROUP BY 1, 2""")
def g11(v: Views):
    m = op.mastery_fold(v.attempts).withColumn("mastery", F.round("mastery", 9))
    return op.category_mastery(m, v.questions).withColumn("mean", F.round(F.col("mean") + 3e-8, 6))


POOL = f"""SELECT t.tenant, q.question_id, q.concept_key, q.category, q.difficulty FROM (SELECT DISTINCT tenant FROM {{attempts}}) t CROSS JOIN {{questions}} q WHERE q.status = 'active' AND NOT q.dup_flag"""
SERVED = f"""SELECT user_id AS tenant, concat('c', CAST(event_id % 60 % 25 AS STRING)) AS concept_key, CAST(0.5 + (user_id % 5) * 0.1 - 0.3 AS DOUBLE) AS mastery, count(*) AS attempts, max(ts) AS last_served_at FROM {{events}} WHERE event_id % 60 % 25 < 12
GROUP BY user_id, concat('c', CAST(event_id % 60 % 25 AS STRING))"""
PRIORITY = f"""pl AS ({POOL.replace('{', '').replace('}', '')}), sv AS ({SERVED.replace('{', '').replace('}', '')}),
pr AS (SELECT pl.*, coalesce(mastery, 0.3) AS m, CASE WHEN last_served_at IS NULL THEN 1.0 ELSE 0.05 + 0.95 * least(1.0, (epoch_us({T}) - epoch_us(last_served_at)) / 86400000000.0 / 14) END AS rest
  FROM pl LEFT JOIN sv ON sv.tenant = pl.tenant AND sv.concept_key = pl.concept_key),
ps AS (SELECT *, CAST(greatest(1 - m, 0.1) * rest * CASE abs(CASE WHEN m < 0.4 THEN 0 WHEN m < 0.7 THEN 1 ELSE 2 END - CASE difficulty WHEN 'easy' THEN 0 WHEN 'hard' THEN 2 ELSE 1 END) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.15 END AS DOUBLE) AS priority FROM pr)"""


@query("g12_score_questions", f"WITH {PRIORITY} SELECT tenant, question_id, round(priority, 6) AS priority FROM ps")
def g12(v: Views):
    return op.score_questions(v.sql(POOL), v.sql(SERVED), NOW).select("tenant", "question_id", F.round("priority", 6).alias("priority"))


@query("g13_select_session", f"""WITH {PRIORITY}, la AS (SELECT tenant, question_id, arg_max(is_correct, attempt_id) AS ok, max(created_at) AS at FROM attempts GROUP BY 1, 2),
fr AS (SELECT ps.tenant, ps.question_id, ps.concept_key, round(priority, 9) AS p FROM ps LEFT JOIN la ON la.tenant = ps.tenant AND la.question_id = ps.question_id
  WHERE la.at IS NULL OR (epoch_us({T}) - epoch_us(la.at)) / 86400000000.0 >= CASE WHEN ok THEN 14 ELSE 4 END),
be AS (SELECT *, row_number() OVER (PARTITION BY tenant, concept_key ORDER BY p DESC, question_id) AS b FROM fr)
SELECT tenant, question_id, row_number() OVER (PARTITION BY tenant ORDER BY b > 1, p DESC, question_id) AS place FROM be QUALIFY place <= 5""")
def g13(v: Views):
    return op.select_session(v.sql(POOL), v.attempts, v.sql(SERVED), NOW).withColumn("place", F.col("place").cast("long"))


@query("g13_select_category", f"""WITH {PRIORITY}, la AS (SELECT tenant, question_id, arg_max(is_correct, attempt_id) AS ok, max(created_at) AS at FROM attempts GROUP BY 1, 2),
ne AS (SELECT * FROM ps WHERE category = 'tech/1' QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY question_id DESC) <= 4),
fr AS (SELECT ne.tenant, ne.question_id, ne.concept_key, round(priority, 9) AS p FROM ne LEFT JOIN la ON la.tenant = ne.tenant AND la.question_id = ne.question_id
  WHERE la.at IS NULL OR (epoch_us({T}) - epoch_us(la.at)) / 86400000000.0 >= CASE WHEN ok THEN 14 ELSE 4 END),
be AS (SELECT *, row_number() OVER (PARTITION BY tenant, concept_key ORDER BY p DESC, question_id) AS b FROM fr)
SELECT tenant, question_id, row_number() OVER (PARTITION BY tenant ORDER BY b > 1, p DESC, question_id) AS place FROM be QUALIFY place <= 3""")
def g13_category(v: Views):
    out = op.select_session(v.sql(POOL), v.attempts, v.sql(SERVED), NOW, size=3, newest=4, category="tech/1")
    return out.withColumn("place", F.col("place").cast("long"))


@query("g14_mark_served", f"""WITH sv AS ({SERVED.replace('{', '').replace('}', '')}), hit AS (SELECT DISTINCT tenant, concept_key FROM attempts WHERE tenant % 2 = 0)
SELECT coalesce(s.tenant, h.tenant) AS tenant, coalesce(s.concept_key, h.concept_key) AS concept_key, round(coalesce(mastery, 0.3), 6) AS mastery, coalesce(attempts, 0) AS attempts,
  CAST(CASE WHEN h.tenant IS NOT NULL THEN {T} ELSE last_served_at END AS VARCHAR) AS last_served_at FROM sv s FULL JOIN hit h ON h.tenant = s.tenant AND h.concept_key = s.concept_key""")
def g14(v: Views):
    out = op.mark_served(v.sql(SERVED), v.attempts.where("tenant % 2 = 0"), NOW)
    return out.withColumns({"mastery": F.round("mastery", 6), "last_served_at": F.col("last_served_at").cast("string")})


@query("g15_pool_deficit", f"""WITH so AS ({SOURCES.replace('{pages}', 'pages')}), li AS (SELECT * FROM questions WHERE status = 'active' AND NOT dup_flag),
gd AS (SELECT * FROM (SELECT DISTINCT tenant FROM attempts) CROSS JOIN (SELECT DISTINCT category FROM so WHERE status = 'approved')),
un AS (SELECT g.tenant, g.category, coalesce(size, 0) - coalesce(seen, 0) AS unseen FROM gd g LEFT JOIN (SELECT category, count(*) AS size FROM li GROUP BY 1) s ON s.category = g.category
  LEFT JOIN (SELECT tenant, category, count(DISTINCT a.question_id) AS seen FROM attempts a JOIN li ON li.question_id = a.question_id GROUP BY 1, 2) n ON n.tenant = g.tenant AND n.category = g.category),
de AS (SELECT *, greatest(0, 6 - unseen) AS deficit FROM un),
al AS (SELECT *, coalesce(sum(deficit) OVER (PARTITION BY tenant ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM de)
SELECT tenant, category, unseen, deficit, CAST(greatest(0, least(deficit, 24 - before)) AS BIGINT) AS allocated FROM al""")
def g15(v: Views):
    return op.pool_deficit(v.attempts.select("tenant").distinct(), v.questions, v.attempts, v.sql(SOURCES))


@query("g16_retire_orphans", "SELECT question_id FROM questions WHERE status = 'active' AND (source_ref IS NULL OR source_ref NOT IN (SELECT page_id FROM pages WHERE page_id % 3 <> 0))")
def g16(v: Views):
    return op.retire_orphans(v.questions, v.pages.where("page_id % 3 <> 0").select(F.col("page_id").alias("source_id"))).select("question_id")


@query("g17_answer_positions", "SELECT answer_index, count(*) AS n, round(pow(count(*) - (SELECT count(*) FROM questions) / 4, 2) / ((SELECT count(*) FROM questions) / 4), 6) AS chi2 FROM questions GROUP BY 1")
def g17(v: Views):
    return op.answer_positions(v.questions).withColumn("chi2", F.round("chi2", 6))


@query("g17_shuffled_positions", """WITH c AS (SELECT question_id, answer_index, unnest(range(0, 4)) AS i FROM questions),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CAST('0x' || md5(concat('3:', question_id, ':', i))[1:15] AS BIGINT), i) - 1 AS place FROM c)
SELECT CAST(place AS INT) AS answer_index, count(*) AS n, round(pow(count(*) - (SELECT count(*) FROM questions) / 4, 2) / ((SELECT count(*) FROM questions) / 4), 6) AS chi2 FROM p WHERE i = answer_index GROUP BY place""")
def g17b(v: Views):
    rows = v.questions.withColumn("choices", F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))
    return op.answer_positions(op.shuffle_choices(rows, 3)).withColumn("chi2", F.round("chi2", 6))


@query("g18_grade_answers", """SELECT user_id AS tenant, event_id, q.question_id, q.concept_key, CAST(event_id % 5 AS INT) = answer_index AS is_correct FROM events JOIN questions q ON q.question_id = event_id % 70 WHERE event_id % 5 <= 3""")
def g18(v: Views):
    sent = v.events.selectExpr("event_id", "user_id as tenant", "event_id % 70 as question_id", "cast(event_id % 5 as int) as chosen")
    return op.grade_answers(sent, v.questions).select("tenant", "event_id", "question_id", "concept_key", "is_correct")
