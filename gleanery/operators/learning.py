"""Grounding of generated questions, mastery and quiz sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.functions.text import collapsed, concept_slug, folded_marks, grounding_tokens, model_json
from gleanery.operators.ranking import hours_since
from gleanery.operators.vectors import nearest_index_quantiles


def ground_quotes(quotes: DataFrame, bodies: DataFrame, min_overlap: float = K.GROUND_OVERLAP) -> DataFrame:
    """reason for every quote (id, quote, source, target) against its source's body (source, body):
    the first that fails of length, verbatim, specific and overlap, else pass. An overlap of 0
    turns the last test off. fixable: a quote that is not verbatim but would be if quotation marks,
    dashes, dots and full-width letters were folded."""
    rows = quotes.join(bodies, "source", "left")
    norm = lambda c: F.lower(collapsed(F.col(c)))
    rows = rows.withColumns({"q": norm("quote"), "b": F.coalesce(norm("body"), F.lit("")), "t": norm("target")})
    rows = rows.withColumns({"qt": grounding_tokens(F.col("q")), "tt": F.coalesce(grounding_tokens(F.col("t")), F.array().cast("array<string>"))})
    both, either = F.size(F.array_intersect("qt", "tt")), F.size(F.array_union("qt", "tt"))
    overlap = F.when((F.size("qt") == 0) | (F.size("tt") == 0), 0.0).otherwise(both / either)
    reason = F.when(F.length("q") < K.GROUND_CHARS, "too_short").when(~F.contains("b", "q"), "not_verbatim").when(F.size("qt") == 0, "not_specific")
    if min_overlap > 0:
        reason = reason.when(overlap < min_overlap, "low_overlap")
    fixable = F.contains(F.coalesce(folded_marks(F.col("body")), F.lit("")), folded_marks(F.col("quote")))
    rows = rows.withColumns({"overlap": overlap, "reason": reason.otherwise("pass")})
    return rows.withColumn("fixable", F.when(F.col("reason") == "not_verbatim", fixable).otherwise(False)).drop("q", "b", "t", "qt", "tt", "body")


def grounding_report(grounded: DataFrame) -> DataFrame:
    return grounded.groupBy("reason").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def grounding_detail(grounded: DataFrame) -> DataFrame:
    """Per kind, and over all (a null kind): how many quotes, how many fail for each reason, how many of
    those that are not verbatim folding would mend, and the rates that pass with the test of overlap and
    without it."""
    count = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    reasons = ("too_short", "not_verbatim", "not_specific", "low_overlap")
    return grounded.rollup("kind").agg(
        F.count("*").alias("n"), *(count(r).alias(r) for r in reasons), F.count_if("fixable").alias("fixable"),
        (count("pass") / F.count("*")).alias("pass_rate"), (count("pass", "low_overlap") / F.count("*")).alias("pass_rate_without_overlap"),
    )


def _text(variant: Column, path: str) -> Column:
    """The text at a path of a variant; null if it is there but not text."""
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(variant, path, "string"))


def land_model_rows(raw: DataFrame) -> DataFrame:
    """Valid rows of model texts (id, text: a JSON array, or an object as its only row) of mixed kinds:
    id, pos, kind and the columns of its kind. qa and cloze cards need a source_quote that is not
    blank; front, back, cloze_text and concept_tag are null unless they are texts. Rows with choices
    are questions (kind choice) and need stem, explanation, source_quote and concept_label that are not
    blank, four choices that are not blank (they are trimmed) and an integer answer_index from 0 to 3; a
    difficulty out of the three is medium. Everything else is dropped; broken JSON has no rows."""
    made = raw.withColumn("v", F.try_parse_json(model_json(F.col("text"))))
    items = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.array("v")).otherwise(F.try_variant_get("v", "$", "array<variant>"))
    rows = made.select("id", F.posexplode(items).alias("pos", "v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    v = F.col("v")
    filled = lambda path: F.when(F.trim(_text(v, path)) != "", F.trim(_text(v, path)))
    raw_choices = F.when(F.schema_of_variant(F.try_variant_get(v, "$.choices", "variant")) == "ARRAY<STRING>", F.try_variant_get(v, "$.choices", "array<string>"))
    choices = F.filter(F.transform(raw_choices, lambda c: F.trim(c)), lambda c: c != "")
    whole = F.schema_of_variant(F.try_variant_get(v, "$.answer_index", "variant")) == "BIGINT"
    answer = F.when(whole, F.try_variant_get(v, "$.answer_index", "int"))
    card = _text(v, "$.type").isin("qa", "cloze")
    kind = F.when(card, _text(v, "$.type")).when(raw_choices.isNotNull(), "choice")
    level = F.when(_text(v, "$.difficulty").isin("easy", "medium", "hard"), _text(v, "$.difficulty")).otherwise("medium")
    rows = rows.withColumns({
        "kind": kind, "quote": filled("$.source_quote"), "front": F.when(card, _text(v, "$.front")), "back": F.when(card, _text(v, "$.back")),
        "cloze_text": F.when(card, _text(v, "$.cloze_text")), "concept": F.when(card, _text(v, "$.concept_tag")).otherwise(filled("$.concept_label")),
        "stem": F.when(~card | card.isNull(), filled("$.stem")), "explanation": filled("$.explanation"), "choices": F.when(kind == "choice", choices),
        "answer": F.when(kind == "choice", answer), "difficulty": F.when(kind == "choice", level), "category": _text(v, "$.category"),
    }).drop("v")
    question = F.col("stem").isNotNull() & F.col("explanation").isNotNull() & F.col("concept").isNotNull() & (F.size("choices") == 4) & F.col("answer").between(0, 3)
    return rows.where(F.col("quote").isNotNull() & F.when(F.col("kind") == "choice", question).otherwise(F.col("kind").isNotNull()))


#: A cloze mark: number, answer, and a hint that may follow.
_CLOZE = r"\{\{c\d+::(.*?)(?:::.*?)?\}\}"


def card_format_ok() -> Column:
    """Whether a card row has what its kind shows: both sides, or a text whose first cloze mark has an
    answer."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(F.col("kind") == "qa", filled("front") & filled("back")).otherwise(filled(F.regexp_extract("cloze_text", _CLOZE, 1)))


def card_target() -> Column:
    """What a card asks: its sides, or its text with the answers in place of their marks."""
    sides = F.concat(F.coalesce("front", F.lit("")), F.lit(" "), F.coalesce("back", F.lit("")))
    return F.when(F.col("kind") == "cloze", F.regexp_replace(F.coalesce("cloze_text", F.lit("")), _CLOZE, "$1")).otherwise(sides)


def gate_cards(cards: DataFrame, bodies: DataFrame, limit: int = 5) -> DataFrame:
    """The first `limit` cards of each source, by pos, of good format and with a grounded quote (without
    the test of overlap). cards: card_id, source, pos, kind, front, back, cloze_text, quote."""
    fine = cards.where(card_format_ok()).withColumn("target", card_target())
    passed = ground_quotes(fine, bodies, min_overlap=0).where("reason = 'pass'")
    order = Window.partitionBy("source").orderBy("pos", "card_id")
    return passed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def coerce_category(column: str, vocabulary: list[str], fallback: str) -> Column:
    """The category if the vocabulary has it, else the fallback."""
    return F.when(F.col(column).isin(*vocabulary), F.col(column)).otherwise(fallback)


def land_candidates(raw: DataFrame) -> DataFrame:
    """Valid multiple-choice questions of model texts (id, text: a JSON array or object): stem, four
    non-empty choices, answer 0 to 3, quote, explanation and concept; a difficulty out of the three
    is medium."""
    row = "struct<stem:string,choices:array<string>,answer:int,quote:string,explanation:string,concept:string,difficulty:string>"
    made = raw.withColumn("json", model_json(F.col("text"))).withColumn("json", F.when(F.col("json").startswith("{"), F.concat(F.lit("["), "json", F.lit("]"))).otherwise(F.col("json")))
    rows = made.select("id", F.posexplode(F.from_json("json", f"array<{row}>")).alias("pos", "c")).select("id", "pos", "c.*")
    choices = F.transform("choices", lambda c: F.trim(c))
    fine = (F.size(F.filter(choices, lambda c: c != "")) == 4) & (F.size("choices") == 4) & F.col("answer").between(0, 3)
    for c in ("stem", "quote", "explanation", "concept"):
        fine &= F.coalesce(F.trim(c) != "", F.lit(False))
    level = F.when(F.col("difficulty").isin("easy", "medium", "hard"), F.col("difficulty")).otherwise("medium")
    return rows.where(fine).withColumns({"choices": choices, "difficulty": level})


def land_annotations(raw: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, summary, tags and outcome of model texts (id, text): a JSON object with a non-empty
    summary and up to three tags of the vocabulary, in order and once each; plain text without
    JSON is salvaged as a summary without tags; broken JSON fails."""
    made = raw.withColumn("json", model_json(F.col("text"))).withColumn("o", F.from_json("json", "struct<summary:string,tags:array<string>>"))
    summary = F.trim("o.summary")
    plain = F.col("json").isNull() & ~F.col("text").rlike(r'"(summary|tags)"\s*:|^\s*[{\[]') & (F.trim("text") != "")
    made = made.withColumn("summary", F.when(summary != "", summary).when(plain, F.trim("text")))
    tags = made.select("id", F.posexplode(F.array_distinct(F.coalesce("o.tags", F.array().cast("array<string>")))).alias("pos", "tag"))
    tags = tags.join(vocabulary.select("tag"), "tag").groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "tag"))), 1, 3)["tag"].alias("tags"))
    outcome = F.when(F.col("summary").isNull(), "failed").when(F.col("json").isNull(), "salvaged").otherwise("landed")
    return made.join(tags, "id", "left").select("id", "summary", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), outcome.alias("outcome"))


def gate_candidates(grounded: DataFrame, limit: int) -> DataFrame:
    """The first `limit` passing candidates of each source, by pos, with a concept slug."""
    fine = grounded.where("reason = 'pass'").withColumn("slug", concept_slug("concept")).where("slug <> ''")
    order = Window.partitionBy("source").orderBy("pos")
    return fine.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def card_targets(feedback: DataFrame, articles: DataFrame, cards: DataFrame, k: int = 10) -> DataFrame:
    """Each tenant's newest k useful, summarised articles that have no card."""
    last = feedback.groupBy("tenant", "article_id").agg(F.max_by("action", F.struct("created_at", "event_id")).alias("action")).where("action = 'useful'")
    rows = last.join(articles.where("summary is not null").select("article_id", "published_at"), "article_id").join(cards.select("article_id"), "article_id", "left_anti")
    order = Window.partitionBy("tenant").orderBy(F.desc_nulls_last("published_at"), "article_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("tenant", "article_id", "place")


def source_prompts(questions: DataFrame, k: int = 30) -> DataFrame:
    """The newest k active stems of each source, cut to 120 characters."""
    order = Window.partitionBy("source_ref").orderBy(F.desc("question_id"))
    rows = questions.where("status = 'active' and source_ref is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return rows.select("source_ref", "question_id", F.substring("stem", 1, 120).alias("stem"))


def latest_concepts(mastery: DataFrame, k: int = 40) -> DataFrame:
    """Each tenant's k concepts of the latest attempts (ties by key), to be reused in prompts."""
    order = Window.partitionBy("tenant").orderBy(F.desc_nulls_last("last_attempt"), "concept_key")
    return mastery.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("tenant", "concept_key", "place")


def seeded(seed: int, *columns: Column) -> Column:
    """A number from 0 to 2^60 - 1 fixed by the seed and the columns, which any engine with md5 can make."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns))), 1, 15), 16, 10).cast("long")


def body_windows(sources: DataFrame, most: int, seed: int) -> DataFrame:
    """The text if short, else a window of `most` characters from a start fixed by id and seed, moved
    (unless it is 0) to after the next space within 200 characters, without blanks at its ends."""
    room = F.length("text") - most
    start = F.pmod(seeded(seed, F.col("source_id")), F.greatest(room + 1, F.lit(1))).cast("int")
    space = F.locate(" ", F.substr("text", start + 1, F.lit(200)))
    begin = F.when(room <= 0, 0).when((start > 0) & (space > 0), start + space).otherwise(start)
    window = F.regexp_replace(F.substr("text", begin + 1, F.lit(most)), r"(?U)^\s+|\s+$", "")
    return sources.select("source_id", begin.cast("long").alias("start"), F.when(room <= 0, F.col("text")).otherwise(window).alias("body"))


def alpha(difficulty: Column, right: Column, alphas: dict = K.ALPHAS) -> Column:
    out = F.when(right, alphas["medium"][0]).otherwise(alphas["medium"][1])
    for level, (up, down) in alphas.items():
        out = F.when(difficulty == level, F.when(right, up).otherwise(down)).otherwise(out)
    return out.cast("double")


def mastery_fold(attempts: DataFrame, alphas: dict = K.ALPHAS, prior: float = K.PRIOR_MASTERY, keys: tuple = ("tenant", "concept_key")) -> DataFrame:
    """Mastery per key: from the prior, each attempt in order of (created_at, attempt_id) moves it by
    alpha towards 1 or 0. An attempt is the map m -> (1 - alpha) m + alpha target, so the state of a
    key is a weighted sum: with R the product of later (1 - alpha), m = prior * R0 + sum(alpha target
    R). Running sums of logarithms give R, so no key is gathered into an array."""
    step = attempts.withColumn("alpha", alpha(F.col("difficulty"), F.col("is_correct"), alphas))
    later = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("attempt_id")).rowsBetween(Window.unboundedPreceding, -1)
    step = step.withColumn("rest", F.exp(F.coalesce(F.sum(F.log(1 - F.col("alpha"))).over(later), F.lit(0.0))))
    gain = F.sum(F.when(F.col("is_correct"), F.col("alpha") * F.col("rest")).otherwise(0.0))
    left = F.exp(F.sum(F.log(1 - F.col("alpha"))))
    m = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prior * left + gain))
    return step.groupBy(*keys).agg(m.alias("mastery"), F.count("*").alias("attempts"), F.max("created_at").alias("last_attempt"))


#: Parameter sets of the replay: the alphas scaled.
REPLAY_SCALES = (0.5, 0.75, 1.0, 1.25)


def mastery_replay(attempts: DataFrame, scales: tuple = REPLAY_SCALES) -> DataFrame:
    """Mastery of all keys under several parameter sets: mean, the middle value (by floor(n / 2)), and
    how many are low (< 0.3) and high (>= 0.7)."""
    out = None
    for scale, one in _replayed(attempts, scales):
        middle = nearest_index_quantiles(one, [0.5], "mastery").select(F.col("value").alias("median"))
        row = one.agg(F.avg("mastery").alias("mean"), F.count_if(F.col("mastery") < 0.3).alias("low"), F.count_if(F.col("mastery") >= 0.7).alias("high"))
        row = row.join(F.broadcast(middle), F.lit(True), "left").select(F.lit(scale).alias("scale"), "mean", "median", "low", "high")
        out = row if out is None else out.union(row)
    return out


def _replayed(attempts: DataFrame, scales: tuple):
    for scale in scales:
        yield scale, mastery_fold(attempts, {k: (a * scale, b * scale) for k, (a, b) in K.ALPHAS.items()})


def replay_top_concepts(attempts: DataFrame, scales: tuple = REPLAY_SCALES, k: int = 15) -> DataFrame:
    """(tenant, concept_key, attempts, scale, mastery): the k keys with the most attempts (ties by key)
    under each parameter set."""
    keys = ["tenant", "concept_key"]
    best = attempts.groupBy(*keys).agg(F.count("*").alias("attempts")).orderBy(F.desc("attempts"), *keys).limit(k)
    out = None
    for scale, one in _replayed(attempts.join(F.broadcast(best.select(*keys)), keys, "left_semi"), scales):
        rows = best.join(one.select(*keys, "mastery"), keys).withColumn("scale", F.lit(scale))
        out = rows if out is None else out.union(rows)
    return out.select(*keys, "attempts", "scale", "mastery")


def ledger_totals(attempts: DataFrame) -> DataFrame:
    """Per difficulty, and over all (a null level): attempts, keys, the rate of right answers, first and
    last day."""
    day = lambda f: f(F.to_date("created_at")).cast("string")
    key = F.struct("tenant", "concept_key")
    return attempts.withColumn("level", F.coalesce("difficulty", F.lit("unknown"))).rollup("level").agg(
        F.count("*").alias("attempts"), F.count_distinct(key).alias("concepts"), F.avg(F.col("is_correct").cast("double")).alias("correct_rate"),
        day(F.min).alias("first_day"), day(F.max).alias("last_day"),
    )


def mastery_drift(replayed: DataFrame, stored: DataFrame, keys: tuple = ("tenant", "concept_key")) -> DataFrame:
    """matched, differs, orphan (stored without attempts) or missing, per key."""
    s = stored.select(*keys, F.col("mastery").alias("stored"), F.col("attempts").alias("stored_attempts"))
    both = replayed.select(*keys, "mastery", "attempts").join(s, list(keys), "full")
    same = (F.abs(F.col("mastery") - F.col("stored")) < 0.005) & (F.col("attempts") == F.col("stored_attempts"))
    return both.withColumn("state", F.when(F.col("mastery").isNull(), "orphan").when(F.col("stored").isNull(), "missing").when(same, "matched").otherwise("differs"))


def category_mastery(mastery: DataFrame, questions: DataFrame) -> DataFrame:
    """Mean mastery of each tenant's tech categories, and the three weakest concepts."""
    concept = questions.where("category like 'tech/%'").select("concept_key", "category").distinct()
    rows = mastery.where("attempts > 0").join(concept, "concept_key")
    order = Window.partitionBy("tenant", "category").orderBy("mastery", "concept_key")
    rows = rows.withColumn("n", F.row_number().over(order))
    weakest = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "concept_key")))), lambda s: s["concept_key"]))
    return rows.groupBy("tenant", "category").agg(F.avg("mastery").alias("mean"), F.count("*").alias("concepts"), weakest.alias("weakest"))


def score_questions(pool: DataFrame, mastery: DataFrame, now: str, jitter_seed: int | None = None) -> DataFrame:
    """priority of every tenant's pool question: weakness x rest since served x fit of level x jitter.
    pool: tenant, question_id, concept_key, difficulty; mastery: tenant, concept_key, mastery,
    last_served_at."""
    rows = pool.join(mastery.select("tenant", "concept_key", "mastery", "last_served_at"), ["tenant", "concept_key"], "left")
    m = F.coalesce("mastery", F.lit(K.PRIOR_MASTERY))
    days = hours_since("last_served_at", now) / 24
    rest = F.when(F.col("last_served_at").isNull(), 1.0).otherwise(0.05 + 0.95 * F.least(F.lit(1.0), days / 14))
    band = F.when(m < 0.4, 0).when(m < 0.7, 1).otherwise(2)
    level = F.when(F.col("difficulty") == "easy", 0).when(F.col("difficulty") == "hard", 2).otherwise(1)
    fit = F.element_at(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.15)), (F.abs(band - level) + 1).cast("int"))
    jitter = F.lit(1.0) if jitter_seed is None else 0.95 + 0.1 * (F.pmod(F.xxhash64("tenant", "question_id", F.lit(jitter_seed)), F.lit(10_000)) / 10_000)
    return rows.withColumn("priority", F.greatest(1 - m, F.lit(0.1)) * rest * fit * jitter)


def select_session(
    pool: DataFrame, attempts: DataFrame, mastery: DataFrame, now: str, size: int = 5, newest: int = K.SESSION_POOL, category: str | None = None,
) -> DataFrame:
    """Each tenant's session: of the `newest` questions (of one category, where that is given) those
    not answered lately (right: 14 days, wrong: 4), the best of each concept first, then the rest by
    priority; ties by question_id. Questions are numbered as they are made."""
    pool = pool if category is None else pool.where(F.col("category") == category)
    age = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("question_id")))
    pool = pool.withColumn("age", age).where(F.col("age") <= newest).drop("age")
    last = attempts.groupBy("tenant", "question_id").agg(F.max_by(F.struct("is_correct", "created_at"), F.struct("created_at", "attempt_id")).alias("last"))
    wait = F.when(F.col("last.is_correct"), K.RETRY_RIGHT_DAYS).otherwise(K.RETRY_WRONG_DAYS)
    rows = pool.join(last, ["tenant", "question_id"], "left").withColumn("at", F.col("last.created_at"))
    rows = rows.where(F.col("last").isNull() | (hours_since("at", now) / 24 >= wait))
    rows = score_questions(rows, mastery, now).withColumn("p", F.round("priority", 9))
    best = F.row_number().over(Window.partitionBy("tenant", "concept_key").orderBy(F.desc("p"), "question_id"))
    order = Window.partitionBy("tenant").orderBy(F.col("best") > 1, F.desc("p"), "question_id")
    return rows.withColumn("best", best).withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("tenant", "question_id", "place")


def mark_served(mastery: DataFrame, served: DataFrame, now: str) -> DataFrame:
    """Mastery with last_served_at set for served (tenant, concept_key); new ones at the prior."""
    keys = ["tenant", "concept_key"]
    both = mastery.join(served.select(*keys).distinct().withColumn("hit", F.lit(True)), keys, "full")
    return both.select(
        *keys, F.coalesce("mastery", F.lit(K.PRIOR_MASTERY)).alias("mastery"), F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.when(F.col("hit"), F.lit(now).cast("timestamp")).otherwise(F.col("last_served_at").cast("timestamp")).alias("last_served_at"),
    )


def pool_deficit(tenants: DataFrame, questions: DataFrame, attempts: DataFrame, sources: DataFrame) -> DataFrame:
    """Per tenant and category with an approved source: unseen questions, how many are missing to
    POOL_PER_CATEGORY, and the share of POOL_PER_RUN that goes to it, in order of categories."""
    live = questions.where("status = 'active' and not dup_flag").select("question_id", "category")
    grid = tenants.crossJoin(F.broadcast(sources.where("status = 'approved'").select("category").distinct()))
    seen = attempts.select("tenant", "question_id").distinct().join(live, "question_id").groupBy("tenant", "category").agg(F.count("*").alias("seen"))
    size = live.groupBy("category").agg(F.count("*").alias("size"))
    rows = grid.join(size, "category", "left").join(seen, ["tenant", "category"], "left").na.fill(0, ["size", "seen"])
    rows = rows.withColumn("unseen", F.col("size") - F.col("seen")).withColumn("deficit", F.greatest(F.lit(0), K.POOL_PER_CATEGORY - F.col("unseen")))
    before = F.coalesce(F.sum("deficit").over(Window.partitionBy("tenant").orderBy("category").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    give = F.greatest(F.lit(0), F.least(F.col("deficit"), K.POOL_PER_RUN - before))
    return rows.select("tenant", "category", "unseen", "deficit", give.alias("allocated"))


def retire_orphans(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Active questions whose source is null or unknown."""
    active = questions.where("status = 'active'")
    return active.join(sources.select(F.col("source_id").alias("source_ref")), "source_ref", "left_anti")


def answer_positions(questions: DataFrame) -> DataFrame:
    """Histogram of answer positions with their share of chi squared against an even spread."""
    total = questions.where("answer_index between 0 and 3").agg(F.count("*").alias("total"))
    rows = questions.where("answer_index between 0 and 3").groupBy("answer_index").agg(F.count("*").alias("n")).crossJoin(total)
    return rows.select("answer_index", "n", (F.pow(F.col("n") - F.col("total") / 4, 2) / (F.col("total") / 4)).alias("chi2"))


def shuffle_choices(questions: DataFrame, seed: int) -> DataFrame:
    """Choices in an order fixed by a hash of question, place and seed; the answer moves along."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.size("choices") - 1), lambda i: F.struct(seeded(seed, F.col("question_id"), i).alias("h"), i.alias("i"))))
    out = questions.withColumn("o", order)
    return out.withColumns({
        "answer_index": (F.array_position(F.transform("o", lambda s: s["i"]), F.col("answer_index")) - 1).cast("int"),
        "choices": F.transform("o", lambda s: F.element_at("choices", s["i"] + 1)),
    }).drop("o")


def grade_answers(submissions: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows for the ledger: submissions (tenant, question_id, chosen) with a choice of 0 to 3 to a known
    question."""
    rows = submissions.where("chosen between 0 and 3").join(questions.select("question_id", "concept_key", "difficulty", "answer_index"), "question_id")
    return rows.withColumn("is_correct", F.col("chosen") == F.col("answer_index"))
