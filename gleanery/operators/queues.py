"""Fair-share work queues, their ledgers, and guards over a run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.operators.landing import at
from gleanery.operators.ranking import hours_since
from gleanery.sources.shared import written

# Failures that come from the environment and are not charged to an item, by the type of a
# batch result or the status of a request; so are statuses from 500 on, and requests without a connection.
FREE_ERRORS = ("rate_limit_error", "overloaded_error", "api_error", "timeout_error", "authentication_error", "billing_error", "connection_error", "401", "429")


def claim_work(articles: DataFrame, feeds: DataFrame, leases: DataFrame, per_feed: int, max_rows: int, hours: int = K.LEASE_HOURS, now: str = K.NOW) -> DataFrame:
    """Articles to work on, round-robin over active feeds: each feed's newest `per_feed` (nulls last,
    ties by id), by rank, then the feed's credibility, newest, id; at most max_rows. Eligible: body
    but no summary, attempts left, no live lease. With the lease's end, the pool (what the feeds
    could give) and whether any feed had more."""
    if per_feed < 1:
        raise ValueError("per_feed must be at least 1")
    free = leases.where((F.col("attempts") < K.MAX_ATTEMPTS) & (F.col("reserved_until").isNull() | (F.col("reserved_until") < at(now)))).select("article_id")
    rows = articles.where("summary is null and content is not null").select("article_id", "feed_id", "published_at")
    rows = rows.join(free, "article_id", "left_semi").join(feeds.where("active").select("feed_id", "credibility"), "feed_id")
    backlog = rows.groupBy("feed_id").count()
    pool = backlog.agg(F.sum(F.least("count", F.lit(per_feed))).alias("pool"), F.max(F.col("count") > per_feed).alias("pool_capped"))
    order = [F.desc_nulls_last("published_at"), "article_id"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("feed_id").orderBy(*order))).where(F.col("rank") <= per_feed)
    best = ranked.orderBy("rank", F.desc("credibility"), *order).limit(max_rows)
    return best.withColumn("reserved_until", at(now) + F.expr(f"interval {hours} hours")).crossJoin(F.broadcast(pool))


def settle_work(leases: DataFrame, outcomes: DataFrame, now: str = K.NOW) -> DataFrame:
    """Leases after outcomes (article_id, lease, charged, error): only where the lease is the same. Both
    kinds end the lease and note when and, in 500 characters, why it failed; a charge counts an attempt."""
    hit = leases.join(outcomes, "article_id", "left")
    match = F.coalesce(F.col("reserved_until") == F.col("lease"), F.lit(False))
    charge = match & F.col("charged")
    return hit.select(
        "article_id", (F.col("attempts") + F.when(charge, 1).otherwise(0)).alias("attempts"), F.when(~match, F.col("reserved_until")).alias("reserved_until"),
        F.when(match, at(now)).otherwise(F.col("failed_at")).alias("failed_at"), F.when(match, F.substring("error", 1, 500)).otherwise(F.col("last_error")).alias("last_error"),
        F.when(charge, "charged").when(match, "released").alias("settled"),
    )


def settle_counts(settled: DataFrame) -> DataFrame:
    """One row: how many were charged and released."""
    return settled.agg(F.count_if(F.col("settled") == "charged").alias("charged"), F.count_if(F.col("settled") == "released").alias("released"))


def attribute_failures(failures: DataFrame, results: DataFrame) -> DataFrame:
    """charged: an item of the failure's round succeeded, and its error_type (the type of a batch result,
    or a status as text) is not one of FREE_ERRORS nor a status of 500 or more. Unknown types and null
    are charged."""
    witness = results.groupBy("round_id").agg((F.count_if(F.col("outcome") == "succeeded") > 0).alias("witness"))
    out = failures.join(witness, "round_id", "left")
    free = F.col("error_type").isin(*FREE_ERRORS) | (F.when(F.col("error_type").rlike("^[0-9]{3}$"), F.col("error_type").cast("int")) >= 500)
    return out.withColumn("charged", F.coalesce("witness", F.lit(False)) & ~F.coalesce(free, F.lit(False))).drop("witness")


def reconcile_results(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Per round: outcomes of expected items (the first result by pos counts, ties by tokens and outcome), missing ones as
    failures, unknown or repeated results, tokens of successes, and items to release."""
    first = results.withColumn("n", F.row_number().over(Window.partitionBy("round_id", "item_id").orderBy("pos", "tokens", "outcome")))
    both = expected.select("round_id", "item_id", F.lit(True).alias("asked")).join(first, ["round_id", "item_id"], "full")
    good = F.col("asked") & (F.coalesce("n", F.lit(1)) == 1)
    is_ = lambda o: F.coalesce(good & (F.col("outcome") == o), F.lit(False))
    return both.groupBy("round_id").agg(
        F.count_if(is_("succeeded")).alias("succeeded"), F.count_if(is_("errored")).alias("errored"), F.count_if(is_("expired")).alias("expired"),
        F.count_if(F.col("asked") & F.col("outcome").isNull()).alias("missing"),
        F.count_if(F.col("asked").isNull() | (F.col("n") > 1)).alias("unknown"),
        F.sum(F.when(is_("succeeded"), F.col("tokens")).otherwise(0)).alias("tokens"), F.count_if(is_("expired") | is_("canceled")).alias("release"),
    )


def apply_annotations(articles: DataFrame, leases: DataFrame, annotations: DataFrame, now: str = K.NOW) -> DataFrame:
    """article_id, new_summary and outcome of annotations (article_id, summary_text, lease): applied
    if there is no summary yet and no other live lease, else superseded."""
    rows = annotations.join(articles.select("article_id", "summary"), "article_id").join(leases.select("article_id", "reserved_until"), "article_id", "left")
    other = F.coalesce((F.col("reserved_until") >= at(now)) & (F.col("lease").isNull() | (F.col("lease") != F.col("reserved_until"))), F.lit(False))
    applied = F.col("summary").isNull() & ~other
    return rows.select("article_id", F.when(applied, F.col("summary_text")).otherwise(F.col("summary")).alias("new_summary"), F.when(applied, "applied").otherwise("superseded").alias("outcome"))


def insert_tags(tags: DataFrame, annotations: DataFrame) -> DataFrame:
    """(article_id, tag, source) to add: the tags of annotations (article_id, tags) that an article does
    not have, once each; those it has stay as they are."""
    asked = annotations.select("article_id", F.explode("tags").alias("tag")).where("tag is not null").distinct()
    return asked.join(tags.select("article_id", "tag"), ["article_id", "tag"], "left_anti").withColumn("source", F.lit("llm"))


def usage_today(rounds: DataFrame, now: str) -> DataFrame:
    """Requests since UTC midnight, in all and by batches, and rounds in flight."""
    today = F.col("submitted_at") >= F.date_trunc("day", at(now))
    return rounds.agg(
        F.coalesce(F.sum(F.when(today, F.col("request_count"))), F.lit(0)).alias("used"),
        F.coalesce(F.sum(F.when(today & (F.col("mode") == "batch"), F.col("request_count"))), F.lit(0)).alias("batch_used"),
        F.count_if(F.col("status") == "submitted").alias("in_flight"),
    )


def plan_submit(usage: DataFrame, daily: int = K.DAILY_BUDGET, batch: int = K.BATCH_BUDGET) -> DataFrame:
    """How many to submit, and why none: in flight, then the day's budget, then the batch budget."""
    room, batch_room = F.greatest(F.lit(daily) - F.col("used"), F.lit(0)), F.greatest(F.lit(batch) - F.col("batch_used"), F.lit(0))
    why = F.when(F.col("in_flight") >= K.IN_FLIGHT, "inflight").when(room == 0, "daily").when(batch_room == 0, "batch")
    return usage.withColumns({
        "reason": why, "submit": F.when(why.isNull(), F.least(F.lit(K.RUN_BATCH), room, batch_room)).otherwise(0).cast("long"),
        "sync": F.least(F.lit(K.RUN_BATCH), room).cast("long"),
    })


def selection_problem(selection: Column) -> Column:
    """Why a round's selection (JSON text) can't be read; null if it can: an object of mode batch, with
    ids, a list of texts that is not empty, and lease_deadline, a text that is not empty."""
    made = F.try_parse_json(selection)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(made, path, "variant")), F.lit("VOID"))
    part = lambda path, type_: F.try_variant_get(made, path, type_)
    return (
        F.when(~F.coalesce(kind("$").startswith("OBJECT"), F.lit(False)), "selection")
        .when((kind("$.mode") != "STRING") | (part("$.mode", "string") != "batch"), "mode")
        .when((kind("$.ids") != "ARRAY<STRING>") | F.exists(part("$.ids", "array<string>"), F.isnull), "ids")
        .when((kind("$.lease_deadline") != "STRING") | (part("$.lease_deadline", "string") == ""), "lease_deadline")
    )


def open_rounds(rounds: DataFrame, limit: int = 24) -> DataFrame:
    """Uncollected submitted rounds, oldest first, with their ids and lease_deadline; malformed: without
    a batch id or with a selection that can't be read (problem says what of it)."""
    rows = rounds.where(F.col("status").isin("submitted", "unresolved")).orderBy("submitted_at", "round_id").limit(limit)
    rows = rows.withColumn("problem", F.when(F.col("batch_id").isNull(), "batch_id").otherwise(selection_problem(F.col("selection"))))
    fine = lambda path, kind: F.when(F.col("problem").isNull(), F.try_variant_get(F.try_parse_json("selection"), path, kind))
    return rows.withColumns({"malformed": F.col("problem").isNotNull(), "ids": fine("$.ids", "array<string>"), "lease_deadline": fine("$.lease_deadline", "string")})


def round_backlog(rounds: DataFrame) -> DataFrame:
    return rounds.where(F.col("status").isin("submitted", "unresolved")).agg(F.count("*").alias("open"), F.min("submitted_at").alias("oldest"))


def resolve_stale_rounds(rounds: DataFrame, items: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """Items to release of claimed rounds older than STALE_ROUND_HOURS, of the oldest `limit`."""
    stale = rounds.where((F.col("status") == "claimed") & (F.col("submitted_at") < at(now) - F.expr(f"interval {K.STALE_ROUND_HOURS} hours")))
    stale = stale.orderBy("submitted_at", "round_id").limit(limit).select("round_id", "mode", F.lit("expired_unknown").alias("status"))
    mine = items.select("round_id", "item_id").where("round_id is not null")
    return stale.join(mine, "round_id", "left").withColumn("item_id", F.when(F.col("mode") == "batch", F.col("item_id")))


def close_rounds(rounds: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Rounds with results become collected, with counts; mismatch: results that are not as many as
    the round asked for."""
    out = rounds.join(reconciled, "round_id", "left")
    done = F.col("succeeded").isNotNull() & (F.col("status") != "collected")
    n = F.col("succeeded") + F.col("errored") + F.col("expired") + F.col("missing")
    return out.select(
        "round_id", F.when(done, "collected").otherwise(F.col("status")).alias("status"), F.coalesce("succeeded", F.lit(0)).alias("succeeded"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), (done & (n != F.col("request_count"))).alias("mismatch"),
    )


def quarantine_report(leases: DataFrame, now: str = K.NOW, samples: int = 10) -> DataFrame:
    """Items out of attempts that failed within a day: the newest samples, with the count of all."""
    rows = leases.where((F.col("attempts") >= K.MAX_ATTEMPTS) & (F.col("failed_at") >= at(now) - F.expr("interval 24 hours")))
    return rows.orderBy(F.desc("failed_at"), "article_id").limit(samples).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def unquarantine(leases: DataFrame) -> DataFrame:
    free = (F.col("attempts") >= K.MAX_ATTEMPTS) & F.col("failed_at").isNotNull()
    return leases.withColumn("released", free).withColumn("attempts", F.when(free, 0).otherwise(F.col("attempts")))


def _embed_ranked(articles: DataFrame, feeds: DataFrame, gate: int, now: str) -> tuple[DataFrame, DataFrame]:
    """Articles without a vector of active feeds in the window, and those of them with a body of `gate`
    or more, with their rank in the feed and what it embedded in 24 hours."""
    narrow = articles.select("article_id", "feed_id", "published_at", "embedded_at", "body_len", F.col("embedding").isNull().alias("missing"))
    done = narrow.where(F.col("embedded_at") >= at(now) - F.expr("interval 24 hours")).groupBy("feed_id").agg(F.count("*").alias("done"))
    missing = narrow.where(F.col("missing") & (F.col("published_at") >= at(now) - F.expr(f"interval {K.WINDOW_DAYS} days")))
    missing = missing.join(feeds.where("active").select("feed_id"), "feed_id", "left_semi")
    rows = missing.where(F.coalesce("body_len", F.lit(0)) >= gate).join(done, "feed_id", "left")
    rank = F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc("published_at"), "article_id"))
    return missing, rows.withColumn("rank", rank)


def embed_candidates(articles: DataFrame, feeds: DataFrame, per_day: int, max_rows: int, gate: int = K.EMBED_GATE, now: str = K.NOW) -> DataFrame:
    """Articles to embed: no vector, active feed, in the window, body of `gate` or more. Each feed
    has room for per_day less what it embedded in 24 hours, newest first (eligible: how many that
    lets through); of all the newest max_rows go. Ranks are made on narrow rows; the start of the
    body is joined after the cut."""
    _, ranked = _embed_ranked(articles, feeds, gate, now)
    eligible = ranked.where(F.col("rank") <= per_day - F.coalesce("done", F.lit(0)))
    best = eligible.orderBy(F.desc("published_at"), "article_id").limit(max_rows).select("article_id", "feed_id", "published_at")
    bodies = articles.select("article_id", F.substring("content", 1, 8000).alias("body"))
    return best.crossJoin(F.broadcast(eligible.agg(F.count("*").alias("eligible")))).join(bodies, "article_id")


def embed_pending(articles: DataFrame, feeds: DataFrame, per_day: int, gate: int = K.EMBED_GATE, now: str = K.NOW) -> DataFrame:
    """One row: pending, pending_capped and eligible. While anything is eligible, pending counts what
    has a long enough body (a lower bound, so pending_capped); else all that lack a vector."""
    missing, ranked = _embed_ranked(articles, feeds, gate, now)
    counts = ranked.agg(F.count("*").alias("gated"), F.count_if(F.col("rank") <= per_day - F.coalesce("done", F.lit(0))).alias("eligible"))
    both = counts.crossJoin(missing.agg(F.count("*").alias("all")))
    capped = F.col("eligible") > 0
    return both.select(F.when(capped, F.col("gated")).otherwise(F.col("all")).alias("pending"), capped.alias("pending_capped"), "eligible")


def embed_input(title: Column, text: Column, lead: int = K.EMBED_LEAD) -> Column:
    """Title and lead on two lines; what is empty is left out, null if both are."""
    empty = lambda c: F.when(F.trim(c) != "", F.trim(c))
    made = F.concat_ws("\n", empty(title), empty(F.substring(text, 1, lead)))
    return F.when(made != "", made)


def _lines(*parts: Column) -> Column:
    """The parts that are not empty, a line each; null if all are."""
    made = F.concat_ws("\n", *(F.when(p != "", p) for p in parts))
    return F.when(made != "", made)


def quiz_embed_input(stem: Column, choices: Column, quote: Column, most: int = 200) -> Column:
    """Stem and choices on a line, then the first `most` characters of the quote. Null choices are none."""
    asked = F.trim(F.concat(stem, F.lit(" "), F.coalesce(F.array_join(choices, " "), F.lit(""))))
    return _lines(asked, F.substring(quote, 1, most))


def card_embed_input(kind: Column, front: Column, back: Column, cloze: Column, quote: Column) -> Column:
    """The cloze text, or front and back (what is empty of them is left out), then the quote."""
    sides = F.concat_ws(" ", F.when(front != "", front), F.when(back != "", back))
    return _lines(F.when(kind == "cloze", cloze).otherwise(sides), quote)


def summary_queue(articles: DataFrame, limit: int) -> DataFrame:
    """Articles with a body but no summary, newest first (nulls last, ties by id)."""
    return articles.where("summary is null and content is not null").orderBy(F.desc_nulls_last("published_at"), "article_id").limit(limit)


def backfill_candidates(articles: DataFrame, limit: int) -> DataFrame:
    return articles.where("embedding is null").orderBy(F.desc_nulls_last("published_at"), "article_id").limit(limit)


#: Texts of a queue that are batched at once.
BLOCK_TEXTS = 20_000


def next_starts(tokens: np.ndarray, budget: int, most: int) -> np.ndarray:
    """For each text as the first of a batch, the first text of the next one (their number: none)."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    fits = np.searchsorted(total, total[:-1] + budget, side="right") - 1
    at = np.arange(len(tokens))
    return np.minimum(np.maximum(np.minimum(fits, at + most), at + 1), len(tokens))


def batch_chains(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text as the first of a batch, the first text of the block's last batch, and how many
    batches come after its own, by jumps that double."""
    n = len(following)
    last = following == n
    jump = np.where(last, np.arange(n), following)
    steps = np.where(last, 0, 1)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump, steps
        steps, jump = steps + steps[jump], further


def first_break(tokens: np.ndarray, used: int, n: int, budget: int, most: int) -> int:
    """The first text that a batch with `used` tokens of n texts has no room for."""
    if n == 0:
        return 0
    fits = int(np.searchsorted(used + np.cumsum(tokens), budget, side="right"))
    return min(fits, max(most - n, 0), len(tokens))


def token_batches(texts: DataFrame, budget: int = 3000, most: int = 128) -> DataFrame:
    """(queue, id, tokens, batch): next-fit batches of each queue in order of id (of rows of one id, by
    tokens); a batch is closed when the next text would exceed the budget or the count, an oversize
    text is alone. Tokens are not negative; null tokens are 0, a null queue is one.

    A queue is cut into ranges, and these into blocks of BLOCK_TEXTS. What a block does with the batch
    that is open before it depends on its first `most` texts alone: where it breaks first decides all
    later breaks (next_starts), and jumps that double say where they end. So each block is a short
    table of (break, batches, what is open after it), the tables of a queue follow each other with
    two numbers, and then all blocks are batched side by side. Rows are sorted and written once.
    """
    columns = texts.select(F.col("queue").cast("string").alias("queue"), F.col("id").cast("long").alias("id"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))
    rows = columns.repartitionByRange("queue", "id", "tokens").sortWithinPartitions("queue", "id", "tokens")
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()))
    first = rows.groupBy(F.col("queue").alias("q"), F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("low"))
    blocks = rows.join(first, F.col("queue").eqNullSafe(F.col("q")) & (F.shiftright("place", 33) == F.col("part")))
    blocks = blocks.select("queue", "id", "tokens", "place", "part", F.expr(f"(place - low) div {BLOCK_TEXTS}").alias("block"))
    key = ["queue", "part", "block"]

    def tables(_, pdf):
        tokens = pdf.sort_values("place")["tokens"].to_numpy()
        heads = min(most, len(tokens))
        last, steps = batch_chains(next_starts(tokens, budget, most))
        total = np.concatenate([[0], np.cumsum(tokens)])
        return pd.DataFrame({
            "queue": [pdf["queue"].iloc[0]], "part": [pdf["part"].iloc[0]], "block": [pdf["block"].iloc[0]], "texts": [len(tokens)], "total": [int(total[-1])],
            "heads": [tokens[:heads].tolist()], "batches": [(steps[: heads + 1] + 1).tolist()], "used": [(total[-1] - total[last[: heads + 1]]).tolist()], "n": [(len(tokens) - last[: heads + 1]).tolist()],
        })

    def follow(pieces):
        queue, batch, used, n = object(), 0, 0, 0
        for pdf in pieces:
            out = []
            for r in pdf.itertuples(index=False):
                if r.queue != queue:
                    queue, batch, used, n = r.queue, 0, 0, 0
                out.append((r.queue, r.part, r.block, batch, used, n))
                brk = first_break(np.asarray(r.heads), used, n, budget, most)
                if brk >= r.texts:
                    used, n = used + r.total, n + r.texts
                else:
                    batch, used, n = batch + int(r.batches[brk]) - (n == 0), int(r.used[brk]), int(r.n[brk])
            yield pd.DataFrame(out, columns=[*key, "batch", "used", "n"])

    def number(_, pdf):
        pdf = pdf.sort_values("place")
        tokens, (batch, used, n) = pdf["tokens"].to_numpy(), (int(pdf[c].iloc[0]) for c in ("batch", "used", "n"))
        brk, following = first_break(tokens[:most], used, n, budget, most), next_starts(tokens, budget, most)
        starts, at = np.zeros(len(tokens), np.int64), brk
        while at < len(tokens):
            starts[at] = 1
            at = following[at]
        if n == 0 and len(starts):
            starts[0] = 0
        return pdf.assign(batch=batch + np.cumsum(starts))[["queue", "id", "tokens", "batch"]]

    made = blocks.groupBy(*key).applyInPandas(tables, "queue string, part long, block long, texts long, total long, heads array<long>, batches array<long>, used array<long>, n array<long>")
    entered = made.repartition("queue").sortWithinPartitions(*key).mapInPandas(follow, "queue string, part long, block long, batch long, used long, n long")
    entered = entered.withColumnRenamed("queue", "q").withColumnRenamed("part", "p").withColumnRenamed("block", "b")
    both = blocks.join(entered, F.col("queue").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).drop("q", "p", "b")
    return both.groupBy(*key).applyInPandas(number, "queue string, id long, tokens long, batch long")


def untagged(articles: DataFrame, tags: DataFrame) -> DataFrame:
    return articles.where("summary is not null").join(tags.select("article_id"), "article_id", "left_anti")


def broken_annotations(articles: DataFrame, column: str = "summary") -> DataFrame:
    return articles.where(F.col(column).rlike(r'"(summary|tags)"\s*:|```'))


def reset_annotations(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """Articles with a body lose their summary and tags: how many of each."""
    body = articles.where("content is not null")
    return body.agg(F.count("*").alias("articles"), F.count("summary").alias("summaries")).crossJoin(
        tags.join(body.select("article_id"), "article_id", "left_semi").agg(F.count("*").alias("tags"))
    )


def apply_reannotations(articles: DataFrame, annotations: DataFrame, force: bool = False) -> DataFrame:
    """outcome per annotation (article_id, summary_text, replaced): tagged or empty, and the summary,
    which is overwritten only when forced or when the body was replaced."""
    rows = annotations.join(articles.select("article_id", "summary"), "article_id")
    over = F.lit(force) | F.col("replaced") | F.col("summary").isNull()
    outcome = F.when(F.col("summary_text").isNull(), "failed").when(F.size("tags") > 0, "tagged").otherwise("empty")
    return rows.select("article_id", F.when(over & F.col("summary_text").isNotNull(), F.col("summary_text")).otherwise(F.col("summary")).alias("summary"), outcome.alias("outcome"))


def rotate_sources(sources: DataFrame, limit: int, category: str | None = None) -> DataFrame:
    """Approved sources with a body, least recently used first (never used before all)."""
    rows = sources.where("status = 'approved' and body is not null")
    rows = rows if category is None else rows.where(F.col("category") == category)
    return rows.orderBy(F.asc_nulls_first("last_generated_at"), "source_id").limit(limit)


def stamp_sources(sources: DataFrame, picked: DataFrame, now: str = K.NOW) -> DataFrame:
    """The sources, with the time of those that were picked: they come last next time."""
    hit = sources.join(picked.select("source_id", F.lit(True).alias("picked")), "source_id", "left")
    return hit.withColumn("last_generated_at", F.when(F.col("picked"), at(now)).otherwise(F.col("last_generated_at"))).drop("picked")


def source_stock(sources: DataFrame) -> DataFrame:
    """(category, stock): how many approved sources with a body each category of the sources has."""
    return sources.groupBy("category").agg(F.count_if(F.expr("status = 'approved' and body is not null")).alias("stock"))


#: Rules over a row of run metrics; null is unknown and never fails.
GUARDS = {
    "all_failed": "fetch_results > 0 and fetch_failed = fetch_results", "stale_feeds": "stale_feeds > 0",
    "annotate_dead": "annotated_attempted > 0 and annotated = 0",
    "selection_dead": "not coalesce(selection_skipped, false) and (pool_error is not null or (pool > 0 and selected = 0))",
    "cap_unavailable": "cap_unavailable", "ledger_failed": "ledger_error is not null",
    "submit_dead": "not coalesce(submit_skipped, false) and reserved > 0 and batch_id is null",
    "submit_settle_failed": "submit_settle_error is not null", "orphaned": "batch_id_write_error is not null", "list_failed": "list_error is not null",
    "collect_settle_failed": "collect_settle_error is not null",
    "collect_dead": "not coalesce(collect_skipped, false) and collect_attempted + collect_expired + collect_canceled > 0 and collect_applied + collect_superseded = 0",
    "batch_stuck": "oldest_round_hours > 36", "quarantine_surge": "quarantined > 5",
    "embed_dead": "not coalesce(embed_skipped, false) and embed_attempted > 0 and embed_succeeded = 0",
    "embed_stalled": "coalesce(embed_skip_reason, '') <> 'disk_ceiling' and embedded_recent = 0 and embed_waiting > 0",
    "embed_gate_stuck": "coalesce(embed_skip_reason, '') <> 'disk_ceiling' and embed_pending > 0 and embed_eligible = 0",
    "embed_select_stalled": "embed_select_error is not null and embedded_recent = 0",
    "deck_starved": "deck_available >= 0 and deck_available < 40", "prune_stalled": "prune_remaining < 0 or prune_remaining > 1000",
    "quiz_dead": "quiz_deficit > 0 and quiz_generated = 0",
}
#: The metrics that rules read, with their types.
METRICS = (
    "fetch_results long, fetch_failed long, stale_feeds long, annotated_attempted long, annotated long, selection_skipped boolean, pool_error string, pool long, selected long, "
    "cap_unavailable boolean, ledger_error string, submit_skipped boolean, reserved long, batch_id string, submit_settle_error string, batch_id_write_error string, list_error string, "
    "collect_settle_error string, collect_skipped boolean, collect_attempted long, collect_expired long, collect_canceled long, collect_applied long, collect_superseded long, "
    "oldest_round_hours double, quarantined long, embed_skipped boolean, embed_skip_reason string, embed_attempted long, embed_succeeded long, embedded_recent long, embed_waiting long, "
    "embed_pending long, embed_eligible long, embed_select_error string, deck_available long, prune_remaining long, quiz_deficit long, quiz_generated long"
)


def metrics_of(spark: SparkSession, *observations: Observation) -> DataFrame:
    """One row of what was observed while a run's tables were written (`df.observe(Observation(), ...)`
    before the write): the guards read no table again. What nothing observed is unknown."""
    found = {k: x for o in observations for k, x in o.get.items()}
    types = [c.split() for c in METRICS.split(", ")]
    return spark.createDataFrame([[found.get(name) for name, _ in types]], ", ".join(f"{name} {kind}" for name, kind in types))


def run_guards(metrics: DataFrame) -> DataFrame:
    """(guard, fails) of a row of metrics (see METRICS; a column that is not there is unknown)."""
    missing = [c.split() for c in METRICS.split(", ") if c.split()[0] not in metrics.columns]
    metrics = metrics.withColumns({c: F.lit(None).cast(kind) for c, kind in missing})
    flags = F.array(*[F.struct(F.lit(n).alias("guard"), F.coalesce(F.expr(rule), F.lit(False)).alias("fails")) for n, rule in GUARDS.items()])
    return metrics.select(F.explode(flags).alias("g")).select("g.*")


def activity_counts(articles: DataFrame, now: str = K.NOW, hours: int = K.STALL_HOURS) -> DataFrame:
    recent = F.col("embedded_at") >= at(now) - F.expr(f"interval {hours} hours")
    return articles.agg(F.count_if(recent).alias("embedded_recent"), F.count_if(F.col("embedding").isNull() & (F.col("body_len") >= K.EMBED_GATE)).alias("embed_waiting"))


def refresh_cooldown(markers: DataFrame, now: str, minutes: int = 60) -> DataFrame:
    """Tenants whose last run (tenant, ts) is under an hour old skip the fetch."""
    last = markers.groupBy("tenant").agg(F.max("ts").alias("last_run"))
    return last.withColumn("skip", hours_since("last_run", now) * 60 < minutes)
