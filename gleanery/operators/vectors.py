"""Exact cosine search and near-duplicate jobs over vectors.

A zero vector, or one of another length, has the similarity 0 with everything. Pairs are compared
in blocks: rows are dealt to blocks by a hash, every pair of blocks is one group of bounded size, and
a group is one matrix product. Only what a job needs leaves a group (a maximum per row, a flag, or
pairs over a threshold).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from gleanery import constants as K
from gleanery.operators.health import in_window, recipe
from gleanery.operators.landing import at

#: Rows of a block.
BLOCK_ROWS = 2000
#: Most rows of a block of pairs_over, whose tasks hold two; it makes PAIR_BLOCKS of blocks that are not under BLOCK_ROWS.
PAIR_ROWS, PAIR_BLOCKS = 50_000, 12
#: Rows of two blocks that are compared in one product.
TILE = 1000, 4000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine as an expression; 0 for zero vectors and unequal lengths, null for null ones."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def vector_audit(vectors: DataFrame, dimension: int, group: str = "grp") -> DataFrame:
    """Per group: rows, null or empty vectors, zero ones, and ones of another dimension."""
    empty = F.col("embedding").isNull() | (F.size("embedding") == 0)
    return vectors.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(empty).alias("missing"), F.count_if(~empty & (F.size("embedding") != dimension)).alias("off_dimension"),
        F.count_if(~empty & F.forall("embedding", lambda x: x == 0)).alias("zero"), F.round(F.avg(dot(F.col("embedding"), F.col("embedding"))), 4).alias("mean_square"),
    )


def knn_search(vectors: DataFrame, queries: DataFrame, threshold: float = 0.4, k: int = 8) -> DataFrame:
    """For each query (query_id, q) its k (at most 200) nearest vectors of cosine over `threshold`, by
    distance, then id. Queries are a stated set: every block of vectors meets every block of
    queries once, and keeps k rows a query."""
    k = min(k, 200)

    def nearest(pdf):
        rows, asked = pdf[~pdf["is_query"]], pdf[pdf["is_query"]]
        sims = similarities(asked["v"].tolist(), rows["v"].tolist())
        out = []
        ids = rows["id"].to_numpy()
        for i, q in enumerate(asked["id"]):
            order = np.lexsort((ids, -sims[i]))[:k]
            out += [(q, int(ids[j]), float(sims[i, j])) for j in order if sims[i, j] > threshold]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "similarity"])

    n, m = vectors.count(), queries.count()
    blocks, parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_ROWS))
    side = vectors.where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(False).alias("is_query"))
    side = side.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"), F.lit(True).alias("is_query"))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = side.select("a", "b", "id", "v", "is_query").union(asked.select("a", "b", "id", "v", "is_query")).groupBy("a", "b").applyInPandas(
        nearest, "query_id long, vec_id long, similarity double"
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def search_articles(
    articles: DataFrame, queries: DataFrame, threshold: float = 0.4, k: int = 8, after: str | None = None, feed: str | None = None,
) -> DataFrame:
    """knn_search over the summarised articles, published since `after` and of one feed where these are
    given, with what a result shows of each."""
    rows = articles.where("embedding is not null and summary is not null")
    rows = rows if after is None else rows.where(F.col("published_at") >= at(after))
    rows = rows if feed is None else rows.where(F.col("feed_id") == feed)
    found = knn_search(rows.select(F.col("article_id").alias("vec_id"), "embedding"), queries, threshold, k)
    return found.join(articles.select(F.col("article_id").alias("vec_id"), "title", "summary", "published_at", "feed_id"), "vec_id")


def similarities(left: list, right: list) -> np.ndarray:
    """Cosines of two lists of vectors; 0 for zero vectors and unequal lengths."""
    out = np.zeros((len(left), len(right)))
    sizes_l, sizes_r = np.array([len(v) for v in left]), np.array([len(v) for v in right])
    for d in np.intersect1d(sizes_l, sizes_r):
        i, j = np.flatnonzero(sizes_l == d), np.flatnonzero(sizes_r == d)
        if d:
            x, y = np.array([left[k] for k in i], float), np.array([right[k] for k in j], float)
            nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            s = (x / np.where(nx, nx, 1)[:, None]) @ (y / np.where(ny, ny, 1)[:, None]).T
            out[np.ix_(i, j)] = s
    return out


def qa_context(queries: DataFrame, matches: DataFrame, articles: DataFrame, cited: DataFrame) -> DataFrame:
    """Titles and passages (title and summary on two lines) of each query's matches, and whether they
    are its sources: the cited ones, or all if none is cited. A query without matches has one row,
    whose outcome is abstain."""
    rows = matches.join(articles.select(F.col("article_id").alias("vec_id"), "title", "summary"), "vec_id").join(
        cited.withColumn("is_cited", F.lit(True)), ["query_id", "vec_id"], "left"
    )
    any_cited = F.max(F.coalesce("is_cited", F.lit(False))).over(Window.partitionBy("query_id"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[<>\[\]`*#]", " "), r"\s+", " "))
    filled = lambda c: F.when(c != "", c)
    title, passage = clean(F.col("title")), clean(F.col("summary"))
    rows = rows.select(
        "query_id", "vec_id", "place", F.coalesce(filled(title), F.lit("(無題)")).alias("title"), F.concat_ws("\n", filled(title), filled(passage)).alias("passage"),
        (F.coalesce("is_cited", F.lit(False)) | ~any_cited).alias("source"),
    )
    return queries.select("query_id").join(rows, "query_id", "left").withColumn("outcome", F.when(F.col("vec_id").isNull(), "abstain").otherwise("answer"))


def blocked(rows: DataFrame, others: DataFrame, fold, schema: str, combine=None) -> DataFrame:
    """Every row against every other row in groups of two blocks: `fold(rows, others)` reduces a
    group, `combine` (aggregates by row id, if any) the groups of a row. Both have id, v and what
    fold needs; the number of rows decides the blocks."""
    others = others.select(*[F.col(c).alias(c) for c in others.columns])  # columns of its own beside rows
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    m = max(1, -(-others.count() // BLOCK_ROWS))
    left = rows.withColumn("_a", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = others.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(fold, schema)
    return out.groupBy("id").agg(*combine) if combine else out


def _edges(rows: DataFrame) -> list[float]:
    """Values of ord that part the rows into blocks of about BLOCK_ROWS."""
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    return rows.approxQuantile("ord", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []


def blocked_by_order(rows: DataFrame, others: DataFrame, fold, schema: str, combine: list) -> DataFrame:
    """As blocked, for jobs that compare with smaller ord only: blocks are ranges of ord (rows of one
    ord that fills several are dealt to these by a hash), and a pair of blocks is a group only if some
    of the others' can be smaller. Where both are the same rows that is half of all pairs."""
    others = others.select(*[F.col(c).alias(c) for c in others.columns])
    p, q = _edges(rows), _edges(others)

    def below(edges: list[float], value: Column, equal: bool) -> Column:
        known = F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>")
        return F.size(F.filter(known, lambda e: e <= value if equal else e < value))

    def block(edges: list[float]) -> Column:
        low, high = below(edges, F.col("ord"), False), below(edges, F.col("ord"), True)
        return (low + F.pmod(F.xxhash64("id"), high - low + 1)).cast("int")

    left = rows.withColumn("_a", block(p)).withColumn("_b", F.explode(F.sequence(F.lit(0), below(q, F.col("ord"), False))))
    start = F.element_at(F.array(*[F.lit(float(e)) for e in [float("-inf"), *q]]), F.col("_b") + 1)
    right = others.withColumn("_b", block(q)).withColumn("_a", F.explode(F.sequence(below(p, start, True), F.lit(len(p)))))
    out = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(fold, schema)
    return out.groupBy("id").agg(*combine)


def earlier_maximum(rows: DataFrame, others: DataFrame, other_group: bool | None) -> DataFrame:
    """(id, best): the highest cosine of each row (id, grp, ord, v) with others of strictly smaller
    ord; of another group if other_group is True. Null where nothing was compared."""

    def fold(a, b):
        if a.empty:
            return pd.DataFrame({"id": [], "best": []})
        if b.empty:
            return pd.DataFrame({"id": a["id"], "best": np.full(len(a), np.nan)})
        s = similarities(a["v"].tolist(), b["v"].tolist())
        ok = b["ord"].to_numpy()[None] < a["ord"].to_numpy()[:, None]
        if other_group:
            ok &= a["grp"].to_numpy()[:, None] != b["grp"].to_numpy()[None]
        best = np.where(ok, s, -np.inf).max(axis=1)
        return pd.DataFrame({"id": a["id"], "best": np.where(ok.any(axis=1), best, np.nan)})

    out = blocked_by_order(rows, others, fold, "id long, best double", [F.max(F.nanvl("best", F.lit(None).cast("double"))).alias("best")])
    return out


def as_rows(vectors: DataFrame) -> DataFrame:
    return vectors.where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("grp"), F.col("ord").cast("double").alias("ord"), F.col("embedding").alias("v"))


def near_dup_rate(articles: DataFrame, feeds: DataFrame, threshold: float = K.DUPLICATE_COSINE, min_own: int = K.MIN_OWN, now: str = K.NOW, own_cap: int = K.OWN_CAP) -> DataFrame:
    """Per active feed: the share of its newest own_cap articles of the window for which another
    feed's strictly earlier article reaches the threshold; null under min_own."""
    window = in_window(articles, now).where("embedding is not null").select(
        F.col("article_id").alias("id"), F.col("feed_id").alias("grp"), F.unix_micros("published_at").cast("double").alias("ord"), F.col("embedding").alias("v")
    )
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("ord"), "id"))
    own = window.join(F.broadcast(feeds.where("active").select(F.col("feed_id").alias("grp"))), "grp", "left_semi").withColumn("place", place).where(F.col("place") <= own_cap).drop("place")
    best = earlier_maximum(own.select("id", "grp", "ord", "v"), window, True)
    per = own.select("id", "grp").join(best, "id", "left").groupBy("grp").agg(F.count("*").alias("own"), F.count_if(F.col("best") >= threshold).alias("dups"))
    out = feeds.where("active").select("feed_id").join(per.withColumnRenamed("grp", "feed_id"), "feed_id", "left").na.fill(0, ["own", "dups"])
    return out.withColumn("rate", F.when(F.col("own") >= min_own, F.col("dups") / F.col("own")))


def recipe_mix(articles: DataFrame, epoch: str, now: str = K.NOW) -> DataFrame:
    """Counts of recipes in the window, majority (ties: legacy), share and verdict: compute, stuck
    (mixed for RECIPE_GRACE_DAYS since the first lead) or blank."""
    rows = in_window(articles, now).where("embedding is not null").withColumn("recipe", recipe(epoch))
    lead = F.col("recipe") == "lead"
    mix = rows.agg(F.count_if(lead).alias("lead"), F.count_if(~lead).alias("legacy"), F.min(F.when(lead, F.col("embedded_at"))).alias("first_lead"))
    total = F.col("lead") + F.col("legacy")
    share = F.when(total > 0, F.greatest("lead", "legacy") / total)
    since = (F.unix_micros(at(now)) - F.unix_micros(F.greatest(F.col("first_lead"), at(epoch)))) / F.lit(86_400_000_000.0)
    verdict = F.when(total == 0, "blank").when(share >= K.RECIPE_SHARE, "compute").when(since >= K.RECIPE_GRACE_DAYS, "stuck").otherwise("blank")
    return mix.select("lead", "legacy", F.when(F.col("lead") > F.col("legacy"), "lead").otherwise("legacy").alias("majority"), share.alias("share"), verdict.alias("verdict"))


def near_dup_freshness(mix: DataFrame, compute_ok: bool, with_rate: int, total: int) -> DataFrame:
    """Freshness of the rates, and why all are null if they are."""
    fresh = F.when(~F.lit(compute_ok), "compute_failed").when(F.coalesce("share", F.lit(0.0)) < K.RECIPE_SHARE, "recipe_mixed").otherwise("fresh")
    out = mix.withColumn("freshness", fresh)
    n = F.col("lead") + F.col("legacy")
    why = F.when(F.lit(total == 0), "no_feeds").when(F.lit(with_rate > 0), None).when(n == 0, "embedding_stopped").when(F.col("freshness") != "fresh", F.col("freshness"))
    return out.withColumn("all_null_because", why.otherwise("too_few_own"))


def mark_duplicates(candidates: DataFrame, population: DataFrame, threshold: float = K.DUPLICATE_COSINE) -> DataFrame:
    """similarity and dup_flag of candidates (vec_id, embedding, grp, ord): against the population and
    every earlier candidate, duplicate or not; never under 0. Without a vector: null, not a
    duplicate, embed_failed."""
    rows = as_rows(candidates)
    others = rows.unionByName(as_rows(population).withColumn("ord", F.lit(float("-inf"))))
    best = earlier_maximum(rows, others, None)
    out = candidates.select("vec_id", F.col("embedding").isNull().alias("embed_failed")).join(best.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    similarity = F.when(~F.col("embed_failed"), F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0))))
    return out.select("vec_id", "embed_failed", similarity.alias("similarity"), F.coalesce(similarity >= threshold, F.lit(False)).alias("dup_flag"))


def rejudge_unjudged(rows: DataFrame, threshold: float, era: int) -> DataFrame:
    """New judgements of rows (vec_id, embedding, grp, ord, similarity, dup_flag): unjudged ones since
    `era` against all earlier rows; judged ones that are not duplicates become so if an earlier
    unjudged row reaches the threshold."""
    all_rows = as_rows(rows)
    unjudged = rows.where(F.col("similarity").isNull() & (F.col("ord") >= era))
    judged = rows.where(F.col("similarity").isNotNull() & ~F.col("dup_flag"))
    first = earlier_maximum(as_rows(unjudged), all_rows, None)
    first = first.select("id", F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0))).alias("similarity"))
    second = earlier_maximum(as_rows(judged), as_rows(unjudged), None).where(F.col("best") >= threshold).select("id", F.col("best").alias("similarity"))
    new = first.withColumn("kind", F.lit("judged")).union(second.withColumn("kind", F.lit("upgraded")))
    return new.select(F.col("id").alias("vec_id"), "similarity", (F.col("similarity") >= threshold).alias("dup_flag"), "kind")


def dup_sweep(best: DataFrame, thresholds: list[float]) -> DataFrame:
    """How many rows reach each threshold."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return best.select("best", steps).groupBy("threshold").agg(F.count_if(F.col("best") >= F.col("threshold")).alias("dups"), F.count("*").alias("n"))


def maxsim_histogram(best: DataFrame, edges: list[float]) -> DataFrame:
    bucket = sum((F.when(F.col("best") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return best.where("best is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def nearest_index_quantiles(best: DataFrame, quantiles: list[float], column: str = "best", width: float = 0.001) -> DataFrame:
    """Quantiles by index floor(n q) of the sorted values, without interpolation: exact, from counts of
    distinct values. Values (cosines) fall into buckets of `width`; only the buckets that hold a
    quantile are sorted, each on its own."""
    values = best.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.floor(F.col(column) / width).alias("bucket"))
    per = values.groupBy("bucket").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each bucket
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    spots = per.withColumn("below", below).crossJoin(F.broadcast(per.agg(F.sum("n").alias("total")))).select("*", wanted)
    spots = spots.withColumn("spot", F.least(F.col("total") - 1, F.floor(F.col("total") * F.col("q")))).where("below <= spot and spot < below + n")
    counts = values.join(F.broadcast(spots.select("bucket").distinct()), "bucket", "left_semi").groupBy("bucket", "value").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("bucket").orderBy("value"))).drop("n")
    return upto.join(F.broadcast(spots.select("bucket", "q", "below", "spot")), "bucket").where("below + upto > spot").groupBy("q").agg(F.min("value").alias("value"))


def pairs_over(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, same): all pairs a < b of cosine `threshold` or more; same: equal groups, null
    if either is null. An id with several rows has the groups of all of them.

    Two blocks meet in one task, which hands its pairs on as it finds them, with their groups: a row is sent
    once for each block, and a pair is not sent at all."""
    plain = as_rows(rows).select("id", "v").where("id is not null")
    n = plain.count()
    blocks = max(1, -(-n // PAIR_ROWS), min(-(-n // BLOCK_ROWS), PAIR_BLOCKS))
    groups = rows.groupBy(F.col("vec_id").alias("id")).agg(F.collect_list(F.struct("grp")).alias("groups"))
    groups = groups.select("id", F.transform("groups", lambda g: g["grp"]).alias("groups"))  # nulls stay
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    sent = plain.join(groups, "id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select((F.least("own", "other") * blocks + F.greatest("own", "other")).alias("task"), (F.col("own") > F.col("other")).alias("second"), "id", "v", "groups")
    dealt = sent.repartition(blocks * (blocks + 1) // 2, "task").sortWithinPartitions("task")

    def meet(batches: Iterator[pa.RecordBatch]):
        task, parts = None, []
        for batch in batches:
            tasks = batch.column("task").to_numpy()
            edges = np.flatnonzero(np.append(True, tasks[1:] != tasks[:-1])) if len(tasks) else []
            for s, e in zip(edges, [*edges[1:], len(tasks)]):
                if tasks[s] != task:
                    yield from _pairs_of(parts, blocks, threshold)
                    task, parts = tasks[s], []
                parts.append(batch.slice(s, e - s))
        yield from _pairs_of(parts, blocks, threshold)

    return dealt.mapInArrow(meet, "a long, b long, similarity double, same boolean")


def _pairs_of(parts: list[pa.RecordBatch], blocks: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of pairs_over that one task's rows have: those of its two blocks, or all of its one."""
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    parts.clear()
    one, two = divmod(table["task"][0].as_py(), blocks)
    ids, second = table["id"].to_numpy(), table["second"].to_numpy()
    groups = table["groups"].combine_chunks()
    many = groups.value_lengths().to_numpy()
    start = np.cumsum(many) - many
    code = groups.flatten().dictionary_encode().indices.fill_null(-1).to_numpy()
    vectors = table["v"].combine_chunks()
    sizes, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    at = np.cumsum(sizes) - sizes
    del table, vectors

    def unit(some: np.ndarray, d: int) -> np.ndarray:
        x = flat[at[some][:, None] + np.arange(d)] if d else np.zeros((len(some), 0))
        length = np.linalg.norm(x, axis=1)
        return x / np.where(length, length, 1)[:, None]

    def found(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        n = many[i] * many[j]
        first, other = start[i], start[j]
        if n.max(initial=1) > 1:
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first, other = np.repeat(first, n) + k // np.repeat(many[j], n), np.repeat(other, n) + k % np.repeat(many[j], n)
            i, j, s = (np.repeat(c, n) for c in (i, j, s))
        same = pa.array(code[first] == code[other], mask=(code[first] < 0) | (code[other] < 0))
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(s), same], names=["a", "b", "similarity", "same"])

    left, right = np.flatnonzero(~second), np.flatnonzero(second if one != two else ~second)
    lengths = np.unique(sizes) if threshold > 0 else None  # what is compared with another length has 0, which counts if that is enough
    for d in lengths if lengths is not None else [None]:
        x, y = (side if d is None else side[sizes[side] == d] for side in (left, right))
        units = None if d is None else unit(y, d)
        for p in range(0, len(x), TILE[0]):
            rows = x[p : p + TILE[0]]
            mine = None if d is None else unit(rows, d)
            for q in range(0, len(y), TILE[1]):
                others = y[q : q + TILE[1]]
                if d is None:
                    s = similarities([flat[at[k] : at[k] + sizes[k]] for k in rows], [flat[at[k] : at[k] + sizes[k]] for k in others])
                else:
                    s = mine @ units[q : q + TILE[1]].T
                ok = s >= threshold
                ok &= ids[rows][:, None] < ids[others][None] if one == two else ids[rows][:, None] != ids[others][None]
                i, j = np.nonzero(ok)
                if len(i):
                    yield found(rows[i], others[j], s[i, j])


def pairs_by_source(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = pairs.select("similarity", "same", steps).where(F.col("similarity") >= F.col("threshold"))
    return rows.groupBy("threshold").agg(
        F.count_if(F.coalesce("same", F.lit(False))).alias("same"), F.count_if(~F.coalesce("same", F.lit(True))).alias("cross"), F.count_if(F.col("same").isNull()).alias("unknown")
    )


def pairs_in_band(pairs: DataFrame, low: float, high: float, k: int = 40) -> DataFrame:
    """The k pairs of the highest similarity in the band, ties by ids, with the number of all. Each task keeps its k, so
    pairs are made once and never sent."""
    band = pairs.where((F.col("similarity") >= low) & (F.col("similarity") <= high))
    row = F.struct("similarity", F.bitwise_not("a").alias("a"), F.bitwise_not("b").alias("b"), "same")
    best = band.agg(InternalFunction.collect_top_k(row, k, False).alias("best"), F.count("*").alias("total"))
    best = best.select(F.explode("best").alias("p"), "total")
    return best.select(F.bitwise_not("p.a").alias("a"), F.bitwise_not("p.b").alias("b"), "p.similarity", "p.same", "total")


def stored_dup_report(rows: DataFrame, thresholds: list[float], since: int) -> DataFrame:
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return rows.select("similarity", "dup_flag", "ord", steps).groupBy("threshold").agg(
        F.count_if("dup_flag").alias("flagged"), F.count_if(F.col("similarity") >= F.col("threshold")).alias("over"),
        F.count_if(F.col("similarity").isNull() & (F.col("ord") >= since)).alias("unjudged"),
    )


def status_counts(cards: DataFrame) -> DataFrame:
    """(status, n) of cards; a null status is one of its own."""
    return cards.groupBy("status").agg(F.count("*").alias("n"))


def cross_recipe_distribution(articles: DataFrame, epoch: str, quantiles: list[float], threshold: float, sample: int = 1000, now: str = K.NOW) -> DataFrame:
    """For each direction of recipes: quantiles of the highest cosine of the newest `sample` articles of
    one with other feeds' earlier ones of the other (-1 where none is), and the share over the
    threshold."""
    rows = in_window(articles, now).where("embedding is not null").withColumn("recipe", recipe(epoch))
    place = F.row_number().over(Window.partitionBy("recipe").orderBy(F.desc("published_at"), "article_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= sample).select(
        F.col("article_id").alias("id"), F.col("feed_id").alias("grp"), F.unix_micros("published_at").cast("double").alias("ord"), F.col("embedding").alias("v"), "recipe"
    )
    out = None
    for a in ("lead", "legacy"):
        for b in ("lead", "legacy"):
            mine, theirs = rows.where(F.col("recipe") == a).drop("recipe"), rows.where(F.col("recipe") == b).drop("recipe")
            best = mine.select("id").join(earlier_maximum(mine, theirs, True), "id", "left").withColumn("best", F.coalesce("best", F.lit(-1.0)))
            share = best.agg(F.avg((F.col("best") >= threshold).cast("int")).alias("share"), F.count("*").alias("n"))
            one = nearest_index_quantiles(best, quantiles).crossJoin(share).withColumn("direction", F.lit(f"{a} to {b}"))
            out = one if out is None else out.union(one)
    return out
