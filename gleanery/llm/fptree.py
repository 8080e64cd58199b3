"""Ranked lexical search over document FP-trees.

The terms of the searched items are a vocabulary. Each document's vector of these terms, most frequent
first, is a path; tasks lay the paths of some thousand documents into a trie, in which equal beginnings are
shared. Each of its leaves (a run of neighbouring subtrees with at most LEAF documents) keeps the
largest tf of each of its terms and the smallest m, which bound the score of all documents below; an
inner node's bound is the largest below it. Per item the trie is searched depth first, best child
first, and subtrees that can't reach the tenth document found so far are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.arrays import PLAIN_WORDS, find_words, lower, slice_hashes, text_chunks
from gleanery.llm.scratch import discard, finish, materialise, release_memory

TOP = 10
#: Most terms of the items of one pass, repeats in other items counted (they are broadcast).
SET_TERMS = 500_000
#: Documents of a leaf (with 64, a search looks into a third of them), levels of a trie, and where a trie ends: documents or terms of documents.
LEAF, LEVELS, TREE_ROWS, TREE_TERMS = 64, 32, 20_000, 2_000_000


def _terms(text: str | None) -> np.ndarray:
    """Hashes of the terms of a text: A-Z lowered, runs of letters, digits and non-ASCII bytes."""
    data = lower(np.frombuffer((text or "").encode(), np.uint8))
    if not len(data):
        return np.zeros(0, np.uint64)
    starts, ends, _ = find_words(data, np.array([0, len(data)]), PLAIN_WORDS)
    return np.unique(slice_hashes(data, starts, ends))


class ItemSet:
    """Some items with their terms as numbers in the order of their hashes."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.names = [name for name, _ in items]
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(terms for _, terms in items)]))
        self.terms = [np.searchsorted(self.hashes, terms) for _, terms in items]

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[self.hashes >> np.uint64(44)] = True
        return out


def item_sets(items: DataFrame, item_column: str, text_column: str) -> Iterator[ItemSet]:
    """The items in sets of bounded size. Rows of one item are one item with the terms of all."""
    rows = items.select(F.col(f"`{item_column}`").alias("item"), F.col(f"`{text_column}`").alias("text")).where("item is not null").orderBy("item")
    held: list[tuple[object, np.ndarray]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        terms = _terms(text)
        if held and held[-1][0] == item:
            held[-1] = (item, np.union1d(held[-1][1], terms))
            size += len(terms)
            continue
        if size >= SET_TERMS:
            yield ItemSet(held)
            held, size = [], 0
        held.append((item, terms))
        size += len(terms)
    if held:
        yield ItemSet(held)


def _vectors(batches: Iterator[pa.RecordBatch], items: ItemSet) -> Iterator[pa.RecordBatch]:
    """Of each document its number of terms, and number and tf of those that items have."""
    bitmap, known = items.bitmap(), items.hashes
    for batch, data, offsets in text_chunks(batches):
        data = lower(data)
        starts, ends, first = find_words(data, offsets, PLAIN_WORDS)
        hashes = slice_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        at = np.flatnonzero(bitmap[hashes >> np.uint64(44)])
        number = np.searchsorted(known, hashes[at])
        hit = known[np.minimum(number, max(len(known) - 1, 0))] == hashes[at] if len(known) else np.zeros(0, bool)
        owner = np.searchsorted(first, at[hit], side="right") - 1
        keys, tf = np.unique(owner * max(len(known), 1) + number[hit], return_counts=True)
        bounds = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * max(len(known), 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v, pa.int32())) for v in (keys % max(len(known), 1), tf)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
    release_memory()


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class DocumentTree:
    """The trie of some documents, in arrays. `terms` are numbers by frequency."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((terms, owner))
        terms, tfs = terms[order], tfs[order]
        end = int(terms.max(initial=0)) + 1
        paths = np.full((len(sizes), LEVELS), end, np.int32)
        level = np.arange(len(terms)) - np.repeat(bounds[:-1] - bounds[0], sizes)
        shallow = level < LEVELS
        paths[owner[shallow], level[shallow]] = terms[shallow]
        order = np.lexsort((ids, *paths.T[::-1]))
        starts = (bounds[:-1] - bounds[0])[order]
        sizes = sizes[order]
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(len(terms)) + np.repeat(starts - self.bounds[:-1], sizes)
        self.ids, self.m, self.terms, self.tfs, self.width = ids[order], m[order], terms[at], tfs[at], end
        self._lay(paths[order])
        self._summarise()

    def _lay(self, paths: np.ndarray) -> None:
        """Leaves as runs of documents; inner nodes as (first leaf, end leaf, children), where a child
        is an inner node, or a leaf as -1 - its number."""
        leaves: list[int] = []  # first document of each
        nodes: list[list] = []

        def build(low: int, high: int, level: int) -> int:
            number = len(nodes)
            nodes.append([len(leaves), 0, []])
            cut = np.flatnonzero(np.diff(paths[low:high, level])) + 1 if level < LEVELS else np.arange(LEAF, high - low, LEAF)
            edges = [low, *(cut + low).tolist(), high]
            run = low
            for s, e in zip(edges[:-1], edges[1:]):
                large = e - s > LEAF
                if run < s and (large or e - run > LEAF):
                    leaves.append(run)
                    nodes[number][2].append(-len(leaves))
                    run = s
                if large:
                    nodes[number][2].append(build(s, e, level + 1))
                    run = e
            if run < high:
                leaves.append(run)
                nodes[number][2].append(-len(leaves))
            nodes[number][1] = len(leaves)
            return number

        build(0, len(paths), 0)
        self.leaves = np.array([*leaves, len(paths)])
        self.nodes = nodes

    def _summarise(self) -> None:
        """Of each leaf the largest tf of each term, by term; the smallest m and id."""
        leaf = np.repeat(np.arange(len(self.leaves) - 1), np.diff(self.bounds[self.leaves]))
        keys = self.terms.astype(np.int64) * len(self.leaves) + leaf
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.most = np.maximum.reduceat(self.tfs[order], first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        self.of_leaf = keys[first] % len(self.leaves)
        self.first_of = np.searchsorted(keys[first] // len(self.leaves), np.arange(self.width + 1))
        self.least_m = np.minimum.reduceat(self.m, self.leaves[:-1])
        self.least_id = np.minimum.reduceat(self.ids, self.leaves[:-1])

    def leaf_bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        terms, weights = terms[terms < self.width], weights[terms < self.width]
        low, n = self.first_of[terms], self.first_of[terms + 1] - self.first_of[terms]
        at = np.arange(int(n.sum())) + np.repeat(low - np.cumsum(n) + n, n)
        leaf = self.of_leaf[at]
        gain = np.repeat(weights, n) * saturation(self.most[at], self.least_m[leaf])
        return np.bincount(leaf, gain, len(self.leaves) - 1).astype(np.int64)  # far below 2**53

    def search(self, terms: np.ndarray, weights: np.ndarray, of_term: np.ndarray, top: int) -> tuple[list[tuple[int, int]], int]:
        """The best (score, id), and how many leaves were looked into. of_term: zeros, one a term."""
        if not len(self.ids):
            return [], 0
        bound = self.leaf_bounds(terms, weights)
        edges = np.array([[n[0], n[1]] for n in self.nodes]).ravel()
        of_node = np.maximum.reduceat(np.append(bound, 0), edges)[::2].tolist()
        of_leaf, least_id = bound.tolist(), self.least_id.tolist()
        of_term[terms] = weights
        best: list[tuple[int, int]] = []
        looked, waiting = 0, [0]
        while waiting:
            node = waiting.pop()
            most = of_node[node] if node >= 0 else of_leaf[-1 - node]
            if most <= 0 or (len(best) == top and (most < -best[-1][0] or (node < 0 and most == -best[-1][0] and least_id[-1 - node] > best[-1][1]))):
                continue
            if node >= 0:
                waiting += sorted(self.nodes[node][2], key=lambda c: of_node[c] if c >= 0 else of_leaf[-1 - c])
                continue
            looked += 1
            low, high = self.leaves[-1 - node], self.leaves[-node]
            here = slice(self.bounds[low], self.bounds[high])
            at = np.flatnonzero(of_term[self.terms[here]]) + here.start
            owner = np.searchsorted(self.bounds[low : high + 1], at, side="right") - 1
            gain = of_term[self.terms[at]] * saturation(self.tfs[at].astype(np.int64), self.m[low + owner])
            score = np.bincount(owner, gain, high - low).astype(np.int64)
            least = -best[-1][0] if len(best) == top else 1
            found = np.flatnonzero(score >= max(least, 1))
            if len(found):
                best = sorted([*best, *zip((-score[found]).tolist(), self.ids[low + found].tolist())])[:top]
        of_term[terms] = 0
        return [(-s, i) for s, i in best], looked


#: Stands for a null id, after all others.
_NO_ID = np.iinfo(np.int64).max


def norms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms, without an overflow."""
    if 90 * int(n.max(initial=0)) * documents < 2**63:
        return 10 + (90 * n * documents) // max(total, 1)
    return np.array([10 + (90 * x * documents) // total for x in n.tolist()], np.int64)


def _search(batches: Iterator[pa.RecordBatch], items: ItemSet, by_frequency: np.ndarray, weights: np.ndarray, documents: int, total: int, top: int):
    """Searches each tree that the rows fill for all items. by_frequency and weights are by term number."""
    held: list[pa.RecordBatch] = []
    of_term = np.zeros(len(by_frequency) + 1, np.int64)

    def results():
        table = pa.Table.from_batches(held).combine_chunks()
        lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
        bounds = np.asarray(lists[0].offsets).astype(np.int64)
        terms, tfs = (x.flatten().to_numpy() for x in lists)
        ids = table.column("doc_id").fill_null(_NO_ID).to_numpy()
        tree = DocumentTree(ids, norms(table.column("n").to_numpy(), documents, total), bounds - bounds[0], by_frequency[terms], tfs)
        rows = []
        for k, own in enumerate(items.terms):
            worth = own[weights[own] > 0]
            found, _ = tree.search(by_frequency[worth], weights[worth], of_term, top)
            rows += [(k, i, s) for s, i in found]
        item, doc, score = zip(*rows) if rows else ((),) * 3
        doc = pa.array([None if d == _NO_ID else d for d in doc], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), doc, pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    size = rows_held = 0
    for batch in batches:
        for first in range(0, batch.num_rows, TREE_ROWS // 4):
            part = batch.slice(first, TREE_ROWS // 4)
            held.append(part)
            size, rows_held = size + len(part.column("terms").flatten()), rows_held + part.num_rows
            if size >= TREE_TERMS or rows_held >= TREE_ROWS:
                yield results()
                held, size, rows_held = [], 0, 0
    if held:
        yield results()
    held = []
    release_memory()


def rank_documents(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", top: int = TOP,
) -> DataFrame:
    """For each item its `top` highest-scoring documents: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and non-ASCII bytes, A-Z lowered. A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), a document's m 10 + 90 n N div L, a score the sum over the
    item's distinct terms of weight * (10^9 tf div (1000 tf + 8 m)); N documents have terms, L in all, n
    in one. Only scores above 0 are results; equal scores go by ascending id, null ids last.

    Null and empty texts have no terms. Items without terms or id have no results; rows of one item id
    are one item. Rows of one doc_id are documents of their own. Without documents or items there are
    no rows. Other columns are not read, whatever their names.

    One pass over the texts writes vectors of the items' terms; one over the vectors counts, one builds
    trees of bounded size and searches each for all items. Trees give `top` rows an item at most. Items
    are taken in sets of at most SET_TERMS terms; each is a pass of its own.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    kind = items.schema[item_column].dataType.simpleString()
    out, tables = None, []
    for chosen in item_sets(items, item_column, item_text):
        shared = spark.sparkContext.broadcast(chosen)
        vectors = materialise(narrow.mapInArrow(lambda it, s=shared: _vectors(it, s.value), "doc_id long, n long, terms array<int>, tfs array<int>"))
        total, documents = vectors.where("n > 0").agg(F.sum("n"), F.count("*")).first()
        df = np.zeros(len(chosen.hashes), np.int64)
        for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[term] = n
        by_frequency = np.empty(len(df), np.int32)
        by_frequency[np.lexsort((chosen.hashes, -df))] = np.arange(len(df), dtype=np.int32)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        told = spark.sparkContext.broadcast((by_frequency, weights))
        found = vectors.where("size(terms) > 0").mapInArrow(
            lambda it, s=shared, t=told, d=documents, n=total: _search(it, s.value, *t.value, d, n, top), "item int, doc_id long, score long"
        )
        names = spark.createDataFrame(list(enumerate(chosen.names)), f"item int, item_id {kind}")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).join(F.broadcast(names), "item")
        result = materialise(ranked.select("item_id", "rank", "doc_id", "score"))
        discard(vectors)
        shared.unpersist()
        tables.append(result)
        out = result if out is None else out.union(result)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out if len(tables) == 1 else finish(out, tables)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank_documents(docs, items)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
t AS (
  SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY row_id, doc_id, n, term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c WHERE term IN (SELECT term FROM q) GROUP BY term
), s AS (
  SELECT item_id, row_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN weights USING (term) JOIN t USING (term), c GROUP BY item_id, row_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""
