"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.scratch import discard, materialise, release_memory

#: Links a task contracts at once, and links of a file of a round.
CONTRACTED, FILE_LINKS = 500_000, 250_000
#: Links of a node that one task may join, and the most nodes with more that a round can have.
HOT, HOT_NODES = 1000, 100_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars around the smallest node of each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars():
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    n = 0
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
            if a != b:
                parent[max(a, b)] = min(a, b)
        n += batch.num_rows
        if n >= CONTRACTED:
            yield stars()
            parent, n = {}, 0
    if parent:
        yield stars()
    parent = {}
    release_memory()


def _with_minimum(rows: DataFrame, links: int) -> DataFrame:
    """Rows (u, v) with m, the least v of their u. Few u can have many rows: the minima of those with
    over HOT, or a HOT_NODES th of all, are at most 2 * HOT_NODES and are broadcast; the others are
    joined."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = F.col("n") > max(HOT, links // HOT_NODES)
    marked = rows.join(F.broadcast(least.where(hot).select("u", F.col("m").alias("hot"))), "u", "left")
    rest = marked.where("hot is null").drop("hot").join(least.where(~hot).select("u", "m"), "u")
    return rest.select("u", "v", "m").union(marked.where("hot is not null").select("u", "v", F.col("hot").alias("m")))


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of the links (integers); component is the smallest node that
    can be reached. Null ends and self links are ignored; no links give no rows.

    Tasks first contract the links they hold, each as many as it may, which leaves about one for each
    of its nodes. Then "large star" and "small star" steps alternate
    until the links no longer change: each round points every node's neighbours at the smallest
    one, so the depth of the graph shrinks geometrically. Every step is a partially aggregated
    minimum and an equi-join (see _with_minimum), so a node with very many links is spread over
    tasks. Rounds are written to the shared folder, in as many files as their links need.
    """
    ends = links.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
    fine = ends.where("u is not null and v is not null and u <> v")
    edges = materialise(fine.coalesce(max(1, fine.count() // FILE_LINKS)).mapInArrow(_contract, "u long, v long"))
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v"), F.col("v")).distinct()
            )
        before = now
        both = edges.union(edges.select("v", "u"))
        large = _with_minimum(both, now[0]).where("v > u").withColumn("m", F.least("u", "m")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = (
            _with_minimum(large, now[0])
            .select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        last, edges = edges, materialise(small.coalesce(max(8, now[0] // FILE_LINKS)))
        discard(last)
