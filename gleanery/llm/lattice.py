"""Near-duplicate embeddings by E8 lattice hashing with multi-probe search."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.arrays import mix
from gleanery.llm.components import connected_components
from gleanery.llm.scratch import materialise, release_memory

#: Random projections to this many tables, each of this many E8 blocks; the lattice's scale in
#: unit vectors' distances; neighbouring cells probed in each block. Chosen for a measured recall
#: over 0.99 at a cosine of 0.98 (see the tests).
TABLES, BLOCKS, SCALE, PROBES = 6, 2, 0.5, 12
SEED = 8


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number
    of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


NEIGHBOURS = _minimal_vectors()


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of the nearest points of D8 (integers of even
    sum: round, and if the sum is odd round the worst entry the other way) and of D8 + 1/2."""

    def nearest_d8(y):
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
        worst = np.abs(y[odd] - r[odd]).argmax(axis=1)
        r[odd, worst] += np.where(y[odd, worst] >= r[odd, worst], 1.0, -1.0)
        return r

    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    whole[nearer] = half[nearer]
    return whole


def _cell_hash(points: np.ndarray) -> np.ndarray:
    """Hash of rows of lattice points (multiples of 1/2)."""
    h = np.zeros(len(points), np.uint64)
    for column in (np.rint(points * 2).astype(np.int64)).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return h


def cells(unit: np.ndarray, table: int, blocks: int, scale: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the own cell of each unit vector, and of the cells to probe (own first): the own
    lattice point in all blocks but one, and there one of the `probes` nearest neighbours."""
    n, d = unit.shape
    basis, _ = np.linalg.qr(np.random.default_rng([SEED, table, d]).normal(size=(max(d, 8 * blocks), 8 * blocks)))
    y = unit @ basis[:d] * (np.sqrt(max(d, 8 * blocks) / (8 * blocks)) / scale)
    y = y * np.sqrt(blocks)
    points, hashes, near = [], [], []
    for b in range(blocks):
        block = y[:, 8 * b : 8 * b + 8]
        p = nearest_e8(block)
        closeness = (block - p) @ NEIGHBOURS.T
        best = np.argpartition(-closeness, probes - 1, axis=1)[:, :probes] if probes else np.zeros((n, 0), int)
        points.append(p)
        hashes.append(_cell_hash(p))
        near.append(best)

    def joint(parts):
        h = np.full(len(parts[0]), np.uint64(table + 1))
        for part in parts:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + part)
        return h

    own = joint(hashes)
    out = [own]
    for b in range(blocks):
        for k in range(probes):
            moved = _cell_hash(points[b] + NEIGHBOURS[near[b][:, k]])
            out.append(joint([moved if c == b else hashes[c] for c in range(blocks)]))
    return own, np.stack(out, axis=1)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, blocks: int = BLOCKS,
    scale: float = SCALE, probes: int = PROBES,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label).

    Rows with equal labels link at a cosine of `threshold` or more in double precision; null
    labels, and vectors that are null, empty, zero or hold null or non-finite entries link with
    nothing, nor do vectors of different lengths. Equal vectors of a label are one class: copies
    link with each other without being paired. n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable, kept marks the row that bears it. A null vec_id
    counts as a row but is never a component's id, unless nothing else is there (null).

    All rows are indexed, and all are queries: each class is hashed to one cell per table and
    probes its own and neighbouring cells; classes that meet are compared exactly. Candidates are
    narrow rows until they are distinct.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label")
    )
    fine = F.col("label").isNotNull() & (F.size("v") > 0) & F.expr(
        "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )
    rows = materialise(rows.withColumn("class", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "v"))).withColumn(
        "class2", F.when(F.col("class").isNotNull(), F.hash("v", "label"))
    ))
    classes = materialise(
        rows.where("class is not null").groupBy("class", "class2").agg(
            F.first("v").alias("v"), F.first("label").cast("string").alias("label"), F.count("*").alias("n"), F.min("vec_id").alias("first")
        )
    )

    def units(batch):
        v = batch.column("v")
        flat, sizes = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == d)
            x = flat[(starts[which][:, None] + np.arange(d))]
            x = x / np.abs(x).max(axis=1, keepdims=True)
            yield d, which, x / np.linalg.norm(x, axis=1, keepdims=True)

    def to_cells(batches):
        for batch in batches:
            ids, salt = batch.column("class").to_numpy(), batch.column("label_hash").to_numpy().astype(np.uint64)
            for d, which, unit in units(batch):
                for table in range(tables):
                    own, probed = cells(unit, table, blocks, scale, probes)
                    mark = mix(salt[which] + np.uint64(d))
                    own, probed = own ^ mark, probed ^ mark[:, None]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([np.repeat(ids[which], probed.shape[1]), ids[which]])),
                        pa.array(np.concatenate([probed.ravel(), own]).astype(np.int64)),
                        pa.array(np.concatenate([np.ones(probed.size, bool), np.zeros(len(own), bool)])),
                    ], names=["class", "cell", "probe"])

    hashed = classes.select("class", F.xxhash64("label").alias("label_hash"), "v").mapInArrow(to_cells, "class long, cell long, probe boolean")
    hashed = materialise(hashed)
    index = hashed.where("not probe").select("cell", F.col("class").alias("b"))
    asked = hashed.where("probe").select("cell", F.col("class").alias("a"))
    met = asked.join(index, "cell").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def compare(batches):
        for batch in batches:
            va, vb = batch.column("va"), batch.column("vb")
            sizes, other = (np.diff(v.offsets.to_numpy()) for v in (va, vb))
            x, y = (v.flatten().to_numpy(zero_copy_only=False) for v in (va, vb))
            starts, other_starts = np.cumsum(sizes) - sizes, np.cumsum(other) - other
            cosine = np.full(len(sizes), -1.0)
            for d in np.unique(sizes[sizes == other]).tolist():
                which = np.flatnonzero((sizes == d) & (other == d))
                p, q = x[starts[which][:, None] + np.arange(d)], y[other_starts[which][:, None] + np.arange(d)]
                p, q = (m / np.abs(m).max(axis=1, keepdims=True) for m in (p, q))
                cosine[which] = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(cosine >= threshold)))
        release_memory()

    known = classes.select("class", "v", "label")
    pairs = met.join(known.select(F.col("class").alias("a"), F.col("v").alias("va"), F.col("label").alias("la")), "a")
    pairs = pairs.join(known.select(F.col("class").alias("b"), F.col("v").alias("vb"), F.col("label").alias("lb")), "b").where("la = lb")
    links = materialise(pairs.select("a", "b", "va", "vb").mapInArrow(compare, "a long, b long"))
    sizes = classes.groupBy("class").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    both = links.union(links.select("b", "a")).toDF("class", "other")
    linked = both.join(sizes.select(F.col("class").alias("other"), "n"), "other").groupBy("class").agg(F.sum("n").alias("linked"))
    parts = connected_components(links).withColumnRenamed("node", "class")
    placed = sizes.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = placed.join(ids, "component").join(linked, "class", "left").select(
        "class", "component_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    out = rows.join(per_class, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) r USING (vec_id)
"""
