"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.scratch import materialise

#: Rows of a local permutation: of a part before the exchange, and of a bucket after it.
PART_ROWS = 50_000
#: Most numbers of the communication matrix, which is broadcast (16 parts there are at least).
MATRIX_CELLS = 1 << 20
#: Numpy draws from fewer items than this.
_LIMIT = 10**9


def _log_factorial_step(a: float, x: float) -> float:
    """log((a + x)! / a!), without the loss of digits that two large logarithms have."""
    if min(a, a + x) < 1000:
        return math.lgamma(a + x + 1) - math.lgamma(a + 1)
    series = lambda n: 1 / (12 * n) - 1 / (360 * n**3)
    return (a + 0.5) * math.log1p(x / a) + x * math.log(a + x) - x + series(a + x) - series(a)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items are good. Beyond numpy's limit by rejection from a flat middle with
    exponential tails, which cover every log-concave law around its mode (Devroye)."""
    total = good + bad
    if not good or not draws:
        return 0
    if good < _LIMIT and bad < _LIMIT and total < _LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    variance = draws / total * good * (bad / total) * ((total - draws) / max(total - 1, 1))
    p = 0.9 / (math.sqrt(2 * math.pi * variance) + 1)  # less than the chance of the mode: a wider cover
    w = 1 + p / 2
    while True:
        u, v, chance = rng.random(3)
        y = v * w / p if u <= w / (1 + w) else (w + rng.exponential()) / p
        x = (1 if rng.random() < 0.5 else -1) * int(y + 0.5)
        k = mode + x
        if not low <= k <= high:
            continue
        ratio = -(
            _log_factorial_step(mode, x) + _log_factorial_step(good - mode, -x) + _log_factorial_step(draws - mode, -x)
            + _log_factorial_step(bad - draws + mode, x)
        )
        if math.log(max(chance, 1e-300)) + min(0.0, w - p * y) <= ratio:
            return k


def _split(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of n items drawn from those of all shards are of each."""
    if room.sum() < _LIMIT:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out, left = np.zeros_like(room), int(room.sum())
    for k, size in enumerate(room.tolist()):
        left -= size
        out[k] = hypergeometric(rng, size, left, n)
        n -= int(out[k])
    return out


def communication_matrix(part_sizes: np.ndarray, shard_sizes: np.ndarray, seed: int) -> np.ndarray:
    """How many rows each part sends to each shard, for a uniform random permutation: a multivariate
    hypergeometric draw of each half of the parts from the room of the shards, down to ranges of
    parts with fewer rows than numpy's limit, where it goes part by part. Row sums are the part
    sizes, column sums the shard sizes, exactly."""
    rng = np.random.default_rng(seed)
    part_sizes = np.asarray(part_sizes, np.int64)
    out = np.zeros((len(part_sizes), len(shard_sizes)), np.int64)
    waiting = [(0, len(part_sizes), shard_sizes.astype(np.int64).copy())]
    while waiting:
        first, last, room = waiting.pop()
        if last - first == 1:
            out[first] = room
        elif room.sum() < _LIMIT:
            for p in range(first, last):
                out[p] = rng.multivariate_hypergeometric(room, part_sizes[p], method="marginals")
                room -= out[p]
        else:
            middle = (first + last) // 2
            left = _split(rng, room, int(part_sizes[first:middle].sum()))
            waiting += [(first, middle, left), (middle, last, room - left)]
    return out


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows with `shard` and `slot`: shard sizes differ by at most one, slots of a shard are
    gapless from 0, and up to the quality of the hash every assignment is equally likely.

    1. Rows are numbered, dealt to parts by a hash of the whole row and its number, and written to
       the shared folder: a task that runs again finds the same rows, and equal rows part. One
       count per part goes to the driver, which draws the communication matrix. Parts are of
       `part_rows`, or more where the matrix would have over MATRIX_CELLS numbers.
    2. Each part is permuted locally (ranked by a second hash) and its ranks cut by its row of
       the matrix into shards.
    3. Rows are exchanged to their shards, there dealt to buckets by a third hash, and permuted
       again by that hash; a bucket's slots start after those of the buckets before it. So no task
       holds a whole shard, whatever its size.

    Existing columns named shard or slot are replaced; all others stay, whatever their names. An
    empty table stays empty.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    names = [f"c{i}" for i in range(len(columns))]
    row = df.select([F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)])
    plain = [F.to_json(F.struct(n)) if t.startswith("map") else F.col(n) for n, t in row.dtypes]
    row = materialise(row.withColumn("h", F.xxhash64(F.lit(seed), *plain, F.monotonically_increasing_id())))
    total = row.count()
    parts = max(16, min(-(-total // part_rows), MATRIX_CELLS // n_shards))
    row = row.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    sizes = np.zeros(parts, np.int64)
    for r in row.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    shards = np.full(n_shards, total // n_shards, np.int64)
    shards[: total % n_shards] += 1
    bounds = np.cumsum(communication_matrix(sizes, shards, seed), axis=1)
    matrix = spark.createDataFrame([(p, b) for p, b in enumerate(bounds.tolist())], "part int, bounds array<long>")
    first = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("h", F.lit(seed + 1)), "h")) - 1
    sent = row.withColumn("rank", first).join(F.broadcast(matrix), "part")
    sent = sent.withColumn("shard", F.expr("size(filter(bounds, b -> b <= rank))"))
    buckets = max(16, -(-int(shards[0]) // part_rows))
    key = F.xxhash64("h", F.lit(seed + 2))
    sent = sent.select(*names, "shard", "h", key.alias("key"), F.pmod(F.shiftright(key, 20), F.lit(buckets)).alias("bucket"))
    offsets = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "h")) - 1
    placed = sent.withColumn("rank", rank).join(offsets, ["shard", "bucket"])
    return placed.select(
        *[F.col(n).alias(c) for n, c in zip(names, columns)], "shard", (F.col("before") + F.col("rank")).alias("slot")
    )


N_SHARDS, SEED = 16, 20240131


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    shuffled = shuffle_into_shards(narrow, N_SHARDS, SEED)
    return shuffled.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
