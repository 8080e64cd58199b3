"""Repeated byte strings by ranks that double: sampled positions are ranked by what follows them, ranks
that one document alone has drop out, and what is left is ranked again by pairs that reach further,
until the pairs span the whole length.

Plain prefix doubling ranks every position in every round: 24 bytes and more a byte of text and round.
Here the positions are those that content chooses: of the starts of the `width` bytes (a quarter of
`length`) in each string of `length` bytes, the one of the least hash. Equal strings choose alike, so
only strings whose sample is shared can be repeated, and a sample stands for some 40 strings. The
rounds rank

1. samples by their `width` bytes: those of one document alone drop out;
2. blocks of BLOCK strings of one sample by pairs (sample, what all of them share) and (that, what they
   span together): pairs reach over length - BLOCK + 1 and length + BLOCK - 1 bytes. A block that an
   earlier document has is repeated as a whole, one that shares nothing drops out;
3. every string of the blocks that are left by pairs (sample, the string).

Ranks are 64-bit hashes of content under the rank of the round before, so equal ranks need no numbering.
A rank's first document is a partially aggregated minimum; no task holds a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.arrays import _BYTE_VALUES, _MULT, _MULT_INV, in_slices, mix, powers, text_chunks
from gleanery.llm.scratch import discard, finish, materialise, numbered, release_memory

LENGTH = 100
#: Most strings of a block, and positions sampled at once.
BLOCK, SEGMENT = 19, 1 << 16
_GEAR = np.random.default_rng(20240131).integers(0, 2**32, 256, dtype=np.uint32)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """32-bit hashes of the `width` bytes from every place, rolled by doubling: what is hashed of two
    halves, which may overlap."""
    h, have, factor = _GEAR[data], 1, 0x9E3779B1
    while have < width:
        step = min(have, width - have)
        h = h[:-step] * np.uint32(factor) + (h[step:] ^ (h[step:] >> np.uint32(15)))
        have, factor = have + step, (factor * factor + 2 * step) % 2**32 | 1
    return h


class Names:
    """64-bit hashes of slices of bytes."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * powers(_MULT, len(data)), out=self.prefix[1:])
        self.inverse = powers(_MULT_INV, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


class Samples:
    """The samples of some texts: of each its text, place, first and last string, and rank. Strings of
    one sample follow each other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.length, self.width, self.block = length, max(1, length // 4), max(1, min(BLOCK, length // 5))
        none = np.zeros(0, np.int64)
        self.text, self.at, self.low, self.high, self.rank = none, none, none, none, none.astype(np.uint64)
        self.names = Names(data)
        if not (np.diff(offsets) >= length).any():
            return
        grams, window = gram_hashes(data, self.width).astype(np.uint64) << np.uint64(32), length - self.width + 1
        count = len(data) - length + 1
        starts, places = [], []
        for first in range(0, count, SEGMENT):
            part = grams[first : first + SEGMENT + window - 1]
            least, span = part | np.arange(len(part), dtype=np.uint64), 1
            while 2 * span <= window:
                least, span = np.minimum(least[:-span], least[span:]), 2 * span
            if span < window:
                least = np.minimum(least[: len(part) - window + 1], least[window - span :])
            fresh = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
            starts.append(fresh + first)
            places.append((least[fresh] & np.uint64(0xFFFFFFFF)).astype(np.int64) + first)
        low, at = np.concatenate(starts), np.concatenate(places)
        high = np.append(low[1:], count) - 1
        again = np.flatnonzero(at[1:] == at[:-1]) + 1  # where segments meet
        low, at, high[again - 1] = np.delete(low, again), np.delete(at, again), high[again]
        high = np.delete(high, again)
        # strings that reach into the next text are none
        text = np.searchsorted(offsets, at, side="right") - 1
        low, high = np.maximum(low, offsets[text]), np.minimum(high, offsets[text + 1] - length)
        own = low <= high
        self.text, self.at, self.low, self.high = text[own], at[own], low[own], high[own]
        self.rank = self.names.of(self.at, self.at + self.width)

    def take(self, which: np.ndarray) -> None:
        self.text, self.at, self.low, self.high, self.rank = self.text[which], self.at[which], self.low[which], self.high[which], self.rank[which]

    def blocks(self):
        """For each block of strings: its sample, first and last string, and the ranks of what all of
        its strings share and of what they span."""
        near, far = (self.at - self.high) // self.block, (self.at - self.low) // self.block
        which = np.repeat(np.arange(len(near)), far - near + 1)
        number = np.arange(len(which)) - np.repeat(np.cumsum(far - near + 1) - (far - near + 1), far - near + 1) + near[which]
        last = self.at[which] - number * self.block
        low, high = np.maximum(self.low[which], last - self.block + 1), np.minimum(self.high[which], last)
        shared = self.names.of(last, last - self.block + 1 + self.length)
        return which, low, high, shared, self.names.of(low, high + self.length)

    def strings(self, which: np.ndarray, low: np.ndarray, high: np.ndarray):
        """For each string from low to high of the samples: its sample, start and rank."""
        n = high - low + 1
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.repeat(which, n), start, self.names.of(start, start + self.length)


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """The first of each group of rows that agree in all keys."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for key in keys:
        same &= key[order[1:]] == key[order[:-1]]
    return np.sort(order[np.concatenate([[True], ~same])]) if len(order) else order


def _listed(text: np.ndarray, rank: np.ndarray, column: pa.ListArray) -> np.ndarray:
    """Whether each rank is in the list of its text."""
    column = column if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column.cast(pa.list_(pa.int64()))
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(column)), sizes)
    keys = lambda t, r: mix(r + mix(t.astype(np.uint64) + np.uint64(1)))
    known = np.sort(keys(owner, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
    if not len(known) or not len(rank):
        return np.zeros(len(rank), bool)
    asked = keys(text, rank)
    return known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked


def _ranker(length: int, rows: Callable, text: str) -> Callable:
    """A mapInArrow function that gives what `rows` makes of each chunk's samples: columns of ranks, the
    last of them the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, text):
            *ranks, owner = rows(Samples(data, offsets, length), batch)
            place = batch.column("place").to_numpy()
            columns = [pa.array(r.view(np.int64)) for r in ranks] + [pa.array(place[owner])]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"r{k}" for k in range(len(ranks))), "place"])
        release_memory()

    return in_slices(run)


def _samples(samples: Samples, batch: pa.RecordBatch):
    keep = _distinct(samples.text, samples.rank)
    return samples.rank[keep], samples.text[keep]


def _blocks(samples: Samples, batch: pa.RecordBatch):
    samples.take(_listed(samples.text, samples.rank, batch.column("alive")))
    which, _, _, shared, spanned = samples.blocks()
    rank, text = samples.rank[which], samples.text[which]
    shared = mix(rank + mix(shared))
    keep = _distinct(text, shared, spanned)
    return shared[keep], spanned[keep], text[keep]


def _strings(samples: Samples, batch: pa.RecordBatch):
    which, low, high, shared, spanned = samples.blocks()
    open_ = _listed(samples.text[which], spanned, batch.column("open"))
    which, _, name = samples.strings(which[open_], low[open_], high[open_])
    name, text = mix(samples.rank[which] + mix(name)), samples.text[which]
    keep = _distinct(text, name)
    return name[keep], text[keep]


def _repeated(samples: Samples, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of runs of strings that are there earlier."""
    which, low, high, _, spanned = samples.blocks()
    whole = _listed(samples.text[which], spanned, batch.column("seen"))
    asked = ~whole & _listed(samples.text[which], spanned, batch.column("open"))
    of, start, name = samples.strings(which[asked], low[asked], high[asked])
    start = start[_listed(samples.text[of], mix(samples.rank[of] + mix(name)), batch.column("late"))]
    # what a text itself has before: strings of samples that it has more than once
    order = np.lexsort((samples.rank, samples.text))
    alike = np.flatnonzero((samples.rank[order[1:]] == samples.rank[order[:-1]]) & (samples.text[order[1:]] == samples.text[order[:-1]]))
    again = np.union1d(order[alike], order[alike + 1])
    own, own_start, own_name = samples.strings(again, samples.low[again], samples.high[again])
    late = np.ones(len(own), bool)
    late[_distinct(samples.text[own], own_name)] = False  # starts ascend within a text, so the first one is the earliest
    return np.concatenate([low[whole], start, own_start[late]]), np.concatenate([high[whole], start, own_start[late]])


def _cut(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """For each text its removed [start, end) in bytes from its own start, and what is left."""
    n, raw = len(offsets) - 1, data.tobytes()
    order = np.argsort(first, kind="stable")
    first, end = first[order], last[order] + length
    text = np.searchsorted(offsets, first, side="right") - 1
    reach = np.maximum.accumulate(end) if len(end) else end
    head = np.flatnonzero(np.append(True, (first[1:] > reach[:-1]) | (text[1:] != text[:-1]))) if len(first) else first
    begin, stop, owner = first[head], reach[np.append(head[1:], len(first)) - 1] if len(first) else first, text[head]
    spans: list[list[list[int]]] = [[] for _ in range(n)]
    kept: list[list[bytes]] = [[] for _ in range(n)]
    bounds = offsets.tolist()
    here = list(bounds[:-1])
    for t, s, e in zip(owner.tolist(), begin.tolist(), stop.tolist()):
        spans[t].append([s - bounds[t], e - bounds[t]])
        kept[t].append(raw[here[t] : s])
        here[t] = e
    for t in range(n):
        kept[t].append(raw[here[t] : bounds[t + 1]])
    return spans, [b"".join(k) for k in kept]


def _lists(rows: DataFrame, name: str, rank: str) -> DataFrame:
    """The ranks of each place in one list, which its text bounds."""
    return rows.groupBy("place").agg(F.collect_list(rank).alias(name))


def _earlier(rows: DataFrame, *ranks: str) -> tuple[DataFrame, DataFrame]:
    """Each combination of ranks with its first place and number of places; the rows whose place is later."""
    first = rows.groupBy(*ranks).agg(F.min("place").alias("first"), F.count("*").alias("places"))
    return first, rows.join(first.where("places > 1"), list(ranks)).where("place > first")


def mark_repeats(docs: DataFrame, id_column: str, text_column: str, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """See remove_repeats; also the tables it reads, which can go once its rows are written."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in docs.columns if c not in ("kept", "spans")]
    plain = numbered(docs.select([F.col(f"`{c}`") for c in names]))
    key, text = (plain.columns[names.index(c)] for c in (id_column, text_column))
    # places in order of ids, then of texts: partitions are ranges, so their row numbers ascend
    ordered = plain.withColumn("tie", F.xxhash64(text)).repartitionByRange(key, "tie").sortWithinPartitions(key, "tie").drop("tie")
    table = materialise(ordered.withColumn("place", F.monotonically_increasing_id()))
    texts = table.select("place", text)

    samples = texts.mapInArrow(_ranker(length, _samples, text), "r0 long, place long")
    shared = samples.groupBy("r0").agg(F.count("*").alias("places")).where("places > 1").select("r0")
    alive = materialise(_lists(samples.join(shared, "r0"), "alive", "r0"))

    every = materialise(texts.join(alive, "place").mapInArrow(_ranker(length, _blocks, text), "r0 long, r1 long, place long"))
    discard(alive)
    shared = every.groupBy("r0").agg(F.count("*").alias("places")).where("places > 1").select("r0")
    blocks = materialise(every.join(shared, "r0"))
    discard(every)
    first, later = _earlier(blocks, "r0", "r1")
    # what blocks share but not what they span: their strings are to be told apart
    several = first.groupBy("r0").agg(F.count("*").alias("spans")).where("spans > 1").select("r0")
    open_ = first.join(several, "r0").select(F.col("first").alias("place"), "r1")
    seen = materialise(
        later.select("place", "r1", F.lit(True).alias("later")).union(open_.select("place", "r1", F.lit(False)))
        .groupBy("place").agg(F.collect_list(F.when(F.col("later"), F.col("r1"))).alias("seen"), F.collect_list(F.when(~F.col("later"), F.col("r1"))).alias("open"))
    )
    discard(blocks)
    asked = texts.join(seen.where("size(open) > 0").select("place", "open"), "place")
    strings = materialise(asked.mapInArrow(_ranker(length, _strings, text), "r0 long, place long"))
    late = materialise(_lists(_earlier(strings, "r0")[1], "late", "r0"))
    discard(strings)

    rest = [f for f in table.schema.fields if f.name not in (text, "place")]
    schema = T.StructType([*rest, T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, text):
            spans, kept = _cut(data, offsets, *_repeated(Samples(data, offsets, length), batch), length)
            new = {"kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
            yield pa.RecordBatch.from_arrays([(new[f.name] if f.name in new else batch.column(f.name)).cast(f.type) for f in arrow], schema=arrow)
        release_memory()

    none = F.array().cast("array<long>")
    full = table.join(seen, "place", "left").join(late, "place", "left")
    full = full.withColumns({c: F.coalesce(c, none) for c in ("seen", "open", "late")})
    return full.mapInArrow(run, schema).toDF(*(c for c in names if c != text_column), "kept", "spans"), [table, seen, late]


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents without the bytes that a string of `length` bytes covers which also starts earlier:
    in a document of smaller id, or before in the same one. Strings are judged on the input, lie in one
    document, and may overlap.

    The text gives way to `kept` (binary: a cut may fall into a character) and `spans`, the removed runs
    as [first byte, end) from the start of the text; columns of these names are replaced, others stay,
    whatever their names. Rows of one id are documents in the order of a hash of their texts, equal
    rows in any order; null ids come before all others. Null and empty texts, and those shorter than
    `length`, lose nothing. An empty table stays empty.
    """
    out, tables = mark_repeats(docs, id_column, text_column, length)
    return finish(out, tables)


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, tables = mark_repeats(docs, "doc_id", "text", LENGTH)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return finish(out.select(
        "doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    ), tables)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), s AS (
  SELECT doc_id, i, array_slice(b, i + 1, i + 100) AS w FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM s) WHERE k > 1
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS z
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM late))
  GROUP BY doc_id, g
), pieces AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs
  UNION ALL SELECT doc_id, coalesce(max(z), 0), any_value(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, coalesce(string_agg(hex(array_slice(b, s + 1, e)), '' ORDER BY s), '') AS h FROM pieces JOIN d USING (doc_id) WHERE e > s GROUP BY doc_id
), total AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""
