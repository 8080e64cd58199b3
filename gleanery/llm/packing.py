"""Vector best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.arrays import text_chunks
from gleanery.llm.scratch import materialise, release_memory
from gleanery.llm.tokens import forget_tokenizers, piece_tokenizer

#: Bytes of text tokenised at once: arrays of the work take some fifty times as much.
PIECE_CHUNK = 1 << 18


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. Attention cost is the sum of squared piece lengths (attention within
    documents). The defaults of the last two never bind: 2048 tokens hold at most 2048 pieces, and
    squares of lengths that sum to 2048 sum to at most 2048 squared; so a sequence count as low as
    the tokens allow is sought. Weights apply to residuals as shares of the capacity."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"


def best_fit(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Pack `histogram[length]` pieces of each length, longest first, each into the open sequence
    that fits best under every constraint; a new one is opened only if none can take it.

    "norm" takes the sequence with the least weighted norm of what would be left of its three
    capacities, "dot" the one with the least weighted dot product of the piece's demand and its
    residuals (the tightest in what the piece needs). Sequences in one state are one run of
    numbers and are filled together, so the work depends on the number of lengths and states, not
    of pieces. Returns runs (length, first rank, count, first sequence, offset): pieces of that
    length with ranks [first rank, + count) go to successive sequences at that offset.
    """
    cap = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    used = np.zeros((1024, 3), np.int64)
    low, count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    n_states = opened = 0
    runs: list[tuple[int, int, int, int, int]] = []

    def state(u, first, n):
        nonlocal used, low, count, n_states
        if n_states == len(low):
            live = np.flatnonzero(count[:n_states])
            used[: len(live)], low[: len(live)], count[: len(live)] = used[live], low[live], count[live]
            n_states = len(live)
            count[n_states:] = 0
            if n_states > len(low) // 2:
                used, low, count = (np.concatenate([x, np.zeros_like(x)]) for x in (used, low, count))
        used[n_states], low[n_states], count[n_states] = u, first, n
        n_states += 1

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length])
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens is beyond the capacity")
        while left:
            after = cap - used[:n_states] - need
            fits = (after >= 0).all(axis=1) & (count[:n_states] > 0)
            if fits.any():
                where = np.flatnonzero(fits)
                share = after[where] / cap
                value = ((share * weights) ** 2).sum(axis=1) if capacity.rule == "norm" else ((share + need / cap) * (need / cap) * weights).sum(axis=1)
                g = int(where[np.argmin(value)])
                k = min(left, int(count[g]))
                runs.append((length, rank, k, int(low[g]), int(used[g, 0])))
                first, u = int(low[g]), used[g] + need
                low[g] += k
                count[g] -= k
                state(u, first, k)
                rank, left = rank + k, left - k
            else:
                each = int(min(cap // need))
                for n_new, n_each in ((left // each, each), (1, left % each)):
                    if n_new and n_each:
                        for j in range(n_each):
                            runs.append((length, rank, n_new, opened, j * length))
                            rank += n_new
                        state(need * n_each, opened, n_new)
                        opened += n_new
                left = 0
    return runs


def least_sequences(histogram: dict[int, int], tokens: int) -> int:
    """A lower bound of the sequences that pieces need: for each k, pieces over tokens - k are alone or
    with ones of at most k, those over half of the tokens are each in one of their own, and what the
    rest fills beyond the room beside them needs more (Martello and Toth's bound L2)."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    best = -(-int((lengths * counts).sum()) // tokens)
    for k in [0, *lengths[2 * lengths <= tokens].tolist()]:
        alone = counts[lengths > tokens - k].sum()
        half = (lengths <= tokens - k) & (2 * lengths > tokens)
        small = (2 * lengths <= tokens) & (lengths >= k)
        room = (tokens - lengths[half]) @ counts[half]
        best = max(best, int(alone + counts[half].sum() + max(0, -(-int(lengths[small] @ counts[small] - room) // tokens))))
    return best


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, drops_blanks: bool, longest: int) -> DataFrame:
    """doc_id, piece, start, length and crc32 of the ids of each piece. A document is its ids, then
    end_id (a null or empty text: end_id alone); longer ones are cut every `longest` ids."""

    def cut(batches):
        tokenizer = piece_tokenizer(tokenizer_path, drops_blanks)
        for batch, data, offsets in text_chunks(batches, max_bytes=PIECE_CHUNK):
            ids, bounds = tokenizer.encode(data, offsets)
            ids, sizes = np.insert(ids, bounds[1:], np.uint32(end_id)), np.diff(bounds) + 1
            ends = np.cumsum(sizes)
            n = -(-sizes // longest)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * longest
            length = np.minimum(longest, sizes[row] - start)
            first = (ends - sizes)[row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
            })
        forget_tokenizers()
        del tokenizer
        release_memory()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """The pieces with sequence_id and offset, by vector best-fit decreasing over all of them.

    The driver sees one count per length (at most capacity.tokens of them) and plans runs of
    ranks; the rows are ranked within their length in parallel (each length is dealt into salted
    parts whose sizes are added up) and look their run up in the broadcast plan. Repeated rows
    are pieces of their own. No pieces: no rows.
    """
    spark = pieces.sparkSession
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = best_fit(lengths, capacity)
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, first long, n long, sequence long, at long")
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "at"))).alias("runs"))
    parts = max(256, sum(lengths.values()) // 1_000_000)
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(sizes, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).join(F.broadcast(plan), "length")
    run = F.expr("element_at(runs, size(filter(runs, r -> r.first <= rank)))")
    return ranked.withColumn("run", run).select(
        *pieces.columns, (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"), F.col("run.at").alias("offset"),
    )


#: The end-of-document id of the query.
END_ID = 0


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of the word vocabulary's ids (see token_pieces and
    pack_pieces). The pieces are written to the shared folder, as they are counted, then placed."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    return pack_pieces(materialise(token_pieces(docs, path, END_ID, True, capacity.tokens)), capacity)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
