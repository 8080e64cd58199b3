"""Hierarchical Pitman-Yor language model, seated and scored in Spark tasks.

Restaurants: one per word before a token, whose parent is the restaurant of that word's last byte,
whose parent is the root, over a uniform base of all training tokens and one unknown token. A dish is
a token; tables of a restaurant are customers of its parent. Seating is sampled by Gibbs sweeps, and
predictive probabilities are averaged over samples.

All restaurants' customers of one dish are in one bucket, so tables pass to parents inside a task.
What a dish needs of its restaurants are their totals: every sweep sends each bucket's share of its
contexts to ranges of contexts, which add them up and send them back. So tables of the model grow
with the corpus, and no task or broadcast holds more than a share of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.arrays import BLANK_WORDS, find_words, lower, mix, slice_hashes, text_chunks
from gleanery.llm.scratch import discard, materialise, release_memory

#: Strength of every restaurant; sweeps before the first sample, and samples.
STRENGTH, BURN_IN, SAMPLES = 1.0, 1, 2
#: Up to so many customers of a dish, the number of their tables is drawn from its exact conditional.
EXACT = 256
#: Tokens and documents a task gathers before it sends them to their buckets.
FLUSH_TOKENS, FLUSH_DOCS = 1_500_000, 60_000
#: Bytes of text for each bucket, and rows of postings that one task scores.
BUCKET_BYTES, POSTINGS = 12 << 20, 512

_END = mix(np.array([0xE4D0F], np.uint64))[0]
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    return _PACK.compress(np.ascontiguousarray(x).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_UNPACK.decompress(data), dtype)


def _pack_sorted(x: np.ndarray) -> bytes:
    """Numbers in order, below 2**32, by their steps."""
    return _pack(np.diff(x, prepend=0).astype(np.uint32))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint32), dtype=np.int64)


def _pack_contexts(x: np.ndarray) -> bytes:
    """Contexts of 40 bits in order: the steps of their hashes, then their last bytes."""
    return _PACK.compress(np.diff(x >> 8, prepend=0).astype(np.uint32).tobytes() + (x & 0xFF).astype(np.uint8).tobytes())


def _unpack_contexts(data: bytes) -> np.ndarray:
    raw = _UNPACK.decompress(data)
    n = len(raw) // 5
    return np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64) << 8 | np.frombuffer(raw, np.uint8, n, 4 * n)


def token_stream(data: np.ndarray, offsets: np.ndarray):
    """Token hashes (words, and the end of each text), the context of each (32 bits of the hash of the
    word before it, and its last byte), and its text."""
    data = lower(data)
    starts, ends, first = find_words(data, offsets, BLANK_WORDS)
    hashes = np.insert(slice_hashes(data, starts, ends), first[1:], _END)
    last = np.insert(data[ends - 1] if len(ends) else np.zeros(0, np.uint8), first[1:], 0)
    as_context = (mix(hashes) >> np.uint64(32) << np.uint64(8)).astype(np.int64) | last
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first) + 1)
    before = np.full(len(hashes), int(mix(np.array([_END]))[0] >> np.uint64(32)) << 8)
    before[1:] = as_context[:-1]
    return hashes, before, text


#: Kinds of rows: documents of a flush; a bucket's dishes; what a flush has of a bucket's pairs; tables
#: of a sweep; a bucket's share of a range's contexts; totals of a range's contexts for a bucket.
DOCS, MODEL, POSTING, TABLES, SHARE, TOTAL = range(6)
_ROW = "kind int, bucket int, number long, a binary, b binary, c binary, d binary, e binary, f binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (kind, bucket, number, up to six cells)."""
    columns = list(zip(*((*r, *(b"",) * (9 - len(r))) for r in rows)))
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "bucket", "number", *"abcdef"])


def _gather(batches: Iterator[pa.RecordBatch], buckets: int):
    """What a flush of documents holds for each bucket, and one row of its documents."""
    partition, flush = TaskContext.get().partitionId(), 0
    parts, docs, n = [], [], 0

    def send():
        nonlocal flush
        key = partition << 20 | flush
        flush += 1
        ids = [d for d, _, _ in docs]
        yield _rows([(DOCS, -1, key, _pack(np.array([d or 0 for d in ids], np.int64)), _pack(np.array([d is None for d in ids], bool)),
                      _pack(np.array([h for _, h, _ in docs], bool)), _pack(np.array([t for _, _, t in docs], np.int64)))])
        hashes, contexts, rows, train = (np.concatenate(x) for x in zip(*parts))
        words, which = np.unique(hashes, return_inverse=True)
        every, of = np.unique(contexts, return_inverse=True)
        pair = which << 32 | of
        order = np.argsort(pair, kind="stable")
        pair, rows, train = pair[order], rows[order], train[order]
        fresh = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        occurrences = np.diff(np.append(fresh, len(pair)))
        customers = np.add.reduceat(train.astype(np.int64), fresh)
        word, context = pair[fresh] >> 32, pair[fresh] & 0xFFFFFFFF
        edges = np.searchsorted(words, (np.arange(1, buckets, dtype=np.float64) * 2.0**64 / buckets).astype(np.uint64))
        edges = np.concatenate([[0], edges, [len(words)]])
        pair_edges = np.searchsorted(word, edges)
        post_edges = np.append(fresh, len(pair))[pair_edges]
        out = []
        for b in range(buckets):
            if edges[b] == edges[b + 1]:
                continue
            p, q = slice(pair_edges[b], pair_edges[b + 1]), slice(post_edges[b], post_edges[b + 1])
            mine, local = np.unique(context[p], return_inverse=True)
            out.append((POSTING, b, key, _pack(words[edges[b] : edges[b + 1]]), _pack_sorted(word[p] - edges[b]), _pack_contexts(every[mine]),
                        _pack(np.stack([local, customers[p], occurrences[p]]).astype(np.uint32)), _pack(rows[q].astype(np.uint16))))
            if len(out) == 64:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    for batch, data, offsets in text_chunks(batches):
        for first in range(0, batch.num_rows, FLUSH_DOCS):
            some = slice(first, min(first + FLUSH_DOCS, batch.num_rows))
            if docs and (n >= FLUSH_TOKENS or len(docs) + some.stop - some.start > FLUSH_DOCS):
                yield from send()
                parts, docs, n = [], [], 0
            bounds = offsets[some.start : some.stop + 1]
            hashes, contexts, text = token_stream(data[bounds[0] : bounds[-1]], bounds - bounds[0])
            held = batch.column("held_out").to_numpy(zero_copy_only=False)[some].astype(bool)
            parts.append((hashes, contexts, text + len(docs), ~held[text]))
            n += len(hashes)
            docs += zip(batch.column("doc_id").to_pylist()[some], held.tolist(), np.bincount(text, minlength=len(held)).tolist())
    if docs:
        yield from send()
    parts = docs = None
    release_memory()


def _groups(batches: Iterator[pa.RecordBatch], *keys: str):
    """Lists of rows, as tuples (kind, number, a, ..., f, bucket), of equal keys, with the key."""
    current, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            row = dict(zip(names, values))
            key = tuple(row[k] for k in keys)
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append((row["kind"], row["number"], *(row[c] for c in "abcdef"), row["bucket"]))
    if rows:
        yield current, rows


def _merge(batches: Iterator[pa.RecordBatch]):
    """A row of each bucket's dishes: words (numbered), contexts and customers of its pairs, and its
    contexts; and for each flush which pairs it has, how often, and in which documents. Document
    rows pass through."""
    for (bucket,), rows in _groups(batches, "bucket"):
        if bucket < 0:
            for kind, number, *cells, _ in rows:
                yield _rows([(kind, bucket, number, *cells)])
            continue
        rows.sort(key=lambda r: r[1])
        every = [_unpack(r[2], np.uint64) for r in rows]
        words = np.unique(np.concatenate(every))
        heard = [_unpack_contexts(r[4]) for r in rows]
        contexts = np.unique(np.concatenate(heard))
        keys, customers, seen = [], [], []
        for w, h, r in zip(every, heard, rows):
            local, n, occurrences = _unpack(r[5], np.uint32).reshape(3, -1)
            keys.append(np.searchsorted(words, w)[_unpack_sorted(r[3])] << 32 | np.searchsorted(contexts, h)[local])
            customers.append(n)
            seen.append(occurrences)
        pairs, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate(customers), len(pairs)).astype(np.int64)
        yield _rows([(
            MODEL, bucket, len(words), _pack_sorted(pairs >> 32), _pack((pairs & 0xFFFFFFFF).astype(np.uint32)), _pack(total.astype(np.uint32)),
            _pack((contexts & 0xFF).astype(np.uint8)), _pack_contexts(contexts),
        )])
        at = 0
        for k, r, n in zip(keys, rows, seen):
            yield _rows([(POSTING, bucket, r[1], _pack_sorted(which[at : at + len(k)]), _pack(n), r[6])])
            at += len(k)
    release_memory()


class Totals:
    """Customers and tables of restaurants: of a bucket's contexts (level 2), of all classes and the
    root; the discount of each level; training tokens and their number of kinds."""

    def __init__(self, rows, discounts=None):
        self.customers = [np.zeros(1, np.int64), np.zeros(256, np.int64), np.zeros(0, np.int64)]
        self.tables = [np.zeros(1, np.int64), np.zeros(256, np.int64), np.zeros(0, np.int64)]
        ones, twos = np.zeros(3), np.zeros(3)
        self.tokens = self.types = 0
        for level, context, customers, tables, one, two in rows:
            if level == 3:
                self.tokens, self.types = customers, tables
                continue
            if level < 2:
                self.customers[level][context], self.tables[level][context] = customers, tables
            ones[level] += one
            twos[level] += two
        self.discounts = discounts if discounts is not None else np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)

    def with_contexts(self, customers: np.ndarray, tables: np.ndarray) -> Totals:
        out = Totals([], self.discounts)
        out.customers, out.tables = [*self.customers[:2], customers], [*self.tables[:2], tables]
        out.tokens, out.types = self.tokens, self.types
        return out


_stirling: dict[float, np.ndarray] = {}


def stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t) up to EXACT: weights of the ways to seat c
    customers at t tables."""
    if discount not in _stirling:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[0, 0] = 0
        for c in range(EXACT):
            stay = out[c] + np.log(np.maximum(c - discount * np.arange(EXACT + 1), 1e-300))
            new = np.append(-np.inf, out[c, :-1])
            out[c + 1] = np.logaddexp(new, np.where(np.arange(EXACT + 1) <= c, stay, -np.inf)) if c else new
        _stirling[discount] = out
    return _stirling[discount]


def reseat(customers, discount, others, parent, rng) -> np.ndarray:
    """A Gibbs draw of the tables of dishes: customers of each, tables of the restaurant's other
    dishes, probability of the dish at the parent. Up to EXACT customers the number of tables is
    drawn from its full conditional, Stirling number times rising factor times parent**t; more are
    seated one after the other, in growing parties, by the Chinese-restaurant rule."""
    t = np.minimum(customers, 1)
    log_s = stirling(discount)
    order = np.argsort(customers, kind="stable")
    edges = np.searchsorted(customers[order], np.arange(EXACT + 2))
    for c in range(2, EXACT + 1):
        at = order[edges[c] : edges[c + 1]]
        for at in np.array_split(at, len(at) * c // 400_000 + 1):
            if len(at):
                opens = np.log(STRENGTH + discount * (others[at][:, None] + np.arange(c))) + np.log(parent[at])[:, None]
                weight = log_s[c, 1 : c + 1] + np.cumsum(opens, axis=1)
                t[at] = 1 + np.argmax(weight - np.log(rng.exponential(size=weight.shape)), axis=1)
    at = order[edges[EXACT + 1] :]
    seated = 1
    tables = np.ones(len(at))
    while len(at):
        party = np.minimum(max(1, seated // 8), customers[at] - seated)
        opens = (STRENGTH + discount * (others[at] + tables)) * parent[at]
        tables += rng.binomial(party, opens / (opens + seated - discount * tables))
        seated += max(1, seated // 8)
        t[at] = tables
        stay = customers[at] > seated
        at, tables = at[stay], tables[stay]
    return t


class Seating:
    """The seating of one bucket's dishes in all restaurants. word, context and customers: its pairs;
    classes: of its contexts."""

    def __init__(self, word, context, customers, classes, n_words: int):
        self.n_words, self.n_contexts = n_words, len(classes)
        middle, of = np.unique(np.asarray(word, np.int64) << 8 | classes[context], return_inverse=True)
        self.up = [None, middle >> 8, of]
        self.where = [np.zeros(n_words, np.int64), middle & 0xFF, context.astype(np.int64)]
        self.c = [np.zeros(0, np.int64)] * 2 + [customers.astype(np.int64)]
        self.t = [np.zeros(0, np.int64)] * 2 + [np.minimum(self.c[2], 1)]
        self._to_parents()
        for level in (1, 0):
            self.t[level] = np.minimum(self.c[level], 1)
            self._to_parents()

    def _to_parents(self):
        for level in (1, 0):
            size = len(self.where[level])
            self.c[level] = np.bincount(self.up[level + 1], self.t[level + 1], size).astype(np.int64) if len(self.t[level + 1]) else np.zeros(size, np.int64)

    def restore(self, tables: list[np.ndarray]) -> None:
        self.t = [x.astype(np.int64) for x in tables]
        self._to_parents()

    def known(self) -> np.ndarray:
        """Training tokens of each word."""
        return np.bincount(self.up[1], np.bincount(self.up[2], self.c[2], len(self.where[1])), self.n_words)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the bucket's contexts."""
        return tuple(np.bincount(self.where[2], x, self.n_contexts).astype(np.int64) for x in (self.c[2], self.t[2]))

    def totals(self):
        """Rows (level, context, customers, tables, ones, twos): of the classes and the root, of all
        contexts together, and tokens and kinds of training tokens (level 3)."""
        known = self.known()
        yield 3, 0, int(known.sum()), int((known > 0).sum()), 0, 0
        for level in range(3):
            at = self.where[level] if level < 2 else np.zeros(len(self.where[2]), np.int64)
            sums = [np.bincount(at, x, 256).astype(np.int64) for x in (self.c[level], self.t[level], self.c[level] == 1, self.c[level] == 2)]
            for k in np.flatnonzero(sums[0]).tolist():
                yield level, k, *(int(s[k]) for s in sums)

    def probabilities(self, totals: Totals, level: int) -> np.ndarray:
        p = np.full(self.n_words, 1 / (totals.types + 1))
        for k in range(level + 1):
            if k:
                p = p[self.up[k]]
            at, d = self.where[k], totals.discounts[k]
            p = (self.c[k] - d * self.t[k] + (STRENGTH + d * totals.tables[k][at]) * p) / (STRENGTH + totals.customers[k][at])
        return p

    def sweep(self, rng: np.random.Generator, totals: Totals) -> None:
        for level in (2, 1, 0):
            if level < 2:
                self.c[level] = np.bincount(self.up[level + 1], self.t[level + 1], len(self.where[level])).astype(np.int64)
            parent = self.probabilities(totals, level - 1)[self.up[level]] if level else np.full(self.n_words, 1 / (totals.types + 1))
            others = np.maximum(totals.tables[level][self.where[level]] - self.t[level], 0)
            self.t[level] = reseat(self.c[level], totals.discounts[level], others, parent, rng)


def _seating(row: tuple) -> tuple[Seating, np.ndarray]:
    """The seating of a MODEL row, and its contexts (none if the row is without them)."""
    contexts = _unpack_contexts(row[6]) if row[6] else np.zeros(0, np.int64)
    return Seating(_unpack_sorted(row[2]), _unpack(row[3], np.uint32), _unpack(row[4], np.uint32), _unpack(row[5], np.uint8), row[1]), contexts


def _with_rows(seating: Seating, totals: Totals, rows: list[tuple]) -> Totals:
    """Seats the bucket by its TABLES row, if there is one, and adds its contexts' TOTAL rows."""
    for row in rows:
        if row[0] == TABLES:
            seating.restore([_unpack(x, np.uint32) for x in row[2:5]])
    parts = sorted((r for r in rows if r[0] == TOTAL), key=lambda r: r[1])
    both = [np.concatenate([np.zeros(0, np.uint32), *(_unpack(r[k], np.uint32) for r in parts)]).astype(np.int64) for k in (2, 3)]
    return totals.with_contexts(*both)


def _shares(bucket: int, seating: Seating, contexts: np.ndarray, ranges: int) -> list[tuple]:
    """The bucket's contexts, their customers and tables, by range."""
    edges = np.searchsorted(contexts, np.arange(ranges + 1) * (1 << 40) // ranges)
    sums = seating.shares()
    return [
        (SHARE, bucket, r, _pack_contexts(contexts[s:e]), *(_pack(x[s:e].astype(np.uint32)) for x in sums))
        for r, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if e > s
    ]


def context_totals(shares: DataFrame, partitions: int) -> DataFrame:
    """TOTAL rows of SHARE rows: what all buckets together have of each context, for each bucket."""

    def add(batches):
        for (number,), rows in _groups(batches, "number"):
            heard = [_unpack_contexts(r[2]) for r in rows]
            contexts, which = np.unique(np.concatenate(heard), return_inverse=True)
            totals = [np.bincount(which, np.concatenate([_unpack(r[k], np.uint32) for r in rows]), len(contexts)).astype(np.uint32) for k in (3, 4)]
            at = 0
            for h, r in zip(heard, rows):
                here = which[at : at + len(h)]
                at += len(h)
                yield _rows([(TOTAL, r[8], number, *(_pack(x[here]) for x in totals))])
        release_memory()

    return shares.repartition(partitions, "number").sortWithinPartitions("number", "bucket").mapInArrow(add, _ROW)


def score_documents(docs: DataFrame, held_out: Column, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Learns from the rows where `held_out` is not true, and scores all. Tokens: A-Z lowered, runs of
    non-blank bytes, then one end. A null or empty text is the end alone. Repeated rows each count
    and each get a score. With no training rows every token is unknown. Other columns of docs are
    not read.

    One shuffle brings all tokens to the buckets of their dishes, where they are written once, what
    each flush of documents has apart from the counts. A sweep is a job over the buckets' counts and
    the tables that the sweep before wrote. The last job adds up the log probabilities of each
    document's tokens; postings of a bucket are dealt to as many tasks as they need.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    sent = rows.mapInArrow(lambda it: _gather(it, buckets), _ROW)
    table = materialise(sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge, _ROW))
    model = table.where(F.col("kind") == MODEL)

    def by_bucket(*parts: DataFrame) -> DataFrame:
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        return every.repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind", "number")

    def seat(number: int, totals: Totals | None):
        shared = spark.sparkContext.broadcast(totals)

        def run(batches):
            for (bucket,), found in _groups(batches, "bucket"):
                seating, contexts = _seating(found[0])
                if shared.value is not None:
                    seating.sweep(np.random.default_rng([seed, bucket, number]), _with_rows(seating, shared.value, found[1:]))
                yield _rows([(TABLES, bucket, number, *(_pack(t.astype(np.uint32)) for t in seating.t)), *_shares(bucket, seating, contexts, buckets)])
                sums = list(seating.totals())
                yield _rows([(DOCS, bucket, number, np.array(sums, np.int64).tobytes())])
            release_memory()

        return run

    def totals_of(state: DataFrame, discounts) -> Totals:
        """Sums of the buckets' rows of totals, one row for each class."""
        def read(batches):
            for batch in batches:
                for cell in batch.column("a").to_pylist():
                    columns = np.frombuffer(cell, np.int64).reshape(-1, 6).T
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["level", "context", "customers", "tables", "ones", "twos"])

        sums = state.where(F.col("kind") == DOCS).select("a").mapInArrow(read, "level long, context long, customers long, tables long, ones long, twos long")
        sums = sums.groupBy("level", "context").agg(*(F.sum(c).alias(c) for c in ("customers", "tables", "ones", "twos")))
        return Totals(sums.collect(), discounts)

    states, totals = [], []
    for number in range(BURN_IN + SAMPLES + 1):
        parts = [model]
        if number:
            parts += [states[-1].where(F.col("kind") == TABLES), context_totals(states[-1].where(F.col("kind") == SHARE), partitions)]
        states.append(materialise(by_bucket(*parts).mapInArrow(seat(number, totals[-1] if number else None), _ROW)))
        totals.append(totals_of(states[-1], totals[0].discounts if number else None))
        if 1 < len(states) <= BURN_IN + 1:
            discard(states[-2])
    last = totals[0]
    shared = spark.sparkContext.broadcast(totals)
    flushes = table.where(F.col("kind") == DOCS).count()
    spread = -(-max(flushes, 1) // POSTINGS)

    def score(batches):
        current, seating, logs, base, known = None, None, None, None, None
        waiting: list[tuple] = []

        def prepare():
            nonlocal logs, base, known
            p = np.zeros(len(seating.where[2]))
            for k in range(BURN_IN + 1, BURN_IN + SAMPLES + 1):
                of_sample = [(r[0], r[1] & 0xFFFFFFFF, *r[2:]) for r in waiting if r[1] >> 32 == k]
                mine = _with_rows(seating, shared.value[k], of_sample)
                p += seating.probabilities(mine, 2) / SAMPLES
            count, of_pair = seating.known(), seating.up[1][seating.up[2]]
            base = np.log10((count + 0.5) / (last.tokens + 0.5 * (last.types + 1)))[of_pair]
            known, logs = (count > 0)[of_pair], np.log10(p)

        for batch in batches:
            for kind, bucket, part, number, *cells in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "part", "number", *"abcdef"))):
                if (bucket, part) != current:
                    current, waiting, logs = (bucket, part), [], None
                if kind == MODEL:
                    seating, _ = _seating((kind, number, *cells))
                elif kind in (TABLES, TOTAL):
                    waiting.append((kind, number, *cells))
                else:
                    if logs is None:
                        prepare()
                    pair = np.repeat(_unpack_sorted(cells[0]), _unpack(cells[1], np.uint32))
                    doc = _unpack(cells[2], np.uint16)
                    some = np.flatnonzero(np.bincount(doc))
                    sums = (np.bincount(doc, x[pair])[some].astype(t) for x, t in ((base, np.float64), (logs, np.float64), (known, np.uint32)))
                    yield _rows([(POSTING, bucket, number, _pack(some.astype(np.uint16)), *map(_pack, sums))])
        release_memory()

    parted = model.withColumn("e", F.lit(b""))
    for k in range(BURN_IN + 1, BURN_IN + SAMPLES + 1):
        both = states[k].where(F.col("kind") == TABLES).withColumn("number", F.lit(0).cast("long"))
        both = both.union(context_totals(states[k].where(F.col("kind") == SHARE), partitions))
        parted = parted.union(materialise(both.withColumn("number", F.col("number") + F.lit(k << 32))))
        discard(states[k])
    order = F.when(F.col("kind") == POSTING, 2).when(F.col("kind") == MODEL, 0).otherwise(1)
    parted = parted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    postings = table.where(F.col("kind") == POSTING).withColumn("part", F.pmod(F.xxhash64("number"), F.lit(spread)).cast("int"))
    dealt = parted.unionByName(postings).withColumn("order", order).repartition(partitions, "bucket", "part").sortWithinPartitions("bucket", "part", "order", "number")
    sums = materialise(dealt.select("kind", "bucket", "part", "number", *"abcdef").mapInArrow(score, _ROW))

    def add_up(batches):
        for _, found in _groups(batches, "number"):
            head = next(r for r in found if r[0] == DOCS)
            ids, null = _unpack(head[2], np.int64), _unpack(head[3], bool)
            total = np.zeros((3, len(ids)))
            for kind, _, at, *cells in found:
                if kind == POSTING:  # of the buckets in order, so that sums do not depend on chance
                    total[:, _unpack(at, np.uint16)] += [_unpack(x, t) for x, t in zip(cells, (np.float64, np.float64, np.uint32))]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64(), mask=null), pa.array(_unpack(head[4], bool)), pa.array(_unpack(head[5], np.int64)),
                pa.array(total[2].astype(np.int64)), pa.array(total[0]), pa.array(total[1]),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        release_memory()

    every = sums.union(table.where(F.col("kind") == DOCS)).repartition(partitions, "number").sortWithinPartitions("number", "bucket")
    scored = every.mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(last.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, tokens, and the perplexity per token of the model and of the base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)
