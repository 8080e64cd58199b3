"""N-gram Jaccard join: word-shingle sets that overlap enough, searched with DivideSkip."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.arrays import BLANK_WORDS, find_words, group_sums, in_slices, lower, mix, shingle_sets, slice_hashes, text_chunks
from gleanery.llm.components import connected_components
from gleanery.llm.scratch import discard, materialise, release_memory

#: Shingles of a search block: what one task holds of a cluster of candidates at once.
BLOCK = 400_000
#: Signatures a task gathers before it sends them, and links it gathers before it adds them up.
FLUSH = 300_000
#: Postings probed in one step.
PROBES = 1 << 20
#: Most sets with a shingle of which all pairs are compared.
HOT = 64
#: Blocks of sets outside of a cluster's largest part that are searched for in every block of the cluster.
ASKS = 2
#: In the place of a count of sets: a row that says what the rows of its document after it are of.
HEAD = 1 << 40


def size_bands(largest: int, percent: int) -> np.ndarray:
    """Largest sizes of the bands 0, 1, ... so that two sets with a Jaccard similarity of percent
    or more are in one band or in neighbouring ones."""
    tops, low = [], 1
    while low <= largest:
        tops.append(low * 100 // percent)
        low = tops[-1] + 1
    tops += [low * 100 // percent]
    return np.array(tops, np.int64)


def level_parts(tops: np.ndarray, percent: int) -> np.ndarray:
    """Parts at each level (bands i and i + 1, without pairs inside band i + 1): one more than the
    elements by which two sets of a linked pair can differ, so at least one part is equal."""
    after = np.append(tops[1:], tops[-1] * 100 // percent + 1)
    return (100 - percent) * (tops + after) // (100 + percent) + 1


def set_fingerprint(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return mix(group_sums(mix(h ^ np.uint64(0x5851F42D4C957F2D)), owner, n) + np.bincount(owner, minlength=n).astype(np.uint64))


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and two fingerprints of the shingle set (null for an empty set): set_id,
    and set_check, which tells apart sets that share a set_id."""

    def sets(batches):
        for batch, data, offsets in text_chunks(batches):
            data = lower(data)
            starts, ends, first = find_words(data, offsets, BLANK_WORDS)
            h, owner = shingle_sets(slice_hashes(data, starts, ends), first, width)
            n = np.bincount(owner, minlength=batch.num_rows)
            prints = [set_fingerprint(x, owner, len(n)).astype(np.int64) for x in (h, mix(h + np.uint64(0x9FB21C651E98DF25)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.int64(), mask=n == 0) for x in prints)],
                names=["doc_id", "n_shingles", "set_id", "set_check"],
            )
        release_memory()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(sets, "doc_id long, n_shingles long, set_id long, set_check long")


def part_signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(signature, set_id): for each set and each level it takes part in, a fingerprint of each of
    its parts. Within a task equal signatures keep their least set and link the others to it
    (link_to), so a hot signature leaves a task as one row.

    A part without elements has no signature, as it is the same for every set. Where all equal parts
    of a linked pair are empty (k of them), all but k - 1 of the others differ by one element. So a set
    with k empty parts also has the signatures of its first k parts of two or more elements less
    each one of them, which are those of the other set's parts. If either set has k such parts, one
    of them differs by one element, and the pair meets there. A set with fewer has the signature of
    each of its least elements too, as many as must hold one of any set that it can link with.
    """

    def cut(batches):
        waiting, n = [], 0
        for _, data, offsets in text_chunks(batches):
            data = lower(data)
            starts, ends, first = find_words(data, offsets, BLANK_WORDS)
            h, owner = shingle_sets(slice_hashes(data, starts, ends), first, width)
            sizes = np.bincount(owner, minlength=len(offsets) - 1)
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            ids = set_fingerprint(h, owner, len(sizes))
            tops = size_bands(int(sizes.max()), percent)
            parts = level_parts(tops, percent)
            band = np.searchsorted(tops, sizes[some])
            spread = mix(h ^ np.uint64(0x2545F4914F6CDD1D))
            place = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[owner]  # in the set, by hash
            for down in (0, 1):
                has = band >= down
                rows, level = some[has], band[has] - down
                m = np.zeros(len(sizes), np.int64)
                m[rows] = parts[level]
                base = np.cumsum(m) - m
                of = m[owner] > 0
                o = owner[of]
                part = ((spread[of] >> np.uint64(32)) * m[o].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                total = int(m.sum())
                sums = group_sums(spread[of], base[o] + part, total)
                filled = np.bincount(base[o] + part, minlength=total)
                row = np.repeat(np.arange(len(m)), m)
                at = np.arange(total) - base[row]
                levels = np.zeros(len(sizes), np.int64)
                levels[rows] = level
                sig = mix(sums + mix((levels[row] << 32 | at).astype(np.uint64)) + filled.astype(np.uint64))
                keep = filled > 0
                waiting.append((sig[keep].astype(np.int64), ids[row[keep]].astype(np.int64)))
                empty = np.bincount(row[~keep], minlength=len(m))
                many = np.append(0, np.cumsum(filled > 1))
                less = (filled > 1) & (many[:-1] - many[base[row]] < empty[row])
                some_less = less[base[o] + part]
                of_part = (base[o] + part)[some_less]
                rest = sums[of_part] - spread[of][some_less]
                rest = mix(rest + mix((levels[row[of_part]] << 32 | at[of_part]).astype(np.uint64)) + (filled[of_part] - 1).astype(np.uint64))
                waiting.append((rest.astype(np.int64), ids[row[of_part]].astype(np.int64)))
                sparse = (m > 0) & (np.bincount(row[filled > 1], minlength=len(m)) < empty)
                alone = sparse[o] & (place[of] <= sizes[o] - -(-sizes[o] * percent // 100))
                single = mix(spread[of][alone] ^ mix((~levels[o[alone]]).astype(np.uint64)))
                waiting.append((single.astype(np.int64), ids[o[alone]].astype(np.int64)))
                n += int(keep.sum()) + len(rest) + len(single)
            if n > FLUSH:
                yield emit(waiting)
                waiting, n = [], 0
        if n:
            yield emit(waiting)
        waiting = []
        release_memory()

    def emit(waiting):
        sig, ids = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = sig[1:] != sig[:-1]
        least = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        again = np.zeros(len(sig), bool)
        again[1:] = ~fresh[1:] & (ids[1:] != ids[:-1])
        keep = fresh | again
        return pa.RecordBatch.from_arrays([
            pa.array(sig[keep]), pa.array(ids[keep]), pa.array(least[keep], mask=fresh[keep]),
        ], names=["signature", "set_id", "link_to"])

    return docs.select("text").mapInArrow(in_slices(cut), "signature long, set_id long, link_to long")


def candidate_links(signatures: DataFrame) -> DataFrame:
    """(a, b, weight): each set that shares a signature, with the least set of that signature;
    weight: signatures of the pair. Tasks stream over their signatures in order and hold FLUSH of
    them at once."""
    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def link(batches):
        waiting, held = [], 0
        last, hub = None, 0  # the signature that the rows before ended with, and its least set

        def links():
            nonlocal last, hub
            sig, ids, to, linked = (np.concatenate(x) for x in zip(*waiting))
            a, b = [ids[linked]], [to[linked]]
            sig, ids = sig[~linked], ids[~linked]
            if len(sig):
                fresh = np.ones(len(sig), bool)
                fresh[1:] = sig[1:] != sig[:-1]
                least = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                if sig[0] == last:
                    least[np.cumsum(fresh) == 1] = hub
                last, hub = sig[-1], least[-1]
                a.append(ids[ids != least])
                b.append(least[ids != least])
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            where = np.flatnonzero(fresh)
            return pa.RecordBatch.from_arrays(
                [pa.array(a[where]), pa.array(b[where]), pa.array(np.diff(np.append(where, len(a))))], names=["a", "b", "weight"]
            )

        for batch in batches:
            to = batch.column("link_to")
            waiting.append((
                batch.column("signature").to_numpy(), batch.column("set_id").to_numpy(), to.fill_null(0).to_numpy(),
                to.is_valid().to_numpy(zero_copy_only=False),
            ))
            held += batch.num_rows
            if held > FLUSH:
                yield links()
                waiting, held = [], 0
        if held:
            yield links()
        waiting = []
        release_memory()

    # a task's own links need no exchange with others of their signature: they go anywhere
    where = F.when(F.col("link_to").isNull(), F.col("signature")).otherwise(F.xxhash64("set_id", "link_to"))
    dealt = signatures.repartition(n, where).sortWithinPartitions("signature", "set_id")
    return dealt.mapInArrow(in_slices(link), "a long, b long, weight long").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


class DivideSkip:
    """T-occurrence search over sets of shingles: which indexed sets hold at least T of a query's
    shingles. Short inverted lists are merged with a heap; the longest are only probed by binary
    search, for sets that the short ones bring to T less the number of long ones."""

    def __init__(self, sets: list[np.ndarray], mu: float = 0.01):
        self.n, self.mu = max(len(sets), 1), mu
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((owner, keys))
        self.keys, starts = np.unique(keys[order], return_index=True)
        self.starts, self.postings = np.append(starts, len(keys)), owner[order]
        # list number and set in one, in order over all lists: all long lists are probed at once
        self.codes = np.repeat(np.arange(len(self.keys)), np.diff(self.starts)) * self.n + self.postings

    def search(self, query: np.ndarray, least: int) -> list[tuple[int, int]]:
        """(indexed set, shared shingles) of all sets that share at least `least` >= 1."""
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        lists = at[self.keys[at] == query]
        if len(lists) < least:
            return []
        lengths = self.starts[lists + 1] - self.starts[lists]
        order = np.argsort(lengths, kind="stable")
        lists, longest = lists[order], int(lengths.max())
        n_long = min(int(least / (self.mu * math.log2(max(longest, 2)) + 1)), least - 1, len(lists))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found, counts = [], []
        for one in heapq.merge(*(self.postings[self.starts[k] : self.starts[k + 1]].tolist() for k in short.tolist())):
            if found and found[-1] == one:
                counts[-1] += 1
            else:
                found.append(one)
                counts.append(1)
        at, n = np.array(found, np.int64), np.array(counts, np.int64)
        at, n = at[n >= least - n_long], n[n >= least - n_long]
        step = max(1, PROBES // max(n_long, 1))
        for s in range(0, len(at), step):
            codes = long[:, None] * self.n + at[s : s + step]
            n[s : s + step] += (self.codes[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)] == codes).sum(axis=0)
        return list(zip(at[n >= least].tolist(), n[n >= least].tolist()))


def _links_in_block(sets: list[np.ndarray], queries: np.ndarray, group: np.ndarray, percent: int):
    """A spanning forest of the links between the queries (rows, the centre first) and all rows, by
    T-occurrence search. Rows of one group are known to be connected; rows that are not queries are
    all of one group. Queries that the main component (that of those rows, or else of the first
    query) holds by their turn are not asked: a link from it into another component has an end
    there, and that row is asked. Returns pairs of rows."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    index, out = DivideSkip(sets), []
    silent = np.setdiff1d(np.arange(len(sets)), queries)
    main = int(group[silent[0]]) if len(silent) else None
    left = len(np.unique(group))
    for q in queries.tolist():
        if left == 1:
            break
        if main is not None and root(int(group[q])) == root(main):
            continue
        main = int(group[q]) if main is None else main
        size = len(sets[q])
        for other, shared in index.search(sets[q], max(1, -(-size * percent // 100))):
            if other != q and shared * 100 >= percent * (size + len(sets[other]) - shared):
                a, b = root(int(group[q])), root(int(group[other]))
                if a != b:
                    parent[a] = b
                    left -= 1
                    out.append((q, other))
    return out


def member_sets(members: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The members (doc_id of one document of a set, set_id, more columns) with their sets of shingles,
    sorted hashes in a binary column."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = members.columns
    joined = members.hint("merge").join(texts, "doc_id").select(*names, "text")  # one plan at every size
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in members.schema)}, shingles binary"

    def with_sets(batches):
        for batch, data, offsets in text_chunks(batches):
            data = lower(data)
            starts, ends, first = find_words(data, offsets, BLANK_WORDS)
            h, owner = shingle_sets(slice_hashes(data, starts, ends), first, width)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)) * 8
            ids = set_fingerprint(h, owner, batch.num_rows).astype(np.int64)
            same = ids == batch.column("set_id").to_numpy()  # rows of a doc_id can have other texts
            raw = h.tobytes()
            sets = pa.array([raw[s:e] for s, e, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), same.tolist()) if k], pa.binary())
            out = batch.select(names).take(pa.array(np.flatnonzero(same)))
            yield pa.RecordBatch.from_arrays([*out.columns, sets], names=[*names, "shingles"])
        release_memory()

    return joined.mapInArrow(with_sets, schema)


def search_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents inside blocks. members: block, doc_id, grp (rows of one grp are
    known to be connected), rank (of queries, least first; null: not a query), shingles."""
    n = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def search(batches: Iterator[pa.RecordBatch]):
        block, rows = None, []

        def links():
            best: dict[int, tuple] = {}
            for doc_id, grp, rank, sets in rows:
                if doc_id not in best or (rank is not None and (best[doc_id][1] is None or rank < best[doc_id][1])):
                    best[doc_id] = (grp, rank, sets)
            ids = sorted(best)
            ranks = [best[i][1] for i in ids]
            queries = sorted((k for k, r in enumerate(ranks) if r is not None), key=lambda k: (ranks[k], ids[k]))
            got = _links_in_block(
                [np.frombuffer(best[i][2], np.uint64) for i in ids], np.array(queries, np.int64), np.array([best[i][0] for i in ids]), percent
            )
            return [(ids[a], ids[b]) for a, b in got]

        def record(found):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["a", "b"])

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    if found := links():
                        yield record(found)
                    block, rows = b, []
                rows.append(row)
        if found := links():
            yield record(found)
        rows = []
        release_memory()

    dealt = members.select("block", "doc_id", "grp", "rank", "shingles").repartition(n, "block").sortWithinPartitions("block", "doc_id")
    return dealt.mapInArrow(search, "a long, b long")


def set_components(table: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, component): the least documents of sets in one component of the links at a similarity
    of percent, for all sets that link with another.

    Sets that share signatures form clusters; a cluster is dealt into blocks of about BLOCK shingles
    by a hash. First each block is searched, with the cluster's centre (most shared signatures) in
    every block, which joins most of what belongs together. In clusters of several blocks that are
    still in parts, all sets but those of the largest part are queries, a block of them against a block
    of the others at a time: every linked pair in two parts has an end that is a query, so no link is
    lost, and what is known is not searched. Where that are over ASKS blocks of queries, sets of
    different parts first meet by their rarest shingles, which what is loosely joined by common ones
    does not share, and only sets whose rarest shingles are common ones are left as queries.
    """
    links = materialise(candidate_links(part_signatures(docs, width, percent)))
    clusters = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("degree"))
    first = table.where("set_id is not null and doc_id is not null")
    first = first.groupBy("set_id", "set_check").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    known = materialise(
        clusters.join(degree, "node").select(F.col("node").alias("set_id"), F.col("component").alias("cluster"), "degree").join(first, "set_id")
    )
    blocks = F.ceil(F.sum("n") / BLOCK).cast("int")
    per = known.groupBy("cluster").agg(blocks.alias("blocks"), F.max_by("doc_id", F.struct("degree", "doc_id")).alias("centre"))
    members = known.join(per, "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    members = members.select("doc_id", "set_id", "cluster", "n", "blocks", "part", "degree", (F.col("doc_id") == F.col("centre")).alias("is_centre"))
    members = materialise(member_sets(members, docs, width))
    discard(links)
    discard(known)
    block = F.xxhash64("cluster", "part").alias("block")
    row = [block, "doc_id", F.col("doc_id").alias("grp"), (-F.col("degree")).alias("rank"), "shingles"]
    centres = members.where("is_centre and blocks > 1").withColumn("part", F.explode(F.expr("sequence(0, blocks - 1)")))
    near = materialise(search_blocks(members.select(row).union(centres.select(row)), percent))
    grown = materialise(connected_components(near).withColumnRenamed("node", "doc_id"))
    large = members.drop("shingles").where("blocks > 1").dropDuplicates(["doc_id", "set_id"])  # sets follow when it is known which are needed
    if not large.limit(1).count():
        discard(members)
        return grown
    large = large.join(grown, "doc_id", "left").withColumn("grp", F.coalesce("component", "doc_id"))
    parts = large.groupBy("cluster", "grp").agg(F.count("*").alias("members"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("members", "grp")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    parted = large.join(main.select("cluster", "main"), "cluster").withColumn("asked", F.expr("grp <> main.grp"))
    asks = F.ceil(F.sum("n") / BLOCK).cast("int").alias("asks")
    told = parted.join(parted.where("asked").groupBy("cluster").agg(asks), "cluster")
    told = materialise(told.select("doc_id", "set_id", "cluster", "n", "blocks", "part", "grp", "asked", "asks"))
    if not told.limit(1).count():
        discard(members)
        discard(told)
        return grown
    apart = materialise(told.join(members.select("doc_id", "set_id", "shingles"), ["doc_id", "set_id"]).dropDuplicates(["doc_id", "set_id"]))
    discard(members)
    discard(told)
    links = [near, materialise(search_blocks(_questions(apart.where(F.col("asks") <= ASKS)), percent))]
    loose = apart.where(F.col("asks") > ASKS)
    if loose.limit(1).count():
        prefixes = materialise(rarest_shingles(loose, percent))
        links.append(materialise(prefix_links(prefixes, loose, percent)))
        common = prefixes.where(F.col("df") > HOT).select("doc_id").distinct()
        rest = loose.drop("asks", "blocks", "part").join(common, "doc_id", "left_semi")
        asks = F.ceil(F.sum(F.when(F.col("asked"), F.col("n"))) / BLOCK).cast("int").alias("asks")
        own = rest.groupBy("cluster").agg(blocks.alias("blocks"), asks).where("asks is not null")  # blocks of what is left alone
        rest = materialise(rest.join(own, "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")))
        discard(prefixes)
        links.append(materialise(search_blocks(_questions(rest), percent)))  # its tasks would each need a second worker for the next step
        discard(rest)
    discard(apart)
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return connected_components(every).withColumnRenamed("node", "doc_id")


def _questions(rest: DataFrame) -> DataFrame:
    """The rows of search_blocks for the sets of clusters of which some are asked about: each block of
    these in every block of its cluster."""
    both = F.xxhash64("cluster", "part", "ask").alias("block")
    held = rest.withColumn("ask", F.explode(F.expr("sequence(0, asks - 1)")))
    asked = rest.where("asked").withColumn("ask", F.pmod(F.xxhash64("doc_id", F.lit(1)), "asks").cast("int"))
    asked = asked.withColumn("part", F.explode(F.expr("sequence(0, blocks - 1)")))
    return held.select(both, "doc_id", "grp", F.lit(None).cast("long").alias("rank"), "shingles").union(
        asked.select(both, "doc_id", "grp", F.lit(1).cast("long").alias("rank"), "shingles")
    )


def rarest_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, doc_id, grp, n, df): of each set (doc_id, grp, n, shingles) its rarest shingles, so many that
    two sets with a Jaccard similarity of percent share one of them: all but as many as must be
    shared, and one. df: sets that have the shingle, those of over HOT alike; what only one set has
    is counted among its rarest and left out."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["shingle", "doc_id"]

    def spread(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for k, raw in enumerate(batch.column("shingles").to_pylist()):
                h = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), ids[k]))], names=names)
        release_memory()

    def count(batches):
        waiting, held, hot = [], 0, None  # hot: the shingle of which more than HOT rows were seen

        def counted(last):
            nonlocal waiting, held, hot
            columns = [np.concatenate(c) for c in zip(*waiting)]
            key = columns[0]
            upto = len(key) if last else int(np.searchsorted(key, key[-1]))
            if len(key) - upto > HOT or (not last and key[-1] == hot):
                upto = len(key)
            some, rest = [c[:upto] for c in columns], [c[upto:] for c in columns]
            waiting, held = ([rest], len(rest[0])) if len(rest[0]) else ([], 0)
            fresh = np.ones(upto, bool)
            fresh[1:] = (some[0][1:] != some[0][:-1]) | (some[1][1:] != some[1][:-1])  # rows of a doc_id can repeat
            some = [c[fresh] for c in some]
            head = np.flatnonzero(np.append(True, some[0][1:] != some[0][:-1])) if len(some[0]) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(some[0])))
            df = np.repeat(np.minimum(size, HOT + 1), size)
            if hot is not None:
                df[some[0] == hot] = HOT + 1
            hot = some[0][-1] if len(df) and df[-1] > HOT else None
            several = np.flatnonzero(df > 1)
            return pa.RecordBatch.from_arrays([*(pa.array(c[several]) for c in some), pa.array(df[several])], names=[*names, "df"])

        for batch in batches:
            waiting.append([batch.column(c).to_numpy() for c in names])
            held += batch.num_rows
            if held > FLUSH:
                yield counted(False)
        if held:
            yield counted(True)
        release_memory()

    def first(batches):
        doc, seen, own = None, 0, []  # own: (grp, n) of the sets of a doc_id
        for batch in batches:
            ids, grp, size, df = (batch.column(c).to_numpy() for c in ("doc_id", "grp", "n", "df"))
            found: list[tuple[np.ndarray, int, int]] = []
            edges = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            for s, e in zip(edges.tolist(), np.append(edges[1:], len(ids)).tolist()):
                if ids[s] != doc:
                    doc, seen, own = ids[s], 0, []
                heads = int(np.searchsorted(-df[s:e], -HEAD, side="right"))
                own = sorted({*own, *zip(grp[s : s + heads].tolist(), size[s : s + heads].tolist())})
                s += heads
                least = min(-(-m * percent // 100) for _, m in own)
                at = np.arange(max(s, s + least - 1 - seen), e)  # all but the least - 1 commonest
                seen += e - s
                if len(at):
                    found += [(at, g, m) for g, m in own]
            if found:
                at = np.concatenate([f[0] for f in found])
                of = [pa.array(np.concatenate([np.full(len(f[0]), f[k]) for f in found])) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(at)).columns, *of, pa.array(df[at])], names=[*names, "grp", "n", "df"])
        release_memory()

    listed = sets.select("doc_id", "shingles").mapInArrow(spread, "shingle long, doc_id long")
    counts = listed.repartition(n, "shingle").sortWithinPartitions("shingle", "doc_id").mapInArrow(in_slices(count), "shingle long, doc_id long, df long")
    none, head = F.lit(0).cast("long"), F.lit(HEAD).cast("long")
    counts = counts.select("shingle", "doc_id", none.alias("grp"), none.alias("n"), "df")
    heads = sets.select(none.alias("shingle"), "doc_id", "grp", F.col("n").cast("long"), head.alias("df"))
    # what only one set has would come last; it needs no row to be counted
    order = counts.union(heads).repartition(n, "doc_id").sortWithinPartitions("doc_id", F.desc("df"), F.desc("shingle"))
    return order.mapInArrow(in_slices(first), "shingle long, doc_id long, grp long, n long, df long")


def prefix_links(prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets of different groups that share one of their rarest shingles, if at most HOT
    sets have it. Pairs whose sizes alone rule a link out are not compared."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pair(batches):
        rest: list = []

        def pairs(columns):
            key, ids, grp, size = columns
            head = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(head)[np.cumsum(head) - 1]
            found = [np.zeros((0, 2), np.int64)]
            for back in range(1, HOT):
                at = np.flatnonzero(np.arange(len(key)) - back >= begin)
                if not len(at):
                    break
                x, y = size[at], size[at - back]
                at = at[(grp[at] != grp[at - back]) & (ids[at] != ids[at - back]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))]
                found.append(np.sort(np.stack([ids[at], ids[at - back]], axis=1), axis=1))
            a, b = np.unique(np.concatenate(found), axis=0).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("shingle", "doc_id", "grp", "n")]
            if rest:
                columns = [np.concatenate(c) for c in zip(rest, columns)]
            if len(columns[0]):
                upto = int(np.searchsorted(columns[0], columns[0][-1]))
                rest = [c[upto:] for c in columns]
                if upto:
                    yield pairs([c[:upto] for c in columns])
        if rest and len(rest[0]):
            yield pairs(rest)
        release_memory()

    few = prefixes.where(F.col("df") <= HOT).repartition(n, "shingle").sortWithinPartitions("shingle", "doc_id")
    met = few.mapInArrow(in_slices(pair), "a long, b long").distinct()
    own = sets.select("doc_id", "shingles").dropDuplicates(["doc_id"])
    both = met.join(own.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        release_memory()

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable over links, a link being
    100 * |A and B| >= percent * |A or B| for the sets of distinct word shingles.

    A text of fewer words has its whole sequence as one shingle; without words or text the set is
    empty and links with nothing, so component_id is the row's own doc_id. Every row is returned:
    repeated rows share a component, rows without a doc_id have none and link nothing. Equal sets
    are one set throughout, so copies cost nothing. Shingles are told apart by 64-bit hashes, sets
    by 128 bits. Other columns of docs, whatever their names, are not read.
    """
    table = materialise(shingle_table(docs, width))
    components = set_components(table, docs, width, percent)
    sets = table.where("set_id is not null").groupBy("set_id", "set_check").agg(F.min("doc_id").alias("own"))
    found = sets.join(components.withColumnRenamed("doc_id", "own"), "own", "left")
    by_set = found.select("set_id", "set_check", F.coalesce("component", "own").alias("component_id"))
    out = table.join(by_set, ["set_id", "set_check"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2
), links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * o >= 90 * (na + nb - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
