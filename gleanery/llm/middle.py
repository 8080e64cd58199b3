"""Fill-in-the-middle texts: content-defined chunks with remembered summaries find the cuts of a text."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.arrays import BLANK_WORDS, text_chunks
from gleanery.llm.scratch import numbered, release_memory

#: A chunk ends where the rolling hash of its last 16 bytes has CHUNK_BITS bits set (one place in 512), or at LONGEST bytes.
CHUNK_BITS, LONGEST = (1 << 9) - 1, 4096
#: Bytes of chunks that a worker remembers before the older half is forgotten.
REMEMBERED_BYTES = 32 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]
_GEAR = np.random.default_rng(20240131).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """The ends of the chunks of bytes, the last one at their end: places that only the 16 bytes before
    them decide, so a passage is cut alike in every text, and cuts LONGEST bytes after the last one.

    The hash of 16 bytes is rolled by doubling: that of 2w bytes is the sum of two of w bytes.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    h, factor, width = _GEAR[data], 0x9E3779B1, 1
    while width < 16 and len(h) > width:
        h = h[width:] + h[:-width] * np.uint32(factor)
        factor, width = factor * factor % 2**32, 2 * width
    places = np.flatnonzero((h >> np.uint32(20)) & np.uint32(CHUNK_BITS) == CHUNK_BITS) + width if width == 16 else np.zeros(0, np.int64)
    ends = np.unique(np.append(places, len(data)))
    gaps = np.diff(ends, prepend=0)
    more = (gaps - 1) // LONGEST
    if more.any():
        wide = np.repeat(np.arange(len(ends)), more)
        step = np.arange(len(wide)) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate([ends, (ends - gaps)[wide] + step * LONGEST]))
    return ends


class ChunkCache:
    """Summaries of chunks by their content. A summary says how many words of the chunk end at a blank
    in it, how many code points start in it, and whether its first and last bytes are blank: what the
    neighbours need to know to add up. The key is the content itself, so equal hashes can't mislead."""

    def __init__(self, most: int = REMEMBERED_BYTES):
        self.most, self.held, self.hits, self.misses = most, 0, 0, 0
        self.young: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.old: dict[bytes, tuple[int, int, bool, bool]] = {}

    def summary(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.young.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = self.old.get(chunk)
        if found is None:
            self.misses += 1
            data = np.frombuffer(chunk, np.uint8)
            blank = ~BLANK_WORDS[data]
            found = (
                int(np.count_nonzero(blank[1:] & ~blank[:-1])), int(np.count_nonzero((data & 0xC0) != 0x80)), bool(blank[0]), bool(blank[-1]),
            )
        else:
            self.hits += 1
        self.young[chunk] = found
        self.held += len(chunk) + 200
        if self.held > self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0
        return found


class TextCuts:
    """Where the tokens of a text end: a token is a word with the blanks before it, and blanks at the end
    are one more. Found from the summaries of its chunks; only chunks that a cut is in are looked into."""

    def __init__(self, text: bytes, cache: ChunkCache):
        self.text, self.ends = text, chunk_ends(np.frombuffer(text, np.uint8)).tolist()
        self.words, self.chars = [0], [0]  # ended words and code points before each chunk, and in all
        before, start, words, chars = True, 0, 0, 0
        for end in self.ends:
            inside, points, first, last = cache.summary(text[start:end])
            words += inside + (first and not before)
            chars += points
            self.words.append(words)
            self.chars.append(chars)
            start, before = end, last
        self.n = words + 1 if text else 0

    def place(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first k tokens."""
        if k <= 0:
            return 0, 0
        if k >= self.n:
            return len(self.text), self.chars[-1]
        c = bisect_left(self.words, k) - 1  # the word's end is in this chunk
        start, end = self.ends[c - 1] if c else 0, self.ends[c]
        data = np.frombuffer(self.text, np.uint8)
        blank = ~BLANK_WORDS[data[max(start - 1, 0) : end]]
        at = np.flatnonzero(blank[1:] & ~blank[:-1])[k - self.words[c] - 1] + 1 + max(start - 1, 0)
        return int(at), self.chars[c] + int(np.count_nonzero((data[start:at] & 0xC0) != 0x80))


def fill_in_middle(text: bytes, name: str, cache: ChunkCache, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and the output for one text."""
    cuts = TextCuts(text, cache)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or h3 % 100 >= rate or any(m in text for m in _MARKS):
        return cuts.n, "plain", None, None, text
    low, high = sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1)))
    (a, a_chars), (b, b_chars) = cuts.place(low), cuts.place(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = _MARKS
    if h4 % 100 < spm:
        return cuts.n, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return cuts.n, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """The documents with n, form, prefix_chars, middle_chars and output.

    A text is cut into n tokens: a word (anything but ASCII blanks) with the blanks before it, and
    blanks at the end. The first four 8-digit groups of sha256("seed:id") say after which two tokens
    prefix and middle end, whether it is changed (`rate` in 100) and whether as suffix-prefix-middle
    (`spm` in 100 of these) or prefix-suffix-middle. A text without characters or with one of the
    marks stays plain, with null counts. Null texts are empty, a null id is the empty string; equal
    rows get equal outputs; columns of these five names are replaced, all others stay whatever their
    names; an empty table stays empty.

    One pass without a shuffle. Texts are cut into chunks by content; each worker remembers summaries
    of chunks (see ChunkCache, of bounded size), so what documents share is looked at once, and sums of
    the summaries say which chunk a cut is in.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c not in _MADE]
    plain = numbered(docs.select([F.col(f"`{c}`") for c in kept]))
    key, text = (plain.columns[kept.index(c)] for c in (id_column, text_column))
    made = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    schema = T.StructType([*plain.schema.fields, *made.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for batch, data, offsets in text_chunks(batches, text):
            raw, bounds = data.tobytes(), offsets.tolist()
            names = ["" if x is None else str(x) for x in batch.column(key).to_pylist()]
            rows = [fill_in_middle(raw[s:e], name, cache, seed, rate, spm) for name, s, e in zip(names, bounds[:-1], bounds[1:])]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *new], arrow)], schema=arrow)
        del cache
        release_memory()

    return plain.mapInArrow(run, schema).toDF(*kept, *_MADE)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of: no part holds a mark, so each mark is where it is
    found first."""
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    end, width = F.length(output) + 1, len(PREFIX)
    part = lambda first, stop: F.substring(output, first + width, stop - first - width)
    return (
        F.when(form == "psm", F.concat(part(p, s), part(m, end), part(s, m)))
        .when(form == "spm", F.concat(part(p, m), part(m, end), part(s, p)))
        .otherwise(output)
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS d,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), k AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
    CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
  FROM h
), f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM k
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 :], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE concat(prefix, middle, suffix) END) AS restored_sha256
FROM p
"""
