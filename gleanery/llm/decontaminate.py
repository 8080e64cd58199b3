"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.arrays import (
    PLAIN_WORDS, find_words, lower, slice_hashes, text_chunks, window_hashes, windows_in_texts,
)
from gleanery.llm.scratch import materialise, numbered, release_memory

#: Words of a window, and the share of hit words (one in so many) that contaminates a document.
WINDOW, ONE_IN = 13, 20
#: Most windows in one broadcast set (some 100 MB); a larger benchmark is scanned in several sets.
SET_WINDOWS = 500_000

_SPANS = T.ArrayType(T.ArrayType(T.LongType()))


def _normal_words(text: str | None) -> list[bytes]:
    data = lower(np.frombuffer((text or "").encode(), np.uint8))
    starts, ends, _ = find_words(data, np.array([0, len(data)]), PLAIN_WORDS)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class WindowSet:
    """Windows of benchmark items by width and hash, with their words for the exact check."""

    def __init__(self, width: int):
        self.width, self.size = width, 0
        self.windows: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = {}

    def add(self, item: str, words: list[bytes]) -> None:
        width = min(self.width, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        hashes = window_hashes(slice_hashes(raw, np.concatenate([[0], ends[:-1]]), ends), width)
        of_width = self.windows.setdefault(width, {})
        for k, h in enumerate(hashes.tolist()):
            text = b" ".join(words[k : k + width])
            same = of_width.setdefault(h, [])
            for known, items in same:
                if known == text:
                    if items[-1] != item:
                        items.append(item)
                    break
            else:
                same.append((text, [item]))
        self.size += len(hashes)

    def lookups(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each width its hashes in order, and a bitmap of their first 22 bits."""
        out = []
        for width, of_width in sorted(self.windows.items()):
            hashes = np.sort(np.fromiter(of_width, np.uint64, len(of_width)))
            bitmap = np.zeros(1 << 22, bool)
            bitmap[hashes >> np.uint64(42)] = True
            out.append((width, hashes, bitmap))
        return out


def benchmark_sets(benchmark: DataFrame, id_column: str, text_column: str, width: int) -> Iterator[WindowSet]:
    """The benchmark in sets of bounded size; there is always one, if an empty one."""
    items = benchmark.select(F.col(id_column).cast("string"), text_column).where(F.col(id_column).isNotNull())
    current, given = WindowSet(width), False
    for item, text in items.toLocalIterator():
        if words := _normal_words(text):
            current.add(item, words)
        if current.size >= SET_WINDOWS:
            yield current
            current, given = WindowSet(width), True
    if current.size or not given:
        yield current


def _scan(batches: Iterator[pa.RecordBatch], windows: WindowSet, text_column: str, schema: pa.Schema):
    lookups = windows.lookups()
    for batch, data, offsets in text_chunks(batches, text_column):
        data = lower(data)
        starts, ends, first = find_words(data, offsets, PLAIN_WORDS)
        hashes = slice_hashes(data, starts, ends)
        raw, hits = data.tobytes(), {}
        for width, known, bitmap in lookups:
            at, owner = windows_in_texts(first, width)
            if not len(at):
                continue
            h = window_hashes(hashes, width)[at]
            maybe = np.flatnonzero(bitmap[h >> np.uint64(42)])
            maybe = maybe[known[np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)] == h[maybe]]
            of_width = windows.windows[width]
            for k in maybe.tolist():
                w = int(at[k])
                text = b" ".join(raw[s:e] for s, e in zip(starts[w : w + width].tolist(), ends[w : w + width].tolist()))
                for known_text, items in of_width[int(h[k])]:
                    if known_text == text:
                        spans, found = hits.setdefault(int(owner[k]), ([], set()))
                        spans.append((w - int(first[owner[k]]), w - int(first[owner[k]]) + width))
                        found.update(items)
        old_spans, old_items = batch.column("hit_spans"), batch.column("hit_items")
        all_spans, all_items = [], []
        for row in range(batch.num_rows):
            spans, found = hits.get(row, ((), ()))
            merged: list[list[int]] = []
            for s, e in sorted([*map(tuple, old_spans[row].as_py()), *spans]) if spans or len(old_spans[row]) else ():
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            all_spans.append(merged)
            all_items.append(sorted({*old_items[row].as_py(), *found}) if found or len(old_items[row]) else [])
        new = {
            "n_words": pa.array(np.diff(first), pa.int64()),
            "hit_spans": pa.array(all_spans, pa.list_(pa.list_(pa.int64()))),
            "hit_items": pa.array(all_items, pa.list_(pa.string())),
        }
        yield pa.RecordBatch.from_arrays(
            [new[f.name].cast(f.type) if f.name in new else batch.column(f.name) for f in schema], schema=schema
        )
    release_memory()


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", width: int = WINDOW,
) -> DataFrame:
    """The documents with n_words, hit_spans ([first word, end) pairs, apart from each other),
    hit_items (ids as strings, in string order), n_hit, n_items and contaminated.

    A window is `width` consecutive words of an item; an item of fewer words is one window, an
    item without words or id none. Words: A-Z lowered, runs of letters, digits and non-ASCII
    bytes. A document word in any occurrence of a window is hit; contaminated means n_hit > 0 and
    ONE_IN * n_hit >= n_words. Null and empty texts have no words and are clean; repeated rows
    are judged each; columns of these six names are replaced, all others stay. An empty
    benchmark marks nothing.

    The benchmark is read in sets of at most SET_WINDOWS windows (a whole item may exceed it);
    each is broadcast and scanned in one pass without a shuffle. If there are several, what a pass
    found is written to the shared folder for the next.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = ["n_words", "hit_spans", "hit_items", "n_hit", "n_items", "contaminated"]
    out = docs.drop(*made)
    out = out.withColumns({
        "n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast(_SPANS),
        "hit_items": F.array().cast("array<string>"),
    })
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    arrow = to_arrow_schema(schema)
    spark = docs.sparkSession
    shared = None
    for windows in benchmark_sets(benchmark, item_column, item_text, width):
        if shared is not None:  # a pass of each set is written before the next: one set is held at a time
            out = materialise(out)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(windows)
        out = out.mapInArrow(lambda it, shared=shared: _scan(it, shared.value, text_column, arrow), schema)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.withColumns({"n_hit": n_hit, "n_items": F.size("hit_items").cast("long")}).withColumn(
        "contaminated", F.expr(f"n_hit > 0 and {ONE_IN} * n_hit >= n_words")
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, action: str = "document", **options) -> DataFrame:
    """The documents without what the benchmark taints, in their own columns.

    action "document" drops contaminated documents and leaves all others as they are; "span"
    keeps every document and cuts the hit words (with what stands between them) from its text.
    Columns can have any names.
    """
    plain = numbered(docs)
    names = plain.columns
    text_column = names[docs.columns.index(options.pop("text_column", "text"))]
    marked = mark_contamination(plain, benchmark, text_column=text_column, **options)
    if action == "document":
        return marked.where(~F.col("contaminated")).select(names).toDF(*docs.columns)
    if action != "span":
        raise ValueError(f"action must be 'document' or 'span', not {action!r}")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = plain.schema
    arrow = to_arrow_schema(schema)

    def cut(batches):
        for batch, data, offsets in text_chunks(batches, text_column):
            starts, ends, first = find_words(lower(data), offsets, PLAIN_WORDS)
            raw, texts = data.tobytes(), []
            for row, spans in enumerate(batch.column("hit_spans").to_pylist()):
                here, kept = offsets[row], b""
                for s, e in spans:
                    kept += raw[here : starts[first[row] + s]]
                    here = ends[first[row] + e - 1]
                kept += raw[here : offsets[row + 1]]
                texts.append(kept.decode() if batch.column(text_column)[row].is_valid else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, f.type) if f.name == text_column else batch.column(f.name) for f in arrow], schema=arrow
            )

    return marked.mapInArrow(cut, schema).toDF(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), "contaminated",
    )


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS width, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)
), widths AS (SELECT DISTINCT width FROM windows),
found AS (
  SELECT d.row_id, d.i, d.width, n.item_id
  FROM (SELECT row_id, width, i, array_to_string(w[i : i + width - 1], ' ') AS words
        FROM (SELECT row_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM words, widths WHERE len(w) >= width)) d
  JOIN windows n ON n.width = d.width AND n.words = d.words
), hit AS (
  SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + width)) AS p FROM found) GROUP BY row_id
), named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
"""
