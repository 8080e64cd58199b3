"""Token-id files in directly addressable codes.

An id's binary digits are cut into chunks, lowest first, of the widths of the levels. Level k
holds, one after the other, the k-th chunks of the ids that have one, and a bitmap that tells
for each whether a next chunk follows. The place of an id's next chunk is the number of set bits
before its own, read from a rank directory with a count every 512 bits; so any id is read by
one step for each of its chunks, and nothing else is decoded.

File: `GLDAC1`, then segments of at most SEGMENT ids, then a footer (numpy arrays: doc ids, a
null mask of them, ids per document, segment offsets), then the footer's place and length.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.arrays import text_chunks
from gleanery.llm.scratch import materialise, scratch_dir
from gleanery.llm.tokens import piece_tokenizer

MAGIC, SEGMENT, RANK_BITS = b"GLDAC1", 1 << 18, 512
#: Bytes of text tokenised at once.
TOKEN_CHUNK = 1 << 20


def level_widths(ids: np.ndarray) -> list[int]:
    """The widths of the levels that take the fewest bits: a bit per chunk for the bitmap, but
    for the last level, and the chunks themselves."""
    _, lengths = np.frexp(ids.astype(np.float64))
    longest = max(1, int(lengths.max()) if len(lengths) else 1)
    counts = np.bincount(np.maximum(lengths, 1), minlength=longest + 1)
    beyond = [int(counts[k + 1 :].sum()) for k in range(longest + 1)]  # ids with over k digits
    best: list[tuple[int, list[int]]] = [(0, [])] * longest + [(0, [])]
    for start in range(longest - 1, -1, -1):
        here = len(ids) if start == 0 else beyond[start]
        best[start] = min(
            (here * (end - start + (end < longest)) + best[end][0], [end - start, *best[end][1]])
            for end in range(start + 1, longest + 1)
        )
    return best[0][1]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    bits = np.empty((len(values), width), np.uint8)
    for k in range(width):
        bits[:, k] = (values >> np.uint32(k)) & np.uint32(1)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros(n, np.uint32)
    for k in range(width):
        out |= bits[:, k].astype(np.uint32) << np.uint32(k)
    return out


class Segment:
    """One run of ids; `get` reads one id, `decode` all of them."""

    def __init__(self, levels: list[tuple[int, int, bytes, bytes, np.ndarray]]):
        self.levels = levels  # width, n, chunks, bitmap, rank directory
        self.n = levels[0][1]

    @classmethod
    def encode(cls, ids: np.ndarray) -> Segment:
        levels, rest = [], ids.astype(np.uint32)
        widths = level_widths(rest)
        for k, width in enumerate(widths):
            chunks = pack_bits(rest & np.uint32((1 << width) - 1), width)
            rest = rest >> np.uint32(width)
            more = rest > 0
            bitmap, ranks = b"", np.zeros(0, np.uint32)
            if k + 1 < len(widths):
                bitmap = np.packbits(more, bitorder="little").tobytes()
                blocks = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else ranks
                ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(np.uint32) if len(blocks) else ranks
            levels.append((width, len(more), chunks, bitmap, ranks))
            rest = rest[more]
        return cls(levels)

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for width, _, chunks, bitmap, ranks in self.levels:
            first = i * width
            window = int.from_bytes(chunks[first >> 3 : (first + width + 7) >> 3], "little")
            value |= (window >> (first & 7) & ((1 << width) - 1)) << shift
            shift += width
            if not bitmap or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = int.from_bytes(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], "little")
            before &= (1 << (i - block * RANK_BITS)) - 1
            i = int(ranks[block]) + before.bit_count()
        return value

    def decode(self) -> np.ndarray:
        out, where, shift = np.zeros(self.n, np.uint32), np.arange(self.n), 0
        for width, n, chunks, bitmap, _ in self.levels:
            out[where] |= unpack_bits(chunks, width, n) << np.uint32(shift)
            shift += width
            if not bitmap:
                break
            where = where[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n, bitorder="little").astype(bool)]
        return out

    def to_bytes(self) -> bytes:
        out = [np.array([len(self.levels)], "<u4").tobytes()]
        for width, n, chunks, bitmap, ranks in self.levels:
            out += [np.array([width, n, len(chunks), len(bitmap), len(ranks)], "<u4").tobytes(), chunks, bitmap, ranks.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Segment:
        levels, at = [], 4
        for _ in range(int.from_bytes(data[:4], "little")):
            width, n, chunk_bytes, bitmap_bytes, n_ranks = np.frombuffer(data, "<u4", 5, at).tolist()
            at += 20
            chunks, bitmap = data[at : at + chunk_bytes], data[at + chunk_bytes : at + chunk_bytes + bitmap_bytes]
            at += chunk_bytes + bitmap_bytes
            levels.append((width, n, chunks, bitmap, np.frombuffer(data, "<u4", n_ranks, at)))
            at += 4 * n_ranks
        return cls(levels)


class DacWriter:
    """Writes documents' ids to a binary file object, a segment at a time."""

    def __init__(self, sink):
        self.sink, self.place, self.offsets = sink, len(MAGIC), []
        self.doc_ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        sink.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.sizes.append(sizes)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= SEGMENT:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // SEGMENT * SEGMENT
            for k in range(0, whole, SEGMENT):
                self._write(ids[k : k + SEGMENT])
            self.waiting, self.n_waiting = [ids[whole:].copy()], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        data = Segment.encode(ids).to_bytes()
        self.offsets.append(self.place)
        self.sink.write(data)
        self.place += len(data)

    def close(self) -> int:
        if self.n_waiting:
            self._write(np.concatenate(self.waiting))
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        footer = io.BytesIO()
        np.savez(
            footer, doc_ids=np.array([d or 0 for d in self.doc_ids], np.int64), sizes=sizes.astype(np.int64),
            null=np.array([d is None for d in self.doc_ids], bool), offsets=np.array([*self.offsets, self.place], np.int64),
        )
        self.sink.write(footer.getvalue() + np.array([self.place, len(footer.getvalue())], "<u8").tobytes())
        return int(sizes.sum())


class DacReader:
    """Reads a file of DacWriter from a seekable binary file object."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token-id file")
        end = source.seek(-16, 2)
        place, length = np.frombuffer(source.read(16), "<u8").tolist()
        if place + length != end:
            raise ValueError("the file is cut short")
        source.seek(place)
        footer = np.load(io.BytesIO(source.read(length)))
        self.doc_ids = [None if n else d for d, n in zip(footer["doc_ids"].tolist(), footer["null"].tolist())]
        self.sizes, self.offsets = footer["sizes"], footer["offsets"]

    def segment(self, k: int) -> Segment:
        self.source.seek(int(self.offsets[k]))
        return Segment.from_bytes(self.source.read(int(self.offsets[k + 1] - self.offsets[k])))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def get(self, i: int) -> int:
        """One id, from a few bytes for each of its chunks: the chunk, the bits of its rank block up to
        it, and the block's rank."""
        k, i = divmod(i, SEGMENT)
        at = int(self.offsets[k]) + 4
        value = shift = 0
        for _ in range(int.from_bytes(self._read(at - 4, 4), "little")):
            width, n, chunk_bytes, bitmap_bytes, n_ranks = np.frombuffer(self._read(at, 20), "<u4").tolist()
            if not 0 <= i < n:
                raise IndexError(i)
            chunks, bits, ranks = at + 20, at + 20 + chunk_bytes, at + 20 + chunk_bytes + bitmap_bytes
            first = i * width
            window = int.from_bytes(self._read(chunks + (first >> 3), (first + width + 7 >> 3) - (first >> 3)), "little")
            value |= (window >> (first & 7) & ((1 << width) - 1)) << shift
            shift += width
            if not bitmap_bytes:
                break
            block, bit = divmod(i, RANK_BITS)
            upto = int.from_bytes(self._read(bits + block * RANK_BITS // 8, (bit >> 3) + 1), "little")
            if not upto >> bit & 1:
                break
            i = int.from_bytes(self._read(ranks + 4 * block, 4), "little") + (upto & ((1 << bit) - 1)).bit_count()
            at = ranks + 4 * n_ranks
        return value

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn; one segment and one document are held."""
        have, k = np.zeros(0, np.uint32), 0
        for size in self.sizes.tolist():
            parts, n = [have], len(have)
            while n < size:
                parts.append(self.segment(k).decode())
                n, k = n + len(parts[-1]), k + 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield have[:size]
            have = have[size:]


def write_token_files(
    docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, drops_blanks: bool,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Encode the texts in ascending order of id (nulls first, equal ids by text) to one file per
    range partition; returns (part, path, n_docs, n_tokens). A null text is empty: its one id is
    end_id. No rows: no files.

    Range partitions put whole id intervals into files in order, and only id and text are
    shuffled. A file is written under a name of its task attempt and then renamed, so a task
    that runs again replaces it by the same bytes.
    """
    ordered = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def write(batches):
        tokenizer, writer, n = piece_tokenizer(tokenizer_path, drops_blanks), None, 0
        context = TaskContext.get()
        where, folder = fs.FileSystem.from_uri(out_dir)
        name = f"{folder}/part-{context.partitionId():06d}.dac"
        partial = f"{name}.{context.taskAttemptId()}"
        for batch, data, offsets in text_chunks(batches, max_bytes=TOKEN_CHUNK):
            if writer is None:
                where.create_dir(folder)
                sink = where.open_output_stream(partial)
                writer = DacWriter(sink)
            ids, bounds = tokenizer.encode(data, offsets)
            ids, sizes = np.insert(ids, bounds[1:], np.uint32(end_id)), np.diff(bounds) + 1
            writer.add(batch.column("doc_id").to_pylist(), ids, sizes)
            n += batch.num_rows
        if writer is not None:
            total = writer.close()
            sink.close()
            where.move(partial, name)
            uri = f"{out_dir.rstrip('/')}/{name.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "path": [uri], "n_docs": [n], "n_tokens": [total]})

    return materialise(ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens and the
    unsigned crc32 of the ids as little-endian unsigned 32-bit integers. Each task takes files."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("part", "path", before.alias("start"))
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as source:
                    reader = DacReader(source)
                    crcs = [zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) for ids in reader.documents()]
                ends = start + np.cumsum(reader.sizes)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(reader.doc_ids, pa.int64()), "start": pa.array(ends - reader.sizes, pa.int64()),
                    "n_tokens": pa.array(reader.sizes, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    return placed.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: The end-of-document id of the query.
END_ID = 2


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, scratch_dir(spark), public_tokenizers.path("byte_bpe_50k.json"), END_ID, drops_blanks=False)
    return read_token_files(files)
