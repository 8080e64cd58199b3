"""Column-at-a-time text work for Arrow batches.

A batch of texts is one byte array with offsets. Words, their hashes and the hashes of
word windows are computed with numpy over the whole array, so no task runs a Python
loop over words. Hashes are 64 bit: a random value per byte, summed with the powers of
an odd multiplier (so that any slice's hash is a difference of prefix sums), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

#: Rows of a batch of numbers on its way to Spark.
SLICE = 20_000

_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

_powers = {_MULT: np.ones(1, np.uint64), _MULT_INV: np.ones(1, np.uint64)}


def forget_powers() -> None:
    for base in _powers:
        _powers[base] = np.ones(1, np.uint64)


def _byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: Bytes of words between blanks: all but space and 0x09-0x0D.
BLANK_WORDS = _byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of words of letters and digits once A-Z is lower case; all non-ASCII bytes count.
PLAIN_WORDS = _byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    have = _powers[base]
    if len(have) < n:
        size = max(n, 2 * len(have), 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their text as (bytes, offsets); a null text is empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(ends, ends[first] + max_bytes, side="right")) - 1
            last = min(max(last, first + 1), len(texts))
            yield (
                batch.slice(first, last - first),
                raw[ends[first] : ends[last]],
                ends[first : last + 1] - ends[first],
            )
            first = last


def in_slices(function):
    """The function of a mapInArrow, whose results leave in batches of at most SLICE rows: Spark holds
    each outside of its heap as a whole."""

    def run(batches):
        for out in function(batches):
            for first in range(0, out.num_rows, SLICE):
                yield out.slice(first, SLICE)

    return run


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of the words in bytes, and for each text the index of its first word
    (with one more entry: the number of words)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte slice [start, end)."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_MULT, len(data)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(_MULT_INV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` neighbours; one for every start that fits."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_MULT, n), out=prefix[1:])
    h = (prefix[width:] - prefix[: n + 1 - width]) * powers(_MULT_INV, n + 1)[: n + 1 - width]
    return mix(h + np.uint64(width))


def range_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of each run [low, high) of neighbours."""
    n = len(hashes)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_MULT, n), out=prefix[1:])
    return mix((prefix[high] - prefix[low]) * powers(_MULT_INV, n + 1)[low] + (high - low).astype(np.uint64))


def windows_in_texts(first: np.ndarray, width: int):
    """For words numbered through, with `first` of each text: the starts of the windows that
    lie in one text, and the text of each."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(len(owner)) - before[owner] + first[:-1][owner], owner


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int):
    """Distinct word shingles of each text: (hash, text) sorted by text, then hash. A text of
    fewer words has its whole sequence as its one shingle, a text without words none."""
    starts, owner = windows_in_texts(first, width)
    h = window_hashes(hashes, width)[starts] if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    for n in range(1, width):
        few = np.flatnonzero(counts == n)
        if len(few):
            h = np.concatenate([h, window_hashes(hashes, n)[first[few]]])
            owner = np.concatenate([owner, few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], owner[keep]


def group_sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values by group modulo 2**64, from exact sums of their 16-bit quarters."""
    total = np.zeros(n, np.uint64)
    for shift in (0, 16, 32, 48):
        part = ((values >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.float64)
        total += np.bincount(groups, part, n).astype(np.uint64) << np.uint64(shift)
    return total
