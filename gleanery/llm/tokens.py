"""Token ids of whole texts, with each distinct piece of text tokenised once per worker.

A text is cut where the tokenizer always starts anew, so the ids of a text are the ids of its
pieces in order. For both vocabularies these are safe cuts: before a run of ASCII blanks (byte
BPE) or around it (word BPE, which drops blanks), and between an ASCII letter and an ASCII mark
other than an apostrophe. A text in which the byte BPE could join a non-ASCII blank with an ASCII
one is one piece. The text of a special token is a piece, as the tokenizers library takes it for that
token wherever it stands. Ids of short pieces are remembered in arrays of bounded size.
"""

from __future__ import annotations

import os
import re

import numpy as np

from gleanery.llm.arrays import lower, slice_hashes

#: Pieces whose ids a worker remembers (about 40 bytes each) before it starts anew, and the
#: longest such piece in bytes.
REMEMBERED, SHORT = 1_000_000, 64
#: Pieces given to the library at once.
ENCODED = 1024

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x80] = True
_MARK[0x30:0x3A] = _MARK[0x27] = _MARK[0x7F] = False
_MARK &= ~_LETTER
_OTHER_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class PieceTokenizer:
    """Encodes chunks of texts (see arrays.text_chunks) to ids."""

    def __init__(self, path: str, drops_blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_blanks = Tokenizer.from_file(path), drops_blanks
        marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True))) if marks else None
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros((0, 2), np.int64)
        self.pool, self.fill = np.zeros(1 << 16, np.uint32), 0

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, special: list[tuple[int, int]]):
        blank = _BLANK[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets] = True
        cut = fresh[:-1].copy()
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        if self.drops_blanks:
            cut[1:] |= blank[:-1] != blank[1:]
        else:
            cut[1:] |= ~blank[:-1] & blank[1:]
            raw = data.tobytes()
            for found in _OTHER_BLANK.finditer(raw):
                text = np.searchsorted(offsets, found.start(), side="right") - 1
                cut[offsets[text] + 1 : offsets[text + 1]] = False
        for begin, end in special:
            cut[begin + 1 : end] = False
            cut[begin] = True
            cut[end : end + 1] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        if self.drops_blanks:
            word = ~blank[starts]
            starts, ends = starts[word], ends[word]
        return starts, ends

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of each text in it."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        special = [] if self.special is None else [m.span() for m in self.special.finditer(data.tobytes())]
        special = [(b, e) for b, e in special if np.searchsorted(offsets, b, side="right") == np.searchsorted(offsets, e - 1, side="right")]
        if self.drops_blanks:
            data = lower(data)
        starts, ends = self._pieces(data, offsets, special)
        keys, first, which = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = self.known[spot] != keys if len(self.known) else np.ones(len(keys), bool)
        place = np.zeros((len(keys), 2), np.int64)
        if len(self.known):
            place[~new] = self.at[spot[~new]]
        fill = self.fill
        if new.any():
            raw, fresh = data.tobytes(), np.flatnonzero(new)
            begins, stops = starts[first[fresh]].tolist(), ends[first[fresh]].tolist()
            made, sizes = [], np.zeros(len(fresh), np.int64)
            for k in range(0, len(fresh), ENCODED):  # the library's results are far larger than their ids
                texts = [raw[s:e].decode() for s, e in zip(begins[k : k + ENCODED], stops[k : k + ENCODED])]
                ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                sizes[k : k + ENCODED] = list(map(len, ids))
                made.append(np.fromiter((i for x in ids for i in x), np.uint32))
            total = int(sizes.sum())
            if fill + total > len(self.pool):
                self.pool = np.concatenate([self.pool[:fill], np.zeros(total + fill // 2 + (1 << 16), np.uint32)])
            self.pool[fill : fill + total] = np.concatenate(made)
            place[fresh, 0] = fill + np.cumsum(sizes) - sizes
            place[fresh, 1] = sizes
            fill += total
        sizes = place[which, 1]
        ends_of = np.cumsum(sizes)
        out = self.pool[np.arange(int(ends_of[-1]) if len(ends_of) else 0) + np.repeat(place[which, 0] - ends_of + sizes, sizes)]
        bounds = np.concatenate([[0], ends_of])[np.searchsorted(starts, offsets)]
        if new.any():
            keep = fresh[(ends - starts)[first[fresh]] <= SHORT]
            if len(self.known) + len(keep) > REMEMBERED:
                self._forget()
            elif len(keep):
                where = np.searchsorted(self.known, keys[keep])
                self.known = np.insert(self.known, where, keys[keep])
                self.at = np.insert(self.at, where, place[keep], axis=0)
                self.fill = fill
        return out, bounds


_tokenizers: dict[tuple[str, bool], PieceTokenizer] = {}


def forget_tokenizers() -> None:
    _tokenizers.clear()


def piece_tokenizer(path: str, drops_blanks: bool) -> PieceTokenizer:
    """This worker's tokenizer for a file, with what it remembers."""
    key = (path, drops_blanks)
    if key not in _tokenizers:
        _tokenizers[key] = PieceTokenizer(path, drops_blanks)
    return _tokenizers[key]
