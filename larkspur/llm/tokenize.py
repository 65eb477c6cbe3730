"""Token ids of whole texts by a tokenizers-library vocabulary file, memoised by word.

The library encodes every distinct word once a Python worker; texts are then
assembled by array gathers. Words are cut at spaces and newlines and between a
letter and ASCII punctuation other than the apostrophe: the tokenizer's
pre-tokeniser splits there too, so that the ids are those of the whole text.
A text that holds ``<|`` might spell a special token and is encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from larkspur.llm import kernels as K

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers, some 40 bytes each with their ids; beyond, it starts anew.
MEMO_WORDS = 800_000

_WORD = K.SPACED | ((K._bytes >= 9) & (K._bytes <= 13) & (K._bytes != 10))
_PUNCTUATION = (K._bytes < 128) & (K._bytes > 32) & (K._bytes < 127) & ~K.LETTER_BYTE & ~K.DIGIT_BYTE & (K._bytes != 39)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(piece: np.ndarray) -> np.ndarray:
    """Positions between a letter (ASCII or Latin-1) and ASCII punctuation."""
    letter = K.LETTER_BYTE[piece]
    sign = _PUNCTUATION[piece]
    latin = np.zeros(len(piece), bool)
    latin[1:] = (piece[:-1] == 0xC3) & (piece[1:] >= 0x80) & (piece[1:] != 0x97) & (piece[1:] != 0xB7)
    cut = np.zeros(len(piece), bool)
    cut[1:] = (sign[1:] & (letter[:-1] | latin[:-1])) | (sign[:-1] & letter[1:])
    cut[1:-1] |= sign[:-2] & latin[2:]
    return cut


class Encoder:
    """encode(column) → (ids, ids per text)."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in got for i in ids), np.uint32, total)
        begin = self.used + np.cumsum(size) - size
        self.used += total
        slot = np.arange(len(self.begin), len(self.begin) + len(got))
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
        at = np.searchsorted(self.known, hashes)
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, slot)

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        found = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        return at, found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = K.utf8(column)
        n = len(offsets) - 1
        special = np.zeros(n, bool)
        hits = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, int)
        special[np.searchsorted(offsets, hits, side="right") - 1] = True
        docs, start, end, hashes = K.words(offsets, data, _WORD, _cuts)
        if special.any():
            plain = ~special[docs]
            docs, start, end, hashes = docs[plain], start[plain], end[plain], hashes[plain]
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > MEMO_WORDS:
            self.clear()
        _, found = self._slots(distinct)
        if not found.all():
            new = ~found
            lower = K.LOWER[data].tobytes()
            s, e = start[first[new]].tolist(), end[first[new]].tolist()
            self._learn(distinct[new], [lower[a:b].decode() for a, b in zip(s, e)])
        at, _ = self._slots(distinct)
        slots = self.slot[at] if len(at) else at
        size = self.size[slots][which]
        ids = self.flat[K.ragged(self.begin[slots][which], size)]
        per_text = np.bincount(docs, weights=size, minlength=n)[:n].astype(np.int64) if len(docs) else np.zeros(n, np.int64)
        if special.any():
            texts = column.filter(pa.array(special)).to_pylist()
            whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            parts, stop = np.split(ids, np.cumsum(per_text)[:-1]), iter(whole)
            parts = [next(stop) if special[i] else parts[i] for i in range(n)]
            per_text = np.fromiter(map(len, parts), np.int64, n)
            ids = np.concatenate(parts) if parts else ids
        return ids, per_text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, with what it has memoised, for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, per_text: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one id to every text."""
    size = per_text + 1
    stops = np.cumsum(size)
    out = np.empty(int(stops[-1]) if len(stops) else 0, np.uint32)
    is_end = np.zeros(len(out), bool)
    is_end[stops - 1] = True
    out[is_end] = end
    out[~is_end] = ids
    return out, size
