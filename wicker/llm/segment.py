"""Vectorised cutting of Arrow text columns into words, pieces and distinct strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: \x20 and \x09-\x0D, the blanks of the word pattern [^\x20\x09-\x0D]+
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LETTERS = "".join(chr(c) for c in range(0x250) if chr(c).isalpha())
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Words:
    """Words of a batch: ``data``/``offsets`` hold them back to back, ``first[d]:first[d + 1]`` are document d's."""

    def __init__(self, data: np.ndarray, docs: np.ndarray):
        keep = ~BLANK[data]
        start = keep.copy()
        start[1:] &= ~keep[:-1]
        heads = docs[:-1][docs[:-1] < docs[1:]]
        start[heads] = keep[heads]
        at = np.flatnonzero(start)
        self.first = np.searchsorted(at, docs)
        self.data = data[keep]
        inside = np.cumsum(keep) - keep  # place of each byte once blanks are gone
        self.offsets = np.append(inside[at], len(self.data)).astype(np.int64)
        self.begin = at  # byte offset of each word in the batch

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def array(self) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(self.offsets), pa.py_buffer(self.data))

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """A code for each word and the distinct words."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary


def joined(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words set apart by one space: bytes, start and end of each word, and first word of each document (one more than documents)."""
    w = Words(data, docs)
    return *spaced(w), w.first


def spaced(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words set apart by one space (and 32 spare bytes behind them): bytes, start and end of each."""
    size = np.diff(w.offsets)
    n = len(w)
    start = w.offsets[:-1] + np.arange(n)
    out = np.full(len(w.data) + n + 32, 32, np.uint8)
    out[np.arange(len(w.data)) + np.repeat(np.arange(n), size)] = w.data
    return out, start, start + size


def core_and_tail(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """A word's letters, the punctuation that follows them, and whether the word is just these two."""
    core = pc.utf8_rtrim(words, PUNCTUATION)
    tail = pc.utf8_ltrim(words, LETTERS)
    plain = pc.and_(pc.utf8_is_alpha(core), pc.equal(pc.add(pc.binary_length(core), pc.binary_length(tail)), pc.binary_length(words)))
    return core, tail, plain.to_numpy(zero_copy_only=False)


#: Bytes that may begin blanks other than space and newline, or other control characters that a pattern treats as blank.
ODD = np.zeros(256, bool)
ODD[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def regular(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Documents whose only blanks are single spaces and newlines between words."""
    n = len(docs) - 1
    blank = (data == 32) | (data == 10)
    bad = ODD[data]
    bad[1:] |= blank[1:] & blank[:-1]
    full = np.flatnonzero(docs[:-1] < docs[1:])
    edge = np.zeros(n, bool)
    edge[full] = blank[docs[full]] | blank[docs[full + 1] - 1]
    at = np.flatnonzero(bad)
    edge[np.searchsorted(docs, at, "right") - 1] = True
    return ~edge


class Pieces:
    """Regular documents cut before each blank, as byte-level BPE with its blank-prefixed words never joins across one.

    ``codes[first[d]:first[d + 1]]`` are the distinct pieces of document d. Every distinct piece is one to three
    units (newline; blank and letters; punctuation), or one odd unit that needs the full pattern. ``units`` lists the
    distinct units' texts, ``odd`` where those of the last kind begin.
    """

    def __init__(self, data: np.ndarray, docs: np.ndarray):
        cut = (data == 32) | (data == 10)
        cut[docs[:-1][docs[:-1] < docs[1:]]] = True
        begin = np.append(np.flatnonzero(cut), len(data)).astype(np.int64)
        self.first = np.searchsorted(begin[:-1], docs)
        self.begin = begin
        array = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(np.ascontiguousarray(data)))
        coded = array.dictionary_encode()
        self.codes, u = coded.indices.to_numpy(), coded.dictionary
        body = pc.utf8_ltrim(u, "\n")
        core = pc.utf8_rtrim(body, PUNCTUATION)
        tail = pc.utf8_ltrim(pc.utf8_ltrim(body, " "), LETTERS)
        plain = pc.and_(pc.utf8_is_alpha(pc.utf8_ltrim(core, " ")), pc.equal(pc.add(pc.binary_length(core), pc.binary_length(tail)), pc.binary_length(body)))
        newline = pc.not_equal(pc.binary_length(body), pc.binary_length(u)).to_numpy(zero_copy_only=False)
        ok = plain.to_numpy(zero_copy_only=False)
        self.table = np.full((len(u), 3), -1, np.int64)
        self.units = ["\n"]
        self.table[ok & newline, 0] = 0
        for column, values, has in ((1, core, ok), (2, tail, ok & (pc.binary_length(tail).to_numpy(zero_copy_only=False) > 0)), (1, u, ~ok)):
            self.odd = len(self.units)
            c = values.filter(pa.array(has)).dictionary_encode()
            self.table[has, column] = c.indices.to_numpy() + len(self.units)
            self.units += c.dictionary.to_pylist()

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """Units in document order, and each document's first (one more than documents)."""
        rows = self.table[self.codes]
        used = rows >= 0
        before = np.append(0, np.cumsum(used.sum(1)))
        return rows[used], before[self.first]


def flattened(lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of the lists in one array, and each list's start and length."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    pool = np.fromiter((x for one in lists for x in one), np.int64, int(size.sum()))
    return pool, np.cumsum(size) - size, size


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d + 1]]."""
    total = np.append(0, np.cumsum(values))
    return total[first[1:]] - total[first[:-1]]
