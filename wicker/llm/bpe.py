"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token the encoding's last token is unique. An automaton whose state is the longest
vocabulary suffix of what was read (failure and output links) lists, at each prefix, every token that ends there. The
first of them whose left neighbour - the last token stored for the prefix before it - is compatible is stored; the
ids follow from the back-pointers. Two neighbours are compatible if byte-pair merging would leave the border between
them untouched, which undoing their merges one by one, latest first, decides.

Defined results: null and empty texts have no tokens, n_tokens 0 and the SHA-256 of the empty string; repeated rows
and ids are kept row by row; very long texts are encoded whole; special-token strings in a text are special tokens,
as in the library. Only the named id and text columns are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, spread, texts_of
from .segment import Pieces, flattened, per_document, regular

#: The pattern of byte-level BPE vocabularies.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pre-tokens remembered in a worker; only speed depends on it.
REMEMBERED = 500_000
#: Text bytes whose distinct words are encoded together.
SLICE_BYTES = 24 << 20


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form (no normaliser, ByteLevel pre-tokeniser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = {c: b for b, c in byte_chars().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        # inner codes: the 256 bytes, then merges by rank
        code = {bytes([b]): b for b in range(256)}
        self.ids = [vocab[c] for _, c in sorted(byte_chars().items())]
        self.left, self.right, self.pair = [*range(256)], [*range(256)], {}
        for n, (a, b) in enumerate(pairs, 256):
            x, y = raw(a), raw(b)
            if x + y in code:
                raise ValueError(f"two merges make {a + b!r}")
            code[x + y] = n
            self.left.append(code[x])
            self.right.append(code[y])
            self.pair[code[x], code[y]] = n
            self.ids.append(vocab[a + b])
        self.size = [len(x) for x in code]
        self.token = {self.ids[n]: x for x, n in code.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.automaton = ahocorasick.Automaton()
        for x, n in code.items():
            self.automaton.add_word(x.decode("latin-1"), n)
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        self.memo: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a|b as it is: no merge over the border comes before those that built a and b."""
        limit = 1 << 60
        while True:
            over = self.pair.get((a, b))
            if over is not None and over < limit:
                return False
            if a > b:
                limit = a
                a = self.right[a]
                if a == limit:
                    limit = b + 1
                    b = self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.left[b]
                if b + 1 == limit:
                    limit = a
                    a = self.right[a]
                    if a == limit:
                        return True

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        found = self.memo.get(text)
        if found is not None:
            return found
        raw = text if text.isascii() else text.encode().decode("latin-1")
        size, known = self.size, self.known
        last = [-1] * len(raw)
        for end, token in self.automaton.iter(raw):
            if last[end] >= 0:
                continue
            before = end - size[token]
            if before < 0:
                last[end] = token
                continue
            key = last[before] << 20 | token
            fits = known.get(key)
            if fits is None:
                if len(known) > 4 * REMEMBERED:
                    known.clear()
                fits = known[key] = self.compatible(last[before], token)
            if fits:
                last[end] = token
        ids, end = [], len(raw) - 1
        while end >= 0:
            ids.append(self.ids[last[end]])
            end -= size[last[end]]
        ids.reverse()
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        if len(text) < 200:
            self.memo[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        ids: list[int] = []
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            ids += self.plain(text[at : m.start()])
            ids.append(self.special[m.group()])
            at = m.end()
        return ids + self.plain(text[at:])

    def plain(self, text: str) -> list[int]:
        return [i for p in PATTERN.findall(text) for i in self.piece(p)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """Units of every text (each distinct unit is encoded once): units, each text's first, regular texts, ids of each unit.

        Texts that aren't regular have no units.
        """
        data, docs = texts_of(texts)
        fine = regular(data, docs)
        if self.specials:
            fine &= ~pc.fill_null(pc.match_substring_regex(texts, self.specials.pattern), False).to_numpy(zero_copy_only=False)
        if not fine.all():
            texts = pc.if_else(pa.array(fine), texts, "")
            data, docs = texts_of(texts)
        p = Pieces(data, docs)
        ids = [self.piece(x) for x in p.units[: p.odd]] + [self.plain(x) for x in p.units[p.odd :]]
        return *p.sequence(), fine, ids


@lru_cache(2)
def load(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def digest(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    """id, n_tokens, SHA-256 of the decimal ids and of the decoded text."""
    bpe, texts = load(path), batch.column(1)
    units, first, fine, ids = bpe.encode_batch(texts)
    said = [b",".join(b"%d" % i for i in x) for x in ids]
    back = [b"".join(map(bpe.token.__getitem__, x)) for x in ids]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    counts = per_document(size[units], first)
    a, b = [], []
    for d in range(len(texts)):
        if fine[d]:
            own = units[first[d] : first[d + 1]].tolist()
            text = b",".join(map(said.__getitem__, own))
            decoded = b"".join(map(back.__getitem__, own)).decode("utf-8", "replace")
        else:
            one = bpe.encode(texts[d].as_py() or "")
            counts[d] = len(one)
            text, decoded = b",".join(b"%d" % i for i in one), bpe.decode(one)
        a.append(hashlib.sha256(text).hexdigest())
        b.append(hashlib.sha256(decoded.encode()).hexdigest())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every document's ids and of their decoding, one row for each input row."""
    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs, [id_col, text_col], lambda b: digest(b, path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", text_col, SLICE_BYTES)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of token ids of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, texts = load(path), batch.column(1)
        units, first, fine, ids = bpe.encode_batch(texts)
        pool, start, size = flattened(ids)
        out = []
        for d in range(len(texts)):
            if fine[d]:
                own = units[first[d] : first[d + 1]]
                out.append(pool[spread(start[own], size[own])].tolist())
            else:
                out.append(bpe.encode(texts[d].as_py() or ""))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs, [id_col, text_col], run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>", text_col)


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text."""

    def run(batches):
        for batch in batches:
            bpe = load(path)
            out = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"doc_id {dict(rows.dtypes)[id_col]}, text string")
