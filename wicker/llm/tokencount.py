"""Token counts of fields or sections, attributed by offsets.

A document is encoded once, as a whole, by the exact encoder of ``bpe``; its tokens' byte spans give character spans
(as the tokenizers library's offsets), which binary search joins with the sections' spans. Rule for a token over a border: it counts for the section that holds most of its characters, the earlier one if
two hold equally many; a token with no characters of its own (a later part of a character's bytes) has its character's span.

Sections are the lines of a text, each with its newline (``section_tokens``), or a row's fields, encoded as one text with a
newline behind each, which belongs to its field (``field_tokens``); newlines inside a field stay what they are.

Defined results: a null or empty text is one empty section with 0 tokens; repeated rows and ids are kept row by row;
very long texts are encoded whole; null fields count as empty. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import arrow_map, spread, texts_of
from .segment import flattened


#: Text bytes handled at once: a token takes some 60 bytes of memory.
SLICE_BYTES = 8 << 20


def owners(begin: np.ndarray, end: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The section of each token span, by the rule; heads are the sections' first characters, ascending, heads[0] <= all begins."""
    first = np.searchsorted(heads, begin, "right") - 1
    last = np.maximum(first, np.searchsorted(heads, np.maximum(end - 1, begin), "right") - 1)
    own = first.copy()
    for i in np.flatnonzero(last > first):
        edges = [begin[i], *heads[first[i] + 1 : last[i] + 1], end[i]]
        own[i] = first[i] + int(np.argmax(np.diff(edges)))
    return own


def token_bytes(texts: pa.Array, docs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Document and byte length of every token of the batch, documents in order."""
    bpe = load(path)
    units, first, fine, ids = bpe.encode_batch(texts)
    length = np.zeros(max(bpe.token) + 1, np.int64)
    for i, x in bpe.token.items():
        length[i] = len(x)
    pool, head, size = flattened(ids)
    tokens = pool[spread(head[units], size[units])]
    owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(first)), size[units])
    own, sizes = [owner], [length[tokens]]
    for d in np.flatnonzero(~fine):
        one = bpe.encode(texts[int(d)].as_py())
        own.append(np.full(len(one), d))
        sizes.append(length[one] if one else np.zeros(0, np.int64))
    if len(own) == 1:
        return owner, sizes[0]
    owner = np.concatenate(own)
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate(sizes)[order]


def lines(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
    data, docs = texts_of(texts)
    # sections start at documents' starts and after newlines; a newline at the end opens none
    ends = np.flatnonzero(data == 10) + 1
    own = np.searchsorted(docs, ends - 1, "right") - 1
    inside = ends < docs[1:][own]
    heads, doc = np.concatenate([docs[:-1], ends[inside]]), np.concatenate([np.arange(len(docs) - 1), own[inside]])
    order = np.lexsort((heads, doc))
    return sections(ids, texts, heads[order], doc[order], path)


def parts(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    """The same for texts of several fields; the third column has the fields' sizes in bytes."""
    size = np.stack([np.asarray(x) for x in batch.column(2).to_pylist()]).astype(np.int64) if batch.num_rows else np.zeros((0, 1), np.int64)
    _, docs = texts_of(batch.column(1))
    heads = docs[:-1, None] + np.cumsum(size, 1) - size
    return sections(batch.column(0), batch.column(1), heads.ravel(), np.repeat(np.arange(len(docs) - 1), size.shape[1]), path)


def sections(ids: pa.Array, texts: pa.Array, heads: np.ndarray, doc: np.ndarray, path: str) -> pa.RecordBatch:
    """Counts of the sections that begin at the given bytes of the batch, in the given documents, in order."""
    data, docs = texts_of(texts)
    n = len(docs) - 1
    char = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters that begin before each byte
    first = np.searchsorted(doc, np.arange(n + 1))
    at = char[heads] + doc  # every document gets a place of its own, so that one binary search serves all, empty ones too
    owner, size = token_bytes(texts, docs, path)
    stop = np.cumsum(size)  # tokens cover the batch's bytes without gaps
    counts = np.zeros(len(heads), np.int64)
    for i in range(0, len(size), 1 << 21):
        part = slice(i, i + (1 << 21))
        b, d = stop[part], owner[part]
        counts += np.bincount(owners(char[b - size[part] + 1] - 1 + d, char[b] + d, at), minlength=len(heads))
    base = char[docs[:-1]][doc]
    until = np.append(at[1:] - doc[1:], char[-1])
    until[first[1:] - 1] = char[docs[1:]]
    totals = np.add.reduceat(counts, first[:-1]) if n else counts
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(doc)), pa.array(np.arange(len(doc)) - first[doc], pa.int32()), pa.array(at - doc - base, pa.int64()), pa.array(until - base, pa.int64()), pa.array(counts), pa.array(totals[doc])],
        ["doc_id", "section", "begin_char", "end_char", "n_tokens", "doc_tokens"],
    )


def section_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line of each row: doc_id, section (0, 1, ...), begin_char, end_char, n_tokens, doc_tokens."""
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, section int, begin_char long, end_char long, n_tokens long, doc_tokens long"
    return arrow_map(docs, [id_col, text_col], lambda b: lines(b, path), schema, text_col, SLICE_BYTES)


def field_tokens(rows: DataFrame, path: str, id_col: str, fields: list[str]) -> DataFrame:
    """Tokens of each field of a row, its fields encoded together, a newline behind each: doc_id, field, n_tokens."""
    texts = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n")) for c in fields]
    whole = rows.select(F.col(id_col).alias("doc_id"), F.concat(*texts).alias("text"), F.array(*map(F.octet_length, texts)).alias("sizes"))
    schema = f"doc_id {dict(rows.dtypes)[id_col]}, section int, begin_char long, end_char long, n_tokens long, doc_tokens long"
    counted = arrow_map(whole, ["doc_id", "text", "sizes"], lambda b: parts(b, path), schema, "text", SLICE_BYTES)
    names = F.array(*map(F.lit, fields))
    return counted.select("doc_id", names[F.col("section")].alias("field"), "n_tokens")
