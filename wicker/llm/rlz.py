"""Substring dedup by relative Lempel-Ziv parsing of every document against all documents before it.

The reference holds each 13-word sequence once, at its first place: the smallest doc_id, and there the first word. Every
document is a reference block of those after it; blocks are met through an index partitioned by hash, so that no document
meets a block with which it shares nothing:

* anchors: of every 13 consecutive words, the 5-word gram with the smallest hash (leftmost of equals). Equal windows have
  equal anchors, so a window can only repeat if its anchor occurs in two rows. Anchors are counted (pre-aggregated in each
  task); those of one row alone go no further. A hash that two grams share costs work, never a result.
* windows: those left are known by 96 bits of the BLAKE2b digest of their words (one space between them), so that equal keys
  mean equal words and no construction of words or word sequences can make others meet. The index has the first
  place (doc_id, word) of every window that repeats, by a pre-aggregated minimum.

The parse reads the index at every place of a document. From a place with an entry (source document, source word) a factor
goes on greedily for as long as the next places' entries are the next words of the same source; it spans 12 words
more than its places. At a factor's end, the windows over its boundary are looked up like any other: the first that has an
entry begins the next factor, which then overlaps the last, else the parse goes on behind it. Words without a factor
are literals. All factors are 13 words or longer, hence duplicate spans; their words are removed. The parse reads
the input alone, not what is left of it. A window that half of all documents share has as many rows in the join with its one
entry; the entry side is one row a key, so that AQE may split the other.

Defined results: ids are of any type that can be ordered; null and empty texts have 0 words and the SHA-256 of the empty
string; texts of fewer than 13 words stay whole; rows with the same id don't count as copies of each other; rows with a null
id stay whole and remove nothing; repeated rows are kept row by row; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sliced, stored, texts_of
from .segment import Words, spaced
from .xxh import xxh64

WINDOW, GRAM = 13, 5
STEP = np.uint64(0xA0761D6478BD642F)
#: What a row is known by: its id and, where rows share one, its text's hash, so that they are parsed apart.
KEY = ["doc_id", "turn"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(w: Words) -> np.ndarray:
    """Hash of the GRAM words from each place on; places where the batch has fewer left mean nothing."""
    codes, distinct = w.distinct()
    data, offsets = texts_of(distinct)
    h = xxh64(np.append(data, np.zeros(8, np.uint8)), offsets[:-1], offsets[1:])[codes] if len(codes) else np.zeros(0, np.uint64)
    out = h.copy()
    with np.errstate(over="ignore"):
        for k in range(1, GRAM):
            out[: len(h) - k] = out[: len(h) - k] * STEP + h[k:]
    return mixed(out).view(np.int64)


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a document's windows: whether 13 words start there, and the hash of the window's anchor."""
    n = len(w)
    g = grams(w)
    left = w.first[1:][np.repeat(np.arange(len(w.counts)), w.counts)] - np.arange(n)
    some = left >= WINDOW
    if not some.any():
        return some, g
    view = sliding_window_view(np.append(g, np.zeros(WINDOW - GRAM, np.int64)), WINDOW - GRAM + 1)
    return some, g[np.minimum(np.arange(n) + view.argmin(1), n - 1)]


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    among = np.sort(among)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def candidates(w: Words, lists: pa.Array) -> np.ndarray:
    """Places whose windows have an anchor in their document's list."""
    some, anchor = anchors(w)
    ends = np.append(0, np.cumsum(np.diff(np.asarray(lists.offsets))))
    values = lists.flatten().to_numpy()
    out = np.zeros(len(w), bool)
    for d in np.flatnonzero(np.diff(ends)):
        own = slice(w.first[d], w.first[d + 1])
        out[own] = some[own] & member(anchor[own], values[ends[d] : ends[d + 1]])
    return out


def digested(w: Words, at: np.ndarray) -> np.ndarray:
    """Keys (h, g) of the windows at the given places."""
    flat, start, end = spaced(w)
    raw, new = flat.tobytes(), hashlib.blake2b
    keys = b"".join([new(raw[a:b], digest_size=12).digest() for a, b in zip(start[at].tolist(), end[at + WINDOW - 1].tolist())])
    return np.frombuffer(keys, [("h", "<i8"), ("g", "<i4")])


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, turn, text, and the columns to keep as k0, k1, ...; turn tells rows of one id apart by their texts' hashes, and is 0 for other rows."""
    ids = docs.select(F.col(id_col).alias("doc_id"))
    again = stored(ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "again")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    turn = F.when(F.col("doc_id").isNull() | F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.join(again, "doc_id", "left").select("doc_id", turn.alias("turn"), "text", *(f"k{i}" for i in range(len(keep))))


def shared_anchors(rows: DataFrame) -> DataFrame:
    """Each row's key and the anchors that it shares with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            w = Words(*texts_of(batch.column(2)))
            some, anchor = anchors(w)
            doc = np.repeat(np.arange(batch.num_rows), w.counts)[some]
            anchor = anchor[some]
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))[: len(doc)]
            own = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), batch.column(0).take(own), batch.column(1).take(own)], ["anchor", *KEY])

    found = rows.mapInArrow(run, f"anchor long, doc_id {dict(rows.dtypes)['doc_id']}, turn long")
    several = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    return found.join(several, "anchor", "left_semi").groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors"))


def windows(rows: DataFrame) -> DataFrame:
    """h, g, doc_id, turn and place of every window that may repeat; a place is negative (~place) where the row has the window before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            w = Words(*texts_of(batch.column(2)))
            at = np.flatnonzero(candidates(w, batch.column(3)))
            keys = digested(w, at)
            doc = np.searchsorted(w.first, at, "right") - 1
            h, g, place = keys["h"], keys["g"], (at - w.first[doc]).astype(np.int32)
            order = np.lexsort((g, h, doc))
            same = np.append(False, (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1]))[: len(order)]
            place[order[same]] = ~place[order[same]]
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), batch.column(0).take(own), batch.column(1).take(own), pa.array(place)], ["h", "g", *KEY, "place"])

    return rows.mapInArrow(run, f"h long, g int, doc_id {dict(rows.dtypes)['doc_id']}, turn long, place int")


def factored(rows: DataFrame) -> DataFrame:
    """doc_id, turn and the factors - first_word, n_words, source, source_word - of every row that has any, by place; written."""
    named = rows.where("doc_id IS NOT NULL").select(*KEY, "text")
    shared = stored(shared_anchors(named), "anchors")
    found = stored(windows(named.join(shared, KEY).select(*KEY, "text", "anchors")), "windows")
    discard(shared)
    first = found.where("place >= 0").groupBy("h", "g").agg(F.min("doc_id").alias("source"), F.min_by("place", "doc_id").alias("at"), F.count(F.lit(1)).alias("n"))
    index = stored(first.where("n > 1").drop("n"), "index")
    here = F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place")).alias("place")
    read = stored(found.join(index, ["h", "g"]).where("source < doc_id").select(*KEY, here, "source", "at"), "read")
    discard(found, index)
    # a factor is a run of places whose entries are a run of one source's words: both counters go up by one
    diagonal = [*KEY, "source", F.col("at") - F.col("place")]
    order = F.dense_rank().over(Window.partitionBy(*diagonal).orderBy("place"))  # a repeated row has every place twice
    runs = read.repartition(*KEY).withColumn("run", F.col("place") - order)
    factors = runs.groupBy(*KEY, "source", (F.col("at") - F.col("place")).alias("shift"), "run").agg(F.min("place").alias("first_word"), (F.max("place") - F.min("place") + WINDOW).alias("n_words"))
    one = F.struct("first_word", "n_words", "source", (F.col("first_word") + F.col("shift")).alias("source_word"))
    out = stored(factors.groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("factors")), "factors")
    discard(read)
    return out


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The parse's factors of 13 words or more: doc_id, first_word, n_words, and source and source_word where the same words stand first."""
    rows = keyed(docs, id_col, text_col)
    each = rows.select(*KEY).join(factored(rows), KEY)  # a repeated row has its factors again
    return each.select("doc_id", F.explode("factors").alias("f")).select("doc_id", "f.*")


def kept_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words and removed words of each row, and the words that stay, one space between them; columns 0-2 are text, first_words and n_words."""
    w = Words(*texts_of(batch.column(0)))
    begin, size = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (1, 2))
    per = batch.column(1).value_lengths().fill_null(0).to_numpy()
    begin = begin + np.repeat(w.first[:-1], per)
    mark = np.zeros(len(w) + 1, np.int64)
    np.add.at(mark, begin, 1)
    np.add.at(mark, begin + size, -1)
    gone = np.cumsum(mark)[:-1] > 0
    stay = np.append(0, np.cumsum(~gone))[w.first]
    length = np.diff(w.offsets)[~gone]
    before = np.cumsum(length) - length + np.arange(len(length))
    flat = np.full(int(length.sum()) + len(length), 32, np.uint8)
    flat[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = w.data[np.repeat(~gone, np.diff(w.offsets))]
    raw, ends = flat.tobytes(), np.append(before, len(flat))
    texts = [raw[ends[a] : max(ends[a], ends[b] - 1)] for a, b in zip(stay[:-1], stay[1:])]
    return w.counts, w.counts - np.diff(stay), texts


def parsed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """text, first_words, n_words (null without factors), doc_id of every row, and the columns to keep as k0, k1, ..."""
    rows = keyed(docs, id_col, text_col, keep)
    found = factored(rows).select(*KEY, F.col("factors.first_word").alias("first_words"), F.col("factors.n_words").alias("n_words"))
    return rows.join(found, KEY, "left").select("text", "first_words", "n_words", "doc_id", *(f"k{i}" for i in range(len(keep))))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n, gone, texts = kept_words(batch)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return parsed(docs, id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their columns, texts without their duplicate spans (texts without any stay as they are)."""
    keep = tuple(c for c in docs.columns if c not in (id_col, text_col))
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            _, gone, texts = kept_words(batch)
            old = batch.column(0)
            new = [x.decode("utf-8", "replace") if g else old[i].as_py() for i, (g, x) in enumerate(zip(gone, texts))]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), *batch.columns[3:]], ["text", "doc_id", *(f"k{i}" for i in range(len(keep)))])

    out = parsed(docs, id_col, text_col, keep).mapInArrow(run, ", ".join([f"text string, doc_id {kinds[id_col]}", *(f"k{i} {kinds[c]}" for i, c in enumerate(keep))]))
    names = {id_col: "doc_id", text_col: "text"} | {c: f"k{i}" for i, c in enumerate(keep)}
    return out.select(*(F.col(names[c]).alias(c) for c in docs.columns))
