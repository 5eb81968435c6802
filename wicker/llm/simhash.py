"""SimHash near-duplicates through a byte-position inverted index with count filtering.

``fingerprints`` takes lower-cased (A-Z only) word shingles, repeats included, hashed by XXH64 with seed 42. Two
fingerprints that differ in at most ``radius`` bits agree in at least ``bytes - radius`` byte positions, as a differing bit
spoils one byte: that is the guaranteed minimum of the count filter. The index lists fingerprints by the bytes at every
set of so many positions, so that two meet where, and only where, their tally of equal positional bytes reaches the
minimum; those that meet are verified by their differing bits. (4 of 8 positions: 32-bit keys, so lists stay short until
there are billions of fingerprints.)

``similar`` serves a similarity of shingle sets instead of a number of bits. At 0.8 some 15 % of the bits differ, and no
number of equal bytes is guaranteed; it is only sure enough. A text has 64 bytes over its distinct shingles, of which 17
(sigma 3.5) are equal at 0.8. A list holds the texts with the same byte at one position and the same smallest shingle
under one of ``MINS`` hashes (each serves four positions): a coordinate that two texts share with a probability equal to
their similarity, so that lists don't fill up with texts that share a byte by chance, however many there are. A pair's
tally is the number of lists in which it meets, 14 on average at 0.8; pairs with ``TALLY`` or more go on (a pair at 0.8
misses that with a probability of some 0.001). The bits of short texts are too coarse for this: those of at most SHORT
shingles are also listed by their smallest shingles, one of which any two that are similar share for sure, and which
counts as a whole tally. Every candidate pair becomes a link only by the exact similarity (common to all distinct
shingles) of its two sets. Texts with one set are one class; two texts without any word are alike.

Both work in two rounds, so that no list gives all its pairs. The first compares the rows of a list with the one of
the smallest id only; what is linked so far makes components. The second compares rows of different components alone - few, where many
copies of one text differ a little. Lists of more than ``LIST`` rows are given out in pieces of so many, and each two
pieces meet in a task of their own, if their list still has several components.

Rows with one fingerprint (or one set) are one class before anything is indexed. Defined results: null and empty texts have
fingerprint 0 and link like any other; repeated rows and ids are kept row by row and share a component; fewer words than a
shingle make one shingle of all; ids must be integers (anything else is refused by name); an empty table gives an empty
result; null ids get a fingerprint and no component. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, integers, spread, stored, texts_of
from .components import components
from .segment import joined
from .xxh import xxh64

#: Rows of a list that one task compares.
LIST = 4096
#: Shingles of a text that is listed by shingles too.
SHORT = 50
#: Of 128 bits, what may differ in a candidate pair (at 0.8: 19.4, sigma 4.1), and in one of short texts (24, sigma 4.4).
NEAR, NEAR_SHORT = 36, 46
#: Hashes whose smallest shingles are coordinates of lists, and the lists in which a candidate pair meets at least.
MINS, TALLY = 16, 3
_mix = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def widened(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from a hash; word 0 is the hash itself."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        x = h + _mix[2] * np.uint64(word)
        x = (x ^ (x >> np.uint64(30))) * _mix[0]
        x = (x ^ (x >> np.uint64(27))) * _mix[1]
        return x ^ (x >> np.uint64(31))


def shingles(data: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and each text's first (one more than texts)."""
    low = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
    flat, start, end, first = joined(low, docs)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    head = spread(first[:-1], count)
    last = head + np.repeat(np.minimum(np.maximum(n, 1), width) - 1, count)
    return (xxh64(flat, start[head], end[last]) if len(head) else np.zeros(0, np.uint64)), np.append(0, np.cumsum(count))


def simhash(h: np.ndarray, first: np.ndarray, words: int = 1) -> np.ndarray:
    """texts x words fingerprint: bits set in over half of a text's hashes."""
    n = len(first) - 1
    ones = np.zeros((n, 64 * words), np.int32)
    step = 1 << 19
    for a in range(0, len(h), step):
        part = h[a : a + step]
        lo, hi = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, a + len(part), "left")
        heads = np.maximum(first[lo:hi], a) - a
        own = np.flatnonzero(np.diff(np.append(heads, len(part))) > 0)
        for w in range(words):
            bits = np.unpackbits(widened(part, w)[:, None].view(np.uint8), axis=1, bitorder="little")
            ones[lo + own, 64 * w : 64 * w + 64] += np.add.reduceat(bits, heads[own], axis=0, dtype=np.int32)
    over = 2 * ones > np.diff(first)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(n, words)


def fingerprints(docs: DataFrame, width: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint's 64-bit words f0, f1, ... of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = simhash(*shingles(*texts_of(batch.column(1)), width), words)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[:, w].view(np.int64)) for w in range(words))], ["doc_id", *(f"f{w}" for w in range(words))])

    return arrow_map(docs, [id_col, text_col], run, ", ".join([f"doc_id {dict(docs.dtypes)[id_col]}", *(f"f{w} long" for w in range(words))]), text_col)


def cover(positions: int, least: int) -> list[tuple[int, ...]]:
    """All sets of ``least`` positions: two fingerprints with that many equal bytes agree in one of them, others in none."""
    return list(combinations(range(positions), least))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the links a-b between 0..n-1, those that join what was apart."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def distinct_shingles(data: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(), each hash once a text, ascending."""
    h, first = shingles(data, docs, width)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))[: len(h)]
    return h[new], np.append(0, np.cumsum(np.bincount(own[new], minlength=len(first) - 1)))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set of hashes."""
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(widened(h, 101), dtype=np.uint64))
        return widened((total[first[1:]] - total[first[:-1]]) ^ widened(np.diff(first).astype(np.uint64), 102), 103)


def leading(n: np.ndarray, similarity: float) -> np.ndarray:
    """Smallest shingles of which sets of n and of any other size share one if they are similar; none for longer texts."""
    return np.where((n > 0) & (n <= SHORT), n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def pairs_of(length: np.ndarray, head: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each list, about ``most`` at once."""
    row = spread(head, length)
    after = np.repeat(head + length, length) - row - 1
    total = np.cumsum(after)
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield np.repeat(row[i:j], after[i:j]), spread(row[i:j] + 1, after[i:j])
        i = j


ROW = "key long, id long, f0 long, f1 long, label long"
MET = "a long, b long, n int, key long, piece int, id long, f0 long, f1 long, label long"
#: kept(i, j, key, f): which of the pairs (rows i, j of one list) may be links.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of whole lists (piece -1), or of pieces of a list longer than LIST, numbered from 0; batches are sorted by key."""
    held, piece, open_key = np.zeros((0, 5), np.int64), -1, 0  # rows not given yet; of a long list, the last piece given
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], 1)])
        while len(rows):
            key = rows[:, 0]
            stop = int(np.searchsorted(key, key[0], "right"))
            if piece >= 0 and key[0] != open_key:
                piece = -1
            if stop > LIST or piece >= 0 and (stop == LIST or stop < len(rows)):  # a piece of a long list
                piece, open_key = piece + 1, key[0]
                yield rows[: min(stop, LIST)], piece
                rows = rows[min(stop, LIST) :]
                continue
            if piece >= 0:
                break
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            long = np.flatnonzero(np.diff(np.append(head, len(rows))) > LIST)
            cut = int(head[long[0]]) if len(long) else int(head[-1])  # the last list may go on
            if not cut:
                break
            yield rows[:cut], -1
            rows = rows[cut:]
        held = rows
    if len(held):
        yield held, piece + 1 if piece >= 0 and held[0, 0] == open_key else -1


def meetings(rows: np.ndarray, i: np.ndarray, j: np.ndarray, judge: Judge) -> pa.RecordBatch:
    """The rows' pairs that differ in their label and that the judge keeps, with the weight of their list in the tally."""
    far = rows[i, 4] != rows[j, 4]
    i, j = i[far], j[far]
    fine = judge(i, j, rows[:, 0], np.ascontiguousarray(rows[:, 2:4]).view(np.uint64))
    i, j = i[fine], j[fine]
    n = np.where(rows[i, 0] < 0, TALLY, 1).astype(np.int32)
    none = pa.nulls(len(i), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(rows[i, 1], rows[j, 1])), pa.array(np.maximum(rows[i, 1], rows[j, 1])), pa.array(n), none, pa.nulls(len(i), pa.int32()), none, none, none, none], MET_NAMES)


MET_NAMES = [x.split()[0] for x in MET.split(", ")]


def met(posted: DataFrame, judge: Judge, stars: bool) -> DataFrame:
    """(a, b, n): pairs of ids that meet in lists, each once, with their tally; stars: only pairs with the smallest id of a list or piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, piece in in_lists(batches):
            head = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            length = np.diff(np.append(head, len(rows)))
            if stars:
                least = np.repeat(np.minimum.reduceat(rows[:, 1], head), length)
                first = np.flatnonzero(rows[:, 1] == least)  # the smallest id, the same one wherever it is met
                first = first[np.searchsorted(first, head)]
                yield meetings(rows, np.repeat(first, length), np.arange(len(rows)), judge)
                continue
            if piece >= 0:
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(rows), pa.int32()), pa.array(rows[:, 0]), pa.array(np.full(len(rows), piece, np.int32)), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(1, 5))], MET_NAMES)
                continue
            several = np.minimum.reduceat(rows[:, 4], head) != np.maximum.reduceat(rows[:, 4], head)
            for i, j in pairs_of(length[several], head[several]):
                yield meetings(rows, i, j, judge)

    out = posted.repartition("key").sortWithinPartitions("key").mapInArrow(run, MET)
    tally = lambda df: df.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").cast("int").alias("n"))
    if stars:
        return stored(tally(out), "stars")
    out = stored(out, "met")
    long = out.where("a IS NULL").select("key", "piece", "id", "f0", "f1", "label")
    if long.isEmpty():
        return tally(out)
    mixed = long.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), (F.max("piece") + 1).alias("pieces")).where("low <> high").select("key", "pieces")
    spread_ = long.join(mixed, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    both = spread_.select("key", F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y"), "id", "f0", "f1", "label", "piece")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 8), np.int64)
        for batch in chained(batches):
            if batch is not None:
                held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            at = np.flatnonzero(np.append(True, np.any(held[1:, :3] != held[:-1, :3], axis=1))[: len(held)])
            ends = np.append(at[1:], len(held)) if batch is None else at[1:]
            for lo, hi in zip(at[: len(ends)].tolist(), ends.tolist()):
                block = held[lo:hi]
                rows, piece = block[:, [0, 3, 4, 5, 6]], block[:, 7]
                for i, j in pairs_of(np.array([len(rows)]), np.array([0])):
                    # pairs inside a piece belong to the task where it meets itself
                    own = (piece[i] != piece[j]) | (block[0, 1] == block[0, 2])
                    yield meetings(rows, i[own], j[own], judge)
            held = held[int(ends[-1]) :] if len(ends) else held

    wide = both.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(across, MET)
    return tally(out.where("a IS NOT NULL").unionByName(wide))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None behind the last."""
    yield from batches
    yield None


def linked(known: DataFrame, post: Callable[[DataFrame], DataFrame], judge: Judge, least: int, checked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect all ids of known that judged and checked pairs connect; post gives ROW for known with its label."""
    one = stored(checked(met(post(known.withColumn("label", F.col("id"))), judge, True).where(F.col("n") >= least)), "links")
    roots = stored(components(one), "roots")
    label = known.join(roots.withColumnsRenamed({"node": "id", "root": "label"}), "id", "left").withColumn("label", F.coalesce("label", "id"))
    two = checked(met(post(stored(label, "labelled")), judge, False).where(F.col("n") >= least))
    return one.select("a", "b").unionByName(two.select("a", "b"))


def by_positions(words: int, least: int) -> Callable[[DataFrame], DataFrame]:
    """ROW by all sets of ``least`` of the fingerprint's byte positions; rows have id, f0, ... and label."""
    sets = cover(8 * words, least)
    names = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5_000):
                part = batch.slice(i, 5_000)
                f = np.stack([c.to_numpy() for c in part.columns[2:]], 1)
                at = np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1).astype(np.int64)
                key = np.empty((len(sets), len(f)), np.int64)
                for k, s in enumerate(sets):
                    key[k] = k
                    for p in s:
                        key[k] = key[k] << 8 | at[:, p]
                own = np.tile(np.arange(len(f)), len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column(0).take(pa.array(own)), pa.array(f[own, 0]), pa.array(f[own, min(1, words - 1)]), part.column(1).take(pa.array(own))], ["key", "id", "f0", "f1", "label"])

    return lambda rows: rows.select("id", "label", *names).mapInArrow(run, ROW)


def minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """texts x MINS: each text's smallest hash under every one of MINS orders; 0 for texts without any."""
    out = np.zeros((len(first) - 1, MINS), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for m in range(MINS):
            out[some, m] = np.minimum.reduceat(widened(h, 200 + m), first[some])
    return out


def set_prints(docs: DataFrame, width: int, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the set's signature, the fingerprint's words, the set's minima and a short text's leading shingles, of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = distinct_shingles(*texts_of(batch.column(1)), width)
        f = np.concatenate([np.zeros((0, words), np.uint64), *(simhash(h[first[i] : first[min(i + 4096, len(first) - 1)]], first[i : i + 4097] - first[i], words) for i in range(0, len(first) - 1, 4096))])
        lead, n = leading(np.diff(first), similarity), len(first) - 1
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lead)).astype(np.int32)), pa.array(h[spread(first[:-1], lead)].view(np.int64)))
        least = pa.ListArray.from_arrays(pa.array(np.arange(0, MINS * n + 1, MINS).astype(np.int32)), pa.array(minima(h, first).ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(signatures(h, first).view(np.int64)), *(pa.array(np.ascontiguousarray(f[:, w]).view(np.int64)) for w in range(words)), least, lists], ["doc_id", "row", "sig", *(f"f{w}" for w in range(words)), "mins", "lead"])

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    return arrow_map(named, ["doc_id", "text", "row"], run, ", ".join([f"doc_id {dict(docs.dtypes)[id_col]}, row long, sig long", *(f"f{w} long" for w in range(words)), "mins array<long>, lead array<long>"]), "text")


def by_bytes(words: int) -> Callable[[DataFrame], DataFrame]:
    """ROW by single bytes with a smallest shingle each (keys of 0 and more), and by a short text's leading shingles (below 0)."""
    names = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5_000):
                part = batch.slice(i, 5_000)
                f = np.stack([c.to_numpy() for c in part.columns[4:]], 1)
                at = np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1).astype(np.uint64)
                mins = part.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, MINS)
                with np.errstate(over="ignore"):
                    key = [widened(mins[:, p % MINS] + (np.uint64(p << 8) | at[:, p]) * _mix[0], 301) >> np.uint64(1) for p in range(8 * words)]
                lists = part.column(3)
                key = np.concatenate([np.concatenate(key).view(np.int64), lists.flatten().to_numpy() | np.int64(-1 << 63)])
                own = np.append(np.tile(np.arange(len(f)), 8 * words), np.repeat(np.arange(len(f)), lists.value_lengths().to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(own)), pa.array(f[own, 0]), pa.array(f[own, 1]), part.column(1).take(pa.array(own))], ["key", "id", "f0", "f1", "label"])

    return lambda rows: rows.select("id", "label", "mins", "lead", *names).mapInArrow(run, ROW)


def within(radius: int) -> Judge:
    """Pairs whose fingerprints of one word differ in at most so many bits."""
    return lambda i, j, key, f: np.bitwise_count(f[i, 0] ^ f[j, 0]) <= radius


def near(i: np.ndarray, j: np.ndarray, key: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Pairs that may be similar by the first 128 bits of their fingerprints."""
    return np.bitwise_count(f[i] ^ f[j]).sum(-1) <= np.where(key[i] < 0, NEAR_SHORT, NEAR)


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose sets of distinct shingles are at least so similar; reps names a document for each signature."""
    need = stored(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(reps, "sig"), "need")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = distinct_shingles(*texts_of(batch.column(1)), width)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(signatures(h, first).view(np.int64)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))], ["rep", "sig", "h"])

    named = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("_t")).join(need.select("rep").distinct(), "rep", "left_semi")
    sets = arrow_map(named, ["rep", "_t"], run, f"rep {dict(docs.dtypes)[id_col]}, sig long, h array<long>", "_t")
    sets = stored(sets.join(need, ["rep", "sig"], "left_semi").drop("rep").dropDuplicates(["sig"]), "sets")
    sizes = sets.select("sig", F.size("h").alias("n"))
    n, m = sizes.withColumnsRenamed({"sig": "a", "n": "n"}), sizes.withColumnsRenamed({"sig": "b", "n": "m"})
    likely = pairs.join(n, "a").join(m, "b").where(F.least("n", "m") + 1e-9 >= similarity * F.greatest("n", "m"))
    both = likely.join(sets.withColumnsRenamed({"sig": "a", "h": "ha"}), "a").join(sets.withColumnsRenamed({"sig": "b", "h": "hb"}), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(common + 1e-9 >= similarity * (F.col("n") + F.col("m") - common)).select("a", "b")


def similar(docs: DataFrame, width: int, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (the text's hash), root (which tells components apart), f0, ... and component_id of every row; a link is a pair of texts that are similar by their shingle sets."""
    names = [f"f{w}" for w in range(words)]
    prints = stored(set_prints(docs, width, words, similarity, id_col, text_col), "prints")
    classes = stored(prints.groupBy("sig").agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in [*names, "mins", "lead"])), "classes")
    known = classes.where("rep IS NOT NULL")
    reps = known.select("sig", "rep")
    checked = lambda pairs: stored(verified(docs, stored(pairs.select("a", "b"), "pairs"), reps, width, similarity, id_col, text_col), "checked")
    links = linked(known.withColumnRenamed("sig", "id"), by_bytes(words), near, TALLY, checked)
    roots = components(links)
    named = stored(reps.join(roots, reps["sig"] == roots["node"], "left").select("sig", "rep", F.coalesce("root", "sig").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("sig", "root", "component_id")
    return prints.join(named, "sig", "left").select("doc_id", "row", "root", *names, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def survivors(docs: DataFrame, width: int = 5, words: int = 8, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which one of each component stays: that with the smallest id, of one id's rows that
    with the smaller hash of its text, and of equal rows any one. Rows without an id stay."""
    integers(docs, id_col)
    found = stored(similar(docs, width, words, similarity, id_col, text_col).where("doc_id IS NOT NULL").select("doc_id", "row", "root"), "components")
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("best"))
    gone = found.join(best, "root").where(F.struct("doc_id", "row") != F.col("best")).select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")).distinct()
    rows = docs.withColumn("_own_row", F.xxhash64(text_col))
    rows = rows.join(gone, (F.col(id_col) == F.col("_gone_id")) & (F.col("_own_row") == F.col("_gone_row")), "left_anti")
    twice = stored(found.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")), "twice")
    if not twice.isEmpty():
        on = (F.col(id_col) == F.col("_gone_id")) & (F.col("_own_row") == F.col("_gone_row"))
        rows = rows.join(twice, on, "left_anti").unionByName(rows.join(twice, on, "left_semi").dropDuplicates([id_col, "_own_row"]))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(docs: DataFrame, width: int = 5, words: int = 8, radius: int | None = None, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f0, ... and component_id (smallest id reachable, itself included) of every row.

    With a radius, links are by bits of one 64-bit word; without one, as in the pipeline, they are by the similarity of five-word shingle sets.
    """
    integers(docs, id_col)
    if radius is None:
        return similar(docs, width, words, similarity, id_col, text_col).drop("row", "root")
    if words != 1 or not 0 < radius < 8:
        raise ValueError("a radius is for fingerprints of one word, and leaves a byte equal")
    prints = stored(fingerprints(docs, width, 1, id_col, text_col), "prints")
    classes = stored(prints.groupBy("f0").agg(F.min("doc_id").alias("id")), "classes")
    known = classes.where("id IS NOT NULL")
    # a pair meets once for each set of positions in which it agrees, so meeting at all is the guaranteed tally
    links = linked(known.select(F.col("id").cast("long").alias("id"), "f0"), by_positions(1, 8 - radius), within(radius), 1, lambda pairs: pairs.select("a", "b"))
    roots = components(links)
    named = classes.join(roots, classes["id"] == roots["node"], "left").select("f0", F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, "f0").select("doc_id", "f0", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
