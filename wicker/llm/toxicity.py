"""Toxicity of whole texts behind a noisy channel.

1. ``char_model`` counts character trigrams over every document (the table is bounded by the alphabet, not by the data).
2. ``Channel`` spells out, for a word or a run of single characters, the lattice of what may have been meant - letters
   for look-alike symbols, nothing for separators and for repeats of a letter (a second one at a price, more of them almost
   free), a border for a symbol kept - and Viterbi decoding under the trigram model picks the likeliest reading. A word
   without such characters has one path: itself. Two neighbours of up to four letters are also read as one word where the
   model finds that likelier than the two apart (``joined``).
3. ``fit`` learns a logistic model over words and word beginnings of the restored texts from labelled rows, at most
   ``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE`` of them (the ones with the smallest hashed ids); its intercept is then moved to the
   two classes' true shares, which one aggregate over all labels gives, so that a score doesn't depend on the caps.
4. ``scores`` restores and scores every whole text. Text is the only input.

Defined results: null and empty texts score as texts without evidence (the model's intercept); repeated rows and ids are
kept row by row; labels that are null are ignored; with no labelled rows of both classes every score is the share of
toxic rows, 0 without labels. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cuts, rows_where, sliced, spread, texts_of
from .segment import LETTERS, PUNCTUATION, Words

#: Most labelled rows of each class that the classifier is fitted on.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 1500
#: Word beginnings of these lengths are features, besides whole words.
BEGINNINGS = range(3, 8)
FEATURES = 6000

#: Classes of the character model: 0 whatever is no letter, a-z, then the 32 lower-case letters of the Latin-1 half.
K = 64
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "¡": "i", "€": "e", "£": "l", "¢": "c", "%": "o", "*": "aeiou", "#": "h", "?": "o", "&": "e",
}
SEPARATORS = set(" .-_*~'`,:;/\\=·•​‌‍⁠­﻿")
LOOK, KEEP, SPLIT, REPEAT, DOUBLE = math.log(0.3), math.log(0.0002), math.log(0.4), math.log(0.9), math.log(0.01)
#: Letters of the neighbours that may be one word.
SHORT = 4


def class_of(c: str) -> int:
    n = ord(c)
    return n - 96 if 97 <= n <= 122 else 27 + n - 0xE0 if 0xE0 <= n <= 0xFF and n != 0xF7 else 0


def classes(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each character of lower-cased text (characters outside Latin-1 take one class 0 a byte), and documents' new offsets."""
    table = np.zeros(256, np.uint32)
    table[97:123] = np.arange(1, 27)
    out = table[data]
    two = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    low = data[two]
    out[two] = np.where((low >= 0xA0) & (low != 0xB7), 27 + low.astype(np.int64) - 0xA0, 0)
    keep = np.ones(len(data), bool)
    keep[two - 1] = False
    return out[keep], np.append(0, np.cumsum(keep))[docs]


def trigrams(texts: pa.Array) -> np.ndarray:
    data, docs = texts_of(pc.utf8_lower(texts))
    c, docs = classes(data, docs)
    if len(c) < 3:
        return np.zeros(K**3, np.int64)
    at = c[:-2] * (K * K) + c[1:-1] * K + c[2:]
    own = np.ones(len(at), bool)
    for back in (1, 2):  # none over two documents
        ends = docs[1:] - back
        own[ends[(ends >= 0) & (ends < len(at))]] = False
    return np.bincount(at[own], minlength=K**3)


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probability of a class after two others (K x K x K), from trigram counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, np.int64)
        for batch in sliced(batches, text_col):
            total += trigrams(batch.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    counted = docs.select(text_col).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    t = np.zeros(K**3)
    t[counted["gram"].to_numpy(np.int64)] = counted["n"].to_numpy(float)
    return smoothed(t)


def smoothed(t: np.ndarray) -> np.ndarray:
    t = t.reshape(K, K, K)
    uni = (t.sum((0, 1)) + 1) / (t.sum() + K)
    two = t.sum(0)
    two = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
    return np.log((t + 5 * two[None]) / (t.sum(2, keepdims=True) + 5)).astype(np.float32)


class Channel:
    """Viterbi decoding of character lattices under the character model."""

    def __init__(self, model: np.ndarray):
        self.lm = model.ravel().tolist()
        self.table = model
        self.memo: dict[str, str] = {}

    @staticmethod
    def noisy(word: str) -> bool:
        """Whether the lattice of the word has more than one path."""
        if word.isalpha():
            return any(word[i] == word[i - 1] for i in range(1, len(word)))
        return any(c.isalpha() for c in word) or sum(c in LOOKALIKES for c in word) > 2

    def restore(self, word: str) -> str:
        """Likeliest reading of a lower-case word or run; borders are blanks."""
        found = self.memo.get(word)
        if found is not None:
            return found
        lm = self.lm
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i, c in enumerate(word):
            ways: list[tuple[int, str, float]] = []
            twice = i > 0 and word[i - 1] == c
            run = twice and (i > 1 and word[i - 2] == c or i + 1 < len(word) and word[i + 1] == c)
            if c.isalpha():
                ways.append((class_of(c), c, 0.0))
            else:
                ways += [(class_of(x), x, LOOK) for x in LOOKALIKES.get(c, "")]
                ways.append((0, " ", KEEP if c in LOOKALIKES else SPLIT))
            if twice and c.isalpha() or run or c in SEPARATORS:
                ways.append((-1, "", REPEAT if run else DOUBLE if twice and c.isalpha() else SPLIT))
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (s, text) in states.items():
                for k, x, cost in ways:
                    if k < 0 or k == 0 and b == 0 and x == " ":
                        key, score, said = (a, b), s + cost, text
                    else:
                        key, score, said = (b, k), s + cost + lm[a * 4096 + b * 64 + k], (text, x)
                    old = new.get(key)
                    if old is None or score > old[0]:
                        new[key] = (score, said)
            states = new
        best = max(((s + lm[a * 4096 + b * 64], text) for (a, b), (s, text) in states.items()), key=lambda x: x[0])[1]
        out = []
        while best:
            best, x = best
            out.append(x)
        result = "".join(reversed(out))
        if len(self.memo) > 200_000:
            self.memo.clear()
        if len(word) < 100:
            self.memo[word] = result
        return result


def restored_words(texts: pa.Array, channel: Channel) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document, word code) of every word of the restored texts, each word also as it stood, and the distinct words."""
    w = Words(*texts_of(pc.utf8_lower(texts)))
    codes, distinct = w.distinct()
    core = pc.utf8_trim(distinct, PUNCTUATION)
    clean = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
    bare = pc.equal(pc.binary_length(core), pc.binary_length(distinct)).to_numpy(zero_copy_only=False)
    short = pc.less_equal(pc.utf8_length(pc.utf8_rtrim(distinct, ".,;:!?")), 1).to_numpy(zero_copy_only=False)
    twice = pc.match_substring_regex(core, DOUBLED).to_numpy(zero_copy_only=False)
    names: dict[str, int] = {}
    plain = core.dictionary_encode()
    for x in plain.dictionary.to_pylist():
        names[x] = len(names)
    lists: list[tuple[int, ...]] = []
    as_is = plain.indices.to_numpy()
    extra: dict[int, tuple[int, ...]] = {}
    usual = clean & (bare | pc.match_substring_regex(distinct, PLAIN).to_numpy(zero_copy_only=False))
    letters, ends = classes(*texts_of(core))
    odd = ~usual
    odd[np.flatnonzero(usual & twice)] = worth_decoding(letters, ends, np.flatnonzero(usual & twice), channel.table)
    for i, x, own in zip(np.flatnonzero(odd).tolist(), distinct.filter(pa.array(odd)).to_pylist(), core.filter(pa.array(odd)).to_pylist()):
        x = own if usual[i] else x
        if Channel.noisy(x):
            words = {y for y in channel.restore(x).split() if len(y) > 2}
            extra[i] = tuple(names.setdefault(y, len(names)) for y in sorted(words))
    doc = np.repeat(np.arange(len(texts)), w.counts)
    out_doc, out_code = [doc], [as_is[codes]]
    if extra:
        keys = np.fromiter(extra, np.int64, len(extra))
        size = np.zeros(len(distinct), np.int64)
        size[keys] = [len(x) for x in extra.values()]
        head = np.zeros(len(distinct), np.int64)
        head[keys] = np.cumsum(size[keys]) - size[keys]
        pool = np.fromiter((y for x in extra.values() for y in x), np.int64, int(size.sum()))
        hit = np.flatnonzero(size[codes])
        c = codes[hit]
        out_doc.append(np.repeat(doc[hit], size[c]))
        out_code.append(pool[spread(head[c], size[c])])
    # runs of three or more words of one character each
    one = np.append(np.append(False, short[codes]), False)
    one[1:-1][w.first[1:-1][w.first[1:-1] < len(codes)]] &= True
    edge = np.zeros(len(codes) + 1, bool)
    edge[w.first] = True
    start = np.flatnonzero(one[1:-1] & (~one[:-2] | edge[:-1]))
    stop = np.flatnonzero(one[1:-1] & (~one[2:] | edge[1:])) + 1
    for a, b in zip(start.tolist(), stop.tolist()):
        if b - a >= 3:
            run = " ".join(distinct.take(pa.array(codes[a:b])).to_pylist())
            words = sorted({y for y in channel.restore(run).split() if len(y) > 2})
            out_doc.append(np.full(len(words), doc[a]))
            out_code.append(np.array([names.setdefault(y, len(names)) for y in words], np.int64))
    # neighbours of a few letters each that are likelier one word, the lost border at a separator's cost
    size = np.diff(ends)
    brief = clean & (size > 0) & (size <= SHORT)
    pair = np.flatnonzero(brief[codes[:-1]] & brief[codes[1:]] & ~edge[1:-1]) if len(codes) else np.zeros(0, np.int64)
    left, right = codes[pair], codes[pair + 1] if len(pair) else codes[pair]
    gain = one_word(letters, ends, left, right, channel.table) + SPLIT
    good = (gain > 0) & (size[left] + size[right] > 3)
    kinds, which = np.unique(left[good].astype(np.int64) * len(distinct) + right[good], return_inverse=True)
    firsts, seconds = (core.take(pa.array(x)).to_pylist() for x in (kinds // max(1, len(distinct)), kinds % max(1, len(distinct))))
    read = np.array([names.setdefault(x + y, len(names)) for x, y in zip(firsts, seconds)], np.int64)
    out_doc.append(doc[pair[good]])
    out_code.append(read[which] if len(read) else read)
    return np.concatenate(out_doc), np.concatenate(out_code).astype(np.int64), list(names)


def near_by(c: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Classes at the given places, 0 (a border) outside of their words."""
    return np.where((at >= start) & (at < end), c[np.clip(at, 0, max(0, len(c) - 1))], 0) if len(c) else np.zeros(len(at), np.int64)


def worth_decoding(c: np.ndarray, ends: np.ndarray, words: np.ndarray, lm: np.ndarray) -> np.ndarray:
    """Of words with a doubled letter, those that the model finds likelier without one, at its price, or that have three in a row.

    The trigrams around the letter say so; in all other words Viterbi decoding would keep every letter.
    """
    size = np.diff(ends)[words]
    start = np.repeat(ends[words], size)
    at, stop, own = spread(ends[words], size), np.repeat(ends[words + 1], size), np.repeat(np.arange(len(words)), size)
    x = [near_by(c, at + k, start, stop).astype(np.int64) for k in range(-2, 3)]
    twice = (x[1] == x[2]) & (x[2] > 0)
    inside = x[3] > 0
    old = lm[x[0], x[1], x[2]] + lm[x[1], x[2], x[3]] + np.where(inside, lm[x[2], x[3], x[4]], 0)
    new = lm[x[0], x[1], x[3]] + np.where(inside, lm[x[1], x[3], x[4]], 0)
    good = twice & ((new - old + DOUBLE > 0) | (x[0] == x[2]))
    return np.bincount(own[good], minlength=len(words)) > 0


def one_word(c: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, lm: np.ndarray) -> np.ndarray:
    """How much likelier each two words are as one word than apart: only the trigrams over their border differ."""
    s, e, t, u = ends[left], ends[left + 1], ends[right], ends[right + 1]
    p, q = near_by(c, e - 2, s, e).astype(np.int64), near_by(c, e - 1, s, e).astype(np.int64)
    x, y = near_by(c, t, t, u).astype(np.int64), near_by(c, t + 1, t, u).astype(np.int64)
    return lm[p, q, x] + lm[q, x, y] - lm[p, q, 0] - lm[q, 0, x] - lm[0, x, y]


#: Words of letters between usual punctuation; three or more of one symbol at the end are a border, not letters.
PLAIN = r"^[^[:punct:]]+[.,;:!?)\"']*(" + "|".join(f"\\{c}{{3,}}" for c in "$&%*#@!~=_+-") + r")?[.,;:!?)\"']*$"
DOUBLED = "|".join(f"{c}{c}" for c in LETTERS if c == c.lower() and ord(c) < 256)


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) >= k)] if len(word) > 2 else []


class Judge:
    """Logistic model over words and word beginnings; a feature counts once a document."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.names, self.bias = {f: i for i, f in enumerate(weights)}, bias
        self.weights = np.array(list(weights.values()))
        self.heads = {f[:3] for f in weights if f[0] != "="} | {f[1:4] for f in weights if f[0] == "="}

    def score(self, n: int, doc: np.ndarray, code: np.ndarray, words: list[str]) -> np.ndarray:
        lists, size = [], np.zeros(len(words), np.int64)
        for i, x in enumerate(words):
            if x[:3] in self.heads:
                own = [self.names[f] for f in features(x) if f in self.names]
                if own:
                    size[i] = len(own)
                    lists += own
        head = np.cumsum(size) - size
        hit = size[code] > 0
        doc, code = doc[hit], code[hit]
        pairs = np.unique(np.repeat(doc, size[code]) * max(1, len(self.names)) + np.array(lists, np.int64)[spread(head[code], size[code])]) if len(code) else np.zeros(0, np.int64)
        total = np.full(n, self.bias)
        if len(pairs):
            total += np.bincount(pairs // len(self.names), self.weights[pairs % len(self.names)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, channel: Channel, rounds: int = 300, shares: tuple[int, int] | None = None) -> Judge:
    """Choose features by their log-odds evidence and fit weights by gradient descent with an L2 penalty; shares are the
    toxic and clean rows that the given ones stand for, if others."""
    pos, neg = int(labels.sum()), int((1 - labels).sum())
    if not pos or not neg:
        rate = pos / max(1, pos + neg)
        return Judge({}, math.log((rate + 1e-6) / (1 - rate + 1e-6)) if pos + neg else -30.0)
    seen: dict[str, int] = {}
    found = []
    whole = pa.array(texts, pa.large_string())
    for i, j in cuts(whole, 1 << 20):  # slice by slice, as the driver's memory is small
        doc, code, words = restored_words(whole.slice(i, j - i), channel)
        pairs = np.unique(doc * len(words) + code)
        doc, code = pairs // len(words), pairs % len(words)
        size, flat = np.zeros(len(words), np.int64), []
        for k, x in enumerate(words):
            own = [seen.setdefault(f, len(seen)) for f in features(x)]
            size[k] = len(own)
            flat += own
        head = np.cumsum(size) - size
        own = np.array(flat, np.int32)[spread(head[code], size[code])]
        found.append(np.unique(np.repeat((doc + i) << 32, size[code]) | own))
    pairs = np.concatenate(found)
    doc, feature = pairs >> 32, pairs & 0xFFFFFFFF
    ones = np.bincount(feature[labels[doc] == 1], minlength=len(seen)).astype(float)
    zeros = np.bincount(feature[labels[doc] == 0], minlength=len(seen)).astype(float)
    odds = np.log((ones + 0.5) / (pos + 1)) - np.log((zeros + 0.5) / (neg + 1))
    worth = np.where(ones + zeros >= 4, np.abs(odds) * np.sqrt(ones + zeros) * (odds > 1), 0)
    chosen = np.argsort(-worth, kind="stable")[:FEATURES]
    chosen = chosen[worth[chosen] > 0]
    names = list(seen)
    at = np.full(len(seen), -1)
    at[chosen] = np.arange(len(chosen))
    use = at[feature] >= 0
    doc, feature = doc[use], at[feature[use]]
    w, b, n = np.zeros(len(chosen)), math.log(pos / neg), len(labels)
    step = np.ones(len(chosen)) * 1e-8
    for _ in range(rounds):  # diagonally scaled gradient
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[feature], minlength=n), -30, 30)))
        g = np.bincount(feature, (p - labels)[doc], minlength=len(w)) + 0.02 * w
        step += g * g
        w -= 0.3 * g / np.sqrt(step)
        b -= 0.5 * (p - labels).mean() / max(1e-3, (p * (1 - p)).mean())
    if shares and min(shares):
        b += math.log(shares[0] / shares[1]) - math.log(pos / neg)
    return Judge({names[i]: float(x) for i, x in zip(chosen.tolist(), w)}, float(b))


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y) of usable labels, each once."""
    return labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)").distinct()


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Labelled texts, at most TOXIC_SAMPLE and CLEAN_SAMPLE of each class, by smallest hashed id; ids first, texts afterwards.

    Of rows with one id and label one is taken, that with the smallest hashed text, so that repeats don't lift the bound.
    """
    known, ids = labelled(labels, id_col, label_col), None
    for y, most in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")
    return rows.groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_id", "_text", "_y")


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", counted: DataFrame | None = None) -> tuple[np.ndarray, Judge]:
    """Character model of all documents (or of ``counted``) and classifier of the labelled ones."""
    model = char_model(docs if counted is None else counted, text_col)
    rows = sample(docs, labels, id_col, text_col, label_col).orderBy("_id", "_text").toArrow()
    y = rows["_y"].to_numpy().astype(np.int64)
    counts = {r[0]: r[1] for r in labelled(labels, id_col, label_col).groupBy("_y").count().collect()}
    # a class below its cap is in the sample as a whole; of one above it the labels' count says how many rows there are
    caps = {1: TOXIC_SAMPLE, 0: CLEAN_SAMPLE}
    shares = tuple(int((y == k).sum()) * max(1.0, counts.get(k, 0) / caps[k]) for k in (1, 0))
    return model, fit(rows["_text"].fill_null("").to_pylist(), y, Channel(model), shares=shares)


def scores(docs: DataFrame, model: np.ndarray, judge: Judge, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id and score of every row (plus the columns in ``keep``); the model is a fixed-size table, the classifier at most FEATURES weights."""
    shared = docs.sparkSession.sparkContext.broadcast((model, judge))
    kept = keep or []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scored(batch.column(1), *shared.value)), *(batch.column(2 + i) for i in range(len(kept)))], ["doc_id", "score", *kept])

    kinds = dict(docs.dtypes)
    return arrow_map(docs, [id_col, text_col, *kept], run, ", ".join([f"doc_id {kinds[id_col]}", "score double", *(f"`{k}` {kinds[k]}" for k in kept)]), text_col)


_last: list = [None, None]


def scored(texts: pa.Array, table: np.ndarray, judge: Judge) -> np.ndarray:
    """Scores; the channel of the table before is kept, and known by the table itself, which it holds on to."""
    if _last[0] is not table:
        _last[:] = [table, Channel(table)]
    return judge.score(len(texts), *restored_words(pc.fill_null(texts, ""), _last[1]))


def accepted(docs: DataFrame, model: np.ndarray, judge: Judge, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below ``reject``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, judge))
    return rows_where(docs, text_col, lambda texts: scored(texts, *shared.value) < reject)
