"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's letters, lower-cased, with one blank between words, give byte 2-, 3- and 4-grams that may touch a blank only at
their ends; each hashes to a row of an embedding table, their mean goes through a linear softmax. Both are trained by
stochastic gradient descent in numpy on at most ``SAMPLE`` labelled rows (those with the smallest hashed ids, or a given
share). A fifth of them is set aside for two things (``calibrated``): the temperature of the softmax, so that a score is the
probability that the prediction is right, and the score below which rows are rejected (``accepted`` false). That one is the
least at which nineteen of twenty texts of no language (those set aside, each with its letters shuffled) and all but one in
a hundred wrong predictions fall below, but at most what 998 of 1,000 right predictions reach: clean rows come first. As
the mean of embeddings is followed by a linear map only, prediction adds up the rows' products with it.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; rows without a language teach
nothing; with no labelled row every prediction is ``und`` with score 0; repeated rows and ids are kept row by row; whole
texts count, however long. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cuts, rows_where, texts_of

BUCKETS, DIMENSIONS, GRAMS = 1 << 15, 16, (2, 3, 4)
#: Most labelled rows that the model is trained on.
SAMPLE = 3000
#: Shares that the rejection is calibrated for: texts of no language rejected, wrong predictions among accepted, right ones lost.
NOISE, WRONG, LOST = 0.95, 0.01, 0.002
LETTER = regex.compile(r"\p{L}")
_table = np.full(256, 32, np.uint8)
_table[97:123] = np.arange(97, 123)
_table[128:] = np.arange(128, 256)


def spelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of letters and other non-ASCII characters, one blank around each word, and texts' offsets."""
    data, docs = texts_of(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(docs) - 1
    out = np.full(len(data) + n, 32, np.uint8)  # a blank before each text
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(docs))] = _table[data]
    docs = docs + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[docs[:-1]] = True
    return out[keep], np.append(0, np.cumsum(keep))[docs]


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; BUCKETS where a blank is inside. The last n - 1 places are left out."""
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    inside = np.zeros(m, bool)
    for k in range(n):
        x = c[k : k + m]
        h ^= x
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        if 0 < k < n - 1:
            inside |= x == 32
    if n == 2:
        inside = (c[:m] == 32) & (c[1 : 1 + m] == 32)
    out = (h >> np.uint32(17)).astype(np.int32)
    out[inside] = BUCKETS
    return out


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, heat: float, reject: float = 0.5):
        self.languages, self.bias, self.heat, self.reject = languages, bias, heat, reject
        #: Row of each bucket: its embedding through the linear map, then 1; zeros for n-grams that don't count.
        self.table = np.zeros((BUCKETS + 1, table.shape[1] + 1), np.float32)
        self.table[:-1, :-1], self.table[:-1, -1] = table, 1

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = pc.fill_null(texts, "")
        lettered = [LETTER.search(x) is not None for x in texts.to_pylist()]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        c, docs = spelled(texts)
        total = np.zeros((len(texts), self.table.shape[1]))
        for n in GRAMS:
            g = grams(c, n)
            if not len(g):
                continue
            for back in range(1, n):  # none over two texts
                ends = docs[1:] - back
                g[ends[(ends >= 0) & (ends < len(g))]] = BUCKETS
            heads = docs[:-1]
            some = heads < len(g)
            total[some] += np.add.reduceat(self.table[g], heads[some], axis=0)
        logits = total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias
        p = softmax(logits * self.heat)
        best = p.argmax(1)
        score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], np.round(score, 6)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 0) -> Model:
    """Stochastic gradient descent over single texts, then the temperature that suits the texts set aside best."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    y = np.array([languages.index(x) for x in labels])
    bags = []
    for x in texts:
        c, _ = spelled(pa.array([x], pa.large_string()))
        g = np.concatenate([grams(c, n) for n in GRAMS])
        at, count = np.unique(g[g < BUCKETS], return_counts=True)
        bags.append((at, count / max(1, count.sum())))
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(bags))
    aside, used = order[: len(order) // 5], order[len(order) // 5 :]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(used):
            at, share = bags[i]
            if not len(at):
                continue
            h = share @ e[at]
            p = np.exp(h @ w + b - (h @ w + b).max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= step * np.outer(h, p)
            b -= step * p
            e[at] -= 20 * step * share[:, None] * back
    model = Model(languages, e @ w, b, 1.0)
    some = [i for i in aside if len(bags[i][0])]
    if some:
        logits = np.stack([bags[i][1] @ e[bags[i][0]] @ w + b for i in some])
        heats = np.geomspace(0.25, 8, 41)
        model.heat = float(heats[np.argmin([-np.log(softmax(logits * t)[np.arange(len(some)), y[some]] + 1e-9).mean() for t in heats])])
        p = softmax(logits * model.heat)
        noise = [model.predict(pa.array([shuffled(texts[i], rng)], pa.large_string()))[1] for i in some]
        model.reject = calibrated(p.max(1), p.argmax(1) == y[some], np.concatenate(noise))
    return model


def shuffled(text: str, rng: np.random.Generator) -> str:
    """A text of no language: the same characters, in any order."""
    return "".join(np.array(list(text))[rng.permutation(len(text))].tolist())


def calibrated(scores: np.ndarray, right: np.ndarray, noise: np.ndarray) -> float:
    """The score to reject below, from scores of texts set aside, whether their predictions are right, and scores of no language."""
    lost = float(np.quantile(scores[right], LOST)) if right.any() else 1.0
    order = np.argsort(scores)[::-1]
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= WRONG)
    least = 0.0 if len(fine) == len(order) else float(scores[order[fine[-1]]]) if len(fine) else 1.0
    return min(max(float(np.quantile(noise, NOISE)) if len(noise) else 0.0, least), lost)


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where=None) -> Model:
    """A model of the labelled rows (those that meet ``where``), at most SAMPLE of them by smallest hashed id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if where is not None:
        known = known.where(where)
    ids = known.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).join(F.broadcast(ids), "_id")
    # of rows with one id that with the smallest hashed text, so that repeats don't lift the bound
    rows = rows.groupBy("_id").agg(F.min_by(F.struct("_text", "_lang"), F.xxhash64("_text", "_lang")).alias("r")).select("_id", "r._text", "r._lang").orderBy("_id").toArrow()
    return train(rows["_text"].to_pylist(), rows["_lang"].to_pylist())


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """id, lang_pred, score, accepted of every row (plus the columns in ``keep``). The model is a fixed-size table."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), keep or []
    least = model.reject if reject is None else reject

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, names, score = batch.column(1), [], []
        for i, j in cuts(texts, 4 << 20):
            a, b = shared.value.predict(texts.slice(i, j - i))
            names += a
            score.append(b)
        score = np.concatenate(score) if score else np.zeros(0)
        ok = [s >= least and x != "und" for s, x in zip(score, names)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_()), *(batch.column(2 + k) for k in range(len(kept)))], ["doc_id", "lang_pred", "score", "accepted", *kept])

    kinds = dict(docs.dtypes)
    return arrow_map(docs, [id_col, text_col, *kept], run, ", ".join([f"doc_id {kinds[id_col]}", "lang_pred string, score double, accepted boolean", *(f"`{k}` {kinds[k]}" for k in kept)]), text_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", reject: float | None = None) -> DataFrame:
    """The rows, with all their columns, whose language is told with enough confidence."""
    shared, least = docs.sparkSession.sparkContext.broadcast(model), model.reject if reject is None else reject

    def judge(texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0, bool)]
        for i, j in cuts(texts, 4 << 20):
            names, score = shared.value.predict(texts.slice(i, j - i))
            out.append((score >= least) & np.array([x != "und" for x in names]))
        return np.concatenate(out)

    return rows_where(docs, text_col, judge)
