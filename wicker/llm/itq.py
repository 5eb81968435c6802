"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

``learn`` centres unit vectors, rotates them to principal axes and then by the rotation that brings them nearest to the
corners of a cube (alternating signs and an orthogonal Procrustes step), on at most ``SAMPLE`` vectors: balanced codes of
up to 64 bits. Every vector is then indexed: a code falls into ``TABLES`` parts, each with a table; two vectors meet if
some part differs in at most one bit, which codes within 2 * TABLES - 1 bits are sure of. In a table, a vector is at home
in its part's cell and visits the cells of that part with one set bit cleared, so that a pair meets once a table; it
counts in the first table where it meets.

Only ids and codes go into the cells. In each, a row is dropped that has no other within ``radius`` bits; the original
vectors are then joined to the rows that are left, and those candidates are ranked by cosine in double precision. The
radius is the number of bits that a pair at the wanted cosine differs in on average, and five standard deviations.

Equal vectors of one label are one row with a count. A cell of more than ``CELL`` rows is not thinned out but split into
blocks, and each two blocks meet in a task of their own; tasks emit counts and spanning forests, not pairs. The sizes of
cells are sums over the parts' counts, so that they are known without the cells.

Defined results: rows whose label, id or vector is null, or whose vector is zero or holds null or non-finite components,
link with nothing; so do vectors of different length. Repeated rows are vectors of their own that link with each other;
ids must be integers (anything else is refused by name). An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integers, stored
from .components import components
from .simhash import forest, pairs_of

SAMPLE, TABLES, BITS, CELL = 20_000, 4, 16, 4096


class Codes:
    """Mean, and axes times rotation, for vectors of one length."""

    def __init__(self, x: np.ndarray, rounds: int = 50, seed: int = 0):
        n = x.shape[1]
        bits = min(n, TABLES * BITS)
        self.mean = x.mean(0)
        v = x - self.mean
        axes = np.linalg.eigh(v.T @ v)[1][:, ::-1][:, :bits]
        v = v @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        self.map = axes @ turn

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """rows x TABLES parts of 16 bits."""
        bits = np.zeros((len(x), TABLES * BITS), bool)
        bits[:, : self.map.shape[1]] = (x - self.mean) @ self.map > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn(rows: pa.ChunkedArray) -> dict[int, Codes]:
    """Codes for each length of the vectors in a list column."""
    rows = rows.combine_chunks()
    sizes = rows.value_lengths().to_numpy()
    out = {}
    for n in np.unique(sizes):
        some = rows.filter(pa.array(sizes == n))
        out[int(n)] = Codes(unit(some.flatten().to_numpy().astype(np.float64).reshape(-1, n)))
    return out


def radius(least: float, bits: int) -> int:
    """Differing bits that a pair of the least cosine hardly ever exceeds."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def clean(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, group (the label's hash), v, ok, and s1, s2: 96 bits of hashes that equal vectors share."""
    kind = dict(rows.dtypes)[vector_col]
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    ok = F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~bad & some, F.lit(False))
    return rows.select(F.col(id_col).alias("vec_id"), F.xxhash64(label_col).alias("group"), v.alias("v"), ok.alias("ok"), F.xxhash64(v).alias("s1"), F.hash(v).alias("s2"))


#: What a class of equal vectors is known by.
CLASS = ["group", "s1", "s2"]


def coded(fine: DataFrame, models: dict[int, Codes]) -> DataFrame:
    """CLASS, size, code, rep (smallest id) and n of every class of equal vectors. Vectors stay where they are read."""
    shared = fine.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sizes = part.column(4).value_lengths().to_numpy()
                for n in np.unique(sizes):
                    some = part.filter(pa.array(sizes == n))
                    x = unit(some.column(4).flatten().to_numpy().astype(np.float64).reshape(-1, n))
                    model = shared.value.get(int(n)) or Codes(np.concatenate([np.eye(n), -np.eye(n)]), rounds=0)
                    code = np.ascontiguousarray(model(x)).view("<i8")[:, 0]
                    yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(np.full(len(x), n), pa.int32()), pa.array(code)], ["vec_id", *CLASS, "size", "code"])

    codes = fine.select(F.col("vec_id").cast("long"), *CLASS, "v").mapInArrow(run, "vec_id long, group long, s1 long, s2 int, size int, code long")
    return codes.groupBy(*CLASS, "size", "code").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def large_cells(classes: DataFrame) -> DataFrame:
    """group, size, cell and number of blocks of cells with more than CELL rows, from the parts' counts."""
    part = lambda t: F.shiftrightunsigned("code", BITS * t).bitwiseAND((1 << BITS) - 1) + (t << BITS)
    parts = classes.select("group", "size", F.explode(F.array(*(part(t) for t in range(TABLES)))).alias("part")).groupBy("group", "size", "part").count()
    visited = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(F.getbit("part", b) == 1, F.col("part") - F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    cells = parts.select("group", "size", "count", F.explode(F.array_compact(F.concat(F.array("part"), visited))).alias("cell"))
    sizes = cells.groupBy("group", "size", "cell").agg(F.sum("count").alias("n")).where(F.col("n") > CELL)
    return sizes.select("group", "size", "cell", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))


def cells_of(classes: DataFrame) -> DataFrame:
    """One row for each cell that a class is at home in or visits: group, size, cell, home, code, and the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                code = part.column(2).to_numpy()
                row, key, home = [], [], []
                for t in range(TABLES):
                    c = code >> BITS * t & (1 << BITS) - 1
                    row.append(np.arange(len(c)))
                    key.append(t << BITS | c)
                    home.append(np.ones(len(c), bool))
                    for b in range(BITS):
                        own = np.flatnonzero(c >> b & 1)
                        row.append(own)
                        key.append(t << BITS | c[own] & ~(1 << b))
                        home.append(np.zeros(len(own), bool))
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns), pa.array(np.concatenate(key)), pa.array(np.concatenate(home))], [*part.schema.names, "cell", "home"])

    return classes.select("group", "size", "code", "rep", "n", "s1", "s2").mapInArrow(run, "group long, size int, code long, rep long, n long, s1 long, s2 int, cell long, home boolean")


def earlier(x: np.ndarray, table: np.ndarray | int) -> np.ndarray:
    """Whether codes that differ in x meet in a table before the given one."""
    differ = np.bitwise_count(np.ascontiguousarray(x).view("<u2").reshape(-1, TABLES))
    return ((differ <= 1) & (np.arange(TABLES) < np.asarray(table).reshape(-1, 1))).any(1)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal keys, and where each group begins; batches are sorted by the keys."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        head = heads(table, keys)
        if len(head) > 1:
            yield table.slice(0, int(head[-1])).combine_chunks(), head[:-1]
        held = table.slice(int(head[-1])) if len(head) else None
    if held is not None:
        yield held.combine_chunks(), np.zeros(1, np.int64)


def heads(table: pa.Table, keys: list[str]) -> np.ndarray:
    columns = [table.column(k).to_numpy() for k in keys]
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))[: len(table)])


def thinned(cells: DataFrame, least: float) -> DataFrame:
    """The rows of cells that have another within the radius there, in the first table where the two meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, head in grouped(batches, ["group", "size", "cell"]):
            code, home = table.column("code").to_numpy(), table.column("home").to_numpy()
            cell, most = table.column("cell").to_numpy(), np.array([radius(least, min(n, TABLES * BITS)) for n in table.column("size").to_numpy()[head]])
            length = np.diff(np.append(head, len(table)))
            most = np.repeat(most, length)
            use = np.zeros(len(table), bool)
            for a, b in pairs_of(length, head):
                x = code[a] ^ code[b]
                fine = (home[a] | home[b]) & (np.bitwise_count(x.view(np.uint64)) <= most[a])
                a, b, x = a[fine], b[fine], x[fine]
                fine = ~earlier(x, cell[a] >> BITS)
                use[a[fine]] = use[b[fine]] = True
            yield from table.filter(pa.array(use)).to_batches()

    return cells.repartition("group", "size", "cell").sortWithinPartitions("group", "size", "cell").mapInArrow(run, cells.schema)


def found(fine: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """kind 0: a class (a, s1, s2) and how many vectors of other classes a cell linked it with (b); kind 1: a link a-b of a forest."""
    large = stored(large_cells(classes), "large")
    key = ["group", "size", "cell"]
    spread = cells_of(classes).join(large, key)
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep", "s1"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("blocks", "other")
    usual = thinned(cells_of(classes).join(large, key, "left_anti"), least)
    usual = usual.withColumn("block", F.lit(0)).withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    met = stored(usual.unionByName(spread), "met")
    wanted = met.select(F.col("rep").alias("vec_id"), *CLASS).distinct()
    vectors = fine.select(F.col("vec_id").cast("long").alias("vec_id"), *CLASS, "v").join(wanted, ["vec_id", *CLASS], "left_semi").dropDuplicates(["vec_id", *CLASS])
    rows = met.join(vectors.withColumnRenamed("vec_id", "rep"), ["rep", *CLASS])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, head in grouped(batches, [*key, "x", "y"]):
            rep, weight, code, home, block, cell, x, y = (table.column(c).to_numpy() for c in ("rep", "n", "code", "home", "block", "cell", "x", "y"))
            signs = [table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c) for c in ("s1", "s2")]
            kind, a_out, b_out, at = [], [], [], []
            for a, b in zip(head.tolist(), np.append(head[1:], len(table)).tolist()):
                if b - a < 2 or not home[a:b].any():
                    continue
                v = unit(table.column("v").slice(a, b - a).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(b - a, -1))
                counts, links = cell_links(v, code[a:b], home[a:b], block[a:b], bool(x[a] != y[a]), int(cell[a]) >> BITS, weight[a:b], least)
                some = np.flatnonzero(counts)
                kind += [np.zeros(len(some), np.int32), np.ones(len(links), np.int32)]
                a_out += [rep[a:b][some], rep[a:b][links[:, 0]]]
                b_out += [counts[some], rep[a:b][links[:, 1]]]
                at += [some + a, links[:, 0] + a]
            if kind:
                own = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (kind, a_out, b_out)] + [c.take(own) for c in signs] + [table.column("group").combine_chunks().take(own)], ["kind", "a", "b", "s1", "s2", "group"])

    return rows.repartition(*key, "x", "y").sortWithinPartitions(*key, "x", "y").mapInArrow(meet, "kind int, a long, b long, s1 long, s2 int, group long")


def cell_links(x: np.ndarray, code: np.ndarray, home: np.ndarray, block: np.ndarray, across: bool, table: int, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of a cell (or of two of its blocks): linked vectors by row, and a spanning forest of the links."""
    n = len(x)
    counts, label, tree = np.zeros(n, np.int64), np.arange(n), [np.zeros((0, 2), np.int64)]
    for i in range(0, n, 512):
        for j in range(i, n, 2048):
            a, b = np.nonzero(x[i : i + 512] @ x[j : j + 2048].T >= least)
            a, b = a + i, b + j
            fine = (a < b) & (home[a] | home[b])
            if across:
                fine &= block[a] != block[b]
            a, b = a[fine], b[fine]
            first = ~earlier(code[a] ^ code[b], table)
            a, b = a[first], b[first]
            counts += np.bincount(a, weight[b], minlength=n).astype(np.int64) + np.bincount(b, weight[a], minlength=n).astype(np.int64)
            fresh = label[a] != label[b]
            if fresh.any():
                for p, q in forest(label[a[fresh]], label[b[fresh]], n):
                    low, high = sorted((label[p], label[q]))
                    label[label == high] = low
                    tree.append(np.array([[p, q]]))
    return counts, np.concatenate(tree)


def near_duplicates(rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    integers(rows, id_col)
    every = clean(rows, id_col, vector_col, label_col)
    fine = every.where("ok")
    # the ids of the sample first, so that no task holds or sends more vectors than the sample has
    chosen = fine.select("vec_id", *CLASS).distinct().orderBy(F.xxhash64("vec_id"), "vec_id", *CLASS).limit(SAMPLE)
    sample = fine.select("vec_id", *CLASS, "v").join(F.broadcast(chosen), ["vec_id", *CLASS], "left_semi").dropDuplicates(["vec_id", *CLASS])
    models = learn(sample.orderBy("vec_id", *CLASS).select("v").toArrow()["v"])
    classes = stored(coded(fine, models), "classes")
    result = stored(found(fine, classes, least), "found")
    counts = result.where("kind = 0").groupBy(*CLASS).agg(F.sum("b").alias("others"))
    roots = components(result.where("kind = 1").select("a", "b"))
    named = classes.join(counts, CLASS, "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select(*CLASS, F.lit(True).alias("ok"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    joined = every.drop("v").join(named, [*CLASS, "ok"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
