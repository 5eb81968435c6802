"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

Documents longer than a bin are cut into full bins and a rest. Rests are dealt into shards by hashed id (so that hot
sources and duplicate clusters spread evenly) of about ``SHARD`` rows each; a shard is packed longest first. Its open bins
are ordered by what is left in them and carry bitmaps of their sources - one plane for each document that a source may
have in a bin - and of their duplicate clusters. The search starts at the tightest bin that holds the document and goes on
to its successors until one has neither the cluster nor too much of the source; if none has, a bin is opened.

Defined results: null and empty texts are pieces of 0 words; null sources and clusters conflict with nothing; repeated
rows are packed row by row (and conflict, if they share a cluster); ties go by id, then piece, then the older bin; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of
from .segment import Words

CAPACITY, PER_SOURCE, SHARD = 2048, 2, 4096


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, words and cluster (rows with the same text) of every row; a text without words has no cluster."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, docs_at = texts_of(batch.column(1))
        counts = Words(data, docs_at).counts
        raw = memoryview(np.ascontiguousarray(data)).cast("B")
        at = docs_at.tolist()
        cluster = [xxhash.xxh64_intdigest(raw[a:b]) - (1 << 63) if n else None for a, b, n in zip(at[:-1], at[1:], counts.tolist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(cluster, pa.int64())], ["doc_id", "source", "words", "cluster"])

    kinds = dict(docs.dtypes)
    return arrow_map(docs, [id_col, text_col, source_col], run, f"doc_id {kinds[id_col]}, source {kinds[source_col]}, words long, cluster long", text_col)


class Bins:
    """Open bins by what is left in them."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.order = capacity, []
        self.planes: list[list[int]] = [[] for _ in range(per_source)]
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, place in it) of a document; source and cluster are bits, 0 for none."""
        order, full, clusters = self.order, self.planes[-1], self.clusters
        at = bisect_left(order, (size, -1))
        while at < len(order):
            bin_no = order[at][1]
            if not (full[bin_no] & source or clusters[bin_no] & cluster):
                left = order.pop(at)[0]
                break
            at += 1
        else:
            bin_no, left = len(clusters), self.capacity
            clusters.append(0)
            for p in self.planes:
                p.append(0)
        carry = source
        for p in self.planes:  # the lowest plane without the source takes it
            p[bin_no], carry = p[bin_no] | carry, p[bin_no] & carry
        clusters[bin_no] |= cluster
        insort(order, (left - size, bin_no))
        return bin_no, self.capacity - left


def shard_bins(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable")
    bit = lambda c: [0 if x < 0 else 1 << x for x in pd.factorize(c)[0].tolist()]
    bins = Bins(capacity, per_source)
    place = [bins.put(n, s, k) for n, s, k in zip(rows["size"].tolist(), bit(rows["source"]), bit(rows["cluster"]))]
    base = int(rows["shard"].iloc[0]) << 32
    return pd.DataFrame({"doc_id": rows["doc_id"], "piece": rows["piece"], "first_word": rows["first_word"], "n_words": rows["size"], "bin_id": [base + b for b, _ in place], "bin_offset": [o for _, o in place]})


def packed(rows: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, id_col: str = "doc_id", size_col: str = "words", source_col: str = "source", cluster_col: str = "cluster", n_rows: int | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, first_word, n_words, bin_id, bin_offset. n_rows spares a count of rows that are dear to make."""
    kind = dict(rows.dtypes)[id_col]
    shards = max(1, -(-(rows.count() if n_rows is None else n_rows) // SHARD))
    base = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("words"), F.col(source_col).alias("source"), F.col(cluster_col).alias("cluster"))
    full = F.floor(F.col("words") / capacity).cast("int")
    pieces = full + F.when((F.col("words") % capacity > 0) | (F.col("words") == 0), 1).otherwise(0)
    cut = base.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    cut = cut.withColumn("first_word", F.col("piece").cast("long") * capacity).withColumn("size", F.least(F.col("words") - F.col("first_word"), F.lit(capacity).cast("long")))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("long")).drop("words")
    return cut.groupBy("shard").applyInPandas(lambda g: shard_bins(g, capacity, per_source), f"doc_id {kind}, piece int, first_word long, n_words long, bin_id long, bin_offset long")
