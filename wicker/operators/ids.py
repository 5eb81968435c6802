"""Stable ids, change detection and overlays between two states of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import prefix_sums

COMPACT_ABOVE = 0.25


def node_keys(defs: DataFrame) -> DataFrame:
    """node_key of defs(path, qualified, kind, ord): a hash that a definition keeps while its file, name, kind and place among namesakes stay."""
    w = W.partitionBy("path", "qualified", "kind").orderBy("ord")
    return defs.withColumn("occurrence", F.row_number().over(w) - 1).withColumn("node_key", F.xxhash64("path", "qualified", "kind", "occurrence"))


def assign(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node_id, node_key, status) after a change: kept keys keep their ids, new ones take retired ids, then new ones in key order.

    old(node_id, node_key), wanted(node_key) distinct. Ids of retired keys that nobody took stay as holes with a null key.
    """
    both = old.join(wanted.withColumn("w", F.lit(1)), "node_key", "full_outer")
    kept = both.where("node_id IS NOT NULL AND w IS NOT NULL").select("node_id", "node_key", F.lit("kept").alias("status"))
    holes = _numbered(both.where("w IS NULL").select("node_id"), "node_id", descending=True)
    added = _numbered(both.where("node_id IS NULL").select("node_key"), "node_key")
    top = old.agg(F.coalesce(F.max("node_id"), F.lit(-1)).alias("top"), F.count(F.lit(1)).alias("c"))
    n_holes = both.where("w IS NULL").agg(F.count(F.lit(1)).alias("n_holes"))
    matched = added.join(holes, "r", "full_outer").join(F.broadcast(top)).join(F.broadcast(n_holes))  # one row each
    new_id = F.coalesce("node_id", F.col("top") + F.col("r") - F.col("n_holes"))
    status = F.when(F.col("node_key").isNull(), "hole").otherwise("added")
    return kept.unionByName(matched.select(new_id.cast("long").alias("node_id"), "node_key", status.alias("status")))


def _numbered(rows: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """r = 1, 2, ... in the order of ``by``, by counts of ranges instead of one global sort task; keys are hashes, ids are dense."""
    one = rows.withColumn("_one", F.lit(1)).withColumn("_k", -F.col(by) if descending else F.col(by))
    if by != "node_key":
        return prefix_sums(one, "_k", "_one", "before").select(by, (F.col("before") + 1).alias("r"))
    part = rows.withColumn("block", F.floor(F.col(by) / F.lit(1 << 40)))
    sums = prefix_sums(part.groupBy("block").agg(F.count(F.lit(1)).alias("t")), "block", "t", "base")
    return part.withColumn("i", F.row_number().over(W.partitionBy("block").orderBy(by))).join(sums, "block").select(by, (F.col("base") + F.col("i")).alias("r"))


def changes(prior: DataFrame, found: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """(key, status): added, changed, same or gone, by the columns of the stamp."""
    a, b = prior.select(F.col(key), F.struct(*stamp).alias("a")), found.select(F.col(key), F.struct(*stamp).alias("b"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("status"))


def overlay(base: DataFrame, delta: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Base, with what the delta replaces or removes."""
    return base.join(delta.select(key), key, "left_anti").join(gone.select(key), key, "left_anti").unionByName(delta.join(gone.select(key), key, "left_anti"))


def cached_head(base: DataFrame, delta: DataFrame) -> DataFrame:
    """One row: the commit that a cache is current at - the delta's, as it is written after the base, else the base's; each has one row (head)."""
    some = lambda df, rank: df.where("head <> ''").select(F.lit(rank).alias("rank"), "head")
    return some(delta, 0).unionByName(some(base, 1)).agg(F.min_by("head", "rank").alias("head"))


def compaction(base: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row: base rows, churned rows and whether the base should be written anew rather than a delta beside it."""
    n = base.agg(F.count(F.lit(1)).alias("n_base"))
    churn = statuses.agg(F.count_if(F.col("status") != "same").alias("n_churn"))
    return n.join(churn).withColumn("compact", F.col("n_churn") > F.col("n_base") * COMPACT_ABOVE)


def graph_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Edges of one graph that the other lacks, by the key columns."""
    both = before.select(*key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(after.select(*key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    seen = both.groupBy(*key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a <> _b")
    return seen.select(*key, F.when(F.col("_a") == 1, "removed").otherwise("added").alias("side"))


def semantic_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line for each node(path, qualified, kind) and edge(src, dst, kind, conf, prov), the same for equal graphs whatever their ids."""
    n = nodes.select(F.concat_ws(" ", F.lit("N"), "path", "qualified", "kind").alias("line"))
    return n.unionByName(edges.select(F.concat_ws(" ", F.lit("E"), "src", "dst", "kind", F.col("conf").cast("string"), "prov").alias("line")))


def semantic_hash(lines: DataFrame) -> DataFrame:
    """An order-free digest of the lines, added up in each task: their number and the sum of the first 48 bits of their MD5."""
    head = F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(head).cast("string").alias("digest"))
