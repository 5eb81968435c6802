"""The two answers that users ask for most: the context around some names, and one node with what calls it and what it calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, retrieve, select
from .iterate import settled


def explore(nodes: DataFrame, edges: DataFrame, owners: DataFrame, asked: list[str], max_nodes: int = 25, max_bytes: int = 24_000, max_node_bytes: int = 2400) -> DataFrame:
    """(rank, node_id, why, score, size): the context of some names within a budget; nodes has size, their length in bytes.

    The names' nodes are seeds. The path between the first two, one way or else the other, comes next, then what lies one
    edge away from the seeds, or two where 60 nodes or more are wanted. Better scores come first, of equals the smaller.
    """
    spark = nodes.sparkSession
    seeds = [r["node_id"] for r in retrieve.named_seeds(nodes, owners, asked).orderBy("ord").collect()]  # one for each name
    first = spark.createDataFrame([(s, "seed", 1.0) for s in seeds], "node_id long, why string, score double")
    known = None
    if len(seeds) > 1:
        path = graph.flow(edges, seeds[0], seeds[1])
        known = path.select("node_id", F.lit("on-path").alias("why"), F.lit(0.9).alias("score"))
    found = graph.expand(edges, first, 2 if max_nodes >= 60 else 1, known)
    items = found.join(nodes.select("node_id", F.least("size", F.lit(max_node_bytes)).alias("size")), "node_id")
    order = W.partitionBy("q").orderBy(F.desc(F.round("score", 6)), "size", "node_id")
    items = settled(items.withColumn("q", F.lit(0)).withColumn("rank", F.row_number().over(order)))
    kept = select.select_budget(items, "q", max_nodes, max_bytes)
    return kept.join(items.select("node_id", "score"), "node_id").select("rank", "node_id", "why", F.round("score", 6).alias("score"), "size")


def node_answer(nodes: DataFrame, forward: DataFrame, reverse: DataFrame, owners: DataFrame, asked: str, limit: int = 20) -> DataFrame:
    """(section, ord, node_id, name, conf, total): the node of a name, its most confident callers and what it calls; total counts them all."""
    seed = retrieve.named_seeds(nodes, owners, [asked]).first()
    if seed is None:
        return nodes.sparkSession.createDataFrame([], "section string, ord int, node_id long, name string, conf int, total long")
    at = seed["node_id"]
    own = nodes.where(F.col("node_id") == at).select(F.lit("node").alias("section"), F.lit(1).alias("ord"), "node_id", "name", F.lit(None).cast("int").alias("conf"), F.lit(1).cast("long").alias("total"))
    for title, edges, ahead in (("called by", reverse, False), ("calls", forward, True)):
        near = "src" if ahead else "dst"
        total = edges.where(F.col(near) == at).agg(F.count(F.lit(1)).alias("total"))
        best = graph.neighbours(edges, nodes, [at], ahead, limit=limit)
        order = W.partitionBy("of").orderBy(F.desc("conf"), "node_id", "edge")  # at most limit rows
        rows = best.withColumn("ord", F.row_number().over(order)).join(total)
        own = own.unionByName(rows.select(F.lit(title).alias("section"), "ord", "node_id", "name", "conf", "total"))
    return own
