"""Stored graphs: columnar tables, two edge layouts, overlays and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import compaction, overlay
from ..operators.iterate import settled, write_clean


def write_graph(folder: str, tables: dict[str, DataFrame], buckets: int | None = None) -> None:
    """nodes, edges by source and by target, and the rest. Each edge layout is range-partitioned and sorted by its key, so a lookup reads a few row groups."""
    for name, df in tables.items():
        if name == "edges":
            for key in ("src", "dst"):
                write_edges(folder, df, key, buckets)
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_edges(folder: str, edges: DataFrame, key: str, buckets: int | None = None) -> None:
    """One layout of the edges: by src or by dst."""
    part = edges.repartitionByRange(buckets, key) if buckets else edges.repartitionByRange(key)
    write_clean(part.sortWithinPartitions(key, "dst" if key == "src" else "src", "kind", "conf"), f"{folder}/edges_by_{key}")


def open_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"nodes": spark.read.parquet(f"{folder}/nodes"), "forward": spark.read.parquet(f"{folder}/edges_by_src"), "reverse": spark.read.parquet(f"{folder}/edges_by_dst")}


def read_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and keys of a stored graph; no other column is read."""
    return spark.read.parquet(f"{folder}/nodes").select("node_id", "node_key")


def write_units(spark: SparkSession, folder: str, units: DataFrame, statuses: DataFrame, base: DataFrame | None) -> str:
    """Keep extraction results: nothing if nothing changed, a delta beside the base while churn is low, else a new base."""
    if base is not None:
        if statuses.where("status <> 'same'").isEmpty():
            return "unchanged"
        if not compaction(base, statuses).first()["compact"]:
            changed = statuses.where("status IN ('added', 'changed')").select("path")
            units.join(changed, "path", "left_semi").write.mode("overwrite").parquet(f"{folder}/delta")
            statuses.where("status = 'gone'").select("path").write.mode("overwrite").parquet(f"{folder}/gone")
            return "delta"
    units.write.mode("overwrite").parquet(f"{folder}/base")
    for rest in ("delta", "gone"):
        units.limit(0).write.mode("overwrite").parquet(f"{folder}/{rest}")
    return "base"


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    base, delta, gone = (spark.read.parquet(f"{folder}/{x}") for x in ("base", "delta", "gone"))
    return overlay(base, delta, gone, "path")


def dump_nodes(nodes: DataFrame, folder: str) -> None:
    nodes.select("file", "name", "kind").write.mode("overwrite").json(folder)


def dump_edges(edges: DataFrame, folder: str) -> None:
    edges.write.mode("overwrite").json(folder)


def symbols(nodes: DataFrame, *columns: str) -> DataFrame:
    """(sym_id, text): all strings of the columns in order, numbered from 0 by sorted ranges of even size."""
    from pyspark.sql import Window as W

    text = None
    for c in columns:
        one = nodes.select(F.col(c).alias("text")).where("text IS NOT NULL")
        text = one if text is None else text.unionByName(one)
    # sorted ranges, numbered inside; the ranges' totals, one row a partition, give the rest
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    part = settled(text.distinct().repartitionByRange("text").sortWithinPartitions("text").select("text", F.spark_partition_id().alias("p"), place.alias("i")))
    before = part.groupBy("p").agg(F.count(F.lit(1)).alias("t")).withColumn("base", F.coalesce(F.sum("t").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return part.join(before, "p").select((F.col("base") + F.col("i")).alias("sym_id"), "text")
