"""Cutting a ranked list to a budget, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_budget(items: DataFrame, group: str, max_nodes: int = 25, max_bytes: int = 24_000) -> DataFrame:
    """Items(group, rank, node_id, why, size) that fit, walked by rank: seeds always stay; others need a place and bytes, and
    one that doesn't fit is skipped, not the end. Co-change has a fifth of the places for itself, beyond the others'.

    A fold over one question's candidates, which are few; questions are spread over tasks.
    """
    quota = max_nodes // 5
    rows = F.array_sort(F.collect_list(F.struct("rank", "node_id", "why", F.col("size").cast("long").alias("size"))))
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("kept"), F.lit(0).alias("co"), F.array().cast("array<int>").alias("ranks"))

    def step(s, x):
        seed, co = x["why"].isin("seed", "path", "prose"), x["why"] == "co-change"
        room = F.when(co, (s["co"] < quota) & (s["kept"] < max_nodes + quota)).otherwise(s["kept"] - s["co"] < max_nodes)
        take = seed | (room & (s["bytes"] + x["size"] <= max_bytes))
        n = take.cast("int")
        return F.struct(
            (s["bytes"] + F.when(take, x["size"]).otherwise(0)).alias("bytes"),
            (s["kept"] + n).alias("kept"),
            (s["co"] + F.when(take & co, 1).otherwise(0)).alias("co"),
            F.when(take, F.concat(s["ranks"], F.array(x["rank"]))).otherwise(s["ranks"]).alias("ranks"),
        )

    folded = items.groupBy(group).agg(rows.alias("rows")).withColumn("s", F.aggregate("rows", start, step))
    kept = folded.select(group, "s.bytes", F.explode(F.filter("rows", lambda x: F.array_contains(F.col("s.ranks"), x["rank"]))).alias("x"))
    return kept.select(group, "x.rank", "x.node_id", "x.why", "x.size")


def context_stats(items: DataFrame, kept: DataFrame, group: str) -> DataFrame:
    """(group, kept, dropped, bytes, est_tokens) of each selection."""
    total = items.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    own = kept.groupBy(group).agg(F.count(F.lit(1)).alias("kept"), F.sum("size").alias("bytes"))
    return total.join(own, group, "left").select(group, F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("total") - F.coalesce("kept", F.lit(0))).alias("dropped"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.floor(F.coalesce("bytes", F.lit(0)) * 2 / 7).cast("long").alias("est_tokens"))


def emit_budget(pieces: DataFrame, group: str, budget: int, overhead: int = 32) -> DataFrame:
    """Pieces(group, rank, item, size) whose text, with so many bytes of header, still fits; others are skipped. One of equal items counts."""
    once = pieces.groupBy(group, "item").agg(F.min(F.struct("rank", "size")).alias("m")).select(group, "item", "m.rank", F.col("m.size").cast("long").alias("size"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "item", "size")))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<int>").alias("ranks"))

    def step(s, x):
        fits = s["spent"] + x["size"] + overhead <= budget
        return F.struct(F.when(fits, s["spent"] + x["size"] + overhead).otherwise(s["spent"]).alias("spent"), F.when(fits, F.concat(s["ranks"], F.array(x["rank"]))).otherwise(s["ranks"]).alias("ranks"))

    folded = once.groupBy(group).agg(rows.alias("rows")).withColumn("s", F.aggregate("rows", start, step))
    kept = folded.select(group, F.explode(F.filter("rows", lambda x: F.array_contains(F.col("s.ranks"), x["rank"]))).alias("x"))
    return kept.select(group, "x.rank", "x.item", "x.size")


def source_pieces(items: DataFrame, nodes: DataFrame, files: DataFrame, group: str, cap: int = 2400) -> DataFrame:
    """Pieces(group, rank, item, size, text) for emit_budget of ranked items(group, rank, node_id): what stands in the files.

    nodes(node_id, kind, file_id, start, end) in bytes, files(file_id, content). Modules have no piece; a piece begins where its
    first line does, is cut at ``cap`` bytes, and is known by its file and span, so that two nodes of one span give one.
    """
    where = items.select(group, "rank", "node_id").join(nodes.where("kind <> 'module'").select("node_id", "file_id", "start", "end"), "node_id")
    text = F.decode("content", "ISO-8859-1")  # a character a byte
    before = F.substring_index(text.substr(F.lit(1), F.col("start")), "\n", -1)
    begin = F.col("start") - F.length(before)
    size = F.least(F.col("end") - begin, F.lit(cap)).cast("long")
    piece = F.decode(F.encode(text.substr((begin + 1).cast("int"), size.cast("int")), "ISO-8859-1"), "UTF-8")
    item = F.concat_ws(":", F.col("file_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
    return where.join(files.select("file_id", "content"), "file_id").select(group, "rank", item.alias("item"), size.alias("size"), piece.alias("text"))
