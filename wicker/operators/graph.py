"""Neighbours, traversal, names and layout over nodes(node_id, name, kind, file_id, ...) and edges(src, dst, kind, conf, prov)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import REASONS
from .iterate import prefix_sums, settled, written


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The most confident edge for each (src, dst, kind); ties go to the smaller provenance name."""
    best = F.max_by(F.struct("conf", "prov"), F.struct("conf", F.transform(F.split("prov", ""), lambda x: -F.ascii(x))))
    return edges.groupBy("src", "dst", "kind").agg(best.alias("b")).select("src", "dst", "kind", "b.conf", "b.prov")


def neighbours(edges: DataFrame, nodes: DataFrame, ids: list[int], forward: bool, min_conf: int = 0, limit: int | None = 25) -> DataFrame:
    """Callees (forward) or callers of some nodes, most confident first, at most ``limit`` for each."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    found = edges.where(F.col(near).isin(ids) & (F.col("conf") >= min_conf)).select(F.col(near).alias("of"), F.col(far).alias("node_id"), F.col("kind").alias("edge"), "conf", "prov")
    if limit is not None:
        order = W.partitionBy("of").orderBy(F.desc("conf"), "node_id", "edge")
        found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    return found.join(nodes.select("node_id", "name"), "node_id").select("of", "node_id", "name", "edge", "conf", "prov")


def degrees(edges: DataFrame) -> DataFrame:
    """Edges in and out of every node that has any."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def csr_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where each node's run begins in the edge list sorted by (src, dst, kind, conf).

    The prefix sum runs over ranges of node ids, level by level, so no task sees all nodes.
    """
    degree = nodes.select(F.col("node_id").alias("n")).join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")), F.col("n") == F.col("src"), "left").select("n", F.coalesce("d", F.lit(0)).alias("degree"))
    return prefix_sums(degree, "n", "degree", "first").select(F.col("n").alias("node_id"), "degree", "first")


def impact(edges: DataFrame, starts: list[int], depth: int = 3, min_conf: int = 80, skip_contains: bool = False) -> DataFrame:
    """Nodes from which some start can be reached in at most ``depth`` hops, with their distance; starts excluded."""
    use = edges.where(F.col("conf") >= min_conf)
    if skip_contains:
        use = use.where("kind <> 'contains'")
    use = use.select("src", "dst")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in starts], "node_id long, hops int")
    frontier = seen
    for hop in range(1, depth + 1):
        step = use.join(frontier, use["dst"] == frontier["node_id"]).select(F.col("src").cast("long").alias("node_id")).distinct()
        frontier = written(step.join(seen, "node_id", "left_anti").select("node_id", F.lit(hop).alias("hops")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def shortest_path(edges: DataFrame, a: int, b: int, max_hops: int = 8) -> DataFrame:
    """(pos, node_id) of a shortest path over all edges; empty if there is none. Of several parents the smallest is taken."""
    spark = edges.sparkSession
    use = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    seen = spark.createDataFrame([(a, None, 0)], "node_id long, parent long, hops int")
    frontier, reached = seen, a == b
    for hop in range(1, max_hops + 1):
        if reached:
            break
        step = use.join(frontier, use["src"] == frontier["node_id"]).groupBy("dst").agg(F.min("src").alias("parent"))
        frontier = written(step.withColumnRenamed("dst", "node_id").join(seen.select("node_id"), "node_id", "left_anti").select("node_id", "parent", F.lit(hop).alias("hops")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        reached = not frontier.where(F.col("node_id") == b).isEmpty()
    out, at = [], b if reached else None
    while at is not None:  # at most max_hops lookups
        row = seen.where(F.col("node_id") == at).first()
        out.append((int(row["hops"]), int(at)))
        at = row["parent"]
    return spark.createDataFrame(sorted(out), "pos int, node_id long")


def flow(edges: DataFrame, a: int, b: int, max_hops: int = 8) -> DataFrame:
    """The path from a to b, else the one from b to a, flagged as reversed."""
    there = shortest_path(edges, a, b, max_hops)
    if not there.isEmpty():
        return there.withColumn("reversed", F.lit(False))
    return shortest_path(edges, b, a, max_hops).withColumn("reversed", F.lit(True))


def expand(edges: DataFrame, seeds: DataFrame, hops: int, known: DataFrame | None = None) -> DataFrame:
    """Best score and reason for every node within one or two hops of the seeds(node_id, why, score); nodes ``known`` in the
    same columns have their scores too, but nothing is expanded from them unless it finds a better one.

    An edge gives reason weight times confidence, less by 0.45 at the second hop; co-change isn't decayed. Only nodes that
    improved go on. Ties: the nearer hop, then callers before callees, then co-change.
    """
    callers = edges.select(F.col("dst").alias("of"), F.col("src").alias("node_id"), "conf", "prov", F.lit("caller").alias("way"))
    both = callers.unionByName(edges.select(F.col("src").alias("of"), F.col("dst").alias("node_id"), "conf", "prov", F.lit("callee").alias("way")))
    co = F.col("prov") == "cochange"
    why = F.when(co, "co-change").otherwise(F.col("way"))
    weight = F.when(co, REASONS["co-change"]).when(F.col("way") == "caller", REASONS["caller"]).otherwise(REASONS["callee"])
    best = seeds.select(F.col("node_id").cast("long").alias("node_id"), "why", F.col("score").cast("double").alias("score"), F.lit(0).alias("hop"))
    frontier, decay = best.select("node_id"), 1.0
    if known is not None:
        rest = known.join(best.select("node_id"), "node_id", "left_anti")
        best = best.unionByName(rest.select(F.col("node_id").cast("long").alias("node_id"), "why", F.col("score").cast("double").alias("score"), F.lit(0).alias("hop")))
    order = {"seed": 0, "path": 1, "prose": 2, "on-path": 3, "caller": 4, "callee": 5, "co-change": 6}
    rank = F.coalesce(*(F.when(F.col("why") == k, F.lit(v)) for k, v in order.items()))
    for hop in range(1, hops + 1):
        score = weight * (F.col("conf") / 100.0) * F.when(co, F.lit(1.0)).otherwise(F.lit(decay))
        step = both.join(frontier.withColumnRenamed("node_id", "of"), "of").select(F.col("node_id").cast("long").alias("node_id"), why.alias("why"), score.alias("score"), F.lit(hop).alias("hop"))
        merged = best.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        top = F.max_by(F.struct("why", "score", "hop", "old"), F.struct("score", -F.col("hop"), -rank))
        merged = settled(merged.groupBy("node_id").agg(top.alias("t")).select("node_id", "t.why", "t.score", "t.hop", "t.old"))
        frontier, best = merged.where("NOT old").select("node_id"), merged.drop("old")
        decay *= 0.45
    return best.select("node_id", "why", "score")


def qualified_names(nodes: DataFrame, contains: DataFrame, stop_kind: str, most: int = 32) -> DataFrame:
    """Names joined by dots from the top of the containment tree down, the file (or other stop kind) left out."""
    up = contains.groupBy("dst").agg(F.min("src").alias("parent"))
    inner = nodes.where(F.col("kind") != stop_kind).select("node_id", "name")
    state = inner.join(up, F.col("node_id") == F.col("dst"), "left").select("node_id", F.col("name").alias("qualified"), "parent")
    done = None
    for _ in range(most):
        step = state.join(inner.select(F.col("node_id").alias("p"), F.col("name").alias("pn")), F.col("parent") == F.col("p"), "left").join(up.select(F.col("dst").alias("d"), F.col("parent").alias("next")), F.col("parent") == F.col("d"), "left")
        step = settled(step.select("node_id", F.when(F.col("pn").isNotNull(), F.concat("pn", F.lit("."), "qualified")).otherwise(F.col("qualified")).alias("qualified"), F.when(F.col("pn").isNotNull(), F.col("next")).alias("parent")))
        over = step.where("parent IS NULL")
        done = over if done is None else done.unionByName(over)
        state = step.where("parent IS NOT NULL")
        if state.isEmpty():
            break
    return done.unionByName(state).select("node_id", "qualified")


def file_ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files by definitions plus a quarter of the edges into them; files themselves and modules don't count."""
    inbound = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    inner = nodes.where("kind NOT IN ('file', 'module')").join(inbound, F.col("node_id") == F.col("dst"), "left")
    by = inner.groupBy("file_id").agg(F.count(F.lit(1)).alias("defs"), F.coalesce(F.sum("n"), F.lit(0)).alias("inbound"))
    return by.withColumn("rank_score", F.col("defs") + F.floor(F.col("inbound") / 4))


def falsified(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the rules that they break: extends itself, extends what is no class, crosses language families, ends in
    vendored code, and, where nodes have name and body, calls itself though the body never does."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("family").alias("sf"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("family").alias("df"), F.col("kind").alias("dk"), F.col("vendored").alias("dv"))
    extends, itself = F.col("kind") == "extends", F.col("src") == F.col("dst")
    calls_itself = F.lit(False)
    if {"name", "body"} <= set(nodes.columns):
        # only self-calls need their source: the text after the first line, with the name bare or on self before a bracket
        loops = edges.where((F.col("kind") == "calls") & itself).select("src").distinct()
        later = F.regexp_replace("body", r"^[^\n]*\n", "")
        quoted = F.concat(F.lit(r"(^|[^.\w])(self[.])?\Q"), "name", F.lit(r"\E\s*\("))
        held = nodes.join(loops.withColumnRenamed("src", "node_id"), "node_id", "left_semi").select(F.col("node_id").alias("src"), later.alias("later"), quoted.alias("quoted"))
        own = held.select("src", (~F.expr("later rlike quoted")).alias("idle"))
        edges, calls_itself = edges.join(own, "src", "left"), F.coalesce(F.col("idle") & (F.col("kind") == "calls") & itself, F.lit(False))
    return edges.join(a, "src").join(b, "dst").select(
        "src", "dst", "kind", "conf", "prov", calls_itself.alias("call_without_recursion"),
        (extends & itself).alias("extends_self"),
        (extends & ~F.col("dk").isin("class", "interface")).alias("extends_other"),
        (F.col("sf") != F.col("df")).alias("cross_language"),
        F.col("dv").alias("into_vendored"),
    )
