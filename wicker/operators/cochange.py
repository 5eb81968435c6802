"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Reuse a stored result if no more commits than this lie between it and now.
DRIFT = 25


#: Rows of commits, and pairs at most, that a task takes.
ROWS, PAIRS = 500_000, 2_000_000


def tasks(rows: int, each: int = ROWS) -> int:
    """So many tasks that none has more than ``each`` of the rows on average."""
    return max(1, -(-rows // each))


def pairs(commits: DataFrame, smallest: int = 2, largest: int = 20, support: int = 3, partners: int = 8, rows: int | None = None) -> DataFrame:
    """(a, b, n, conf) with a < b, from commits(commit_id, file): pairs of enough commits that stand among the strongest
    partners of either file. A commit's files are counted and walked in order; none gathers more than the next ``largest``.

    ``rows`` is how many the commits have. Where it is given, pairs are counted in tasks of PAIRS at most, not in as many as
    the session has for a shuffle, and what a task holds doesn't grow with the history. A pair hardly comes twice in a task
    of commits, so that pairs are counted where they meet and not before.
    """
    files = commits.select("commit_id", "file").distinct()
    w = W.partitionBy("commit_id").orderBy("file")
    count = F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    walked = files.select(F.col("file").alias("a"), count.alias("m"), F.collect_list("file").over(w.rowsBetween(1, largest - 1)).alias("later"))
    each = walked.where(F.col("m").between(smallest, largest) & F.col("a").isNotNull()).select("a", F.explode("later").alias("b"))
    if rows is not None:
        each = each.repartition(tasks(rows * (largest - 1) // 2, PAIRS), "a", "b")
    n = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    ways = F.array(F.struct(F.col("a").alias("file"), F.col("b").alias("partner")), F.struct(F.col("b").alias("file"), F.col("a").alias("partner")))
    both = n.select(F.explode(ways).alias("w"), "n").select("w.file", "w.partner", "n")
    if rows is not None:
        both = both.repartition(tasks(2 * rows), "file")
    top = both.withColumn("r", F.row_number().over(W.partitionBy("file").orderBy(F.desc("n"), "partner"))).where(F.col("r") <= partners)
    kept = top.select(F.least("file", "partner").alias("a"), F.greatest("file", "partner").alias("b"), "n").distinct()
    return kept.withColumn("conf", F.least(F.lit(40) + 3 * F.col("n"), F.lit(70)).cast("int"))


def edges(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Edges both ways for pairs whose files(path, node_id) still exist."""
    a = files.select(F.col("path").alias("a"), F.col("node_id").alias("src"))
    b = files.select(F.col("path").alias("b"), F.col("node_id").alias("dst"))
    one = pairs.join(a, "a").join(b, "b").select("src", "dst", F.lit("references").alias("kind"), "conf", F.lit("cochange").alias("prov"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "conf", "prov"))


def reusable(behind: int | None, ahead: int | None) -> bool:
    """Whether a stored result serves, by commits on either side of the fork; unknown history means no."""
    return behind is not None and ahead is not None and behind + ahead <= DRIFT


def write(folder: str, pairs: DataFrame, head: str) -> None:
    """Keep pairs with the commit that they were mined at."""
    pairs.withColumn("head", F.lit(head)).write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str, behind: dict[str, tuple[int, int]]) -> DataFrame | None:
    """Kept pairs, if the commit they were mined at is near enough; behind gives, by commit, the commits on either side of the fork."""
    kept = spark.read.parquet(folder)
    head = kept.select("head").first()
    return kept.drop("head") if head and reusable(*behind.get(head[0], (None, None))) else None
