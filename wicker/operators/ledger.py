"""Costs of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cost, usage

BATCH_RATE = 0.5


def priced(calls: DataFrame, rate: float = 1.0) -> DataFrame:
    """calls(model, input_tokens, cache_read_tokens, cache_write_tokens, output_tokens, ...) with cost_usd."""
    return calls.withColumn("cost_usd", cost(F.col("model"), F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"), F.col("output_tokens"), rate))


def spend(ledger: DataFrame, by: str, since=None) -> DataFrame:
    """Dollars and tokens by group since a time; tokens count input, output and cached reads."""
    rows = ledger if since is None else ledger.where(F.col("created_at") >= since)
    return rows.groupBy(by).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens")), F.lit(0)).cast("long").alias("tokens"))


def totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "done").alias("done"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"))


def recent(runs: DataFrame, issues: DataFrame, repos: DataFrame, most: int = 20) -> DataFrame:
    """The newest runs with their issue's title and repository's name."""
    i, r = issues.select(F.col("id").alias("issue_id"), "title"), repos.select(F.col("id").alias("repo_id"), "full_name")
    return runs.join(i, "issue_id").join(r, "repo_id").orderBy(F.desc("id")).limit(most)


def collected(answers: DataFrame) -> DataFrame:
    """Batch answers(custom_id, model, error, body JSON) that succeeded, with their usage, at half price."""
    u = usage(F.get_json_object("body", "$.usage"))
    rows = answers.where("error IS NULL").withColumn("u", u).select("custom_id", "model", F.col("u.input").alias("input_tokens"), F.col("u.output").alias("output_tokens"), F.col("u.cache_read").alias("cache_read_tokens"), F.col("u.cache_write").alias("cache_write_tokens"))
    return priced(rows, BATCH_RATE)


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    w = W.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
