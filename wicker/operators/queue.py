"""Job queue, leases, gates and debouncing as batch operators; ``streaming`` runs the same rules over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import backoff, setting

LEASE, MOST_DEFERS, QUIET_MS = 60, 180, 300


def enqueue(queued: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request_id, dedupe_key, ...) that enter the queue: of one key the first, unless a queued job has it; null keys always enter."""
    w = W.partitionBy("dedupe_key").orderBy("request_id")
    keyed = requests.where("dedupe_key IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    fresh = keyed.join(queued.where("dedupe_key IS NOT NULL").select("dedupe_key").distinct(), "dedupe_key", "left_anti").select(*requests.columns)
    return fresh.unionByName(requests.where("dedupe_key IS NULL"))


def claim(jobs: DataFrame, now: int, kinds: list[str] | None = None) -> DataFrame:
    """The oldest ready job of each kind: queued, due, smallest id. jobs(id, kind, state, run_after)."""
    ready = jobs.where((F.col("state") == "queued") & (F.col("run_after") <= now))
    if kinds:
        ready = ready.where(F.col("kind").isin(kinds))
    return ready.groupBy("kind").agg(F.min_by(F.struct(*[c for c in jobs.columns if c != "kind"]), "id").alias("j")).select("kind", "j.*")


def deferred(jobs: DataFrame, now: int, wait: int) -> DataFrame:
    """Claimed jobs put back without a charge: attempts go down again, and after MOST_DEFERS they fail."""
    again = F.col("defers") < MOST_DEFERS
    return jobs.withColumns({"state": F.when(again, "queued").otherwise("failed"), "attempts": F.when(again, F.col("attempts") - 1).otherwise(F.col("attempts")), "defers": F.col("defers") + 1, "run_after": F.lit(now + wait)})


def retried(jobs: DataFrame, now: int, base: int = 30) -> DataFrame:
    """Failed tries: transient ones queue again after the backoff while tries remain; jobs(id, attempts, transient)."""
    wait = backoff(F.col("attempts"), base)
    again = F.col("transient") & wait.isNotNull()
    return jobs.withColumns({"state": F.when(again, "queued").otherwise("failed"), "run_after": F.when(again, F.lit(now) + wait)})


def reclaimed(jobs: DataFrame, now: int) -> DataFrame:
    """Running jobs whose lease has run out, queued again."""
    out = (F.col("state") == "running") & (F.col("lease_until") < now)
    return jobs.withColumns({"owner": F.when(~out, F.col("owner")), "state": F.when(out, "queued").otherwise(F.col("state"))})


def renewed(jobs: DataFrame, owner: str, now: int) -> DataFrame:
    """The owner's running leases that still hold, longer."""
    own = (F.col("state") == "running") & (F.col("owner") == owner) & (F.col("lease_until") >= now)
    return jobs.withColumn("lease_until", F.when(own, F.lit(now + LEASE)).otherwise(F.col("lease_until")))


def first_deliveries(deliveries: DataFrame) -> DataFrame:
    """Each delivery once: the earliest."""
    return deliveries.groupBy("delivery_id").agg(F.min("received_at").alias("received_at"))


def gate(signed: Column, replay: Column, branch: Column, action: Column, is_pr: Column, author: Column, labels: Column, label: str | None = None) -> Column:
    """Why a webhook is ignored, the first reason that holds; null if it goes on."""
    reason = (
        F.when(~signed, "signature").when(replay, "replay").when(~branch.isin("main", "master"), "branch").when(~action.isin("opened", "labeled", "reopened"), "action")
        .when(is_pr, "pull request").when(author.endswith("[bot]"), "bot")
    )
    return reason.when(~F.array_contains(labels, label), "label") if label else reason


def debounced(events: DataFrame, ts: str, wanted: Column, gap: str = "300 milliseconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """Bursts of events ended by a quiet gap; every event prolongs its burst, but only bursts with a wanted one count."""
    burst = events.withColumn("_w", wanted.cast("int")).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("_w").alias("n_wanted"))
    return burst.where("n_wanted > 0").select(*keys, F.col("w.start").alias("began"), F.col("w.end").alias("due"), "n_events", "n_wanted")


IGNORED = r"(^|/)(\.git|\.wicker|target|node_modules|__pycache__)(/|$)|~$|\.sw[a-p]$|(^|/)\.#|(^|/)#.*#$"


def watched(path: Column, extensions: tuple[str, ...]) -> Column:
    """Whether a changed path is a source that should lead to a new index."""
    return ~path.rlike(IGNORED) & F.regexp_extract(path, r"[.]([^./]+)$", 1).isin(*extensions)


def unanswered(issues: DataFrame, runs: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """Issues without a finished run; or, given stale ids, those answered ones whose answer is stale."""
    done = runs.where("status = 'done'").select(F.col("issue_id").alias("id")).distinct()
    if stale is None:
        return issues.join(done, "id", "left_anti")
    return issues.join(done, "id", "left_semi").join(stale.select("id"), "id", "left_semi")


def swept(jobs: DataFrame, repos: DataFrame, now: int, reanalyse_hours: int = 0) -> tuple[DataFrame, DataFrame]:
    """One round of the timers: jobs with expired leases queued again, and new requests(dedupe_key, repo_id, kind, run_after) for
    ready repositories(id, state, config) that ask for re-analysis, where no queued job has their key."""
    jobs = reclaimed(jobs, now)
    asks = F.coalesce(setting(F.col("config"), "reanalyse", "0").try_cast("int"), F.lit(0)) > 0
    wants = repos.where((F.col("state") == "ready") & asks) if reanalyse_hours > 0 else repos.limit(0)
    requests = wants.select(F.col("id").alias("request_id"), F.concat(F.lit("reanalyse:"), F.col("id").cast("string")).alias("dedupe_key"), F.col("id").alias("repo_id"), F.lit("reanalyse").alias("kind"), F.lit(now).alias("run_after"))
    return jobs, enqueue(jobs.where("state = 'queued'").select("dedupe_key"), requests).drop("request_id")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows overridden, where the new ones aren't null, plus rows of new keys."""
    rest = [c for c in old.columns if c not in key]
    n = new.select(*key, *(F.col(c).alias(f"_{c}") for c in rest if c in new.columns))
    return old.join(n, key, "full_outer").select(*key, *(F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in rest))


def migrated(old: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """Rows of an older schema in a newer one: missing columns take their default, else null."""
    empty = old.sparkSession.createDataFrame([], schema)
    return empty.unionByName(old, allowMissingColumns=True).select(*empty.columns).fillna(defaults or {})


def depths(jobs: DataFrame, now: int) -> DataFrame:
    """One row: queued, ready, running and failed jobs."""
    n = lambda c: F.count_if(c)
    return jobs.agg(n(F.col("state") == "queued").alias("queued"), n((F.col("state") == "queued") & (F.col("run_after") <= now)).alias("ready"), n(F.col("state") == "running").alias("running"), n(F.col("state") == "failed").alias("failed"))


def prometheus(row: DataFrame, prefix: str = "wicker") -> DataFrame:
    """Text lines of a one-row table of numbers: one gauge for each column."""
    cols = row.columns
    stacked = row.selectExpr(f"stack({len(cols)}, " + ", ".join(f"'{c}', cast(`{c}` as bigint)" for c in cols) + ") as (name, value)")
    return stacked.select(F.concat(F.lit(prefix + "_"), "name", F.lit(" "), F.col("value").cast("string")).alias("line"))
