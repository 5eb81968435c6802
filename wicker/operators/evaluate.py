"""Evaluation: recall, calibration, intervals, tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import prefix_sums, settled

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """95 % interval of a share, clamped to 0..1; 0 and 1 without observations."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(1.0)


def recall_table(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """(case_id, wanted, hit, recall): wanted(case_id, item), got(case_id, item)."""
    hit = wanted.distinct().join(got.distinct().withColumn("h", F.lit(1)), ["case_id", "item"], "left")
    return hit.groupBy("case_id").agg(F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("h"), F.lit(0)).alias("hit")).withColumn("recall", F.round(F.col("hit") / F.col("wanted"), 6))


def summary(cases: DataFrame, *by: str) -> DataFrame:
    """Cases, mean recall, share with any hit and mean tokens; cases has recall, hit and tokens."""
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg((F.col("hit") > 0).cast("double")), 6).alias("any_hit"), F.round(F.avg("tokens"), 6).alias("tokens"))


def calibration(rows: DataFrame, by: list[str]) -> DataFrame:
    """Observations, confirmed ones and their share's interval by bucket; rows has ok and cluster."""
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("k"), F.countDistinct("cluster").alias("clusters"))
    lo, hi = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.withColumns({"rate": F.round(F.col("k") / F.col("n"), 6), "low": F.round(lo, 6), "high": F.round(hi, 6)})


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    p = (k1 + k2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0) & (se > 0), (k1 / n1 - k2 / n2) / se).otherwise(0.0)


def trend(rows: DataFrame) -> DataFrame:
    """Cochran-Armitage z of rows(level, ok), in one pass over counts by level; 0 with fewer than three levels."""
    g = rows.groupBy("level").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("ok").cast("double")).alias("k"))
    s = g.agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("level") * F.col("k")).alias("tk"), F.sum(F.col("level") * F.col("n")).alias("tn"), F.sum(F.col("level") * F.col("level") * F.col("n")).alias("ttn"))
    p = F.col("k") / F.col("n")
    var = p * (1 - p) * (F.col("ttn") - F.col("tn") * F.col("tn") / F.col("n"))
    return s.select("levels", F.round(F.when((F.col("levels") >= 3) & (var > 0), (F.col("tk") - p * F.col("tn")) / F.sqrt(var)).otherwise(0.0), 6).alias("z"))


def monotone(rates: DataFrame) -> DataFrame:
    """One row: whether rates(level, rate) never fall as levels rise. Levels are few."""
    w = W.orderBy("level")
    return rates.withColumn("up", F.coalesce(F.col("rate") >= F.lag("rate").over(w), F.lit(True))).agg(F.bool_and("up").alias("monotone"))


def p_value(z: float) -> float:
    """Two-sided p of a normal z."""
    return math.erfc(abs(z) / math.sqrt(2))


def sign_test(moved: DataFrame) -> DataFrame:
    """One row of moved(better, worse): exact two-sided p that as many of the moved pairs went one way by chance."""
    s = moved.agg(F.sum("better").alias("better"), F.sum("worse").alias("worse"))
    n, k = F.col("better") + F.col("worse"), F.least("better", "worse")
    # each term from the one before it, in logarithms, so that nothing vanishes: one pass over k terms
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(terms, start, step, lambda a: a["sum"])
    return s.withColumn("p", F.round(F.when(n > 0, F.least(2 * tail, F.lit(1.0))).otherwise(1.0), 6))


def clustered_null(rows: DataFrame, replicates: int = 4000, seed: int = 1) -> DataFrame:
    """One row (z, mean, sd, p, informative): the trend against a null of outcomes shuffled within strata. rows(stratum, level, ok).

    mean and sd are the null's, p is the share of replicates whose z is no less than the trend's (one-sided: the null needn't
    be centred at 0), informative the strata of more than one level; without any, mean and sd are 0 and p is 1.
    The null only needs counts by stratum and level: a shuffle within a stratum deals its confirmed rows over its levels by
    the multivariate hypergeometric law. Replicates are dealt over tasks; a stratum is a row of counts, not its rows.
    """
    counts = rows.groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("k"))
    level, n, k = F.col("level").cast("double"), F.col("n").cast("double"), F.col("k").cast("double")
    t = counts.agg(F.countDistinct("level").alias("levels"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(level * k).alias("tk"), F.sum(level * n).alias("tn"), F.sum(level * level * n).alias("ttn"))
    p = F.col("k") / F.col("n")
    var = p * (1 - p) * (F.col("ttn") - F.col("tn") * F.col("tn") / F.col("n"))
    t = t.select("tk", (p * F.col("tn")).alias("centre"), F.when((F.col("levels") >= 3) & (var > 0), F.sqrt(var)).alias("scale"))
    z = F.coalesce((F.col("tk") - F.col("centre")) / F.col("scale"), F.lit(0.0))
    strata = counts.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct(level.alias("level"), "n"))).alias("levels"), F.sum("k").alias("k"))
    told = t.select(z.alias("z"), "centre", "scale").join(strata.agg(F.count_if(F.size("levels") > 1).alias("informative")))
    step = 100
    jobs = strata.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(step)))).repartition("stratum", "r")

    def draw(batches):
        for pdf in batches:
            out = [pd.DataFrame({"r": np.zeros(0, np.int32), "tk": np.zeros(0)})]
            for s, levels, k, r in zip(pdf["stratum"], pdf["levels"], pdf["k"], pdf["r"]):
                rng = np.random.default_rng([seed, int(r), abs(hash_of(str(s)))])
                m = min(step, replicates - int(r))
                dealt = rng.multivariate_hypergeometric([int(x["n"]) for x in levels], int(k), size=m)
                out.append(pd.DataFrame({"r": np.arange(r, r + m, dtype=np.int32), "tk": dealt @ np.array([float(x["level"]) for x in levels])}))
            yield pd.concat(out)

    drawn = jobs.mapInPandas(draw, "r int, tk double").groupBy("r").agg(F.sum("tk").alias("tk"))
    null = drawn.join(F.broadcast(told)).select(z.alias("zr"), F.col("z").alias("z_obs"))
    drawn = null.agg(F.avg("zr").alias("mean"), F.stddev_samp("zr").alias("sd"), F.count_if(F.col("zr") >= F.col("z_obs") - 1e-9).alias("hits"), F.count(F.lit(1)).alias("drawn"))
    some = F.col("informative") > 0
    return told.join(drawn).select(
        F.round("z", 6).alias("z"), F.when(some, F.col("mean")).otherwise(0.0).alias("mean"), F.when(some, F.coalesce("sd", F.lit(0.0))).otherwise(0.0).alias("sd"),
        F.when(some, (F.col("hits") + 1) / (F.col("drawn") + 1)).otherwise(1.0).alias("p"), "informative",
    )


def hash_of(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())


def cluster_bootstrap(cases: DataFrame, draws: int = 2000, seed: int = 1) -> DataFrame:
    """One row (mean, low, high): the mean of cases(cluster, value) and its 95 % interval when as many clusters as there are
    are drawn again, with replacement.

    Clusters are reduced to sum and count and numbered; place i of draw r takes the cluster whose number a hash of (r, i)
    gives, so that places need no common state and are dealt over tasks. low and high are the draws at 2.5 and 97.5 %.
    """
    c = settled(cases.groupBy("cluster").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")))
    total = c.agg(F.count(F.lit(1)).alias("m"), (F.sum("s") / F.sum("n")).alias("mean"))
    numbered = numbered_from_zero(c, "cluster")
    places = total.select("m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r")).repartition("r")
    places = places.select("r", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
    drawn = places.select("r", F.pmod(F.xxhash64(F.lit(seed), "r", "i"), F.col("m")).alias("no")).groupBy("r", "no").agg(F.count(F.lit(1)).alias("t"))
    means = drawn.join(numbered, "no").groupBy("r").agg((F.sum(F.col("t") * F.col("s")) / F.sum(F.col("t") * F.col("n"))).alias("m"))
    low, high = int(0.025 * draws), int(0.975 * draws)
    ends = means.agg(F.array_sort(F.collect_list("m")).alias("m")).select(F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(high)).alias("high"))
    return total.select("mean").join(ends)


def numbered_from_zero(rows: DataFrame, key: str) -> DataFrame:
    """rows with no = 0, 1, ...: numbers inside blocks of hashed keys, then the blocks' totals, so that no task sorts all."""
    part = rows.withColumn("_slot", F.shiftrightunsigned(F.xxhash64(key), 40))
    sums = prefix_sums(part.groupBy("_slot").agg(F.count(F.lit(1)).alias("_many")), "_slot", "_many", "_base").drop("_many")
    inside = F.row_number().over(W.partitionBy("_slot").orderBy(key)) - 1
    return part.withColumn("_in", inside).join(sums, "_slot").withColumn("no", F.col("_base") + F.col("_in")).drop("_slot", "_in", "_base")


def paired(now: DataFrame, before: DataFrame) -> DataFrame:
    """One row that compares two runs case by case: now and before have case_id, recall and tokens; cases of one run only don't count.

    recall_gain and token_gain are mean differences; better, worse and same count the cases that moved; rescued had nothing
    before and lost have nothing now, of blind that had nothing before. p is the sign test's over those that moved.
    """
    b = before.select("case_id", F.col("recall").alias("r0"), F.col("tokens").alias("t0"))
    both = now.select("case_id", "recall", "tokens").join(b, "case_id")
    gain, had, has = F.col("recall") - F.col("r0"), F.col("r0") > 0, F.col("recall") > 0
    one = both.agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg(gain), 6).alias("recall_gain"), F.round(F.avg(F.col("tokens") - F.col("t0")), 6).alias("token_gain"),
        F.count_if(gain > 0).alias("better"), F.count_if(gain < 0).alias("worse"), F.count_if(gain == 0).alias("same"),
        F.count_if(~had & has).alias("rescued"), F.count_if(had & ~has).alias("lost"), F.count_if(~had).alias("blind"),
    )
    return one.join(sign_test(one.select("better", "worse")).select("p"))


def missing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(what, value, n) of symbols(file, name, kind) that only they have: by kind, by name where a name repeats (10), by file (5);
    and, as `relabelled`, how symbols that both have differ in kind (6)."""
    key = ["file", "name"]
    own = ours.select(*key, F.col("kind").alias("mine"))
    gone = theirs.select(*key, "kind").distinct().join(own.select(*key).distinct(), key, "left_anti")
    pairs = gone.select(*key).distinct()
    by = lambda rows, what, c, least, most: (lambda g: g.orderBy(F.desc("n"), "value").limit(most) if most else g)(rows.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)).select(F.lit(what).alias("what"), "value", "n")
    label = theirs.select(*key, "kind").distinct().join(own.groupBy(*key).agg(F.max("mine").alias("mine")), key).where("kind <> mine")
    label = label.withColumn("pair", F.concat_ws(" > ", "kind", "mine"))
    return by(gone, "kind", "kind", 1, None).unionByName(by(pairs, "name", "name", 2, 10)).unionByName(by(pairs, "file", "file", 1, 5)).unionByName(by(label, "relabelled", "pair", 1, 6))


def hub_callers(missed: DataFrame, most: int = 5) -> DataFrame:
    """(file, caller, n, share): the callers out of which most of the missed(file, caller, ...) calls go, and their share of all."""
    g = missed.groupBy("file", "caller").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "file", "caller").limit(most).join(missed.agg(F.count(F.lit(1)).alias("total"))).select("file", "caller", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def scraped(outputs: DataFrame, id_col: str, text_col: str, bytes_per_token: float = 3.5) -> DataFrame:
    """What another tool's printed answer holds: sources (files whose text it shows), cited (these and files named with a line),
    tokens of all and of the text inside fences."""
    text = F.col(text_col)
    lines = F.split(text, "\n")
    sources = F.array_distinct(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^\*\*`([^`]+)`\*\*", 1)), lambda x: x != ""))
    cited = F.regexp_extract_all(text, F.lit(r"\(([\w./-]+\.(?:py|ts|tsx|js|jsx)):\d+\)"), 1)
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("closed"))

    def step(s: Column, x: Column) -> Column:
        fence, size = x.startswith("```"), F.octet_length(x).cast("long") + 1
        return F.struct((s["inside"] != fence).alias("inside"), F.when(fence, F.lit(0).cast("long")).when(s["inside"], s["size"] + size).otherwise(s["size"]).alias("size"), F.when(fence & s["inside"], s["closed"] + s["size"]).otherwise(s["closed"]).alias("closed"))

    shown = F.aggregate(lines, start, step, lambda s: s["closed"])
    return outputs.select(
        F.col(id_col).alias("id"), sources.alias("sources"), F.array_sort(F.array_union(cited, sources)).alias("cited"),
        F.round(F.octet_length(text) / bytes_per_token, 6).alias("tokens"), F.round(shown / bytes_per_token, 6).alias("source_tokens"),
    )


def staged_confirmation(edges: DataFrame, observed: DataFrame, constructors: DataFrame, kin: DataFrame) -> DataFrame:
    """edges(caller, callee) with how the trace confirms each: exactly, as a constructor, through a related class, or not.

    observed(caller, callee); constructors(cls, init) maps a class to what calling it runs; kin(a, b) both ways.
    """
    seen = observed.select("caller", "callee").distinct()
    exact = edges.join(seen.withColumn("exact", F.lit(True)), ["caller", "callee"], "left")
    ctor = exact.join(constructors.select(F.col("cls").alias("callee"), "init"), "callee", "left").join(seen.select("caller", F.col("callee").alias("init"), F.lit(True).alias("ctor")), ["caller", "init"], "left")
    mro = seen.join(kin.select(F.col("a").alias("callee"), F.col("b").alias("rel")), "callee").select("caller", F.col("rel").alias("callee"), F.lit(True).alias("mro")).distinct()
    stage = F.when(F.col("exact"), "exact").when(F.col("ctor"), "constructor").when(F.col("mro"), "mro").otherwise("none")
    return ctor.join(mro, ["caller", "callee"], "left").select("caller", "callee", stage.alias("stage")).distinct()


def settled_precision(edges: DataFrame, observed: DataFrame, ran: DataFrame) -> DataFrame:
    """edges(caller, leaf, callee, conf) that a trace can judge - the caller ran and something of that leaf name was called -
    with right: whether it was this callee."""
    judged = edges.join(ran.select("caller").distinct(), "caller", "left_semi").join(observed.select("caller", "leaf").distinct(), ["caller", "leaf"], "left_semi")
    hit = observed.select("caller", "leaf", "callee").distinct().withColumn("right", F.lit(True))
    return judged.join(hit, ["caller", "leaf", "callee"], "left").withColumn("right", F.coalesce("right", F.lit(False)))


def fan_out(edges: DataFrame) -> DataFrame:
    """One row: (caller, leaf) groups of edges(caller, leaf, callee), edges, and edges a group."""
    g = edges.groupBy("caller", "leaf").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("edges"), F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("ratio"))


def presence(ours: DataFrame, theirs: DataFrame, key: list[str], kind: str = "kind") -> DataFrame:
    """One row: how many of their keys we have, and on how many of these the kinds agree."""
    both = theirs.select(*key, F.col(kind).alias("k2")).distinct().join(ours.select(*key, F.col(kind).alias("k1")).distinct(), key, "left")
    each = both.groupBy(*key).agg(F.max(F.col("k1").isNotNull()).alias("there"), F.max(F.coalesce(F.col("k1") == F.col("k2"), F.lit(False))).alias("same"))
    return each.agg(F.count(F.lit(1)).alias("theirs"), F.count_if("there").alias("present"), F.count_if("same").alias("agree"))


def standardised(rates: DataFrame, mix: DataFrame) -> DataFrame:
    """One row: the mean of rates(band, rate) under another mix(band, weight)."""
    return rates.join(mix, "band").agg(F.round(F.sum(F.col("rate") * F.col("weight")) / F.sum("weight"), 6).alias("rate"))


def test_outcomes(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(case_id, resolved): whether every wanted(case_id, test) passed by the last word of log(case_id, line_no, line) on it."""
    found = log.select("case_id", "line_no", F.regexp_extract("line", r"^(PASSED|FAILED|ERROR|SKIPPED)\s+(\S+)", 1).alias("status"), F.regexp_extract("line", r"^(PASSED|FAILED|ERROR|SKIPPED)\s+(\S+)", 2).alias("test")).where("status <> ''")
    last = found.groupBy("case_id", "test").agg(F.max_by("status", "line_no").alias("status"))
    return wanted.join(last, ["case_id", "test"], "left").groupBy("case_id").agg(F.bool_and(F.coalesce(F.col("status") == "PASSED", F.lit(False))).alias("resolved"))


def usable_id(test: Column) -> Column:
    """Test ids whose brackets balance."""
    n = lambda c: F.length(test) - F.length(F.replace(test, F.lit(c), F.lit("")))
    return n("[") == n("]")


def bug_fixes(commits: DataFrame, most: int) -> DataFrame:
    """The first commits(commit_id, subject, body, files) that fix something: subject says so, 2 to 8 files, 30 characters of text."""
    hit = commits.where(F.col("subject").rlike(r"(?i)\b(fix|bug|error|crash|regress|incorrect|broken)") & F.size("files").between(2, 8) & (F.length(F.concat_ws("\n", "subject", "body")) >= 30))
    return hit.orderBy("commit_id").limit(most)
