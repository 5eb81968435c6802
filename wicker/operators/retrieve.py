"""Finding nodes and documents by name, path, prose, keyword or vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import candidate_rank, depth
from .iterate import written


def prose_table(docs: DataFrame, id_col: str, text_col: str, cap: int = 96) -> DataFrame:
    """(node_id, word, pos): each document's first ``cap`` distinct words worth indexing."""
    return docs.select(F.col(id_col).alias("node_id"), F.posexplode(F.slice(F.array_distinct(T.prose_words(F.col(text_col))), 1, cap)).alias("pos", "word")).select("node_id", "word", "pos")


def bm25_seeds(prose: DataFrame, query: DataFrame, most: int, b: float = 0.75) -> DataFrame:
    """(query_id, node_id, score): nodes by the rarity of the query's words in them, long ones discounted.

    prose(node_id, word), distinct; query(query_id, word), distinct. One pass counts words by document, one counts documents
    by word; only words that some query holds go into the join.
    """
    length = prose.groupBy("node_id").agg(F.count(F.lit(1)).alias("len"))
    total = length.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    wanted = prose.join(query.select("word").distinct(), "word", "left_semi")
    df = wanted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(1 - b) + F.lit(b) * F.col("len") / F.col("avg_len")
    hits = query.join(df, "word").join(wanted, "word").join(length, "node_id").join(F.broadcast(total))  # total is one row
    scored = hits.groupBy("query_id", "node_id").agg(F.round(F.sum(idf / norm), 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def find(nodes: DataFrame, names: list[str], most: int | None = 50) -> DataFrame:
    """Nodes of exactly these names, files by path included, by id; at most so many of each name, or all."""
    if most is None:
        return nodes.where(F.col("name").isin(names))
    w = W.partitionBy("name").orderBy("node_id")
    return nodes.where(F.col("name").isin(names)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def ranked_names(nodes: DataFrame) -> DataFrame:
    """The best node of every name: not a test, not a variable, shallow, then the smaller id; with the number of its namesakes.

    Nodes of one name, rank and depth are hashed together before any are compared as structs, which would sort them all.
    """
    alike = nodes.groupBy("name", candidate_rank(F.col("path"), F.col("kind")).alias("rank"), depth(F.col("path")).alias("depth")).agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("n"))
    return alike.groupBy("name").agg(F.min(F.struct("rank", "depth", "node_id")).alias("best"), F.sum("n").cast("int").alias("n_defs")).select("name", "best.node_id", "n_defs")


def named_seeds(nodes: DataFrame, owners: DataFrame, asked: list[str]) -> DataFrame:
    """Seeds for explicit names; Owner.name keeps the candidates whose owner has that name, unless none does.

    owners(node_id, owner) gives the name of each node's container.
    """
    spark = nodes.sparkSession
    pairs = [(i, a, a.split(".", 1)[0] if "." in a else None, a.split(".", 1)[-1]) for i, a in enumerate(asked)]
    want = spark.createDataFrame(pairs, "ord int, asked string, want_owner string, name string")
    hit = want.join(nodes, "name").join(owners, "node_id", "left").withColumn("own", F.coalesce(F.col("owner") == F.col("want_owner"), F.lit(False)))
    by = W.partitionBy("ord")
    kept = hit.withColumn("any", F.max("own").over(by)).where("own OR NOT any")
    w = by.orderBy(candidate_rank(F.col("path"), F.col("kind")), depth(F.col("path")), "node_id")
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ord", "asked", "node_id")


#: The names most defined among those that can't be leads: a text's mentions of them go no further than its own task.
COMMONEST = 1 << 16


def symbol_seeds(questions: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, node_id, shape, n_defs, pos, fallback): leads that a text names.

    Names with more than 12 definitions are common words; plain lower-case ones are leads only with two or fewer. Stop words
    count only where nothing else is found, and only with two definitions or fewer. What a name can be is told by itself and
    its definitions, so that names are judged once and tokens meet only those that can be leads.
    """
    stop = T.listed(T.ascii_lower(F.col("name")), T.QUERY_STOP)
    lead = F.when(F.col("fallback"), F.col("n_defs") <= 2).otherwise((F.col("n_defs") <= 12) & ((F.col("shape") > 0) | (F.col("n_defs") <= 2)))
    best = written(ranked_names(nodes).withColumns({"shape": T.identifier_shape(F.col("name")), "fallback": stop}).withColumn("lead", lead))
    common = best.where(~F.col("lead")).orderBy(F.desc("n_defs"), "name").limit(COMMONEST).select("name")
    tokens = questions.select(F.col(id_col).alias("query_id"), F.posexplode(T.symbol_names(F.col(text_col))).alias("pos", "name"))
    hit = tokens.join(F.broadcast(common), "name", "left_anti").join(best.where("lead").drop("lead"), "name")  # the first only spares rows
    strong = F.max(~F.col("fallback")).over(W.partitionBy("query_id"))
    hit = hit.withColumn("strong", strong).where(~F.col("fallback") | ~F.col("strong"))
    first = W.partitionBy("query_id", "node_id").orderBy("pos")
    return hit.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query_id", "node_id", "shape", "n_defs", "pos", "fallback")


def path_hits(questions: DataFrame, files: DataFrame, id_col: str, text_col: str, path_col: str = "path") -> DataFrame:
    """(query_id, file_id, hits, depth): files with two or more of a question's words in their path.

    A path part matches a word that it equals, or one of 5 bytes or more that it begins with: parts are exploded into their
    beginnings, so that the join is on equality.
    """
    words = questions.select(F.col(id_col).alias("query_id"), F.explode(T.query_words(F.col(text_col))).alias("word"))
    low = T.ascii_lower(F.col(path_col))
    parts = files.select("file_id", depth(low).alias("depth"), F.explode(F.array_distinct(F.split(low, "[/._-]"))).alias("part")).where("part <> ''")
    heads = F.transform(F.sequence(F.lit(0), F.greatest(F.length("part") - 5, F.lit(0))), lambda i: F.col("part").substr(F.lit(1), F.when(i == 0, F.length("part")).otherwise(i + 4)))
    keys = parts.select("file_id", "depth", F.explode(F.array_distinct(heads)).alias("word")).distinct()
    # heads shorter than 5 bytes are whole parts; those of 5 or more are whole parts or beginnings
    return words.join(keys, "word").groupBy("query_id", "file_id", "depth").agg(F.countDistinct("word").cast("int").alias("hits")).where("hits >= 2")


def path_seeds(hits: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(query_id, ord, node_id): of each question's best files, most words first, the two best nodes each."""
    w = W.partitionBy("query_id").orderBy(F.desc("hits"), "depth", "file_id")
    top = hits.withColumn("f", F.row_number().over(w)).where(F.col("f") <= most)
    v = W.partitionBy("query_id", "f").orderBy(candidate_rank(F.col("path"), F.col("kind")), depth(F.col("path")), "node_id")
    two = top.select("query_id", "f", "file_id").join(nodes, "file_id").withColumn("k", F.row_number().over(v)).where("k <= 2")
    return two.withColumn("ord", F.row_number().over(W.partitionBy("query_id").orderBy("f", "k"))).where(F.col("ord") <= most).select("query_id", "ord", "node_id")


def max_seeds(max_nodes: int) -> int:
    return min(max(max_nodes // 3, 4), 32)


def assembled(names: DataFrame, paths: DataFrame, prose: DataFrame, most: int) -> DataFrame:
    """(query_id, rank, node_id, why): names first, paths up to three quarters, then prose, then the paths left over.

    Each input has (query_id, ord, node_id). A node counts where it first appears.
    """
    room = most - most // 4
    n_names = names.groupBy("query_id").agg(F.count(F.lit(1)).alias("nn"))
    p = paths.join(n_names, "query_id", "left").withColumn("left", F.greatest(F.lit(room) - F.coalesce("nn", F.lit(0)), F.lit(0)))
    phase = F.when(F.col("ord") <= F.col("left"), 1).otherwise(3)
    rows = names.select("query_id", F.lit(0).alias("phase"), "ord", "node_id", F.lit("seed").alias("why"))
    rows = rows.unionByName(p.select("query_id", phase.alias("phase"), "ord", "node_id", F.lit("path").alias("why")))
    rows = rows.unionByName(prose.select("query_id", F.lit(2).alias("phase"), "ord", "node_id", F.lit("prose").alias("why")))
    first = rows.groupBy("query_id", "node_id").agg(F.min(F.struct("phase", "ord", "why")).alias("m"))
    w = W.partitionBy("query_id").orderBy("m.phase", "m.ord", "node_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "rank", "node_id", "m.why")


def keyword_postings(docs: DataFrame, item_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(item, word), distinct: which of the wanted(word), all of them lowered and worth indexing, each item's texts hold.

    All words of all texts are looked up, in the task that reads them; the rest of the vocabulary is in no answer and isn't kept.
    """
    words = docs.select(F.col(item_col).alias("item"), F.explode(T.words(F.col(text_col))).alias("word")).select("item", T.ascii_lower(F.col("word")).alias("word"))
    return words.join(wanted, "word", "left_semi").distinct().select("item", "word")


def keyword_hits(query: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, item, hits): distinct words of the query(query_id, word) that postings(item, word) has."""
    return query.join(postings, "word").groupBy("query_id", "item").agg(F.countDistinct("word").cast("int").alias("hits"))


def top(scored: DataFrame, by: str, item: str, k: int | None = None) -> DataFrame:
    """Ranks from 1 on within each query; the first k of them, or all."""
    w = W.partitionBy("query_id").orderBy(F.desc(by), item)
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def within_budget(ranked: DataFrame, cost_col: str, budget: int) -> DataFrame:
    """Rows in rank order until the first that overflows; the first row always stays."""
    w = W.partitionBy("query_id").orderBy("rank")
    total = F.sum(cost_col).over(w.rowsBetween(W.unboundedPreceding, 0))
    over = ranked.withColumn("spent", total.cast("long"))
    return over.where((F.col("rank") == 1) | (F.col("spent") <= budget))


def budgeted(scored: DataFrame, by: str, item: str, cost: str, budget: int) -> DataFrame:
    """The best rows of each query within a budget, with rank and spent; the first always stays, costs are 0 or more.

    What lies behind the budget is left out before rows are ranked: costs are summed by thousandths of the score, and rows of
    a step that better steps have already overspent can't be reached. So no task ranks a whole query's rows.
    """
    steps = scored.withColumn("_step", F.floor(F.col(by) * 1000))
    sums = steps.groupBy("query_id", "_step").agg(F.sum(cost).alias("c"))
    better = F.coalesce(F.sum("c").over(W.partitionBy("query_id").orderBy(F.desc("_step")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumn("before", better).where(F.col("before") <= budget).select("query_id", "_step")
    return within_budget(top(steps.join(near, ["query_id", "_step"], "left_semi").drop("_step"), by, item), cost, budget)


def vectors_by_content(docs: DataFrame, known: DataFrame, text_col: str, embed) -> DataFrame:
    """(key, vectors) of every distinct text of docs: from known(key, vectors) where its hash is there, else by embed(DataFrame(key, text)).

    The key is the SHA-1 of the text's bytes, so that a text is embedded once, whatever rows, names or commits it has.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.sha1(F.col(text_col).cast("binary")).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    new = embed(texts.join(known, "key", "left_anti"))
    return texts.select("key").join(known.select("key", "vectors"), "key").unionByName(new.select("key", "vectors"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def chunks(docs: DataFrame, id_col: str, text_col: str, lines: int = 40, step: int = 30) -> DataFrame:
    """(id, first_line, n_lines, body): windows of so many lines, each so many after the last; the last may be short."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.size(split) - 1, F.lit(0)), F.lit(step))
    cut = docs.select(F.col(id_col).alias("id"), split.alias("l"), F.explode(starts).alias("first_line"))
    body = F.slice("l", F.col("first_line") + 1, lines)
    return cut.select("id", "first_line", F.size(body).alias("n_lines"), F.array_join(body, "\n").alias("body"))
