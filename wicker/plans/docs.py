"""Retrieval, selection and duplicate queries over documents, pages, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import dedup, evaluate, retrieve, select
from ..operators.iterate import written_once
from .bindings import SQL_NODES, star_nodes, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


LOW = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = lambda c: f"list_filter(string_split_regex(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
PROSE = lambda c: f"list_filter(list_transform(list_filter({WORDS(c)}, lambda x: strlen(x) BETWEEN 4 AND 24 AND regexp_matches(x, '[A-Za-z]')), lambda x: {LOW('x')}), lambda x: x NOT IN ({quoted(T.PROSE_STOP)}))"
ASKED = lambda c: f"list_distinct(list_filter(list_transform({WORDS(c)}, lambda x: {LOW('x')}), lambda x: strlen(x) >= 4 AND x NOT IN ({quoted(T.QUERY_STOP)})))"

#: (node_id, word): the first 96 distinct words of every document, by first place.
SQL_PROSE = f"""w AS (SELECT doc_id AS node_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {PROSE('text')} AS ws FROM documents)),
u AS (SELECT node_id, word, min(i) AS i FROM w GROUP BY 1, 2),
prose AS (SELECT node_id, word FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY i) AS k FROM u) WHERE k <= 96)"""
SQL_BM25 = f"""{SQL_PROSE},
len AS (SELECT node_id, count(*) AS n FROM prose GROUP BY 1), tot AS (SELECT count(*) AS nd, avg(n) AS av FROM len),
q AS (SELECT item_id AS query_id, unnest({ASKED('text')}) AS word FROM benchmark),
df AS (SELECT word, count(*) AS df FROM prose GROUP BY 1),
sc AS (SELECT query_id, node_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) / (0.25 + 0.75 * n / av)), 6) AS score FROM q JOIN df USING (word) JOIN prose USING (word) JOIN len USING (node_id), tot GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM sc) WHERE rank <= 10)"""


def prose(spark: SparkSession, sf: str) -> DataFrame:
    """The postings, written once and read by every query over words."""
    build = lambda folder: retrieve.prose_table(table(spark, sf, "documents"), "doc_id", "text").write.parquet(folder)
    return spark.read.parquet(written_once(spark, "prose", [f"{sf}/documents.parquet"], build)).select("node_id", "word")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.query_words(F.col("text"))).alias("word"))


@query(f"WITH {SQL_BM25} SELECT query_id, node_id, score, CAST(rank AS INT) AS rank FROM bm25")
def prose_seeds_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.bm25_seeds(prose(spark, sf), asked(spark, sf), 10)


@query(f"WITH {SQL_PROSE} SELECT lang, count(*) AS words, count(DISTINCT word) AS distinct_words, count(DISTINCT node_id) AS nodes FROM prose JOIN documents ON doc_id = node_id GROUP BY lang")
def prose_harvest_counts(spark: SparkSession, sf: str) -> DataFrame:
    langs = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "lang")
    return prose(spark, sf).join(langs, "node_id").groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("word").alias("distinct_words"), F.countDistinct("node_id").alias("nodes"))


@query(f"WITH {SQL_PROSE}, len AS (SELECT node_id, count(*) AS n FROM prose GROUP BY 1) SELECT count(*) AS n_docs, round(avg(n), 6) AS avg_len, (SELECT count(DISTINCT word) FROM prose) AS vocabulary FROM len")
def prose_statistics(spark: SparkSession, sf: str) -> DataFrame:
    p = prose(spark, sf)
    n = p.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n"), 6).alias("avg_len"))
    return n.join(p.agg(F.countDistinct("word").alias("vocabulary")))


SQL_PATHS = """files AS (SELECT page_id AS file_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"""


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("file_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


QUESTIONS = ["example pages about site number 12 item article", "host page of article topic index list", "www example site blog post news"]
SQL_QUESTIONS = "questions(query_id, text) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ")"
SQL_HITS = f"""{SQL_PATHS}, {SQL_QUESTIONS},
q AS (SELECT query_id, unnest({ASKED('text')}) AS word FROM questions),
parts AS (SELECT DISTINCT file_id, length(path) - length(replace(path, '/', '')) AS depth, unnest(string_split_regex({LOW('path')}, '[/._-]')) AS part FROM files),
hits AS (SELECT query_id, file_id, depth, count(DISTINCT word) AS hits FROM q JOIN parts ON part = word OR (length(word) >= 5 AND starts_with(part, word)) GROUP BY 1, 2, 3 HAVING count(DISTINCT word) >= 2)"""


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, text string")


@query(f"WITH {SQL_HITS} SELECT query_id, file_id, CAST(depth AS INT) AS depth, CAST(hits AS INT) AS hits FROM hits")
def path_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.path_hits(questions(spark), page_files(spark, sf), "query_id", "text").select("query_id", "file_id", "depth", "hits")


@query(f"""WITH {SQL_HITS},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, depth, file_id) AS f FROM hits) WHERE f <= 8),
n AS (SELECT f.query_id, f.f, k.i AS k, f.file_id * 10 + k.i AS node_id FROM f CROSS JOIN (VALUES (0), (1), (2)) k(i)),
two AS (SELECT * FROM n WHERE k < 2)
SELECT query_id, CAST(ord AS INT) AS ord, node_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f, k) AS ord FROM two) WHERE ord <= 8""")
def path_seed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Three nodes to a page; the two best of each file are taken."""
    files = page_files(spark, sf)
    nodes = files.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), "path").select("file_id", (F.col("file_id") * 10 + F.col("i")).alias("node_id"), "path", F.lit("function").alias("kind"))
    return retrieve.path_seeds(retrieve.path_hits(questions(spark), files, "query_id", "text"), nodes, 8)


TOKENS = lambda c: f"list_filter(flatten(list_transform(list_filter(string_split_regex(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}_.]+'), lambda x: strlen(x) >= 3), lambda r: list_append(string_split(r, '.'), r))), lambda x: strlen(x) >= 3)"
SHAPE = "CASE WHEN name LIKE '%!_%' ESCAPE '!' THEN 3 WHEN regexp_matches(name, '\\p{Lu}') AND regexp_matches(name, '\\p{Ll}') THEN 3 WHEN regexp_matches(name, '\\p{Lu}') THEN 2 ELSE 0 END"


@query(f"""WITH {SQL_NODES},
tok AS (SELECT query_id, name, min(i) AS i FROM (SELECT doc_id AS query_id, unnest(ts) AS name, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, {TOKENS("text || ' ASIA Europe ' || coalesce(lang, '')")} AS ts FROM documents)) GROUP BY 1, 2),
words AS (SELECT DISTINCT doc_id AS node_id, unnest({WORDS("text")}) AS name FROM documents),
cnt AS (SELECT name, min(node_id) AS node_id, count(*) AS n_defs FROM words GROUP BY 1),
hit AS (SELECT query_id, node_id, n_defs, i, {SHAPE} AS shape, {LOW('name')} IN ({quoted(T.QUERY_STOP)}) AS fallback FROM tok JOIN cnt USING (name)),
ok AS (SELECT * FROM hit WHERE CASE WHEN fallback THEN n_defs <= 2 ELSE n_defs <= 12 AND (shape > 0 OR n_defs <= 2) END),
st AS (SELECT *, bool_or(NOT fallback) OVER (PARTITION BY query_id) AS strong FROM ok)
SELECT query_id, node_id, CAST(shape AS INT) AS shape, CAST(n_defs AS INT) AS n_defs, fallback FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY i) AS k FROM st WHERE NOT fallback OR NOT strong) WHERE k = 1""")
def seeds_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents ask; every word of a document names it."""
    d = table(spark, sf, "documents")
    named = d.select(F.col("doc_id").alias("node_id"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("name"))
    if not d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # else a row's own words are distinct
        named = named.distinct()
    nodes = named.select("node_id", "name", F.lit("function").alias("kind"), F.lit("a").alias("path"))
    asked_ = d.select("doc_id", F.concat("text", F.lit(" ASIA Europe "), F.coalesce("lang", F.lit(""))).alias("text"))
    return retrieve.symbol_seeds(asked_, nodes, "doc_id", "text").select("query_id", "node_id", "shape", "n_defs", "fallback")


@query(f"""WITH {SQL_BM25}, {SQL_PATHS},
names AS (SELECT item_id AS query_id, 1 AS ord, item_id * 3 AS node_id FROM benchmark WHERE item_id % 4 = 0),
paths AS (SELECT item_id AS query_id, k AS ord, item_id * 5 + k AS node_id FROM benchmark CROSS JOIN range(1, 9) r(k) WHERE item_id % 3 = 0),
p3 AS (SELECT p.*, CASE WHEN p.ord <= 6 - coalesce(n.c, 0) THEN 1 ELSE 3 END AS phase FROM paths p LEFT JOIN (SELECT query_id, count(*) AS c FROM names GROUP BY 1) n USING (query_id)),
al AS (SELECT query_id, 0 AS phase, ord, node_id, 'seed' AS why FROM names UNION ALL SELECT query_id, phase, ord, node_id, 'path' FROM p3 UNION ALL SELECT query_id, 2, rank, node_id, 'prose' FROM bm25),
fi AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY phase, ord) AS k FROM al)
SELECT query_id, CAST(rank AS INT) AS rank, node_id, why FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, ord, node_id) AS rank FROM fi WHERE k = 1) WHERE rank <= 8""")
def seed_assembly(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    names = items.where("query_id % 4 = 0").select("query_id", F.lit(1).alias("ord"), (F.col("query_id") * 3).alias("node_id"))
    paths = items.where("query_id % 3 = 0").select("query_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("ord")).withColumn("node_id", F.col("query_id") * 5 + F.col("ord"))
    text = retrieve.bm25_seeds(prose(spark, sf), asked(spark, sf), 10).select("query_id", F.col("rank").alias("ord"), "node_id")
    return retrieve.assembled(names, paths, text, retrieve.max_seeds(25))


def why_of(rank) -> F.Column:
    return F.when(rank <= 3, "prose").when(rank % 4 == 0, "co-change").otherwise("caller")


SQL_ITEMS = f"""{SQL_BM25.replace('rank <= 10', 'rank <= 40')},
items AS (SELECT query_id, rank, node_id, CASE WHEN rank <= 3 THEN 'prose' WHEN rank % 4 = 0 THEN 'co-change' ELSE 'caller' END AS why, least(n_chars, 2400) AS size FROM bm25 JOIN documents ON doc_id = node_id)"""
SQL_KEPT = f"""WITH RECURSIVE {SQL_ITEMS},
f(query_id, rank, bytes, kept, co, took) AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM items
  UNION ALL
  SELECT i.query_id, i.rank, f.bytes + CASE WHEN t THEN i.size ELSE 0 END, f.kept + t::INT, f.co + (t AND i.why = 'co-change')::INT, t
  FROM f JOIN items i ON i.query_id = f.query_id AND i.rank = f.rank + 1,
       LATERAL (SELECT i.why = 'prose' OR ((CASE WHEN i.why = 'co-change' THEN f.co < 2 AND f.kept < 12 ELSE f.kept - f.co < 10 END) AND f.bytes + i.size <= 12000) AS t))"""


def context_items(spark: SparkSession, sf: str) -> DataFrame:
    size = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.least("n_chars", F.lit(2400)).alias("size"))
    ranked = retrieve.bm25_seeds(prose(spark, sf), asked(spark, sf), 40)
    return ranked.join(size, "node_id").select("query_id", "rank", "node_id", why_of(F.col("rank")).alias("why"), "size")


@query(f"{SQL_KEPT} SELECT f.query_id, CAST(f.rank AS INT) AS rank, node_id, why, size FROM f JOIN items USING (query_id, rank) WHERE took")
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    return select.select_budget(context_items(spark, sf), "query_id", 10, 12_000)


@query(f"""{SQL_KEPT} SELECT query_id, max(kept) AS kept, (SELECT count(*) FROM items i WHERE i.query_id = f.query_id) - max(kept) AS dropped, max(bytes) AS bytes, CAST(floor(max(bytes) * 2 / 7) AS BIGINT) AS est_tokens FROM f GROUP BY query_id""")
def context_stats(spark: SparkSession, sf: str) -> DataFrame:
    items = context_items(spark, sf)
    return select.context_stats(items, select.select_budget(items, "query_id", 10, 12_000), "query_id")


@query(f"""WITH RECURSIVE {SQL_ITEMS}, g AS (SELECT query_id, node_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, size FROM items),
f(query_id, rank, spent, took) AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM g
  UNION ALL SELECT g.query_id, g.rank, f.spent + CASE WHEN f.spent + g.size + 32 <= 8000 THEN g.size + 32 ELSE 0 END, f.spent + g.size + 32 <= 8000 FROM f JOIN g ON g.query_id = f.query_id AND g.rank = f.rank + 1)
SELECT query_id, CAST(f.rank AS INT) AS rank, item, size FROM f JOIN g USING (query_id, rank) WHERE took""")
def emit_source_budget(spark: SparkSession, sf: str) -> DataFrame:
    return select.emit_budget(context_items(spark, sf).select("query_id", "rank", F.col("node_id").alias("item"), "size"), "query_id", 8000)


SQL_KEYWORD = f"""post AS (SELECT DISTINCT source AS item, unnest({PROSE('text')}) AS word FROM documents),
q AS (SELECT item_id AS query_id, unnest({ASKED('text')}) AS word FROM benchmark),
kw AS (SELECT query_id, item, count(DISTINCT word) AS hits FROM q JOIN post USING (word) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, item) AS rank FROM kw)"""


def keyword_ranked(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "benchmark").select(F.explode(T.indexed(T.query_words(F.col("text")))).alias("word")).distinct()
    held = retrieve.keyword_postings(table(spark, sf, "documents"), "source", "text", wanted)
    postings = spark.read.parquet(written_once(spark, "sources", [f"{sf}/documents.parquet", f"{sf}/benchmark.parquet"], lambda folder: held.write.parquet(folder)))
    return retrieve.top(retrieve.keyword_hits(asked(spark, sf), postings), "hits", "item")


@query(f"WITH {SQL_KEYWORD} SELECT query_id, item, CAST(hits AS INT) AS hits, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10")
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_ranked(spark, sf).where("rank <= 10")


@query(f"""WITH {SQL_KEYWORD}, c AS (SELECT source AS item, CAST(sum(n_chars) * 2 // 700 AS BIGINT) AS cost FROM documents GROUP BY 1),
s AS (SELECT r.*, cost, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM ranked r JOIN c USING (item))
SELECT query_id, item, CAST(rank AS INT) AS rank, CAST(spent AS BIGINT) AS spent FROM s WHERE rank = 1 OR spent <= 2000""")
def keyword_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    cost = table(spark, sf, "documents").groupBy(F.col("source").alias("item")).agg(F.floor(F.sum("n_chars") * 2 / 700).alias("cost"))
    return retrieve.within_budget(keyword_ranked(spark, sf).join(cost, "item"), "cost", 2000).select("query_id", "item", "rank", "spent")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT 0 AS query_id, vec_id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), lambda p: p[1] * p[2])) /
  sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) * list_sum(list_transform(CAST(q.e AS DOUBLE[]), lambda x: x * x))), 6) AS score, 100 + vec_id % 50 AS cost FROM embeddings, q),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s),
t AS (SELECT *, sum(cost) OVER (ORDER BY rank) AS spent FROM r)
SELECT vec_id, CAST(rank AS INT) AS rank, score, CAST(spent AS BIGINT) AS spent FROM t WHERE rank = 1 OR spent <= 2500""")
def rag_cosine_budget(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = F.array(*map(F.lit, e.where("vec_id = 0").first()["embedding"]))
    scored = e.select(F.lit(0).alias("query_id"), "vec_id", F.round(retrieve.cosine(F.col("embedding"), q), 6).alias("score"), (100 + F.col("vec_id") % 50).alias("cost"))
    return retrieve.budgeted(scored, "score", "vec_id", "cost", 2500).select("vec_id", "rank", "score", "spent")


@query("""WITH l AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
c AS (SELECT id, l, unnest(range(0, greatest(len(l), 1), 30)) AS s FROM l)
SELECT id, CAST(s AS INT) AS first_line, CAST(len(l[s + 1:s + 40]) AS INT) AS n_lines, CAST(length(array_to_string(l[s + 1:s + 40], chr(10))) AS INT) AS chars FROM c""")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = retrieve.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return c.select("id", "first_line", "n_lines", F.length("body").alias("chars"))


REPORT = lambda c: f"list_transform({WORDS(c)}, lambda x: {LOW('x')})"
SQL_REPORTS = f"""rep AS (SELECT doc_id AS id, source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, {REPORT('text')} AS w FROM documents),
flat AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM rep),
tri AS (SELECT id, x || ' ' || lead(x, 1) OVER v || ' ' || lead(x, 2) OVER v AS m FROM flat WINDOW v AS (PARTITION BY id ORDER BY i)),
sh AS (SELECT DISTINCT id, m FROM tri WHERE m IS NOT NULL),
cw AS (SELECT id, list(DISTINCT x) AS cw FROM flat WHERE strlen(x) > 2 AND x NOT IN ({quoted(T.GRAMMAR)}) GROUP BY id),
fp AS (SELECT rep.id, grp, rank, coalesce(n, 0) AS n, coalesce(cw, []) AS cw FROM rep LEFT JOIN (SELECT id, count(*) AS n FROM sh GROUP BY id) s ON s.id = rep.id LEFT JOIN cw ON cw.id = rep.id)"""
SQL_COMPARED = f"""{SQL_REPORTS}, fit AS (SELECT * FROM fp WHERE n >= 8), xs AS (SELECT id, grp, rank, m FROM fit JOIN sh USING (id)),
cs AS (SELECT a.id, b.id AS prior, count(*) AS c FROM xs a JOIN xs b ON a.grp = b.grp AND a.m = b.m AND b.rank < a.rank AND b.rank >= a.rank - 300 GROUP BY 1, 2),
sc AS (SELECT p.id, p.prior, c / (a.n + b.n - c) AS copy, a.cw AS aw, b.cw AS bw FROM cs p JOIN fit a ON a.id = p.id JOIN fit b ON b.id = p.prior),
sim AS (SELECT id, prior, copy, CASE WHEN len(aw) = 0 OR len(bw) = 0 THEN 0 ELSE len(list_intersect(aw, bw)) / (len(aw) + len(bw) - len(list_intersect(aw, bw))) END AS txt FROM sc WHERE copy >= 0.3)"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.fingerprints(table(spark, sf, "documents"), "doc_id", "source", "text")


@query(f"WITH {SQL_COMPARED} SELECT id, prior, round(copy, 6) AS copy, round(txt, 6) AS text FROM sim WHERE copy >= 0.3")
def near_dup_shingles(spark: SparkSession, sf: str) -> DataFrame:
    near = dedup.recent_copies(table(spark, sf, "documents"), "doc_id", "source", "text", 0.3)
    return near.select("id", "prior", F.round("copy", 6).alias("copy"), F.round("text", 6).alias("text"))


@query(f"WITH {SQL_REPORTS} SELECT id, CAST(n AS INT) AS shingles, CAST(len(cw) AS INT) AS words FROM fp")
def near_dup_words(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select("id", F.size("shingles").alias("shingles"), F.size("words").alias("words"))


@query(f"WITH {SQL_COMPARED.replace(' AND b.rank >= a.rank - 300', '')} SELECT id, prior, round(copy, 6) AS copy FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(copy + txt, 9) DESC, prior DESC) AS k FROM sim WHERE copy >= 0.6) WHERE k = 1")
def near_dup_best(spark: SparkSession, sf: str) -> DataFrame:
    """Of all earlier documents of the source, however far back."""
    return dedup.best_copies(table(spark, sf, "documents"), "doc_id", "source", "text").select("id", "prior", F.round("copy", 6).alias("copy"))


@query(f"""WITH f AS (SELECT doc_id AS id, list_sort(list_distinct({ASKED('text')})[1:24]) AS x FROM documents) SELECT id FROM (SELECT doc_id AS id, list_sort({ASKED("CASE WHEN doc_id % 9 = 0 THEN text || ' rewritten' ELSE text END")}) AS a, list_sort({ASKED('text')}) AS b FROM documents) WHERE a <> b""")
def stale_seeds(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    stored = d.select(F.col("doc_id").alias("id"), T.query_words(F.col("text")).alias("seeds"))
    fresh = d.select(F.col("doc_id").alias("id"), T.query_words(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" rewritten"))).otherwise(F.col("text"))).alias("seeds"))
    return dedup.stale(stored, fresh)


@query("SELECT lang, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def by_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct("source").alias("sources"))


@query("SELECT lang, source, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def language_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: subtotals by language and source in one pass."""
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


@query(f"WITH {SQL_PROSE} SELECT word AS name, count(*) AS n FROM prose GROUP BY 1 ORDER BY n DESC, name LIMIT 25")
def top_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return prose(spark, sf).groupBy(F.col("word").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(25)


@query("SELECT ext, count(*) AS files FROM (SELECT regexp_extract(url, '[.]([^./]+)$', 1) AS ext FROM pages) WHERE ext NOT IN (" + quoted(S.LANGUAGES) + ") GROUP BY ext")
def unsupported_ext(spark: SparkSession, sf: str) -> DataFrame:
    ext = S.extension(F.col("url"))
    return table(spark, sf, "pages").select(ext.alias("ext")).where(~F.col("ext").isin(*S.LANGUAGES)).groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:?#]+)', 1)) AS host, length(url) - length(replace(url, '/', '')) AS depth,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:?#]+)', 1)) = 'example.com' OR lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:?#]+)', 1)) LIKE '%.example.com' AS ours,
  array_to_string(string_split(url, '/')[-2:], '/') AS short FROM pages""")
def url_check(spark: SparkSession, sf: str) -> DataFrame:
    host = S.host_of(F.col("url"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), S.depth(F.col("url")).cast("long").alias("depth"), S.host_matches(host, "example.com").alias("ours"), S.short_path(F.col("url")).alias("short"))


CONF_TEXT = "coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Confidence: HIGH' WHEN 1 THEN chr(10) || '<!-- confidence: low -->' || chr(10) || 'end' WHEN 2 THEN chr(10) || 'confidence: maybe' ELSE '' END"


@query(f"""WITH t AS (SELECT doc_id, string_split({CONF_TEXT}, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, l, list_filter(l, lambda x: regexp_matches(x, '(?i)^\\s*(?:<!--\\s*)?confidence:\\s*(high|medium|low)\\s*(?:-->)?\\s*$')) AS c FROM t)
SELECT doc_id, CASE WHEN len(c) > 0 THEN lower(regexp_extract(c[-1], '(?i)confidence:\\s*(high|medium|low)', 1)) ELSE 'medium' END AS confidence, CAST(len(l) - len(c) AS INT) AS lines FROM s""")
def split_confidence(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 4 == 0, "\nConfidence: HIGH").when(F.col("doc_id") % 4 == 1, "\n<!-- confidence: low -->\nend").when(F.col("doc_id") % 4 == 2, "\nconfidence: maybe").otherwise("")
    conf, rest = S.split_confidence(F.concat(F.coalesce("text", F.lit("")), said))
    return table(spark, sf, "documents").select("doc_id", conf.alias("confidence"), F.size(F.split(rest, "\n")).alias("lines"))


PATCH = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '+++ b/src/a.py' || chr(10) || '+x' WHEN 2 THEN '+++ b/.github/workflows/x.yml' WHEN 3 THEN '+++ /etc/passwd' WHEN 4 THEN '+++ b/../up.py' ELSE repeat('x', 60001 * CAST(doc_id % 12 = 5 AS INT)) || 'no files' END"


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN NULL WHEN 2 THEN 'forbidden path' WHEN 3 THEN 'outside the tree' WHEN 4 THEN 'outside the tree' ELSE CASE WHEN doc_id % 12 = 5 THEN 'too large' ELSE 'no files' END END AS reason FROM documents""")
def patch_vet(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 6
    patch = F.when(k == 0, "").when(k == 1, "+++ b/src/a.py\n+x").when(k == 2, "+++ b/.github/workflows/x.yml").when(k == 3, "+++ /etc/passwd").when(k == 4, "+++ b/../up.py").otherwise(F.concat(F.repeat(F.lit("x"), F.when(F.col("doc_id") % 12 == 5, 60_001).otherwise(0)), F.lit("no files")))
    return table(spark, sf, "documents").select("doc_id", S.patch_reason(patch).alias("reason"))


SQL_TRUTH = """truth AS (SELECT item_id AS case_id, doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
SQL_RECALL = f"""{SQL_BM25}, {SQL_TRUTH}, rc AS (SELECT case_id, count(*) AS wanted, count(b.node_id) AS hit, round(count(b.node_id) / count(*), 6) AS recall FROM truth LEFT JOIN bm25 b ON b.query_id = case_id AND b.node_id = item GROUP BY 1)"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """(case_id, item): documents that hold a benchmark text.

    Texts of five words or more find candidates by three words inside them, by equality. Shorter ones, which may begin and
    end within words, are looked for in every document: a stated set of questions against all rows.
    """
    cut = lambda c: F.split(c, r"\s+")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("needle"))
    long = F.size(cut(F.col("needle"))) >= 5
    keyed = b.where(long).withColumn("k", F.array_join(F.slice(cut(F.col("needle")), 2, 3), " "))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    d = docs.select("doc_id", F.explode(T.shingles(cut(F.col("text")), 3)).alias("k"))
    keys = d.join(keyed.select("k", "case_id"), "k").select("doc_id", "case_id").distinct()
    found = keys.join(docs, "doc_id").join(keyed, "case_id").where(F.contains("text", "needle")).select("case_id", F.col("doc_id").alias("item"))
    short = docs.join(b.where(~long), F.contains("text", "needle")).select("case_id", F.col("doc_id").alias("item"))
    return found.unionByName(short)


def recalls(spark: SparkSession, sf: str) -> DataFrame:
    got = retrieve.bm25_seeds(prose(spark, sf), asked(spark, sf), 10).select(F.col("query_id").alias("case_id"), F.col("node_id").alias("item"))
    return evaluate.recall_table(truth(spark, sf), got)


@query(f"WITH {SQL_RECALL} SELECT case_id, wanted, hit, recall FROM rc")
def recall_table(spark: SparkSession, sf: str) -> DataFrame:
    return recalls(spark, sf)


@query(f"WITH {SQL_RECALL} SELECT count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(CAST(hit > 0 AS DOUBLE)), 6) AS any_hit, round(avg(wanted * 100.0), 6) AS tokens FROM rc")
def at_least_one(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summary(recalls(spark, sf).withColumn("tokens", F.col("wanted") * 100.0))


@query(f"WITH {SQL_RECALL} SELECT wanted % 3 AS band, round(sum(wanted * 100.0) / nullif(sum(recall * 100), 0), 6) AS tokens_per_point FROM rc GROUP BY 1")
def tokens_per_point(spark: SparkSession, sf: str) -> DataFrame:
    return recalls(spark, sf).groupBy((F.col("wanted") % 3).alias("band")).agg(F.round(F.sum(F.col("wanted") * 100.0) / F.nullif(F.sum(F.col("recall") * 100), F.lit(0)), 6).alias("tokens_per_point"))


@query("""WITH d AS (SELECT doc_id, n_chars, doc_id * 7 % 5 / 4 AS r0, doc_id * 3 % 5 / 4 AS r1, n_chars // 4 AS t0, n_chars // 5 AS t1 FROM documents WHERE doc_id % 3 <> 0),
s AS (SELECT count(*) AS cases, round(avg(r1 - r0), 6) AS recall_gain, round(avg(t1 - t0), 6) AS token_gain, count(*) FILTER (r1 > r0) AS better, count(*) FILTER (r1 < r0) AS worse, count(*) FILTER (r1 = r0) AS same,
  count(*) FILTER (r0 = 0 AND r1 > 0) AS rescued, count(*) FILTER (r0 > 0 AND r1 = 0) AS lost, count(*) FILTER (r0 = 0) AS blind FROM d WHERE doc_id % 4 <> 0),
i AS (SELECT unnest(range(0, (SELECT least(better, worse) + 1 FROM s))) AS i)
SELECT s.*, round(least(1.0, 2 * (SELECT sum(exp(lgamma(better + worse + 1) - lgamma(i + 1) - lgamma(better + worse - i + 1) - (better + worse) * ln(2))) FROM i)), 6) AS p FROM s""")
def paired_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two made-up runs over documents; each has some cases that the other lacks."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "n_chars")
    run = lambda rows, k, cost: rows.select("case_id", (F.col("case_id") * k % 5 / 4).alias("recall"), F.floor(F.col("n_chars") / cost).alias("tokens"))
    return evaluate.paired(run(d.where("case_id % 4 <> 0"), 3, 5), run(d.where("case_id % 3 <> 0"), 7, 4))


@query("""WITH t AS (SELECT doc_id, '**`src/m' || CAST(doc_id % 3 AS VARCHAR) || '.py`** text' || chr(10) || '```' || chr(10) || coalesce(lang, '?') || chr(10) || '```' || chr(10) || 'see (lib/x' || CAST(doc_id % 4 AS VARCHAR) || '.ts:12)' AS x, coalesce(lang, '?') AS l FROM documents)
SELECT doc_id AS id, 'src/m' || CAST(doc_id % 3 AS VARCHAR) || '.py' AS sources, 'lib/x' || CAST(doc_id % 4 AS VARCHAR) || '.ts,src/m' || CAST(doc_id % 3 AS VARCHAR) || '.py' AS cited, round(strlen(x) / 3.5, 6) AS tokens, round((strlen(l) + 1) / 3.5, 6) AS source_tokens FROM t""")
def scraped_answers(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    said = F.concat(F.lit("**`src/m"), (i % 3).cast("string"), F.lit(".py`** text\n```\n"), F.coalesce("lang", F.lit("?")), F.lit("\n```\nsee (lib/x"), (i % 4).cast("string"), F.lit(".ts:12)"))
    out = evaluate.scraped(table(spark, sf, "documents").select("doc_id", said.alias("said")), "doc_id", "said")
    return out.select("id", F.array_join("sources", ",").alias("sources"), F.array_join("cited", ",").alias("cited"), "tokens", "source_tokens")


@query("""WITH d AS (SELECT DISTINCT sha1(text) AS key, text FROM documents WHERE text IS NOT NULL) SELECT key, CAST(CASE WHEN starts_with(key, '0') THEN -1 ELSE length(text) END AS INT) AS vectors FROM d""")
def vectors_by_content(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that begin with 0 are known; a text's length stands for its vectors."""
    docs = table(spark, sf, "documents").select("text")
    known = docs.where("text IS NOT NULL").select(F.sha1(F.col("text").cast("binary")).alias("key")).where("key LIKE '0%'").distinct().withColumn("vectors", F.lit(-1))
    return retrieve.vectors_by_content(docs, known, "text", lambda new: new.select("key", F.length("text").alias("vectors")))
