"""Graph queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import answers, evaluate, graph, ids, resolve, retrieve
from ..operators.iterate import written
from . import bindings as B
from .bindings import SQL_CONTAINS, SQL_EDGES, SQL_NODES, SQL_RESOLVED

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {SQL_NODES} SELECT node_id, name, kind FROM nodes WHERE name IN ('EUROPE', 'Supplier#000000007', 'Customer#000000042') OR name = (SELECT min(p_name) FROM part)")
def name_find(spark: SparkSession, sf: str) -> DataFrame:
    nodes = B.star_nodes(spark, sf)
    least = nodes.where("kind = 'variable'").agg(F.min("name")).first()[0]
    return retrieve.find(nodes, ["EUROPE", "Supplier#000000007", "Customer#000000042", least], None).select("node_id", "name", "kind")


#: Some nodes that are asked about.
S1, S2, S3, S4, S7 = (B.number("supplier", k) for k in (1, 2, 3, 4, 7))
C1, C2, C3 = (B.number("customer", k) for k in (1, 2, 3))
N3, R1, R2 = B.number("nation", 3), B.number("region", 1), B.number("region", 2)
RANK = "(CASE WHEN path LIKE '%/test%' OR path LIKE '%!_test.%' ESCAPE '!' OR path LIKE '%.test.%' THEN 2 ELSE 0 END + CASE WHEN kind IN ('variable', 'module') THEN 1 ELSE 0 END)"
DEPTH = "(length(path) - length(replace(path, '/', '')))"


@query(f"WITH {SQL_NODES} SELECT name, node_id, CAST(n AS INT) AS n_defs FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY {RANK}, {DEPTH}, node_id) AS k FROM nodes) WHERE k = 1")
def name_seeds_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.ranked_names(B.star_nodes(spark, sf))


@query(f"""WITH {SQL_NODES}, {SQL_CONTAINS},
asked(ord, asked, want_owner, name) AS (VALUES (0, 'Supplier#000000003', NULL, 'Supplier#000000003'), (1, (SELECT n_name FROM nation WHERE n_nationkey = 3) || '.Customer#000000005', (SELECT n_name FROM nation WHERE n_nationkey = 3), 'Customer#000000005'), (2, 'ASIA', NULL, 'ASIA')),
hit AS (SELECT a.ord, a.asked, n.*, coalesce(p.name = a.want_owner, false) AS own FROM asked a JOIN nodes n ON n.name = a.name LEFT JOIN contains_edges c ON c.dst = n.node_id LEFT JOIN nodes p ON p.node_id = c.src),
kept AS (SELECT * FROM (SELECT *, bool_or(own) OVER (PARTITION BY ord) AS hit_owner FROM hit) WHERE own OR NOT hit_owner)
SELECT ord, asked, node_id FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY {RANK}, {DEPTH}, node_id) AS k FROM kept) WHERE k = 1""")
def explicit_seeds(spark: SparkSession, sf: str) -> DataFrame:
    nodes, contains = B.star_nodes(spark, sf), B.star_contains(spark, sf)
    owners = contains.join(nodes.select(F.col("node_id").alias("src"), F.col("name").alias("owner")), "src").select(F.col("dst").alias("node_id"), "owner")
    third = B.table(spark, sf, "nation").where("n_nationkey = 3").first()["n_name"]
    return retrieve.named_seeds(nodes, owners, ["Supplier#000000003", f"{third}.Customer#000000005", "ASIA"])


def neighbour_sql(near: str, far: str, ids_: str, conf: int) -> str:
    return f"""WITH {SQL_NODES}, {SQL_EDGES}
SELECT f.of, f.node_id, n.name, f.edge, f.conf, f.prov FROM (
  SELECT *, row_number() OVER (PARTITION BY of ORDER BY conf DESC, node_id, edge) AS k
  FROM (SELECT {near} AS of, {far} AS node_id, kind AS edge, conf, prov FROM edges WHERE {near} IN ({ids_}) AND conf >= {conf})) f
JOIN nodes n USING (node_id) WHERE k <= 25"""


@query(neighbour_sql("dst", "src", f"{S1}, {S2}, {C3}", 0))
def callers(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(B.star_edges(spark, sf, "dst"), B.star_nodes(spark, sf), [S1, S2, C3], forward=False)


@query(neighbour_sql("src", "dst", f"{C1}, {C2}, {N3}", 60))
def callees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(B.star_edges(spark, sf), B.star_nodes(spark, sf), [C1, C2, N3], forward=True, min_conf=60)


@query(f"WITH {SQL_EDGES} SELECT node_id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS node_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node_id")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(B.star_edges(spark, sf))


@query(f"WITH {SQL_NODES}, {SQL_CONTAINS} SELECT p.name AS parent, p.kind AS parent_kind, c.name AS child, c.kind AS child_kind FROM contains_edges e JOIN nodes p ON p.node_id = e.src JOIN nodes c ON c.node_id = e.dst")
def containment_tree(spark: SparkSession, sf: str) -> DataFrame:
    nodes = B.star_nodes(spark, sf)
    p = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("parent"), F.col("kind").alias("parent_kind"))
    c = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("child"), F.col("kind").alias("child_kind"))
    return B.star_contains(spark, sf).join(p, "src").join(c, "dst").select("parent", "parent_kind", "child", "child_kind")


@query(f"""WITH {SQL_NODES}, {SQL_CONTAINS}
SELECT n.node_id, CASE WHEN p.kind = 'module' THEN p.name || '.' || n.name ELSE n.name END AS qualified
FROM nodes n LEFT JOIN contains_edges c ON c.dst = n.node_id LEFT JOIN nodes p ON p.node_id = c.src WHERE n.kind <> 'file'""")
def qualified_names(spark: SparkSession, sf: str) -> DataFrame:
    return graph.qualified_names(B.star_nodes(spark, sf), B.star_contains(spark, sf), "file")


@query(f"WITH {SQL_RESOLVED} SELECT ref, dst, locality, CAST(n AS INT) AS n, conf FROM resolved WHERE conf IS NOT NULL")
def resolve_tier3(spark: SparkSession, sf: str) -> DataFrame:
    return B.star_resolved(spark, sf).where("conf IS NOT NULL").select("ref", "dst", "locality", "n", "conf")


@query(f"""WITH {SQL_RESOLVED}, o AS (SELECT ref, CASE WHEN max(n) = 1 THEN 'name_unique' WHEN max(n) <= 8 THEN 'name_ambiguous' ELSE 'too_ambiguous' END AS outcome FROM resolved GROUP BY ref),
a AS (SELECT coalesce(o.outcome, 'external') AS outcome FROM orders LEFT JOIN o ON o.ref = o_orderkey)
SELECT count(*) AS total_refs, count(*) FILTER (outcome <> 'external') AS in_repo, count(*) FILTER (outcome LIKE 'name%') AS resolved, count(*) FILTER (outcome = 'name_unique') AS name_unique,
       count(*) FILTER (outcome = 'name_ambiguous') AS name_ambiguous, count(*) FILTER (outcome = 'too_ambiguous') AS too_ambiguous,
       CAST(0 AS BIGINT) AS scope, CAST(0 AS BIGINT) AS "import", CAST(0 AS BIGINT) AS weak_read, CAST(0 AS BIGINT) AS builtin, count(*) FILTER (outcome = 'external') AS external,
       round(count(*) FILTER (outcome LIKE 'name%') / count(*) FILTER (outcome <> 'external'), 6) AS rate FROM a""")
def resolve_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = B.star_resolved(spark, sf).groupBy("ref").agg(F.max("n").alias("n"))
    refs = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ref")).join(n, "ref", "left")
    return resolve.outcome_counts(refs.select(F.when(F.col("n").isNull(), "external").when(F.col("n") == 1, "name_unique").when(F.col("n") <= 8, "name_ambiguous").otherwise("too_ambiguous").alias("outcome")))


@query(f"WITH {SQL_RESOLVED}, g AS (SELECT src, ref, count(*) AS n FROM resolved WHERE conf IS NOT NULL GROUP BY src, ref) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS edges, round(sum(n) / count(*), 6) AS ratio FROM g")
def ambiguity_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.fan_out(B.star_resolved(spark, sf).where("conf IS NOT NULL").select(F.col("src").alias("caller"), F.col("ref").alias("leaf"), F.col("dst").alias("callee")))


@query(f"""WITH t AS (SELECT c_custkey AS ref, c_nationkey AS n FROM customer),
def AS (SELECT n_nationkey AS n, n_regionkey AS r, max(s_suppkey) AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0 GROUP BY 1, 2),
reg AS (SELECT r_regionkey AS r, {B.node_sql("region", "r_regionkey")} AS node FROM region)
SELECT ref, CAST(coalesce({B.node_sql("supplier", "def.node")}, reg.node) AS BIGINT) AS dst, 100 AS conf, 'scope' AS prov
FROM t JOIN nation ON n_nationkey = t.n LEFT JOIN def ON def.n = t.n JOIN reg ON reg.r = n_regionkey""")
def resolve_tier1_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Customers refer to 'home' from their nation's scope; even suppliers define it there, every region around it does too."""
    t = lambda n: B.table(spark, sf, n)
    scopes = t("nation").select(B.node("nation", "n_nationkey").alias("scope"), B.node("region", "n_regionkey").alias("parent")).unionByName(t("region").select(B.node("region", "r_regionkey").alias("scope"), F.lit(None).cast("long").alias("parent")))
    defs = t("supplier").where("s_suppkey % 2 = 0").select(B.node("supplier", "s_suppkey").alias("node"), B.node("nation", "s_nationkey").alias("scope"), F.lit("home").alias("name"), F.col("s_suppkey").alias("ord"))
    defs = defs.unionByName(t("region").select(B.node("region", "r_regionkey").alias("node"), B.node("region", "r_regionkey").alias("scope"), F.lit("home").alias("name"), F.lit(0).cast("long").alias("ord")))
    refs = t("customer").select(F.col("c_custkey").alias("ref"), B.node("nation", "c_nationkey").alias("scope"), F.lit("home").alias("name"))
    return resolve.resolve_scoped(refs, resolve.scope_chain(scopes), defs)


@query(f"WITH {SQL_EDGES} SELECT src, dst, kind, conf, prov FROM edges")
def edge_dedup_best(spark: SparkSession, sf: str) -> DataFrame:
    return B.star_edges(spark, sf)


def impact_sql(start: int, depth: int, conf: int, skip: bool) -> str:
    return f"""WITH RECURSIVE {SQL_EDGES}, use AS (SELECT DISTINCT src, dst FROM edges WHERE conf >= {conf} {"AND kind <> 'contains'" if skip else ''}),
r(node_id, hops) AS (SELECT CAST({start} AS BIGINT), 0 UNION SELECT use.src, hops + 1 FROM r JOIN use ON use.dst = r.node_id WHERE hops < {depth})
SELECT node_id, min(hops) AS hops FROM r GROUP BY node_id HAVING min(hops) > 0"""


@query(impact_sql(S1, 3, 60, False))
def impact_k3(spark: SparkSession, sf: str) -> DataFrame:
    return graph.impact(B.star_edges(spark, sf, "dst"), [S1], 3, 60)


@query(impact_sql(S2, 2, 45, True))
def impact_skip_contains(spark: SparkSession, sf: str) -> DataFrame:
    return graph.impact(B.star_edges(spark, sf, "dst"), [S2], 2, 45, skip_contains=True)


def path_ctes(a: int, b: int, x: str) -> str:
    """Tables r, d, p and back of the shortest path from a to b, their names ending in x."""
    return f"""r{x}(node_id, hops) AS (SELECT CAST({a} AS BIGINT), 0 UNION SELECT use.dst, hops + 1 FROM r{x} JOIN use ON use.src = r{x}.node_id WHERE hops < 8),
d{x} AS (SELECT node_id, min(hops) AS hops FROM r{x} GROUP BY node_id),
p{x} AS (SELECT d.node_id, d.hops, min(use.src) AS parent FROM d{x} d JOIN use ON use.dst = d.node_id JOIN d{x} e ON e.node_id = use.src AND e.hops = d.hops - 1 GROUP BY 1, 2),
back{x}(node_id, pos) AS (SELECT node_id, hops FROM d{x} WHERE node_id = {b} UNION ALL SELECT p.parent, b.pos - 1 FROM back{x} b JOIN p{x} p ON p.node_id = b.node_id)"""


def path_sql(a: int, b: int) -> str:
    return f"WITH RECURSIVE {SQL_EDGES}, use AS (SELECT DISTINCT src, dst FROM edges), {path_ctes(a, b, '')} SELECT pos, node_id FROM back"


def flow_sql(a: int, b: int) -> str:
    return f"""WITH RECURSIVE {SQL_EDGES}, use AS (SELECT DISTINCT src, dst FROM edges), {path_ctes(a, b, '1')}, {path_ctes(b, a, '2')}
SELECT pos, node_id, false AS reversed FROM back1 UNION ALL SELECT pos, node_id, true FROM back2 WHERE NOT EXISTS (SELECT 1 FROM back1)"""


@query(path_sql(R1, S4))
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shortest_path(B.star_edges(spark, sf), R1, S4)


@query(flow_sql(S7, R2))
def flow(spark: SparkSession, sf: str) -> DataFrame:
    return graph.flow(B.star_edges(spark, sf), S7, R2)


@query(f"""WITH {SQL_EDGES}, seeds(node_id) AS (VALUES (CAST({C1} AS BIGINT)), (CAST({S3} AS BIGINT))),
both_ways AS (SELECT dst AS of, src AS node_id, conf, 0.6 AS w FROM edges UNION ALL SELECT src, dst, conf, 0.5 FROM edges),
h0 AS (SELECT node_id, CAST(1.0 AS DOUBLE) AS score FROM seeds),
s1 AS (SELECT b.node_id, max(w * (conf / 100.0)) AS score FROM both_ways b JOIN h0 ON h0.node_id = b.of GROUP BY 1),
h1 AS (SELECT node_id, max(score) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM s1) GROUP BY 1),
f1 AS (SELECT s1.node_id FROM s1 LEFT JOIN h0 USING (node_id) WHERE h0.score IS NULL OR s1.score > h0.score),
s2 AS (SELECT b.node_id, max(w * (conf / 100.0) * 0.45) AS score FROM both_ways b JOIN f1 ON f1.node_id = b.of GROUP BY 1)
SELECT node_id, round(max(score), 6) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM s2) GROUP BY 1""")
def expand_weighted(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([(C1, "seed", 1.0), (S3, "seed", 1.0)], "node_id long, why string, score double")
    return graph.expand(B.star_edges(spark, sf), seeds, 2).select("node_id", F.round("score", 6).alias("score"))


@query(f"""WITH {SQL_NODES}, {SQL_EDGES}, i AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst)
SELECT file_id, count(*) AS defs, CAST(coalesce(sum(n), 0) AS BIGINT) AS inbound, CAST(count(*) + floor(coalesce(sum(n), 0) / 4) AS BIGINT) AS rank_score
FROM nodes LEFT JOIN i ON i.dst = node_id WHERE kind NOT IN ('file', 'module') GROUP BY file_id""")
def file_rank_preamble(spark: SparkSession, sf: str) -> DataFrame:
    return graph.file_ranks(B.star_nodes(spark, sf), B.star_edges(spark, sf, "dst"))


@query(f"""WITH {SQL_NODES}, {SQL_EDGES}, d AS (SELECT node_id, coalesce(n, 0) AS degree FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) ON src = node_id)
SELECT node_id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM d""")
def csr_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return graph.csr_offsets(B.star_edges(spark, sf), B.star_nodes(spark, sf))


@query("""WITH old AS (SELECT c_custkey AS k, c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 1)
SELECT CASE WHEN old.k IS NULL THEN 'added' WHEN new.k IS NULL THEN 'gone' ELSE 'kept' END AS status, count(*) AS n, CAST(sum(coalesce(old.id, 0)) AS BIGINT) AS old_ids FROM old FULL JOIN new USING (k) GROUP BY 1""")
def id_assign_churn(spark: SparkSession, sf: str) -> DataFrame:
    """Kept ids never move; what is gone is the holes plus the ids that new keys took over."""
    c = B.table(spark, sf, "customer").select("c_custkey")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("node_id"), F.col("c_custkey").alias("node_key"))
    new = c.where("c_custkey % 2 = 0 OR c_custkey % 3 <> 1").select(F.col("c_custkey").alias("node_key"))
    out = ids.assign(old, new)
    now = out.join(old.select("node_id", F.col("node_key").alias("was")), "node_id", "left")
    rows = now.select(F.explode(F.filter(F.array(F.when(F.col("status") != "hole", F.struct(F.col("status").alias("status"), F.when(F.col("status") == "kept", F.col("node_id")).otherwise(0).alias("id"))), F.when((F.col("status") != "kept") & F.col("was").isNotNull(), F.struct(F.lit("gone").alias("status"), F.col("node_id").alias("id")))), lambda x: x.isNotNull())).alias("x"))
    return rows.groupBy("x.status").agg(F.count(F.lit(1)).alias("n"), F.sum("x.id").alias("old_ids"))


@query(f"""WITH {SQL_RESOLVED}, a AS (SELECT DISTINCT src, dst FROM resolved WHERE conf >= 60), b AS (SELECT DISTINCT src, dst FROM resolved WHERE conf IS NOT NULL AND src // 8 % 7 <> 0)
SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, 'removed' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT src, dst, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def graph_diff(spark: SparkSession, sf: str) -> DataFrame:
    # a pair's best confidence decides for both graphs, so that calls are resolved and brought together once
    e = written(B.star_resolved(spark, sf).where("conf IS NOT NULL").groupBy("src", "dst").agg(F.max("conf").alias("conf")))
    return ids.graph_diff(e.where("conf >= 60"), e.where("shiftright(src, 3) % 7 <> 0"), ["src", "dst"])


@query(f"""WITH {SQL_NODES}, mine AS (SELECT name, kind FROM nodes WHERE node_id // 8 % 10 <> 0), theirs AS (SELECT name, CASE WHEN node_id // 8 % 4 = 0 THEN 'function' ELSE kind END AS kind FROM nodes),
e AS (SELECT t.name, max(CAST(m.kind IS NOT NULL AS INT)) AS there, max(CAST(coalesce(m.kind = t.kind, false) AS INT)) AS same FROM theirs t LEFT JOIN mine m USING (name) GROUP BY 1)
SELECT count(*) AS theirs, CAST(sum(there) AS BIGINT) AS present, CAST(sum(same) AS BIGINT) AS agree FROM e""")
def presence_recall(spark: SparkSession, sf: str) -> DataFrame:
    nodes = B.star_nodes(spark, sf)
    theirs = nodes.select("name", F.when(F.shiftright("node_id", 3) % 4 == 0, "function").otherwise(F.col("kind")).alias("kind"))
    return evaluate.presence(nodes.where("shiftright(node_id, 3) % 10 <> 0"), theirs, ["name"])


@query(f"""WITH {SQL_NODES}, {SQL_EDGES}, n AS (SELECT node_id, kind, CASE WHEN file_id // 8 % 2 = 0 THEN 'a' ELSE 'b' END AS family, path LIKE '%ASIA%' AS vendored FROM nodes)
SELECT conf, e.kind, count(*) AS edges, count(*) FILTER (a.family <> b.family) AS cross_language, count(*) FILTER (b.vendored) AS into_vendored
FROM edges e JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst GROUP BY 1, 2""")
def edge_falsify(spark: SparkSession, sf: str) -> DataFrame:
    nodes = B.star_nodes(spark, sf).select("node_id", "kind", F.when(F.shiftright("file_id", 3) % 2 == 0, "a").otherwise("b").alias("family"), F.col("path").contains("ASIA").alias("vendored"))
    f = graph.falsified(B.star_edges(spark, sf), nodes)
    return f.groupBy("conf", "kind").agg(F.count(F.lit(1)).alias("edges"), F.count_if("cross_language").alias("cross_language"), F.count_if("into_vendored").alias("into_vendored"))


@query(f"""WITH {SQL_RESOLVED}, e AS (SELECT src AS caller, ref AS leaf, dst AS callee, conf FROM resolved WHERE conf IS NOT NULL),
obs AS (SELECT DISTINCT {B.node_sql("customer", "o_custkey")} AS caller, o_orderkey AS leaf, {B.node_sql("supplier", "l_suppkey")} AS callee FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
j AS (SELECT e.*, EXISTS (SELECT 1 FROM obs o WHERE o.caller = e.caller AND o.leaf = e.leaf AND o.callee = e.callee) AS ok FROM e
      WHERE (caller, leaf) IN (SELECT caller, leaf FROM obs) AND caller IN (SELECT {B.node_sql("customer", "o_custkey")} FROM orders WHERE o_orderstatus = 'F'))
SELECT conf, count(*) AS judged, count(*) FILTER (ok) AS correct FROM j GROUP BY conf""")
def precision_settled(spark: SparkSession, sf: str) -> DataFrame:
    e = B.star_resolved(spark, sf).where("conf IS NOT NULL").select(F.col("src").alias("caller"), F.col("ref").alias("leaf"), F.col("dst").alias("callee"), "conf")
    o = B.table(spark, sf, "orders")
    lines = B.table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    obs = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(B.node("customer", "o_custkey").alias("caller"), F.col("o_orderkey").alias("leaf"), B.node("supplier", "l_suppkey").alias("callee"))
    ran = o.where("o_orderstatus = 'F'").select(B.node("customer", "o_custkey").alias("caller"))
    return evaluate.settled_precision(e, obs, ran).groupBy("conf").agg(F.count(F.lit(1)).alias("judged"), F.count_if("right").alias("correct"))


@query(f"WITH {SQL_NODES}, {SQL_EDGES} SELECT 'wicker_' || name || ' ' || CAST(v AS VARCHAR) AS line FROM (SELECT 'nodes' AS name, (SELECT count(*) FROM nodes) AS v UNION ALL SELECT 'edges', (SELECT count(*) FROM edges) UNION ALL SELECT 'files', (SELECT count(*) FROM nodes WHERE kind = 'file'))")
def prom_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.queue import prometheus

    n = B.star_nodes(spark, sf).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"))
    return prometheus(n.join(B.star_edges(spark, sf).agg(F.count(F.lit(1)).alias("edges"))))


@query(f"""WITH {SQL_EDGES}, x AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls'),
seen AS (SELECT src, dst FROM x WHERE src // 8 % 2 = 0 UNION SELECT src, dst // 8 * 8 + 4 FROM x WHERE src // 8 % 5 = 0 UNION SELECT src, dst + 8 FROM x WHERE src // 8 % 3 = 0),
st AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM seen s WHERE s.src = x.src AND s.dst = x.dst) THEN 'exact' WHEN EXISTS (SELECT 1 FROM seen s WHERE s.src = x.src AND s.dst = x.dst // 8 * 8 + 4) THEN 'constructor'
  WHEN EXISTS (SELECT 1 FROM seen s WHERE s.src = x.src AND s.dst = x.dst + 8) THEN 'mro' ELSE 'none' END AS stage FROM x)
SELECT stage, count(*) AS n FROM st GROUP BY stage""")
def trace_stages(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's constructor is the part of its number, its kin the next supplier. Even callers were seen as they are, those
    by five in the constructor, those by three in the kin."""
    e = B.star_edges(spark, sf).where("kind = 'calls'").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    init = F.shiftright("callee", 3) * 8 + 4
    of = lambda k, callee: e.where(F.shiftright("caller", 3) % k == 0).select("caller", callee.alias("callee"))
    seen = of(2, F.col("callee")).unionByName(of(5, init)).unionByName(of(3, F.col("callee") + 8))
    classes = e.select("callee").distinct()
    kin = classes.select((F.col("callee") + 8).alias("a"), F.col("callee").alias("b"))
    return evaluate.staged_confirmation(e, seen, classes.select(F.col("callee").alias("cls"), init.alias("init")), kin).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def named(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The nodes, with a made-up size, and the names of what contains them."""
    nodes, contains = B.star_nodes(spark, sf), B.star_contains(spark, sf)
    owners = contains.join(nodes.select(F.col("node_id").alias("src"), F.col("name").alias("owner")), "src").select(F.col("dst").alias("node_id"), "owner")
    return nodes.withColumn("size", 100 + F.shiftright("node_id", 3) * 37 % 900), owners


@query(f"""WITH {SQL_NODES}, {SQL_EDGES},
f AS (SELECT 'called by' AS section, src AS node_id, kind, conf FROM edges WHERE dst = {S1} UNION ALL SELECT 'calls', dst, kind, conf FROM edges WHERE src = {S1}),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY conf DESC, node_id, kind) AS ord, count(*) OVER (PARTITION BY section) AS total FROM f)
SELECT section, CAST(ord AS INT) AS ord, node_id, name, conf, total FROM r JOIN nodes USING (node_id) WHERE ord <= 20
UNION ALL SELECT 'node', 1, node_id, name, NULL, 1 FROM nodes WHERE node_id = {S1}""")
def node_answer(spark: SparkSession, sf: str) -> DataFrame:
    nodes, owners = named(spark, sf)
    return answers.node_answer(nodes, B.star_edges(spark, sf), B.star_edges(spark, sf, "dst"), owners, "Supplier#000000001")


@query(f"""WITH RECURSIVE {SQL_EDGES}, {SQL_NODES}, use AS (SELECT DISTINCT src, dst FROM edges), {path_ctes(C1, S3, '1')}, {path_ctes(S3, C1, '2')},
way AS (SELECT node_id FROM back1 UNION ALL SELECT node_id FROM back2 WHERE NOT EXISTS (SELECT 1 FROM back1)),
seeds(node_id) AS (VALUES (CAST({C1} AS BIGINT)), (CAST({S3} AS BIGINT))),
sc AS (SELECT node_id, 'seed' AS why, 1.0 AS score, 0 AS turn FROM seeds UNION ALL SELECT node_id, 'on-path', 0.9, 1 FROM way
  UNION ALL SELECT src, 'caller', 0.6 * conf / 100, 2 FROM edges JOIN seeds ON node_id = dst UNION ALL SELECT dst, 'callee', 0.5 * conf / 100, 3 FROM edges JOIN seeds ON node_id = src),
first AS (SELECT node_id, why, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, turn) AS k FROM sc) WHERE k = 1),
items AS (SELECT row_number() OVER (ORDER BY round(score, 6) DESC, least(100 + node_id // 8 * 37 % 900, 2400), node_id) AS rank, node_id, why, round(score, 6) AS score, CAST(least(100 + node_id // 8 * 37 % 900, 2400) AS BIGINT) AS size FROM first JOIN nodes USING (node_id)),
f(rank, bytes, kept, took) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false UNION ALL
  SELECT i.rank, f.bytes + CASE WHEN t THEN i.size ELSE 0 END, f.kept + t::INT, t FROM f JOIN items i ON i.rank = f.rank + 1, LATERAL (SELECT i.why = 'seed' OR (f.kept < 25 AND f.bytes + i.size <= 9000) AS t))
SELECT CAST(rank AS INT) AS rank, node_id, why, score, size FROM f JOIN items USING (rank) WHERE took""")
def explore_answer(spark: SparkSession, sf: str) -> DataFrame:
    nodes, owners = named(spark, sf)
    return answers.explore(nodes, B.star_edges(spark, sf), owners, ["Customer#000000001", "Supplier#000000003"], 25, 9000)


@query(f"""WITH {SQL_NODES}, ours AS (SELECT path AS file, name, kind FROM nodes WHERE node_id // 8 % 3 <> 0), theirs AS (SELECT path AS file, name, CASE WHEN node_id // 8 % 7 = 1 THEN 'interface' ELSE kind END AS kind FROM nodes),
gone AS (SELECT * FROM theirs t WHERE NOT EXISTS (SELECT 1 FROM ours o WHERE o.file = t.file AND o.name = t.name)), p AS (SELECT DISTINCT file, name FROM gone), d AS (SELECT DISTINCT * FROM gone),
l AS (SELECT DISTINCT t.file, t.name, t.kind, o.mine FROM theirs t JOIN (SELECT file, name, max(kind) AS mine FROM ours GROUP BY 1, 2) o USING (file, name) WHERE t.kind <> o.mine)
SELECT 'kind' AS what, kind AS value, count(*) AS n FROM d GROUP BY kind
UNION ALL (SELECT 'name', name, count(*) FROM p GROUP BY name HAVING count(*) > 1 ORDER BY count(*) DESC, name LIMIT 10)
UNION ALL (SELECT 'file', file, count(*) FROM p GROUP BY file ORDER BY count(*) DESC, file LIMIT 5)
UNION ALL (SELECT 'relabelled', kind || ' > ' || mine, count(*) FROM l GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 6)""")
def missing_symbols(spark: SparkSession, sf: str) -> DataFrame:
    nodes = B.star_nodes(spark, sf).select("node_id", F.col("path").alias("file"), "name", "kind")
    number = F.shiftright("node_id", 3)
    return evaluate.missing(nodes.where(number % 3 != 0), nodes.withColumn("kind", F.when(number % 7 == 1, "interface").otherwise(F.col("kind"))))


@query(f"""WITH {SQL_NODES}, {SQL_EDGES}, m AS (SELECT path AS file, name AS caller FROM edges e JOIN nodes ON node_id = src WHERE e.kind = 'calls' AND dst // 8 % 2 = 1)
SELECT file, caller, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 6) AS share FROM m GROUP BY 1, 2 ORDER BY n DESC, file, caller LIMIT 5""")
def hub_callers(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of odd suppliers count as missed."""
    names = B.star_nodes(spark, sf).select(F.col("node_id").alias("src"), F.col("path").alias("file"), F.col("name").alias("caller"))
    return evaluate.hub_callers(B.star_edges(spark, sf).where("kind = 'calls' AND shiftright(dst, 3) % 2 = 1").join(names, "src"))


@query("""WITH d AS (SELECT s_suppkey AS dst, 'n' || CAST(s_suppkey % 23 AS VARCHAR) AS name, s_suppkey % 2 AS fam, s_nationkey AS dir, s_suppkey % 5 AS file FROM supplier),
r AS (SELECT c_custkey AS ref, 'n' || CAST(c_custkey % 23 AS VARCHAR) AS name, c_custkey % 2 AS fam, c_nationkey AS dir, c_custkey % 5 AS file FROM customer),
c AS (SELECT ref, dst, CASE WHEN r.dir = d.dir AND r.file = d.file THEN 3 WHEN r.dir = d.dir THEN 2 ELSE 1 END AS locality FROM r JOIN d USING (name, fam)),
b AS (SELECT *, count(*) OVER (PARTITION BY ref) AS n FROM (SELECT *, max(locality) OVER (PARTITION BY ref) AS top FROM c) WHERE locality = top)
SELECT ref, dst, locality, CAST(n AS INT) AS n, CASE WHEN n = 1 THEN 80 WHEN n <= 4 THEN 60 ELSE 45 END AS conf, 'name' AS prov FROM b WHERE n <= 8""")
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers refer to suppliers by a name that many share, from files in the folders of their nations."""

    def placed(table: str, c: str, n: str) -> DataFrame:
        key = F.col(c)
        name, family = F.concat(F.lit("n"), (key % 23).cast("string")), (key % 2).cast("string")
        return B.table(spark, sf, table).select(key.alias("key"), name.alias("name"), family.alias("family"), F.col(n).cast("string").alias("dir"), F.concat_ws("/", F.col(n).cast("string"), (key % 5).cast("string")).alias("path"))

    refs, defs = placed("customer", "c_custkey", "c_nationkey"), placed("supplier", "s_suppkey", "s_nationkey")
    return resolve.resolve_named(refs.withColumnRenamed("key", "ref"), defs.withColumnRenamed("key", "node"))
