"""Reference resolution: scopes, imports, then names, each with its confidence."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import family
from .iterate import settled

#: More candidates than this make no edge.
MOST = 8
BUILTINS = {
    "python": frozenset("abs all any bool bytes callable chr dict dir divmod enumerate eval exec filter float format frozenset getattr globals hasattr hash hex id input int isinstance issubclass iter len list locals map max min next object open ord pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip".split()),
    "other": frozenset("Array Boolean Date Error JSON Map Math Number Object Promise Proxy Reflect RegExp Set String Symbol WeakMap clearTimeout console decodeURIComponent encodeURIComponent fetch isNaN parseFloat parseInt require setInterval setTimeout".split()),
}


STDLIB = frozenset(sys.stdlib_module_names)
#: Languages whose import paths end in a symbol.
SYMBOL_LAST = ("rust", "java", "csharp", "kotlin", "scala")


def name_confidence(n: Column) -> Column:
    return F.when(n == 1, 80).when(n <= 4, 60).when(n <= MOST, 45)


def scope_chain(scopes: DataFrame, most: int = 32) -> DataFrame:
    """(scope, anc, depth): every scope with itself and all around it; scopes has scope and parent."""
    level = scopes.select("scope", F.col("scope").alias("anc"), F.lit(0).alias("depth"))
    chain, up = level, scopes.select(F.col("scope").alias("s"), "parent")
    for depth in range(1, most + 1):
        level = settled(level.join(up, F.col("anc") == F.col("s")).where("parent IS NOT NULL").select("scope", F.col("parent").alias("anc"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        chain = chain.unionByName(level)
    return chain


def resolve_scoped(refs: DataFrame, chain: DataFrame, defs: DataFrame) -> DataFrame:
    """Tier 1: the definition of the name in the nearest scope around the reference; of one scope's, the last.

    refs(ref, scope, name), defs(node, scope, name, ord).
    """
    named = defs.groupBy(F.col("scope").alias("anc"), "name").agg(F.max_by("node", "ord").alias("node"))
    hits = refs.join(chain, "scope").join(named, ["anc", "name"])
    return hits.groupBy("ref").agg(F.min_by("node", "depth").alias("dst")).withColumns({"conf": F.lit(100), "prov": F.lit("scope")})


def module_keys(files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(key, file_id): every suffix of a file's dotted path without its extension and index name; the first file in path order wins a key.

    A single last part that names a module of Python's standard library is no key of a Python file. packages(key, file_id),
    names of a workspace's packages, fill the keys that no path has.
    """
    bare = F.regexp_replace(F.col("path"), r"[.][^./]+$", "")
    parts = F.split(F.regexp_replace(bare, r"(^|/)(__init__|index|mod)$", ""), "/")
    n = F.size(parts)
    suffix = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    python = F.col("lang") == "python" if "lang" in files.columns else F.col("path").rlike("[.]pyi?$")
    keys = files.select("file_id", "path", python.alias("py"), F.explode(suffix).alias("key")).where("key <> ''")
    keys = keys.where(~(F.col("py") & ~F.col("key").contains(".") & F.col("key").isin(*sorted(STDLIB))))
    own = keys.groupBy("key").agg(F.min_by("file_id", F.struct("path", "file_id")).alias("file_id"))
    if packages is None:
        return own
    named = packages.select(F.translate("key", "/", ".").alias("key"), "file_id").groupBy("key").agg(F.min("file_id").alias("file_id"))
    return own.unionByName(named.join(own, "key", "left_anti"))


def import_targets(imports: DataFrame, keys: DataFrame) -> DataFrame:
    """(file_id, imp_idx, target) of imports(file_id, imp_idx, module[, lang, dir]): the first of a module's keys that a file has.

    A crate or package prefix is left out. A module that begins with a dot is a path from the importing file's folder; any
    other is the key itself, else, in languages whose imports end in a symbol, the key without its last part.
    """
    known = set(imports.columns)
    lang = F.col("lang") if "lang" in known else F.lit(None).cast("string")
    folder = F.col("dir") if "dir" in known else F.lit("")
    module = F.when(lang == "rust", F.regexp_replace("module", "^(crate|self|super)::", "")).otherwise(F.col("module"))
    dotted = F.replace(F.translate(module, "/", "."), F.lit("::"), F.lit("."))
    steps = F.split(F.concat_ws("/", folder, module), "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda at, x: F.when(x.isin("", "."), at).when(x == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(x))))
    here = F.array_join(walked, ".")
    symbol = lang.isin(*SYMBOL_LAST) | lang.isNull()
    tries = F.when(module.startswith("."), F.array(here, F.regexp_replace(here, "[.]index$", ""))).when(symbol, F.array(dotted, F.regexp_replace(dotted, r"[.][^.]+$", ""))).otherwise(F.array(dotted))
    tried = imports.select("file_id", "imp_idx", F.posexplode(F.array_distinct(tries)).alias("pos", "key"))
    hit = tried.join(keys.withColumnRenamed("file_id", "target"), "key").groupBy("file_id", "imp_idx").agg(F.min_by("target", "pos").alias("target"))
    return hit.where("target <> file_id")


def module_receivers(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, recv_name): names that stand for a module in a file - those it imports, and their aliases."""
    own = imports.select("file_id", F.col("module").alias("recv_name")).distinct()
    local = aliases.join(own.withColumnRenamed("recv_name", "original"), ["file_id", "original"], "left_semi").select("file_id", F.col("local").alias("recv_name"))
    return own.unionByName(local).distinct()


def imported_names(targets: DataFrame, exports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(file_id, name, node): what each file may call by import; the first import wins, an alias never overrides."""
    direct = targets.join(exports.select(F.col("file_id").alias("target"), "name", "node"), "target").groupBy("file_id", "name").agg(F.min_by("node", F.struct("imp_idx", "node")).alias("node"))
    if aliases is None:
        return direct
    local = aliases.join(direct.withColumnRenamed("name", "original"), ["file_id", "original"]).groupBy("file_id", F.col("local").alias("name")).agg(F.min("node").alias("node"))
    return direct.unionByName(local.join(direct, ["file_id", "name"], "left_anti"))


def resolve_imported(refs: DataFrame, names: DataFrame) -> DataFrame:
    """Tier 2: refs(ref, file_id, name) by the names that their file imports."""
    return refs.join(names, ["file_id", "name"]).select("ref", F.col("node").alias("dst"), F.lit(95).alias("conf"), F.lit("import").alias("prov"))


def narrowed(candidates: DataFrame, *carried: str) -> DataFrame:
    """Of candidates(ref, dst, locality) those with the best locality, their number n and confidence; too many have none. Carried columns stay."""
    w = W.partitionBy("ref")
    best = candidates.withColumn("top", F.max("locality").over(w)).where("locality = top")
    return best.withColumn("n", F.count(F.lit(1)).over(w)).select("ref", *carried, "dst", "locality", F.col("n").cast("int").alias("n"), name_confidence(F.col("n")).alias("conf"))


def resolve_named(refs: DataFrame, defs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Tier 3: refs(ref, name, family, path, dir[, spare]) by name among defs(node, name, family, path, dir) of one family.

    Candidates in the same file come before those in the same folder, and these before all others. They are counted for
    each (name, family), folder and file before anything is joined with references, so that a name that is defined
    everywhere yields its count and no rows. With ``extra`` columns (a reference may then have several rows) candidates share
    these too. ``spare``: how many candidates more than MOST a reference may have, as some are left out afterwards.
    """
    levels = [(3, ["name", "family", "dir", "path", *extra]), (2, ["name", "family", "dir", *extra]), (1, ["name", "family", *extra])]
    counted = refs if "spare" in refs.columns else refs.withColumn("spare", F.lit(0))
    for level, keys in levels:
        counted = counted.join(defs.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{level}")), keys, "left")
    total = lambda k: F.coalesce(F.sum(f"n{k}").over(W.partitionBy("ref")) if extra else F.col(f"n{k}"), F.lit(0))
    counted = counted.withColumns({f"t{k}": total(k) for k in (1, 2, 3)})
    level = F.when(F.col("t3") > 0, 3).when(F.col("t2") > 0, 2).when(F.col("t1") > 0, 1)
    n = F.when(F.col("t3") > 0, F.col("t3")).when(F.col("t2") > 0, F.col("t2")).otherwise(F.col("t1"))
    ready = counted.withColumn("locality", level).withColumn("n", n).where(F.col("locality").isNotNull() & (F.col("n") <= MOST + F.col("spare")))
    out = None
    for level, keys in levels:
        part = ready.where(F.col("locality") == level).select("ref", "locality", "n", *keys).join(defs.select("node", *keys), keys).select("ref", F.col("node").alias("dst"), "locality", F.col("n").cast("int").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"conf": name_confidence(F.col("n")), "prov": F.lit("name")})


def but_itself(found: DataFrame, holders: DataFrame) -> DataFrame:
    """found(ref, dst, locality, n, ...) without candidates that hold the reference themselves, holders(ref, src), counted again."""
    rest = found.join(holders, "ref").where(F.col("dst") != F.col("src"))
    n = F.count(F.lit(1)).over(W.partitionBy("ref"))
    return rest.withColumn("n", n.cast("int")).where(F.col("n") <= MOST).withColumn("conf", name_confidence(F.col("n"))).select("ref", "dst", "locality", "n", "conf", "prov")


def tiers(units: dict[str, DataFrame], packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found(ref, dst, conf, prov), outcomes(ref, outcome) of every reference, and targets(file_id, imp_idx, target) of imports.

    units has files(file_id, path, dir, lang) and defs, refs, imports, aliases of ``schema``. A super call is looked for in the
    bases that its class declares before locality counts, and among all if they have none; neither it nor heritage binds to
    the definition that holds it. Reads stop before tier 3; bare names that the language builds in resolve by scope or import only.
    """
    files = units["files"].withColumn("family", family(F.col("lang")))
    defs = units["defs"].withColumn("node", F.struct("file_id", "def_idx"))
    refs = units["refs"].withColumn("ref", F.struct("file_id", "ref_idx"))
    scope = lambda c: F.struct("file_id", F.coalesce(c, F.lit(-1)).alias("s"))
    scopes = defs.select(scope(F.col("def_idx")).alias("scope"), F.struct("file_id", F.coalesce("parent", F.lit(-1)).alias("s")).alias("parent"))
    scopes = scopes.unionByName(files.select(F.struct("file_id", F.lit(-1).alias("s")).alias("scope"), F.lit(None).cast("struct<file_id:int,s:int>").alias("parent")))
    table = defs.select("node", scope(F.col("parent")).alias("scope"), "name", F.col("def_idx").alias("ord"))
    # self.x looks into the class around; bare names into the chain; other receivers into neither
    holder = units["defs"].where("kind IN ('class', 'interface')").select("file_id", F.col("def_idx").alias("cls"))
    chain = settled(scope_chain(scopes))
    one = resolve_scoped(refs.where("recv = 'bare'").select("ref", scope(F.col("scope")).alias("scope"), "name"), chain, table)
    inside = refs.where("recv IN ('self', 'super')").select("ref", "recv", scope(F.col("scope")).alias("scope"), "name").join(chain, "scope").join(holder, (F.col("anc.file_id") == holder["file_id"]) & (F.col("anc.s") == F.col("cls")))
    inside = inside.groupBy("ref", "recv", "name").agg(F.min_by("anc", "depth").alias("scope"))  # the class around
    members = table.groupBy("scope", "name").agg(F.max_by("node", "ord").alias("node"))
    own = inside.where("recv = 'self'").join(members, ["scope", "name"])
    one = settled(one.unionByName(own.select("ref", F.col("node").alias("dst"), F.lit(100).alias("conf"), F.lit("scope").alias("prov"))))
    targets = settled(import_targets(units["imports"].join(files.select("file_id", "lang", "dir"), "file_id"), module_keys(files, packages)))
    exports = defs.where("parent IS NULL").groupBy("file_id", "name").agg(F.max_by("node", "def_idx").alias("node"))
    names = imported_names(targets, exports, units["aliases"])
    left = refs.join(one, "ref", "left_anti")
    through = left.where("recv = 'other'").join(module_receivers(units["imports"], units["aliases"]), ["file_id", "recv_name"], "left_semi")
    lexical = left.where("recv IN ('bare', 'self')").select("ref", "file_id", "name").unionByName(through.select("ref", "file_id", "name"))
    two = settled(resolve_imported(lexical, names))
    built = F.when(F.col("lang") == "python", F.col("name").isin(*BUILTINS["python"])).otherwise(F.col("name").isin(*BUILTINS["other"]))
    holds = F.struct("file_id", F.coalesce("scope", F.lit(-1)).alias("def_idx"))
    left = left.join(two, "ref", "left_anti").select("ref", "file_id", "name", "kind", "recv", holds.alias("src"))
    left = left.join(files.select("file_id", "path", "dir", "lang", "family"), "file_id").withColumn("built", (F.col("recv") == "bare") & built)
    left = settled(left.drop("file_id", "lang"))
    asked = left.where("kind <> 'read' AND NOT built").withColumn("spare", (F.col("recv") == "super").cast("int"))
    owner = units["defs"].select("file_id", F.col("def_idx").alias("parent"), F.col("name").alias("owner"))
    placed = defs.join(owner, ["file_id", "parent"], "left").join(files.select("file_id", "path", "dir", "family"), "file_id").select("node", "name", "family", "path", "dir", "owner")
    key = ["ref", "name", "family", "path", "dir", "spare"]
    # super(): among the members of the declared bases, if these have any
    bases = units["refs"].where("kind = 'extends' AND scope IS NOT NULL").select(scope(F.col("scope")).alias("scope"), F.col("name").alias("owner")).distinct()
    sup = asked.where("recv = 'super'").join(inside.where("recv = 'super'").select("ref", "scope"), "ref").join(bases, "scope").select(*key, "owner")
    narrow = settled(resolve_named(sup, placed, ("owner",)))
    plain = asked.join(narrow.select("ref").distinct(), "ref", "left_anti").select(*key)
    three = resolve_named(plain, placed).unionByName(narrow)
    picky = left.where("recv = 'super' OR kind = 'extends'").select("ref", "src")
    three = settled(three.join(picky, "ref", "left_anti").unionByName(but_itself(three, picky)))
    # a class isn't its own base, by scope either
    heirs = refs.where("kind = 'extends'").select("ref", holds.alias("src"))
    selves = one.join(heirs, "ref").where(F.col("dst") == F.col("src")).select("ref")
    found = one.join(selves, "ref", "left_anti").unionByName(two).unionByName(three.select("ref", "dst", "conf", "prov"))
    anywhere = placed.select("name", "family").distinct().withColumn("there", F.lit(True))
    rest = left.join(three.select("ref").distinct(), "ref", "left_anti").join(anywhere, ["name", "family"], "left")
    why = F.when(F.col("kind") == "read", "weak_read").when(F.col("built"), "builtin").when(F.col("there"), "too_ambiguous").otherwise("external")
    outcomes = one.join(selves, "ref", "left_anti").select("ref", F.lit("scope").alias("outcome")).unionByName(selves.select("ref", F.lit("too_ambiguous").alias("outcome")))
    outcomes = outcomes.unionByName(two.select("ref", F.lit("import").alias("outcome"))).unionByName(rest.select("ref", why.alias("outcome")))
    counts = three.groupBy("ref").agg(F.max("n").alias("n")).select("ref", F.when(F.col("n") == 1, "name_unique").otherwise("name_ambiguous").alias("outcome"))
    return found, outcomes.unionByName(counts), targets


def resolve(units: dict[str, DataFrame], packages: DataFrame | None = None, partners: DataFrame | None = None) -> DataFrame:
    """The graph's edges(src, dst, kind, conf, prov) between nodes (file_id, def_idx), a file being its own def -1.

    Containment from files down, imports from file to file, and what references resolve to, the best of each (src, dst, kind);
    then, as they are, edges of the co-change pairs partners(a, b, conf) whose files are still there.
    """
    found, _, targets = tiers(units, packages)
    kinds = {"call": "calls", "new": "calls", "extends": "extends", "read": "references"}
    kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()))
    node = lambda file, index: F.struct(file.alias("file_id"), index.alias("def_idx"))
    nil = F.lit(-1)
    refs = units["refs"].select(F.struct("file_id", "ref_idx").alias("ref"), node(F.col("file_id"), F.coalesce("scope", nil)).alias("src"), kind.alias("kind"))
    edges = found.join(refs, "ref").select("src", "dst", "kind", "conf", "prov")
    held = units["defs"].select(node(F.col("file_id"), F.coalesce("parent", nil)).alias("src"), node(F.col("file_id"), F.col("def_idx")).alias("dst"), F.lit("contains").alias("kind"), F.lit(100).alias("conf"), F.lit("scope").alias("prov"))
    imported = targets.select(node(F.col("file_id"), nil).alias("src"), node(F.col("target"), nil).alias("dst"), F.lit("imports").alias("kind"), F.lit(95).alias("conf"), F.lit("import").alias("prov"))
    edges = edges.unionByName(held).unionByName(imported).groupBy("src", "dst", "kind").agg(F.max(F.struct("conf", "prov")).alias("b")).select("src", "dst", "kind", "b.conf", "b.prov")
    if partners is None:
        return edges
    from .cochange import edges as paired

    return edges.unionByName(paired(partners, units["files"].select("path", node(F.col("file_id"), nil).alias("node_id"))))


OUTCOMES = ("scope", "import", "name_unique", "name_ambiguous", "too_ambiguous", "weak_read", "builtin", "external")


def outcome_counts(outcomes: DataFrame, contains: DataFrame | None = None) -> DataFrame:
    """One row of outcomes(outcome): how many references ended which way, and the share of those in the tree that resolved;
    with contains, one row for each definition, their number too."""
    c = lambda *names: F.count_if(F.col("outcome").isin(*names))
    inside, resolved = c(*OUTCOMES[:5]), c(*OUTCOMES[:4])
    out = outcomes.agg(F.count(F.lit(1)).alias("total_refs"), inside.alias("in_repo"), resolved.alias("resolved"), *(c(x).alias(x) for x in OUTCOMES), F.round(resolved / inside, 6).alias("rate"))
    return out if contains is None else out.join(contains.agg(F.count(F.lit(1)).alias("contains")))


def file_graph(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind, conf) between files(node_id, path): the edges whose both ends are files."""
    a, b = files.select(F.col("node_id").alias("src"), F.col("path").alias("src_path")), files.select(F.col("node_id").alias("dst"), F.col("path").alias("dst_path"))
    return edges.join(a, "src").join(b, "dst").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), "kind", "conf")
