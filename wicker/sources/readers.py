"""Scans. Filters on name, size and columns reach the reader; file contents are read only for rows that stay."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FOREIGN_DEFS, FOREIGN_EDGES, LANGUAGES, extension, language, mapped, norm_path, norm_qual

MAX_FILE_BYTES = 1 << 20
TRACE = "kind string, cf string, cq string, cl int, df string, dq string, dl int, hops int, n long, f string, q string, flag string, b array<string>, python string, root string"


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def source_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, content: bool = True) -> DataFrame:
    """Files of known languages up to 1 MiB, hidden and ignored ones left out: path (below root), dir, ext, lang, size, mtime, content.

    ``ignore`` holds gitignore-like names (`build`, `*.min.js`, `docs/`), applied to every part of the path; the tree's own
    .gitignore files, which are small and read first, apply below their folders, those further down last.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), r"^(file:)?/*", "/").substr(F.lit(len(root.rstrip("/")) + 2), F.lit(1 << 20))
    rows = raw.where(F.col("length") <= MAX_FILE_BYTES).withColumn("rel", rel).where(~F.col("rel").rlike(r"(^|/)[.]"))
    for rule in ignore or []:
        name = rule.rstrip("/").replace(".", "[.]").replace("*", "[^/]*").lstrip("/")
        anchor = "^" if rule.startswith("/") else "(^|/)"
        rows = rows.where(~F.col("rel").rlike(f"{anchor}{name}(/|$)"))
    own = sorted(ignore_files(spark, root).items(), key=lambda x: (x[0].count("/"), x[0]))
    rules = [r for path, text in own for r in ignore_rules(text, path.rpartition("/")[0])]
    rows = rows.where(not_ignored(F.col("rel"), rules)) if rules else rows
    ext = extension(F.col("rel"))
    rows = rows.where(ext.isin(*LANGUAGES))
    lang = language(F.col("rel"), F.decode("content", "iso-8859-1")) if content else language(F.col("rel"))
    cols = [F.col("rel").alias("path"), F.regexp_replace("rel", r"/?[^/]*$", "").alias("dir"), ext.alias("ext"), lang.alias("lang"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime")]
    return rows.select(*cols, *([F.col("content")] if content else []))


def unsupported(spark: SparkSession, root: str) -> DataFrame:
    """How many files of each extension no language claims."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return raw.select(extension(F.col("path")).alias("ext")).where(~F.col("ext").isin(*LANGUAGES)).groupBy("ext").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "ext")


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def git_tree(spark: SparkSession, root: str, commit: str = "HEAD") -> DataFrame:
    """Paths and blob ids of a commit, without hidden parts."""
    rows = [(line.split("\t", 1)[1], line.split()[2]) for line in _git(root, "ls-tree", "-r", commit).splitlines()]
    return spark.createDataFrame([r for r in rows if not any(p.startswith(".") for p in r[0].split("/"))], "path string, blob string")


def git_changed(spark: SparkSession, root: str, since: str, until: str = "HEAD") -> DataFrame:
    """(status, path) of the difference between two commits' trees."""
    rows = [tuple(line.split("\t", 1)) for line in _git(root, "diff", "--name-status", "--no-renames", since, until).splitlines()]
    return spark.createDataFrame(rows, "status string, path string")


def git_log_text(root: str, most: int = 3000) -> str:
    """History as text for ``commit_log``: a NUL, the commit and its subject, then its files, newest first."""
    return _git(root, "log", "--no-merges", "--no-renames", f"-n{most}", "--name-only", "--format=%x00%H%x09%s")


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, subject, file) from stored history text; records end at NULs, so a file may be read in parts."""
    records = spark.read.option("lineSep", "\x00").text(path).where("value <> ''")
    lines = F.split("value", "\n")
    head = F.split(F.element_at(lines, 1), "\t")
    return records.select(F.element_at(head, 1).alias("commit_id"), F.element_at(head, 2).alias("subject"), F.explode(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x != "")).alias("file"))


def traces(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of one kind - edge, ran, bases or header - of runtime traces in JSON lines."""
    columns = {"edge": ["cf", "cq", "cl", "df", "dq", "dl", "hops", "n"], "ran": ["f", "q", "n", "flag"], "bases": ["q", "b"], "header": ["python", "root"]}[kind]
    return spark.read.schema(TRACE).json(path).where(F.col("kind") == kind).select(*columns)


def workspace_packages(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(key, file_id): names by which a workspace's packages can be imported; manifests(path, content) are package.json files.

    A file belongs to the packages in the folders above it; `name/sub` reaches its path below the package, without its
    extension and `/index`, and `name` its entry file. The deepest package wins.
    """
    spec = manifests.select(F.regexp_replace("path", r"/?package[.]json$", "").alias("pkg"), F.from_json(F.col("content").cast("string"), "name string, main string, module string, types string").alias("m")).where("m.name IS NOT NULL")
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit(""))))
    own = files.select("file_id", "path", F.explode(above).alias("pkg")).join(spec, "pkg")
    sub = F.when(F.col("pkg") == "", F.col("path")).otherwise(F.col("path").substr(F.length("pkg") + 2, F.length("path")))
    bare = F.regexp_replace(F.regexp_replace(sub, r"[.][^./]+$", ""), r"(^|/)index$", "")
    entry = F.regexp_replace(F.regexp_replace(F.coalesce("m.module", "m.main", F.lit("index")), r"^[.]/", ""), r"[.][^./]+$", "")
    key = F.when((bare == "") | (bare == entry) | bare.isin("src", "src/index", "lib/index"), F.col("m.name")).otherwise(F.concat("m.name", F.lit("/"), bare))
    return own.select(key.alias("key"), "file_id", F.length("pkg").alias("deep"), "path").groupBy("key").agg(F.max_by("file_id", F.struct("deep", -F.col("file_id"))).alias("file_id"))


def foreign_nodes(nodes: DataFrame) -> DataFrame:
    """(id, file, name, kind) of another engine's nodes(id, kind, qualified_name, name, file_path) in our kinds; kinds we don't have are left out."""
    kind = mapped(F.col("kind"), FOREIGN_DEFS)
    return nodes.select("id", norm_path(F.col("file_path")).alias("file"), "name", norm_qual(F.col("qualified_name")).alias("qualified"), kind.alias("kind")).where("kind IS NOT NULL")


def foreign_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sf, sq, df, dq, kind, merged) of its edges(source, target, kind) in our kinds and names, each once; merged is how many more there were."""
    ends = nodes.select("id", norm_path(F.col("file_path")).alias("f"), norm_qual(F.col("qualified_name")).alias("q"))
    a, b = ends.withColumnsRenamed({"id": "source", "f": "sf", "q": "sq"}), ends.withColumnsRenamed({"id": "target", "f": "df", "q": "dq"})
    rows = edges.withColumn("kind", mapped(F.col("kind"), FOREIGN_EDGES)).where("kind IS NOT NULL").join(a, "source").join(b, "target")
    return rows.groupBy("sf", "sq", "df", "dq", "kind").agg((F.count(F.lit(1)) - 1).alias("merged"))


def ignore_files(spark: SparkSession, root: str) -> dict[str, str]:
    """The .gitignore files below a folder, by path; Spark's readers pass over names that begin with a dot."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getScheme() == "file":
        found = [os.path.join(at, ".gitignore") for at, _, names in os.walk(root.removeprefix("file:")) if ".gitignore" in names]
        return {os.path.relpath(x, root.removeprefix("file:")).replace(os.sep, "/"): open(x, encoding="utf-8", errors="replace").read() for x in found}  # noqa: SIM115
    out, listed = {}, files.listFiles(path, True)
    base = files.getFileStatus(path).getPath().toString().rstrip("/") + "/"
    while listed.hasNext():
        at = listed.next().getPath()
        if at.getName() == ".gitignore":
            stream = files.open(at)
            out[at.toString().removeprefix(base)] = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
    return out


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """(pattern over paths below the root, whether it lets the path in again) of a .gitignore's lines, in order."""
    out = []
    for line in text.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        again = rule.startswith("!")
        rule = rule[1:] if again else rule
        tree, rule = rule.endswith("/"), rule.rstrip("/")
        held = "/" in rule
        parts = re.split(r"(\*\*/|/\*\*|\*|\?)", rule.lstrip("/"))
        body = "".join({"**/": "(.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in parts)
        top = f"{re.escape(folder)}/" if folder else ""
        out.append((f"^{top}{'' if held else '(.*/)?'}{body}{'/' if tree else '(/|$)'}", again))
    return out


def not_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that speaks of a path lets it in."""
    out = F.lit(True)
    for pattern, again in rules:
        out = F.when(path.rlike(pattern), F.lit(again)).otherwise(out)
    return out
