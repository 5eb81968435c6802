"""Definitions, references, imports, aliases and prose out of source files.

Python goes through the standard parser, in blocks around a syntax error; other languages through a line grammar that
knows their keywords, which is approximate. A file's result depends on its bytes alone, so files are extracted in any task.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PROSE_STOP
from ..schema import UNIT

WORDS_PER_SCOPE = 96
FUNC = r"(?:async\s+)?(?:function\*?|func|fn|fun|def|sub)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"
TYPE = r"(?:class|struct|interface|trait|enum|record|object|protocol)\s+([A-Za-z_]\w*)(?:\s*(?:extends|:|<)\s*([A-Za-z_][\w.]*))?"
METHOD = r"^\s+(?:(?:public|private|protected|static|final|async|override|virtual|const|inline|unsafe|pub)\s+)*(?:[A-Za-z_][\w<>\[\],.&*:]*\s+)?([A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}]*\{"
ARROW = r"(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_]\w*)\s*=>"
CONST = r"^(?:export\s+)?(?:pub\s+)?(?:const|let|var|static)\s+(?:mut\s+)?([A-Za-z_]\w*)"
CALL = re.compile(r"(?:\b(new)\s+)?(?:([A-Za-z_]\w*)\s*(?:\.|->|::)\s*)?([A-Za-z_]\w*)\s*\(")
IMPORTS = re.compile(r"""^\s*(?:import\s+(?:.*?\s+from\s+)?|.*?\brequire\(\s*|use\s+|#include\s+|from\s+|using\s+)["'<]?([\w@./:\\-]+)["'>]?""")
KEYWORDS = frozenset("if for while switch catch return sizeof typeof elif else match when until unless with assert function fn func fun def".split())


def prose_of(text: str, scope: int | None, seen: set, out: list) -> None:
    """Distinct words of a scope, at most so many new ones from one piece of prose."""
    new = 0
    for raw in re.split(r"[^\w]+", text):
        word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        if new >= WORDS_PER_SCOPE:
            return
        if 4 <= len(raw.encode()) <= 24 and re.search("[A-Za-z]", raw) and word not in PROSE_STOP and (scope, word) not in seen:
            seen.add((scope, word))
            out.append({"scope": scope, "word": word})
            new += 1


class PythonUnit(ast.NodeVisitor):
    """One walk over a module's tree."""

    def __init__(self, text: str):
        self.lines = [0]
        for line in text.encode().splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.defs, self.refs, self.imports, self.aliases, self.prose = [], [], [], [], []
        self.scope: list[int] = []
        self.seen: set = set()
        self.base = 0

    def at(self, line: int, column: int) -> int:
        return self.base + self.lines[line - 1] + column

    @property
    def inside(self) -> int | None:
        return self.scope[-1] if self.scope else None

    def define(self, node: ast.AST, name: str, kind: str) -> int:
        start, end = self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)
        self.defs.append({"def_idx": len(self.defs), "name": name, "kind": kind, "start": start, "end": end, "name_start": start, "name_end": start + len(name.encode()), "parent": self.inside})
        return len(self.defs) - 1

    def refer(self, node: ast.AST, name: str, kind: str, recv: str = "bare", recv_name: str | None = None) -> None:
        self.refs.append({"ref_idx": len(self.refs), "name": name, "kind": kind, "start": self.at(node.lineno, node.col_offset), "end": self.at(node.end_lineno, node.end_col_offset), "scope": self.inside, "recv": recv, "recv_name": recv_name})

    def body(self, node: ast.AST, index: int) -> None:
        self.scope.append(index)
        if doc := ast.get_docstring(node, clean=False):
            prose_of(doc, index, self.seen, self.prose)
        for x in node.body:
            self.visit(x)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        for x in node.decorator_list:
            self.visit(x)
        held = self.inside is not None and self.defs[self.inside]["kind"] in ("class", "interface")
        index = self.define(node, node.name, "method" if held else "function")
        for x in (*node.args.defaults, *filter(None, node.args.kw_defaults)):
            self.visit(x)
        self.body(node, index)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        index = self.define(node, node.name, "class")
        self.scope.append(index)
        for x in node.bases:
            x = x.func.value if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) else x
            if isinstance(x, ast.Name):
                self.refer(x, x.id, "extends")
            elif isinstance(x, ast.Attribute):
                self.refer(x, x.attr, "extends", "other", x.value.id if isinstance(x.value, ast.Name) else None)
            elif isinstance(x, ast.Subscript):  # Base[T]: the base, and T is only mentioned
                self.refer(x.value, x.value.id if isinstance(x.value, ast.Name) else getattr(x.value, "attr", "?"), "extends")
                self.visit(x.slice)
        self.scope.pop()
        for x in (*node.decorator_list, *(k.value for k in node.keywords)):
            self.visit(x)
        self.body(node, index)

    def visit_Assign(self, node: ast.Assign) -> None:
        if self.inside is None or self.defs[self.inside]["kind"] == "class":
            for target in node.targets:
                for x in target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target]:
                    x = x.value if isinstance(x, ast.Starred) else x
                    if isinstance(x, ast.Name):
                        self.define(x, x.id, "variable")
        for target in node.targets:
            if isinstance(target, (ast.Attribute, ast.Subscript)):
                self.visit(target.value)
        self.visit(node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if (self.inside is None or self.defs[self.inside]["kind"] == "class") and isinstance(node.target, ast.Name):
            self.define(node.target, node.target.id, "variable")
        self.visit(node.annotation)
        if node.value is not None:
            self.visit(node.value)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        """A mention of a member that no call or base list has used."""
        v = node.value
        how = "self" if isinstance(v, ast.Name) and v.id in ("self", "cls") else "other"
        self.refer(node, node.attr, "read", how, v.id if isinstance(v, ast.Name) else None)
        if how == "other":
            self.visit(v)

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self.refer(f, f.id, "new" if f.id[:1].isupper() else "call")
        elif isinstance(f, ast.Attribute):
            v = f.value
            if isinstance(v, ast.Name) and v.id in ("self", "cls"):
                self.refer(f, f.attr, "call", "self", v.id)
            elif isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "super":
                self.refer(f, f.attr, "call", "super")
            else:
                self.refer(f, f.attr, "call", "other", v.id if isinstance(v, ast.Name) else None)
                self.visit(v)
        else:
            self.visit(f)
        for x in (*node.args, *(k.value for k in node.keywords)):
            self.visit(x)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.refer(node, node.id, "read")

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str):
            prose_of(node.value, self.inside, self.seen, self.prose)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports.append({"imp_idx": len(self.imports), "module": a.name})
            if a.asname:
                self.aliases.append({"local": a.asname, "original": a.name})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.imports.append({"imp_idx": len(self.imports), "module": "." * node.level + (node.module or "")})
        self.aliases += [{"local": a.asname, "original": a.name} for a in node.names if a.asname]

    def read(self, text: str) -> bool:
        """Whether there was a syntax error; blocks that start at column 0 are then parsed one by one."""
        for number, line in enumerate(text.splitlines(), 1):
            if "#" in line:
                prose_of(line.split("#", 1)[1], None, self.seen, self.prose)
        try:
            self.visit(ast.parse(text))
            return False
        except (SyntaxError, ValueError, RecursionError):
            pass
        whole = self.lines
        blocks, start = [], 0
        for m in re.finditer(r"^(?=[^\s#)\]}])", text, re.M):
            blocks.append((start, text[start : m.start()]))
            start = m.start()
        for at, block in [*blocks, (start, text[start:])]:
            try:
                tree = ast.parse(block)
            except (SyntaxError, ValueError, RecursionError):
                continue
            self.base, self.lines = len(text[:at].encode()), [0]
            for line in block.encode().splitlines(keepends=True):
                self.lines.append(self.lines[-1] + len(line))
            self.visit(tree)
        self.base, self.lines = 0, whole
        return True


def braces(text: str, lang: str) -> dict:
    """Line grammar for languages with blocks in braces (or ends): definitions nest by the depth at their line."""
    defs, refs, imports, aliases, prose, seen = [], [], [], [], [], set()
    stack: list[tuple[int, int]] = []
    depth = offset = 0
    for line in text.splitlines(keepends=True):
        code = re.sub(r"//.*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", lambda m: " " * len(m.group()), line)
        while stack and depth <= stack[-1][0]:
            defs[stack.pop()[1]]["end"] = offset
        scope = stack[-1][1] if stack else None
        for m in re.finditer(r"(?://|/\*|\*|#)\s*(.*)|\"([^\"]*)\"", line):
            prose_of(m.group(1) or m.group(2) or "", scope, seen, prose)
        m = IMPORTS.match(line)
        if m and re.match(r"\s*(import|use|#include|from|using|.*require\()", line):
            imports.append({"imp_idx": len(imports), "module": m.group(1)})
            aliases += [{"local": b, "original": a} for a, b in re.findall(r"(\w+)\s+as\s+(\w+)", line)]
            aliases += [{"local": b, "original": m.group(1)} for b in re.findall(r"\*\s+as\s+(\w+)", line)]
        held = scope is not None and defs[scope]["kind"] in ("class", "interface")
        found = None
        for kind, pattern in (("type", TYPE), ("func", FUNC), ("func", ARROW), ("method", METHOD), ("variable", CONST)):
            m = re.search(pattern, code)
            if m and m.group(1) not in KEYWORDS and (kind != "method" or held or lang in ("c", "cpp")) and (kind != "variable" or scope is None or held):
                name = m.group(1)
                word = {"type": "interface" if re.search(r"\b(interface|trait|protocol)\b", code) else "class", "variable": "variable"}.get(kind, "method" if held or kind == "method" and lang != "c" else "function")
                start = offset + len(line[: m.start()].encode())
                found = {"def_idx": len(defs), "name": name, "kind": word, "start": start, "end": offset + len(line.encode()), "name_start": offset + len(line[: m.start(1)].encode()), "name_end": offset + len(line[: m.end(1)].encode()), "parent": scope}
                defs.append(found)
                if kind == "type" and m.lastindex and m.lastindex > 1 and m.group(2):
                    refs.append({"ref_idx": len(refs), "name": m.group(2).split(".")[-1], "kind": "extends", "start": start, "end": start, "scope": found["def_idx"], "recv": "bare", "recv_name": None})
                break
        holder = found["def_idx"] if found and found["kind"] in ("function", "method") else scope
        for m in CALL.finditer(code):
            new, recv, name = m.groups()
            if name in KEYWORDS or found and name == found["name"] and not recv:
                continue
            how = "bare" if not recv else "self" if recv in ("this", "self") else "super" if recv == "super" else "other"
            at = offset + len(line[: m.start()].encode())
            refs.append({"ref_idx": len(refs), "name": name, "kind": "new" if new else "call", "start": at, "end": at + len(m.group().encode()) - 1, "scope": holder, "recv": how, "recv_name": recv if how == "other" else None})
        before = depth
        depth += code.count("{") - code.count("}")
        if found and found["kind"] != "variable" and (depth > before or "{" not in code):
            stack.append((before, found["def_idx"]))
            if depth <= before and "{" not in code:
                stack.pop()
        offset += len(line.encode())
    while stack:
        defs[stack.pop()[1]]["end"] = offset
    return {"had_error": depth != 0, "defs": defs, "refs": refs, "imports": imports, "aliases": aliases, "prose": prose}


def extract_text(text: str, lang: str) -> dict:
    if lang != "python":
        return braces(text, lang)
    unit = PythonUnit(text)
    broken = unit.read(text)
    return {"had_error": broken, "defs": unit.defs, "refs": unit.refs, "imports": unit.imports, "aliases": unit.aliases, "prose": unit.prose}


def extract(files: DataFrame) -> DataFrame:
    """One unit for each row of files(path, lang, content), as schema.UNIT says; bytes that aren't UTF-8 are replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, "lang": lang} | extract_text(bytes(c).decode("utf-8", "replace"), lang) for p, lang, c in zip(pdf["path"], pdf["lang"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "lang", "had_error", "defs", "refs", "imports", "aliases", "prose"])

    return files.select("path", "lang", "content").mapInPandas(run, UNIT)


def tables_of(units: DataFrame, file_ids: DataFrame) -> dict[str, DataFrame]:
    """files, defs, refs, imports, aliases and prose tables of units; file_ids(path, file_id)."""
    rows = units.join(file_ids, "path")
    out = {"files": rows.select("file_id", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), "lang", "had_error")}
    for name in ("defs", "refs", "imports", "aliases", "prose"):
        out[name] = rows.select("file_id", F.explode(name).alias("x")).select("file_id", "x.*")
    return out


def qualified(defs: DataFrame) -> DataFrame:
    """(file_id, def_idx, qualified): names from the outermost definition inwards."""
    from .graph import qualified_names

    nodes = defs.select(F.struct("file_id", "def_idx").alias("node_id"), "name", F.lit("def").alias("kind"))
    contains = defs.where("parent IS NOT NULL").select(F.struct("file_id", F.col("parent").alias("def_idx")).alias("src"), F.struct("file_id", "def_idx").alias("dst"))
    return qualified_names(nodes, contains, "file").select("node_id.file_id", "node_id.def_idx", "qualified")


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(lang, files, defs, refs): what was extracted, by language."""
    files = tables["files"].select("file_id", "lang")
    out = files.groupBy("lang").agg(F.count(F.lit(1)).alias("files"))
    for name in ("defs", "refs"):
        n = tables[name].groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).join(files, "file_id").groupBy("lang").agg(F.sum("n").alias(name))
        out = out.join(n, "lang", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
