"""Paths, names, prices, patches, addresses and other scalar rules."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust",
    "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rb": "ruby", "php": "php", "cs": "csharp", "kt": "kotlin", "swift": "swift", "scala": "scala",
}
FAMILIES = {"javascript": "js", "typescript": "js", "tsx": "js", "c": "c", "cpp": "c", "java": "jvm", "kotlin": "jvm", "scala": "jvm"}
#: Dollars for a million input and output tokens; the dearest serves unknown models.
PRICES = {"small": (1.0, 5.0), "medium": (3.0, 15.0), "large": (5.0, 25.0)}
FORBIDDEN = (".github/", ".git/", ".env", "secrets/")


def mapped(keys: Column, table: dict, default=None) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(pairs[keys], F.lit(default)) if default is not None else pairs[keys]


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[.]([^./]+)$", 1)


def language(path: Column, head: Column | None = None) -> Column:
    """Language by extension; a .h file whose first 64 KiB show C++ is C++."""
    by_name = mapped(extension(path), LANGUAGES)
    if head is None:
        return by_name
    return F.when((extension(path) == "h") & cpp_marks(head), "cpp").otherwise(by_name)


def cpp_marks(head: Column) -> Column:
    return F.substring(head, 1, 65536).rlike(r"(?m)^\s*(namespace\s+\w+|template\s*<|class\s+\w+|(public|private|protected)\s*:)|^[^/\n\"]*\b[A-Za-z_]\w*::[A-Za-z_~]")


def family(lang: Column) -> Column:
    return F.coalesce(mapped(lang, FAMILIES), lang)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def candidate_rank(path: Column, kind: Column) -> Column:
    """Tests last, variables and modules behind the rest."""
    test = path.contains("/test") | path.contains("_test.") | path.contains(".test.")
    return F.when(test, 2).otherwise(0) + F.when(kind.isin("variable", "module"), 1).otherwise(0)


def short_path(path: Column, parts: int = 2) -> Column:
    return F.substring_index(path, "/", -parts)


def owner_and_name(token: Column) -> tuple[Column, Column]:
    """Class.method at the first dot; no owner without one."""
    at = F.instr(token, ".")
    return F.when(at > 0, F.substring_index(token, ".", 1)), F.when(at > 0, token.substr(at + 1, F.length(token))).otherwise(token)


def norm_qual(q: Column) -> Column:
    """Qualified names of several tools on one form: dots, no <locals>, no synthetic parts."""
    dotted = F.replace(F.replace(q, F.lit("::"), F.lit(".")), F.lit(".<locals>."), F.lit("."))
    return F.array_join(F.filter(F.split(dotted, "[.]"), lambda x: ~x.rlike("^<.*>$") & (x != "")), ".")


def norm_path(p: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "/+", "/"), "^([.]/)+", "")


def est_tokens(size: Column) -> Column:
    return F.floor(size * 2 / 7).cast("long")


def charged_bytes(start: Column, end: Column, cap: int) -> Column:
    return F.least(end - start, F.lit(cap))


def cost(model: Column, read: Column, cache_read: Column, cache_write: Column, written: Column, rate: float = 1.0) -> Column:
    """Dollars of a call: cached reads cost a tenth, cache writes a quarter more."""
    dear_in, dear_out = max(p for p, _ in PRICES.values()), max(q for _, q in PRICES.values())
    p = mapped(model, {k: v[0] for k, v in PRICES.items()}, dear_in)
    q = mapped(model, {k: v[1] for k, v in PRICES.items()}, dear_out)
    return (read * p + cache_read * p * 0.1 + cache_write * p * 1.25 + written * q) * rate / 1e6


def usage(payload: Column) -> Column:
    """Input, output and cached tokens of a provider's usage object, whichever names it takes."""
    get = lambda *names: F.coalesce(*(F.get_json_object(payload, f"$.{n}").cast("long") for n in names), F.lit(0).cast("long"))
    cached = get("prompt_tokens_details.cached_tokens", "cache_read_input_tokens")
    total = get("prompt_tokens", "input_tokens")
    fresh = F.when(F.get_json_object(payload, "$.prompt_tokens").isNotNull(), F.greatest(total - cached, F.lit(0).cast("long"))).otherwise(total)
    return F.struct(fresh.alias("input"), get("completion_tokens", "output_tokens").alias("output"), cached.alias("cache_read"), get("cache_creation_input_tokens").alias("cache_write"))


def setting(config: Column, key: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(config, f"$.{key}"), F.lit(default))


def sanitised(text: Column) -> Column:
    """Issue text without control characters and with fences that can't close ours."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", ""), "`{3,}", "'''")


def triage_kind(answer: Column) -> Column:
    kind = F.lower(F.regexp_extract(answer, r"(?i)\b(bug|feature|question|docs|invalid)\b", 1))
    return F.when(kind == "", "invalid").otherwise(kind)


CONFIDENCE_LINE = r"(?i)^\s*(?:<!--\s*)?confidence:\s*(high|medium|low)\s*(?:-->)?\s*$"


def split_confidence(text: Column) -> tuple[Column, Column]:
    """(confidence, text without the lines that state one); the last statement wins, medium without any."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    said = F.filter(lines, lambda x: x.rlike(CONFIDENCE_LINE))
    last = F.lower(F.regexp_extract(F.element_at(said, -1), CONFIDENCE_LINE, 1))
    return F.when(F.size(said) > 0, last).otherwise("medium"), F.array_join(F.filter(lines, lambda x: ~x.rlike(CONFIDENCE_LINE)), "\n")


def clean_patch(answer: Column) -> Column:
    """The unified diff in an answer: without its fence, without what stands before the first file header and without empty
    lines at the end; a last line of one space is context and stays, and the diff ends in one newline."""
    bare = F.regexp_replace(answer, r"^\s*(```(diff|patch)?)?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[\r\n]+$", ""), r"(```)+$", "")
    at = F.instr(bare, "--- ")
    diff = F.regexp_replace(bare.substr(at, F.length(bare)), r"(\r?\n)(\r?\n|\r$)*$", "")
    return F.when(at > 0, F.concat(diff, F.lit("\n"))).otherwise(F.regexp_replace(bare, r"^\s+|\s+$", ""))


def touched_files(patch: Column) -> Column:
    """Files that a unified diff writes."""
    found = F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ (?:b/)?([^\t\r\n]+)"), 1)
    return F.array_distinct(F.filter(found, lambda x: x != "/dev/null"))


def patch_reason(patch: Column) -> Column:
    """Why a patch is refused, the first reason that holds; null if none does."""
    files = touched_files(patch)
    bad = F.exists(files, lambda f: f.startswith("/") | f.rlike(r"(^|/)[.][.](/|$)"))
    barred = F.exists(files, lambda f: F.greatest(*(f.startswith(p) | f.contains("/" + p) for p in FORBIDDEN)))
    return (
        F.when(F.trim(F.coalesce(patch, F.lit(""))) == "", "empty")
        .when(F.octet_length(patch) > 60_000, "too large")
        .when(F.size(files) == 0, "no files")
        .when(F.size(files) > 12, "too many files")
        .when(bad, "outside the tree")
        .when(barred, "forbidden path")
    )


def patched_files(patch: Column) -> Column:
    """Sorted non-test files of a git diff."""
    found = F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/(\S+) b/"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.rlike(r"(^|/)tests?(/|_|$)|(_test|[.]test)[.]"))))


def host_of(url: Column) -> Column:
    """Host of a web address, an scp-like one included, in lower case; '' if it has none."""
    web = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:?#]+)", 1)
    scp = F.regexp_extract(url, r"^[^@/\s]+@([^:/]+):", 1)
    return F.lower(F.when(web != "", web).otherwise(scp))


def host_matches(host: Column, allowed: str) -> Column:
    return (host == allowed) | host.endswith("." + allowed)


def is_public_v4(ip: Column) -> Column:
    """Whether a dotted address is outside the private, local, shared, test, multicast and reserved ranges."""
    part = [F.try_element_at(F.split(ip, "[.]"), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    a, b, c, _ = part
    ok = ip.rlike(r"^\d{1,3}([.]\d{1,3}){3}$") & F.greatest(*part).between(0, 255)
    closed = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    test = ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return F.coalesce(ok & ~closed & ~test, F.lit(False))


def secret_hint(secret: Column) -> Column:
    return F.when(F.length(secret) > 8, F.concat(F.substring(secret, 1, 4), F.lit("…"), F.substring(secret, -4, 4))).otherwise("…")


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def ago(seconds: Column, largest: str = "d") -> Column:
    """A time span in whole units, the largest that fits up to ``largest``."""
    units = ((86_400, "d"), (3_600, "h"), (60, "m"))
    units = units[[name for _, name in units].index(largest) :]
    out = F.concat(seconds.cast("string"), F.lit("s"))
    for size, name in reversed(units):
        out = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(name))).otherwise(out)
    return out


def backoff(attempts: Column, base: int = 30, most: int = 4) -> Column:
    """Seconds before the next try: base times four to the tries so far less one; null once they are used up."""
    return F.when(attempts < most, (F.lit(base) * F.pow(F.lit(4), F.greatest(F.least(attempts, F.lit(most)), F.lit(1)) - 1)).cast("long"))


def population(path: Column) -> Column:
    return F.when(path.rlike(r"(^|/)tests?(/|$)|(^|/)test_|_test[.]|[.]test[.]"), "test").otherwise("lib")


def vendored(path: Column) -> Column:
    return path.rlike(r"(^|/)(vendor|vendored|node_modules|third_party|dist)(/|$)")


def line_of(content: Column, byte: Column) -> Column:
    """Line, from 1, of a byte offset in ASCII-compatible content."""
    head = content.substr(F.lit(1), byte)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def signed(secret: bytes, body: Column, header: Column) -> Column:
    """Whether a header (sha256=...) is the HMAC-SHA256 of the body under the secret; null headers aren't.

    The two inner and outer paddings are literals, so that all rows are hashed by built-in expressions.
    """
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    mac = F.sha2(F.concat(pad(0x5C), inner), 256)
    return F.coalesce(F.lower(header) == F.concat(F.lit("sha256="), mac), F.lit(False)) & header.startswith("sha256=")


def forge_push(payload: Column) -> Column:
    """A push event of the other forge's payload in the names that the queue reads."""
    get = lambda p: F.coalesce(F.get_json_object(payload, p), F.lit(""))
    return F.struct(get("$.project.path_with_namespace").alias("full_name"), get("$.ref").alias("ref"), get("$.before").alias("before"))


def forge_issue(payload: Column) -> Column:
    """An issue event likewise; its number is the project's own, labels are names; null where the payload has no attributes."""
    get = lambda p: F.coalesce(F.get_json_object(payload, p), F.lit(""))
    of = lambda p: get(f"$.object_attributes.{p}")
    action = mapped(of("action"), {"open": "opened", "reopen": "reopened", "update": "labeled"})
    labels = F.from_json(F.get_json_object(payload, "$.labels"), "array<struct<title:string>>")
    names = F.filter(F.transform(labels, lambda x: x["title"]), lambda x: x.isNotNull())
    number = F.coalesce(of("iid").try_cast("long"), F.lit(0).cast("long"))
    row = F.struct(get("$.project.path_with_namespace").alias("full_name"), F.coalesce(action, of("action")).alias("action"), number.alias("number"), of("title").alias("title"), of("description").alias("body"), F.coalesce(names, F.array().cast("array<string>")).alias("labels"))
    return F.when(F.get_json_object(payload, "$.object_attributes").isNotNull(), row)


#: What another engine calls definitions and edges, in our kinds.
FOREIGN_DEFS = {"function": "function", "method": "method", "class": "class", "struct": "class", "interface": "interface", "trait": "interface", "protocol": "interface", "variable": "variable", "constant": "variable", "module": "module", "namespace": "module"}
FOREIGN_EDGES = {"calls": "calls", "instantiates": "calls", "extends": "extends", "implements": "extends", "imports": "imports", "references": "references", "contains": "contains"}


def in_repo(path: Column) -> Column:
    """Whether a normalised path lies in the tree: relative, and not above it."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)[.][.](/|$)") & ~path.rlike("^[A-Za-z]:/")
