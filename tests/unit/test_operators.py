"""Rules that the driver tables don't reach."""

import json
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wicker.functions import scalars as S
from wicker.functions import text as T
from wicker.operators import cochange, dedup, evaluate, extract, graph, ids, ledger, queue, resolve, retrieve, select
from wicker.sources import readers, store


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def units(spark, files, lang="python"):
    rows = [(p, lang if p.endswith(".py") else "typescript", bytearray(t.encode())) for p, t in files.items()]
    numbered = spark.createDataFrame([(p, i) for i, p in enumerate(sorted(files))], "path string, file_id int")
    return extract.tables_of(extract.extract(spark.createDataFrame(rows, "path string, lang string, content binary")), numbered)


def edges_of(spark, files):
    u = units(spark, files)
    names = {(r["file_id"], r["def_idx"]): r["name"] for r in u["defs"].collect()}
    return {(names.get(tuple(r["src"])), names.get(tuple(r["dst"])), r["kind"]): (r["conf"], r["prov"]) for r in resolve.resolve(u).collect()}


def test_three_tiers(spark):
    got = edges_of(spark, {"app.py": "from helper import assist\nclass Client:\n    def open(self):\n        self.send()\n    def send(self):\n        assist(1)\ndef main():\n    c = Client()\n    c.open()\n", "helper.py": "def assist(n):\n    return n\n"})
    assert got["open", "send", "calls"] == (100, "scope")
    assert got["send", "assist", "calls"] == (95, "import")
    assert got["main", "Client", "calls"] == (100, "scope")
    assert got["main", "open", "calls"] == (80, "name")


def test_ambiguity_cap_and_super(spark):
    many = {f"m{i}.py": "class T:\n    def handle(self):\n        pass\n" for i in range(11)} | {"z.py": "def go(x):\n    x.handle()\n"}
    assert not any(k[0] == "go" for k in edges_of(spark, many))
    got = edges_of(spark, {"a.py": "class Base:\n    def run(self):\n        pass\nclass Child(Base):\n    def run(self):\n        super().run()\n"})
    assert got["Child", "Base", "extends"][0] == 100 and ("Child", "Child", "extends") not in got


def test_partial_parse_and_prose():
    u = extract.extract_text("def before():\n    pass\n\ndef broken(:\n    pass\n\ndef after():\n    'Some docstring words'\n", "python")
    assert u["had_error"] and {"before", "after"} <= {d["name"] for d in u["defs"]}
    assert {"docstring", "words"} <= {p["word"] for p in u["prose"]}


@pytest.mark.parametrize("lang,code", [("typescript", "class A {\n  go() {\n    this.stop();\n  }\n  stop() {\n  }\n}\n"), ("java", "public class A {\n  void go() {\n    this.stop();\n  }\n  void stop() {\n  }\n}\n"), ("rust", "struct A {\n}\nfn go() {\n    stop();\n}\nfn stop() {\n}\n"), ("go", "func go_() {\n\tstop()\n}\nfunc stop() {\n}\n")])
def test_other_languages(lang, code):
    u = extract.extract_text(code, lang)
    assert "stop" in {d["name"] for d in u["defs"]} and "stop" in {r["name"] for r in u["refs"]} and not u["had_error"]


def test_module_keys(spark):
    f = spark.createDataFrame([(0, "src/flask/app.py"), (1, "pkg/index.ts"), (2, "a/app.py")], "file_id int, path string")
    got = {r["key"]: r["file_id"] for r in resolve.module_keys(f).collect()}
    assert got == {"src.flask.app": 0, "flask.app": 0, "app": 2, "pkg": 1, "a.app": 2}


def brute_select(items, nodes, most):
    kept, spent, co = [], 0, 0
    for r, why, size in items:
        seed, is_co = why in ("seed", "path", "prose"), why == "co-change"
        room = co < nodes // 5 and len(kept) < nodes + nodes // 5 if is_co else len(kept) - co < nodes
        if seed or room and spent + size <= most:
            kept.append(r)
            spent += size
            co += is_co
    return kept


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["seed", "caller", "callee", "co-change"]), st.integers(0, 50)), min_size=1, max_size=30), st.integers(1, 10), st.integers(0, 300))
def test_budget_selection(spark, rows, nodes, most):
    items = [(i, w, n) for i, (w, n) in enumerate(rows, 1)]
    df = spark.createDataFrame([(1, i, i, w, n) for i, w, n in items], "q int, rank int, node_id long, why string, size long")
    assert sorted(r["rank"] for r in select.select_budget(df, "q", nodes, most).collect()) == brute_select(items, nodes, most)


def test_text_rules(spark):
    r = one(spark, a=T.identifier_shape(F.lit("send_file")), b=T.identifier_shape(F.lit("SendFile")), c=T.identifier_shape(F.lit("HTTP")), d=T.identifier_shape(F.lit("send")), e=T.symbol_tokens(F.lit("see models.query.QuerySet")), s=T.shingles(T.words(F.lit("a b c d"))), j=T.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))))
    assert (r["a"], r["b"], r["c"], r["d"]) == (3, 3, 2, 0)
    assert r["e"] == ["see", "see", "models", "query", "QuerySet", "models.query.QuerySet"] and r["s"] == ["a b c", "b c d"] and r["j"] == 0.5


def test_scalars(spark):
    diff = "diff --git a/src/x.py b/src/x.py\n+++ b/src/x.py\ndiff --git a/tests/t.py b/tests/t.py\n+++ b/tests/t.py\n"
    r = one(spark, p=S.patched_files(F.lit(diff)), t=S.touched_files(F.lit(diff)), h=S.host_of(F.lit("git@Host.example:a/b")), u=S.usage(F.lit(json.dumps({"prompt_tokens": 10, "prompt_tokens_details": {"cached_tokens": 4}, "completion_tokens": 3}))), b=S.backoff(F.lit(2)), n=S.backoff(F.lit(4)), k=S.triage_kind(F.lit("It is a Bug.")), i=S.triage_kind(F.lit("?")), c=S.language(F.lit("x.h"), F.lit("namespace a {\n")), c2=S.language(F.lit("x.h"), F.lit("/* fe80::1 */ int x;\n")), line=S.line_of(F.lit("a\nb\nc"), F.lit(3)), esc=S.html_escaped(F.lit('<a "&">')))
    assert r["p"] == ["src/x.py"] and r["t"] == ["src/x.py", "tests/t.py"] and r["h"] == "host.example"
    assert (r["u"]["input"], r["u"]["output"], r["u"]["cache_read"]) == (6, 3, 4) and (r["b"], r["n"]) == (120, None)
    assert (r["k"], r["i"], r["c"], r["c2"], r["line"]) == ("bug", "invalid", "cpp", "c", 2) and r["esc"] == "&lt;a &quot;&amp;&quot;&gt;"


def test_duplicate_reports(spark):
    base = "the server crashes when a client sends an empty frame during the handshake phase of a session"
    rows = [(1, "r", base), (2, "r", base + " please help"), (3, "r", "completely different text about something else entirely with other words in it today"), (4, "q", base), (5, "r", "too short")]
    prints = dedup.fingerprints(spark.createDataFrame(rows, "id long, repo string, text string"), "id", "repo", "text")
    assert {(r["id"], r["prior"]) for r in dedup.best_match(dedup.compared(prints)).collect()} == {(2, 1)}


def test_ids_and_overlay(spark):
    old = spark.createDataFrame([(0, 10), (1, 20), (2, 30)], "node_id long, node_key long")
    got = {(r["node_key"]): (r["node_id"], r["status"]) for r in ids.assign(old, spark.createDataFrame([(10,), (40,), (50,), (30,)], "node_key long")).collect()}
    assert got[10] == (0, "kept") and got[30] == (2, "kept") and {got[40][0], got[50][0]} == {1, 3}


def test_queue_rules(spark):
    jobs = spark.createDataFrame([(1, "running", 10, "a", 1, 0), (2, "running", 99, "b", 1, 0)], "id int, state string, lease_until long, owner string, attempts int, defers int")
    got = {r["id"]: (r["state"], r["owner"]) for r in queue.reclaimed(jobs, 50).collect()}
    assert got == {1: ("queued", None), 2: ("running", "b")}
    assert {r["id"]: r["lease_until"] for r in queue.renewed(jobs, "b", 50).collect()} == {1: 10, 2: 110}
    assert [r["attempts"] for r in queue.deferred(jobs, 5, 10).collect()] == [0, 0]
    up = queue.upserted(spark.createDataFrame([(1, "x", "y")], "id int, a string, b string"), spark.createDataFrame([(1, "z"), (2, "w")], "id int, a string"), ["id"])
    assert sorted(map(tuple, up.collect())) == [(1, "z", "y"), (2, "w", None)]
    assert queue.migrated(spark.createDataFrame([(1,)], "id int"), "id int, url string", {"url": ""}).first()["url"] == ""


def test_evaluation(spark):
    log = spark.createDataFrame([(1, 1, "FAILED t::a"), (1, 2, "PASSED t::a"), (2, 1, "FAILED t::a")], "case_id int, line_no int, line string")
    want = spark.createDataFrame([(1, "t::a"), (2, "t::a")], "case_id int, test string")
    assert {r["case_id"]: r["resolved"] for r in evaluate.test_outcomes(log, want).collect()} == {1: True, 2: False}
    lo, hi = evaluate.wilson(F.lit(0.0), F.lit(10.0))
    r = one(spark, lo=lo, hi=hi, u=evaluate.usable_id(F.lit("a[b]")), v=evaluate.usable_id(F.lit("a[b")))
    assert r["lo"] == 0.0 and 0.27 < r["hi"] < 0.28 and r["u"] and not r["v"] and 0.04 < evaluate.p_value(1.96) < 0.06
    fixes = spark.createDataFrame([(1, "Fix crash in the parser for empty input", "", ["a", "b"]), (2, "Add docs", "", ["a", "b"])], "commit_id int, subject string, body string, files array<string>")
    assert [r["commit_id"] for r in evaluate.bug_fixes(fixes, 5).collect()] == [1]


def test_ledger_batch(spark):
    body = json.dumps({"usage": {"input_tokens": 1000, "output_tokens": 100}})
    r = ledger.collected(spark.createDataFrame([("a", "medium", None, body), ("b", "medium", "boom", None)], "custom_id string, model string, error string, body string")).collect()
    assert len(r) == 1 and abs(r[0]["cost_usd"] - (1000 * 3 + 100 * 15) / 2e6) < 1e-12


def test_sources(spark, tmp_path):
    (tmp_path / "src" / ".hid").mkdir(parents=True)
    (tmp_path / "build").mkdir()
    for name, text in (("src/a.py", "x=1"), ("src/b.xyz", "?"), ("src/.hid/c.py", "y"), ("build/d.py", "z"), ("src/e.h", "namespace q {\n}\n")):
        (tmp_path / name).write_text(text)
    got = {r["path"]: r["lang"] for r in readers.source_tree(spark, str(tmp_path), ["build/"]).collect()}
    assert got == {"src/a.py": "python", "src/e.h": "cpp"}
    assert readers.unsupported(spark, str(tmp_path)).first()["ext"] == "xyz"
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "src/a.py")
    git("commit", "-qm", "one")
    git("add", "build/d.py")
    git("commit", "-qm", "two")
    assert {r["path"] for r in readers.git_tree(spark, str(tmp_path)).collect()} == {"src/a.py", "build/d.py"}
    assert [tuple(r) for r in readers.git_changed(spark, str(tmp_path), "HEAD~1").collect()] == [("A", "build/d.py")]
    (tmp_path / "log.txt").write_text(readers.git_log_text(str(tmp_path)))
    assert {(r["subject"], r["file"]) for r in readers.commit_log(spark, str(tmp_path / "log.txt")).collect()} == {("one", "src/a.py"), ("two", "build/d.py")}
    (tmp_path / "t.jsonl").write_text(json.dumps({"kind": "edge", "cf": "a", "n": 2}) + "\n" + json.dumps({"kind": "ran", "f": "a"}) + "\n")
    assert readers.traces(spark, str(tmp_path / "t.jsonl"), "edge").first()["n"] == 2


def test_store(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 11, "a", "function"), (2, 12, "b", "class")], "node_id long, node_key long, name string, kind string")
    edges = spark.createDataFrame([(1, 2, "calls", 80, "name")], "src long, dst long, kind string, conf int, prov string")
    store.write_graph(str(tmp_path / "g"), {"nodes": nodes, "edges": edges})
    back = store.open_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, back["forward"].collect())) == sorted(map(tuple, back["reverse"].collect())) == sorted(map(tuple, edges.collect()))
    assert store.read_keys(spark, str(tmp_path / "g")).columns == ["node_id", "node_key"]
    assert [tuple(r) for r in store.symbols(nodes, "name", "kind").orderBy("sym_id").collect()] == [(0, "a"), (1, "b"), (2, "class"), (3, "function")]
    base = spark.createDataFrame([(f"p{i}", i) for i in range(10)], "path string, v int")
    assert store.write_units(spark, str(tmp_path / "u"), base, base.select("path", F.lit("added").alias("status")), None) == "base"
    new = base.where("v > 0").withColumn("v", F.when(F.col("v") == 5, 50).otherwise(F.col("v")))
    status = ids.changes(base, new, "path", ["v"])
    assert store.write_units(spark, str(tmp_path / "u"), new, status, base) == "delta"
    assert sorted(map(tuple, store.read_units(spark, str(tmp_path / "u")).collect())) == sorted(map(tuple, new.collect()))


def test_graph_small(spark):
    e = spark.createDataFrame([(i, i + 1, "calls", 80, "name") for i in range(5)], "src long, dst long, kind string, conf int, prov string")
    assert [r["node_id"] for r in graph.shortest_path(e, 0, 4, 16).orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    assert graph.shortest_path(e, 0, 4, 1).count() == 0 and graph.flow(e, 3, 1).first()["reversed"]
    assert cochange.reusable(10, 15) and not cochange.reusable(10, 16) and not cochange.reusable(None, 0)
    assert retrieve.max_seeds(25) == 8 and retrieve.max_seeds(3) == 4 and retrieve.max_seeds(999) == 32


def test_clustered_null_equals_a_direct_shuffle(spark):
    import math
    import random

    from wicker.operators import evaluate

    def z_of(rows):
        n, k = len(rows), sum(ok for _, _, ok in rows)
        p, mid = k / n, sum(x for _, x, _ in rows) / n
        return sum((x - mid) * (ok - p) for _, x, ok in rows) / math.sqrt(p * (1 - p) * sum((x - mid) ** 2 for _, x, _ in rows))

    own = random.Random(4)
    rows = [("a", own.choice([2, 3, 3]), own.random() < 0.85) for _ in range(60)] + [("b", own.choice([0, 1, 2]), own.random() < 0.3) for _ in range(60)] + [("c", 1, True)] * 3
    z, null = z_of(rows), []
    for _ in range(4000):
        mixed = []
        for s in "abc":
            g = [r for r in rows if r[0] == s]
            levels = own.sample([x for _, x, _ in g], len(g))
            mixed += [(s, x, ok) for x, (_, _, ok) in zip(levels, g)]
        null.append(z_of(mixed))
    mean = sum(null) / 4000
    sd = math.sqrt(sum((x - mean) ** 2 for x in null) / 3999)
    p = (sum(x >= z - 1e-9 for x in null) + 1) / 4001
    got = evaluate.clustered_null(spark.createDataFrame(rows, "stratum string, level int, ok boolean")).first()
    assert mean > 2 and abs(got["z"] - z) < 1e-5 and got["informative"] == 2
    assert abs(got["mean"] - mean) < 0.1 and abs(got["sd"] - sd) < 0.06 and abs(got["p"] - p) < 0.05
    assert abs(got["p"] * 4001 - round(got["p"] * 4001)) < 1e-6
    flat = evaluate.clustered_null(spark.createDataFrame([("a", 1, True), ("b", 2, False), ("c", 3, True)], "stratum string, level int, ok boolean")).first()
    assert (flat["mean"], flat["sd"], flat["p"], flat["informative"]) == (0, 0, 1, 0)


def test_extraction_of_python_details():
    u = extract.extract_text("import a.b as c\nx, (y) = 1, 2\nz: int = 3\nclass K(Base[T]):\n    f: str\n    def go(self):\n        return self.f + c.thing\n", "python")
    assert [d["name"] for d in u["defs"] if d["kind"] == "variable"] == ["x", "y", "z", "f"]
    refs = {(r["name"], r["kind"], r["recv"], r["recv_name"]) for r in u["refs"]}
    assert {("Base", "extends", "bare", None), ("T", "read", "bare", None), ("f", "read", "self", "self"), ("thing", "read", "other", "c")} <= refs
    assert u["aliases"] == [{"local": "c", "original": "a.b"}]
    ts = extract.extract_text("import * as ns from './lib';\n", "typescript")
    assert {"local": "ns", "original": "./lib"} in ts["aliases"]


def test_super_looks_in_the_bases_first(spark):
    files = {f"m{i}.py": f"class T{i}:\n    def handle(self):\n        pass\n" for i in range(12)}
    files |= {"base/b.py": "class Base:\n    def handle(self):\n        pass\n", "z.py": "class Child(Base):\n    def handle(self):\n        super().handle()\n"}
    got = edges_of(spark, files)
    assert got["handle", "handle", "calls"] == (80, "name")
    u = units(spark, files)
    paths = {r["file_id"]: r["path"] for r in u["files"].collect()}
    calls = [(paths[r["src"]["file_id"]], paths[r["dst"]["file_id"]]) for r in resolve.resolve(u).where("kind = 'calls'").collect()]
    assert calls == [("z.py", "base/b.py")]


def test_imports_by_path_package_and_shadow(spark):
    f = spark.createDataFrame([(0, "src/web/a.ts", "src/web", "typescript"), (1, "src/lib/b.ts", "src/lib", "typescript"), (2, "pkg/core/src/index.ts", "pkg/core/src", "typescript"), (3, "app/json.py", "app", "python"), (4, "lib/thing.rs", "lib", "rust")], "file_id int, path string, dir string, lang string")
    manifests = spark.createDataFrame([("pkg/core/package.json", '{"name": "@acme/core"}')], "path string, content string")
    keys = resolve.module_keys(f, readers.workspace_packages(f, manifests))
    assert "json" not in {r["key"] for r in keys.collect()}
    imports = spark.createDataFrame([(0, 0, "../lib/b", "typescript", "src/web"), (0, 1, "@acme/core", "typescript", "src/web"), (3, 2, "json", "python", "app"), (1, 3, "crate::lib::thing::Def", "rust", "src/lib")], "file_id int, imp_idx int, module string, lang string, dir string")
    assert {r["imp_idx"]: r["target"] for r in resolve.import_targets(imports, keys).collect()} == {0: 1, 1: 2, 3: 4}


def test_ids_of_the_star_graph_never_meet(spark):
    from wicker.plans import bindings as B

    kinds = [(k, i) for k in B.KINDS for i in (1, 7, 1_500_000, 999_999, 10**12)]
    assert len({B.number(k, i) for k, i in kinds}) == len(kinds)
    df = spark.createDataFrame([(i,) for _, i in kinds], "i long")
    assert sorted(r[0] for r in df.distinct().select(B.node("part", "i")).collect()) == sorted({B.number("part", i) for _, i in kinds})


def test_prefix_sums_and_numbers(spark):
    from wicker.operators import iterate

    keys = [-5000, -1, 0, 3, 4095, 4096, 9000, 20_000_000, 20_000_001]
    rows = spark.createDataFrame([(g, k, i + 1) for g in ("a", None) for i, k in enumerate(keys)], "g string, k long, v int")
    got = {(r["g"], r["k"]): r["s"] for r in iterate.prefix_sums(rows, "k", "v", "s", ["g"]).collect()}
    assert got == {(g, k): sum(range(i + 1)) for g in ("a", None) for i, k in enumerate(keys)}
    assert sorted(r["no"] for r in evaluate.numbered_from_zero(rows.where("g = 'a'"), "k").collect()) == list(range(9))


def test_sign_test_and_bootstrap(spark):
    from math import comb

    for better, worse in ((0, 0), (3, 1), (60, 40), (1000, 1100)):
        n, k = better + worse, min(better, worse)
        want = min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        got = evaluate.sign_test(spark.createDataFrame([(better, worse)], "better long, worse long")).first()["p"]
        assert abs(got - want) < 1e-6
    rows = spark.createDataFrame([(c, float(c % 3)) for c in range(12) for _ in range(c + 1)], "cluster int, value double")
    r = evaluate.cluster_bootstrap(rows, 500).first()
    mean = sum(c % 3 * (c + 1) for c in range(12)) / sum(range(1, 13))
    assert abs(r["mean"] - mean) < 1e-9 and r["low"] < mean < r["high"] and 0.3 < r["high"] - r["low"] < 1.4


def test_signatures_and_gitignore(spark, tmp_path):
    import hmac

    for key in (b"k", b"x" * 100):
        body, good = "some body \u00e9", "sha256=" + hmac.new(key, "some body \u00e9".encode(), "sha256").hexdigest()
        r = one(spark, a=S.signed(key, F.lit(body), F.lit(good)), b=S.signed(key, F.lit(body), F.lit(good[:-1] + "0")), c=S.signed(key, F.lit(body), F.lit(good[7:])))
        assert (r["a"], r["b"], r["c"]) == (True, good.endswith("0"), False)
    for folder in ("src/gen", "src/keep", "docs"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("# made\ngen/\n*.min.js\n/docs\n!src/keep/a.min.js\n")
    (tmp_path / "src" / ".gitignore").write_text("only.py\n")
    for name in ("src/a.py", "src/only.py", "src/gen/b.py", "src/x.min.js", "src/keep/a.min.js", "docs/d.py", "only.py"):
        (tmp_path / name).write_text("x = 1\n")
    assert {r["path"] for r in readers.source_tree(spark, str(tmp_path)).collect()} == {"src/a.py", "src/keep/a.min.js", "only.py"}


def test_self_calls_without_recursion(spark):
    nodes = spark.createDataFrame([(1, "function", "py", False, "go", "def go(x):\n    x.go()\n"), (2, "function", "py", False, "run", "def run():\n    return run()\n")], "node_id long, kind string, family string, vendored boolean, name string, body string")
    edges = spark.createDataFrame([(1, 1, "calls", 100, "scope"), (2, 2, "calls", 100, "scope"), (1, 2, "calls", 80, "name")], "src long, dst long, kind string, conf int, prov string")
    assert {(r["src"], r["dst"]): r["call_without_recursion"] for r in graph.falsified(edges, nodes).collect()} == {(1, 1): True, (2, 2): False, (1, 2): False}


def test_cochange_is_kept_and_becomes_edges(spark, tmp_path):
    pairs = spark.createDataFrame([("a.py", "b.py", 4, 52), ("a.py", "gone.py", 5, 55)], "a string, b string, n long, conf int")
    cochange.write(str(tmp_path / "co"), pairs, "abc")
    assert cochange.read(spark, str(tmp_path / "co"), {"abc": (20, 6)}) is None and cochange.read(spark, str(tmp_path / "co"), {}) is None
    kept = cochange.read(spark, str(tmp_path / "co"), {"abc": (20, 5)})
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, pairs.collect()))
    files = spark.createDataFrame([("a.py", 1), ("b.py", 2)], "path string, node_id long")
    assert sorted(tuple(r) for r in cochange.edges(kept, files).collect()) == [(1, 2, "references", 52, "cochange"), (2, 1, "references", 52, "cochange")]


def test_heads_of_caches(spark):
    head = lambda *x: spark.createDataFrame([(v,) for v in x], "head string")
    assert [ids.cached_head(head(*b), head(*d)).first()["head"] for b, d in ((("x",), ("y",)), (("x",), ()), (("x",), ("",)), ((), ()))] == ["y", "x", "x", None]


def test_written_once_until_the_source_changes(spark, tmp_path):
    from wicker.operators import iterate

    source, made = str(tmp_path / "t.parquet"), []
    spark.range(3).write.parquet(source)

    def build(folder):
        made.append(folder)
        spark.read.parquet(source).write.parquet(folder)

    first = iterate.written_once(spark, "t", [source], build)
    assert iterate.written_once(spark, "t", [source], build) == first and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert spark.read.parquet(iterate.written_once(spark, "t", [source], build)).count() == 5 and len(made) == 2


def test_explore_keeps_seeds_and_the_path(spark):
    from wicker.operators import answers

    nodes = spark.createDataFrame([(i, f"n{i}", "function", 0, "a.py", 100 * i) for i in range(1, 8)], "node_id long, name string, kind string, file_id long, path string, size int")
    edges = spark.createDataFrame([(1, 2, "calls", 80, "name"), (2, 3, "calls", 80, "name"), (4, 1, "calls", 100, "scope"), (5, 6, "calls", 100, "scope")], "src long, dst long, kind string, conf int, prov string")
    owners = spark.createDataFrame([], "node_id long, owner string")
    got = {r["node_id"]: (r["why"], r["score"]) for r in answers.explore(nodes, edges, owners, ["n3", "n1"], 25, 10_000).collect()}
    assert got == {1: ("seed", 1.0), 3: ("seed", 1.0), 2: ("on-path", 0.9), 4: ("caller", 0.6)}
    assert {r["node_id"] for r in answers.explore(nodes, edges, owners, ["n3", "n1"], 25, 0).collect()} == {1, 3}
    assert answers.node_answer(nodes, edges, edges, owners, "nothing").count() == 0


def test_patches_are_cleaned(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n+b\n "
    r = one(spark, a=S.clean_patch(F.lit("```diff\nnote\n" + diff + "\n\n```\n")), b=S.clean_patch(F.lit(diff + "\n\n")), c=S.clean_patch(F.lit(" nothing here \n")), d=S.clean_patch(F.lit("```\n--- a/x\r\n+++ b/x\r\n\r\n")))
    assert r["a"] == r["b"] == diff + "\n" and r["c"] == "nothing here" and r["d"] == "--- a/x\r\n+++ b/x\n"


def test_pieces_of_source(spark):
    code = "# é\nclass A:\n    def go(self):\n        pass\n".encode()
    at = code.index(b"def go")
    nodes = spark.createDataFrame([(1, "method", 0, at, len(code)), (2, "module", 0, 0, len(code)), (3, "method", 0, at, len(code)), (4, "class", 0, code.index(b"class"), len(code))], "node_id long, kind string, file_id int, start int, end int")
    files = spark.createDataFrame([(0, bytearray(code))], "file_id int, content binary")
    items = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3), ("q", 4, 4)], "q string, rank int, node_id long")
    pieces = select.source_pieces(items, nodes, files, "q", 40)
    got = {r["rank"]: (r["size"], r["text"]) for r in pieces.collect()}
    assert set(got) == {1, 3, 4} and got[1][1] == "    def go(self):\n        pass\n" and got[4][0] == 40
    kept = select.emit_budget(pieces, "q", 10_000).collect()
    assert sorted(r["rank"] for r in kept) == [1, 4]


def test_scalar_rules_counts_hours_beyond_a_day(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (59, 60, 3_599, 3_600, 86_399, 86_400, 200_000)], "page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    from wicker.plans import server

    got = {r["page_id"]: r["age"] for r in server.scalar_rules(spark, str(tmp_path)).collect()}
    assert got == {59: "59s", 60: "1m", 3_599: "59m", 3_600: "1h", 86_399: "23h", 86_400: "24h", 200_000: "55h"}
    assert one(spark, a=S.ago(F.lit(86_400)), b=S.ago(F.lit(200_000)))["a"] == "1d"


def test_best_copies_look_back_over_the_whole_group(spark):
    said = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    near = said(0) + " one more"
    rows = [(0, "a", said(0)), (1, "b", said(0)), *((i, "a", said(i)) for i in range(2, 400)), (400, "a", near), (401, "a", said(0)), (402, "a", near), (403, "a", None), (404, None, said(0)), (405, "a", "few words")]
    table = spark.createDataFrame(rows, "id long, repo string, text string")
    got = {(r["id"], r["prior"], round(r["copy"], 6)) for r in dedup.best_copies(table, "id", "repo", "text").collect()}
    assert got == {(400, 0, round(28 / 30, 6)), (401, 0, 1.0), (402, 400, 1.0)}
    recent = {(r["id"], r["prior"]) for r in dedup.recent_copies(table, "id", "repo", "text", 0.3).collect()}
    assert recent == {(401, 400), (402, 400), (402, 401)}


def test_star_edges_write_the_layout_asked_for_only(spark, sf, tmp_path):
    import os

    from wicker.operators import iterate
    from wicker.plans import bindings

    os.symlink(sf, tmp_path / "sf")
    before = set(iterate._written)
    bindings.star_edges(spark, str(tmp_path / "sf"), "dst")
    assert sorted(key[1] for key in set(iterate._written) - before) == ["edges", "graph-dst"]


def test_graph_diff_brings_each_edge_together_once(spark):
    edge = lambda *rows: spark.createDataFrame(rows, "src long, dst long")
    diff = ids.graph_diff(edge((1, 2), (1, 2), (1, 3)), edge((1, 3), (2, 3)), ["src", "dst"])
    assert sorted(tuple(r) for r in diff.collect()) == [(1, 2, "removed"), (2, 3, "added")]
    assert "Join" not in diff._jdf.queryExecution().optimizedPlan().toString()


def test_cochange_counts_pairs_in_tasks_of_a_bounded_size(spark, sf):
    import itertools
    import random
    import re
    from collections import Counter

    draw = random.Random(5)
    sets = {c: {draw.choice([None, *range(12)]) for _ in range(draw.randint(1, 5))} for c in range(80)} | {80: set(range(20)), 81: set(range(21)), 82: {None, *range(20)}}
    rows = [(c, f) for c, files in sets.items() for f in files for _ in range(draw.randint(1, 3))]
    table = spark.createDataFrame(rows, "commit_id long, file long")
    n = Counter(p for files in sets.values() if 2 <= len(files) <= 20 for p in itertools.combinations(sorted(files - {None}), 2))
    best = lambda f: sorted(((-k, *(p if p[0] != f else p[::-1])) for p, k in n.items() if f in p and k >= 3))[:8]
    want = {(min(f, g), max(f, g), -k) for f in range(20) for k, g, _ in best(f)}
    for stated in (None, len(rows)):
        got = cochange.pairs(table, rows=stated)
        assert {tuple(r)[:3] for r in got.collect()} == want and got.count() == len(want)
    exchanges = lambda df: {(k, int(x)) for k, x in re.findall(r"hashpartitioning\(([a-z]+)#\d+L?,[^)]*?(\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}
    assert exchanges(cochange.pairs(table, rows=10_000_000)) == {("a", 48), ("file", 40)}
    from wicker.plans import server

    assert server.cochange_edges(spark, sf)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 4


def test_ascii_words_are_lowered_alone(spark):
    words = ["ABCxyz", "ÉCOLE", "İX", "ß", "", None, "KK"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.ascii_lower(F.col("w"))).collect()
    assert [r[0] for r in got] == ["abcxyz", "École", "İx", "ß", "", None, "kK"]
    text = "a.b.cde cde. x_1 models.query a.b.cde ... Zé.Zé"
    every, names = one(spark, e=T.symbol_tokens(F.lit(text)), n=T.symbol_names(F.lit(text)))
    assert names == list(dict.fromkeys(every)) == ["cde", "a.b.cde", "cde.", "x_1", "models", "query", "models.query", "...", "Zé", "Zé.Zé"]


def test_symbol_seeds_pass_on_leads_only(spark, monkeypatch):
    defs = [("rare", 1), ("rare", 2), ("Shape", 9), *(("Common", i) for i in range(13)), *(("plain", i) for i in range(3)), ("file", 5), ("test", 6), ("n.m", 7)]
    nodes = spark.createDataFrame([(i, n, "function", "tests/x_test.py" if (n, i) == ("rare", 1) else "a") for n, i in defs], "node_id long, name string, kind string, path string")
    asked = spark.createDataFrame([(1, "Common rare plain Shape n.m file Common"), (2, "Common file test plain"), (3, None), (4, "Common plain")], "id long, text string")
    want = {(1, 2, 0, 2, False), (1, 9, 3, 1, False), (1, 7, 0, 1, False), (2, 5, 0, 1, True), (2, 6, 0, 1, True)}
    for most in (retrieve.COMMONEST, 1):  # names behind the commonest are told by the join
        monkeypatch.setattr(retrieve, "COMMONEST", most)
        got = retrieve.symbol_seeds(asked, nodes, "id", "text")
        assert {(r["query_id"], r["node_id"], r["shape"], r["n_defs"], r["fallback"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortAggregate" not in plan
    best = retrieve.ranked_names(nodes)._jdf.queryExecution().executedPlan().toString()
    assert best.index("SortAggregate") < best.index("HashAggregate(keys=[name")  # structs are compared after nodes are hashed together


def test_seeds_of_repeated_ids_count_once(spark, tmp_path):
    from wicker.plans import docs

    rows = [(1, "Alpha beta Alpha", "en"), (1, "Alpha gamma", "en"), (2, "Alpha", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["query_id"], r["node_id"], r["n_defs"]) for r in docs.seeds_from_text(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 2), (2, 1, 2)}


def test_keyword_postings_hold_what_is_asked(spark, sf, tmp_path):
    import os

    from wicker.operators import iterate
    from wicker.plans import docs

    said = "Alpha ALPHA beta abc with 1234 éééé Zoë_ " + "x" * 25 + " École"
    table = spark.createDataFrame([("s", said), ("s", None), ("t", "alpha"), (None, "beta")], "source string, text string")
    prose = table.select("source", F.explode(T.prose_words(F.col("text"))).alias("word")).distinct()
    words = [(w,) for w in ("alpha", "beta", "abc", "with", "1234", "éééé", "zoë_", "x" * 25, "École", "École".lower(), "gone")]
    wanted = spark.createDataFrame(words, "word string").select(F.explode(T.indexed(F.array("word"))).alias("word"))
    got = sorted(map(str, retrieve.keyword_postings(table, "source", "text", wanted).collect()))
    assert got == sorted(map(str, prose.select(F.col("source").alias("item"), "word").collect())) and len(got) == 6
    os.symlink(sf, tmp_path / "sf")
    docs.keyword_ranked(spark, str(tmp_path / "sf"))
    folder = next(f for key, f in iterate._written.items() if key[1] == "sources" and str(tmp_path) in str(key[2]))
    kept = {r["word"] for r in spark.read.parquet(folder).collect()}
    assert kept and kept <= {r["word"] for r in docs.asked(spark, sf).collect()}  # no vocabulary of the texts is written or shuffled
