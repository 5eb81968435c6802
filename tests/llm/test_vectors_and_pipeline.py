"""Embedding near-duplicates against brute force, components, and the pipeline's stages one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wicker.llm import itq, rlz, simhash
from wicker.llm.common import stored
from wicker.llm.components import components


def brute(rows, least=0.93):
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {r[0]: (links[k], rows[find(k)][0]) for k, r in enumerate(rows)}


def vectors(dim, n=400):
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(20, dim))
    for i in range(n):
        v = centres[i % 20] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 20 % 3)))
    rows[7] = (7, rows[27][1], rows[27][2])  # an equal vector
    rows[8], rows[9], rows[10] = (8, None, 1), (9, [0.0] * dim, 1), (10, [float("nan")] * dim, 1)
    rows[11], rows[12], rows[13] = (11, rows[31][1], None), (12, [None] * dim, 0), (13, [1.0, 2.0], 1)
    return rows


@pytest.mark.parametrize("dim", [64, 24])
def test_quantised_search_matches_brute_force(spark, dim):
    rows = vectors(dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("rep", F.lit(2))
    got = {r["vec_id"]: r for r in itq.near_duplicates(df).collect()}
    want = brute(rows)
    pairs = sum(n for n, _ in want.values())
    assert len(got) == len(rows) and pairs > 200
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * pairs
    assert all(got[k]["n_links"] <= n for k, (n, _) in want.items())
    assert np.mean([got[k]["component_id"] == c for k, (_, c) in want.items()]) > 0.95
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (8, 9, 10, 11, 12, 13))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_split_cells_lose_nothing(spark, monkeypatch):
    rows = vectors(64, 200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, itq.near_duplicates(df).collect()))
    monkeypatch.setattr(itq, "CELL", 5)
    assert sorted(map(tuple, itq.near_duplicates(df).collect())) == whole


def test_quantised_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert itq.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r["vec_id"], r["n_links"]) for r in itq.near_duplicates(twice).collect()) == [(1, 1), (1, 1), (2, 0)]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_follow_each_other(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "language", "simhash", "substrings", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    one = stored(p.drop_toxic(spark, docs, sf))
    assert one.columns == columns
    bad = docs.join(labels.where("toxic = 1"), "doc_id").count()
    left = one.join(labels, "doc_id").groupBy("toxic").count().collect()
    left = {r[0]: r[1] for r in left}
    assert left.get(1, 0) <= 0.2 * bad and left[0] >= 0.98 * docs.join(labels.where("toxic = 0"), "doc_id").count()
    two = stored(p.drop_unclear_language(spark, one, sf))
    assert two.columns == columns and two.count() >= 0.95 * one.count()
    three = stored(p.drop_near_duplicates(spark, two, sf))
    assert three.columns == columns
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(two).collect()}
    assert {r["doc_id"] for r in three.select("doc_id").collect()} == set(groups.values())
    assert three.count() == three.select("text").distinct().count()
    four = stored(p.drop_repeated_passages(spark, three, sf))
    assert four.columns == columns and four.count() == three.count()
    want = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in rlz.digests(three).collect()}
    assert {r["doc_id"]: len((r["text"] or "").encode().split()) for r in four.collect()} == want
    assert four.where("n_chars <> length(text)").count() == 0
    five = p.pack(spark, four, sf)
    assert {r["doc_id"]: r["n"] for r in five.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()} == want
    assert five.groupBy("bin_id").agg(F.sum("n_words").alias("n")).where("n > 2048").count() == 0


def test_stages_of_an_odd_table(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    english = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0"), "doc_id").where("lang = 'en' AND n_chars > 300").limit(5)
    pool = " ".join(r["text"] for r in english.collect()).split()
    long = " ".join(np.random.default_rng(1).permutation(pool)[:400].tolist())
    rows = [(None, long), (None, long), (1000, None), (1001, ""), (1002, long + " one"), (1002, " ".join(np.random.default_rng(2).permutation(pool)[:400].tolist())), (1003, long), (1003, long), (1004, long * 30)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    odd = odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)
    both = docs.unionByName(odd)
    for c in ("row", "sig", "turn", "k0", "_own_row_", "score", "words", "place", "again"):
        both = both.withColumn(c, F.lit("clash"))
    for table in (both, both.limit(0)):
        at = table
        for name, stage in p.STAGES[:-1]:
            at = stored(stage(spark, at, sf))
            assert at.columns == both.columns, name
            if name == "simhash" and table is both:
                kept = [(r["doc_id"], r["text"]) for r in at.collect()]
                assert kept.count((None, long)) == 2 and (1002, rows[5][1]) in kept
                assert sum(t == long for i, t in kept if i is not None) + sum(t == long + " one" for _, t in kept) == 1
        assert (p.STAGES[-1][1](spark, at, sf).count() > 0) == (table is both)
