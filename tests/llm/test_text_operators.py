"""Operators on documents against brute force, the tokenizers library and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wicker.llm import bpe, langid, media, packing, rlz, simhash, tokenbin, tokencount, toxicity
from wicker.llm.queries import QUERIES, vocabulary
from wicker.llm.xxh import xxh64

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(300)]
PASSAGE = " ".join(rng.choice(WORDS) for _ in range(60))
CLASHING = ["anchors", "owned", "score", "k0", "f0", "rep", "words", "cluster", "component_id", "label", "_text", "_id", "_y", "h", "node"]


def corpus():
    docs = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    docs[5] = docs[9] + " " + PASSAGE
    docs[12] = PASSAGE + "\n" + docs[3]
    docs[20] = docs[21] = docs[22] = docs[4] + " tail words here to make it long enough for windows of thirteen words or more"
    docs[30] = "same " * 40
    docs[31] = " " + "same " * 25 + "\t end"
    return docs


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def edgy(spark):
    base = frame(spark, ["", None, " \n\t ", "one", "été naïve 日本語 \U0001f642 don't", "x" * 200_000, "the same words " * 20, "the same words " * 20, "<|endoftext|> a  b"], [0, 1, 2, 3, 4, 5, 6, 6, None])
    for c in CLASHING:
        base = base.withColumn(c, F.lit("clash"))
    return base.withColumn("lang", F.when(F.col("doc_id") == 3, None).otherwise(F.col("lang"))).withColumn("source", F.when(F.col("doc_id") == 4, None).otherwise(F.col("source")))


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def brute_substrings(docs):
    first = {}
    for i, t in sorted(docs.items()):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, t in docs.items():
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substrings_match_brute_force(spark):
    docs = corpus()
    got = {r[0]: tuple(r[1:]) for r in rlz.digests(frame(spark, docs)).collect()}
    want = brute_substrings(dict(enumerate(docs)))
    assert got == want and sum(v[1] for v in want.values()) > 100


def brute_parse(docs):
    """Greedy factors against the first places of all windows, document by document."""
    first, out = {}, set()
    for i, t in sorted(docs.items()):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), (i, k))
    for i, t in docs.items():
        w, k = words(t), 0
        entry = lambda x: first[tuple(w[x : x + 13])] if 0 <= x <= len(w) - 13 and first[tuple(w[x : x + 13])][0] < i else None  # noqa: B023, E731
        while k <= len(w) - 13:
            if not entry(k):
                k += 1
                continue
            (source, at), n = entry(k), 1
            while entry(k + n) == (source, at + n):
                n += 1
            out.add((i, k, n + 12, source, at))
            k += n
    return out


def test_factors_match_a_greedy_parse_and_hold_their_sources_words(spark):
    docs = corpus()
    docs[40] = docs[9] + " " + docs[12] + " between " + docs[9]  # factors of several sources, with borders between them
    got = rlz.factors(frame(spark, docs)).collect()
    assert set(map(tuple, got)) == brute_parse(dict(enumerate(docs))) and len(got) == len(set(got)) > 8
    for doc, a, n, source, b in got:
        assert n >= 13 and source < doc and words(docs[doc])[a : a + n] == words(docs[source])[b : b + n]


def thue_morse(n, swap):
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomial_hashes_confuse_stay_apart(spark, n):
    tail = " one two three four five six seven eight nine ten eleven twelve"
    docs = [thue_morse(n, 0) + tail, thue_morse(n, 1) + tail, thue_morse(n, 0) + tail]
    assert [r["n_removed"] for r in rlz.digests(frame(spark, docs)).orderBy("doc_id").collect()] == [0, 0, 13]


def test_substrings_of_string_ids_and_repeated_rows(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [("a", base), ("b", base + " x"), ("b", "other " + base), ("b", base + " x"), ("c", "w1 w2 w3")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted((r[0], r[1], r[2]) for r in rlz.digests(df).collect()) == [("a", 30, 0), ("b", 31, 30), ("b", 31, 30), ("b", 31, 30), ("c", 3, 0)]
    assert sorted(map(tuple, rlz.factors(df).collect())) == [("b", 0, 30, "a", 0), ("b", 0, 30, "a", 0), ("b", 1, 30, "a", 0)]


def test_substrings_keep_columns_and_edges(spark):
    e = edgy(spark)
    out = rlz.deduplicated(e)
    assert out.columns == e.columns and out.count() == e.count()
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[6] == "the same words " * 20 and by[1] is None and by[0] == ""  # rows with one id aren't copies of each other
    rows = rlz.digests(e).collect()
    assert len(rows) == 9 and all(r["n_removed"] == 0 for r in rows)
    assert rlz.digests(e.limit(0)).count() == 0


def test_xxh64():
    data = bytes(rng.randrange(256) for _ in range(2000))
    a = [rng.randrange(1500) for _ in range(500)]
    b = [x + rng.choice([0, 1, 3, 4, 7, 8, 15, 31, 32, 33, 64, 100, 300]) for x in a]
    got = xxh64(np.frombuffer(data + b"\0" * 8, np.uint8), np.array(a), np.array(b))
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[x:y], seed=42) for x, y in zip(a, b)]


def brute_print(t, n=4):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), seed=42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(n, linked):
    r = list(range(n))

    def find(i):
        while r[i] != i:
            i = r[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        r[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_simhash_matches_brute_force(spark):
    docs = [t + (" alpha" * (i % 3)) for i, t in enumerate(corpus())] + ["", None, "Été ÉTÉ A b"]
    docs += [" ".join(x if rng.random() > 0.004 else "zz" for x in (PASSAGE + " " + docs[k % 5]).split()) for k in range(40)]
    prints = [brute_print(t) for t in docs]
    linked = [(a, b) for a in range(len(docs)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    got = simhash.near_duplicates(frame(spark, docs), width=4, words=1, radius=4).orderBy("doc_id").collect()
    assert [r["f0"] & (1 << 64) - 1 for r in got] == prints
    assert [r["component_id"] for r in got] == roots(len(docs), linked)
    assert len(set(roots(len(docs), linked))) < len(docs) - 10


def test_any_two_within_the_radius_share_a_list():
    from itertools import combinations

    sets = simhash.cover(8, 4)
    assert len(sets) == 70 and all(any(set(s) <= set(m) for s in sets) for n in range(4, 9) for m in combinations(range(8), n))


@pytest.mark.parametrize("most", [1, 2, 3, 7, 100])
def test_lists_are_given_whole_or_in_pieces(monkeypatch, most):
    monkeypatch.setattr(simhash, "LIST", most)
    own = random.Random(most)
    keys = sorted(own.choice(range(9)) for _ in range(60))
    rows = [(k, i, 0, 0, i) for i, k in enumerate(keys)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + 8]], pa.int64()) for c in range(5)], ["key", "id", "f0", "f1", "label"]) for i in range(0, 60, 8)]
    seen = {}
    for part, piece in simhash.in_lists(iter(batches)):
        for k in sorted(set(part[:, 0].tolist())):
            own_rows = part[part[:, 0] == k, 1].tolist()
            assert (piece >= 0) == (keys.count(k) > most) and len(own_rows) <= most and (piece < 0 or set(part[:, 0]) == {k})
            seen.setdefault(k, []).append((piece, own_rows))
    assert {k: [x for _, xs in v for x in xs] for k, v in seen.items()} == {k: [i for i, x in enumerate(keys) if x == k] for k in set(keys)}
    assert all([p for p, _ in v] in ([-1], list(range(len(v)))) for v in seen.values())


def test_split_lists_lose_no_link(spark, monkeypatch):
    gen = random.Random(2)
    base = [gen.choice(WORDS) for _ in range(60)]
    docs = [" ".join(x if gen.random() > 0.02 else gen.choice(WORDS) for x in base) for _ in range(40)] + corpus()[:20]
    args = [dict(width=4, words=1, radius=4), {}]
    whole = [sorted(map(tuple, simhash.near_duplicates(frame(spark, docs), **a).collect())) for a in args]
    monkeypatch.setattr(simhash, "LIST", 3)
    assert [sorted(map(tuple, simhash.near_duplicates(frame(spark, docs), **a).collect())) for a in args] == whole


def test_near_duplicates_default_and_edges(spark):
    base = " ".join(rng.choice(WORDS) for _ in range(400)).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in (50, 150, 300)]
    other = " ".join(rng.choice(WORDS) for _ in range(400))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, [" ".join(base), *near, other])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    rows = simhash.near_duplicates(edgy(spark)).collect()
    assert len(rows) == 9 and all((r["doc_id"] is None) == (r["component_id"] is None) for r in rows)
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(edgy(spark).limit(0)).count() == 0


def shingle_set(t):
    w = [x.lower() for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(low, high, n, sizes, seed):
    """n pairs of texts whose similarity is in the range: places of one are changed, or its end is left out, until it is."""
    own, out = random.Random(seed), []
    while len(out) < n:
        base = ["".join(own.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(own.randint(*sizes))]
        other = list(base)
        by_cut = len(out) % 3 == 0
        while jaccard(" ".join(base), " ".join(other)) > high:
            if by_cut:
                other.pop()
            else:
                other[own.randrange(len(other))] = "changed%d" % own.randrange(10**6)
        if low <= jaccard(" ".join(base), " ".join(other)):
            out.append((" ".join(base), " ".join(other)))
    return out


def share_linked(spark, pairs):
    """Share of the pairs that are linked, all in one table."""
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, [t for p in pairs for t in p])).collect()}
    return sum(got[2 * i] == got[2 * i + 1] for i in range(len(pairs))) / len(pairs)


@pytest.mark.parametrize(("low", "high", "sizes"), [(0.8, 0.82, (150, 1000)), (0.82, 0.86, (60, 800)), (0.86, 0.9, (60, 800)), (0.8, 0.9, (8, 54))])
def test_near_duplicates_meet_brute_force_pairs(spark, low, high, sizes):
    assert share_linked(spark, planted(low, high, 300, sizes, 3)) >= 0.99


def test_near_duplicates_keep_texts_below_the_similarity(spark):
    far = planted(0.6, 0.79, 100, (8, 400), 5)
    repeated = "a b c d e " * 30
    far.append((repeated, repeated + " ".join(f"w{i}" for i in range(20))))
    assert max(jaccard(*p) for p in far) < 0.8 and share_linked(spark, far) == 0


ODD = ["<|endoftext|>a<|endoftext|>", "  a  b\n\n\tc ", "don't we'll x's 'S", "日本語 テスト 12345", "\n a", "a \nb", "é́ﬁ \U0001f642\nü", "", None, "x" * 3000, "trailing ", "a\n", "ẞ İ ΑΣ a b", "tab\there"]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = corpus() + ODD
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, texts), path).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    ids = bpe.encoded(frame(spark, texts), path)
    assert {r["doc_id"]: r["text"] for r in bpe.decoded(ids, path).collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert bpe.round_trip(edgy(spark), path).count() == 9 and bpe.round_trip(edgy(spark).limit(0), path).count() == 0


def test_every_prefix_has_one_last_token():
    b = bpe.load(vocabulary("byte_bpe_50k.json"))
    for n in rng.sample(range(256, 50_000), 3000):  # a token that merges make encodes as itself
        raw = b.token[b.ids[n]].decode("latin-1")
        if raw.isascii():
            assert b.piece(raw) == [b.ids[n]]


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = corpus() + ODD
    got = sorted(tokenbin.written(frame(spark, texts), path).collect())
    start = 0
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids))
        start += len(ids)
    rows = tokenbin.written(edgy(spark), path).collect()
    assert len(rows) == 9 and min(r["start"] for r in rows) == [r for r in rows if r["doc_id"] is None][0]["start"]
    assert tokenbin.written(edgy(spark).limit(0), path).count() == 0


def test_token_files_in_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "PARTITION_BYTES", 2000)
    path = vocabulary("word_bpe_49k.json")
    docs = frame(spark, corpus())
    many = sorted(tokenbin.written(docs.repartition(5), path).collect())
    monkeypatch.undo()
    assert many == sorted(tokenbin.written(docs, path).collect())


def test_section_tokens(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = corpus()[:20] + ODD + ["one\ntwo three\n\n\nfour", "a\n\n\n\n\n b"]
    got = {}
    for r in tokencount.section_tokens(frame(spark, texts), path).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["begin_char"], r["end_char"], r["n_tokens"], r["doc_tokens"]))
    for i, x in enumerate(texts):
        x = x or ""
        lines, at = [], 0
        for line in (x.split("\n")[:-1] if x.endswith("\n") else x.split("\n")) or [""]:
            end = min(len(x), at + len(line) + 1)
            lines.append((at, end))
            at = end
        n = [0] * len(lines)
        spans = t.encode(x, add_special_tokens=False).offsets
        for a, b in spans:
            n[int(np.argmax([min(b, e) - max(a, s) for s, e in lines]))] += 1
        assert sorted(got[i]) == [(k, s, e, c, len(spans)) for k, ((s, e), c) in enumerate(zip(lines, n))]
    fields = tokencount.field_tokens(frame(spark, ["some words\nhere"]), path, "doc_id", ["text", "lang", "source"]).collect()
    assert {r["field"] for r in fields} == {"text", "lang", "source"} and all(r["n_tokens"] > 0 for r in fields)
    cols, rows = ["text", "lang", "source"], [("some wörds\nhere 日本", "en", "s"), (None, "", "a\n"), ("x" * 50, "fr  ", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {(r["doc_id"], r["field"]): r["n_tokens"] for r in tokencount.field_tokens(df, path, "doc_id", cols).collect()}
    for i, r in enumerate(rows):
        ends = np.cumsum([len(x or "") + 1 for x in r]).tolist()
        spans, n = t.encode("".join((x or "") + "\n" for x in r), add_special_tokens=False).offsets, [0, 0, 0]
        for a, b in spans:
            n[int(np.argmax([min(b, e) - max(a, s) for s, e in zip([0, *ends[:-1]], ends)]))] += 1
        assert [got[i, c] for c in cols] == n
    assert tokencount.section_tokens(edgy(spark), path).select("doc_id").distinct().count() == 8
    assert tokencount.section_tokens(edgy(spark).limit(0), path).count() == 0


def plain_ima(block):
    """One mono block, sample by sample."""
    pred, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [pred]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            d = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
            pred = max(-32768, min(32767, pred - d if nibble & 8 else pred + d))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nibble & 7]))
            out.append(pred)
    return out


def plain_feature(raw):
    """The feature of a text, value by value, from the laws' formulas."""
    data = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
    ulaw = []
    alaw = 0
    for b in data:
        u = ~b & 255
        m = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
        ulaw.append(-m if u & 128 else m)
        x = b ^ 0x55
        e, m = x >> 4 & 7, (x & 15) << 4
        alaw += m + 8 if not e else (m + 264) << (e - 1)
    pcm = []
    for a, b in zip(ulaw, ulaw[1:] + [ulaw[-1]]):
        pcm += [a, (a + b) >> 1]
    pcm[-1] = ulaw[-1]
    blocks = [plain_ima(data[i : i + 64]) for i in range(0, len(data), 64)]
    rms = int((sum(x * x for x in pcm) / len(pcm)) ** 0.5)
    zc = sum((a >= 0) != (b >= 0) for a, b in zip(pcm, pcm[1:]))
    return f"n={len(pcm)};rms={rms};zc={zc};peak={max(map(abs, pcm))};alaw={alaw};ima={sum(abs(x) for b in blocks for x in b)};last={blocks[-1][-1]};pcm={zlib.crc32(np.array(pcm, '<i2').tobytes()):08x}"


@pytest.mark.parametrize("channels,block", [(1, 256), (1, 1024), (2, 512), (2, 64)])
def test_adpcm_is_decoded_by_its_header(channels, block):
    own = random.Random(block + channels)
    files, want = [], []
    for size in (block, 3 * block, 2 * block + 8 * 4 * channels):  # the last one ends in a shorter block
        payload = bytes(own.randrange(256) for _ in range(size))
        rows = []
        for at in range(0, size, block):
            b = payload[at : at + block]
            each = []
            for c in range(channels):
                body = b"".join(b[4 * channels + 4 * (g * channels + c) :][:4] for g in range((len(b) // channels - 4) // 4))
                each.append(plain_ima(b[4 * c : 4 * c + 4] + body))
            rows += list(zip(*each))
        files.append(media.wave(payload, media.IMA, 8000, channels, block))
        want.append(rows)
    got = media.decoded([media.parse(x) for x in files])
    assert [[tuple(int(v) for v in r) for r in g] for g in got] == want


def test_files_of_other_kinds_are_refused(spark):
    odd = [b"RIFF", media.wave(b"abcd", media.MULAW, channels=3), media.wave(b"ab", 85), media.wave(b"x" * 60, media.IMA, block=60, channels=2)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(odd)] + [(9, None)], "id int, media binary")
    assert [r["pcm"] for r in media.to_pcm(df, "id", "media").collect()] == [None] * 5
    two = media.wave(b"\x80\xff\x00\x7f", media.MULAW, channels=2)
    kept = media.to_pcm(spark.createDataFrame([(1, bytearray(two))], "id int, media binary"), "id", "media", 8000).first()["pcm"]
    assert np.frombuffer(media.parse(bytes(kept))[2], "<i2").tolist() == media.MULAW_TABLE[[0x80, 0xFF, 0x00, 0x7F]].tolist()


def test_telephony(spark):
    # known points of both laws, and the reference form of the ADPCM step
    assert media.MULAW_TABLE[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert media.ALAW_TABLE[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    block = bytes(rng.randrange(256) for _ in range(64))
    pred, index, want = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    want.append(pred)
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            pred = max(-32768, min(32767, pred + (-d if n & 8 else d)))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][n & 7]))
            want.append(pred)
    assert media.ima(np.frombuffer(block * 3, np.uint8))[1].tolist() == want
    texts = corpus()[:10] + ODD
    got = {r["doc_id"]: r for r in media.text_media(frame(spark, texts)).collect()}
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        stored = media.wave(full, media.MULAW)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    a = {r["doc_id"]: r["feature"] for r in media.text_media(frame(spark, ["p", "q" * 999, "p"])).collect()}
    assert a[0] == a[2] != a[1] and media.text_media(frame(spark, ["q" * 999])).first()["feature"] == a[1]
    for codec in (media.MULAW, media.ALAW, media.IMA):
        m = media.stored_texts(frame(spark, ["hello " * 30]), codec=codec)
        pcm = media.to_pcm(m, "id", "media").first()
        assert media.parse(bytes(pcm["pcm"]))[:2] == (media.PCM, 16000)
    broken = spark.createDataFrame([(1, bytearray(b"RIFFxx")), (2, None)], "id long, media binary")
    assert [r["pcm"] for r in media.to_pcm(broken, "id", "media").collect()] == [None, None]
    assert [r["feature"] for r in media.text_media(frame(spark, ["hello", "x" * 200])).orderBy("doc_id").collect()] == [plain_feature(b"hello"), plain_feature(b"x" * 200)]
    own = media.text_media(frame(spark, ["hello"])).first()
    file = media.to_pcm(media.stored_texts(frame(spark, ["hello"])), "id", "media").first()["pcm"]
    assert own["pcm_bytes"] == len(file) == 44 + 256 and own["pcm_sha256"] == hashlib.sha256(bytes(file)).hexdigest()
    assert media.text_media(edgy(spark)).count() == 9 and media.text_media(edgy(spark).limit(0)).count() == 0


def brute_pack(rows, capacity, per_source):
    """Best fit by looking at every bin."""
    bins, place = [], {}
    for size, doc, piece, source, cluster in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        fit = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= size and (source is None or b["s"].count(source) < per_source) and (cluster is None or cluster not in b["c"])]
        if fit:
            n = min(fit)[1]
        else:
            bins.append({"left": capacity, "s": [], "c": []})
            n = len(bins) - 1
        place[doc, piece] = (n, capacity - bins[n]["left"])
        bins[n]["left"] -= size
        bins[n]["s"].append(source)
        bins[n]["c"].append(cluster)
    return place


def test_packing_matches_brute_force(spark):
    rows = [(i, rng.choice([0, 3, 17, 30, 55, 99, 100, 101, 250]), rng.choice(["a", "a", "b", None]), rng.choice([None, 1, 2, 3])) for i in range(150)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, words long, source string, cluster long"), capacity=100, per_source=2)
    pieces = [(min(100, n - 100 * k), d, k, s, c) for d, n, s, c in rows for k in range(max(1, -(-n // 100)))]
    assert {(r["doc_id"], r["piece"]): (r["bin_id"], r["bin_offset"]) for r in got.collect()} == brute_pack(pieces, 100, 2)


def test_packing_edges(spark):
    out = packing.packed(packing.measured(edgy(spark))).collect()
    assert len({(r["doc_id"]) for r in out}) == 8
    same = [r["bin_id"] for r in out if r["doc_id"] == 6]
    assert len(same) == 2 and len(set(same)) == 2  # copies never share a bin
    assert packing.packed(packing.measured(edgy(spark).limit(0))).count() == 0


def synthetic_toxicity(n=600):
    bad = ["idiot", "moron", "vequila", "vequron"]
    texts, y = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    return texts, y


def test_toxicity_sees_through_the_channel(spark):
    texts, y = synthetic_toxicity()
    docs, labels = frame(spark, texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    model, judge = toxicity.trained(docs, labels.where("doc_id < 400"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model, judge).collect()}
    right = [(got[i] >= 0.5) == bool(y[i]) for i in range(400, 600)]
    assert np.mean(right) > 0.97
    clean = texts[1]
    hidden = [clean + " " + x for x in ("m0r0n 1d10t", "m o r o n so i d i o t", "mooooron idioooot", "m.o.r.o.n i.d.i.o.t", "m-o-r-o-n i-d-i-o-t", "MORON IDIOT", "morron iddiot", "mor on id iot")]
    found = [r["score"] for r in toxicity.scores(frame(spark, [clean, *hidden]), model, judge).orderBy("doc_id").collect()]
    assert found[0] < 0.5 and min(found[1:]) >= 0.5
    assert [r["doc_id"] for r in toxicity.accepted(docs, model, judge).collect()] == [i for i in range(600) if got[i] < 0.5]


def test_toxicity_edges(spark):
    e = edgy(spark)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model, judge = toxicity.trained(e, none)
    rows = toxicity.scores(e, model, judge).collect()
    assert len(rows) == 9 and all(0 <= r["score"] < 0.5 for r in rows)
    assert toxicity.accepted(e, model, judge).columns == e.columns
    assert toxicity.scores(e.limit(0), *toxicity.trained(e.limit(0), none)).count() == 0


def test_the_score_does_not_depend_on_the_caps(monkeypatch, spark):
    texts, y = synthetic_toxicity(600)
    rare = [i for i in range(600) if not y[i] or i % 8 == 0]  # toxic rows are few
    docs, labels = frame(spark, [texts[i] for i in rare]), spark.createDataFrame([(k, y[i]) for k, i in enumerate(rare)], "doc_id long, toxic int")
    toxic = sum(y[i] for i in rare)
    whole = toxicity.trained(docs, labels)[1]
    monkeypatch.setattr(toxicity, "CLEAN_SAMPLE", toxic)
    assert len(rare) > 4 * toxic and abs(toxicity.trained(docs, labels)[1].bias - whole.bias) < 0.5 * np.log((len(rare) - toxic) / toxic)


def test_another_model_is_another_channel():
    texts, y = synthetic_toxicity(200)
    whole = pa.array(texts[:20], pa.large_string())
    first = toxicity.smoothed(toxicity.trigrams(pa.array(texts, pa.large_string())).astype(float))
    judge = toxicity.fit(texts, np.array(y[:200]), toxicity.Channel(first))
    toxicity.scored(whole, first, judge)
    for _ in range(20):  # freed and made again, an array may get the same address
        other = np.ascontiguousarray(first[::-1, ::-1, ::-1])
        toxicity.scored(whole, other, judge)
        assert toxicity._last[0] is other and toxicity._last[1].lm == other.ravel().tolist()
        del other
        again = first.copy()
        toxicity.scored(whole, again, judge)
        assert toxicity._last[0] is again and toxicity._last[1].lm == first.ravel().tolist()


def test_viterbi_matches_all_paths():
    texts, _ = synthetic_toxicity(200)
    model = toxicity.smoothed(toxicity.trigrams(pa.array(texts, pa.large_string())).astype(float))
    channel = toxicity.Channel(model)

    def paths(word):
        out = [("", 0.0, (0, 0))]
        for i, c in enumerate(word):
            twice = i > 0 and word[i - 1] == c
            run = twice and (i > 1 and word[i - 2] == c or i + 1 < len(word) and word[i + 1] == c)
            ways = [(toxicity.class_of(c), c, 0.0)] if c.isalpha() else [(toxicity.class_of(x), x, toxicity.LOOK) for x in toxicity.LOOKALIKES.get(c, "")] + [(0, " ", toxicity.KEEP if c in toxicity.LOOKALIKES else toxicity.SPLIT)]
            if run or twice and c.isalpha() or c in toxicity.SEPARATORS:
                ways.append((-1, "", toxicity.REPEAT if run else toxicity.DOUBLE if twice and c.isalpha() else toxicity.SPLIT))
            new = []
            for text, s, (a, b) in out:
                for k, x, cost in ways:
                    if k < 0 or k == 0 and b == 0 and x == " ":
                        new.append((text, s + cost, (a, b)))
                    else:
                        new.append((text + x, s + cost + float(model[a, b, k]), (b, k)))
            out = new
        return max(s + float(model[a, b, 0]) for _, s, (a, b) in out), {text for text, s, (a, b) in out if s + float(model[a, b, 0]) > max(x + float(model[p, q, 0]) for _, x, (p, q) in out) - 1e-6}

    for word in ("m0r0n", "1d1ot", "m.o.r", "moooon", "v3qu1la", "$4m3", "a-b c", "moroon", "iddiot", "lalla"):
        assert channel.restore(word) in paths(word)[1]


LANGS = {"en": ["the", "of", "and", "th", "ing", "tion", "er"], "de": ["der", "und", "sch", "ung", "keit", "ein"], "fr": ["les", "eau", "que", "ment", "oi", "é"]}


def test_language_id(spark):
    rows = []
    for i in range(450):
        lang = [*LANGS][i % 3]
        rows.append((i, " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30)), lang))
    rows += [(450, None, "en"), (451, "123 ... 456", "en"), (452, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained(docs, where=F.col("doc_id") < 300)
    got = {r["doc_id"]: r for r in langid.languages(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in range(300, 450)]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in (450, 451, 452))
    kept = {r["doc_id"] for r in langid.accepted(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["accepted"]} and len(kept) > 440
    one = langid.languages(docs.where("doc_id = 7"), model).first()
    assert abs(one["score"] - got[7]["score"]) < 1e-6  # a text's score doesn't depend on its neighbours


def test_predictions_equal_a_plain_computation():
    texts = [" ".join("".join(rng.choice(LANGS[x]) for _ in range(2)) for _ in range(12)) for x in [*LANGS] * 30]
    model = langid.train(texts, [*LANGS] * 30)
    asked = ["The eau; and Ünd que!", "x", "der und 12 keit", "é"]

    def plain(text):
        spelled = " ".join("".join(chr(c) if 97 <= c <= 122 or c >= 128 else " " for c in text.lower().encode()).split(" "))
        while "  " in spelled:
            spelled = spelled.replace("  ", " ")
        raw = bytes(ord(c) for c in (spelled if spelled.startswith(" ") else " " + spelled))
        total, n = np.zeros(len(model.languages)), 0
        for size in langid.GRAMS:
            for i in range(len(raw) - size + 1):
                gram = raw[i : i + size]
                if b" " in gram[1:-1] or gram == b"  ":
                    continue
                h = size * 0x9E3779B1 & 0xFFFFFFFF
                for b in gram:
                    h = (h ^ b) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 13
                total += model.table[h >> 17, :-1]
                n += 1
        x = np.exp((total / max(1, n) + model.bias) * model.heat)
        return model.languages[int(x.argmax())], x.max() / x.sum()

    names, scores = model.predict(pa.array(asked, pa.large_string()))
    for text, name, score in zip(asked, names, scores):
        want = plain(text)
        assert name == want[0] and abs(score - want[1]) < 1e-4


def test_rejection_is_calibrated():
    scores, right = np.linspace(0.3, 1, 1000), np.ones(1000, bool)
    right[:50] = False
    noise = np.linspace(0.2, 0.4, 100)
    t = langid.calibrated(scores, right, noise)
    assert (scores[right] < t).mean() <= langid.LOST + 1e-3 and (noise < t).mean() >= 0.5  # clean rows come first
    assert langid.calibrated(np.full(100, 0.99), np.ones(100, bool), noise) == pytest.approx(np.quantile(noise, langid.NOISE))
    assert 0 < langid.train(["der und ung " * 5, "les eau que " * 5] * 20, ["de", "fr"] * 20).reject < 1


def test_language_id_edges(spark):
    e = edgy(spark)
    model = langid.trained(e)
    assert langid.languages(e, model).count() == 9 and langid.accepted(e, model).columns == e.columns
    empty = langid.trained(e.limit(0))
    assert [r["lang_pred"] for r in langid.languages(e, empty).collect()] == ["und"] * 9


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_give_every_row(spark, sf, name):
    table, key = ("embeddings", "vec_id") if name.startswith("op6") else ("documents", "doc_id")
    got = QUERIES[name](spark, sf).select(key).distinct().count()
    assert got == spark.read.parquet(f"{sf}/{table}.parquet").count()
