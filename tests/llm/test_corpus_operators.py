"""Operators that compare texts with each other, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphwright.llm import linking, queries, simhash, suffix
from graphwright.llm.components import components


def brute_print(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(prints):
    """Smallest index that links reach."""
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3 and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return [find(i) for i in range(len(prints))]


def test_fingerprints_are_brute_forces():
    texts = [None, "", " \t", "One", "one TWO", "a b c", "a b c d e f", "É é Straße", "x " * 4000, "a\x0bb\x0cc\xa0d"]
    assert simhash._fingerprints(texts, 3, 42)[:, 0].tolist() == [brute_print(t) for t in texts]


def test_groups_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    prints = [brute_print(t) for _, t in docs]
    want = {i: (f"{p:016x}", docs[g][0]) for (i, _), p, g in zip(docs, prints, brute_groups(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_dedup(spark, sf).collect()} == want


def test_links_of_all_distances(spark):
    random.seed(1)
    base = [random.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1, 1 << 63]
    prints = sorted({p for b in base for k in range(6) for p in [b ^ sum(1 << i for i in random.sample(range(64), k))]})
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(v,) for v in signed.values()] * 2 + [(None,)], "fp long")
    for distance in (1, 3, 5):
        want = {tuple(sorted((signed[a], signed[b]))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance}
        got = [(r.a, r.b) for r in simhash.links(df, distance).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_links_dont_pass_the_driver(spark, tmp_path):
    """The index has 64 rows for each fingerprint, and Spark takes it for as small as the fingerprints."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "prints"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "prints")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "x y z"), (4, "x y z"), (2, "x y z"), (2, "x y z"), (7, None), (8, ""), (9, "other words here now")], "doc_id int, text string")
    got = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2), (4, 2), (2, 2), (2, 2), (7, 7), (8, 7), (9, 9)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([(None, "a")], "doc_id int, text string")).first().component_id is None


def test_keep_one(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(2000)]
    text = " ".join(random.choices(words, k=400))
    near = text.split()
    near[200] = "changed"
    rows = [(5, text, 1), (3, text, 2), (9, " ".join(near), 3), (1, " ".join(random.choices(words, k=400)), 4), (2, None, 5), (6, "", 6), (7, "", 7), (None, text, 8)]
    df = spark.createDataFrame(rows, "doc_id int, text string, fp int")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(((r.doc_id, r.fp) for r in got.collect()), key=str) == sorted([(3, 2), (1, 4), (2, 5), (6, 6), (7, 7), (None, 8)], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_goes_by_shingles_not_by_bits(spark):
    random.seed(4)
    line = " ".join(f"notice{i}" for i in range(12))
    texts = [" ".join([" ".join(f"w{random.randrange(10**6)}" for _ in range(200)), *[line] * 20]) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert simhash.keep_one(df).count() == 20


def test_keep_one_finds_pairs_near_its_limit(spark):
    random.seed(8)
    rows, want = [], set()
    for i in range(200):
        text = [f"w{random.randrange(10**6)}" for _ in range(300)]
        end = text[: random.randint(264, 278)] + [f"x{random.randrange(10**6)}" for _ in range(35)]
        x, y = ({" ".join(t[k : k + 5]) for k in range(len(t) - 4)} for t in (text, end))
        want |= {2 * i} if len(x & y) / len(x | y) >= 0.8 else {2 * i, 2 * i + 1}
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(end))]
    assert 220 < len(want) < 380
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()} == want


def test_keep_one_compares_few_pairs_that_are_just_unlike(spark, monkeypatch):
    """60 texts, any two of which are some 0.75 alike: none are linked, and few of their 1,770 pairs get as far as a comparison of texts."""
    random.seed(9)
    base = [f"w{k}" for k in range(600)]
    rows = []
    for i in range(60):
        text = list(base)
        for k in random.sample(range(120), 9):
            text[5 * k + 2] = f"x{i}_{k}"
        rows.append((i, " ".join(text)))
    sets = [simhash.shingle_set(t, 5, 42) for _, t in rows]
    pairs = [(i, j) for i in range(60) for j in range(i)]
    alike = {p for p in pairs if simhash.similarity(sets[p[0]], sets[p[1]]) >= 0.8}
    compared, whole = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda some, *rest: compared.append(some.count()) or whole(some, *rest))
    top = list(range(60))
    for _ in top:
        for i, j in alike:
            top[i] = top[j] = min(top[i], top[j])
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {i for i in range(60) if top[i] == i} and not alike and sum(compared) < 300


def test_keep_ones_exploded_tables_and_texts_dont_pass_the_driver(spark, monkeypatch):
    """Spark takes 25 rows for each node for one, and repeated facts and texts for as small as their packed files."""
    rows = [(i, " ".join([f"w{k}" for k in range(100)] + [f"x{i // 2}_{k}" for k in range(20 + i % 2)])) for i in range(30)]
    plans, write = [], simhash.stored

    def spied(df, release=False):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, release)

    docs = write(spark.createDataFrame(rows, "doc_id int, text string"))
    monkeypatch.setattr(simhash, "stored", spied)
    monkeypatch.setattr(linking, "stored", spied)
    assert [r.doc_id for r in simhash.keep_one(docs).orderBy("doc_id").collect()] == list(range(0, 30, 2))
    joins = [found for plan in plans for found in re.findall(r"(\w+Join) \[(key|id)#", plan)]
    assert len(joins) >= 7 and set(joins) <= {("SortMergeJoin", "key"), ("SortMergeJoin", "id")}


def test_parities_lose_no_pair():
    random.seed(10)
    for size in (1, 9, 150, 3000):
        x = [random.getrandbits(64) for _ in range(size)]
        for gone in (0, 1, size // 10, size // 9, size // 2):
            y = x[gone:] + [random.getrandbits(64) for _ in range(gone)]
            differ = simhash._parities(np.array(x, np.uint64)) ^ simhash._parities(np.array(y, np.uint64))
            assert sum(int(d).bit_count() if d >= 0 else (int(d) + (1 << 64)).bit_count() for d in differ) <= len(set(x) ^ set(y))


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 300 + i) for i in range(50)] + [(7, 7), (None, 1)]
    top = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in top and b in top and a is not None and b is not None and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()} == top
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def brute_repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [8, 21, 200])
def test_repeats_are_brute_forces(spark, length):
    random.seed(4)
    base = "".join(random.choice("abcdefgh é") for _ in range(900))
    texts = [None, "", "a" * (length - 1), "a" * length, "a" * (length + 1), "ab" * 150, base, base[:450] + "X" + base[452:], base[300:700], "zz" + base[100:320] + "q" * 7 + base[150:380], base]
    texts += ["".join(random.choice("ab") for _ in range(random.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, k1 int")
    got = Counter((r.repeats.n_bytes, r.repeats.n_removed, r.repeats.n_spans, hashlib.sha256(bytes(r.repeats.kept)).hexdigest()) for r in suffix.without_repeats(df, length=length).collect())
    assert got == Counter(brute_repeats(texts, length))


def test_repeats_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, sf).collect()}
    assert got == dict(zip([r.doc_id for r in docs], brute_repeats([r.text for r in docs], 200), strict=True))


def test_repeats_keep_whole_characters(spark):
    df = spark.createDataFrame([(1, "é" + "x" * 11 + "é1"), (2, "è" + "x" * 11 + "é2"), (3, "plain")], "doc_id int, text string")
    got = {r.doc_id: bytes(r.repeats.kept).decode() for r in suffix.without_repeats(df, length=12, whole_characters=True).collect()}
    assert got == {1: "é1", 2: "è2", 3: "plain"}
    assert suffix.without_repeats(df.limit(0), length=12).count() == 0


def test_block_size_changes_nothing(monkeypatch):
    random.seed(5)
    texts = ["".join(random.choice("abc") for _ in range(random.randint(0, 900))).encode() for _ in range(30)]
    want = suffix.runs_of(texts, 40, True)
    for size in (1, 500, 1 << 22):
        monkeypatch.setattr(suffix, "BLOCK", size)
        got = suffix.runs_of(texts, 40, True)
        assert all((got[k] == want[k]).all() for k in want)
