"""Source divergence, ranked search and URL filters: against SQL, against brute force, and on odd tables."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphwright.llm import divergence, lexical, queries, reputation
from graphwright.sources.scratch import stored

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n int, term string, id string"


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_ranked_search", "op13_url_filters"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in os.listdir(SF):
        con.execute(f"CREATE VIEW {path[:-8]} AS SELECT * FROM read_parquet('{SF}/{path}')")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(queries.ORACLE_SQL[name]).df())


# source divergence


def brute_audit(docs, least):
    texts = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in docs]
    out = set()
    for lang in {x[0] for x in texts}:
        mine = [x for x in texts if x[0] == lang]
        df = Counter(t for x in mine for t in set(x[2]))
        kept = sorted(t for t in df if df[t] >= least)
        sources = sorted({x[1] for x in mine})
        counts = {s: Counter(t for x in mine if x[1] == s for t in x[2]) for s in sources}
        total = Counter(t for x in mine for t in x[2])

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(counts[s]) for s in sources}, share(total)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= 10}
    return out


def odd_documents(n=150):
    random.seed(11)
    words = ["Ab", "ab", "the", "été", "ÉTÉ", "中文", "a1b", "x-y", "\x00", "😀", "\xa0", "zz", *[f"w{chr(97 + i)}" for i in range(20)]]
    out = [(" ".join(random.choices(words, k=random.randint(0, 30))), random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "s3", None])) for _ in range(n)]
    return [*out, (None, "en", "s9"), ("", "xx", "one"), ("word " * 200_000, "en", "s1"), *out[:5]]


@pytest.mark.parametrize("least", [1, 10])
def test_divergence_is_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(divergence, "TALLIED", 50)
    monkeypatch.setattr(divergence, "REMEMBERED", 20)
    docs = odd_documents()
    table = spark.createDataFrame([(i, *d, i, "t", "x") for i, d in enumerate(docs)], DOCS).repartition(3)
    got = {tuple(r) for r in divergence.audit(table, least=least).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == brute_audit(docs, least)


def test_divergence_of_few_rows(spark):
    table = spark.createDataFrame([(1, "a b", "en", "s", 0, "t", "x"), (2, "b", "en", None, 0, "t", "x"), (3, "c", None, None, 0, "t", "x")], DOCS)
    # no term is in ten documents: distances of 0; the language without a name has one source
    assert {tuple(r) for r in divergence.audit(table).collect()} == {("en", "s", "pair", "", 0, 1), ("en", "", "pair", "s", 0, 1)}
    assert divergence.audit(table.limit(0)).collect() == []


def test_tallies_cross_batches():
    rows = [("en", t, s, n) for t in ("a", "b", "c") for s, n in (("s1", 1), ("s2", 2), ("s3", 1))]
    whole = pa.table({"lang": [r[0] for r in rows], "source": [r[2] for r in rows], "term": [r[1] for r in rows], "n": [r[3] for r in rows]})
    found = Counter()
    for batch in divergence._tallied(iter(whole.to_batches(max_chunksize=2))):
        for r in batch.to_pylist():
            found[r["source"], r["other"], r["a"], r["b"]] += r["terms"]
    assert found == {("s1", "s2", 1, 2): 3, ("s1", "s3", 1, 1): 3, ("s2", "s3", 2, 1): 3}


# ranked search


def brute_search(docs, items, best):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counted = [(i, Counter(terms(text))) for i, text in docs]
    n = sum(bool(c) for _, c in counted)
    words = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = set()
    for item, wanted in asked.items():
        found = []
        for i, c in counted:
            m = 100 - 90 + (90 * c.total() * n) // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:best], 1)}
    return out


@pytest.mark.parametrize("block,chunk", [(1, 1), (200, 60), (1 << 21, 1 << 22)])
def test_search_is_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    random.seed(12)
    words = ["Ab", "ab", "the", "été", "ÉTÉ", "中文", "a1b", "x-y", "\x00", "2024", *[f"w{i}" for i in range(40)]]
    texts = [" ".join(random.choices(words, weights=range(len(words), 0, -1), k=random.randint(0, 25))) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (5, texts[5]), (500, texts[7]), (501, texts[7]), (600, None), (601, ""), (602, "the " * 100_000 + "w3")]
    items = [(1, "the ab w3"), (2, "w39 2024 W38 w39"), (3, None), (4, "nowhere"), (None, "été w5"), (5, "w7"), (5, "w8"), (6, texts[7])]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, score int").repartition(3)
    found = lexical.rank(table, spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, id string"))
    assert sorted(map(repr, map(tuple, found.select("item", "rank", "id", "score").collect()))) == sorted(map(repr, brute_search(docs, items, 10)))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert lexical.rank(docs.limit(0), items).collect() == lexical.rank(docs, items.limit(0)).collect() == lexical.rank(docs.where("false").union(spark.createDataFrame([(2, None)], docs.schema)), items).collect() == []
    assert [tuple(r) for r in lexical.rank(docs.union(spark.createDataFrame([(2, "c")], docs.schema)), items).select("item", "rank", "id").collect()] == [("q", 1, 1)]


def test_bounds_spare_most_exact_scores(spark, monkeypatch):
    """Bounds decide which documents are scored; far fewer than those that share a term with an item."""
    blocks = stored(lexical.index(spark.read.parquet(f"{SF}/documents.parquet")))
    batches = blocks.toArrow().to_batches()
    docs = sum(len(x) for b in batches for x in b.column("ids"))
    scored = []
    add = lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, s, i, n: (scored.append(len(s)), add(self, s, i, n)))
    vocabulary = {t: k for k, t in enumerate(sorted({t for b in batches for x in b.column("terms") for t in x.as_py()}))}
    item = (0, list(range(0, len(vocabulary), 40)), [1000] * len(range(0, len(vocabulary), 40)))
    list(lexical._searched(iter(batches), [item], vocabulary, docs, 10**5, 10))
    assert sum(scored) < docs / 2


# URL filters


def test_hosts_and_paths(spark):
    urls = ["http://A.example.NET/en/1?x#y", "https://u:p@b.co.uk:80/x", "no scheme", None, "x://", "x://h?q=/a", "a://b://c/d", "http://h#f", "http://exAmple.com./de/1", "HTTP://É.org/fr/", "http://[::1]:80/p", "http://1.2.3.4/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", reputation.host(F.col("url")).alias("host"), reputation.path(F.col("url")).alias("path"))
    got = [tuple(r) for r in df.select("host", "path", reputation.site(F.col("host")).alias("s"), reputation.domain(reputation.site(F.col("host"))).alias("d"), reputation.suffix(reputation.site(F.col("host"))).alias("e")).collect()]
    assert got == [
        ("a.example.net", "/en/1", "a.example.net", "example.net", "net"),
        ("u:p@b.co.uk:80", "/x", "b.co.uk", "b.co.uk", "co.uk"),
        ("", "", "", "", ""),
        ("", "", "", "", ""),
        ("", "", "", "", ""),
        ("h", "", "h", "h", "h"),
        ("b:", "//c/d", "b", "b", "b"),
        ("h", "", "h", "h", "h"),
        ("example.com.", "/de/1", "example.com", "example.com", "com"),
        ("É.org", "/fr/", "É.org", "É.org", "org"),
        ("[::1]:80", "/p", "[::1]", "[::1]", ""),
        ("1.2.3.4", "/", "1.2.3.4", "1.2.3.4", ""),
    ]


def test_longest_rule_wins(spark):
    rules = [*reputation.RULES, ("allow", "example.net", "/xx/")]
    cases = [("example.net", "/en/x"), ("a.example.net", "/de/"), ("net", "/"), ("net", ""), ("myexample.com", "/de/"), ("a.example.com", "/de/"), ("example.com", "/de"), ("org", "/fr/1"), ("b.org", "/en/")]
    got = spark.createDataFrame(cases, "host string, path string").select(reputation.fitting_rule(F.col("host"), F.col("path"), rules).alias("r")).collect()
    assert [r.r and (r.r.rule, r.r.verdict) for r in got] == [("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), None, None, ("example.com/de/", "block"), None, ("org/fr/", "allow"), None]


def judged(spark, pages, bad, **more):
    table = spark.createDataFrame([(i, u, "x", 1, "y") for i, u in pages], "page_id long, url string, host string, bad int, verdict string")
    return reputation.judge(table, spark.createDataFrame(bad, "doc long, bad int"), rules=[], **more).collect()


def test_bad_hosts_are_blocked_and_others_shrink(spark):
    pages, bad = [], []
    for h in range(12):
        for k in range(40):
            i = h * 100 + k
            pages.append((i, f"http://h{h}.site{h % 3}.com/{k}"))
            # a host of bad pages; the others have one bad page in ten
            bad.append((i, 1 if h == 5 else int(k % 10 == 0)))
    pages += [(5000, "http://new.site2.com/a"), (5001, "http://new.site1.com/a"), (5002, "http://other.org/"), (5003, None), (5000, "http://new.site2.com/a"), (None, "http://h5.site2.com/z")]
    got = judged(spark, pages, [*bad, (None, 1), (5002, None), (0, 0)])
    assert len(got) == len(pages)
    by = {r.id: r for r in got}
    blocked = {r.host for r in got if r.verdict == "block"}
    assert blocked == {"h5.site2.com"} and by[500].bad_rate > 0.8
    # without evidence of its own, a host has its domain's mean and no narrow bound
    assert by[5000].bad_rate > by[5001].bad_rate and by[5000].verdict == "allow" and by[5003].host == by[5003].path == ""
    # shrunk towards the domain
    assert 0.1 < by[100].bad_rate < by[200].bad_rate < 0.4


def test_reputation_needs_evidence(spark):
    assert {(r.verdict, r.bad_rate) for r in judged(spark, [(1, "http://a.com/"), (2, None)], [])} == {("allow", 0.5)}
    assert judged(spark, [], [(1, 1)]) == []
    # one bad page blocks nothing
    assert {r.verdict for r in judged(spark, [(1, "http://a.com/"), (2, "http://b.com/")], [(1, 1), (2, 0)])} == {"allow"}
    assert [r.verdict for r in judged(spark, [(i, "http://a.com/") for i in range(100)], [(i, 1) for i in range(100)])] == ["block"] * 100
