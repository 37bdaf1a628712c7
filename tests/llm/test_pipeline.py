"""The corpus pipeline on a small table, stage by stage."""

import hashlib
from array import array

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from graphwright.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    for df in seen[:-1]:
        assert df.columns == columns
    start, good, unlike, cut, clean, coded = ({r.doc_id: r for r in df.collect()} for df in seen)
    assert good.keys() < start.keys() and all(i not in good or labels[i].quality == 1 for i in labels) and all(i in good for i in labels if labels[i].quality == 1)
    assert unlike.keys() < good.keys() and {r.text for r in good.values()} == {r.text for r in unlike.values()} | {good[i].text for i in good.keys() - unlike.keys()}
    assert len({r.text for r in unlike.values() if r.text.strip()}) == len([r for r in unlike.values() if r.text.strip()])
    assert cut.keys() == unlike.keys() and all(len(cut[i].text) <= len(unlike[i].text) and cut[i].n_chars == len(cut[i].text) for i in cut)
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, r in cut.items() if any(t in decontaminate.normalised(r.text) for t in items)}
    assert clean.keys() == cut.keys() - bad
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in coded.items():
        ids = library.encode(clean[i].text, add_special_tokens=False).ids
        assert list(array("I", bytes(r.ids))) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert coded.keys() == clean.keys()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(coded)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_stages_of_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " and more"
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, text, "en", "s", 5, 7), (2, near, "en", "s", 5, 8), (3, None, None, None, None, 9), (4, "", "en", "s", 0, 10), (None, text, "en", "s", 5, 11), (5, f"so {benchmark} it is", "en", "s", 9, 12), (5, f"so {benchmark} it is", "en", "s", 9, 12), (6, "x " * 30_000, "fr", "s", 60_000, 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, repeats int")
    by = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    assert ids(by["SimHash near-dedup"](spark, docs, SF)) == sorted([1, 3, 4, None, 5, 5, 6], key=str)
    assert ids(by["benchmark decontamination"](spark, docs, SF)) == sorted([1, 2, 3, 4, None, 6], key=str)
    cut = {(r.doc_id, r.repeats): r.text for r in by["suffix-array dedup"](spark, docs, SF).collect()}
    assert len(cut) == 7 and cut[3, 9] is None and cut[4, 10] == "" and cut[1, 7] == "" and cut[2, 8] == " and more"[-len(cut[2, 8]):] and cut[6, 13] == ""
    coded = by["BPE encoding and decoding"](spark, docs, SF).collect()
    assert len(coded) == len(rows) and {r.n_tokens for r in coded if r.doc_id in (3, 4)} == {0}


def test_near_dedup_of_the_table_is_brute_forces(spark):
    """Every pair of similarity 0.8 or more is linked, and nothing else is."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]

    def shingles(text):
        words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    sets = {i: s for i, t in rows if (s := shingles(t))}
    top = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    want = {i for i, _ in rows if i not in sets or top[i] == i}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, SF).collect()} == want and len(links) > 5
