"""Nulls, empty and long texts, ties, repeated rows, clashing names, empty tables."""

import zlib

import corpus_pipeline
import pytest

from strandloom.llm import decontam, dedup, langid, merkle, mixing, ngram, quality, secrets, sharding, toxicity

from .conftest import WORDS


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, 0), (9, 0, 1), (9, 1, None), (None, 1, 1), (10, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (4, "one"), (None, "one"), (1, "naïve straße")], "item_id long, text string")


OPERATORS = {
    "near_duplicates": lambda d, m, i: dedup.near_duplicates(d),
    "secrets": lambda d, m, i: secrets.findings(d),
    "scores": lambda d, m, i: ngram.document_scores(d),
    "shards": lambda d, m, i: sharding.shard_documents(d),
    "toxicity": lambda d, m, i: toxicity.predictions(d, m),
    "window_hits": lambda d, m, i: decontam.window_hits(d, i),
    "quality": lambda d, m, i: quality.predictions(d, m),
    "fingerprints": lambda d, m, i: merkle.fingerprints(d),
    "mix": lambda d, m, i: mixing.mix_report(d),
    "language": lambda d, m, i: langid.predictions(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, marks, items, name):
    rows = OPERATORS[name](odd, marks, items).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((r["doc_id"] for r in odd.collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, marks, items, name):
    assert OPERATORS[name](none, marks.limit(0), items.limit(0)).count() == 0


def rows_by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], r)
    return out


def test_near_duplicates_defined_cases(odd):
    got = rows_by_id(dedup.near_duplicates(odd))
    assert got[3]["n_shingles"] == got[4]["n_shingles"] == got[5]["n_shingles"] == 0
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 10, 11)] == [1, 1, 3, 4, 5, 6, 6, 10, 10]
    assert got[None]["component_id"] is None and got[None]["kept"]
    left = [r["doc_id"] for r in dedup.distinct_documents(odd).collect()]
    assert sorted(left, key=str) == sorted([1, 3, 4, 5, 6, 8, 9, 10, None, None] + ([12] if got[12]["kept"] else []), key=str)


def test_other_defined_cases(odd, marks, items):
    lang = rows_by_id(langid.predictions(odd))
    assert all(lang[i]["lang_pred"] == "und" and lang[i]["score"] == 0 for i in (3, 4, 5, 8)) and lang[None]["held_out"]
    hits = rows_by_id(decontam.window_hits(odd, items))
    assert hits[1]["contaminated"] and hits[10]["n_hit"] == 1 and not hits[3]["contaminated"] and hits[9]["n_items"] == 0
    shards = sharding.shard_documents(odd).collect()
    assert {r["text_crc32"] for r in shards if r["doc_id"] in (3, 4)} == {0} and all(r["grown_shard"] is None for r in shards)
    assert len({r["shard"] for r in shards if r["text_crc32"] == zlib.crc32(WORDS.encode())}) == 1
    prints = rows_by_id(merkle.fingerprints(odd))
    assert prints[3]["n_chars"] == 0 and prints[3]["fingerprint"] == prints[4]["fingerprint"] and prints[1]["fingerprint"] == prints[2]["fingerprint"]
    found = rows_by_id(secrets.findings(odd))
    assert (found[12]["n_assign"], found[12]["n_access"]) == (1, 1) and found[3]["spans"] == ""
    for df in (quality.predictions(odd, marks), toxicity.predictions(odd, marks)):
        assert all(0 <= r["score"] <= 1 for r in df.collect())
    scores = rows_by_id(ngram.document_scores(odd))
    assert scores[3]["n_tokens"] == scores[4]["n_tokens"] == 1 and all(r["score"] < 0 for r in scores.values())
    mix = mixing.mix_report(odd).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in mix) and {r["size"] for r in mix if r["doc_id"] in (3, 4, 5)} == {0}


def test_a_single_document(spark):
    one = spark.createDataFrame([(5, "a few words in one text", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.fingerprints(one).first()
    assert r["near_next"] == 1.0
    assert dedup.near_duplicates(one).first()["kept"] and sharding.shard_documents(one).first()["slot"] == 0
    assert mixing.mix_report(one).first()["taken"] in (6, 12)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_the_columns(spark, odd, none, sf_dir, stage):
    for docs in (odd, none):
        out = stage[1](spark, docs, sf_dir)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.collect()


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    known = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert len(ids(known)) >= 0.99 * docs.count()
    single = corpus_pipeline.without_near_duplicates(spark, docs, sf_dir)
    assert ids(single) == {r["doc_id"] for r in dedup.near_duplicates(docs).where("kept").collect()} < ids(docs)
    clean = corpus_pipeline.without_benchmark(spark, docs, sf_dir)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(docs) - ids(clean) == {r["doc_id"] for r in decontam.contained_items(docs, bench).collect()}
    final = corpus_pipeline.run(spark, sf_dir)
    assert {r["shard"] for r in final.collect()} <= set(range(sharding.SHARDS)) and final.count() > 0
