from collections import Counter

import corpus_pipeline
from strandloom.llm import mixing, sharding


def test_the_last_stage_places_every_row(spark, odd, none, sf_dir):
    """Odd rows: slots without gaps, copies of a text together, nothing lost."""
    rows = corpus_pipeline.sharded(spark, odd, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    places = {}
    for r in rows:
        if r["text_crc32"]:  # null and empty texts are two groups
            places.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(p) == 1 for p in places.values()) and all(0 <= r["shard"] < sharding.SHARDS for r in rows)
    assert corpus_pipeline.sharded(spark, none, sf_dir).collect() == []


def test_a_source_for_every_document(spark):
    """As many sources as documents: each target is reached to within its document."""
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 as int)) AS text", "cast(id as string) AS source")
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == 300 and all(0 <= r["taken"] <= 2 * r["size"] and abs(r["taken"] - r["target"]) <= r["size"] for r in rows)
