"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. The keys are cut into ranges (buckets); bucket sums and their prefix
sums per source show in which bucket a source's budget ends, and only that bucket is sorted and summed
document by document. What comes out is one cut key for each source, so that texts never move: a document
is taken once more than the full epochs if its key is at or below its source's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1:"
#: Sources up to this many are broadcast to the documents; beyond it the join is shuffled.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _hash_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(sk, source_size, target, full, rest) of each source.

    Targets share ``share`` of all words by weight; what a source can't give at ``max_epochs`` is shared
    again by weight. With sources by the ratio of what they can give to their weight, the level
    (words a unit of weight) is the largest of (budget - caps before) / (weights from here on).
    The windows see one row for each source.
    """
    by_name = Window.orderBy(F.substring("sk", 1, 1).desc(), "sk")
    given = F.array(*[F.lit(float(w)) for w in weights])
    per = (
        sized.groupBy("sk").agg(F.sum("size").alias("source_size"))
        .withColumn("w", F.element_at(given, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    )
    level = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("w").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = (
        per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("at", (F.col("budget") - before) / later)
        .withColumn("target", F.least("cap", F.col("w") * F.max("at").over(everything)))
    )
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return per.withColumn("full", full).select(
        "sk", "source_size", "target", "full", (F.col("target") - F.col("full") * F.col("source_size")).alias("rest")
    )


def mix_cuts(sized: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(sk, source_size, target, full, cut): documents of a source with key <= cut are taken full + 1 times."""
    targets = source_targets(sized, weights, share, max_epochs)
    buckets = sized.groupBy("sk", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = Window.partitionBy("sk").orderBy("bucket")
    buckets = buckets.withColumn("upto", F.sum("bucket_size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ends = (
        buckets.join(targets.select("sk", "rest"), "sk")
        .where((F.col("upto") - F.col("bucket_size") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        .select("sk", "bucket", (F.col("upto") - F.col("bucket_size")).alias("base"), "rest")
    )
    last = sized.join(ends, ["sk", "bucket"])
    inner = Window.partitionBy("sk", "bucket").orderBy("key", "size")
    last = last.withColumn("upto", F.col("base") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (
        last.where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
        .groupBy("sk").agg(F.max("key").alias("inner_cut"))
    )
    return (
        targets.join(ends.select("sk", "bucket"), "sk", "left").join(inside, "sk", "left")
        .select("sk", "source_size", "target", "full", F.coalesce("inner_cut", "bucket", F.lit("")).alias("cut"))
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(sized, cuts) for documents with doc_id, text and source; other columns are ignored.

    A null text has no words; null sources are one source, the last; documents of a null id share one key.
    Rows that repeat a doc_id are taken together. A source without words gets no budget. An empty table
    gives empty results. The document at a cut is taken if that comes nearer to the budget.
    """
    key = _hash_key(F.col("doc_id"), seed)
    sized = docs.select("doc_id", _source_key(F.col("source")).alias("sk"), key.alias("key"), n_words(F.col("text")).alias("size"))
    sized = table(sized.withColumn("bucket", F.substring("key", 1, 3)), "mix-sized")
    cuts = table(mix_cuts(sized, weights, share, max_epochs), "mix-cuts")
    return sized, cuts


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    copies = F.col("full") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return rows.join(cuts, "sk").withColumn("copies", copies.cast("long"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies.

    A null text has size 0, a null source is a source of its own, last in order. A document's place in its source depends on its
    id alone, so rows of one id (null ids are one) and ties go the same way, and each counts by itself; a source may be named
    by one document only. An empty table gives no rows; other columns are ignored.
    """
    sized, cuts = mix_sources(docs, **how)
    return _with_cuts(sized, cuts).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, repeated as often as they are taken, with their own columns, whatever their names.

    Null sources, ids and texts, repeated rows and an empty table as in ``mix_report``; texts of any length move only once.
    """
    names = docs.columns
    _, cuts = mix_sources(docs, **how)
    cuts = cuts.select(*[F.col(c).alias(f"_mix_{c}") for c in cuts.columns])
    small = cuts.count() <= BROADCAST_SOURCES
    rows = docs.withColumn("_mix_key", _hash_key(F.col("doc_id"), how.get("seed", SEED)))
    rows = rows.join(F.broadcast(cuts) if small else cuts, _source_key(F.col("source")) == F.col("_mix_sk"))
    copies = F.col("_mix_full") + F.when(F.col("_mix_key") <= F.col("_mix_cut"), 1).otherwise(0)
    rows = rows.withColumn("_mix_n", copies).where("_mix_n > 0")
    rows = rows.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(1), F.col("_mix_n").cast("int"))))
    return rows.select(*[rows[f"`{c}`"] for c in names])


#: DuckDB statement with the same rows as mix_report at its defaults.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS sk, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT sk, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY substr(sk, 1, 1) DESC, sk) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sized GROUP BY sk),
lev AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later
  FROM per),
targets AS (
  SELECT sk, source_size, least(source_size * 2.0::DOUBLE, w * max((budget - before) / later) OVER ()) AS target FROM lev),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_epochs FROM targets),
run AS (
  SELECT s.doc_id, s.sk, s.size, c.source_size, c.target, c.full_epochs, c.target - c.full_epochs * c.source_size AS rest, s.key,
         sum(s.size) OVER (PARTITION BY s.sk ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN cut c USING (sk)),
ends AS (
  SELECT sk, max(key) AS cut_key FROM run WHERE rest > 0 AND upto - size / 2.0::DOUBLE <= rest GROUP BY sk)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * (r.full_epochs + CASE WHEN r.key <= e.cut_key THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(r.full_epochs + CASE WHEN r.key <= e.cut_key THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM run r LEFT JOIN ends e USING (sk)
"""
