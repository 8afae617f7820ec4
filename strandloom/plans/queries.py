"""Registered queries of the engine's own operators, and SQL with the same rows.

Documents stand for reads and their source for the sample. k-mer bins in these queries are integer sums, which
any engine computes alike; the complex hyperplanes are used by ``plans.pipeline``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kmer import mapper_windows as kmer_windows
from ..functions.kmer import canonical_bin, coefficients, hamming, mate_id, pair_key, partial_counts, read_base_id, reverse_complement, text_kmers, trimmed_length
from ..operators import abundance, chain, cluster, hyperplane, ingest, metric, pairs, partition, planted, reports, spectral, svd
from ..sources import fastq
from .stored import bucketed, stored

K, BITS = 8, 20
#: Spokes of the integer hyperplanes; their coefficients come from a linear congruential sequence.
SPOKES = 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# k-mer abundance ---------------------------------------------------------------------------------------------

_BIN = "(" + " + ".join(f"u[i+{j}]*{c}" for j, c in enumerate(coefficients(K, BITS))) + f") % {1 << BITS}"
_KMERS = f"""kmers AS (
  SELECT sample, doc_id, unnest(list_transform(range(1, len(u) - {K} + 2), lambda i: CAST({_BIN} AS BIGINT))) AS bin
  FROM (SELECT source AS sample, doc_id, list_transform(string_split(text, ''), lambda x: unicode(x)) AS u FROM documents))"""
_COUNTS = f"{_KMERS}, counts AS (SELECT sample, bin, CAST(least(count(*), 65535) AS BIGINT) AS cnt FROM kmers GROUP BY ALL)"
_WEIGHTS = (
    f"{_COUNTS}, weights AS (SELECT bin, count(*) AS df, log2(((SELECT count(DISTINCT sample) FROM counts) + 2) / (count(*) + 1)) AS gw"
    " FROM counts GROUP BY bin)"
)
_CONDITIONED = (
    f"{_WEIGHTS}, norms AS (SELECT sample, sqrt(sum(CAST(cnt AS DOUBLE) * cnt) / {1 << BITS}) AS norm FROM counts GROUP BY sample),"
    " conditioned AS (SELECT c.sample, c.bin, c.cnt * w.gw / n.norm AS x FROM counts c JOIN weights w USING (bin) JOIN norms n USING (sample))"
)


def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_counts(_t(spark, sf_dir, "documents"), "source", "text", K, BITS).withColumnRenamed("source", "sample")


def _bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abundance.saturated(_partial(spark, sf_dir))


def _kept_by_bin(partial: DataFrame) -> DataFrame:
    buckets = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(abundance.saturated_by_bin(partial, buckets), "counts", "bin", buckets, dealt=True)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, made once and kept in buckets by bin: weights, conditioned rows and products of bins need no exchange."""
    return _kept_by_bin(_partial(spark, sf_dir))


def _conditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    return bucketed(abundance.conditioned(counts, abundance.idf_weights(counts), BITS), "conditioned", "bin", dealt=True)


@query(f"WITH {_COUNTS} SELECT sample, bin, cnt FROM counts")
def kmer_bin_counts(spark, sf_dir):
    return _bin_counts(spark, sf_dir)


@query(f"WITH {_COUNTS} SELECT sample, count(*) AS n_bins, CAST(sum(cnt) AS BIGINT) AS n_kmers FROM counts GROUP BY sample")
def sample_kmer_summary(spark, sf_dir):
    return abundance.sample_summary(_counts(spark, sf_dir))


@query(f"WITH {_WEIGHTS} SELECT bin, df, round(gw, 9) AS gw FROM weights")
def idf_weights(spark, sf_dir):
    return abundance.idf_weights(_counts(spark, sf_dir)).withColumn("gw", F.round("gw", 9))


@query(
    f"WITH {_COUNTS}, n AS (SELECT count(DISTINCT sample) AS n FROM counts), p AS (SELECT bin, cnt / sum(cnt) OVER (PARTITION BY bin) AS p FROM counts)"
    " SELECT bin, round(1 + sum(p * ln(p)) / ln((SELECT n FROM n)), 6) + 0.0 AS gw FROM p GROUP BY bin"
)
def entropy_weights(spark, sf_dir):
    return abundance.entropy_weights(_counts(spark, sf_dir)).withColumn("gw", F.round("gw", 6) + F.lit(0.0))


@query(f"WITH {_CONDITIONED} SELECT sample, bin, round(x, 6) AS x FROM conditioned")
def conditioned_matrix(spark, sf_dir):
    return _conditioned(spark, sf_dir).withColumn("x", F.round("x", 6))


@query(f"WITH {_WEIGHTS} SELECT c.sample, c.bin, round(ln(c.cnt + 1) * w.gw, 6) AS x FROM counts c JOIN weights w USING (bin)")
def log_conditioned_matrix(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return abundance.log_conditioned(counts, abundance.idf_weights(counts)).withColumn("x", F.round("x", 6))


@query(f"WITH {_COUNTS} SELECT bin FROM counts GROUP BY bin HAVING sum(cnt) > 0 AND bin NOT IN (SELECT bin FROM counts WHERE sample = 'src0')")
def masked_bins(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return abundance.nonzero_bins(abundance.masked(counts, counts.where("sample = 'src0'").select("bin")))


@query(
    f"WITH {_COUNTS}, n AS (SELECT count(DISTINCT sample) AS n FROM counts), per_bin AS (SELECT bin, count(*) AS df FROM counts GROUP BY bin)"
    " SELECT df, count(*) AS n_bins, df <= (SELECT n FROM n) AS possible FROM per_bin GROUP BY df"
)
def frequency_spectrum(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    n = counts.select("sample").distinct().agg(F.count("*").alias("n"))
    spectrum = abundance.idf_weights(counts).groupBy("df").agg(F.count("*").alias("n_bins"))
    return spectrum.crossJoin(F.broadcast(n)).select("df", "n_bins", (F.col("df") <= F.col("n")).alias("possible"))


@query(
    f"WITH {_CONDITIONED} SELECT a.sample AS sample_i, b.sample AS sample_j, round(sum(a.x * b.x) / {1 << BITS}, 6) AS g"
    " FROM conditioned a JOIN conditioned b ON a.bin = b.bin AND a.sample <= b.sample GROUP BY ALL"
)
def gram_matrix(spark, sf_dir):
    return spectral.gram(_conditioned(spark, sf_dir)).withColumn("g", F.round(F.col("g") / (1 << BITS), 6))


@query()
def svd_spectrum(spark, sf_dir):
    _, _, s = spectral.eigenspace(spectral.gram(_conditioned(spark, sf_dir)))
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(s)], "dim int, sigma double")


_BASIS = 3


@query(
    f"WITH {_CONDITIONED}, numbered AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS i FROM (SELECT DISTINCT sample FROM conditioned))"
    " SELECT bin, " + ", ".join(f"round(sum(x * ((i + 1) * {d + 2} % 5 - 2)), 6) + 0.0 AS v{d}" for d in range(_BASIS)) + " FROM conditioned JOIN numbered USING (sample) GROUP BY bin"
)
def projected_bins(spark, sf_dir):
    """Bins in a fixed basis, which any engine has alike; the run takes the eigenspace's."""
    conditioned = _conditioned(spark, sf_dir)
    names = spectral.sample_names(conditioned)
    basis = np.array([[(i + 1) * (d + 2) % 5 - 2 for d in range(_BASIS)] for i in range(len(names))], dtype=float).reshape(len(names), _BASIS)
    vectors = spectral.projected(conditioned, names, basis)
    return vectors.select("bin", *[(F.round(F.col("vec")[d], 6) + F.lit(0.0)).alias(f"v{d}") for d in range(_BASIS)])


# strands and trimming ----------------------------------------------------------------------------------------

_PLANES = []
_state = 12345
for _ in range(SPOKES):
    _row = []
    for _ in range(2 * K + 1):
        _state = (_state * 1103515245 + 12345) % (1 << 31)
        _row.append((_state >> 16) % 19 - 9)
    _PLANES.append(_row)
_LETTERS, _TO_BASES = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]


def _plane_sum(re: Callable[[int], str], im: Callable[[int], str]) -> str:
    """Sum over spokes of 2**s where the product with plane s is over its offset."""
    terms = []
    for s, plane in enumerate(_PLANES):
        total = " + ".join(f"{re(j)}*({plane[2 * j]}) + {im(j)}*({plane[2 * j + 1]})" for j in range(K))
        terms.append(f"CASE WHEN {total} > {plane[-1]} THEN {1 << s} ELSE 0 END")
    return " + ".join(terms)


_STRAND_SQL = f"""
WITH dna AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_TO_BASES}') AS seq FROM documents),
codes AS (SELECT doc_id,
    list_transform(string_split(seq, ''), lambda x: CASE x WHEN 'A' THEN -1 WHEN 'T' THEN 1 ELSE 0 END) AS re,
    list_transform(string_split(seq, ''), lambda x: CASE x WHEN 'C' THEN -1 WHEN 'G' THEN 1 ELSE 0 END) AS im FROM dna),
places AS (SELECT doc_id, re, im, unnest(range(1, len(re) - {K} + 2)) AS i FROM codes),
both_strands AS (SELECT doc_id, i AS pos,
    {_plane_sum(lambda j: f"re[i+{j}]", lambda j: f"im[i+{j}]")} AS fwd,
    {_plane_sum(lambda j: f"-re[i+{K - 1 - j}]", lambda j: f"-im[i+{K - 1 - j}]")} AS back FROM places)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(fwd AS BIGINT) AS fwd, CAST(back AS BIGINT) AS back,
       CAST(CASE WHEN fwd % 1000000 <= back % 1000000 THEN fwd ELSE back END AS BIGINT) AS bin FROM both_strands
"""


@query(_STRAND_SQL)
def canonical_strand(spark, sf_dir):
    """Bins of all windows of all texts and of their reverse complements, with whole-number planes and bases that are all sure."""
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _LETTERS, _TO_BASES)
    # products are whole numbers times the certainty of a base: half a step over the offset leaves no ties to rounding
    wheels = [(0, s, plane[: 2 * K : 2], plane[1 : 2 * K : 2], (plane[-1] + 0.5) * hyperplane.SURE, 0.0) for s, plane in enumerate(_PLANES)]
    hashed = hyperplane.hash_reads(_t(spark, sf_dir, "documents").select("doc_id", seq.alias("seq")), wheels, K, strands=True)
    rows = hashed.select("doc_id", F.posexplode(F.arrays_zip("fwd", "back")).alias("at", "w"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), "w.fwd", "w.back", canonical_bin(F.col("w.fwd"), F.col("w.back")).alias("bin"))


#: What the qualities of the complex hash start from: letters from a to z are 2 to 27.
_LETTER_OFFSET = 95


def _complex_sum(sign: str, at: Callable[[int], int]) -> str:
    terms = []
    for s, plane in enumerate(_PLANES):
        total = " + ".join(f"re[i+{at(j)}]*({plane[2 * j] / 8}) + im[i+{at(j)}]*({plane[2 * j + 1] / 8})" for j in range(K))
        terms.append(f"CASE WHEN {sign}({total}) > {plane[-1] / 8} THEN {1 << s} ELSE 0 END")
    return " + ".join(terms)


@query(f"""
WITH letters AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), '') AS l FROM documents),
sure AS (SELECT doc_id, l, list_transform(l, lambda x: 1 - pow(10.0, -(unicode(x) - {_LETTER_OFFSET}) / 10.0)) AS p,
    list_transform(l, lambda x: translate(x, '{_LETTERS}', '{_TO_BASES}')) AS b FROM letters),
codes AS (SELECT doc_id,
    list_transform(range(1, len(l) + 1), lambda i: p[i] * CASE b[i] WHEN 'A' THEN -1 WHEN 'T' THEN 1 ELSE 0 END) AS re,
    list_transform(range(1, len(l) + 1), lambda i: p[i] * CASE b[i] WHEN 'C' THEN -1 WHEN 'G' THEN 1 ELSE 0 END) AS im FROM sure),
places AS (SELECT doc_id, re, im, unnest(range(1, len(re) - {K} + 2)) AS i FROM codes),
both_strands AS (SELECT doc_id, i, {_complex_sum("", lambda j: j)} AS fwd, {_complex_sum("-", lambda j: K - 1 - j)} AS back FROM places)
SELECT doc_id, CAST(i AS BIGINT) AS pos, CAST(least(fwd, back) AS BIGINT) AS bin FROM both_strands
""")
def complex_hash_bins(spark, sf_dir):
    """The run's own hash, with fixed planes: bases as complex numbers, weighed by the probability that they are right."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    reads = _t(spark, sf_dir, "documents").select("doc_id", F.translate(letters, _LETTERS, _TO_BASES).alias("seq"), letters.alias("qual"))
    wheels = [(0, s, [x / 8 for x in plane[: 2 * K : 2]], [x / 8 for x in plane[1 : 2 * K : 2]], plane[-1] / 8, 0.0) for s, plane in enumerate(_PLANES)]
    hashed = hyperplane.hash_reads(reads, wheels, K, _LETTER_OFFSET)
    return hashed.select("doc_id", F.posexplode("bins").alias("at", "bin")).select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), "bin")


@query(f"""
WITH letters AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM conversations),
l AS (SELECT conv_id, turn, string_split(t, '') AS l FROM letters WHERE length(t) >= {K}),
codes AS (SELECT conv_id, turn,
    list_transform(l, lambda x: (1 - pow(10.0, -(unicode(x) - {_LETTER_OFFSET}) / 10.0)) * CASE translate(x, '{_LETTERS}', '{_TO_BASES}') WHEN 'A' THEN -1 WHEN 'T' THEN 1 ELSE 0 END) AS re,
    list_transform(l, lambda x: (1 - pow(10.0, -(unicode(x) - {_LETTER_OFFSET}) / 10.0)) * CASE translate(x, '{_LETTERS}', '{_TO_BASES}') WHEN 'C' THEN -1 WHEN 'G' THEN 1 ELSE 0 END) AS im FROM l),
places AS (SELECT conv_id, turn, re, im, unnest(range(1, len(re) - {K} + 2)) AS i FROM codes),
both_strands AS (SELECT conv_id, turn, i, re, im, {_complex_sum("", lambda j: j)} AS fwd, {_complex_sum("-", lambda j: K - 1 - j)} AS back FROM places)
SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS at, CAST(CASE WHEN fwd < back THEN fwd ELSE back END AS BIGINT) AS bin,
       round(re[i], 9) + 0.0 AS first_re, round(im[i], 9) + 0.0 AS first_im, round(re[i + {K - 1}], 9) + 0.0 AS last_re, round(im[i + {K - 1}], 9) + 0.0 AS last_im FROM both_strands
""")
def mapper_hash_bins(spark, sf_dir):
    """Single k-mers as a streaming mapper hashes them, with their outer coordinates."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate(letters, _LETTERS, _TO_BASES).alias("s"), letters.alias("q")).where(F.length("q") >= K)
    kmers = rows.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.length("q") - K)).alias("at"), "s", "q")
    cut = lambda c: F.substring(c, F.col("at") + 1, F.lit(K))
    kmers = kmers.select("conv_id", "turn", F.col("at").cast("long").alias("at"), cut("s").alias("seq"), cut("q").alias("qual"))
    wheels = [(0, s, [x / 8 for x in plane[: 2 * K : 2]], [x / 8 for x in plane[1 : 2 * K : 2]], plane[-1] / 8, 0.0) for s, plane in enumerate(_PLANES)]
    hashed = hyperplane.mapper_bins(kmers, wheels, _LETTER_OFFSET, terminals=True)
    ends = [(F.round(F.col(end)[i], 9) + F.lit(0.0)).alias(f"{end}_{part}") for end in ("first", "last") for i, part in enumerate(("re", "im"))]
    return hashed.select("conv_id", "turn", "at", F.col("bins")[0].alias("bin"), *ends)


#: The quality offset at which the letter e has quality 2.
_MAPPER_OFFSET = 99


@query(f"""
WITH codes AS (SELECT doc_id, coalesce(length(text), 0) AS n, list_transform(string_split(coalesce(text, ''), ''), lambda x: unicode(x) - {_MAPPER_OFFSET}) AS q FROM documents),
bad AS (SELECT doc_id, greatest(n - {K - 1}, 0) AS every, list_filter(range(0, n), lambda i: q[i + 1] = 2) AS b FROM codes),
full_at AS (SELECT doc_id, every, list_min(list_transform(list_filter(range(3, len(b) + 1), lambda j: b[j] - b[j - 2] < {K}), lambda j: greatest(b[j] - {K - 1}, 0))) AS stop FROM bad)
SELECT doc_id, CAST(least(every, coalesce(stop, every)) AS BIGINT) AS n FROM full_at
""")
def mapper_windows(spark, sf_dir):
    """How many k-mers of each text a mapper takes before the first of low quality."""
    text = F.coalesce("text", F.lit(""))
    return _t(spark, sf_dir, "documents").select("doc_id", kmer_windows(text, text, K, q_offset=_MAPPER_OFFSET).cast("long").alias("n"))


_PER_FILE, _SAMPLE_SEED = 20, 1
_WORD = f"CAST({(1 << 64) - 1} AS UHUGEINT)"


def _mixed(x: str, shift: int, factor: int) -> str:
    """(x xor x >> shift) * factor modulo 2**64, of 64-bit numbers."""
    return f"((xor({x}, {x} >> {shift}) * CAST({factor} AS UHUGEINT)) & {_WORD})"


@query(f"""
WITH places AS (SELECT coalesce(source, '') AS sample, coalesce(lang, '') AS part, doc_id, text, unnest(range(0, length(text) - {K - 1})) AS place FROM documents WHERE length(text) >= {K}),
a AS (SELECT *, (CAST(doc_id AS UHUGEINT) * CAST({0x9E3779B97F4A7C15} AS UHUGEINT) + CAST(place + {_SAMPLE_SEED} AS UHUGEINT)) & {_WORD} AS x FROM places),
b AS (SELECT * EXCLUDE (x), {_mixed("x", 30, hyperplane._MIX[0])} AS x FROM a), c AS (SELECT * EXCLUDE (x), {_mixed("x", 27, hyperplane._MIX[1])} AS x FROM b),
d AS (SELECT *, xor(x, x >> 31) >> 1 AS rank FROM c)
SELECT sample, part, CAST(rank AS BIGINT) AS rank, substr(text, place + 1, {K}) AS seq FROM d QUALIFY row_number() OVER (PARTITION BY sample, part ORDER BY rank, doc_id, place) <= {_PER_FILE}
""")
def sampled_kmers(spark, sf_dir):
    """Of each file exactly so many k-mers, or all there are: those with the smallest hashes of record and place."""
    return hyperplane.bottom_kmers(_reads(spark, sf_dir), K, _PER_FILE, _SAMPLE_SEED).select("sample", "part", "rank", "seq")


@query("""
WITH dna AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)
SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc,
       CAST(list_sum(list_transform(list_zip(string_split(seq, ''), string_split(reverse(seq), '')), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS away FROM dna WHERE len(seq) > 0
""")
def reverse_complements(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    dna = docs.select("doc_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _LETTERS, _TO_BASES).alias("seq")).where("length(seq) > 0")
    return dna.select("doc_id", reverse_complement(F.col("seq")).alias("rc"), hamming(F.col("seq"), F.reverse("seq")).alias("away"))


@query(f"""
WITH codes AS (SELECT doc_id, length(text) AS n, list_transform(string_split(text, ''), lambda x: unicode(x) - 33) AS q FROM documents),
bad AS (SELECT doc_id, n, list_filter(range({K - 1}, n), lambda i: q[i + 1] < 3) AS b FROM codes)
SELECT doc_id, CAST(CASE WHEN len(b) >= 3 THEN b[3] + 1 ELSE n END AS BIGINT) AS kept FROM bad
""")
def quality_trim(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", trimmed_length(F.col("text"), K).cast("long").alias("kept"))


# clusters of vectors -----------------------------------------------------------------------------------------

_NEAR, _LOOSE = 0.1, 0.05
_CENTRES = """means AS (SELECT label AS cluster, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
cells AS (SELECT cluster, dim, avg(v) AS v FROM means GROUP BY ALL),
centres AS (SELECT cluster, list(v ORDER BY dim) AS c FROM cells GROUP BY cluster),
sizes AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label)"""
_DIST = "1 - list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
_MEMBERS = f"""{_CENTRES}, dists AS (
  SELECT vec_id AS bin, cluster, {_DIST.format(a="list_transform(embedding, lambda x: x::DOUBLE)", b="c")} AS dist FROM embeddings, centres),
members AS (SELECT bin, cluster, CAST(row_number() OVER (PARTITION BY bin ORDER BY dist, cluster) AS INTEGER) AS rank, dist FROM dists
            WHERE dist < 1 - {_NEAR} QUALIFY rank <= 5)"""
_VEC_WEIGHTS = "vec_weights AS (SELECT vec_id AS bin, log2(2 + vec_id % 10) AS gw FROM embeddings)"


def _vectors(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("bin"), F.col("embedding").alias("vec"), F.col("label").alias("cluster"))


def _centres(vectors: DataFrame) -> DataFrame:
    cells = vectors.select("cluster", F.posexplode("vec").alias("dim", "v")).groupBy("cluster", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    c = cells.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("dim", "v")))["v"].alias("c"))
    return c.join(vectors.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")


def _members(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return cluster.assign_nearest(vectors, stored(_centres(vectors), "centres"), _NEAR)


def _vec_weights(spark, sf_dir):
    return _vectors(spark, sf_dir).select("bin", F.log2(2 + F.col("bin") % 10).alias("gw"))


@query(f"WITH {_MEMBERS} SELECT bin, cluster, rank, round(dist, 6) AS dist FROM members")
def cosine_top5_assign(spark, sf_dir):
    return _members(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query(
    f"WITH {_CENTRES}, full_centres AS (SELECT * FROM centres JOIN sizes USING (cluster)),"
    f" near_pairs AS (SELECT a.cluster AS i, b.cluster AS j, {_DIST.format(a='a.c', b='b.c')} AS dist, CASE WHEN a.n < b.n THEN a.cluster ELSE b.cluster END AS loser"
    f" FROM full_centres a JOIN full_centres b ON a.cluster < b.cluster)"
    f" SELECT i, j, round(dist, 6) AS dist, loser FROM near_pairs WHERE dist < 1 - {_LOOSE}"
)
def centroid_collapse_pairs(spark, sf_dir):
    return cluster.near_pairs(_centres(_vectors(spark, sf_dir)), _LOOSE).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_MEMBERS} SELECT bin, array_to_string(list_sort(list(cluster)), ',') AS clusters FROM members GROUP BY bin")
def cluster_inversion(spark, sf_dir):
    return cluster.inverted(_members(spark, sf_dir)).withColumn("clusters", F.array_join(F.col("clusters").cast("array<string>"), ","))


@query(
    f"WITH {_MEMBERS}, {_VEC_WEIGHTS}, total AS (SELECT sum(gw) + ({1 << BITS}::DOUBLE - count(*)) * log2(22) AS total FROM vec_weights)"
    " SELECT cluster, count(*) AS size, round(sum(gw) / (SELECT total FROM total), 12) AS prob FROM members JOIN vec_weights USING (bin) GROUP BY cluster"
)
def cluster_priors(spark, sf_dir):
    found = cluster.cluster_priors(_members(spark, sf_dir), _vec_weights(spark, sf_dir), 20, BITS)
    return found.withColumn("prob", F.round("prob", 12))


@query()
def leader_clusters(spark, sf_dir):
    return cluster.leader_clusters(_vectors(spark, sf_dir), 0.3).select("cluster", "n", "c")


@query(f"WITH {_MEMBERS} SELECT bin, cluster, rank, round(dist, 6) AS dist FROM members")
def metric_top5_assign(spark, sf_dir):
    """cosine_top5_assign without a broadcast of the centroids: a metric join by angles to a few pivots."""
    vectors = _vectors(spark, sf_dir)
    found = metric.near(vectors, "bin", stored(_centres(vectors), "centres"), 1 - _NEAR, cluster.NEAREST, pivots=4, block=3)
    return found.select("bin", "cluster", "rank", F.round("dist", 6).alias("dist"))


@query()
def recentred_clusters(spark, sf_dir):
    """Bins of clusters found by repeated assignment to means, with up to five fits in the last round."""
    return cluster.recentred(_vectors(spark, sf_dir), 0.3)[1].select("bin", "cluster", "rank", F.round("dist", 9).alias("dist"))


@query()
def truncated_svd_spectrum(spark, sf_dir):
    """Leading singular values over samples of source and language, by distributed products, and the share of all squares up to each."""
    docs = _t(spark, sf_dir, "documents").select(F.concat_ws("|", "source", "lang").alias("source"), "text")
    counts = _kept_by_bin(partial_counts(docs, "source", "text", K, BITS).withColumnRenamed("source", "sample"))
    found = svd.decompose(stored(abundance.conditioned(counts, abundance.idf_weights(counts), BITS), "conditioned"), rank=10, tolerance=1e-9)
    share = np.cumsum(found.sigma**2) / max(found.energy, 1e-300)
    return spark.createDataFrame([(i, round(float(x), 4), round(float(y), 6)) for i, (x, y) in enumerate(zip(found.sigma, share))], "dim int, sigma double, share double")


# reads to clusters -------------------------------------------------------------------------------------------
# A bin belongs to the cluster of the sample that has more than half of it; clusters are numbered by sample name.

_READ_SQL = f"""{_WEIGHTS},
numbered AS (SELECT sample, CAST(row_number() OVER (ORDER BY sample) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT sample FROM counts)),
owned AS (SELECT bin, sample FROM (SELECT bin, sample, cnt, sum(cnt) OVER (PARTITION BY bin) AS t FROM counts) WHERE cnt * 2 > t),
bin_members AS (SELECT bin, cluster FROM owned JOIN numbered USING (sample)),
stats AS (SELECT cluster, count(*) AS size,
          sum(gw) / ((SELECT sum(gw) + ({1 << BITS}::DOUBLE - count(*)) * log2((SELECT count(*) FROM numbered) + 2) FROM weights)) AS prob
          FROM bin_members JOIN weights USING (bin) GROUP BY cluster),
read_kmers AS (SELECT doc_id AS read, bin, count(*) AS n FROM kmers GROUP BY ALL)"""
_RATIO = (
    "ln(sqrt(m * prob * (1 - prob)) / sqrt(m * 0.8 * (1 - 0.8))) + 0.5 * (pow(s - m * prob, 2) / (m * prob * (1 - prob)) - pow(s - m * 0.8, 2) / (m * 0.8 * (1 - 0.8)))"
)
_BEST = f"""{_READ_SQL},
per_cluster AS (SELECT read, cluster, sum(n * gw) AS s FROM read_kmers JOIN bin_members USING (bin) JOIN weights USING (bin) GROUP BY ALL),
evidence AS (SELECT read, cluster, s, sum(s) OVER (PARTITION BY read) AS m FROM per_cluster),
rated AS (SELECT read, cluster, {_RATIO} AS llr FROM evidence JOIN stats USING (cluster) WHERE s > m * prob),
best AS (SELECT read, cluster, llr FROM rated WHERE llr > 3.84 QUALIFY row_number() OVER (PARTITION BY read ORDER BY llr DESC, cluster DESC) = 1)"""
_OLDER = f"""{_READ_SQL},
totals AS (SELECT read, sum(n * gw) AS m FROM read_kmers JOIN weights USING (bin) GROUP BY read),
parts AS (SELECT read, cluster, sum(gw) AS s FROM read_kmers JOIN bin_members USING (bin) JOIN weights USING (bin) GROUP BY ALL),
found AS (SELECT read, cluster, {_RATIO} AS llr FROM parts JOIN totals USING (read) JOIN stats USING (cluster)
          WHERE s > m * prob AND size < 0.2 * {1 << BITS} AND prob > 0.00002)"""


def _read_tables(spark, sf_dir, keep=stored):
    """(texts of reads, bin table, priors). One sum by bin gives both a bin's weight and its owner."""
    counts = _counts(spark, sf_dir)
    names = sorted(r[0] for r in counts.select("sample").distinct().collect())
    numbers = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else F.lit(None).cast("map<string,int>")
    # the owner has more than half: no tie, and no window over a bin's samples
    seen = counts.groupBy("bin").agg(F.count("*").alias("df"), F.max(F.struct("cnt", "sample")).alias("top"), F.sum("cnt").alias("t"))
    owner = F.when(F.col("top.cnt") * 2 > F.col("t"), F.array(numbers[F.col("top.sample")]))
    bins = keep(seen.select("bin", abundance.idf(F.lit(len(names)), F.col("df")).alias("gw"), owner.alias("clusters")), "bins")
    reads = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("read"), "text")
    return reads, bins, stored(partition.table_priors(bins, len(names), BITS), "stats")


def _best(spark, sf_dir):
    reads, bins, stats = _read_tables(spark, sf_dir)
    return partition.best_cluster(partition.text_evidence(reads, K, BITS, bins), stats)


def _memberships(spark, sf_dir):
    reads, bins, stats = _read_tables(spark, sf_dir)
    return partition.rated_memberships(partition.text_evidence(reads, K, BITS, bins, True), stats, BITS)


def _by_bin(df: DataFrame, label: str) -> DataFrame:
    return bucketed(df, label, "bin")


@query(f"WITH {_BEST} SELECT read, cluster, round(llr, 2) AS llr FROM best")
def bucketed_llr_partition(spark, sf_dir):
    """read_llr_partition as for a bin table too large for all tasks: kept in buckets, met by a join."""
    reads, bins, stats = _read_tables(spark, sf_dir, _by_bin)
    return partition.best_cluster(partition.text_evidence(reads, K, BITS, bins, lookup_bytes=0), stats).withColumn("llr", F.round("llr", 2))


@query(f"WITH {_BEST} SELECT read, cluster, round(llr, 2) AS llr FROM best")
def read_llr_partition(spark, sf_dir):
    return _best(spark, sf_dir).withColumn("llr", F.round("llr", 2))


@query(f"WITH {_OLDER} SELECT read, cluster, round(llr, 2) AS llr FROM found WHERE llr > 3.84")
def membership_all(spark, sf_dir):
    return _memberships(spark, sf_dir).withColumn("llr", F.round("llr", 2))


@query(
    f"WITH {_OLDER} SELECT read, cluster, round(llr, 2) AS llr FROM found WHERE llr > 3.84"
    " QUALIFY row_number() OVER (PARTITION BY read ORDER BY llr DESC, CAST(cluster AS VARCHAR) DESC) = 1"
)
def membership_best(spark, sf_dir):
    return partition.best_membership(_memberships(spark, sf_dir)).withColumn("llr", F.round("llr", 2))


@query(
    f"WITH {_BEST}, marked AS (SELECT b.cluster, coalesce(l.toxic, 0) = 1 AS spike FROM best b LEFT JOIN labels l ON l.doc_id = b.read)"
    " SELECT cluster, count(*) FILTER (spike) AS spiked, count(*) AS total, CAST(floor(count(*) FILTER (spike) * 100 / count(*)) AS BIGINT) AS pct"
    " FROM marked GROUP BY cluster ORDER BY spiked DESC, cluster LIMIT 5"
)
def spike_enrichment_top5(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("read"), "toxic")
    return partition.spike_report(_best(spark, sf_dir).join(labels, "read", "left"), F.coalesce(F.col("toxic"), F.lit(0)) == 1)


_STRETCH = planted.STRETCH
_PLANTED = f"""pieces AS (SELECT DISTINCT item_id, substr(text, i, {_STRETCH}) AS piece FROM (SELECT item_id, text, unnest(range(1, length(text) - {_STRETCH} + 2)) AS i FROM benchmark)),
stretches AS (SELECT DISTINCT doc_id, substr(text, i, {_STRETCH}) AS piece FROM (SELECT doc_id, text, unnest(range(1, length(text) - {_STRETCH} + 2)) AS i FROM documents)),
planted AS (SELECT DISTINCT doc_id, item_id FROM stretches JOIN pieces USING (piece))"""


def _planted(spark, sf_dir):
    return planted.planted(_t(spark, sf_dir, "documents"), "doc_id", _t(spark, sf_dir, "benchmark"), "item_id")


@query(f"WITH {_PLANTED} SELECT doc_id, item_id FROM planted")
def planted_passages(spark, sf_dir):
    """Benchmark passages that stand in documents, by minimisers; the SQL compares all stretches of that many characters."""
    return _planted(spark, sf_dir).select("doc_id", "item_id")


@query(
    f"WITH {_BEST}, {_PLANTED}, marked AS (SELECT b.cluster, b.read IN (SELECT doc_id FROM planted) AS spike FROM best b)"
    " SELECT cluster, count(*) FILTER (spike) AS spiked, count(*) AS total, CAST(floor(count(*) FILTER (spike) * 100 / count(*)) AS BIGINT) AS pct"
    " FROM marked GROUP BY cluster ORDER BY spiked DESC, cluster LIMIT 5"
)
def planted_enrichment_top5(spark, sf_dir):
    """Clusters with the most reads that hold a planted passage."""
    marks = _planted(spark, sf_dir).select(F.col("doc_id").alias("read")).distinct().withColumn("spike", F.lit(True))
    return partition.spike_report(_best(spark, sf_dir).join(marks, "read", "left"), F.coalesce("spike", F.lit(False)))


# pairs -------------------------------------------------------------------------------------------------------

_MATES = "mates AS (SELECT conv_id, turn, CAST(turn % 2 + 1 AS INTEGER) AS mate, text FROM conversations)"


def _mates(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 2 + 1).cast("int").alias("mate"), "text")


@query(
    "SELECT conv_id, turn, coalesce(lag(conv_id) OVER w = conv_id, false) OR coalesce(lead(conv_id) OVER w = conv_id, false) AS paired"
    " FROM conversations WINDOW w AS (PARTITION BY role ORDER BY conv_id * 1000 + turn)"
)
def mate_pairing(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    return pairs.neighbours_paired(rows, ["role"], "at", "conv_id").select("conv_id", "turn", "paired")


@query(
    f"WITH {_MATES} SELECT conv_id, CASE WHEN count(*) FILTER (mate = 1) > 0 AND count(*) FILTER (mate = 2) > 0 THEN 'pair' ELSE 'single' END AS kind,"
    " count(*) FILTER (mate = 1) AS n1, count(*) FILTER (mate = 2) AS n2 FROM mates GROUP BY conv_id"
)
def mate_split(spark, sf_dir):
    return pairs.split_mates(_mates(spark, sf_dir), "conv_id", "mate")


@query(
    f"WITH {_MATES}, both_in AS (SELECT conv_id FROM mates GROUP BY conv_id HAVING count(DISTINCT mate) = 2) SELECT conv_id, turn, mate FROM mates WHERE conv_id IN (SELECT conv_id FROM both_in)"
)
def mate_repair(spark, sf_dir):
    rows = _mates(spark, sf_dir).select("conv_id", "turn", "mate")
    return pairs.repaired(rows.where("mate = 1"), rows.where("mate = 2"), "conv_id")


@query(
    f"WITH {_MATES}, both_in AS (SELECT conv_id FROM mates GROUP BY conv_id HAVING count(DISTINCT mate) = 2),"
    " c AS (SELECT count(*) FILTER (mate = 1) AS n1, count(*) FILTER (mate = 2) AS n2, count(*) FILTER (mate = 1 AND conv_id IN (SELECT conv_id FROM both_in)) AS kept1,"
    " count(*) FILTER (mate = 2 AND conv_id IN (SELECT conv_id FROM both_in)) AS kept2 FROM mates)"
    " SELECT *, kept1 > 0.9 * n1 AND kept2 > 0.9 * n2 AS accepted FROM c"
)
def mate_repair_ratio(spark, sf_dir):
    rows = _mates(spark, sf_dir)
    return pairs.repair_ratio(rows.where("mate = 1"), rows.where("mate = 2"), "conv_id")


@query(f"WITH {_MATES} SELECT conv_id, turn, mate FROM mates ORDER BY conv_id, mate, turn")
def interleave(spark, sf_dir):
    rows = _mates(spark, sf_dir).select("conv_id", "turn", "mate")
    return pairs.interleaved(rows.where("mate = 1").drop("mate"), rows.where("mate = 2").drop("mate"), "conv_id")


@query(
    "SELECT conv_id, turn, '@c' || conv_id || '/' || (turn % 2 + 1) AS base_id, '@c' || conv_id || '/' AS pair, '@c' || conv_id || '/' || (2 - turn % 2) AS mate,"
    " '@c' || conv_id AS lone FROM conversations"
)
def read_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("@c"), F.col("conv_id"), F.lit("/"), F.col("turn") % 2 + 1, F.lit(" length="), F.length("text"))
    base = read_base_id(raw, 2)
    return rows.select("conv_id", "turn", base.alias("base_id"), pair_key(base).alias("pair"), mate_id(base).alias("mate"), F.substring_index(base, "/", 1).alias("lone"))


_COLLISION_BITS = 16


@query(f"""
WITH texts AS (SELECT text, list_transform(string_split(text, ''), lambda x: unicode(x)) AS u FROM documents),
places AS (SELECT text, u, unnest(range(1, len(u) - {K} + 2)) AS i FROM texts),
km AS MATERIALIZED (SELECT {_BIN.replace(str(1 << BITS), str(1 << _COLLISION_BITS))} AS bin, substr(text, i, {K}) AS kmer, count(*) AS n FROM places GROUP BY ALL),
p AS (SELECT 0 AS distance, CAST(n * (n - 1) // 2 AS BIGINT) AS p FROM km UNION ALL
      SELECT least(CAST(list_sum(list_transform(range(1, {K + 1}), lambda j: CASE WHEN a.kmer[j] <> b.kmer[j] THEN 1 ELSE 0 END)) AS INTEGER), {K - 1}), CAST(a.n * b.n AS BIGINT)
      FROM km a JOIN km b ON a.bin = b.bin AND a.kmer < b.kmer)
SELECT CAST(distance AS INTEGER) AS distance, CAST(sum(p) AS BIGINT) AS n_pairs FROM p GROUP BY distance HAVING sum(p) > 0
""")
def collision_histogram(spark, sf_dir):
    """Pairs of k-mers of all documents by distance."""
    rows = text_kmers(_t(spark, sf_dir, "documents"), "text", K, _COLLISION_BITS)
    return pairs.collision_histogram(rows.groupBy("bin", "kmer").agg(F.sum("n").alias("n")), K)


def _reads(spark, sf_dir) -> DataFrame:
    """Documents as reads of files (source, lang)."""
    docs = _t(spark, sf_dir, "documents")
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(
        name("source").alias("sample"), name("lang").alias("part"), F.col("doc_id").alias("rec_no"), F.concat(F.lit("@d"), F.col("doc_id")).alias("id"),
        name("text").alias("seq"), F.lit("+").alias("plus"), name("text").alias("qual"),
    )


_READS = "SELECT coalesce(source, '') AS sample, coalesce(lang, '') AS part, doc_id AS rec_no, '@d' || doc_id AS id, coalesce(text, '') AS seq, '+' AS plus, coalesce(text, '') AS qual FROM documents"


@query("""
WITH kept AS (SELECT conv_id, len(list_filter(string_split(text, ''), lambda x: x <> '')) AS n, list_sum(list_transform(string_split(text, ''), lambda x: unicode(x))) AS b FROM conversations WHERE text <> '')
SELECT c.conv_id, c.turn, CAST(sum(k.n) AS BIGINT) AS n_bins, CAST(sum(k.b) AS BIGINT) AS bin_sum FROM conversations c JOIN kept k USING (conv_id) GROUP BY ALL
""")
def paired_bins(spark, sf_dir):
    """Characters stand for bins; each turn of a conversation carries those of all its turns."""
    rows = _t(spark, sf_dir, "conversations").select(
        F.lit("all").alias("sample"), F.lit("").alias("part"), F.col("turn").alias("rec_no"), "conv_id", "turn",
        F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long")).alias("bins"),
    )
    both = hyperplane.paired_bins(rows, "conv_id").where(F.size("bins") > 0)
    return both.select("conv_id", "turn", F.size("bins").cast("long").alias("n_bins"), F.aggregate("bins", F.lit(0).cast("long"), lambda s, x: s + x).alias("bin_sum"))


@query("""
WITH c AS (SELECT conv_id, turn, '@c' || conv_id || '/' AS stem, turn % 2 + 1 AS mate, length(text) AS n FROM conversations),
both_ids AS (SELECT stem || mate AS id, n, turn FROM c UNION ALL SELECT stem || (3 - mate), n, turn FROM c)
SELECT id, CAST(n AS BIGINT) AS bin FROM both_ids UNION ALL SELECT id, CAST(turn AS BIGINT) FROM both_ids
""")
def mapper_rows(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations")
    hashed = rows.withColumn("bins", F.array(F.length("text").cast("long"), F.col("turn").cast("long")))
    return ingest.mapper_rows(hashed, F.concat(F.lit("@c"), F.col("conv_id"), F.lit("/"), F.col("turn") % 2 + 1))


@query("""
WITH n AS (SELECT conv_id, turn, (conv_id * 100 + turn // 2) * 2 + turn % 2 AS rec_no FROM conversations)
SELECT conv_id, turn, rec_no, CASE WHEN rec_no >= 1000000 THEN CAST(rec_no // 1000 AS VARCHAR) ELSE lpad(CAST(rec_no // 1000 AS VARCHAR), 3, '0') END AS part FROM n
""")
def interleave_chunks(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.floor(F.col("turn") / 2)).alias("rec_no"))
    return ingest.interleave_chunks(rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1"), chunk_reads=1000)


@query(f"""
WITH reads AS ({_READS}), sized AS (SELECT *, length(id) + length(seq) + length(plus) + length(qual) + 4 AS size FROM reads),
run AS (SELECT *, sum(size) OVER (PARTITION BY sample ORDER BY rec_no) - size AS above FROM sized)
SELECT sample, rec_no, lpad(CAST(CAST(floor(above / 50000) AS BIGINT) AS VARCHAR), 3, '0') AS part FROM run
""")
def byte_chunks(spark, sf_dir):
    return ingest.byte_chunks(_reads(spark, sf_dir), megabytes=0.05).select("sample", "rec_no", "part")


@query(f"WITH reads AS ({_READS}) SELECT sample, part, rec_no FROM reads QUALIFY count(*) OVER (PARTITION BY sample, part) >= 12")
def large_files(spark, sf_dir):
    return partition.large_files(_reads(spark, sf_dir), 12).select("sample", "part", "rec_no")


@query(f"""
WITH reads AS ({_READS}), firsts AS (SELECT * FROM reads QUALIFY row_number() OVER (PARTITION BY sample, part ORDER BY rec_no) <= 1000),
seen AS (SELECT sample, part, length(qual) AS n, len(list_filter(string_split(qual, ''), lambda x: unicode(x) < 74)) AS low FROM firsts WHERE qual <> '')
SELECT sample, part, CAST(CASE WHEN sum(low) * 3 > sum(n - low) THEN 33 ELSE 64 END AS INTEGER) AS q_offset FROM seen GROUP BY ALL
""")
def quality_offsets(spark, sf_dir):
    """The first thousand records of each file tell its offset: that is the feature, as everywhere its first reads do."""
    nth = F.row_number().over(Window.partitionBy("sample", "part").orderBy("rec_no"))
    firsts = _reads(spark, sf_dir).withColumn("nth", nth).where("nth <= 1000")
    return fastq.quality_offset(firsts.withColumn("rec_no", F.col("nth") - 1).where("qual <> ''"))


@query("""
WITH t AS (SELECT conv_id, turn, conv_id % 3 AS kind, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations WHERE turn < 125)
SELECT 's' || kind AS sample, CAST(conv_id AS VARCHAR) AS part, CAST(CASE WHEN bool_or(turn % 2 = 0 AND coalesce(after % 2 = 1, false)) THEN kind ELSE 0 END AS INTEGER) AS id_type FROM t GROUP BY conv_id, kind
""")
def id_types(spark, sf_dir):
    """Each conversation is a file, named in one of three ways."""
    kind, mate = F.col("conv_id") % 3, F.col("turn") % 2 + 1
    stem = F.concat(F.lit("@c"), F.col("conv_id"))
    name = F.when(kind == 1, F.concat(stem, F.lit(" "), mate, F.lit(":N:0"))).when(kind == 2, F.concat(stem, F.lit("/"), mate)).otherwise(F.concat(stem, F.lit("x"), F.col("turn")))
    rows = _t(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), kind).alias("sample"), F.col("conv_id").cast("string").alias("part"), F.col("turn").alias("rec_no"), name.alias("id"))
    return fastq.id_types(rows)


# reports -----------------------------------------------------------------------------------------------------


@query("""
WITH run AS (SELECT source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC RANGE UNBOUNDED PRECEDING) AS run, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, count(*) AS n, CAST(max(total) AS BIGINT) AS total, max(n_chars) AS longest, max(n_chars) FILTER (run > total // 2) AS n50 FROM run GROUP BY source
""")
def n50_by_group(spark, sf_dir):
    return reports.n50(_t(spark, sf_dir, "documents"), "source", "n_chars")


@query("""
WITH hits AS (SELECT l_returnflag AS path, l_linenumber AS block, l_suppkey AS sseqid, l_partkey % 10 AS qseqid, min(l_extendedprice) AS first FROM lineitem GROUP BY ALL)
SELECT path, sseqid, CAST(sum(CAST(floor(first) AS BIGINT) % 1000) AS BIGINT) AS score FROM hits GROUP BY path, sseqid
""")
def alignment_scores(spark, sf_dir):
    """Line items as hits: the cheapest one of a range stands first, and its score alone counts."""
    hits = _t(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("block"), F.col("l_suppkey").alias("sseqid"), (F.col("l_partkey") % 10).alias("qseqid"),
        F.lit(0).alias("qstart"), F.lit(0).alias("qend"), F.col("l_extendedprice").alias("line_no"), (F.floor("l_extendedprice") % 1000).alias("score"),
    )
    return reports.alignment_scores(hits)


@query("""
WITH ranked AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) AS lo, max(value) AS hi, max(value) FILTER (r = n // 2 + 1) AS mid FROM ranked GROUP BY event_type
""")
def log_min_max_median(spark, sf_dir):
    return reports.spread(_t(spark, sf_dir, "events"), "event_type", "value")


@query(
    "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), langs AS (SELECT lang, count(*) AS t FROM documents WHERE lang IS NOT NULL GROUP BY lang)"
    " SELECT s.source, array_to_string(list(l.lang || '=' || coalesce(n.n, 0) ORDER BY l.t DESC, l.lang), ',') AS by_abundance"
    " FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN langs l LEFT JOIN n ON n.source IS NOT DISTINCT FROM s.source AND n.lang = l.lang GROUP BY s.source"
)
def abundance_pivot(spark, sf_dir):
    """A pivot's columns are whatever languages there are, by descending total; one text column holds them here, as SQL names its columns beforehand."""
    docs = _t(spark, sf_dir, "documents")
    names = reports.by_abundance(docs.where("lang is not null"), "lang")
    wide = reports.pivot_counts(docs, "source", "lang", names)
    return wide.select("source", F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(f"`{n}`")) for n in names]).alias("by_abundance"))


@query("SELECT lang, count(*) AS count, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY lang")
def normalised_profile(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").withColumn("all", F.lit(0)).withColumn("one", F.lit(1))
    shares = reports.share_of_group(rows, ["all"], "lang", "one")
    return shares.select("lang", F.col("total").alias("count"), F.round(F.col("share") * 100, 6).alias("pct"))


@query(
    "SELECT source, lang, count(*) AS n, CAST(row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS INTEGER) AS rank FROM documents GROUP BY source, lang"
    " QUALIFY rank = 1"
)
def first_name_per_partition(spark, sf_dir):
    n = _t(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return reports.top_per_group(n, "source", [F.desc("n"), F.col("lang")], 1)


@query("SELECT split_part(c.c_name, '#', 1) AS lib, c.c_custkey, coalesce(o.n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def library_report(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").withColumn("id", F.concat(F.lit("@"), F.translate("c_name", "#", ".")))
    orders = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return reports.left_report(pairs.split_libraries(rows), (orders, "c_custkey", {"n": 0})).select("lib", "c_custkey", "n")


@query("""
WITH sums AS (SELECT l_returnflag, split_part(p_name, ' ', 1) AS name, sum(l_quantity) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
shares AS (SELECT *, total / sum(total) OVER (PARTITION BY l_returnflag) AS share FROM sums)
SELECT l_returnflag, name, round(total, 2) AS total, round(share, 9) AS share, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY round(total, 2) DESC, name) AS INTEGER) AS rank
FROM shares QUALIFY rank <= 10
""")
def name_share_top(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("name")), F.col("l_partkey") == F.col("p_partkey"))
    shares = reports.share_of_group(rows, ["l_returnflag"], "name", "l_quantity").withColumn("total", F.round("total", 2)).withColumn("share", F.round("share", 9))
    return reports.top_per_group(shares, "l_returnflag", [F.desc("total"), F.col("name")], 10)


@query("""
SELECT s.s_suppkey, s.s_name, coalesce(n.n_name, '') AS nation, coalesce(l.n_items, 0) AS n_items, coalesce(l.quantity, 0) AS quantity
FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
LEFT JOIN (SELECT l_suppkey, count(*) AS n_items, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey) l ON l.l_suppkey = s.s_suppkey
""")
def partition_report(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_items"), F.sum("l_quantity").alias("quantity"))
    nations = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    base = _t(spark, sf_dir, "supplier")
    out = reports.left_report(base, (nations, "s_nationkey", {"nation": ""}), (items, "s_suppkey", {"n_items": 0, "quantity": 0.0}))
    return out.select("s_suppkey", "s_name", "nation", "n_items", "quantity")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def unprocessed_anti(spark, sf_dir):
    done = _t(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return reports.unprocessed(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query("""
WITH RECURSIVE spans AS (SELECT source AS sample, CAST(avg(n_chars) AS DOUBLE) AS lo, CAST(avg(n_chars) + 150 AS DOUBLE) AS hi FROM documents GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY lo, hi, sample) AS r FROM spans),
walk AS (SELECT r, sample, 0 AS lib, hi AS edge FROM o WHERE r = 1 UNION ALL
         SELECT o.r, o.sample, CASE WHEN o.lo > w.edge THEN w.lib + 1 ELSE w.lib END, CASE WHEN o.lo > w.edge THEN o.hi ELSE w.edge END FROM walk w JOIN o ON o.r = w.r + 1)
SELECT CAST(lib AS INTEGER) AS lib, sample FROM walk
""")
def library_grouping(spark, sf_dir):
    mean = F.avg("n_chars")
    return chain.windows(_t(spark, sf_dir, "documents").groupBy(F.col("source").alias("sample")).agg(mean.alias("lo"), (mean + 150).alias("hi")))
