"""Merkle manifest of a dataset in an external-memory node store.

Leaves are hashed where their documents lie, and sorted by group and id into runs (level 0 of the store, Parquet); counts of
the runs give every leaf its coordinate: group and place. A level is a folder of its own. It reads the one below in order:
eight consecutive nodes, of which a batch nearly always has all, become one row with its children; only groups that an
Arrow batch cuts are put together by a shuffle. Proofs come from the top: rows of a level meet their own paths by
coordinate, and every child's path is its parent's with the siblings before it, so no path is longer than the tree is high
and no node is read twice in a level. The groups' roots are the leaves of a second tree, built by the same steps.

Digests are lowercase hex and a node is the SHA-256 of its children's hex text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import new_path, table

#: Consecutive nodes that become one.
WIDTH = 8
#: The columns of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One document in so many is tampered with.
TAMPER_EVERY = 3
#: Consecutive nodes of a level above the leaves that are dealt together.
TILE = 64
#: Runs are so many leaves at least, and offsets of up to so many runs are broadcast.
RUN_ROWS = 1_000_000
BROADCAST_OFFSETS = 50_000

_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """A document's leaf with the given text."""
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(f"`{c}`")) for c in FIELDS]), 256)


def _group(lang: Column) -> Column:
    """Groups as text that is never null and sorts bytewise, null first."""
    return F.when(lang.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), lang))


class Store:
    """A forest of trees, one for each group, as level-partitioned Parquet.

    Level 0 has the leaves (grp, pos, n, digest and what else they carry), level i > 0 nodes (grp, pos, n, digest, members:
    the nodes below with all their columns). pos counts from 0 in a group, n is the group's number of nodes in that level.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.schemas = spark, new_path(spark, label), []

    def level(self, i: int) -> DataFrame:
        return self.spark.read.schema(self.schemas[i]).parquet(f"{self.path}/level={i}")

    @property
    def height(self) -> int:
        return len(self.schemas) - 1

    def append(self, rows: DataFrame) -> None:
        rows.write.option("compression", "zstd").parquet(f"{self.path}/level={len(self.schemas)}")
        self.schemas.append(rows.schema)

    def subroots(self) -> DataFrame:
        """(grp, digest) of every group."""
        tops = [self.level(i).where("n = 1").select("grp", "digest") for i in range(self.height + 1)]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with pos and n: sorted into runs by group and order, then numbered by the runs' counts."""
    spark = leaves.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = max(least, -(-leaves.count() // RUN_ROWS))
    keys = [F.asc(c) for c in ("grp", *order)]
    ordered = leaves.repartitionByRange(runs, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = table(ordered, "manifest-runs").withColumn("run", F.shiftright("at", 33))
    counts = ordered.groupBy("grp", "run").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")
    above = F.coalesce(F.sum("k").over(group.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("grp", "run", (above - F.col("first")).alias("shift"), F.sum("k").over(group).alias("n"))
    offsets = table(offsets, "manifest-offsets")
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    numbered = ordered.join(offsets, ["grp", "run"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "run", "shift")
    return numbered.sortWithinPartitions("grp", "pos")


def _gathered(nodes: DataFrame) -> DataFrame:
    """(grp, pos, n, members) of the level above: WIDTH consecutive nodes each, of groups with more than one.

    A kernel takes together what a batch has whole; groups that it has in part meet in a shuffle.
    """
    names = nodes.columns
    at = {c: i for i, c in enumerate(names)}
    node = ", ".join(f"`{n}`: {t}" for n, t in nodes.dtypes)
    kind = dict(nodes.dtypes)
    list_of = f"array<struct<{node}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, n = batch.column(at["pos"]).to_numpy(), batch.column(at["n"]).to_numpy()
            grp = batch.column(at["grp"])
            new = np.ones(len(pos), dtype=bool)
            same = pc.equal(grp.slice(1), grp.slice(0, len(pos) - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same | (pos[1:] // WIDTH != pos[:-1] // WIDTH) | (pos[1:] != pos[:-1] + 1)
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate([first, [len(pos)]]))
            parent = pos[first] // WIDTH
            whole = size == np.minimum(WIDTH, n[first] - parent * WIDTH)
            rows = pa.StructArray.from_arrays(batch.columns, names=names)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(pos)]]), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays(
                [grp.take(pa.array(first)), pa.array(parent), pa.array(-(-n[first] // WIDTH)), pa.array(whole), lists], names=["grp", "pos", "n", "whole", "members"]
            )

    found = table(nodes.where("n > 1").mapInArrow(run, f"grp {kind['grp']}, pos long, n long, whole boolean, members {list_of}"), "manifest-gathered")
    cut = found.where("not whole").select("grp", "pos", "n", F.explode("members").alias("m")).groupBy("grp", "pos", "n")
    merged = cut.agg(F.sort_array(F.collect_list(F.struct("m.pos", "m")))["m"].alias("members"))
    return found.where("whole").drop("whole").unionByName(merged)


def build(leaves: DataFrame, order: list[str], label: str = "manifest") -> Store:
    """The store of leaves (grp, digest and more), in each group ordered by ``order``."""
    spark = leaves.sparkSession
    store = Store(spark, label)
    store.append(_numbered(leaves, order))
    most = store.level(0).agg(F.max("n")).first()[0] or 0
    while most > 1:
        rows = _gathered(store.level(store.height).drop("members"))
        digest = F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256)
        rows = rows.withColumn("digest", digest).repartition(F.col("grp"), F.floor(F.col("pos") / TILE)).sortWithinPartitions("grp", "pos")
        store.append(rows.select("grp", "pos", "n", "digest", "members"))
        most = -(-most // WIDTH)
    return store


def paths(store: Store, above: DataFrame | None = None) -> DataFrame:
    """Every leaf with its path: its siblings level by level up to its group's root, and then what ``above`` (grp, path and
    more) has for the group, whose other columns come too. Rows of a level meet their paths by coordinate, each once."""
    none = F.array().cast(_PATH)
    more = [] if above is None else [c for c in above.columns if c not in ("grp", "path")]

    def starting(i: int) -> DataFrame:
        """The groups' roots of a level."""
        tops = store.level(i).where("n = 1").drop("members")
        return tops.withColumn("path", none) if above is None else tops.join(above, "grp")

    text = lambda a, n: F.array_join(F.transform(F.slice("members", a, n), lambda m: m["digest"]), "")
    known = None  # the nodes of a level with their paths
    for i in range(store.height, 0, -1):
        here = starting(i).select("grp", "pos", "path", *more)
        known = here if known is None else known.unionByName(here)
        met = store.level(i).select("grp", "pos", "members").join(known, ["grp", "pos"])
        each = met.select("grp", "members", "path", *more, F.posexplode("members").alias("i", "m"))
        step = F.struct(text(F.lit(1), F.col("i")).alias("left"), text(F.col("i") + 2, F.lit(WIDTH)).alias("right"))
        path = F.concat(F.array(step), "path").alias("path")
        if i == 1:
            lone = starting(0)
            return each.select(*[F.col("m")[c].alias(c) for c in lone.columns if c not in ("path", *more)], path, *more).unionByName(lone)
        known = table(each.select("grp", F.col("m.pos").alias("pos"), path, *more), "manifest-paths")
    return starting(0)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the tree of all documents and its proofs.

    A group is a language, whose leaves ascend by doc_id (null first), rows that share an id by their leaf; equal rows have
    equal leaves, and a place and a proof each. Groups are ordered by language, null first, then bytewise. Where 3 divides
    the CRC-32 of the decimal id, folded_root is of the leaf whose text has its A-Z lower-cased: it differs from root just
    where that changes the text. Ids are decimals as they are; a null id counts as ``-`` in its leaf and isn't tampered
    with. An empty table gives no rows; other columns are ignored.
    """
    tampered = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % TAMPER_EVERY == 0, F.lit(False))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", upper, upper.lower())
    changed = tampered & F.coalesce(lowered != F.col("text"), F.lit(False))
    leaves = docs.select("doc_id", _group(F.col("lang")).alias("grp"), leaf(F.col("text")).alias("digest"), F.when(changed, leaf(lowered)).alias("other"))
    store = build(table(leaves, "manifest-leaves"), ["doc_id", "digest"])
    groups = table(store.subroots().select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), "manifest-subroots")
    top = build(groups, ["of"], "manifest-top")
    root = F.broadcast(top.subroots().select(F.col("digest").alias("root")))  # one row
    above = table(paths(top).select(F.col("of").alias("grp"), "path", F.col("digest").alias("subroot")).crossJoin(root), "manifest-group-paths")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return paths(store, above).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, levels: int) -> str:
    """CTEs name1, name2, ... above name0 (grp, pos, n, d, ...): eight nodes become one, a group's root stays as it is."""
    out = []
    for i in range(levels):
        out.append(
            f"{name}{i + 1} AS MATERIALIZED (SELECT grp, pos // {WIDTH} AS pos, n AS below, (n + {WIDTH - 1}) // {WIDTH} AS n, list(d ORDER BY pos) AS members,"
            f" CASE WHEN n = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{i} GROUP BY grp, pos // {WIDTH}, n)"
        )
    return ", ".join(out)


def _fold_sql(name: str, start: str, levels: int, keep: str) -> str:
    """CTEs that take rows (grp, pos, h, proof, ...) of ``start`` up the levels of ``name``; the last is <start><levels>."""
    out = []
    for i in range(levels):
        left, right = (f"array_to_string({x}, '')" for x in ("m.members[1:nth]", "m.members[nth + 2:]"))
        out.append(
            f"{start}{i + 1} AS MATERIALIZED (SELECT {keep}, s.grp, s.pos, CASE WHEN below = 1 THEN h ELSE sha256({left} || h || {right}) END AS h,"
            f" CASE WHEN below = 1 THEN proof ELSE proof || {left} || {right} END AS proof"
            f" FROM (SELECT *, CAST((pos // {WIDTH**i}) % {WIDTH} AS INTEGER) AS nth FROM {start}{i}) s JOIN {name}{i + 1} m USING (grp) WHERE m.pos = s.pos // {WIDTH ** (i + 1)})"
        )
    return ", ".join(out)


def manifest_sql(levels: int = 8, group_levels: int = 4) -> str:
    """For up to 8**levels documents of a language and 8**group_levels languages."""
    piece = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    with_text = lambda t: "sha256(" + " || ".join(piece(t if c == "text" else c) for c in FIELDS) + ")"
    crc = "doc_id IN (SELECT doc_id FROM tampered)"
    return f"""
WITH RECURSIVE bytes AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM bytes
  UNION ALL SELECT doc_id, s, i + 1, list_reduce(list_prepend(xor(c, CAST(ascii(s[i + 1]) AS BIGINT)), [CAST(b AS BIGINT) FOR b IN range(8)]), lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  FROM crc WHERE i < length(s)),
tampered AS (SELECT doc_id FROM crc WHERE i = length(s) AND xor(c, 4294967295) % {TAMPER_EVERY} = 0),
leaves AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 's' || lang END AS grp, {with_text("text")} AS d, CASE WHEN {crc} THEN {with_text(low)} ELSE {with_text("text")} END AS h FROM documents),
a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_levels_sql("a", levels)},
b0 AS MATERIALIZED (SELECT '' AS grp, grp AS of, d, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM a{levels}),
{_levels_sql("b", group_levels)},
f0 AS (SELECT doc_id, d AS leaf, grp, pos, h, '' AS proof FROM a0),
{_fold_sql("a", "f", levels, "doc_id, leaf")},
g0 AS (SELECT doc_id, leaf, f.grp AS of, b0.d AS subroot, b0.grp AS grp, b0.pos AS pos, h, proof FROM f{levels} f JOIN b0 ON b0.of = f.grp),
{_fold_sql("b", "g", group_levels, "doc_id, leaf, subroot")}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = r.d AS verified FROM g{group_levels}, (SELECT d FROM b{group_levels}) r
"""
