"""Exact top-k by inner product with a uniform threshold, in three phases.

Components are dealt over lists (component i to list i modulo LISTS), so a score is a sum of one local score from each
list, and a node, which is one list of one chunk of vectors, sees its own components only.

1. Every node hands on its k best local scores of each query and its least one. What these vectors score in all is added
   up, and the k-th best of them is a safe cutoff: no vector below it is in the answer.
2. The cutoff goes to all nodes. Above the least local scores, a vector that reaches it must reach an equal share of it
   in one list at least, so each node hands on its entries from that share on, and no others.
3. What one list named and another did not is looked up there, pair by pair, and the k best totals stand.

Queries and vectors meet in blocks: a join of blocks on a dealt cell gives a row for each pair of blocks. Joins that carry
matrices are merge joins: a file of matrices says little of their size, least of all with a row for each cell, and a broadcast
of them would pass through the driver. Scores are whole numbers; products are taken in doubles where they stay exact (below
2**53) and in 64-bit integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import bound_batches, release_memory, table

K = 5
EVERY = 50
LISTS = 2
#: Vectors of a chunk and queries of a block.
CHUNK_ROWS = 4096
BLOCK_ROWS = 512
#: Pairs looked up at once.
PAIRS = 1 << 16

_BLOCKS = "block long, rows array<long>, ids array<long>, mats array<binary>"
_ENTRIES = "block long, chunk long, list int, q binary, r binary, s binary, low array<long>"
_FOUND = "query_row long, vec_id long, score long, low array<long>"
_LEAST = np.iinfo(np.int64).min


def scaled(vec: Column, factor: int = 256) -> Column:
    """Components as floor(factor * x), x as a double."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def usable(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is larger than all others
    return vec.isNotNull() & F.coalesce(F.forall(vec, fine), F.lit(False))


def _blocks(vectors: DataFrame, rows: int, dims: int, kind: str, lists: int) -> DataFrame:
    """Vectors (row, vec_id, vec) in blocks of so many rows, a matrix for each list; missing components are 0."""
    width = -(-max(dims, 1) // lists)

    def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts).combine_chunks()
        row, vec = held.column(0).combine_chunks(), held.column(2).combine_chunks()
        size = np.diff(vec.offsets.to_numpy())
        flat = vec.flatten().to_numpy(zero_copy_only=False)
        dense = np.zeros((len(row), width * lists), dtype=kind)
        dense[np.repeat(np.arange(len(row)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        mats = [np.ascontiguousarray(dense[:, j::lists]).tobytes() for j in range(lists)]
        one = pa.array([0, len(row)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [row[:1], pa.ListArray.from_arrays(one, row), pa.ListArray.from_arrays(one, held.column(1).combine_chunks()), pa.array([mats], pa.list_(pa.binary()))],
            names=["block", "rows", "ids", "mats"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(rows - held, batch.num_rows - at)
                parts.append(batch.slice(at, take))
                held, at = held + take, at + take
                if held == rows:
                    yield told(parts)
                    parts, held = [], 0
        if held:
            yield told(parts)

    return vectors.mapInArrow(run, _BLOCKS)


def _matrix(raw: pa.Scalar, rows: int, kind: str, exact: str) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), dtype=kind).reshape(rows, -1).astype(exact)


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _own(query_rows: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a query of a block meets its own row in a chunk."""
    return np.nonzero(query_rows[:, None] == rows[None, :]) if np.intersect1d(query_rows, rows).size else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _local(pairs: DataFrame, kind: str, exact: str, k: int | None) -> DataFrame:
    """Entries of each node's local scores: the k best of each query, or without k those from the query's cut on."""

    def one(batch: pa.RecordBatch, i: int):
        rows, query_rows = _numbers(batch.column(3), i), _numbers(batch.column(5), i)
        s = _matrix(batch.column(6)[i], len(query_rows), kind, exact) @ _matrix(batch.column(4)[i], len(rows), kind, exact).T
        s = s.astype(np.int64)
        low = s.min(axis=1)
        own = _own(query_rows, rows)
        if k is None:
            there = s >= _numbers(batch.column(7), i)[:, None]
            there[own] = False
            q, r = np.nonzero(there)
            low = low[:0]
        else:
            ranked = s.copy()
            ranked[own] = _LEAST + 1
            best = np.argpartition(-ranked, min(k, len(rows)) - 1, axis=1)[:, :k]
            q, r = np.repeat(np.arange(len(query_rows)), best.shape[1]), best.ravel()
            fine = query_rows[q] != rows[r]
            q, r = q[fine], r[fine]
        return q.astype(np.uint16).tobytes(), r.astype(np.uint16).tobytes(), s[q, r].tobytes(), low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, r, s, low = one(batch, i)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in (0, 1, 2)), *(pa.array([x], pa.binary()) for x in (q, r, s)), pa.array([low], pa.list_(pa.int64()))],
                    names=["block", "chunk", "list", "q", "r", "s", "low"],
                )
        release_memory()

    return pairs.mapInArrow(run, _ENTRIES)


def _totals(entries: list[dict], mats: list[np.ndarray], query_mats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, total) of all pairs that any list named; scores that a list didn't name are looked up there."""
    rows = len(mats[0])
    code = {e["list"]: np.frombuffer(e["q"], np.uint16).astype(np.int64) * rows + np.frombuffer(e["r"], np.uint16) for e in entries}
    score = {e["list"]: np.frombuffer(e["s"], np.int64) for e in entries}
    every = np.unique(np.concatenate(list(code.values())))
    q, r = every // rows, every % rows
    total = np.zeros(len(every), dtype=np.int64)
    for j, (own, asked) in enumerate(zip(mats, query_mats)):
        missing = np.ones(len(every), dtype=bool)
        if j in code:
            at = np.searchsorted(every, code[j])
            total[at] += score[j]
            missing[at] = False
        left = np.flatnonzero(missing)
        for at in range(0, len(left), PAIRS):
            part = left[at : at + PAIRS]
            total[part] += np.einsum("ij,ij->i", asked[q[part]], own[r[part]]).astype(np.int64)
    return q, r, total


def _resolved(entries: DataFrame, chunks: DataFrame, blocks: DataFrame, kind: str, exact: str, k: int) -> DataFrame:
    """(query_row, vec_id, score, low): the k best totals of each query in each chunk, ties to the smaller id (null last),
    and the least local scores of the query there, list by list."""
    named = entries.groupBy("block", "chunk").agg(F.sort_array(F.collect_list(F.struct("list", "q", "r", "s", "low"))).alias("entries"))
    # the queries' smaller matrices first: what is shuffled for each pair is theirs, and a chunk's is shuffled once
    rows = named.join(blocks.select("block", F.col("rows").alias("query_rows"), F.col("mats").alias("query_mats")).hint("merge"), "block")
    rows = rows.join(chunks.select(F.col("block").alias("chunk"), F.col("ids"), F.col("mats").alias("mats")).hint("merge"), "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, ids, query_rows = batch.column(0)[i].as_py(), batch.column(1)[i].values, _numbers(batch.column(3), i)
                mats = [_matrix(m, len(ids), kind, exact) for m in batch.column(2)[i]]
                q, r, total = _totals(found, mats, [_matrix(m, len(query_rows), kind, exact) for m in batch.column(4)[i]])
                by_id = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                order = np.lexsort((by_id[r], -total, q))
                q, r, total = q[order], r[order], total[order]
                first = np.searchsorted(q, q)
                keep = np.arange(len(q)) - first < k
                q, r, total = q[keep], r[keep], total[keep]
                low = np.array([e["low"] for e in found], dtype=np.int64).reshape(len(found), -1).T
                lows = pa.array(list(low[q]), pa.list_(pa.int64())) if low.size else pa.nulls(len(q), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(query_rows[q]), ids.take(pa.array(r)), pa.array(total), lows], names=["query_row", "vec_id", "score", "low"])
        release_memory()

    return rows.select("entries", "ids", "mats", "query_rows", "query_mats").mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; only k of a query leave a task before it is shuffled by query."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_cuts(blocks: DataFrame, found: DataFrame, lists: int, k: int) -> DataFrame:
    """Query blocks with each query's cut in each list: its least local score there, and an equal share of what the k-th
    best total is above the least ones. A query with fewer than k vectors takes all."""
    kth = _best(found.select("query_row", "vec_id", "score"), k).where(F.col("rank") == k).select("query_row", F.col("score").alias("kth"))
    lows = found.groupBy("query_row").agg(*[F.min(F.col("low")[j]).alias(f"low{j}") for j in range(lists)])
    above = F.col("kth") - sum((F.col(f"low{j}") for j in range(1, lists)), F.col("low0"))
    share = F.ceil(above / F.lit(float(lists))) if lists > 1 else above
    cuts = lows.join(kth, "query_row", "left").select("query_row", F.array(*[F.coalesce(F.col(f"low{j}") + share, F.lit(_LEAST)) for j in range(lists)]).alias("cut"))
    each = blocks.select("block", F.posexplode("rows").alias("at", "query_row")).join(cuts, "query_row", "left")
    none = F.array(*[F.lit(_LEAST) for _ in range(lists)])
    per_block = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("cut", none).alias("cut"))))["cut"].alias("cuts"))
    return blocks.hint("merge").join(per_block, "block")


def top_k(vectors: DataFrame, queries: Column, k: int = K, lists: int = LISTS, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query with all rows but its own, exactly.

    ``vectors``: vec_id, vec (array of long); ``queries``: which rows are queries. Ties go to the smaller vec_id, null ids
    come last. Rows are told apart as rows: a repeated row is a candidate as often as it comes, for its own twin too, and a
    repeated query has an answer for each. Null vectors take no part; of vectors of different lengths, missing components
    count as 0. A query alone in its table, and an empty table, give no rows. Scores beyond a long are refused.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.where(F.col("vec").isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "vec", queries.alias("is_query"))
    rows = table(rows, "topk-rows")
    seen = rows.agg(F.max(F.size("vec")).alias("dims"), F.max(F.array_max("vec")).alias("most"), F.min(F.array_min("vec")).alias("least"), F.count(F.lit(1)).alias("n")).first()
    dims, most = seen["dims"] or 0, max(abs(seen["most"] or 0), abs(seen["least"] or 0))
    if dims * most * most >= 1 << 62:
        raise ValueError("scores of these vectors can pass the limits of a long")
    kind = "<i2" if most < 1 << 15 else "<i8"
    exact = "<f8" if dims * most * most < 1 << 53 else "<i8"
    chunks = table(_blocks(rows.select("row", "vec_id", "vec"), chunk_rows, dims, kind, lists), "topk-chunks")
    blocks = table(_blocks(rows.where("is_query").select("row", "vec_id", "vec"), block_rows, dims, kind, lists), "topk-queries")
    # queries are repeated in every cell, so there are no more cells than chunks
    cells = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // chunk_rows)))
    nodes = chunks.select(F.col("block").alias("chunk"), "rows", F.posexplode("mats").alias("list", "mat")).withColumn("cell", F.pmod(F.xxhash64("chunk"), F.lit(cells)))

    def met(asked: DataFrame, *more: str) -> DataFrame:
        every_cell = F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))
        lists_of = asked.select("block", F.col("rows").alias("query_rows"), *more, F.posexplode("mats").alias("list", "query_mat")).withColumn("cell", F.explode(every_cell))
        return nodes.join(lists_of.hint("merge"), ["list", "cell"])

    columns = ("block", "chunk", "list", "rows", "mat", "query_rows", "query_mat")
    first = _local(met(blocks).select(*columns), kind, exact, k)
    found = table(_resolved(first, chunks, blocks, kind, exact, k), "topk-first")
    asked = table(_with_cuts(blocks, found, lists, k), "topk-cuts")
    cut = F.transform("cuts", lambda c: F.get(c, F.col("list"))).alias("cut")
    second = _local(met(asked, "cuts").select(*columns, cut), kind, exact, None).where(F.length("q") > 0)
    every = _resolved(second, chunks, blocks, kind, exact, k)
    names = rows.where("is_query").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return _best(every.drop("low"), k).join(names, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_vectors(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``top_k`` of embeddings (vec_id, embedding), components as floor(256 * x); rows whose vec_id is divisible by ``every`` ask.

    Vectors that are null, or hold a null or non-finite component, take no part; other columns are ignored.
    """
    fine = embeddings.where(usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("vec"))
    return top_k(fine, F.coalesce(F.col("vec_id") % every == 0, F.lit(False)), k)


#: All queries against all other rows.
TOP_K_SQL = f"""
WITH rows AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
fine AS (SELECT r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM rows
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scores AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
           FROM fine q JOIN fine c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM scores QUALIFY rank <= {K}
"""
