"""Near-duplicates by MinHash with sequential Bayesian verification.

A document is the set of its word shingles. Copies (equal sets) become one node, named by the smallest id.
Nodes that agree in a band of their MinHash signature are candidates. Candidate pairs are compared by batches
of hashes: a pair is dropped as soon as the posterior probability that its similarity reaches the threshold
falls under the chosen miss probability. Survivors are verified on their full sets.

A bucket of many nodes is never expanded into its pairs. Each of its nodes is compared with two members
chosen by hash; only where a bucket's nodes then still lie in different components are the stray ones compared
with all members, block against block, and pairs that lie in one component by then are skipped: what is lost
by the bounded first step is made good by the second, and only survivors leave the blocks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, small_batches, table
from .textkit import Words, mix, shingle_set, text_slices

SHINGLE = 5
#: Similarity threshold in percent: 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 80
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: Hashes compared at once, and the posterior probability under which a pair is dropped.
BATCH = 40
MISS = 1e-5
#: Members of a block of a large bucket.
BLOCK = 256
#: Tasks over which a bucket's blocks are dealt, at most.
SPREAD = 16
#: Pairs of blocks that go to a Python worker at once.
BLOCK_ROWS = 8
#: Ids up to this many (16 MB) are broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000

_U = np.uint64
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The signature (HASHES numbers of 32 bits) of a set that isn't empty."""
    out = np.empty(HASHES, dtype=np.uint32)
    step = max(1, (1 << 19) // len(shingles))
    for k in range(0, HASHES, step):
        out[k : k + step] = ((shingles[None, :] * _FACTORS[k : k + step, None]) >> _U(32)).min(axis=1)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys; the band's number is part of its key."""
    cells = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cells.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + cells[:, :, r])
    return key


@functools.lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For each batch's end, the fewest matches with which a pair goes on.

    A hash of one byte matches with probability s + (1 - s) / 256 at similarity s; the prior of s is uniform.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        tail = weight[:, s >= percent / 100].sum(axis=1) / weight.sum(axis=1)
        out.append(int(np.argmax(tail >= miss)))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of signature pairs (rows of bytes) that survive all batches, and their matches."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int32)
    for i, least in enumerate(least_matches(percent)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, and of documents with words: fp (hash of the set), sig (a byte of each hash), keys."""
    id_type = dict(docs.dtypes)["doc_id"]

    def kernel(batch: pa.RecordBatch):
        for a, b, data, offsets in text_slices(batch.column(0)):
            words = Words(data, offsets)
            sets = [shingle_set(words.hash[words.bounds[i] : words.bounds[i + 1]], shingle) for i in range(b - a)]
            full = [i for i, s in enumerate(sets) if len(s)]
            sigs = np.array([minhash(sets[i]) for i in full], dtype=np.uint32).reshape(len(full), HASHES)
            keys = band_keys(sigs).view(np.int64)
            low = sigs.astype(np.uint8)
            fp, sig, key = [None] * (b - a), [None] * (b - a), [None] * (b - a)
            for k, i in enumerate(full):
                fp[i], sig[i], key[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), low[k].tobytes(), keys[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(key, pa.list_(pa.int64()))],
                names=["doc_id", "n", "fp", "sig", "keys"],
            )

    return arrow_map(docs.select("text", "doc_id"), kernel, f"doc_id {id_type}, n long, fp binary, sig binary, keys array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of binaries of HASHES bytes as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), HASHES)


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, matches) of the pairs whose signatures survive. Sizes too far apart are dropped first."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    joined = pairs.join(one, "a").join(two, "b").where(near).select("a", "b", "sig_a", "sig_b")

    def kernel(batch: pa.RecordBatch):
        alive, matches = surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), percent)
        take = pa.array(alive)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(matches, pa.int32())], names=["a", "b", "matches"])

    return arrow_map(joined, kernel, "a long, b long, matches int")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of the given nodes (one column, distinct)."""
    rows = docs.select("text", "doc_id")
    nodes = nodes.withColumnRenamed("node", "doc_id")
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes.hint("shuffle_hash")

    def kernel(batch: pa.RecordBatch):
        for a, b, data, offsets in text_slices(batch.column(0)):
            words = Words(data, offsets)
            sets = [shingle_set(words.hash[words.bounds[i] : words.bounds[i + 1]], shingle).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(sets, pa.binary())], names=["node", "set"])

    return arrow_map(rows.join(nodes, "doc_id", "left_semi").select("text", "doc_id"), kernel, "node long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets reach the threshold."""
    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b").select("a", "b", "s", "t")

    def kernel(batch: pa.RecordBatch):
        keep = []
        for s, t in zip(batch.column(2), batch.column(3)):
            s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return arrow_map(joined, kernel, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct nodes of pairs (a, b); each end is made distinct first."""
    ends = [pairs.select(F.col(c).alias("node")).distinct() for c in ("a", "b")]
    return ends[0].unionAll(ends[1]).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of the links (a, b), a < b: comp is the smallest node reachable.

    Every node points to its smallest smaller neighbour, pointers are followed twice over, the links are drawn
    again between what they lead to, until none is left. A node's neighbours only meet in partial minima.
    """
    links = table(links.select("a", "b").distinct(), "cc-links")
    comp = table(_ends(links).withColumn("comp", F.col("node")), "cc-comp")
    while links.take(1):
        up = links.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("p"))
        for _ in range(2):
            further = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
            up = up.join(further, "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        up = table(up, "cc-up")
        comp = table(_led(comp, "comp", up), "cc-comp")
        moved = _led(_led(links, "a", up), "b", up).where("a <> b")
        links = table(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    return comp


def _led(rows: DataFrame, name: str, up: DataFrame) -> DataFrame:
    """rows with a column of nodes replaced by where they lead."""
    rest = [c for c in rows.columns if c != name]
    return rows.join(up, rows[name] == up["x"], "left").select(*rest, F.coalesce("p", name).alias(name))


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp after more links between its nodes (or others)."""
    drawn = _led(_led(links.select("a", "b"), "a", _as_up(comp)), "b", _as_up(comp)).where("a <> b")
    drawn = drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    higher = components(drawn)
    both = _led(comp, "comp", _as_up(higher)).select("node", "comp")
    fresh = higher.join(comp.select("node"), "node", "left_anti").select("node", "comp")
    return table(both.unionByName(fresh), "dedup-comp")


def _as_up(comp: DataFrame) -> DataFrame:
    return comp.select(F.col("node").alias("x"), F.col("comp").alias("p"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    a = comp.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    b = comp.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    marked = pairs.join(a, "a", "left").join(b, "b", "left")
    return marked.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select(*pairs.columns)


def _open_members(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, comp, stray, size) of buckets (key, node, leader) that aren't one component; strays aren't in the leader's."""
    placed = members.join(comp, "node", "left").select("key", "node", "leader", F.coalesce("comp", "node").alias("comp"))
    placed = table(placed, "dedup-placed")
    main = F.max(F.when(F.col("node") == F.col("leader"), F.col("comp"))).alias("main")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), main, F.count("*").alias("size")).where("lo <> hi")
    mixed = mixed.select("key", "main", "size")
    return placed.join(mixed, "key").select("key", "node", "comp", (F.col("comp") != F.col("main")).alias("stray"), "size")


def _stray_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between components in open buckets (rows of _open_members with n, sig, keys, set).

    Strays are compared with all members of their bucket, block against block: by signature, then on full sets.
    A pair is looked at in the first band that it shares only, and not at all once the block has joined its
    components; so what leaves a block are a few links, however many pairs it has. A large bucket's blocks are dealt
    over up to SPREAD tasks by the member's block; strays, which are few as a rule, go to each of them.
    """
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("size") / BLOCK)).alias("part")
    member = F.struct("node", "comp", "n", "sig", "keys", "set")
    deals = F.least(F.ceil(F.max("size") / BLOCK), F.lit(SPREAD)).alias("deals")
    blocks = rows.groupBy("key", part).agg(F.collect_list(member).alias("ys"), deals)
    blocks = blocks.select("key", F.pmod("part", "deals").alias("deal"), "ys")
    strays = rows.where("stray").groupBy("key", part).agg(F.collect_list(member).alias("xs"), deals)
    strays = strays.select("key", "xs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    facing = strays.join(blocks, ["key", "deal"]).select("key", "xs", "ys")

    def side(value: pa.Scalar):
        fields = value.values.flatten()
        numbers = [fields[i].to_numpy(zero_copy_only=False) for i in range(3)]
        return *numbers, _matrix(fields[3]), fields[4].flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS), fields[5]

    def links(key: int, x: pa.Scalar, y: pa.Scalar) -> set[tuple[int, int]]:
        (xn, xc, xs, xg, xk, xset), (yn, yc, ys, yg, yk, yset) = side(x), side(y)
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        out = set()
        small, large = np.minimum(xs[:, None], ys[None, :]), np.maximum(xs[:, None], ys[None, :])
        i, j = np.nonzero((xc[:, None] != yc[None, :]) & (100 * small >= percent * large))
        for at in range(0, len(i), 1 << 14):
            p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            alive, matches = surviving(xg[p], yg[q], percent)
            first = (xk[p[alive]] == yk[q[alive]]).argmax(axis=1)
            here = xk[p[alive], first] == key
            alive, matches = alive[here], matches[here]
            for k in alive[np.argsort(-matches, kind="stable")].tolist():
                u, v = int(p[k]), int(q[k])
                c, d = root(int(xc[u])), root(int(yc[v]))
                if c == d:
                    continue
                s, t = np.frombuffer(xset[u].as_buffer(), np.uint64), np.frombuffer(yset[v].as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    joined[max(c, d)] = min(c, d)
                    out.add((min(int(xn[u]), int(yn[v])), max(int(xn[u]), int(yn[v]))))
        return out

    def kernel(batch: pa.RecordBatch):
        for key, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if found := links(key, x, y):
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return arrow_map(facing, kernel, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept.

    A document without words or with a null text has the empty set and is linked with nothing. A document of
    fewer words than a shingle has one shingle, all its words. Rows that share an id are one node. A row
    without an id can't be named: it is linked with nothing, has no component and is kept. doc_id is cast to
    long. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = table(_signed(docs, shingle), "dedup-signed")
    known = signed.where(F.col("doc_id").isNotNull() & F.col("fp").isNotNull())
    first = known.groupBy("fp").agg(F.min(F.struct("doc_id", "n", "sig", "keys")).alias("r"))
    nodes = table(first.select(F.col("r.doc_id").alias("node"), "fp", "r.n", "r.sig", "r.keys"), "dedup-nodes")
    bands = nodes.select("node", F.explode("keys").alias("key"))
    order = F.xxhash64("node", "key")
    buckets = bands.groupBy("key").agg(
        F.count("*").alias("size"), F.min_by("node", order).alias("leader"), F.max_by("node", order).alias("second")
    ).where("leader <> second")
    members = table(bands.join(buckets, "key"), "dedup-members")
    lead = members.select("node", F.explode(F.array("leader", "second")).alias("other")).where("node <> other")
    pairs = lead.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    likely = table(_likely(pairs, nodes, percent), "dedup-likely")
    # first each node's likeliest smaller partner; then only pairs that this leaves in different components
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a"))
    sets = table(_sets(docs, table(_ends(likely), "dedup-likely-nodes"), shingle), "dedup-sets")
    comp = components(_confirmed(best, sets, percent))
    rest = likely.join(best, ["a", "b"], "left_anti")
    comp = _merged(comp, _confirmed(_apart(rest, comp), sets, percent))
    still = table(_open_members(members.where("size > 3").select("key", "node", "leader"), comp), "dedup-open")
    more = still.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(table(_sets(docs, table(more, "dedup-more"), shingle), "dedup-more-sets"))
    rows = still.join(nodes.select("node", "n", "sig", "keys"), "node").join(sets, "node")
    with small_batches(docs.sparkSession, BLOCK_ROWS):
        comp = _merged(comp, table(_stray_links(rows, percent), "dedup-stray-links"))
    named = nodes.select("fp", "node").join(comp, "node", "left").select("fp", F.coalesce("comp", "node").alias("component"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"))
    out = out.join(named, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _own_ids(docs: DataFrame) -> DataFrame:
    """docs with ``_dedup_id``: the id as a long, or where ids repeat with different texts a number for each (id, text), in
    order of id and of the text's hash. Rows without an id have none."""
    known = F.col("doc_id").cast("long")
    texts = docs.where(known.isNotNull()).select(known.alias("_dup_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_dup_text"))
    differ = texts.groupBy("_dup_id").agg(F.min("_dup_text").alias("a"), F.max("_dup_text").alias("b")).where("a <> b")
    if not differ.take(1):
        return docs.withColumn("_dedup_id", known)
    numbered = texts.distinct().orderBy("_dup_id", "_dup_text").withColumn("_dedup_id", F.monotonically_increasing_id())
    numbered = table(numbered, "dedup-numbered")
    same = (known == F.col("_dup_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_dup_text"))
    return docs.join(numbered, same, "left").drop("_dup_id", "_dup_text")


def distinct_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near-duplicates (the smallest id), with its own columns, whatever their names.

    Different texts of one id are different documents, of which the one with the smaller hash comes first; rows equal in
    id and text count once, and the one whose columns make the smallest JSON text stays. Rows without an id stay. Null
    and empty texts, and those without words, are no near-duplicates. An empty table gives no rows.
    """
    named = _own_ids(docs)
    found = near_duplicates(named.select(F.col("_dedup_id").alias("doc_id"), "text"), shingle, percent)
    found = table(found.select("doc_id", "kept"), "dedup-kept")
    gone = found.where("not kept").select(F.col("doc_id").alias("_dup_id")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = named.join(gone, F.col("_dedup_id") == F.col("_dup_id"), "left_anti")
    again = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_dup_id")).count().where("count > 1").select("_dup_id")
    again = table(again, "dedup-again")
    if not again.take(1):
        return left.drop("_dedup_id")
    same = F.col("_dedup_id") == F.col("_dup_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # minima are taken before the shuffle, so a row repeated ever so often is no hot key
    one = left.join(again, same, "left_semi").groupBy("_dedup_id").agg(F.min_by(row, F.to_json(row)).alias("_dedup_row"))
    return left.join(again, same, "left_anti").drop("_dedup_id").unionByName(one.select("_dedup_row.*"))
