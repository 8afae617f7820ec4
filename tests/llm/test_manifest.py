import hashlib
import zlib

import pytest

from strandloom.llm import manifest
from strandloom.llm.oracles import ORACLES
from strandloom.llm.queries import op12_merkle_manifest

from ..conftest import canonical
from .conftest import DOCS

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    """(root, path of each leaf as (left, right) pairs)."""
    paths, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(place):
            run = level[p - p % 8 : p - p % 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            place[i] = p // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0] if level else None, paths


def plainly(rows):
    piece = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(piece(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    subs = {}
    for lang, members in groups.items():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        subs[lang] = tree([leaf(r, r["text"]) for r in members])
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    root, tops = tree([subs[g][0] for g in order])
    out = []
    for lang, top in zip(order, tops):
        for r, path in zip(groups[lang], subs[lang][1]):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h, whole = leaf(r, text), path + top
            for left, right in whole:
                h = sha(left + h + right)
            out.append((r["doc_id"], leaf(r, r["text"]), subs[lang][0], root, sha("".join(a + b for a, b in whole)), h, h == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


def test_rows_of_the_sql(spark, duck, sf_dir):
    assert canonical(op12_merkle_manifest(spark, sf_dir).toPandas()) == canonical(duck.execute(ORACLES["op12_merkle_manifest"]).df())


def test_against_a_plain_tree(docs):
    rows = got(manifest.manifest(docs))
    assert rows == plainly(docs.collect())
    assert {r[-1] for r in rows} == {True, False}


@pytest.mark.parametrize("batch", [3, 1000])
def test_odd_rows_and_cut_batches(spark, odd, batch):
    """Nulls, repeated rows, clashing columns; batches so small that groups are cut."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        assert got(manifest.manifest(odd)) == plainly(odd.collect())
        one = [(i, f"T {i}", "en", "s", i) for i in range(75)] + [(200, "X", "fr", "s", 1)] + [(300 + i, "y", f"l{i}", None, i) for i in range(70)]
        df = spark.createDataFrame(one, DOCS)
        assert got(manifest.manifest(df)) == plainly(df.collect())
    finally:
        spark.conf.set(key, before)


def test_few_rows(spark, none):
    assert manifest.manifest(none).collect() == []
    df = spark.createDataFrame([(7, "Only", "en", "a", 4)], DOCS)
    rows = got(manifest.manifest(df))
    assert rows == plainly(df.collect()) and rows[0][1] == rows[0][2] == rows[0][3] and rows[0][4] == sha("")


def test_levels_of_the_store(spark):
    rows = [(f"g{i % 3}", i, sha(str(i))) for i in range(1000)]
    store = manifest.build(spark.createDataFrame(rows, "grp string, id long, digest string"), ["id"])
    assert [store.level(i).count() for i in range(store.height + 1)] == [1000, 3 * 42 - 0, 18, 3]
    for i in range(1, store.height + 1):
        assert store.level(i).where("size(members) > 8 or n < 1").count() == 0
    assert {r["digest"] for r in store.subroots().collect()} == {tree([sha(str(i)) for i in range(g, 1000, 3)])[0] for g in range(3)}
