import hashlib
import re

import numpy as np
import pytest

from strandloom.llm import infill
from strandloom.llm.oracles import ORACLES
from strandloom.llm.queries import op13_fill_in_middle

from ..conftest import canonical


@pytest.mark.parametrize("size,share", [(0, 0.5), (1, 1.0), (63, 0.3), (64, 0.5), (512, 0.01), (513, 1.0), (5000, 0.002), (70_000, 0.4), (4096, 0.0)])
def test_rank_and_select_against_counting(size, share):
    bits = np.random.default_rng(size).random(size) < share
    vector = infill.BitVector(bits)
    ones = np.flatnonzero(bits)
    assert vector.total == len(ones)
    assert (vector.rank(np.arange(size + 1)) == np.concatenate([[0], np.cumsum(bits)])).all()
    assert (vector.select(np.arange(len(ones))) == ones).all()


def plainly(doc_id, text):
    """The row by regular expressions and lists."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        form, out = "plain", text
    elif h[3] % 100 < 50:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, len(units), form, *sizes, sha(out), sha(text))


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na", "é\nß\U0001F600\n\n日本", "x<P>y\nz", "<S>", "a<M>\n", "<\n<P\n>S>\n<S\n", "a\r\nb\r\n",
    "\n".join("line %d é" % i for i in range(30_000)), "z" * 700_000, "q\n" * 70_000 + "end", "\x00\n\x01", "a b\x0bc\x85d\n",
]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


def test_rows_of_the_sql(spark, duck, sf_dir):
    assert canonical(op13_fill_in_middle(spark, sf_dir).toPandas()) == canonical(duck.execute(ORACLES["op13_fill_in_middle"]).df())


def test_odd_texts_against_plain_rules(spark):
    """Each text under several ids, null ids, repeated rows, clashing columns."""
    rows = [(i, t, "x", "y", 1) for n, t in enumerate(TEXTS) for i in (n, n + 1000, -n, None)] + [(3, "a\nb", "x", "y", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, output string, n long").repartition(3)
    assert rows_of(infill.fill_in_middle(df)) == sorted((plainly(r[0], r[1]) for r in rows), key=str)


def test_all_clashes_and_an_empty_table(odd, none):
    assert rows_of(infill.fill_in_middle(odd)) == sorted((plainly(r["doc_id"], r["text"]) for r in odd.collect()), key=str)
    assert infill.fill_in_middle(none).collect() == []


def test_outputs_give_their_texts_again(docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    made = infill.transformed(docs).collect()
    assert {"psm", "spm"} <= {r["form"] for r in made}
    for r in made:
        assert infill.restored(r["output"].encode(), r["form"]).decode() == texts[r["doc_id"]]
        if r["form"] != "plain":
            assert r["output"].count("<M>") == 1 and len(r["output"]) == len(texts[r["doc_id"]]) + 9


def test_rates(docs):
    assert {r["form"] for r in infill.transformed(docs, rate=0).collect()} == {"plain"}
    assert "psm" not in {r["form"] for r in infill.transformed(docs, suffix_first=100).collect()}
    n = docs.count()
    assert 0.3 * n < infill.transformed(docs, rate=50, output=False).where("form = 'plain'").count() < 0.7 * n
