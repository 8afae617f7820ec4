"""Document fingerprints: a Merkle tree over sections, paragraphs and segments.

Lines are paragraphs; a paragraph is cut into segments after words chosen by their hash, and paragraphs form
sections in the same way, so that an edit changes the tree only around its place. A leaf is a hash of a
segment's exact bytes; a node is a hash of its children's hashes. The fingerprint is the root (32 hex
digits), a colon and the leaves: four characters each, paragraphs ended by ``.`` and sections by ``/``. Equal
roots mean equal texts; differing branches show where texts differ (``differing``), and the share of common
leaves is the likeness of two texts.
"""

from __future__ import annotations

import base64
import difflib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import bound_batches, table
from .textkit import SLICE_BYTES, Words, mix, span_hash

#: A segment ends after about every so many words, a section after about every so many paragraphs.
SEGMENT_WORDS = 8
#: Within so many first words, a segment ends after about every second one: short texts have leaves enough to be compared.
FINE_WORDS = 48
SECTION_PARAGRAPHS = 4
#: Rows of one range of ids, and the most ranges.
RANGE_ROWS = 5000
MOST_RANGES = 20_000

_U = np.uint64


class Trees:
    """Fingerprints of several texts."""

    def __init__(self, texts: list[bytes]):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        words = Words(data, offsets)
        row = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        n = len(row)
        line = np.concatenate([[0], np.cumsum(data == 10)])[words.start]
        first = np.ones(n, dtype=bool)
        first[1:] = row[1:] != row[:-1]
        gap = np.zeros(n, dtype=np.int64)
        gap[1:] = np.where(first[1:], 0, line[1:] - line[:-1])
        ends = words.hash % _U(SEGMENT_WORDS) == 0
        ends |= (words.hash % _U(2) == 0) & (np.arange(n) - words.bounds[:-1][row] < FINE_WORDS)
        cut = first | (gap > 0)
        cut[1:] |= ends[:-1]
        at = np.flatnonzero(cut)
        # a leaf runs to the next one's first byte; the first takes what stands before its first word
        leaf_row = row[at]
        wordless = np.flatnonzero((np.diff(words.bounds) == 0) & (np.diff(offsets) > 0))
        start = np.concatenate([np.where(first[at], offsets[leaf_row], words.start[at]), offsets[wordless]])
        leaf_row = np.concatenate([leaf_row, wordless])
        new_par = np.concatenate([gap[at] > 0, np.zeros(len(wordless), bool)])
        blank = np.concatenate([gap[at] > 1, np.zeros(len(wordless), bool)])
        by = np.argsort(start, kind="stable")
        start, leaf_row, new_par, blank = start[by], leaf_row[by], new_par[by], blank[by]
        stop = np.concatenate([start[1:], offsets[-1:]])[: len(start)]
        stop = np.minimum(stop, offsets[leaf_row + 1]) if len(start) else stop
        self.leaf = span_hash(data, start, stop, SLICE_BYTES)
        self.bounds = np.searchsorted(leaf_row, np.arange(len(texts) + 1))
        self._mark(new_par, blank)

    def _mark(self, new_par: np.ndarray, blank: np.ndarray) -> None:
        """Paragraph hashes and ends; a section ends at a blank line or after a paragraph chosen by its hash."""
        n = len(self.leaf)
        begins = new_par.copy()
        begins[self.bounds[:-1][self.bounds[:-1] < n]] = True
        at = np.flatnonzero(begins)
        self.par_end = np.zeros(n, dtype=bool)
        self.sec_end = np.zeros(n, dtype=bool)
        if not n:
            return
        last = np.concatenate([at[1:], [n]]) - 1
        self.par_end[last] = True
        place = np.arange(n) - np.repeat(at, np.diff(np.concatenate([at, [n]])))
        par = mix(np.add.reduceat(self.leaf * (mix(place.astype(np.uint64)) | _U(1)), at))
        self.sec_end[last] = par % _U(SECTION_PARAGRAPHS) == 0
        before_blank = np.flatnonzero(blank) - 1
        self.sec_end[before_blank[before_blank >= 0]] = True
        self.sec_end[self.bounds[1:][np.diff(self.bounds) > 0] - 1] = True

    def codes(self, i: int) -> np.ndarray:
        """The sorted distinct leaf codes (24 bits) of text i."""
        return np.unique(self.leaf[self.bounds[i] : self.bounds[i + 1]] >> _U(40))

    def fingerprint(self, i: int) -> str:
        lo, hi = self.bounds[i], self.bounds[i + 1]
        leaf, par, sec = self.leaf[lo:hi], self.par_end[lo:hi], self.sec_end[lo:hi]
        sections, a = [], 0
        for b in np.flatnonzero(sec) + 1:
            nodes, p = [], a
            for q in a + np.flatnonzero(par[a:b]) + 1:
                nodes.append(xxhash.xxh3_128_digest(leaf[p:q].tobytes()))
                p = q
            sections.append(xxhash.xxh3_128_digest(b"".join(nodes)))
            a = b
        root = xxhash.xxh3_128_hexdigest(b"".join(sections))
        codes = np.ascontiguousarray((leaf >> _U(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]).tobytes()
        text = base64.b64encode(codes, b"-_").decode()
        parts, a = [], 0
        for b in np.flatnonzero(par) + 1:
            parts.append(text[4 * a : 4 * b])
            parts.append("/" if sec[b - 1] else ".")
            a = b
        return f"{root}:{''.join(parts)}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """2 |A and B| / (|A| + |B|) of leaf codes; 1 for two empty texts."""
    if not len(a) and not len(b):
        return 1.0
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def leaf_codes(fingerprint: str) -> np.ndarray:
    """The sorted distinct leaf codes in a fingerprint."""
    raw = base64.b64decode(fingerprint.split(":")[1].replace(".", "").replace("/", ""), b"-_")
    three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.uint64)
    return np.unique((three[:, 0] << _U(16)) | (three[:, 1] << _U(8)) | three[:, 2])


def differing(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(section, paragraph) numbers of the branches that only a has, and of those that only b has, in order and with
    repeats; none if the roots are equal. Sections that both have in one order aren't looked into."""
    if a.split(":")[0] == b.split(":")[0]:
        return [], []
    trees = [[[p for p in s.split(".") if p] for s in f.split(":")[1].split("/") if s] for f in (a, b)]
    whole = difflib.SequenceMatcher(None, *([tuple(s) for s in t] for t in trees), autojunk=False)
    only: tuple[list, list] = ([], [])
    for kind, *ends in whole.get_opcodes():
        if kind == "equal":
            continue
        sides = [[(i, j) for i in range(*ends[2 * k : 2 * k + 2]) for j in range(len(trees[k][i]))] for k in (0, 1)]
        inner = difflib.SequenceMatcher(None, *([trees[k][i][j] for i, j in sides[k]] for k in (0, 1)), autojunk=False)
        for what, i, j, x, y in inner.get_opcodes():
            if what != "equal":
                only[0].extend(sides[0][i:j])
                only[1].extend(sides[1][x:y])
    return only


def _shared_start(a: str, b: str) -> int:
    """Length of the longest common start."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.startswith(b[:mid]) else (lo, mid - 1)
    return lo


def _results(texts: list[str], nexts: list[str]) -> list[tuple]:
    """(n_chars, edited_sha256, fingerprint, and of the edited text: root, how many characters its leaves share with the
    text's from the start, the rest of them; near_edited, near_next) of pairs of neighbours."""
    raw = [t.encode() for t in texts]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts)]
    edited = [e.encode() for e in edited]
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(raw[j]) <= SLICE_BYTES // 2):
            size += len(raw[j])
            j += 1
        m = j - i
        trees = Trees(raw[i:j] + edited[i:j] + [nexts[j - 1].encode()])
        codes = [trees.codes(k) for k in range(2 * m + 1)]
        for k in range(m):
            follows = codes[k + 1] if k + 1 < m else codes[2 * m]
            print_, changed = trees.fingerprint(k), trees.fingerprint(m + k)
            same = _shared_start(print_[33:], changed[33:])
            out.append((
                len(texts[i + k]), hashlib.sha256(edited[i + k]).hexdigest(), print_, changed[:32], same, changed[33 + same :],
                likeness(codes[k], codes[m + k]), likeness(codes[k], follows),
            ))
        i = j
    return out


_NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_root", "same", "edited_rest", "near_edited", "near_next")
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64())
_FIELDS = ", ".join(f"{n} {k}" for n, k in zip(_NAMES, ("long", "string", "string", "string", "int", "string", "double", "double")))


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk one range of ids in order. Its first and last document go on as edges, with their texts."""
    part = TaskContext.get().partitionId()
    id_type, held = None, None  # held: the last document so far

    def edges(ids, texts, kinds):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), *(pa.nulls(n, k) for k in _KINDS), pa.array([part] * n, pa.int32()), pa.array(kinds), pa.array(texts, pa.string())],
            names=["doc_id", *_NAMES, "part", "edge", "text"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        if held is None:
            id_type = batch.column(0).type
            yield edges(ids[:1], texts[:1], ["first"])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        rows = _results(texts[:-1], texts[1:])
        held = ids[-1], texts[-1]
        if rows:
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[:-1], id_type), *(pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())],
                names=["doc_id", *_NAMES, "part", "edge", "text"],
            )
    if held is not None:
        yield edges([held[0]], [held[1]], ["last"])


def _edge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = []
            for text, follows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows += _results([text or ""], [follows or ""])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), _KINDS))], names=["doc_id", *_NAMES])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next
    document's, by ascending doc_id; after the last comes the first (a single document is its own next one).
    A null text is empty. Null ids come first; rows of one id are ordered by a hash of the text. Ranges of ids
    are sorted apart from each other; a range's last document is put together with the next range's first.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text")
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("doc_id").count() // RANGE_ROWS))
    ordered = rows.repartitionByRange(ranges, F.asc("doc_id")).sortWithinPartitions(F.asc("doc_id"), F.xxhash64("text"))
    done = table(ordered.mapInArrow(_along, f"doc_id {id_type}, {_FIELDS}, part int, edge string, text string"), "merkle")
    first = done.where("edge = 'first'").select("part", F.col("text").alias("follows"))
    last = done.where("edge = 'last'").select("doc_id", "text", "part")
    # one row for each range: which range comes next
    parts = first.select("part")
    after = parts.select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    pairs = last.join(after, "part").join(first.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "follows")
    ends = pairs.mapInArrow(_edge_pairs, f"doc_id {id_type}, {_FIELDS}")
    every = done.where("edge is null").select("doc_id", *_NAMES).unionByName(ends)
    edited = F.expr("concat(edited_root, ':', substring(fingerprint, 34, same), edited_rest)").alias("edited_fingerprint")
    return every.select("doc_id", "n_chars", "edited_sha256", "fingerprint", edited, "near_edited", "near_next")
