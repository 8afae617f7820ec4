"""Fill-in-the-middle transformation with succinct rank and select.

Where a text's lines end is a bit for each byte, packed eight to a byte; a directory holds the number of ends before each
block of 512 bits. Rank and select on it answer all that is asked: the ends in a text are its lines, and the place of the
a-th and b-th end are the byte cuts of prefix, middle and suffix. Texts of a batch share one bit vector, and all their
ranks and selects are answered at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map
from .textkit import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many are transformed, and how many of those have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = "7:"
#: Words of 64 bits in a block of the directory.
BLOCK_WORDS = 8


class BitVector:
    """Packed bits with a popcount directory: rank and select of whole arrays of queries."""

    def __init__(self, bits: np.ndarray):
        """bits: booleans."""
        self.size = len(bits)
        words = -(-self.size // 64)
        words += -words % BLOCK_WORDS
        packed = np.zeros(words * 8, dtype=np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        per_block = np.bitwise_count(self.words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        #: set bits before each block; the last entry is the total
        self.directory = np.concatenate([[0], np.cumsum(per_block)]).astype(np.int64)

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place (0 to size)."""
        at = np.asarray(at, dtype=np.int64)
        word = at >> 6
        block = word // BLOCK_WORDS
        out = self.directory[block].copy()
        for step in range(BLOCK_WORDS - 1):  # whole words of the block before the place's word
            i = block * BLOCK_WORDS + step
            whole = i < word
            out[whole] += np.bitwise_count(self.words[i[whole]])
        part = (at & 63) != 0
        mask = (np.uint64(1) << (at[part] & 63).astype(np.uint64)) - np.uint64(1)
        out[part] += np.bitwise_count(self.words[word[part]] & mask)
        return out

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Place of each nth set bit, counted from 0."""
        nth = np.asarray(nth, dtype=np.int64)
        block = np.searchsorted(self.directory, nth, side="right") - 1
        left, word = nth - self.directory[block], block * BLOCK_WORDS
        for _ in range(BLOCK_WORDS - 1):
            count = np.bitwise_count(self.words[word]).astype(np.int64)
            past = left >= count
            left, word = np.where(past, left - count, left), word + past
        at, width = np.zeros(len(nth), dtype=np.int64), 32
        value = self.words[word]
        while width:  # halve the word until one bit is left
            low = np.bitwise_count((value >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            past = left >= low
            left, at = np.where(past, left - low, left), at + width * past
            width //= 2
        return word * 64 + at


def line_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bit for each byte: newlines, and the last byte of a text that doesn't end with one."""
    ends = data == 10
    full = offsets[1:] > offsets[:-1]
    ends[offsets[1:][full] - 1] = True
    return ends


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, a, b) of each text: bytes a and b (from the text's start) end its first min and max of first % (lines + 1)
    and second % (lines + 1) lines."""
    bits = BitVector(line_ends(data, offsets))
    before = bits.rank(offsets)
    lines = np.diff(before)
    ends = []
    one, two = first % (lines + 1), second % (lines + 1)
    for units in (np.minimum(one, two), np.maximum(one, two)):
        at = np.zeros(len(lines), dtype=np.int64)
        some = units > 0
        at[some] = bits.select(before[:-1][some] + units[some] - 1) + 1 - offsets[:-1][some]
        ends.append(at)
    return lines, *ends


def joined(text: bytes, a: int, b: int, form: str) -> bytes:
    """The output of a form."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if form == "plain":
        return text
    return p + text[:a] + s + text[b:] + m + text[a:b] if form == "psm" else s + text[b:] + p + text[:a] + m + text[a:b]


def restored(output: bytes, form: str) -> bytes:
    """The text, from the output and its form alone. A transformed text holds none of the three marks."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    first, rest = output[len(one) :].split(two.encode(), 1)
    second, middle = rest.split(MIDDLE.encode(), 1)
    prefix, suffix = (second, first) if form == "spm" else (first, second)
    return prefix + middle + suffix


_MADE = "n long, form string, prefix_chars long, middle_chars long, output {kind}, output_sha256 string, restored_sha256 string"


def _hashes(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the id."""
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


def transformed(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, output: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256 of whole texts.

    n counts the lines; form is plain (the text as it is: empty, with a mark of its own, or not chosen by the rate), psm or
    spm. What an id decides is decided alike in every run. prefix_chars and middle_chars count code points and are null
    for plain texts. A null text is empty; a null id is hashed as the empty text; repeated rows are transformed alike; a
    text of any length is a slice of its own. An empty table gives no rows; other columns are ignored. Without
    ``output`` the text of the output stays with the worker, and its column is null.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def kernel(batch: pa.RecordBatch):
        texts, numbers = batch.column(1), [batch.column(i + 2).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        for lo, hi, data, offsets in text_slices(texts):
            h1, h2, h3, h4 = (h[lo:hi] for h in numbers)
            lines, a, b = cuts(data, offsets, h1, h2)
            starts = np.zeros(len(data) + 1, dtype=np.int32)
            np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
            chars = lambda x: starts[offsets[:-1] + x]  # noqa: B023, E731
            prefix, middle = chars(a) - chars(0 * a), chars(b) - chars(a)
            raw = data.tobytes()
            form, out, digests, again = [], [], [], []
            for i in range(hi - lo):
                text = raw[offsets[i] : offsets[i + 1]]
                plain = not text or h3[i] % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE))
                form.append("plain" if plain else "spm" if h4[i] % 100 < suffix_first else "psm")
                made = joined(text, a[i], b[i], form[-1])
                out.append(made.decode() if output else None)
                digests.append(hashlib.sha256(made).hexdigest())
                again.append(hashlib.sha256(restored(made, form[-1])).hexdigest())
            plain = np.array([f == "plain" for f in form], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo), pa.array(lines, pa.int64()), pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain),
                    pa.array(out, pa.string()), pa.array(digests, pa.string()), pa.array(again, pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"],
            )

    return arrow_map(docs.select("doc_id", "text", *_hashes(F.col("doc_id"))), kernel, f"doc_id {kind}, {_MADE.format(kind='string')}")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``transformed`` without the output's text, its hashes instead."""
    return transformed(docs, output=False).drop("output")


#: Lines by a regular expression, and the pieces joined again.
INFILL_SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS l,
      CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
           WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
