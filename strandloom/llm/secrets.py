"""Secret scans over an incremental ledger of blobs.

Every version of a text is content-addressed by its SHA-256. The ledger records which (blob, rule version)
pairs have been scanned and what was found; a scan looks only at pairs that are not in it, once for each
distinct blob, adds them, and joins findings back to all paths (here: documents) that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import arrow_map, new_path, table

#: Rules by version: kind -> (pattern, group whose length counts, least length, what a text must hold for it).
RULES: dict[str, dict[str, tuple[re.Pattern, int, int, tuple[str, ...]]]] = {
    "base-1": {
        "assign": (
            re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
            2, 6, ("passw", "secret", "token", "api"),
        ),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20, ("akia",)),
        "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24, ()),
    },
    "more-1": {
        "pem": (re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 1, ("private key",)),
        "jwt": (re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII), 0, 1, ("eyj",)),
        "forge": (re.compile(r"\b(?:ghp|gho|ghs|glpat)[_-][A-Za-z0-9_-]{20,}", re.ASCII), 0, 1, ("gh", "glpat")),
    },
}
KINDS = [kind for rules in RULES.values() for kind in rules]
#: Findings of up to so many bytes are broadcast to the paths; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20
LEDGER_FIELDS = "blob binary, version string, spans array<struct<start:int,kind:int,end:int>>"


def find_spans(text: str, version: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points of one version's rules; matches that are too short are passed over whole."""
    low = None
    found = []
    for kind, (pattern, group, least, needs) in RULES[version].items():
        if needs:
            low = text.lower() if low is None else low
            if not any(x in low for x in needs):
                continue
        k = KINDS.index(kind)
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def blob_id(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, as 32 bytes; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class BlobLedger:
    """A ledger at a path in the shared folder; scans add to it, so that each pair is scanned once over all runs."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "blob-ledger")
        self.started = False

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER_FIELDS).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER_FIELDS)

    def paths(self) -> DataFrame | None:
        """(path, blob) of every version of every path that was ever scanned; None before the first scan."""
        try:
            return self.spark.read.parquet(f"{self.path}-paths").dropDuplicates(["path", "blob"])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def scan(self, texts: DataFrame, versions: Iterable[str] = tuple(RULES)) -> DataFrame:
        """texts: path, text. Scans unseen pairs, records them, and returns (path, blob) of all texts.

        One row of each unseen blob is chosen by its smallest path, so only ids and hashes are grouped and a
        blob with any number of copies meets in partial sums; then the chosen texts alone go on to be scanned.
        """
        versions = list(versions)
        paths = table(texts.select("path", blob_id(F.col("text")).alias("blob")), "blob-paths")
        every = paths.groupBy("blob").agg(F.min("path").alias("path"))
        done = self.entries().where(F.col("version").isin(versions)).groupBy("blob").agg(F.collect_set("version").alias("done"))
        due = every.join(done, "blob", "left").select(
            "path", F.col("blob").alias("due_blob"), F.array_except(F.array(*map(F.lit, versions)), F.coalesce("done", F.array().cast("array<string>"))).alias("due")
        ).where(F.size("due") > 0)
        due = table(due, "blob-due")
        chosen = texts.withColumn("blob", blob_id(F.col("text"))).join(
            due.hint("shuffle_hash"), (texts["path"].eqNullSafe(due["path"])) & (F.col("blob") == F.col("due_blob"))
        ).select("text", "blob", "due")
        arrow_map(chosen, _scan_batch, LEDGER_FIELDS).dropDuplicates(["blob", "version"]).write.mode("append").parquet(self.path)
        known, fresh = self.paths(), paths
        if known is not None:
            known = known.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"))
            fresh = paths.join(known, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")), "left_anti")
        fresh.write.mode("append").option("compression", "zstd").parquet(f"{self.path}-paths")
        return paths


def _scan_batch(batch: pa.RecordBatch):
    blobs, versions, spans = [], [], []
    for text, blob, due in zip(batch.column(0), batch.column(1), batch.column(2)):
        value = text.as_py() or ""
        for version in due.as_py():
            blobs.append(blob.as_py())
            versions.append(version)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in find_spans(value, version)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(versions, pa.string()), pa.array(spans, kind)], names=["blob", "version", "spans"])


def findings(docs: DataFrame, ledger: BlobLedger | None = None, versions: Iterable[str] = tuple(RULES)) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    Null texts are empty, empty texts have no spans, repeated rows repeat their findings, null ids are kept. Spans that begin
    at one place stand in the order of their kinds. An empty table gives no rows; texts of any length are scanned whole.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    paths = ledger.scan(docs.select(F.col("doc_id").alias("path"), "text"), versions)
    return _with_findings(paths, ledger, versions).withColumnRenamed("path", "doc_id")


def history(ledger: BlobLedger, versions: Iterable[str] = tuple(RULES)) -> DataFrame:
    """Per path and blob that the ledger has seen in any scan: path, blob (hex) and the columns of ``findings``.

    A path has a row for each of its historical texts; what a later rule version found counts for all of them. A ledger
    without scans has no history and is refused.
    """
    paths = ledger.paths()
    if paths is None:
        raise ValueError(f"{ledger.path}: nothing was scanned yet")
    found = _with_findings(paths, ledger, versions, ["blob"])
    return found.withColumn("blob", F.lower(F.hex("blob")))


def _with_findings(paths: DataFrame, ledger: BlobLedger, versions: Iterable[str], also: Iterable[str] = ()) -> DataFrame:
    found = ledger.entries().where(F.col("version").isin(list(versions)) & (F.size("spans") > 0))
    found = found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set(F.col("spans")))).alias("all"))
    names = F.array(*[F.lit(k) for k in KINDS])
    n_base = len(RULES["base-1"])

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("all", lambda s: s["kind"] < n_base)
    digest = found.select(
        "blob", "all",
        *[count(i).alias(f"n_{KINDS[i]}") for i in range(n_base)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"),
    ).drop("all")
    digest = table(digest, "blob-findings")
    size = digest.agg(F.sum(F.length("spans") + 200)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # a blob with any number of copies then stays where its paths are
        digest = F.broadcast(digest)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return paths.join(digest, "blob", "left").select(
        "path", *also, *[F.coalesce(f"n_{KINDS[i]}", F.lit(0)).cast("long").alias(f"n_{KINDS[i]}") for i in range(n_base)],
        F.coalesce("base_sha256", nothing).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
