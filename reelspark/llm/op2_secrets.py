"""Secret scans with an incremental blob ledger.

Every historical version of a file, here every whole text, is a blob addressed by its content. The ledger says
which (blob, rule version) pairs have been scanned and what was found. A scan takes only the pairs that are not
in it, each once however many paths hold the blob, adds them, and joins the findings back to every path.

The ledger is what its folder holds: a scan's findings are a part of their own, which counts once its row is in
path/commits. A second object on the same path goes on where the first ended, and what a failed scan left behind is
never read. One writer at a time.

Spans are kind:start:end in code points, end exclusive. Base kinds, rule version 1: assign, access, hex. Rule version 2
adds pem, the armour line of a private key; base spans stay as they are.

Defined results: a null text is the empty text; a null path id keeps its row; repeated rows are paths of their
own and share a blob; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Commits, lean, scratch, slices, stage, table

KINDS = ("assign", "access", "hex", "pem")
#: Rule version -> how many of the kinds it looks for.
RULES = {1: 3, 2: 4}
RULE_VERSION = 2


def _either(words: str) -> str:
    """A-Z and a-z alike, and no other letter that a case-blind match would fold onto them."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = re.compile(r"(?:" + _either("password|passwd|secret|token|api_?key") + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 24 or more: the runs [0-9a-f]+ of that length are the same spans.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")


def find_spans(text: str, kinds: int = len(KINDS)) -> list[tuple[int, int, str]]:
    """(start, rank of kind, kind:start:end) of the first so many kinds, in the order in which spans are joined."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if kinds > 3 and "PRIVATE KEY" in text:
        out += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    return [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in sorted(out)]


FINDINGS = "blob binary, rule_version int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(version: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [find_spans(t, RULES[version]) for t in b.column("text").to_pylist()]
            base = [",".join(x for _, k, x in f if k < 3) for f in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "blob": b.column("blob"),
                    "rule_version": pa.array([version] * b.num_rows, pa.int32()),
                    **{f"n_{kind}": pa.array([sum(k == rank for _, k, _ in f) for f in found], pa.int64()) for rank, kind in enumerate(KINDS[:3])},
                    "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in base],
                    "spans": [",".join(x for _, _, x in f) for f in found],
                }
            )

    return lean(run)


class BlobLedger:
    """Findings by (blob, rule_version), appended part by part in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark)
        self.commits = Commits(spark, self.path)
        self.parts = [part for _, part, _ in self.commits.rows()]

    def findings(self) -> DataFrame | None:
        return self.spark.read.schema(FINDINGS).parquet(*(f"{self.path}/part-{p}" for p in self.parts)) if self.parts else None

    def scan(self, versions: DataFrame, path_id: str = "doc_id", text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
        """Findings of every row of versions under rule_version: path_id, blob and the findings' columns.

        A blob's text crosses the network once from each task that holds it, however many paths share it there.
        """
        body = F.coalesce(F.col(text), F.lit(""))
        addressed = versions.select(F.col(path_id).alias("path_id"), F.unhex(F.sha2(body, 256)).alias("blob"), body.alias("text"))
        unseen = addressed.groupBy("blob").agg(F.first("text").alias("text"))
        known = self.findings()
        if known is not None:
            unseen = unseen.join(known.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
        part = self.commits.fresh()
        stage(unseen.select("blob", "text").mapInArrow(_scan(rule_version), FINDINGS), f"{self.path}/part-{part}")
        self.commits.add(len(self.parts) + 1, part)
        self.parts.append(part)
        now = self.findings().where(F.col("rule_version") == rule_version)
        return addressed.select("path_id", "blob").join(now, "blob").withColumnRenamed("path_id", path_id)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = BlobLedger(spark).scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.lower(F.hex("blob")).alias("blob_sha256"))
