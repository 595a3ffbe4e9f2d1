"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes (its blob). The ledger holds, for a blob and a version
of the rules, what was found. A scan computes the blobs of all rows, takes one row for each blob that the ledger does not
yet know under these rules, scans those texts only, and joins the findings back to every row (path) that has the blob.
Copies are counted out before any text moves: the blobs are grouped first, so a blob that a third of all rows share is
one narrow row for each task, and the join back carries only blobs with findings: by broadcast where a count shows that they
are few, by a shuffle (which AQE splits where a blob is hot) where not. The version of the rules is a digest of the patterns,
so a changed rule makes every blob unseen under the new version, and old findings stay on record.

Null is the empty text and has no findings. Repeated rows get a row each. Texts are scanned whole, in batches of about 1 MB, a
longer text alone. Offsets are code points, ends exclusive. An empty table gives an empty result and adds nothing to a ledger.
A kept column named like one of the operator's own (blob, findings) stays, and the own one gets an underscore behind its name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import free, narrow, pieces, row_key

FOUND = "array<struct<kind:string,start:int,end:int>>"
#: Kinds in the order of ties. The first three are the base rules, the others published formats of credentials.
KINDS = ("assign", "access", "hex", "github", "jwt", "pem")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs: a shorter run before cannot reach into one
_MORE = {
    "github": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
    "pem": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
}
#: Numbers of blobs with findings, and of findings, up to which they are broadcast.
FEW = 200_000, 1_000_000


def rules_version() -> str:
    """A digest of all rules: patterns, their flags, least lengths and order."""
    rules = [_ASSIGN.pattern, str(_ASSIGN.flags), "12", _ACCESS.pattern, "18", _HEX.pattern, *(f"{k} {hint} {p.pattern}" for k, (hint, p) in _MORE.items()), *KINDS]
    return hashlib.sha256("\n".join(rules).encode()).hexdigest()[:16]


RULES_VERSION = rules_version()


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """All findings in the text, by start, then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    for kind, (hint, pattern) in _MORE.items():
        if hint in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in pieces(batches, "text", 1 << 20):
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, kind)], ["blob", "findings"])


def blob(text_col: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: str = RULES_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, rules, findings): one for each blob that the ledger has not under these rules."""
    narrow(docs.sparkSession)
    rows = docs.select(row_key(id_col, text_col).alias("rid"), blob(text_col).alias("blob"))
    first = rows.groupBy("blob").agg(F.min("rid").alias("rid"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    texts = docs.select(row_key(id_col, text_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(first.hint("shuffle_hash"), "rid").select("blob", "text").mapInArrow(_scan, f"blob binary, findings {FOUND}")
    return found.select("blob", F.lit(rules).alias("rules"), "findings")


def _back(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(id, __blob, __findings, kept columns) of every row, from ledger rows."""
    # repeated rows may have been scanned twice: the smallest of equal findings is any of them
    known = known.where(F.size("findings") > 0).groupBy(F.col("blob").alias("__blob")).agg(F.min("findings").alias("__found"))
    rows = docs.select(F.col(id_col), blob(text_col).alias("__blob"), *keep)
    out = rows.join(known, "__blob", "left")
    return out.select(id_col, "__blob", F.coalesce("__found", F.array().cast(FOUND)).alias("__findings"), *keep)


def _named(found: DataFrame, id_col: str, keep: tuple[str, ...]) -> DataFrame:
    return found.select(id_col, F.col("__blob").alias(free("blob", (id_col, *keep))), F.col("__findings").alias(free("findings", (id_col, *keep))), *keep)


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, blob, findings, columns named in `keep`) of every row: ledger entries and new ones joined back to all paths.

    Nothing is written; `scan` keeps what it finds.
    """
    known = unseen(docs, ledger, rules, id_col, text_col)
    if ledger is not None:
        known = known.unionByName(ledger.where(F.col("rules") == rules).select("blob", "rules", "findings"))
    return _named(_back(docs, known, id_col, text_col, keep), id_col, keep)


def scan(docs: DataFrame, ledger_path: str, rules: str = RULES_VERSION, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, blob, findings, columns named in `keep`) of every row, by way of the ledger at this shared path: texts that it
    has under these rules are not scanned again, and the others are entered."""
    known = extend(ledger_path, docs, rules, id_col, text_col).where((F.col("rules") == rules) & (F.size("findings") > 0))
    many = known.agg(F.count("*").alias("blobs"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings")).first()
    if many.blobs <= FEW[0] and many.findings <= FEW[1]:
        known = F.broadcast(known)
    return _named(_back(docs, known, id_col, text_col, keep), id_col, keep)


def extend(ledger_path: str, docs: DataFrame, rules: str = RULES_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger at this shared path lacks, append it there, and return the whole ledger.

    One writer at a time; a blob that two writers enter at once is there twice, with the same findings.
    """
    spark = docs.sparkSession
    schema = f"blob binary, rules string, findings {FOUND}"
    have = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = have.getFileSystem(spark._jsc.hadoopConfiguration()).exists(have)
    old = spark.read.schema(schema).parquet(ledger_path) if there else None
    unseen(docs, old, rules, id_col, text_col).dropDuplicates(["blob", "rules"]).write.mode("append").parquet(ledger_path)
    return spark.read.schema(schema).parquet(ledger_path)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, with the findings in the text replaced by a mark. A null text stays null."""
    rest = tuple(c for c in docs.columns if c != id_col)
    found = _back(docs, unseen(docs, None, RULES_VERSION, id_col, text_col), id_col, text_col, rest).drop("__blob")
    at = found.columns.index(text_col)
    fields = docs.select(id_col, *rest).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if t is None or not f else redacted(t, f) for t, f in zip(batch.column(at).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [c for k, c in enumerate(batch.columns) if k != 1]
            columns[at - 1] = pa.array(new, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, fields.names)

    return found.mapInArrow(run, fields).select(docs.columns)


def redacted(text: str, found: list[dict]) -> str:
    """The text with each found span replaced by a mark; overlapping spans share one."""
    out, at = [], 0
    for f in sorted(found, key=lambda f: (f["start"], -f["end"])):
        if f["start"] >= at:
            out += [text[at : f["start"]], "[SECRET]"]
            at = f["end"]
        else:
            at = max(at, f["end"])
    return "".join([*out, text[at:]])
