"""What the corpus operators share: durable tables, Arrow text batches and vectorised hashing of texts.

Hashes are 64 bits wide and depend on bytes only, so every executor and every retry computes the same ones.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64


# --- tables that outlive an executor -------------------------------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see (spark.checkpoint.dir); a temporary one only in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage and survives lost executors. Shuffles of the write
    are given up when it is done, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def narrow(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session hold at most `rows` rows: texts are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A non-null key of a row: equal for repeated rows, different for rows that share only the id."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def carried(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, list[T.StructField], list[int]]:
    """Rows of (__text as string, id, columns to keep), the fields of the latter and their places in a row. A text that is
    kept is not there twice: it is the most that a batch holds."""
    fields = docs.select(id_col, *keep).schema.fields
    once = [c == text_col and f.dataType == T.StringType() for c, f in zip((id_col, *keep), fields, strict=True)]
    rest = [c for c, same in zip((id_col, *keep), once, strict=True) if not same]
    places = [0 if same else 1 + rest.index(c) for c, same in zip((id_col, *keep), once, strict=True)]
    return docs.select(F.col(text_col).cast("string").alias("__text"), *rest), fields, places


def free(name: str, taken: tuple[str, ...]) -> str:
    """A name for a column of an operator's own: with underscores behind it where a kept column has that name."""
    while name in taken:
        name += "_"
    return name


# --- Arrow batches -------------------------------------------------------------------------------------------------

def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece hold about `limit` bytes (one longer text stays alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 offsets. Null is the empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def byte_texts(column: pa.Array) -> list[bytes]:
    """Each text as bytes; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Give freed pages back to the system, where the C library can: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --- hashing -------------------------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salt(k: int) -> np.uint64:
    return mix(np.array([k], U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))[0]


_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, U64(base))
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: Upper-case ASCII letters to lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a lane.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, as a number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


#: Bytes of words split at white space (space, tab, line feed, vertical tab, form feed, carriage return).
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all maximal runs of bytes for which `inside` holds; no run crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    on = inside[data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = on[cuts]
    last = on.copy()
    last[:-1] &= ~on[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    last[cuts] = on[cuts]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each white-space separated word, ASCII letters in lower case, in text order.

    A word is cut into lanes of 8 bytes; its hash is the sum of the scrambled lanes, each with its place and the word's
    length mixed in. Unlike a polynomial modulo a power of two it has no words that collide by their structure.
    """
    start, end, doc = word_spans(data, offsets, SPACED)
    size = end - start
    lane = lanes(LOWER[data] if lower else data)
    h = mix((lane[start] & MASKS[np.minimum(size, 8)]) + size.astype(U64) * salt(30))
    more = np.flatnonzero(size > 8)
    k = 0
    while len(more):
        k += 1
        left = size[more] - 8 * k
        h[more] += mix(mix((lane[start[more] + 8 * k] & MASKS[np.minimum(left, 8)]) + salt(31)) + salt(40 + k))
        more = more[left > 8]
    return mix(h), doc


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
