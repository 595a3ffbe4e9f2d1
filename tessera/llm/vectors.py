"""Approximate nearest neighbours by randomly rotated one-bit codes (the RaBitQ estimator).

A vector is normalised, turned by one random rotation (fixed by a seed) and kept as the signs of its coordinates, packed
into bits, with two numbers: its norm and the inner product of the turned unit vector with its code. A turned query is cut
into four planes of bits; the inner product of code and query is then the weighted count of the bits that the code shares with
each plane. Divided by the agreement of the vector with its code, this estimates the inner product of the unit vectors without
bias; the error is at most `spread` * (sqrt((1 - c**2) / (c**2 * (d - 1))) + the planes' step / sqrt(12)) with high
probability, c being the agreement. Of each batch of vectors the best guesses are reranked first, then those whose upper bound
reaches the k-th best score so far; reranking uses the original vectors in double precision, so scores are exact and ties go
to the smaller id. A guess that is not finite, as products of huge components can be, is always reranked.

Queries are a stated set, taken in blocks of `block_bytes` at most (what a broadcast holds is bounded), one after the other
where there are several. Every task keeps the best k for each query of its vectors, and the best k of these partial lists are
merged by query. Every code is compared with every query: a recall that holds without assumptions about clusters.

Rows without an id and vectors that are null, zero, or hold null or non-finite components take no part. Vectors of several lengths may be mixed; only
those of a query's length are its candidates. Rows with a query's own id are not its candidates. Equal query rows are one query;
unlike vectors of one query id have the nearest of all of them. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import U64, durable

#: Vectors of a task taken at once, and queries compared with them at once.
ROWS, WIDE = 4096, 256
#: Pairs scored at once.
PAIRS = 1 << 15
#: Bits that a coordinate of a query keeps.
PLANES = 4


@lru_cache(8)
def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def norms_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; components are scaled first, so that their squares stay finite and above zero."""
    top = np.abs(x).max(axis=1, keepdims=True)
    y = x / top
    norm = np.linalg.norm(y, axis=1)
    with np.errstate(over="ignore"):
        return y / norm[:, None], norm * top[:, 0]


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : -(-bits.shape[1] // 8)] = np.packbits(bits, axis=1)
    return out.view(U64)


def encode(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms and inner products of the turned unit vectors with their codes."""
    unit, norm = norms_of(x)
    y = unit @ rotation(x.shape[1], seed).T
    return packed(y > 0), norm, np.abs(y).sum(axis=1) / math.sqrt(x.shape[1])


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of a batch."""
    sizes = np.asarray(pc.list_value_length(column))
    flat, ends = np.asarray(column.flatten()), np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat.reshape(-1, d) if len(rows) == len(sizes) else flat[(ends[rows] - d)[:, None] + np.arange(d)]


def index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """(id, vector array<double>, code binary, norm double, agreement double) of every usable row."""
    kept = usable(vectors.select(id_col, vec_col).where(F.col(id_col).isNotNull()), vec_col).select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, norms, agreements = [b""] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for _, rows, x in by_length(batch.column(1)):
                    code, norms[rows], agreements[rows] = encode(x, seed)
                    for r, c in zip(rows.tolist(), code, strict=True):
                        codes[r] = c.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(norms), pa.array(agreements)], [id_col, "vector", "code", "norm", "agreement"])

    return kept.mapInArrow(run, f"`{id_col}` long, vector array<double>, code binary, norm double, agreement double")


def search(codes: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", seed: int = 7, spread: float = 1.9, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for every row of the index where `is_query` holds."""
    spark = codes.sparkSession
    chosen = codes.where(is_query).select(id_col, "vector").distinct()
    size = chosen.agg(F.sum(F.size("vector") + 4).alias("n")).first().n or 0
    blocks = max(1, math.ceil(8 * size / block_bytes))
    if blocks > 1:
        codes = durable(codes, "codes")  # they are read once for each block
    kind = f"query_id long, `{id_col}` long, score double"
    parts = []
    for b in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        ids, column = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
        shared = spark.sparkContext.broadcast({d: (ids[at], x.copy()) for d, at, x in by_length(column)})
        found = codes.mapInArrow(_nearest(shared, k, seed, spread, id_col), kind)
        if blocks > 1:
            found = durable(_best(found, k, id_col), "nearest")
            shared.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    found = _best(parts[0], k, id_col) if blocks == 1 else reduce(DataFrame.unionByName, parts)
    return found.select("query_id", "rank", id_col, "score")


def _best(found: DataFrame, k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


class Queries:
    """Queries of one length in a task, and the best candidates found for each so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, seed: int, spread: float):
        self.ids, self.q, self.k, self.spread, self.d = ids, q, k, spread, q.shape[1]
        unit, self.norms = norms_of(q)
        turned = unit @ rotation(self.d, seed).T
        low = turned.min(axis=1, keepdims=True)
        self.step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-30)
        level = np.rint((turned - low) / self.step).astype(np.uint8)
        self.planes = [packed((level >> p) & 1) for p in range(PLANES)]
        self.low, self.total = low, (low * self.d + self.step * level.sum(axis=1, keepdims=True))
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def guesses(self, lo: int, hi: int, code: np.ndarray) -> np.ndarray:
        """Inner products of the turned unit queries with the codes, from packed bits."""
        shared = np.zeros((hi - lo, len(code)), np.uint32)
        for p, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                shared += np.bitwise_count(plane[lo:hi, w, None] & code[None, :, w]).astype(np.uint32) << p
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        out = shared * self.step[lo:hi]
        out += self.low[lo:hi] * ones
        out *= 2
        out -= self.total[lo:hi]
        out /= math.sqrt(self.d)
        return out

    def add(self, own: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray, agreement: np.ndarray) -> None:
        k, slack = self.k, np.sqrt(np.maximum(0, 1 - agreement**2) / (agreement**2 * max(1, self.d - 1)))
        with np.errstate(all="ignore"):
            for lo in range(0, len(self.ids), WIDE):
                hi = min(len(self.ids), lo + WIDE)
                guess = self.guesses(lo, hi, code)
                guess /= agreement
                room = (slack + self.step[lo:hi] / math.sqrt(12) / agreement) * self.spread
                # bounds of inner products with the unit query, where ranks are the same
                guess *= norm
                room *= norm
                todo = own[None, :] != self.ids[lo:hi, None]
                if len(own) > 2 * k:  # the best guesses first: their scores set the bar for the others
                    first = np.zeros_like(todo)
                    np.put_along_axis(first, np.argpartition(np.where(todo, -guess, np.inf), 2 * k, axis=1)[:, : 2 * k], True, 1)
                    self.rerank(lo, first & todo, x, norm, own)
                    todo &= ~first
                room += guess
                # not below, so that what is not finite counts as near
                self.rerank(lo, todo & ~(room < (self.floor[lo:hi] / self.norms[lo:hi])[:, None]), x, norm, own)

    def rerank(self, lo: int, chosen: np.ndarray, x: np.ndarray, norm: np.ndarray, own: np.ndarray) -> None:
        """Exact scores of the chosen pairs, merged into the best of their queries."""
        q, k, d = self.q, self.k, self.d
        if np.count_nonzero(chosen) * 16 > chosen.size:  # many: one product of matrices costs less than picking pairs
            hi = lo + len(chosen)
            far = q[lo:hi] @ x.T
            far += 1e-9 * self.norms[lo:hi, None] * norm
            chosen = chosen & ~(far < self.floor[lo:hi, None])
        (who, what), likely = np.nonzero(chosen), []
        for i in range(0, len(who), PAIRS):
            a, b = lo + who[i : i + PAIRS], what[i : i + PAIRS]
            far = np.einsum("ij,ij->i", q[a], x[b]) < self.floor[a] - 1e-9 * self.norms[a] * norm[b]  # rounding is far below this
            likely.append(i + np.flatnonzero(~far))
        likely = np.concatenate([np.zeros(0, np.int64), *likely])
        who, what = who[likely], what[likely]
        score = np.zeros(len(who))
        for i in range(0, len(who), PAIRS // 16):
            a, b = q[lo + who[i : i + PAIRS // 16]].T, x[what[i : i + PAIRS // 16]].T
            for c in range(d):  # components in order: a score does not depend on the layout of a batch
                score[i : i + PAIRS // 16] += a[c] * b[c]
        cuts = np.searchsorted(who, np.arange(len(chosen) + 1)).tolist()
        for j in np.unique(who).tolist():
            a, b = cuts[j], cuts[j + 1]
            s = np.concatenate([self.best[lo + j][0], score[a:b]])
            i = np.concatenate([self.best[lo + j][1], own[what[a:b]]])
            order = np.lexsort((i, -s))[:k]
            self.best[lo + j] = (s[order], i[order])
            if len(order) == k and np.isfinite(s[order[-1]]):
                self.floor[lo + j] = s[order[-1]]


def _nearest(shared, k: int, seed: int, spread: float, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {d: Queries(ids, q, k, seed, spread) for d, (ids, q) in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own, codes = np.asarray(part.column(0)), part.column(2).to_pylist()
                norm, agreement = np.asarray(part.column(3)), np.asarray(part.column(4))
                for d, rows, x in by_length(part.column(1)):
                    if d in asked:
                        code = np.frombuffer(b"".join([codes[r] for r in rows.tolist()]), U64).reshape(len(rows), -1)
                        asked[d].add(own[rows], x, code, norm[rows], agreement[rows])
        for found in asked.values():
            ids, s = (np.concatenate([b[c] for b in found.best]) for c in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(found.ids, [len(b[0]) for b in found.best]), pa.int64()), pa.array(ids, pa.int64()), pa.array(s)], ["query_id", id_col, "score"])

    return run
