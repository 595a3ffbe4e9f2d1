"""Removal of repeated byte strings, and report of repeated passages, by a depth-limited radix sort of suffixes.

A byte goes if it lies in a string of `least` bytes that starts at another place too, in the same text or another. A passage
is a run of `words` words (white space apart, ASCII case aside) that starts at another place too; passages are reported, not
removed. Sorting all suffixes to that depth would put equal strings side by side; the equal groups are exactly the repeats.
The sort goes from the coarsest digit to the finest, and a pass takes on only groups that still hold more than one suffix and
are not yet known to be equal throughout:

* Suffixes are dealt into blocks by their anchor, the smallest hash among the short grams of the string (leftmost among
  equals), a function of the string alone, and by their distance to it, in steps of least / 3. Within an anchor's blocks the
  leading digit is the core: what all strings of a block have in common. Blocks with a core of their own leave (pass 1).
  Where all blocks of a core have the same span (all they cover), all their strings repeat and they leave as well.
* The others are cut into blocks an eighth as wide, whose cores are longer and closer to the string (pass 2).
* What is still neither single nor equal is told apart by the last digit, the string itself (pass 3).

Digits are 64-bit hashes of 8-byte lanes scrambled before they enter a polynomial (of scrambled words for passages), so a pass
is a count by key; equal digits are not compared byte by byte. Tasks count their own texts first, so a key that a third of
all rows hold is one row for each task. Between passes two bit tables (of up to 2**MOST_BITS bits, broadcast) say which cores
go on; a false bit only means that a unique block is counted in vain, at the price of more rows in the last pass.

Null is the empty text. Repeated rows repeat each other's strings and all their copies go. Texts are handled in slices of 1 MB
whatever their length. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import MASKS, U64, as_long, byte_texts, durable, lanes, mix, narrow, pieces, powers, row_key, salt, text_bytes, word_hashes

#: Bytes handled at once, and rows that a task gathers before it counts them.
SLICE, GATHER = 1 << 20, 1 << 19
MOST_BITS = 28
#: Blocks of the second pass for each one of the first, at most.
FINER = 8
BYTES, WORDS = 0, 1


class Blocks:
    """Blocks of the suffixes of one batch: strings of `least` letters, which are bytes or words."""

    def __init__(self, least: int, unit: int):
        self.least, self.unit, self.slice = least, unit, SLICE
        self.reach = 7 if unit == BYTES and least >= 16 else 0  # a letter's value covers so many more bytes behind it
        self.gram = max(1, min(least, max(self.reach + 1, 2, least // 12)))
        self.finer = min(FINER, max(1, least // 3))
        self.fine = max(1, least // (3 * FINER))
        self.wide = self.fine * self.finer
        self.low = U64((1 << int(self.slice + least).bit_length()) - 1)  # of slices of any length, so that anchors depend on strings only
        self.tag = salt(60 + unit)

    def letters(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A scrambled number for each letter, and the offsets of the texts in letters."""
        if self.unit == WORDS:
            h, text = word_hashes(data, offsets)
            return h, np.searchsorted(text, np.arange(len(offsets)))
        return mix((lanes(data)[: len(data)] & MASKS[self.reach + 1]) + salt(50)), offsets

    def of(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Part]:
        """The blocks of the first pass, slice by slice."""
        values, offsets = self.letters(data, offsets)
        for lo in range(0, max(0, len(values) - self.least + 1), self.slice):
            part = values[lo : lo + self.slice + self.least - 1]
            up, down = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            size = self.gram - self.reach
            grams = mix((sums[size:] - sums[:-size]) * down[: len(sums) - size])[: len(part) - self.gram + 1]
            grams = (grams & ~self.low) | np.arange(len(grams), dtype=U64)
            anchor = (_sliding_min(grams, self.least - self.gram + 1) & self.low).astype(np.int64)
            starts = np.arange(len(anchor))
            text = np.searchsorted(offsets, starts + lo, "right") - 1
            good = starts + lo + self.least <= offsets[1:][text]
            starts, text, anchor = starts[good], text[good], anchor[good]
            if not len(starts):
                continue
            level = (anchor - starts) // self.wide
            new = np.ones(len(starts), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (level[1:] != level[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            yield Part(self, sums, down, text[at], starts[at], starts[np.append(at[1:], len(starts)) - 1], anchor[at], level[at], self.wide, lo - offsets[:-1][text[at]])


class Part:
    """Blocks of one slice: text numbers, first and last starts, anchors, levels, and what turns starts into places of the text."""

    def __init__(self, blocks: Blocks, sums, down, text, first, last, anchor, level, width: int, base):
        self.blocks, self.sums, self.down, self.width = blocks, sums, down, width
        self.text, self.first, self.last, self.anchor, self.level, self.base = text, first, last, anchor, level, base

    def digest(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (self.sums[y - self.blocks.reach] - self.sums[x]) * self.down[x] + self.blocks.tag

    def core(self) -> np.ndarray:
        near = self.anchor - self.level * self.width
        return mix(self.digest(near, near - self.width + 1 + self.blocks.least) + self.level.astype(U64) * salt(20) + salt(100 + self.width))

    def span(self) -> np.ndarray:
        a, p, q = self.anchor, self.first, self.last
        return mix(self.digest(p, q + self.blocks.least) + (a - p).astype(U64) * salt(21) + (a - q).astype(U64) * salt(22) + salt(100 + self.width))

    def only(self, on: np.ndarray) -> Part:
        return Part(self.blocks, self.sums, self.down, self.text[on], self.first[on], self.last[on], self.anchor[on], self.level[on], self.width, self.base[on])

    def finer(self) -> Part:
        """The same starts in blocks of the second pass."""
        k = np.repeat(np.arange(len(self.first)), self.blocks.finer)
        fine = self.blocks.fine
        level = self.level[k] * self.blocks.finer + np.tile(np.arange(self.blocks.finer), len(self.first))
        near = self.anchor[k] - level * fine
        first, last = np.maximum(near - fine + 1, self.first[k]), np.minimum(near, self.last[k])
        out = Part(self.blocks, self.sums, self.down, self.text[k], first, last, self.anchor[k], level, fine, self.base[k])
        return out.only(first <= last)

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digit, block number and start of every string."""
        many = self.last - self.first + 1
        k = np.repeat(np.arange(len(many)), many)
        p = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + self.first[k]
        return mix(self.digest(p, p + self.blocks.least) + salt(23)), k, p


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w successive values."""
    n = len(v)
    if n < w:
        return v[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(U64).max, U64)
    padded[:n] = v
    square = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _split(part: Part, tables) -> tuple[Part, Part]:
    """Blocks whose core's spans are all equal, as far as the bit tables know, and those that go on."""
    bits, equal, mixed = tables
    core = part.core()
    on = _set(mixed, bits, core)
    return part.only(_set(equal, bits, core) & ~on), part.only(on)


def _parts(blocks: list[Blocks], batch: pa.RecordBatch) -> Iterator[Part]:
    data, offsets = text_bytes(batch.column("__text"))
    for b in blocks:
        yield from b.of(data, offsets)


def _cores(blocks: list[Blocks], earlier):
    """Cores of one pass: (core, smallest span, largest span, blocks), counted within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            core, span = (as_long(np.concatenate(x)) for x in zip(*held, strict=True))  # signed, as Spark compares them
            order = np.lexsort((span, core))
            core, span = core[order], span[order]
            start = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
            stop = np.append(start[1:], len(core))
            arrays = [core[start], span[start], span[stop - 1], stop - start]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["core", "low", "high", "n"])

        for batch in pieces(batches, "__text", SLICE):
            for part in _parts(blocks, batch):
                if earlier is not None:
                    part = _split(part, earlier.value)[1].finer()
                if len(part.first):
                    held.append((part.core(), part.span()))
                    size += len(part.first)
            if size >= GATHER:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _bit_tables(groups: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of the cores that go on: (number of bits as a power of 2, table of equal spans, table of unequal ones)."""
    spark = groups.sparkSession
    many = groups.count()
    bits = min(MOST_BITS, max(16, int(many * 16).bit_length()))
    chunk = 12
    place = F.shiftrightunsigned("core", 64 - bits)
    rows = groups.select((F.col("low") != F.col("high")).alias("mixed"), F.shiftright(place, chunk).cast("int").alias("chunk"), place.bitwiseAND((1 << chunk) - 1).cast("int").alias("bit")).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            mixed, at, bit = (np.asarray(batch.column(k)) for k in range(3))
            code = at.astype(np.int64) * 2 + mixed
            order = np.argsort(code, kind="stable")
            code, bit = code[order], bit[order]
            cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else []
            for i, j in zip(cuts, [*cuts[1:], len(code)], strict=True):
                held.setdefault((bool(code[i] % 2), int(code[i] // 2)), np.zeros(1 << chunk, bool))[bit[i:j]] = True
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in keys], pa.bool_()), pa.array([c for _, c in keys], pa.int32()), pa.array([np.packbits(held[k], bitorder="little").tobytes() for k in keys], pa.binary())], ["mixed", "chunk", "bits"])

    tables = [np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)]
    size = 1 << (chunk - 3)
    for r in rows.repartition(spark.sparkContext.defaultParallelism, "chunk").mapInArrow(pack, "mixed boolean, chunk int, bits binary").toLocalIterator():
        tables[r.mixed][r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits, tables[0], tables[1]


def _set(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = keys >> U64(64 - bits)
    return (table[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def _set(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = keys >> U64(64 - bits)
    return (table[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def _where(first: np.ndarray, last: np.ndarray, unit: int, sure) -> np.ndarray:
    """First start, unit, whether it is known to repeat, and number of further starts, in one number."""
    return (first << 22) | (unit << 21) | (np.asarray(sure).astype(np.int64) << 20) | (last - first)


def _strings(blocks: list[Blocks], tables, finer):
    """What is left after two passes: (key, rid, place); see _where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {b.unit: [] for b in blocks}

        def out(unit: int) -> pa.RecordBatch:
            key, rid, first, last = (np.concatenate(x) for x in zip(*held[unit], strict=True))
            held[unit] = []
            order = np.lexsort((first, rid, key))
            key, rid, first, last = key[order], rid[order], first[order], last[order]
            start = np.append(True, key[1:] != key[:-1])
            group = np.cumsum(start) - 1
            many = np.bincount(group)[group] > 1
            # one row for the key; all of a key that repeats here are certain and go on as runs with keys of their own
            k = np.flatnonzero(start)
            sure = np.flatnonzero(many)
            order = np.lexsort((first[sure], rid[sure]))
            r, a, b = rid[sure][order], first[sure][order], last[sure][order]
            new = np.append(True, (r[1:] != r[:-1]) | (a[1:] > b[:-1] + 1) | (a[1:] >> 18 != a[:-1] >> 18))[: len(r)]
            run_at = np.flatnonzero(new)
            ends = np.maximum.reduceat(b, run_at) if len(r) else b
            own = mix(r[run_at].view(U64) + a[run_at].astype(U64) * salt(24) + salt(25 + unit))
            at = np.concatenate([_where(first[k], last[k], unit, many[k]), _where(a[run_at], ends, unit, True)])
            columns = [np.concatenate([as_long(key[k]), as_long(own)]), np.concatenate([rid[k], r[run_at]]), at]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "rid", "at"])

        for batch in pieces(batches, "__text", SLICE):
            rids = np.asarray(batch.column("rid"))
            for part in _parts(blocks, batch):
                unit = part.blocks.unit
                equal, on = _split(part, tables.value)
                equal_too, on = _split(on.finer(), finer.value)
                for x in (equal, equal_too):
                    held[unit].append((x.span(), rids[x.text], x.first + x.base, x.last + x.base))
                key, k, p = on.strings()
                held[unit].append((key, rids[on.text[k]], p + on.base[k], p + on.base[k]))
            for unit in held:
                if sum(len(x[0]) for x in held[unit]) >= GATHER:
                    yield out(unit)
        for unit in held:
            if sum(len(x[0]) for x in held[unit]):
                yield out(unit)

    return run


def repeats(docs: DataFrame, least: int = 400, words: int = 50, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(rid, at): starts of strings of `least` bytes, and of `words` words, that start elsewhere too; `ranges` reads them."""
    spark = docs.sparkSession
    blocks = [Blocks(least, BYTES), Blocks(words, WORDS)]
    texts = docs.select(row_key(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("__text")).where(F.octet_length("__text") >= min(least, 2 * words - 1))
    tables: list = [None]
    for name in ("cores", "finer"):
        cores = texts.select("__text").mapInArrow(_cores(blocks, tables[-1]), "core long, low long, high long, n long")
        groups = cores.groupBy("core").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("n > 1").select("core", "low", "high")
        tables.append(spark.sparkContext.broadcast(_bit_tables(durable(groups, name))))
    rows = texts.mapInArrow(_strings(blocks, *tables[1:]), "key long, rid long, at long")
    sure = F.shiftright("at", 20).bitwiseAND(1)
    return rows.withColumn("all", F.sum(sure + 1).over(Window.partitionBy("key"))).where("all > 1").select("rid", "at")


def ranges(at: np.ndarray, unit: int, least: int) -> list[tuple[int, int]]:
    """The maximal runs of letters that the strings of one text cover."""
    at = at[(at >> 21) & 1 == unit]
    if not len(at):
        return []
    first = at >> 22
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate((first + (at & ((1 << 20) - 1)) + least)[order])
    new = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
    return list(zip(first[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))


def dedup(docs: DataFrame, least: int = 400, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, removed array<struct<start, end>> in bytes, kept binary, passages array<struct<start, end>> in
    words) of every row."""
    narrow(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    found = repeats(docs, least, words, text_col, id_col).groupBy("rid").agg(F.collect_list("at").alias("runs"))
    texts = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    joined = texts.join(found.hint("shuffle_hash"), "rid", "left").select(id_col, "__text", "runs")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", SLICE):
            size, removed, kept, passages = [], [], [], []
            runs = batch.column("runs")
            for k, text in enumerate(byte_texts(batch.column("__text"))):
                at = np.asarray(runs[k].values) if runs[k].is_valid else np.zeros(0, np.int64)
                spans, p, out = ranges(at, BYTES, least), 0, []
                for a, b in spans:
                    out.append(text[p:a])
                    p = b
                size.append(len(text))
                removed.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join([*out, text[p:]]))
                passages.append([{"start": a, "end": b} for a, b in ranges(at, WORDS, words)])
            arrays = [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_bytes", "removed", "kept", "passages"])

    span = "array<struct<start:long,end:long>>"
    return joined.mapInArrow(run, f"`{id_col}` {joined.schema[0].dataType.simpleString()}, n_bytes long, removed {span}, kept binary, passages {span}")
