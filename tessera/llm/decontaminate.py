"""Benchmark decontamination as a prefix-filtered set join.

A window is `length` consecutive words of an item (an item of fewer words is one window). A window occurs in a text only
if all its words do, so with containment 1 a prefix of one word is enough: the word of the window that is rarest in the
whole corpus. Texts are probed with these rarest words only; each hit gives the place where the window would start
(positional bound: it must not start before the text), the text must hold the whole window (length bound), and the words
are then compared exactly.

The benchmark is taken in blocks of at most `block_bytes`, so what a broadcast holds is bounded whatever its size; each
block is one narrow pass over the documents, and no text is shuffled.

Nulls and texts without words: no words, nothing hit. Items without words match nothing; an item with a null id hits
words but is not listed. Repeated rows get a row each, repeated items count once. Empty tables give empty or clean rows. A text
of any length is read whole, a long one alone in its batch. A kept column named like one of the operator's own stays, and the
own one gets an underscore behind its name.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import byte_texts, carried, free, narrow, pieces, release

#: ASCII letters to lower case; every other ASCII byte but digits becomes a space; the rest stays.
WORDS = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))
SPAN = "array<struct<start:int,end:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def windows(words: list[bytes], length: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))]


def corpus_counts(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of `vocabulary` occurs in all texts; counted where the texts are, summed by word."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in pieces(batches, "t", 1 << 20):
            found = Counter(words_of(b"\n".join(byte_texts(batch.column("t")))))
            for w in found.keys() & shared.value:
                total[w] += found[w]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["w", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "w binary, n long")
    return {bytes(w): n for w, n in rows.groupBy("w").agg(F.sum("n")).collect()}


def plans(items: list[tuple[str | None, bytes]], length: int, counts: dict[bytes, int]) -> dict[bytes, list]:
    """Rarest word -> [(offset in the window, window length, {window: item ids})]."""
    out: dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], set[str]]]] = defaultdict(dict)
    for item, text in items:
        for window in windows(words_of(text), length):
            offset = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i]))
            ids = out[window[offset]].setdefault((offset, len(window)), {}).setdefault(window, set())
            if item is not None:
                ids.add(item)
    return {w: [(o, n, table) for (o, n), table in by.items()] for w, by in out.items()}


def occurrences(words: list[bytes], probe: dict[bytes, list], prefix: frozenset[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Maximal runs of hit words, and the items of all windows that occur."""
    hits = prefix.intersection(words)
    spans: list[tuple[int, int]] = []
    found: set[str] = set()
    if hits:
        for i, w in enumerate(words):
            if w in hits:
                for offset, n, table in probe[w]:
                    start = i - offset
                    if start >= 0 and start + n <= len(words) and (ids := table.get(tuple(words[start : start + n]))) is not None:
                        spans.append((start, start + n))
                        found |= ids
    return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, benchmark: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns named in `keep`, n_words long, spans of hit words, items array<string>, sorted) of every row of `docs`."""
    spark = docs.sparkSession
    narrow(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("t")).where("t is not null").dropDuplicates()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    kept, own, places = carried(docs, id_col, text_col, keep)
    out = kept.select("*", F.lit(None).cast("long").alias("__n_words"), F.lit(None).cast(SPAN).alias("__spans"), F.lit(None).cast("array<string>").alias("__items"))
    taken = tuple(f.name for f in own)
    found = [T.StructField(free(f.name[2:], taken), f.dataType) for f in out.schema.fields[-3:]]
    between, done = out.schema, T.StructType([*own, *found])
    for k in range(blocks):
        block = [(r.item, bytes(r.t, "utf-8")) for r in items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k).toLocalIterator()]
        vocabulary = frozenset(w for _, t in block for w in words_of(t))
        probe = plans(block, length, corpus_counts(docs, vocabulary, text_col))
        shared = spark.sparkContext.broadcast((probe, frozenset(probe)))

        last = k == blocks - 1
        kind, chosen = (done, places) if last else (between, [*range(len(between) - 3)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, kind=kind, chosen=chosen) -> Iterator[pa.RecordBatch]:
            probe, prefix = shared.value
            for batch in pieces(batches, "__text", 1 << 20):
                counts, all_spans, all_items = [], [], []
                old = zip(batch.column("__spans").to_pylist(), batch.column("__items").to_pylist(), strict=True)
                for text, (spans, found) in zip(byte_texts(batch.column("__text")), old, strict=True):
                    words = words_of(text)
                    new, ids = occurrences(words, probe, prefix)
                    if spans:
                        new = merged(new + [(s["start"], s["end"]) for s in spans])
                    counts.append(len(words))
                    all_spans.append([{"start": a, "end": b} for a, b in new])
                    all_items.append(sorted(ids | set(found or ())))
                arrays = [pa.array(counts, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(all_items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in chosen], *arrays], kind.names)
            release()

        out = out.mapInArrow(run, kind)
    return out


def hit_words(spans: str = "spans"):
    """Number of words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
