"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that no vocabulary token holds can never be bridged by a merge: every merge makes a
vocabulary token, so no intermediate or final token spans such a pair. Cutting there and encoding the fragments alone
gives the ids of the whole. Two kinds of forced cut are used:

* before a single space between two visible characters: the pre-tokenizer always starts a piece there, and the pair
  (any byte, space) is checked against the vocabulary; texts are cut there first;
* inside a piece of the pre-tokenizer, at every forbidden byte pair; long junk runs fall apart into short fragments.

Fragments recur, so their ids are kept in a bounded table for each task. No shuffle takes place. Texts that are null
count as empty and get no ids. The decoder joins the bytes of the tokens and reads them as UTF-8.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.shared import carried, free, narrow, pieces, release

#: The published pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a task keeps, and their bytes, before it starts its table anew.
KEPT, KEPT_BYTES = 1 << 17, 24 << 20


def byte_letters() -> list[str]:
    """The published mapping of the 256 bytes to visible characters: printable ones stay, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.ids = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.alone = Tokenizer(BPE(spec["model"]["vocab"], merges))  # no pre-tokenizer: it sees one fragment at a time
        self.letters = dict(enumerate(byte_letters()))
        top = max([*self.ids.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * (top + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.bridged = np.zeros((256, 256), bool)
        for token in self.ids:
            for a, b in zip(token, token[1:], strict=False):
                self.bridged[a, b] = True
        self.forced = ~self.bridged
        self.pieces = regex.compile(PATTERN).findall
        # visible characters after which a space is forced to start anew: no token has a space behind their last byte
        free = [c for c in map(chr, range(33, 0x800)) if not c.isspace() and not self.bridged[c.encode()[-1], 32]]
        self.cut = re.compile(rf" (?=\S)(?<=[{re.escape(''.join(free))}] )") if free else None
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str | int, bytes] = {}  # ids of chunks and of special tokens, as int32 bytes
        self.older: dict[str | int, bytes] = {}
        self.short: dict[bytes, bytes] = {}  # ids of fragments
        self.sizes = {"known": 0, "short": 0}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks: cut into pieces, then at every byte pair that no token holds; each distinct fragment
        is encoded once and alone, and the ids of a chunk are those of its fragments end to end."""
        # chunks between forced cuts keep their pieces when they are laid end to end, so one call finds those of all
        joined = [c for c in chunks if c[0] == " " and not c[-1].isspace()]
        alone = [c for c in chunks if c[0] != " " or c[-1].isspace()]
        parts = self.pieces("".join(joined))
        for c in alone:
            parts += self.pieces(c)
        chunks = joined + alone
        data = "".join(chunks).encode()
        raw = np.frombuffer(data, np.uint8)
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = self.forced[raw[:-1], raw[1:]]
        sizes = lambda xs: np.fromiter(map(len, xs if data.isascii() else map(str.encode, xs)), np.int64, len(xs))
        cut[np.cumsum(sizes(parts))] = True
        ends = np.flatnonzero(cut)
        at = ends.tolist()
        fragments = [data[i:j] for i, j in zip(at, at[1:], strict=False)]
        fresh = list(set(fragments) - self.short.keys())
        if len(self.short) + len(fresh) > 2 * KEPT or self.sizes["short"] > KEPT_BYTES:
            self.short.clear()
            self.sizes["short"] = 0
            fresh = list(set(fragments))
        self.sizes["short"] += 5 * sum(map(len, fresh))  # the fragment, and its ids at most
        coded = self.alone.encode_batch_fast([f.decode("latin-1").translate(self.letters) for f in fresh], add_special_tokens=False)
        self.short.update(zip(fresh, [array("i", e.ids).tobytes() for e in coded], strict=True))
        ids = list(map(self.short.__getitem__, fragments))
        stops = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=stops[1:])
        stops = stops[np.searchsorted(ends, np.append(0, np.cumsum(sizes(chunks))))].tolist()
        flat = b"".join(ids)
        return {c: flat[i:j] for c, i, j in zip(chunks, stops, stops[1:], strict=False)}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text; strings of special tokens become their ids, as the library does by default."""
        specials = self.specials
        rows: list[list[str | int]] = []
        for text in texts:
            row: list[str | int] = []
            at = 0
            for m in specials.finditer(text) if specials else ():
                row += [*self._chunks(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            row += self._chunks(text[at:] if at else text)
            rows.append(row)
        missing = set().union(*rows) - self.known.keys()
        if len(self.known) + len(missing) > KEPT or self.sizes["known"] > KEPT_BYTES:  # the entries in use now and their elders stay, older ones go
            self.known, self.older, self.sizes["known"] = {}, self.known, 0
            missing = set().union(*rows)
        self.sizes["known"] += 2 * sum(len(c) for c in missing if isinstance(c, str))  # the chunk and its ids, about
        self.known |= {c: self.older[c] for c in missing & self.older.keys()}
        missing -= self.older.keys()
        marks = {c for c in missing if isinstance(c, int)}
        self.known |= {i: np.int32(i).tobytes() for i in marks}
        if plain := list(missing - marks):
            self.known |= self._learn(plain)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, row)), np.int32) for row in rows]

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.cut is None:
            return [text]
        first, *rest = self.cut.split(text)
        return [first, *[" " + c for c in rest]]

    def forget(self) -> None:
        """Free the tables and give their pages back: the worker may go on with other work."""
        self.known, self.older, self.short = {}, {}, {}
        self.sizes = {"known": 0, "short": 0}
        release()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(file: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(file)


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=ends[1:])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def tokenize(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns named in `keep`, ids array<int>, decoded string) of every row; a null text is empty.

    Empty table: empty result. Repeated rows: one result row each. Very long texts are encoded whole, alone in their batch.
    A kept column named ids or decoded stays, and the own one gets an underscore behind its name. `file` must exist on every
    executor.
    """
    narrow(docs.sparkSession)
    kept, own, places = carried(docs, id_col, text_col, keep)
    ids_name, text_name = (free(c, (id_col, *keep)) for c in ("ids", "decoded"))
    fields = T.StructType([*own, T.StructField(ids_name, T.ArrayType(T.IntegerType())), T.StructField(text_name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(file)
        for batch in pieces(batches, "__text", 2 << 20):
            ids = bpe.encode_all([t or "" for t in batch.column("__text").to_pylist()])
            texts = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in places], id_lists(ids), texts], fields.names)
        bpe.forget()

    return kept.mapInArrow(run, fields)
