"""Toxicity by a weighted finite-state pattern grammar.

Words fall into classes (insult, threat, target, negation, report). A clause is the string of its word classes; five weighted
transducers read it from left to right, each what the one before wrote:

* insult and threat turn each word of their class into a match, an arc of that weight;
* target counts the words since a target and marks a match that follows one closely as targeted;
* negation marks a match within a few words after a negation as negated;
* reported speech marks every match behind a word of reporting as reported.

They are composed into one machine (`compose`: the product of the states, made before any text is read). A sixth transducer
reads what that machine wrote from right to left and marks matches that closely precede a target. An arc's weight is a vector
that counts which marks it made (the weights of a path are added); the machine's weight of a text is the sum over its clauses.
The score is a logistic function of log(1 + count) of the five marks, fitted by logistic regression towards hand-set weights
on a bounded sample of labelled rows. So every mark has a weight of its own wherever it combines with others: clauses that aim
at someone score more than isolated words, and denied or quoted ones less.

The sample: at most `sample` labelled training rows, those of smallest hash. Stems strongly tied to the toxic label in it join
the insult class. Texts are scored whole, in one narrow pass. Null and empty texts get the score of no evidence. Repeated rows
get a row each; of training rows that share an id the smallest text counts, with the largest label. Without labelled rows the
hand-set weights stand. An empty table gives an empty result. A kept column named like one of the operator's own (features,
score) stays, and the own one gets an underscore behind its name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import byte_texts, carried, free, narrow, pieces, release

#: The lexicon, by class; English first, then German, French and Spanish.
INSULT = """idiot idiots moron morons stupid pathetic worthless loser losers trash scum clown clowns disgusting dumb fool fools
imbecile filth garbage vermin ugly bastard bitch asshole jerk creep retard freak pig pigs coward liar scumbag useless
dummkopf idioten abschaum arschloch versager mistkerl widerlich wertlos trottel
imbécile crétin abruti connard salaud ordure minable débile
idiota imbécil estúpido estúpida basura escoria asqueroso patético inútil payaso""".split()
THREAT = """kill destroy hurt punch stab shoot strangle hang murder crush beat
umbringen töten vernichten tuer détruire frapper matar destruir golpear""".split()
TARGET = "you your yours he she they them him her his their this these those du dich ihr euch sie tu toi vous ils elles usted ustedes ellos ellas".split()
NEGATION = "not no never isn aren wasn don doesn didn without nicht kein keine nie pas jamais nunca jamás".split()
REPORT = "said says say told wrote writes quoted quote claimed called according sagte schrieb dit écrit dijo escribió".split()

OTHER, INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS = range(6)
#: Matches: MATCH, and what is known of them.
MATCH, THREAT_MATCH, TARGETED, NEGATED, REPORTED = 8, 1, 16, 32, 64
SYMBOLS = 128
#: Weights of an arc: which of these marks it makes.
MARKS = ("insult", "threat", "targeted", "negated", "reported")
#: Hand-set weights of the marks, towards which the fit is drawn; the signs are kept.
PRIOR = np.array([3.0, 1.2, 1.2, -2.5, -2.0])
BIAS = -3.0
#: Words between a target or a negation and its match.
NEAR, REACH = 4, 3

_CLAUSE = re.compile(rb"[.!?;:\n]+")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_SPLIT = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


def lexicon() -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for kind, group in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT)):
        out |= {w.encode(): kind for w in group}
    return out


class Transducer:
    """A sequential weighted transducer: arcs[state][symbol] = (symbol written, next state, weight). State 0 is the first.

    A symbol without an arc is written as it is, without weight, and leaves the state as it is.
    """

    def __init__(self, arcs: list[dict[int, tuple[int, int, tuple[int, ...]]]]):
        self.arcs = arcs

    def arc(self, state: int, symbol: int) -> tuple[int, int, tuple[int, ...]]:
        return self.arcs[state].get(symbol) or (symbol, state, NOTHING)

    def run(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """What is written, and the weight of the path."""
        state, out, weight = 0, [], [0] * len(MARKS)
        for symbol in symbols:
            symbol, state, w = self.arc(state, symbol)
            out.append(symbol)
            if w is not NOTHING:
                weight = [a + b for a, b in zip(weight, w, strict=True)]
        return out, weight


def one(mark: str) -> tuple[int, ...]:
    return tuple(int(m == mark) for m in MARKS)


NOTHING = (0,) * len(MARKS)
WORDS_READ = range(6)
MATCHES_READ = [s for s in range(SYMBOLS) if s & MATCH]


def compose(first: Transducer, then: Transducer) -> Transducer:
    """The machine that does what `first` and `then` do one after the other: states are pairs that can be reached."""
    numbers, arcs, todo = {(0, 0): 0}, [{}], [(0, 0)]
    while todo:
        at = todo.pop()
        for symbol in [*WORDS_READ, *MATCHES_READ]:
            middle, a, w = first.arc(at[0], symbol)
            written, b, v = then.arc(at[1], middle)
            if (a, b) not in numbers:
                numbers[a, b] = len(arcs)
                arcs.append({})
                todo.append((a, b))
            weight = tuple(x + y for x, y in zip(w, v, strict=True))
            arcs[numbers[at]][symbol] = (written, numbers[a, b], weight if any(weight) else NOTHING)
    return Transducer(arcs)


def matcher(kind: int, match: int, mark: str) -> Transducer:
    """Turns words of a class into matches."""
    return Transducer([{kind: (match, 0, one(mark))}])


def marker(opens: int, flag: int, mark: str, reach: int | None) -> Transducer:
    """Marks matches that come up to `reach` words behind a word of the class `opens` (None: anywhere behind it).

    State 0: no such word in reach; state k: k more words are.
    """
    arcs: list[dict] = []
    for state in range(2 if reach is None else reach + 1):
        left = state if reach is None else max(0, state - 1)
        here = {}
        for s in [*WORDS_READ, *MATCHES_READ]:
            fresh = state and s & MATCH and not s & flag
            here[s] = (s | flag if fresh else s, left, one(mark) if fresh else NOTHING)
        here[opens] = (opens, 1 if reach is None else reach, NOTHING)
        arcs.append(here)
    return Transducer(arcs)


def machines() -> tuple[Transducer, Transducer]:
    """The composed machine, left to right, and the one that marks matches ahead of a target, right to left."""
    chain = [
        matcher(INSULTS, MATCH, "insult"), matcher(THREATS, MATCH | THREAT_MATCH, "threat"), marker(TARGETS, TARGETED, "targeted", NEAR),
        marker(NEGATIONS, NEGATED, "negated", REACH), marker(REPORTS, REPORTED, "reported", None),
    ]
    return reduce(compose, chain), marker(TARGETS, TARGETED, "targeted", NEAR)


def clause_marks(classes: list[int], both: tuple[Transducer, Transducer]) -> list[int]:
    """Number of marks of each kind in one clause."""
    out, weight = both[0].run(classes)
    _, more = both[1].run(out[::-1])
    return [a + b for a, b in zip(weight, more, strict=True)]


class Grammar:
    """The lexicon with learned stems, and the transducers over it."""

    def __init__(self, stems: tuple[str, ...] = ()):
        self.words = lexicon()
        self.stems = {w.encode() for w in stems}
        self.lengths = sorted({len(w) for w in self.stems})
        self.machines = machines()
        self.triggers = frozenset(w for w, k in self.words.items() if k in (INSULTS, THREATS))

    def kind(self, word: bytes) -> int:
        return self.words.get(word, 0) or (INSULTS if any(word[:n] in self.stems for n in self.lengths) else 0)

    def features(self, text: bytes) -> list[int]:
        """Number of marks of each kind over all clauses of the text."""
        out = [0] * len(PRIOR)
        words = set(text.translate(_SPLIT).split())
        if self.triggers.isdisjoint(words) and all(self.stems.isdisjoint({w[:n] for w in words}) for n in self.lengths):
            return out
        kinds = {w: self.kind(w) for w in words}
        for clause in _CLAUSE.split(text.translate(_LOWER)):
            classes = [kinds[w] for w in _WORD.findall(clause)]
            if INSULTS in classes or THREATS in classes:
                out = [a + b for a, b in zip(out, clause_marks(classes, self.machines), strict=True)]
        return out


def with_features(docs: DataFrame, learned: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns named in `keep`, features array<int>) of every row."""
    narrow(docs.sparkSession)
    kept, own, places = carried(docs, id_col, text_col, keep)
    fields = T.StructType([*own, T.StructField(free("features", (id_col, *keep)), T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(learned)
        for batch in pieces(batches, "__text", 1 << 20):
            found = [grammar.features(t) for t in byte_texts(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in places], pa.array(found, pa.list_(pa.int32()))], fields.names)
        release()

    return kept.mapInArrow(run, fields)


def stems_of(text: bytes) -> set[bytes]:
    """Words of 4 bytes and more, and their beginnings of 4 to 9 bytes that end with a character."""
    words = {w for w in text.translate(_SPLIT).split() if len(w) >= 4}
    return words | {w[:n] for w in words for n in range(4, min(len(w), 10)) if w[n] & 0xC0 != 0x80}


def learned_stems(rows: DataFrame, least: int = 4, ratio: float = 25.0) -> tuple[str, ...]:
    """Stems that toxic rows of the sample hold and others do not: the fewest that cover most of them, taken greedily.

    The texts of the sample's toxic rows come to the driver; their number is bounded by the sample.
    """
    toxic = [stems_of(bytes(r.text, "utf-8")) for r in rows.where("toxic > 0").select("text").distinct().collect()]
    clean = rows.where("toxic <= 0").select("text").distinct()
    seen: Counter[bytes] = Counter()
    for stems in toxic:
        seen.update(stems)
    wanted = frozenset(w for w, n in seen.items() if n >= least)
    if not wanted:
        return ()
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        n = 0
        for batch in pieces(batches, "text"):
            for text in byte_texts(batch.column("text")):
                n += 1
                total.update(stems_of(text) & shared.value)
        total[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["w", "n"])
        release()

    held = {bytes(r.w): r.n for r in clean.mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    others = held.pop(b"", 0)
    odds = lambda w: (seen[w] + 0.5) / (len(toxic) + 1) * (others + 1) / (held.get(w, 0) + 0.5)
    left = [s & {w for w in s & wanted if odds(w) >= ratio} for s in toxic]
    out = []
    while left:
        gain: Counter[bytes] = Counter()
        for stems in left:
            gain.update(stems)
        if not gain:
            break
        best, n = max(gain.items(), key=lambda x: (x[1], len(x[0]), x[0]))
        if n < least:
            break
        out.append(best.decode())
        left = [s for s in left if best not in s]
    return tuple(sorted(out))


def fit(x: np.ndarray, y: np.ndarray, pull: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn towards the hand-set weights; counts enter as log(1 + n)."""
    z = np.c_[np.log1p(x), np.ones(len(x))]
    prior = np.r_[PRIOR, BIAS]
    w = prior.copy()
    strength = pull * max(1, len(x)) ** 0.5 * np.ones(len(w))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(strength), z.T @ (p - y) + strength * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.where(PRIOR > 0, np.maximum(w[:-1], 0), np.minimum(w[:-1], 0)), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> tuple[tuple[str, ...], np.ndarray, float]:
    """Learned insult words, weights and bias from at most `sample` labelled rows among those where `usable` holds."""
    chosen = labels.where("toxic is not null").where(usable).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "toxic").agg(F.min("text").alias("text")).persist()
    try:
        learned = learned_stems(rows)
        seen = with_features(rows, learned, "__id").join(F.broadcast(chosen), "__id").groupBy("features", "toxic").count().collect()
    finally:
        rows.unpersist()
    if len({r.toxic for r in seen}) < 2:
        return learned, PRIOR, BIAS
    x = np.repeat(np.array([r.features for r in seen], float), [r["count"] for r in seen], axis=0)
    y = np.repeat(np.array([float(r.toxic > 0) for r in seen]), [r["count"] for r in seen])
    weights, bias = fit(x, y)
    return learned, weights, bias


def score(docs: DataFrame, model: tuple[tuple[str, ...], np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns named in `keep`, features, score double in 0 to 1) of every row."""
    learned, weights, bias = model
    found = with_features(docs, learned, id_col, text_col, keep)
    features, own = (free(c, (id_col, *keep)) for c in ("features", "score"))
    evidence = F.lit(float(bias))
    for k, w in enumerate(weights):
        evidence = evidence + F.log1p(F.get(features, F.lit(k)).cast("double")) * float(w)
    return found.select(id_col, *keep, features, (1 / (1 + F.exp(-evidence))).alias(own))
