"""Language-model scoring: a causal self-attention model in numpy over subword ids.

Subwords tile the bytes of a text: a word with the one space before it, or a run of other white space, cut every `PIECE`
bytes. Their counts over all training texts give the subword table (the TABLE most frequent, a bound on what is broadcast).
The model reads ids: the IDS most frequent subwords have an embedding of their own, the others share that of their class
(shape and frequency bin). It predicts an id in three steps: its class, its slot within the class (up to SLOTS, the most
frequent subwords of a class have one of their own), both by a softmax over the attention's state, and the id within its slot
by add-one counts. Subwords outside the table share a class for each shape, where counted ones have their count, met in a
join, and what is left over is spelled byte by byte. An end mark closes every text, so the score is the log10 probability of
the whole text, and over all texts of a given length of ids the probabilities add up to one.

The attention is one causal layer. Texts are scored in overlapping windows of WINDOW ids: each window scores its last STRIDE
ids and sees the WINDOW - STRIDE ones before them, so each id is scored once; windows are taken in batches under one mask. The
model is trained with every window of every training text; every task takes Adam steps from the common start over its windows
as they come, and the models are averaged by their numbers of windows. So the fit depends on how the input is dealt into
tasks (it is the same for the same files and settings).

The word unigram baseline counts all words of the training texts. The HEAD most frequent words (a bound on what is
broadcast) are looked up where the texts are; rarer words, few for each text, meet their counts in a join.

Null is the empty text: one end mark. Texts are read whole, a very long one alone in its batch. Repeated rows get a row each;
extra columns are ignored. Without training texts counts are zero and the model stays at its start. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import SPACED, U64, as_long, durable, pieces, row_key, text_bytes, word_hashes

PIECE, TABLE, HEAD, GATHER = 7, 1 << 18, 1 << 20, 1 << 21
WINDOW, STRIDE, WIDTH = 24, 16, 16
#: Classes: shape (2 x 2) by frequency bin, spelled subwords by shape, end mark, start mark.
BINS = 6
SPELLED, END, START = 4 * BINS, 4 * BINS + 4, 4 * BINS + 5
CLASSES = START + 1
#: Subwords with an embedding of their own, and slots of a class, of which OWN hold one subword where it has more.
IDS, SLOTS, OWN = 2048, 32, 24
WORD, SUBWORD = 0, 1


# --- subwords ------------------------------------------------------------------------------------------------------

def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key (bytes and length in one number) and text number of every subword, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    word = SPACED[data]
    gap = ~word
    before = np.append(False, word[:-1])
    new = first | (gap & before) | (word & ~before)
    # a word after a lone space belongs to the unit that the space opens
    lone = np.zeros(n, bool)
    lone[1:] = (data[:-1] == 32) & new[:-1] & word[1:] & ~first[1:]
    new &= ~lone
    at = np.flatnonzero(new)
    unit = np.repeat(at, np.diff(np.append(at, n)))
    start = np.flatnonzero((np.arange(n) - unit) % PIECE == 0)
    size = np.diff(np.append(start, n))
    padded = np.append(data, np.zeros(PIECE, np.uint8))
    key = size.astype(U64) << U64(8 * PIECE)
    for k in range(PIECE):
        key |= np.where(size > k, padded[start + k], 0).astype(U64) << U64(8 * k)
    return key, np.searchsorted(offsets, start, "right") - 1


def shape(key: np.ndarray) -> np.ndarray:
    """0 to 3: does it open with a space; is it of full length."""
    return 2 * ((key & U64(255)) == 32).astype(np.int64) + ((key >> U64(8 * PIECE)) == PIECE)


class Table:
    """Embedding rows, classes and slots of the subwords kept, and their log10 probabilities within their slots.

    `rest` holds, for each shape, how many counted subwords are not kept and how often they occur: those of the shape have
    (count + (many + 1) * spelled) / (occurrences + many + 1), which is what is spelled where all are kept.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rest: np.ndarray | None = None):
        self.rest = np.zeros((4, 2), np.int64) if rest is None else rest
        order = np.argsort(keys)
        self.keys, counts = keys[order], counts[order].astype(float)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        mass = np.cumsum(-np.sort(-counts)) / max(1.0, counts.sum())
        bins = np.minimum(BINS - 1, (mass[rank] * BINS).astype(np.int64)) if len(counts) else rank
        self.classes = (shape(self.keys) * BINS + bins).astype(np.uint8)
        order = np.lexsort((rank, self.classes))
        place = np.empty(len(counts), np.int64)
        sizes = np.bincount(self.classes, minlength=CLASSES)
        place[order] = np.arange(len(counts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        shared = (place >= OWN) & (sizes[self.classes] > SLOTS)
        slot = np.where(shared, OWN + place % (SLOTS - OWN), place)
        self.codes = (self.classes.astype(np.int64) * SLOTS + slot).astype(np.uint16)
        self.slots = np.clip(sizes, 1, SLOTS)
        total = np.bincount(self.codes, counts + 1, CLASSES * SLOTS)
        self.within = np.log10((counts + 1) / total[self.codes])
        self.rows = np.where(rank < IDS, CLASSES + rank, self.classes).astype(np.uint16)
        spelled = np.ones(256)
        for k in range(PIECE):
            on = (self.keys >> U64(8 * PIECE)) > k
            spelled += np.bincount(((self.keys[on] >> U64(8 * k)) & U64(255)).astype(np.int64), counts[on], 256)
        self.bytes = np.log10(spelled / spelled.sum())

    def read(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding row, code (class and slot) and log10 probability within the slot; for subwords whose class `open`
        marks, that of their bytes."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            miss = np.flatnonzero(self.keys[at] != key)
            rows, codes, within = self.rows[at], self.codes[at], self.within[at]
        else:
            miss, rows, codes, within = np.arange(len(key)), np.zeros(len(key), np.uint16), np.zeros(len(key), np.uint16), np.zeros(len(key))
        if len(miss):
            odd = key[miss]
            form, size = shape(odd), odd >> U64(8 * PIECE)
            rows[miss], codes[miss] = SPELLED + form, (SPELLED + form) * SLOTS
            spelled = np.where(form & 1, 0.0, np.log10(1 / (PIECE - 1)))  # the length, where the shape leaves it open
            for k in range(PIECE):
                spelled += np.where((size > k) & ((k > 0) | (form < 2)), self.bytes[((odd >> U64(8 * k)) & U64(255)).astype(np.int64)], 0.0)
            within[miss] = spelled
        return rows, codes, within

    def open(self, codes: np.ndarray) -> np.ndarray:
        """Is it of a class whose subwords may have counts that are not kept here."""
        on = np.zeros(CLASSES, bool)
        on[SPELLED:END] = self.rest[:, 0] > 0
        return on[codes // SLOTS]


# --- the model -----------------------------------------------------------------------------------------------------

SHAPES = {
    "embed": (CLASSES + IDS, WIDTH), "place": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH),
    "out": (WIDTH, CLASSES), "bias": (1, CLASSES), "slot": (CLASSES, SLOTS, WIDTH), "slot_bias": (CLASSES, SLOTS),
}
_MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(WINDOW - STRIDE, WINDOW)[:, None], 0, -1e9).astype(np.float32).T[:, None].copy()


def start(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (np.zeros(s) if "bias" in k else rng.standard_normal(s) / np.sqrt(WIDTH)).astype(np.float32) for k, s in SHAPES.items()}


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = np.asarray(x[at : at + n], np.float32).reshape(s)
        at += n
    return out


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product of matrices, not one for each window."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def forward(m: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Unnormalised log probabilities of the class after each of the last STRIDE ids of every window.

    (CLASSES, windows, STRIDE): what is summed over lies first, as in the attention (WINDOW, windows, STRIDE), which numpy
    reduces several times faster than short rows.
    """
    x = m["embed"][ids] + m["place"]
    tail = np.ascontiguousarray(x[:, -STRIDE:])
    q, k, v = _times(tail, m["q"]), _times(x, m["k"]), _times(x, m["v"])
    a = np.ascontiguousarray((k @ q.transpose(0, 2, 1)).transpose(1, 0, 2))
    a *= np.float32(1 / np.sqrt(WIDTH))
    a += _MASK
    a -= a.max(axis=0)
    np.exp(a, out=a)
    a /= a.sum(axis=0)
    y = a.transpose(1, 2, 0) @ v
    h = tail + _times(y, m["o"])
    z = m["out"].T @ np.ascontiguousarray(h.reshape(-1, WIDTH).T)
    z += m["bias"].T
    return z.reshape(-1, *h.shape[:2]), (x, tail, q, k, v, a, y, h)


def by_class(goal: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray]:
    """Positions in the order of their goals' classes, (class, its slots, first, end) of the runs of classes with several
    slots, and the goals' slots in that order: so that what follows works on slices."""
    kind = goal // SLOTS
    order = np.argsort(kind, kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
    runs = [(c, int(slots[c]), cuts[c], cuts[c + 1]) for c in range(CLASSES) if slots[c] > 1 and cuts[c] < cuts[c + 1]]
    return order, runs, (goal[order] % SLOTS).astype(np.int64)


def slot_logits(m: dict[str, np.ndarray], c: int, many: int, x: np.ndarray) -> np.ndarray:
    """(slots, positions), the largest of each position being zero."""
    z = m["slot"][c, :many] @ x.T
    z += m["slot_bias"][c, :many, None]
    z -= z.max(axis=0)
    return z


def gradients(m: dict[str, np.ndarray], slots: np.ndarray, ids: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy (of class, and of slot within it) over the positions of weight 1."""
    z, (x, tail, q, k, v, a, y, h) = forward(m, ids)
    z -= z.max(axis=0)
    p = np.exp(z, out=z)
    p /= p.sum(axis=0)
    dz = p.reshape(len(p), -1)
    flat_goal = goal.ravel()
    dz[flat_goal // SLOTS, np.arange(goal.size)] -= 1
    share = (weight / max(1.0, weight.sum())).astype(dz.dtype).ravel()
    dz *= share
    two = lambda t: t.reshape(-1, t.shape[-1])
    state = two(h)
    g = {"out": (dz @ state).T, "bias": dz.sum(1)[None, :], "slot": np.zeros_like(m["slot"]), "slot_bias": np.zeros_like(m["slot_bias"])}
    dh = dz.T @ m["out"].T
    order, runs, slot = by_class(flat_goal, slots)
    sorted_state, sorted_share, more, places = state[order], share[order], np.zeros_like(state), np.arange(len(order))
    for c, many, i, j in runs:
        x_run = sorted_state[i:j]
        e = np.exp(slot_logits(m, c, many, x_run))
        e *= sorted_share[i:j] / e.sum(axis=0)
        e[slot[i:j], places[: j - i]] -= sorted_share[i:j]
        g["slot"][c, :many] = e @ x_run
        g["slot_bias"][c, :many] = e.sum(axis=1)
        more[i:j] = e.T @ m["slot"][c, :many]
    dh[order] += more
    dh = dh.reshape(h.shape)
    g["o"] = two(y).T @ two(dh)
    dy = _times(dh, m["o"].T)
    da = np.ascontiguousarray((v @ dy.transpose(0, 2, 1)).transpose(1, 0, 2))
    dv = a.transpose(1, 0, 2) @ dy
    da -= (da * a).sum(0)
    ds = a * da
    ds *= np.float32(1 / np.sqrt(WIDTH))
    dq, dk = ds.transpose(1, 2, 0) @ k, ds.transpose(1, 0, 2) @ q
    g["q"], g["k"], g["v"] = two(tail).T @ two(dq), two(x).T @ two(dk), two(x).T @ two(dv)
    dx = _times(dk, m["k"].T) + _times(dv, m["v"].T)
    dx[:, -STRIDE:] += dh + _times(dq, m["q"].T)
    g["place"] = dx.sum(0)
    order = np.argsort(ids, axis=None, kind="stable")
    sorted_ids = ids.ravel()[order]
    new = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
    g["embed"] = np.zeros_like(m["embed"])
    g["embed"][sorted_ids[new]] = np.add.reduceat(two(dx)[order], new)
    return g


class Adam:
    """Adam steps over windows as they come: `hold` of them are held, put into a fixed random order and gone over once.

    Where all windows are fewer than `least_steps` batches, they are gone over several times.
    """

    def __init__(self, m: dict[str, np.ndarray], slots: np.ndarray, batch: int = 256, rate: float = 0.02, least_steps: int = 60, hold: int = 1 << 15):
        self.slots = slots
        self.flat = flat(m)
        self.one, self.two = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.batch, self.rate, self.least_steps, self.hold = batch, np.float32(rate), least_steps, max(hold, batch * least_steps)
        self.rng, self.step, self.n, self.held = np.random.default_rng(5), 0, 0, []

    def add(self, ids: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> None:
        for at in range(0, len(ids), self.hold):
            self.held.append(tuple(x[at : at + self.hold] for x in (ids, goal, weight)))
            self.n += len(self.held[-1][0])
            if sum(len(x[0]) for x in self.held) >= self.hold:
                self._pass()
                self.held = []

    def _pass(self) -> None:
        ids, goal, weight = (np.concatenate(x) for x in zip(*self.held, strict=True))
        m = unflat(self.flat)  # views: the steps below show in them
        order = self.rng.permutation(len(ids))
        for at in range(0, len(ids), self.batch):
            self.step += 1
            b = order[at : at + self.batch]
            g = flat(gradients(m, self.slots, ids[b], goal[b], weight[b]))
            self.one += np.float32(0.1) * (g - self.one)
            self.two += np.float32(0.01) * (g * g - self.two)
            self.flat -= self.rate * (self.one / np.float32(1 - 0.9**self.step)) / (np.sqrt(self.two / np.float32(1 - 0.99**self.step)) + np.float32(1e-8))

    def model(self) -> dict[str, np.ndarray]:
        while self.held:
            self._pass()
            if self.step >= self.least_steps:
                self.held = []
        return unflat(self.flat)


def windows(rows: np.ndarray, codes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows (windows, WINDOW), goals (codes) and weights (windows, STRIDE), and the text of each window.

    Every text is led by start marks and closed by its end mark; the last window is filled up with weight 0.
    """
    lead = WINDOW - STRIDE + 1
    counts = np.bincount(owner, minlength=texts)
    many = (counts + STRIDE) // STRIDE  # windows for counts + 1 goals
    size = lead + many * STRIDE
    base = np.concatenate([[0], np.cumsum(size)])
    rank = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(counts)])[owner]
    place = base[owner] + lead + rank
    read, goals = np.full(base[-1], START, np.uint16), np.full(base[-1], START * SLOTS, np.uint16)
    read[place], goals[place] = rows, codes
    end = base[:-1] + lead + counts
    read[end], goals[end] = END, END * SLOTS
    text = np.repeat(np.arange(texts), many)
    k = np.arange(len(text)) - np.concatenate([[0], np.cumsum(many)[:-1]])[text]
    at = base[text] + k * STRIDE
    weight = (k * STRIDE)[:, None] + np.arange(STRIDE) <= counts[text][:, None]
    return read[at[:, None] + np.arange(WINDOW)], goals[at[:, None] + lead + np.arange(STRIDE)], weight.astype(np.float32), text


def id_scores(m: dict[str, np.ndarray], slots: np.ndarray, ids: np.ndarray, goal: np.ndarray, weight: np.ndarray, batch: int = 1024) -> np.ndarray:
    """Sum of the log10 probabilities of the goals' classes and slots over each window."""
    out = np.zeros(len(ids))
    for lo in range(0, len(ids), batch):
        z, cache = forward(m, ids[lo : lo + batch])
        now = goal[lo : lo + batch]
        hit = np.take_along_axis(z, (now // SLOTS).astype(np.int64)[None], 0)[0]
        top = z.max(axis=0)
        z -= top
        np.exp(z, out=z)
        hit -= np.log(z.sum(axis=0)) + top
        order, runs, slot = by_class(now.ravel(), slots)
        state, more, places = cache[-1].reshape(-1, WIDTH)[order], np.zeros(now.size, hit.dtype), np.arange(now.size)
        for c, many, i, j in runs:
            e = slot_logits(m, c, many, state[i:j])
            own = e[slot[i:j], places[: j - i]]
            np.exp(e, out=e)
            more[order[i:j]] = own - np.log(e.sum(axis=0))
        out[lo : lo + batch] = ((hit + more.reshape(hit.shape)) * weight[lo : lo + batch]).sum(axis=1, dtype=np.float64)
    return out / np.log(10)


# --- passes over the corpus ----------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {WORD: [], SUBWORD: []}

    def out() -> Iterator[pa.RecordBatch]:
        for kind in held:
            if held[kind]:
                key, n = np.unique(np.concatenate(held[kind]), return_counts=True)
                held[kind] = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(as_long(key)), pa.array(n)], ["kind", "key", "n"])

    for batch in pieces(batches, "text"):
        data, offsets = text_bytes(batch.column("text"))
        held[WORD].append(word_hashes(data, offsets)[0])
        held[SUBWORD].append(subwords(data, offsets)[0])
        if sum(map(len, held[SUBWORD])) >= GATHER:
            yield from out()
    yield from out()


def most_frequent(counts: DataFrame, kind: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all keys above the lowest count that leaves at most `most` of them. No sort, bounded result."""
    own = counts.where(F.col("kind") == kind)
    level = F.floor(F.log2("n") * 16)
    found = sorted(((r.level, r.keys, r.low) for r in own.groupBy(level.alias("level")).agg(F.count("*").alias("keys"), F.min("n").alias("low")).collect()), reverse=True)
    total, low = 0, None
    for _, keys, least in found:
        if total + keys > most:
            break
        total, low = total + keys, least
    if low is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    rows = own.where(F.col("n") >= low).select("key", "n").toArrow()
    return rows["key"].to_numpy().astype(np.int64).view(U64), rows["n"].to_numpy()


def rest_counts(counts: DataFrame, kept: np.ndarray) -> np.ndarray:
    """For each shape, the number and occurrences of the subwords below the lowest count kept."""
    rare = counts.where(F.col("kind") == SUBWORD)
    if len(kept):
        rare = rare.where(F.col("n") < int(kept.min()))
    form = 2 * (F.col("key").bitwiseAND(255) == 32).cast("int") + (F.shiftright("key", 8 * PIECE) == PIECE).cast("int")
    out = np.zeros((4, 2), np.int64)
    for r in rare.groupBy(form.alias("form")).agg(F.count("*").alias("many"), F.sum("n").alias("times")).collect():
        out[r.form] = r.many, r.times
    return out


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shared.value
        fit = Adam(model, table.slots)
        for batch in pieces(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            key, owner = subwords(data, offsets)
            ids, goal, weight, _ = windows(*table.read(key)[:2], owner, batch.num_rows)
            fit.add(ids, goal, weight)
        if fit.n:
            found = flat(fit.model()).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([fit.n], pa.int64()), pa.array([found.tolist()], pa.list_(pa.float64()))], ["n", "model"])

    return run


def distinct(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of each text, their texts, and how often each occurs there."""
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))[: len(key)]
    return key[new], owner[new], np.diff(np.append(new, len(key)))


class Model:
    """What scoring needs: subword table, attention model, head of the word counts, totals."""

    def __init__(self, counts: DataFrame, table: Table, attention: dict[str, np.ndarray], head: tuple[np.ndarray, np.ndarray], tokens: int, distinct: int, texts: int):
        self.counts, self.table, self.attention, self.head = counts, table, attention, head
        self.tokens, self.distinct, self.texts = tokens, distinct, texts


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts over all rows where `usable` holds, and the attention model from all of their windows."""
    spark = docs.sparkSession
    rows = docs.where(usable).select(row_key(id_col, text_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.select("text").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = durable(counted, "counts")
    totals = counts.where(F.col("kind") == WORD).agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    texts = docs.where(usable).count()
    keys, kept = most_frequent(counts, SUBWORD, TABLE)
    table = Table(keys, kept, rest_counts(counts, kept))
    model = start()
    shared = spark.sparkContext.broadcast((table, model))
    fits = rows.mapInArrow(_train(shared), "n long, model array<double>").select("n", F.posexplode("model").alias("at", "x"))
    found = fits.groupBy("at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).collect()
    if found:
        model = unflat(np.array([r.x for r in sorted(found, key=lambda r: r["at"])]))
    head = most_frequent(counts, WORD, HEAD)
    order = np.argsort(head[0])
    return Model(counts, table, model, (head[0][order], head[1][order]), (totals.n or 0) + texts, totals.v + (texts > 0), texts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.table, model.attention, model.head, model.texts))
    kept = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = kept.schema[1].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, attention, (words, counts), texts = shared.value
        logs = np.log10(counts + 1.0)
        for batch in pieces(batches, "__text", 2 << 20):
            m = batch.num_rows
            data, offsets = text_bytes(batch.column("__text"))
            w, doc = word_hashes(data, offsets)
            at = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
            hit = words[at] == w if len(words) else np.zeros(len(w), bool)
            head = np.bincount(doc[hit], logs[at[hit]], m) + np.log10(texts + 1.0)
            known = np.bincount(doc[hit], minlength=m) + (texts > 0)
            rare, who, times = distinct(w[~hit], doc[~hit])
            key, owner = subwords(data, offsets)
            read, codes, within = table.read(key)
            ids, goal, weight, text = windows(read, codes, owner, m)
            ask = table.open(codes)
            sub, whose, often = distinct(key[ask], owner[ask])
            spelled = table.read(sub)[2]
            own = np.bincount(owner[~ask], within[~ask], m) + np.bincount(text, id_scores(attention, table.slots, ids, goal, weight), m)
            rid = np.asarray(batch.column("rid"))
            t, u = len(rare), len(sub)
            none = np.zeros(t + u)
            columns = [
                np.repeat(np.array([WORD, WORD, SUBWORD], np.int32), [m, t, u]), np.concatenate([rid, as_long(rare), as_long(sub)]), np.concatenate([rid, rid[who], rid[whose]]), np.repeat([False, True], [m, t + u]),
                np.concatenate([np.bincount(doc, minlength=m) + 1, times, often]), np.concatenate([known, np.zeros(t, np.int64), shape(sub)]), np.concatenate([head, none]), np.concatenate([own, np.zeros(t), spelled]),
            ]
            names = pa.concat_arrays([batch.column(1), pa.nulls(t + u, batch.column(1).type)])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), names], ["kind", "key", "rid", "rare", "n", "known", "head", "own", id_col])

    rows = kept.mapInArrow(run, f"kind int, key long, rid long, rare boolean, n long, known long, head double, own double, `{id_col}` {kind}")
    # a text's own row travels by its key too, so that one pass over the texts serves both
    words = model.counts.where((F.col("kind") == WORD) | F.lit(bool(model.table.rest.any()))).select("kind", "key", F.col("n").alias("c"))
    met = rows.join(words, ["kind", "key"], "left").withColumn("c", F.when(F.col("rare"), F.coalesce("c", F.lit(0))))
    word, sub = F.col("kind") == WORD, F.col("kind") == SUBWORD
    many, times = (F.element_at(F.array(*[F.lit(float(x)) for x in model.table.rest[:, k]]), F.when(sub, F.col("known") + 1).otherwise(1).cast("int")) for k in (0, 1))
    inside = F.log10((F.col("c") + (many + 1) * F.pow(F.lit(10.0), F.col("own"))) / (times + many + 1))
    copies = F.sum((~F.col("rare")).cast("long"))  # repeated rows share a key: what is summed is as many times too large
    by = met.groupBy("rid").agg(
        copies.alias("copies"), F.max(id_col).alias(id_col), F.sum(F.when(~F.col("rare"), F.col("n"))).alias("n"),
        F.sum(F.when(word, F.when(F.col("rare"), F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("known")))).alias("known"),
        F.sum(F.when(word, F.when(F.col("rare"), F.col("n") * F.log10(F.col("c") + 1)).otherwise(F.col("head")))).alias("base"),
        F.sum(F.when(sub, F.col("n") * inside).otherwise(F.col("own"))).alias("own"),
    )
    each = by.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    n = F.expr("n div copies")
    level = float(np.log10(model.tokens + model.distinct + 1))
    return each.select(id_col, n.alias("n_tokens"), F.expr("known div copies").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies") - n * level).alias("base_score"), (F.col("own") / F.col("copies")).alias("score"))
