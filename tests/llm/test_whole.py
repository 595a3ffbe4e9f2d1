
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import jaccard, lm
from tessera.llm.shared import text_bytes


def test_lm_trains_on_every_window():
    texts = pa.array([" ".join(f"w{i % 50}" for i in range(3000)), "a b", None])
    data, offsets = text_bytes(texts)
    key, owner = lm.subwords(data, offsets)
    table = lm.Table(*np.unique(key, return_counts=True))
    ids, goal, weight, text = lm.windows(*table.read(key)[:2], owner, 3)
    assert weight.sum() == len(key) + 3 and len(text) > 100
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts], ["rid", "text"])
    (row,) = lm._train(SimpleNamespace(value=(table, lm.start())))(iter([batch]))
    assert row["n"].to_pylist() == [len(ids)]
    # the fit is closer to all goals than the start is
    found = lm.unflat(np.array(row["model"][0].as_py()))
    assert lm.id_scores(found, table.slots, ids, goal, weight).sum() > 0.5 * lm.id_scores(lm.start(), table.slots, ids, goal, weight).sum()


def test_lm_adam_goes_over_each_window_once():
    rng = np.random.default_rng(1)
    ids, goal, weight = rng.integers(0, lm.CLASSES, (70, lm.WINDOW)), lm.SLOTS * rng.integers(0, lm.CLASSES, (70, lm.STRIDE)), np.ones((70, lm.STRIDE), np.float32)
    fit = lm.Adam(lm.start(), np.ones(lm.CLASSES, int), batch=8, least_steps=1, hold=16)
    for at in range(0, 70, 30):
        fit.add(ids[at : at + 30], goal[at : at + 30], weight[at : at + 30])
    fit.model()
    assert fit.n == 70 and fit.step == 9 and not fit.held


def test_lm_subwords_beyond_the_table_have_their_counts(spark, monkeypatch):
    common, rare, unseen = "the cat sat on the mat", "zq", "zv"
    rows = [(i, common) for i in range(20)] + [(100 + i, f"{common} {rare}") for i in range(3)] + [(200, f"{common} {unseen}"), (201, "zq zq zv"), (202, None)]
    docs = spark.createDataFrame(rows + rows[-2:-1], "doc_id long, text string")
    monkeypatch.setattr(lm, "TABLE", 6)
    model = lm.train(docs, F.col("doc_id") < 200)
    counts = {(r.key, r.n) for r in model.counts.where("kind = 1").collect()}
    kept = set(model.table.keys.astype(np.int64).tolist())
    assert 0 < len(kept) <= 6 < len(counts)
    form = lambda key: int(lm.shape(np.array([key], np.uint64))[0])
    for f in range(4):
        left = [n for key, n in counts if key not in kept and form(key) == f]
        assert model.table.rest[f].tolist() == [len(left), sum(left)]
    score = {r.doc_id: r.score for r in lm.score(docs, model).collect()}
    for i, t in rows:
        data, offsets = text_bytes(pa.array([t]))
        key, owner = lm.subwords(data, offsets)
        rows_read, codes, within = model.table.read(key)
        want = lm.id_scores(model.attention, model.table.slots, *lm.windows(rows_read, codes, owner, 1)[:3]).sum()
        for k, x in zip(key.astype(np.int64).tolist(), within.tolist(), strict=True):
            if k not in kept:
                many, times = model.table.rest[form(k)]
                x = np.log10((dict(counts).get(k, 0) + (many + 1) * 10**x) / (times + many + 1))
            want += x
        assert abs(score[i] - want) < 1e-4, (i, score[i], want)
    assert score[100] > score[200] + 0.3  # the same but for a subword that was counted three times


def test_jaccard_links_sets_two_classes_apart(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words[:10])), (2, " ".join(words[:15])), (3, " ".join(words[20:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 66):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, n=1, percent=percent).collect()}
        assert found == {1: (10, 1), 2: (15, 1), 3: (10, 3)}
