"""What near-duplicate detection leaves on disk and copies."""

import random
import time

from pyspark.sql import functions as F

from tessera.llm import jaccard
from tessera.llm.shared import durable


def test_durable_gives_up_its_shuffles(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x and x.endswith(".data")}
    before = files()
    kept = spark.range(10000).repartition(4, "id")
    out = durable(kept, "test")
    for _ in range(20):  # files go in the background
        time.sleep(0.1)
        left = files() - before
    assert not left
    assert out.count() == 10000


def test_large_candidate_components_are_cut_and_keep_their_links(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):  # families of near copies of very different lengths
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(10 + 4 * k)]
        rows += [(10 * k + c, " ".join(words[: len(words) - c])) for c in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: {tuple(t.split()[a : a + 3]) for a in range(len(t.split()) - 2)} for i, t in rows}
    low = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    for block in (2, 1000):
        got = {r.doc_id: r.component_id for r in jaccard.join(docs, 3, 80, block=block).collect()}
        assert got == low
    # one component of all sets: blocks are compared with those of like sizes only
    parts = spark.createDataFrame([(i, 1, len(s)) for i, s in sets.items()], "node long, root long, size long")
    chosen, pairs = jaccard.blocked(parts, F.lit(0.1), 80)
    block = {r.node: r.block for r in chosen.collect()}
    on = {(r.i, r.j) for r in pairs.collect()}
    assert len(block) == len(sets) and len(on) < 0.4 * (max(block.values()) + 1) ** 2 / 2
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                assert (min(block[a], block[b]), max(block[a], block[b])) in on


def test_refined_candidates_keep_links_and_part_the_rest(spark):
    """Texts that share one widespread shingle in a segment of its own are one star in the whole corpus."""
    rng = random.Random(5)
    shared = "a b c"
    rows = [(k, shared + " " + " ".join(f"u{k}x{rng.randrange(10**6)}" for _ in range(20))) for k in range(200)]
    rows += [(1000 + k, t + f" z{k}") for k, t in rows[:50]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = jaccard.nodes(docs, 3)
    moved = durable(docs.join(nodes.select("doc_id", "node", F.col("n_shingles").alias("size")), "doc_id").select("node", F.lit(7).cast("long").alias("root"), "size", "text"), "moved")
    parts = moved.select("node", "root", "size").distinct()
    out = jaccard.refined(moved, parts, parts.select("root").distinct(), 3, 80)
    root = {r.node: r.root for r in out.collect()}
    node = {r.doc_id: r.node for r in nodes.collect()}
    assert all(root[node[k]] == root[node[1000 + k]] for k in range(50))
    assert out.groupBy("root").count().agg(F.max("count")).first()[0] < 20
