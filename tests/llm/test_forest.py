import numpy as np
from pyspark.sql import functions as F

from ravelin.llm import forest as V


def rows(spark, vectors):
    return spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "vid long, vector array<float>")


def test_leaves_share_a_prefix_and_cover():
    labels = np.sort(np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64))
    labels[100:900] = labels[100]
    leaves = V.prefix_leaves(np.sort(labels), 64)
    assert leaves[0][0] == 0 and leaves[-1][1] == 5000 and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
    assert sum(b - a > 64 for a, b in leaves) == 1


def test_top_columns_are_the_largest():
    sims = np.random.default_rng(2).random((40, 3001)).astype(np.float32)
    got = np.take_along_axis(sims, V.top_columns(sims, 5), 1)
    assert np.allclose(np.sort(got), np.sort(sims)[:, -5:])


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((300, 16))
    vectors = (centres[rng.integers(0, 300, 3000)] + 0.4 * rng.standard_normal((3000, 16))).astype(np.float32)
    got = V.forest_neighbours(rows(spark, vectors), 5, trees=10, leaf=128).toPandas()
    unit = V.unit_rows(vectors)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    true = np.argpartition(-sims, 5, axis=1)[:, :5]
    found = got.groupby("vid").nid.apply(set)
    assert np.mean([len(set(t) & found[n]) / 5 for n, t in enumerate(true.tolist())]) >= 0.9
    assert np.allclose(got.similarity, sims[got.vid, got.nid], atol=1e-3) and (got.groupby("vid").size() == 5).all()


def test_results_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 256)
    monkeypatch.setattr(V, "FULLEST", 300)
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.standard_normal((1500, 8)), np.ones((700, 8)) + 1e-6 * rng.standard_normal((700, 8))]).astype(np.float32)
    frame = rows(spark, vectors)
    got = [V.forest_neighbours(frame.repartition(n), 5, trees=6, leaf=64).toPandas().sort_values(["vid", "nid"], ignore_index=True) for n in (1, 7)]
    assert got[0].equals(got[1]) and (got[0].groupby("vid").size() == 5).all()
    assert got[0].query("vid >= 1500").similarity.min() > 0.999


def test_trees_grow_with_the_rows():
    assert V.trees_for(1000) == 12 and V.trees_for(150_000) == 14 and 55 < V.trees_for(1_500_000) < 62


def test_few_rows_copies_and_none(spark):
    few = V.forest_neighbours(rows(spark, np.eye(3, dtype=np.float32)), 5).collect()
    assert sorted((r.vid, r.nid) for r in few) == [(a, b) for a in range(3) for b in range(3) if a != b]
    same = V.forest_neighbours(rows(spark, np.ones((40, 4), np.float32)), 5, trees=2, leaf=8).toPandas()
    assert (same.groupby("vid").size() == 5).all() and (same.similarity > 0.999).all() and (same.vid != same.nid).all()
    assert V.forest_neighbours(rows(spark, np.ones((1, 4), np.float32)), 5).count() == 0
    assert V.forest_neighbours(spark.createDataFrame([], "vid long, vector array<float>"), 5).count() == 0


def test_unusable_vectors_and_hashes(spark):
    e = [("a", [1.0, 0.0], "AA", 1), ("a", [1.0, 0.1], "aa", 2), ("b", [1.0, 0.05], None, 1), ("c", [0.0, 0.0], "cc", 1), ("d", None, "dd", 1), ("e", [1.0], "ee", 1), ("f", [float("nan"), 1.0], "ff", 1), ("g", [2.0, 0.2], "gg", 1), ("h", [1.0, 1.0], None, 1)]
    embedded = spark.createDataFrame(e, "chunk_id string, dense_vector array<float>, embed_text_hash string, generated_at int").withColumn("vid", F.lit(0))
    chunks = spark.createDataFrame([("b", "text"), ("b", "text")], "chunk_id string, embed_text string")
    got = {r.hash: r.vector for r in V.usable_vectors(embedded, chunks, 2).collect()}
    assert len(got) == 3 and [round(x, 3) for x in got["aa"]] == [1.0, 0.1]
    pairs = {(r.hash_a, r.hash_b) for r in V.mutual_neighbours(embedded, chunks, 2).collect()}
    assert len(pairs) == 3 and all(a < b for a, b in pairs)
