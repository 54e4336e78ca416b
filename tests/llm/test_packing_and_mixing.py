import os

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ravelin.llm import mixing as M, packing as B, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files here")
DOC = "doc_id long, text string, source string"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(-1, 2)), max_size=60))
def test_best_fit_keeps_its_rules(items):
    items.sort(reverse=True)
    foes = {0: 1 << 1, 1: 1 << 0}
    bins = B.best_fit([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 20, foes)
    for b in set(bins):
        inside = [i for i, k in zip(items, bins) if k == b]
        clusters = [c for _, _, c in inside if c >= 0]
        assert sum(s for s, *_ in inside) <= 20 and len(clusters) == len(set(clusters)) and not {0, 1} <= {s for _, s, _ in inside}


def test_the_tightest_compatible_bin_is_taken():
    assert B.best_fit([12, 10, 7, 5], [0] * 4, [-1] * 4, 20, {}) == [0, 1, 0, 1]
    assert B.best_fit([12, 10, 7], [0] * 3, [5, -1, 5], 20, {}) == [0, 1, 1]


def test_every_document_is_packed(spark):
    rows = [(n, "word " * (n % 37 + 1), "a") for n in range(300)] + [(900, "long " * 500, "b"), (901, None, None), (902, "", "a"), (903, "copy this", "a"), (904, "copy this", "b"), (904, "copy this", "b"), (None, "x", "a")]
    packed = B.pack(spark.createDataFrame(rows, DOC).withColumn("shard", F.lit(1)), 100, shard_items=1000).toPandas()
    assert set(packed.doc_id) == {*range(300), 900, 901, 902, 903, 904} and (packed.groupby("container_id").n_tokens.sum() <= 100).all()
    assert packed[packed.doc_id != 900].groupby("doc_id").size().max() == 1
    big = packed[packed.doc_id == 900].sort_values("piece_no")
    assert big.n_tokens.sum() == len(tokens.encoding(tokens.TOKENIZER).encode_ordinary("long " * 500)) and (big.n_tokens[:-1] == 100).all()
    a, b = (packed[packed.doc_id == d].container_id.iloc[0] for d in (903, 904))
    assert a != b
    report = B.fill_report(spark.createDataFrame(packed), 100).first()
    assert report["fill"] > 0.9 and report["items"] == len(packed)
    assert [r.doc_id for r in B.oversized(spark.createDataFrame(packed)).collect()] == [900]
    assert B.pack(spark.createDataFrame([], DOC), 100).count() == 0


def test_rests_of_copies_do_not_share_a_container(spark):
    rows = [(n, "long " * 520, "a") for n in range(3)] + [(9, "word", "a")]
    packed = B.pack(spark.createDataFrame(rows, DOC), 500).toPandas()
    rests = packed[packed.piece_no == 1]
    assert len(rests) == 3 and rests.n_tokens.max() < 100 and rests.container_id.nunique() == 3
    assert (packed.groupby("container_id").n_tokens.sum() <= 500).all()


def test_sources_kept_apart(spark):
    rows = [(n, "word " * 10, "a" if n % 2 else " B ") for n in range(40)]
    packed = B.pack(spark.createDataFrame(rows, DOC), 100, apart=[("a", "b")]).toPandas()
    assert (packed.assign(odd=packed.doc_id % 2).groupby("container_id").odd.nunique() == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 300))
def test_flight_keeps_totals(seed, n):
    rng = np.random.default_rng(seed)
    share, size = rng.random(n), rng.integers(0, 500, n).astype(float)
    flown = M.flight(share, size, rng, heavy=0)
    open_ = (flown > 0) & (flown < 1)
    assert open_.sum() <= 2 and abs(flown.sum() - share.sum()) < 1e-5 and abs(flown @ size - share @ size) < 1e-2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 600))
def test_the_shipped_flight_keeps_totals(seed, n):
    rng = np.random.default_rng(seed)
    share, size = rng.random(n), np.sort(rng.pareto(1.2, n) * 100).round()[::-1]
    flown = M.flight(share, size, rng)
    open_ = (flown > 0) & (flown < 1)
    assert open_.sum() <= 3 and abs(flown.sum() - share.sum()) < 2 and abs(flown @ size - share @ size) < 1e-6 * (size.sum() + 1)


def test_inclusion_chances_are_kept():
    share, size = np.full(6, 0.3), np.array([1.0, 2, 3, 4, 5, 6])
    flown = np.mean([M.flight(share, size, np.random.default_rng(n), heavy=2) for n in range(3000)], axis=0)
    assert np.abs(flown - 0.3).max() < 0.04


def test_mix_reaches_shares_and_reports(spark):
    rows = [(n, "word " * (n % 9 + 1), s) for n, s in enumerate(["a"] * 400 + ["b "] * 200 + ["C"] * 5 + [None] * 9 + ["other"] * 20)] + [(9000, None, "a"), (9000, None, "a")]
    targets = spark.createDataFrame([("a", 0.3, 3), ("b", 0.5, 4), ("c", 0.2, 2), ("absent", 0.0, 2), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    copies, report = M.mix(spark.createDataFrame(rows, DOC).withColumn("share", F.lit(1)), targets, block_items=64)
    got = {r.source: r for r in report.collect()}
    assert not got["c"].reachable and not got["none"].reachable and got["a"].reachable and got["b"].reachable
    for s in "ab":
        assert abs(got[s].reached_tokens - got[s].quota) < 12
    assert got["c"].reached_tokens == 2 * got["c"].tokens
    used = copies.toPandas()
    assert used.doc_id.is_unique and (used[used.source == "b"].copies <= 4).all() and (used[used.source == "a"].copies <= 3).all() and "other" not in set(used.source)
    none, empty = M.mix(spark.createDataFrame([], DOC), targets)
    assert none.count() == 0 and empty.count() == 5
