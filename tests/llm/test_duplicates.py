import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ravelin.llm import history as H, near_duplicates as N

DOC = "doc_id string, kb_id string, batch_no int, arrival_no bigint, content_hash string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=9), st.text("ab", max_size=9), st.integers(0, 3))
def test_bounded_distance(a, b, tau):
    assert H.within(a, b, tau) == (distance(a, b) <= tau)


def test_segment_index_loses_no_match(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(90)]
    frame = spark.createDataFrame([("s", w) for w in sorted(set(words))], "scope string, s string")
    for tau in (0, 1, 2):
        index = H.keyed(H.segments(frame, tau)).withColumn("canon", F.col("s"))
        got = {(r.s, r.t) for r in H.verified(H.matches(H.keyed(H.probes(frame, [5, 6, 7, 8, 9], tau)), index), tau).collect()}
        assert got == {(a, b) for a in set(words) for b in set(words) if distance(a, b) <= tau}


def reference(docs, chunks):
    hashes = {}
    for d, t in chunks:
        hashes.setdefault(d, set()).add(sha(t))
    kept, out = [], set()
    for d, k, _, _, h in sorted(docs, key=lambda r: (r[2], r[3], r[0])):
        real = re.sub(r"^sha256:", "", (h or "").strip().lower())
        real = real if len(real) == 64 and len(set(real)) > 1 else None
        mine = hashes.get(d, set())
        same = any(k == k2 and ((real and real == r2) or (mine and s2 and 2 * len(mine & s2) >= min(len(mine), len(s2)))) for k2, r2, s2 in kept)
        if same:
            out.add(d)
        else:
            kept.append((k, real, mine))
    return out


def test_refusals_match_the_sequential_rule(spark):
    rng = random.Random(5)
    texts, docs, chunks = [f"text {n}" for n in range(26)], [], []
    for n in range(120):
        kind = rng.random()
        h = None if kind < 0.1 else "0" * 64 if kind < 0.15 else sha(f"bytes {rng.randint(0, 60)}")
        h = h and rng.choice([h, h.upper(), "sha256:" + h, " " + h])
        docs.append((f"d{n:03}", rng.choice(["k1", "k2"]), rng.randint(0, 3), n, h))
        if kind < 0.9:
            chunks += [(f"d{n:03}", rng.choice(texts)) for _ in range(rng.randint(1, 5))]
    frame = spark.createDataFrame(docs + docs[:5], DOC).withColumn("scope", F.lit("clash"))
    got = [r.doc_id for r in H.refuse_repetitions(frame, spark.createDataFrame(chunks + chunks[:9], "doc_id string, embed_text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == reference(docs, chunks)


def test_a_hash_with_one_wrong_digit_is_the_same(spark):
    h = sha("a")
    docs = [("a", "k", 0, 1, h), ("b", "k", 1, 1, h[:20] + ("0" if h[20] != "0" else "1") + h[21:]), ("c", "k", 1, 2, h[:20] + h[21:]), ("d", "k", 1, 3, sha("d")), ("e", "l", 1, 4, h), (None, "k", 1, 5, h)]
    got = {r.doc_id for r in H.refuse_repetitions(spark.createDataFrame(docs, DOC), spark.createDataFrame([], "doc_id string, embed_text string")).collect()}
    assert got == {"b", "c"}


def test_a_batch_costs_the_same_whatever_the_history(spark):
    def moved():
        return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))

    def records(first, n, batch):
        rows = [(f"r{k}", "k", batch, k, sha(f"bytes {k}")) for k in range(first, first + n)]
        texts = [(f"r{k}", sha(f"text {k} {c}")) for k in range(first, first + n) for c in range(4)]
        return spark.createDataFrame(rows, "doc_id string, scope string, batch_no int, arrival_no bigint, content_hash string"), spark.createDataFrame(texts, "doc_id string, hash string")

    costs = []
    for size in (600, 1200):
        index = H.HistoryIndex(spark, H.scratch_path(spark, "history"))
        assert index.take(*records(0, size, 0)).filter("accepted").count() == size
        docs, texts = records(100_000, 40, 1)
        docs = docs.unionByName(spark.createDataFrame([("again", "k", 1, 999_999, sha("bytes 7").upper())], docs.schema))
        before = moved()
        got = index.take(docs, texts)
        assert {r.doc_id for r in got.filter("not accepted").collect()} == {"again"}
        costs.append(moved() - before)
        index.drop()
    assert costs[1] <= 1.1 * costs[0]


def test_a_hot_group_is_settled_in_slices(spark, monkeypatch):
    monkeypatch.setattr(H, "MEETING", 8)
    docs, chunks, rng = [], [], random.Random(9)
    for n in range(150):
        docs.append((f"d{n:03}", "k", n // 60, n, None))
        common = ["a", "b", "c"] if rng.random() < 0.6 else ["a"]
        chunks += [(f"d{n:03}", t) for t in [*common, *(f"own {n} {k}" for k in range(rng.randint(1, 4)))]]
    got = {r.doc_id for r in H.refuse_repetitions(spark.createDataFrame(docs, DOC), spark.createDataFrame(chunks, "doc_id string, embed_text string")).collect()}
    assert got == reference(docs, chunks) and len(got) > 60


def test_steps_of_a_batch_are_planned_once_and_the_session_is_left_alone(spark):
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    settings, active = dict(spark.conf.getAll), spark._jvm.org.apache.spark.sql.SparkSession.active()
    bus.waitUntilEmpty(60_000)
    seen = {e.executionId() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList())}
    docs = [(f"d{n}", "k", n % 3, n, sha(f"bytes {n % 7}")) for n in range(12)]
    found = H.refuse_repetitions(spark.createDataFrame(docs, DOC), spark.createDataFrame([("d1", "a"), ("d4", "a")], "doc_id string, embed_text string"))
    assert {r.doc_id for r in found.collect()} == reference(docs, [("d1", "a"), ("d4", "a")])
    bus.waitUntilEmpty(60_000)
    plans = [e.physicalPlanDescription() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList()) if e.executionId() not in seen]
    assert len(plans) > 20 and sum("AdaptiveSparkPlan" in p for p in plans) <= 2
    assert found.sparkSession is spark and dict(spark.conf.getAll) == settings and spark._jvm.org.apache.spark.sql.SparkSession.active().equals(active)


def test_history_of_nothing(spark):
    assert H.refuse_repetitions(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id string, embed_text string")).count() == 0


def corpus(rng):
    words = [f"w{n}" for n in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 80))] for _ in range(40)]
    rows = []
    for n in range(260):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((rng.choice(["chunk", "document"]), f"i{n:03}", " ".join(text)))
    return rows + [("chunk", "e1", ""), ("chunk", "e2", None), ("chunk", "s1", "two words"), ("chunk", "s2", "two words"), ("chunk", None, "x y z"), *rows[:4]]


def shingles(text, n=3):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_near_duplicates_match_brute_force(spark):
    rows = corpus(random.Random(7))
    frame = spark.createDataFrame(rows, "record_kind string, id string, text string").withColumn("doc", F.lit(1))
    got = {tuple(r) for r in N.near_duplicate_pairs(frame, 3, 0.5).collect()}
    sets = {(k, i): shingles(t) for k, i, t in rows if i}
    sure, border = set(), set()
    for (k, a), x in sets.items():
        for (k2, b), y in sets.items():
            if k == k2 and a < b and x and y and 2 * len(x & y) >= len(x | y):
                (sure if len(x & y) >= 0.58 * len(x | y) else border).add((k, a, b))
    assert sure <= got <= sure | border and len(border - got) <= 0.1 * len(border) + 1


def test_many_copies_are_a_star_and_classes_hold_all(spark):
    rows = [("chunk", f"c{n:03}", "a b c d e f g h") for n in range(100)] + [("chunk", "z", "a b c d e f g h i"), ("chunk", "o", "other words stand in this one here")]
    frame = spark.createDataFrame(rows, "record_kind string, id string, text string")
    got = {(r.id_a, r.id_b) for r in N.near_duplicate_pairs(frame, 3, 0.5).collect()}
    assert got == {("c000", f"c{n:03}") for n in range(1, 100)} | {("c000", "z")}
    classes = {r.id: (r.class_id, r.n_links) for r in N.near_duplicate_classes(frame, 3, 0.5).collect()}
    assert len(classes) == 102 and len({c for c, _ in classes.values()}) == 2 and classes["z"] == (classes["c050"][0], 1) and classes["o"][1] == 0


def test_near_duplicates_of_nothing(spark):
    frame = spark.createDataFrame([], "record_kind string, id string, text string")
    assert N.near_duplicate_pairs(frame, 3, 0.5).count() == 0 and N.near_duplicate_classes(frame).count() == 0


def test_texts_with_nothing_in_common(spark):
    rows = [("chunk", f"u{n}", " ".join(f"w{n}x{k}" for k in range(9))) for n in range(12)]
    frame = spark.createDataFrame(rows, "record_kind string, id string, text string")
    assert N.near_duplicate_pairs(frame, 3, 0.5).count() == 0
    assert N.near_duplicate_classes(frame).select("class_id").distinct().count() == 12


def test_no_link_at_the_threshold_is_lost(spark):
    rows, expected = [], set()
    for n in range(400):
        words = [f"w{n}x{k}" for k in range(8)]
        rows += [("chunk", f"a{n:03}", " ".join(words[:5])), ("chunk", f"b{n:03}", " ".join(words[:7] if n % 2 else [*words[:4], words[7]]))]
        rows += [("chunk", f"c{n:03}", " ".join([*words[:4], "the", "end", "of", "it"]))]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for _, i, t in rows}
    for n in range(400):
        group = [f"{c}{n:03}" for c in "abc"]
        expected |= {(x, y) for x in group for y in group if x < y and 2 * len(sets[x] & sets[y]) >= len(sets[x] | sets[y])}
    assert len(expected) == 400
    got = N.near_duplicate_pairs(spark.createDataFrame(rows, "record_kind string, id string, text string"), 3, 0.5).collect()
    assert {(r.id_a, r.id_b) for r in got} == expected


def test_unfinished_classes_are_an_error(spark):
    chain = [("chunk", f"d{n:02}", " ".join(f"w{k}" for k in range(2 * n, 2 * n + 9))) for n in range(24)]
    frame = spark.createDataFrame(chain, "record_kind string, id string, text string")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        N.near_duplicate_classes(frame, 3, 0.5, rounds=1)
    assert N.near_duplicate_classes(frame, 3, 0.5).select("class_id").distinct().count() == 1


def test_finished_steps_leave_the_disk_and_sets_travel_once(spark):
    def shuffles():
        return {int(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",") if x}

    def moved():
        return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))

    rows = [("chunk", f"t{n:03}", " ".join(f"w{n // 2 if n % 40 < 4 else n}x{k}" for k in range(1000 + n % 2))) for n in range(200)]
    texts = N.cut(N.prepared(spark.createDataFrame(rows, "record_kind string, id string, text string"), 3)).select("record_kind", "doc", "shingles")
    size = texts.selectExpr("sum(length(shingles))").first()[0]
    before = shuffles()
    links = N.similar_texts(texts, 0.5)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for key in settings:
            spark.conf.set(key, "-1")
        start = moved()
        assert links.count() == 10
        assert moved() - start < 1.5 * size
    finally:
        for key in settings:
            spark.conf.unset(key)
