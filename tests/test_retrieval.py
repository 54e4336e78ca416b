import math

import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.functions.plugins import REFUSAL, EchoModel, generate
from ravelin.operators import dense, fusion, lexical
from ravelin.operators.ranking import spread_row_number


def hits(spark, rows):
    return spark.createDataFrame(rows, "q_ord int, query string, src_ord int, source string, id int, rank int")


def test_fusion_of_one_query(spark):
    rows = [(0, "q", 0, "dense", i, n + 1) for n, i in enumerate([2, 1, 0])] + [(0, "q", 1, "bm25", i, n + 1) for n, i in enumerate([0, 1, 3])]
    got = fusion.rrf(hits(spark, rows), "id", 4).orderBy("place").collect()
    assert [r.id for r in got] == [0, 1, 2, 3]
    assert (got[0].dense_rank, got[0].bm25_rank) == (3, 1)
    assert [round(r.rrf_score, 7) for r in got] == [0.0322665, 0.0322581, 0.0163934, 0.015873]


def test_fusion_of_two_queries_and_ties(spark):
    rows = [(q, f"q{q}", s, n, 1, 1) for q in (0, 1) for s, n in ((0, "dense"), (1, "bm25"))] + [(0, "q0", 0, "dense", 7, 2), (1, "q1", 0, "dense", 5, 2)]
    got = fusion.rrf(hits(spark, rows), "id", 3).orderBy("place").collect()
    assert math.isclose(got[0].rrf_score, 4 / 61, abs_tol=1e-9) and [r.id for r in got] == [1, 7, 5]
    assert got[0].matched_queries == ["q0", "q1"] and got[0].retrieval_sources == ["bm25", "dense"]


def test_rerank_orders_and_keeps_ties_and_nulls_last(spark):
    rows = spark.createDataFrame([(n, float(n) if n != 4 else None) for n in range(10)] + [(11, 9.0)], "pos int, s double")
    assert [r.pos for r in fusion.rerank(rows, "s", "pos", 5).orderBy("rerank_rank").collect()] == [9, 11, 8, 7, 6]


def test_parents_contexts_and_budget(spark):
    cands = spark.createDataFrame(
        [("c1", "d1", "w1", 0.2, 0.5, ["q"], ["bm25"], 2), ("c2", "d1", "w1", 0.1, 0.9, ["p"], ["dense"], 1), ("c3", "d2", "none", 0.3, 0.4, ["q"], ["bm25"], 3), ("c4", "d2", "w2", 0.3, None, ["q"], ["bm25"], 4)],
        "chunk_id string, doc_id string, parent_window_id string, rrf_score double, rerank_score double, matched_queries array<string>, retrieval_sources array<string>, rerank_rank int",
    )
    grouped = fusion.by_parent(cands)
    w1 = grouped.filter("parent_window_id = 'w1'").first()
    assert w1.source_chunks == ["c2", "c1"] and w1.best_rerank_score == 0.9 and w1.best_rrf_score == 0.2 and w1.matched_queries == ["p", "q"]
    lookup = spark.createDataFrame([("w1", "d1", 2, 5), ("w1", "d1", 2, 5), ("w2", "d9", 0, 2)], "parent_window_id string, doc_id string, char_start int, char_end int")
    docs = spark.createDataFrame([("d1", "abcdefg"), ("d1", "abcdefg")], "doc_id string, full_text string")
    found = fusion.contexts(grouped, lookup, docs, 3).collect()
    assert [(r.rank, r.parent_window_id, r.parent_text) for r in found] == [(1, "w1", "cde")]
    ranked = spark.createDataFrame([(1, "d1", "w1", "x" * 20, 1.0), (2, "d2", "w2", "y" * 60, 0.5), (3, "d1", "w1", "x" * 20, 0.1)], "rank int, doc_id string, parent_window_id string, parent_text string, best_rerank_score double")
    assert [r.parent_window_id for r in fusion.budget(ranked, 15).collect()] == ["w1"]


def test_bm25_by_hand(spark):
    texts = ["the cat sat", "the dog", "the the bird cat", None, ""]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r.score for r in lexical.bm25(["cat cat", "zzz", ""], docs, "doc_id", "text", 9).collect()}
    raw = {t: math.log(5 - df + 0.5) - math.log(df + 0.5) for t, df in (("the", 3), ("cat", 2), ("sat", 1), ("dog", 1), ("bird", 1))}
    idf, avg = raw["cat"], 9 / 5
    assert set(got) == {0, 2}
    for n, dl in ((0, 3), (2, 4)):
        assert math.isclose(got[n], 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avg)), abs_tol=2e-6)


def test_dense_topk_leaves_out_bad_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0]), (None, [1.0, 1.0])], "vec_id int, v array<float>")
    got = dense.dense_topk({0: [1.0, 0.0]}, rows, "vec_id", "v", 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (5, 1.0)]
    with pytest.raises(ValueError, match="at most"):
        dense.dense_topk({n: [1.0] for n in range(dense.MOST_QUERIES + 1)}, rows, "vec_id", "v", 2)


def test_spread_row_number_is_row_number(spark):
    rows = spark.createDataFrame([(g, n) for g in ("a", None, "b") for n in range(50, 0, -1)] * 1, "g string, n int").repartition(4)
    got = spread_row_number(rows, ["g"], ["n"], "at").collect()
    assert all(r["at"] == r.n for r in got) and len(got) == 150


def test_scalar_functions(spark):
    row = spark.createDataFrame([("\n a \n b\t\n", ["A", "B"], "t", {"x": 0.0, "y": 2.0}, [3.0, 4.0], [0.0, 0.0])], "s string, p array<string>, t string, m map<string,float>, v array<float>, z array<float>")
    got = row.select(
        T.clean_text(F.col("s")).alias("clean"), T.embed_text(F.col("t"), F.col("p"), F.col("s")).alias("embed"), T.embed_text(F.lit(""), F.array().cast("array<string>"), F.lit("x ")).alias("bare"),
        T.sparse_clean(F.col("m")).alias("m"), T.l2_normalise(F.col("v")).alias("v"), T.l2_normalise(F.col("z")).alias("z"), T.bm25_tokens(F.lit("Ab-c É d")).alias("tok"), T.bm25_tokens(F.lit(None).cast("string")).alias("none"),
        T.kb_name(F.lit("a b/ü_1-")).alias("kb"), T.kb_name(F.lit("//")).alias("no"), T.valid_table(F.lit("| Col1 | --- | a b c d |")).alias("ok"), T.valid_table(F.lit("| a |")).alias("bad"),
        T.rewrite_variants(F.lit('```json\n["a", "q", "b", "c", "d"]\n```'), F.lit("q")).alias("r"), T.rewrite_variants(F.lit("- a\n2) b"), F.lit("q")).alias("r2"), T.file_type(F.lit(b"%PDF-1")).alias("pdf"),
    ).first()
    assert (got.clean, got.embed, got.bare) == ("a\nb", "t\n\nA > B\n\na \n b", "x")
    assert got.m == {"y": 2.0} and [round(x, 6) for x in got.v] == [0.6, 0.8] and got.z == [0.0, 0.0]
    assert got.tok == ["ab", "c", "d"] and got.none == [] and got.kb == "abü_1-" and got.no is None and got.ok and not got.bad
    assert got.r == ["q", "a", "b", "c"] and got.r2 == ["q", "a", "b"] and got.pdf == "pdf"


def test_generation_falls_back_and_refuses():
    class Broken:
        name = "broken"

        def answer(self, system, prompt):
            raise RuntimeError

    assert generate("q", [], [], [EchoModel()]) == {"answer": REFUSAL, "sources": [], "model_used": "none"}
    got = generate("q", ["[Document 1] d\ntext\n"], [("d", "w")], [Broken(), EchoModel()])
    assert got["model_used"] == "echo" and got["sources"] == [("d", "w")]


def test_sparse_keys_are_stripped_and_the_last_stays(spark):
    row = spark.sql("SELECT map(' a', 1.0D, 'b', 2.0D, 'a ', 3.0D, 'c', 0.0D, 'd', 2.0D) AS m, map() AS e").select(T.sparse_clean(F.col("m")).alias("m")).first()
    assert row.m == {"a": 3.0, "b": 2.0, "d": 2.0}
