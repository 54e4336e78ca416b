import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ravelin.llm.leximin import leximin_rank
from ravelin.llm.splitting import atoms, merge_atoms, split_oversized, split_text

SCORES = {"a": "large", "b": "small"}
ROW = "q int, c string, a double, b int, extra string"


def brute(rows, k=None):
    out = {}
    for q in {r[0] for r in rows}:
        best = {}
        for _, c, a, b, *_ in (r for r in rows if r[0] == q):
            old = best.setdefault(c, [None, None])
            for n, v in enumerate((a, None if b is None else -b)):
                if v is not None and (old[n] is None or v > old[n]):
                    old[n] = v
        n = len(best)
        marks = {}
        for c, vs in best.items():
            m = []
            for k_, v in enumerate(vs):
                column = [x[k_] for x in best.values()]
                if all(x is None for x in column) or (v is not None and n == 1):
                    m.append(1.0)
                elif v is None:
                    m.append(0.0)
                else:
                    below = sum(x is None or x < v for x in column)
                    m.append((2 * below + sum(x == v for x in column) - 1) / 2 / (n - 1))
            marks[c] = sorted(m)
        order = sorted(marks, key=lambda c: ([-x for x in marks[c]], c))
        out[q] = order[:k]
    return out


def ranked(spark, rows, **kw):
    got = leximin_rank(spark.createDataFrame(rows, ROW), "q", "c", SCORES, **kw).collect()
    out = {}
    for r in sorted(got, key=lambda r: r.place):
        out.setdefault(r.q, []).append(r.c)
    return out


def test_leximin_matches_brute_force_in_both_paths(spark):
    rng = random.Random(1)
    rows = [(q, f"c{n}", rng.choice([None, 1.0, 2.0, 1e9, rng.random()]), rng.choice([None, 1, 2, 3]), "x") for q in range(6) for n in range(12)]
    rows += rows[:9] + [(9, "only", 1.0, None, None), (8, "x", None, None, None), (8, "y", None, None, None)]
    assert ranked(spark, rows) == brute(rows)
    assert ranked(spark, rows, k=3) == brute(rows, 3)
    assert ranked(spark, rows, hot_rows=5) == brute(rows)
    assert ranked(spark, rows, hot_rows=5, k=2) == brute(rows, 2)


def test_leximin_of_nothing_and_nan(spark):
    assert ranked(spark, []) == {}
    assert ranked(spark, [(1, "a", float("nan"), 1, None), (1, "b", 0.5, 1, None)]) == {1: ["b", "a"]}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n,!x", max_size=400), st.integers(1, 20), st.integers(0, 12))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[a + back : b] for a, b, back in pieces) == text
    assert all(-(-(b - a) // 4) <= limit for a, b, _ in pieces)
    assert all(back <= overlap * 4 for *_, back in pieces)


def test_weakest_boundaries_are_merged_first():
    text = "one two. three four.\n\nfive six"
    assert [text[a:b] for a, b, _ in split_text(text, 6, 0)] == ["one two. three four.\n\n", "five six"]
    assert merge_atoms(atoms("a b c", 10), lambda a, b: b - a <= 10) == [(0, 5)]
    word = "y" * 50
    assert [b - a for a, b, _ in split_text(word, 5, 0)] == [20, 20, 10]


def test_split_oversized_defines_odd_rows(spark):
    rows = [("chunk", "a", "word " * 40, 10, 2), ("chunk", "a", "word " * 40, 10, 2), ("chunk", "n", None, 10, 2), ("chunk", "e", "", 10, 2), ("chunk", "s", "short", 10, 2), ("chunk", "l", "x" * 99, None, 2), ("chunk", "o", "word " * 40, 10, None), (None, "k", "z" * 60, 0, 0)]
    frame = spark.createDataFrame(rows, "item_kind string, item_id string, text string, max_tokens int, overlap_tokens int").withColumn("piece_no", F.lit(7))
    got = split_oversized(frame).collect()
    assert {r.item_id for r in got} == {"a", "o", "k"}
    first = sorted((r.piece_no, r.piece_text) for r in got if r.item_id == "a")
    assert len({n for n, _ in first}) == len(first) and all(r.token_count <= 10 for r in got if r.item_id != "k")
    assert split_oversized(frame.limit(0)).count() == 0


def test_an_overlap_over_half_the_limit():
    from ravelin.llm.splitting import split_text

    text = "abcd " * 200
    for most, lap in ((10, 8), (10, 10), (10, 30), (1, 1)):
        pieces = split_text(text, most, lap)
        assert all(b - a <= 4 * most for a, b, _ in pieces) and pieces[-1][1] == len(text)
        assert all(after[0] + after[2] == before[1] for before, after in zip(pieces, pieces[1:]))
        assert max(back for _, _, back in pieces) >= 4 * min(lap, most - 1) - 5
