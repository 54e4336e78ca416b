import math
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ravelin.operators import chunking as C

TEXTS = [
    None, "", "  \n ", "One. Two! Three? four\n\nFive", "\n\nlead. " + "word " * 700, "x" * 5000, "a b. " * 90, "Ärger... ja!  \n\n\n  nein. " * 12, "no end " * 400 + ". done",
]


def pieces(text):
    parts, out, lead = re.split(r"([.!?]+\s+|\n{2,})", text), [], ""
    for n in range(0, len(parts), 2):
        piece = lead + parts[n] + (parts[n + 1] if n + 1 < len(parts) else "")
        lead = ""
        if piece.strip():
            out.append(piece)
        else:
            lead = piece
    return out


def test_sentence_pieces_match_a_plain_split(spark):
    short = [t for t in TEXTS if t and len(t) < 900]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(short)], "id int, t string").select("id", C.sentence_pieces(F.col("t")).alias("p")).collect()
    for r in rows:
        assert r.p == pieces(short[r.id])


def test_long_pieces_are_cut_at_words_and_join_to_the_text(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t and t.strip()], "t string").select("t", C.sentence_pieces(F.col("t")).alias("p")).collect()
    for r in rows:
        assert "".join(r.p).rstrip() == r.t.rstrip()
        assert max(map(len, r.p)) <= C.LONG_SENTENCE


def fold(sizes, cap, overlap):
    out, a, cur = [], 0, 0
    for i, s in enumerate(sizes):
        if cur + s > cap and i > a:
            out.append((a, i))
            a = max(a, i - overlap)
            while a < i and sum(sizes[a:i]) + s > cap:
                a += 1
            cur = sum(sizes[a:i])
        cur += s
    return out + [(a, len(sizes))] if sizes else []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=25), min_size=1, max_size=8), st.integers(1, 60))
def test_folds_match_list_code(spark, lists, cap):
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(lists)], "id int, s array<int>")
    got = rows.select("id", C.fold_bounds(F.col("s"), cap).alias("plain"), C.overlap_bounds(F.col("s"), cap, 2).alias("lap")).collect()
    for r in got:
        assert [(x.a, x.b) for x in r.plain] == fold(lists[r.id], cap, 0)
        assert [(x.a, x.b) for x in r.lap] == fold(lists[r.id], cap, 2)


def test_child_chunks_slice_the_text(spark):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "doc_id int, text string")
    for r in C.child_chunks(docs, "doc_id", "text", 40).collect():
        assert TEXTS[r.doc_id][r.char_start : r.char_end].strip() == r.chunk_text
        assert r.token_count <= 40 + 1
    assert C.child_chunks(docs.limit(0), "doc_id", "text").count() == 0


def test_tables_are_found_and_cut_below_their_header(spark):
    table = "intro\n" + "\n".join(f"a{n} | b | c | d{n}" for n in range(40)) + "\nend\nx\ty\tz\tw\nx\ty\tz\tw"
    docs = spark.createDataFrame([("k", table), ("n", None), ("e", "")], "doc_id string, text string")
    found = C.text_tables(docs, "doc_id", "text").collect()
    assert [(r.first_line, r.n_rows, r.n_cols) for r in found] == [(1, 40, 4)]
    parts = C.table_chunks(spark.createDataFrame([("k", found[0].markdown)], "doc_id string, m string"), "doc_id", "m", 60).orderBy("chunk_no").collect()
    head = "\n".join(found[0].markdown.split("\n")[:2])
    assert len(parts) > 1 and all(p.chunk_text.startswith(head + "\n") for p in parts)
    assert [line for p in parts for line in p.chunk_text.split("\n")[2:]] == found[0].markdown.split("\n")[2:]


def test_code_is_fenced_again_and_taken_out(spark):
    text = "before\n```python\nimport os\ndef f():\n  pass\n\nclass A:\n  x = 1\n```\nafter ```js\nopen"
    docs = spark.createDataFrame([("k", text), ("n", None), ("p", "plain")], "doc_id string, text string")
    chunks, rest = C.code_blocks(docs, "doc_id", "text")
    assert [r.chunk_text for r in chunks.orderBy("block_no", "unit_no").collect()] == ["```python\nimport os\n```", "```python\ndef f():\n  pass\n```", "```python\nclass A:\n  x = 1\n```", "```js\nopen\n```"]
    assert {r.doc_id: r.text for r in rest.collect()} == {"k": "before\n\nafter ", "n": None, "p": "plain"}


def test_code_is_masked_in_place(spark):
    text = "before\n```python\nx = 1\n```\nafter ```js\nopen"
    docs = spark.createDataFrame([("k", text), ("n", None), ("p", "plain")], "doc_id string, text string")
    got = {r.doc_id: r.text for r in C.without_code(docs, "text").collect()}
    assert len(got["k"]) == len(text) and got["k"].split() == ["before", "after"] and got["k"].index("after") == text.index("after") and got["n"] is None and got["p"] == "plain"


def test_heading_paths_and_sections(spark):
    text = "pre\nA\nbody a\nB\nbody b\nC\nbody c"
    heads = [(2, "B", text.index("B\n")), (1, "A", text.index("A\n")), (1, "C", text.index("C\n"))]
    docs = spark.createDataFrame([("k", text, heads), ("n", "alone", None)], "doc_id string, text string, h array<struct<level:int,text:string,char_offset:int>>")
    got = [(r.doc_id, r.heading_path, r.segment_text) for r in C.heading_segments(docs, "doc_id", "text", "h").orderBy("doc_id", "char_start").collect()]
    assert got == [("k", [], "pre"), ("k", ["A"], "A\nbody a"), ("k", ["A", "B"], "B\nbody b"), ("k", ["C"], "C\nbody c"), ("n", [], "alone")]


def test_pseudo_segments_keep_an_oversize_paragraph(spark):
    text = "a" * 40 + "\n\n" + "b" * 400 + "\n\n" + "c" * 8
    got = C.pseudo_segments(spark.createDataFrame([("k", text)], "doc_id string, text string"), "doc_id", "text", 20).orderBy("segment_no").collect()
    assert [r.token_count for r in got] == [10, 100, 2]
    assert math.isclose(sum(len(r.segment_text) for r in got), 448)


def test_table_starts_thread_a_cursor(spark):
    docs = spark.createDataFrame([("k", "alpha x alpha y beta", [("| alpha | 1 |", None), ("| alpha | 2 |", None), ("| beta |", 3), ("| zz |", None)])], "doc_id string, text string, t array<struct<markdown:string,char_start:int>>")
    assert [r.char_start for r in C.table_starts(docs, "doc_id", "text", "t").orderBy("table_no").collect()] == [0, 8, 3, 7]
