import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import scanned as P, sentences as S

CLEAN = "The ceramic pump must be inspected within ten working days. Security will forward every low-cost invoice to the department. The cost of the scanned manual depends on the query. Please label the committee and the reranker. "
PAGE = """NARROW PUMP AND INVOICE    p. 7
The ceramic pump must be inspected within ten w0rking days. Secu-
rity will forward every low-
cost invoice to the department. The cost of the scarmed manual
NARROW PUMP AND INV0ICE
8
depends on the qucry. The pump cost 3O4 and Braquin saw it.

Please label the cornmittee and the reranker within ten working days.
Total
3611

Security will forward the invoice to the committee."""


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, full_text string, original_filename string").withColumn("text", F.lit("clash"))


def test_a_page_is_repaired(spark):
    frame = docs(spark, [("clean", CLEAN * 30, "x.txt"), ("page", PAGE, "narrow_pump_and_invoice_12.pdf"), ("page", PAGE, "narrow_pump_and_invoice_12.pdf"), ("n", None, None), ("e", "", None), (None, PAGE, None)])
    got = {(r.line_no, r.kind, r.repaired) for r in P.scan_defects(frame).collect() if r.doc_id == "page"}
    assert got == {
        (0, "furniture", ""), (4, "furniture", ""), (5, "furniture", ""), (1, "hyphen", "security"), (2, "hyphen", "low-cost"),
        (1, "misread", "working"), (3, "misread", "scanned"), (6, "misread", "query"), (6, "misread", "304"), (8, "misread", "committee"),
    }
    parts = [r.text for r in P.scan_paragraphs(frame).filter("doc_id = 'page'").orderBy("paragraph_no").collect()]
    assert parts[0].startswith("The ceramic pump must be inspected within ten working days. Security will forward every low-cost invoice")
    assert "scanned manual depends on the query. The pump cost 304 and Braquin saw it." in parts[0]
    assert {r.doc_id for r in P.scan_defects(frame).collect()} == {"page"} and P.scan_defects(frame.limit(0)).count() == 0


def decoder(**counts):
    return P.Decoder(P.Excerpt(counts, np.zeros(P.TRIGRAMS, np.int64), 1 << 20))


def test_words_are_decoded_across_blanks():
    read = decoder(ceramic=300, inspection=300, pump=300, the=30000, of=30000, lantern=90)
    assert read.priced("ceramicinspection")[1] == ("ceramic", "inspection") and read.priced("unknownword")[1] == ("unknownword",)
    assert read.read("cerarnic") == "ceramic" and read.joined("inspec", "tion") == "inspection" and read.token("2O15") == "2015" and read.token("13B") == "138" and read.token("1b") == "16"
    findings, _, words = P._read("The insp ection of the cer amic lan-\ntern ofthe purnp (ex ample) Lan Tern", set(), read)
    assert " ".join(w for _, w in words).split() == ["The", "inspection", "of", "the", "ceramic", "lantern", "of", "the", "pump", "(ex", "ample)", "Lan", "Tern"]
    assert findings == [(0, "hyphen", "lantern"), (1, "misread", "pump")]


def test_a_word_with_many_misread_letters():
    read = decoder(communication=4000, classification=4000)
    assert read.read("cornrnunicotlon") == "communication" and read.read("c1oss1f1cat1on") == "classification"
    grams = np.random.default_rng(8).integers(0, 90, P.TRIGRAMS)
    excerpt = P.Excerpt({}, grams, 9)
    score = lambda w: sum(np.log1p(grams[P.xxhash.xxh3_64_intdigest(f"^{w}$"[k : k + 3]) % P.TRIGRAMS]) for k in range(len(w)))
    choices = [letters if letters != "?" else "il" for letters in "?a?a?a?a?a?a?"]
    every = ["".join(x) for x in itertools.product(*choices)]
    assert len(every) == 128 and score(excerpt.likeliest(choices)) == pytest.approx(max(map(score, every)))
    assert P.Decoder(excerpt).read("1a|a1a|a1a|a1") in {"".join(x) for x in itertools.product(*choices)}


def wrapped(paragraph, width):
    lines, line = [], ""
    for word in paragraph.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*lines, line]


def boundaries(parts):
    return {part[0] for part in parts if part[0]}


def test_paragraphs_are_found_by_their_length_too():
    """Wrapped paragraphs without blank lines: the program finds them better than any threshold on the same hints."""
    rng = np.random.default_rng(4)
    sentence = lambda: " ".join(rng.choice(["pump", "ceramic", "valve", "of", "the", "inspection", "a"], rng.integers(5, 14))).capitalize() + "."
    right = found = true = plain_right = plain_found = 0
    for _ in range(60):
        body, starts = [], set()
        for n in range(8):
            starts.add(len(body))
            body += [(len(body) + k, line) for k, line in enumerate(wrapped(" ".join(sentence() for _ in range(rng.integers(5, 8))), 60))]
        starts -= {0}
        got = boundaries(P.paragraphs(body, 60, (np.log(340), 0.25)))
        plain = {k for k in range(1, len(body)) if body[k - 1][1].endswith(".") and len(body[k - 1][1]) < 36}
        right, found, true = right + len(got & starts), found + len(got), true + len(starts)
        plain_right, plain_found = plain_right + len(plain & starts), plain_found + len(plain)
    f = lambda hit, made: 2 * hit / (made + true)
    assert f(right, found) > f(plain_right, plain_found) + 0.1 and right / true > 0.7


def test_a_scan_with_a_long_line_and_a_short_one(spark):
    long = PAGE + "\n" + "x" * 300
    frame = docs(spark, [("clean", CLEAN * 30, "x.txt"), ("long", long, None), ("short", "The pump was inspected by the secu-\nrity department.", None)])
    got = {(r.doc_id, r.kind, r.repaired) for r in P.scan_defects(frame).collect()}
    assert {("long", "misread", "working"), ("long", "hyphen", "low-cost"), ("short", "hyphen", "security")} <= got


def test_a_paragraph_of_many_lines_stays_whole():
    body = [(n, "and the pump was taken to the other hall by the men who") for n in range(1000)]
    assert [len(p) for p in P.paragraphs(body, 60)] == [1000]


def test_confusions_keep_the_strokes(spark):
    assert all(P.strokes(right) == P.strokes(seen) for right, seen in P.CONFUSIONS)
    words = ["cornmittee", "w0rking", "oﬃce|k7", "naïve-4d", "", *(w for pair in P.CONFUSIONS for w in pair)]
    assert [r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select(P.strokes_of(F.col("w")).alias("s")).collect()] == [P.strokes(w) for w in words]
    assert P.confusions("cornmittcc", "committee") == 3 and P.confusions("pump", "pump") == 0 and P.confusions("pump", "pomp") is None


def test_rare_words_stay_in_a_large_lexicon(spark):
    many = [" ".join(f"x{n}q" for n in range(k, k + 5000)) for k in range(0, 265_000, 5000)]
    frame = docs(spark, [("clean", CLEAN * 30, "x.txt"), ("rare", "The quillwort was photographed by a lepidopterist. It stands in the garden of the old house near the river and in no other text that we have read so far.", "r.txt"), *((f"m{n}", t, "m.txt") for n, t in enumerate(many)), ("page", PAGE.replace("qucry", "qui1lwort").replace("Secu-\nrity", "lepidop-\nterist"), "narrow_pump_and_invoice_12.pdf")])
    got = {(r.line_no, r.kind, r.repaired) for r in P.scan_defects(frame).collect()}
    assert {(6, "misread", "quillwort"), (1, "hyphen", "lepidopterist"), (3, "misread", "scanned")} <= got
    assert P.learn(frame.filter("doc_id != 'page'").select(F.col("full_text").alias("text")))[0].filter("n = 1").count() > 265_000


EXPECTED = {
    "Dr. Branof closes at 6 p.m. The gasket failed at 10.30 a.m. and again.": ["Dr. Branof closes at 6 p.m.", "The gasket failed at 10.30 a.m. and again."],
    'The label reads: "Do not touch it!" Nobody did. "It is late. We go," said the clerk.': ['The label reads: "Do not touch it!"', "Nobody did.", '"It is late. We go," said the clerk.'],
    "(It is not included. Really.) The pump (cf. App. 9) is idle.The file a_4.final.docx holds 40 batches.": ["(It is not included. Really.)", "The pump (cf. App. 9) is idle.", "The file a_4.final.docx holds 40 batches."],
    "Notes on the pump\nThe pump is idle.\n\n* First item\n* Second item\n\nEnds in mid": ["Notes on the pump", "The pump is idle.", "* First item", "* Second item", "Ends in mid"],
    "“查询很内部。我们再测量一次。”财务部的人说。财务部问：“目录在哪里？”文件很长！": ["“查询很内部。我们再测量一次。”财务部的人说。", "财务部问：“目录在哪里？”", "文件很长！"],
    "「表は新しい。もう一度。」と経理部は言った。版8.0.3の表（旧目録。以下同じ。）を翻訳する。": ["「表は新しい。もう一度。」と経理部は言った。", "版8.0.3の表（旧目録。以下同じ。）を翻訳する。"],
    "क्या मशीन तैयार है? लंबाई 14.75 से.मी. है। मत छुइए!": ["क्या मशीन तैयार है?", "लंबाई 14.75 से.मी. है।", "मत छुइए!"],
    "Ist die Karte neu? Nein. Sie wird evtl. geprüft. Nr. 67 gilt im 2. Stock.": ["Ist die Karte neu?", "Nein.", "Sie wird evtl. geprüft.", "Nr. 67 gilt im 2. Stock."],
    "มีคู่มือ 8 ชุดในฝ่ายจัดซื้อ เราวัดปั๊มเก่าแล้ว": ["มีคู่มือ 8 ชุดในฝ่ายจัดซื้อ", "เราวัดปั๊มเก่าแล้ว"],
}


def test_sentences_of_many_scripts(spark):
    d = "/root/testdata/sf0.01/documents.parquet"
    try:
        base = spark.read.parquet(d).select("doc_id", "text")
    except Exception:  # noqa: BLE001
        pytest.skip("no test tables here")
    texts = list(EXPECTED)
    extra = spark.createDataFrame([(10**9 + n, t) for n, t in enumerate(texts)] + [(2 * 10**9, None), (2 * 10**9 + 1, " \n "), (None, "A b.")], "doc_id long, text string")
    got = S.split_sentences(base.unionByName(extra).withColumn("sent_start", F.lit(0))).filter("doc_id >= 1000000000").collect()
    for n, text in enumerate(texts):
        spans = sorted((r.sent_start, r.sent_end) for r in got if r.doc_id == 10**9 + n)
        assert [text[a:b] for a, b in spans] == EXPECTED[text]
    assert {r.doc_id for r in got} == {10**9 + n for n in range(len(texts))}


def test_held_out_accuracy_on_reliable_boundaries(spark):
    try:
        rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("text is not null")
    except Exception:  # noqa: BLE001
        pytest.skip("no test tables here")
    counts = S.boundary_counts(rows)
    texts = {r.doc_id: r.text for r in rows.collect()}
    model = S.train([t for d, t in sorted(texts.items()) if d % 2], counts)
    right = total = 0
    for text in (t for d, t in sorted(texts.items()) if not d % 2):
        for start, end, whole in S.structure(text):
            for c in [] if whole else S.candidates(text[start:end]):
                if (label := S.reliable(c, counts)) is not None:
                    total += 1
                    right += (model.probability(c) > 0.5) == label
    assert total > 3000 and right / total >= 0.99


def test_sentences_cover_everything_but_space(spark):
    frame = spark.createDataFrame([(1, "A b c. D e f! «G h. I», j k. L"), (1, "A b c. D e f! «G h. I», j k. L"), (2, "x" * 30000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.sent_start, r.sent_end) for r in S.split_sentences(frame).collect())
    assert len(got) == len(set(got)) and (2, 0, 30000) in got
    text = frame.first().text
    covered = "".join(text[a:b] for d, a, b in got if d == 1)
    assert covered.replace(" ", "") == text.replace(" ", "")
    assert S.split_sentences(frame.limit(0)).count() == 0


def test_quotations_of_any_length():
    inner = "It stops. " * 1200
    text = f'The note says "{inner.strip()}" and no more. Then (a "loose mark and {inner.strip()}) it goes "on". Done.'
    pairs = S.matched(text)
    assert pairs[text.index('"')] > 11_000 and max(b - a for a, b in pairs.items()) > 11_000
    assert S.matched('he said "one and then "two" and (three [four) five' + "[" * 50_000) == {22: 26, 32: 44}


def test_composed_and_decomposed_letters_are_alike():
    one, two = (S.candidates(t) for t in ("Le café. Été venu. Fin", "Le cafe\u0301. E\u0301te\u0301 venu. Fin"))
    assert [(c.left, c.after) for c in one] == [(c.left, c.after) for c in two]
