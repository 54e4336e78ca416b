from ravelin.operators import layout

SPAN = "doc string, page int, block int, line int, span_no int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"


def test_headings_are_scored(spark):
    spans = [("d", p, 0, n, 0, "plain body text of the page", 10.0, False, 50.0, 200.0 + 12 * n, 300.0, 210.0 + 12 * n) for p in (1, 2, 3, 4) for n in range(3)]
    spans += [("d", 2, 1, 9, 0, "2.1 Results", 14.0, True, 50.0, 150.0, 200.0, 164.0), ("d", 3, 1, 9, 0, "Figure 3: a plot", 14.0, True, 50.0, 150.0, 200.0, 164.0), ("d", 4, 1, 9, 0, "2.2 Cells", 14.0, True, 60.0, 500.0, 200.0, 514.0)]
    spans += [("d", p, 2, 20, 0, "Running title", 14.0, True, 50.0, 150.0, 200.0, 164.0) for p in (1, 2, 3, 4)]
    frame = spark.createDataFrame(spans, SPAN)
    pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in (1, 2, 3, 4)], "doc string, page int, width double, height double")
    tables = spark.createDataFrame([("d", 4, 40.0, 480.0, 400.0, 560.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.text): (r.score, r.accepted) for r in layout.heading_scores(frame, pages, tables).collect()}
    assert got[2, "2.1 Results"] == (7.0, True) and got[3, "Figure 3: a plot"] == (0.0, False)
    assert got[4, "2.2 Cells"][0] == 2.0 and not got[2, "Running title"][1] and got[1, "plain body text of the page"][0] == 0.0


def test_levels_and_offsets(spark):
    sizes = spark.createDataFrame([("d", 20.0), ("d", 19.0), ("d", 16.0), ("d", 14.6)], "doc string, size double")
    assert {r.size: r.level for r in layout.heading_levels(sizes).collect()} == {20.0: 1, 19.0: 1, 16.0: 2, 14.6: 2}
    heads = spark.createDataFrame([("d", 1, 0, "B"), ("d", 1, 1, "A"), ("d", 1, 2, "B"), ("d", 1, 3, "zz")], "doc string, page int, ord int, text string")
    pages = spark.createDataFrame([("d", 1, "A B A", 100)], "doc string, page int, text string, page_start int")
    assert {r.text: r.char_offset for r in layout.heading_offsets(heads, pages).collect()} == {"B": 102, "A": 104, "zz": 100}


def test_body_size_of_ties_and_nothing(spark):
    frame = spark.createDataFrame([("d", 1, 0, 0, 0, "abcd", 12.2, False, 0.0, 0.0, 1.0, 1.0), ("d", 1, 0, 1, 0, "efgh", 9.0, False, 0.0, 0.0, 1.0, 1.0)], SPAN)
    assert layout.body_size(frame).first().body == 12.0
    assert layout.body_size(frame.limit(0)).count() == 0


def test_headings_from_a_table_of_contents_or_from_spans(spark):
    spans = [(d, p, 0, n, 0, "plain body text of the page", 10.0, False, 50.0, 200.0 + 12 * n, 300.0, 210.0 + 12 * n) for d in ("t", "s") for p in (1, 2, 3, 4) for n in range(3)]
    spans += [(d, 2, 1, 9, 0, "2.1 Results", 14.0, True, 50.0, 150.0, 200.0, 164.0) for d in ("t", "s")]
    pages = spark.createDataFrame([(d, p, 600.0, 800.0, p % 2) for d in ("t", "s") for p in (1, 2, 3, 4)], "doc string, page int, width double, height double, n_drawings int")
    tables = spark.createDataFrame([], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    toc = spark.createDataFrame([("t", 0, 1, "Opening", 1), ("t", 1, 2, " 2.1 Results ", 2), ("t", 2, 1, " ", 3), ("t", 3, 1, "Gone", 9)], "doc string, ord int, level int, title string, page int")
    texts = spark.createDataFrame([(d, p, "body 2.1 Results" if p == 2 else "body", 100 * p) for d in ("t", "s") for p in (1, 2, 3, 4)], "doc string, page int, text string, page_start int")
    got = {r.doc: (r.structure_tier, [tuple(h) for h in r.headings]) for r in layout.headings_of(frame(spark, spans), pages, tables, toc, texts).collect()}
    assert got == {"t": (1, [(1, "Opening", 100), (2, "2.1 Results", 205)]), "s": (2, [(1, "2.1 Results", 205)])}
    assert layout.table_pages(pages).count() == 4


def frame(spark, spans):
    return spark.createDataFrame(spans, SPAN)
