"""Headings of paged documents, scored from text spans with fonts and positions.

Spans: ``doc, page, block, line, span_no, text, size, bold, x0, y0, x1, y1``; pages: ``doc,
page, width, height``; tables: ``doc, page, x0, y0, x1, y1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Thresholds and weights of the heading score.
ACCEPT, DEFAULT_SIZE, LEVEL_GAP = 4.0, 12.0, 1.5
#: What a numbered heading begins with, and what is no heading (captions, page numbers, citations, separators).
NUMBERED = r"(?iU)^(?:(?:chapter|appendix|section|part|annex)\s+[\dA-Z]|\d+(?:\.\d+)*\.?\s+\S)"
CAPTION = r"(?iU)^(?:(?:figure|fig\.?|table|tbl\.?|chart|exhibit|plate|scheme)\s*\w|page\s+\d+|\d{1,4}$|(?:et\s+al|ibid|op\.?\s*cit)\b|[\W_]{3,}$)"


def font_histogram(spans: DataFrame) -> DataFrame:
    """Characters per font size, to the half point: ``(doc, size, n_chars, first)``."""
    solid = spans.filter(F.trim("text") != "")
    return solid.groupBy("doc", (F.bround(F.col("size") * 2) / 2).alias("size")).agg(F.sum(F.length("text")).alias("n_chars"), F.min(F.struct("page", "block", "line", "span_no")).alias("first"))


def body_size(spans: DataFrame) -> DataFrame:
    """The size most characters have, the first seen of equals: ``(doc, body)``; documents without spans have the default."""
    hist = font_histogram(spans)
    best = W.partitionBy("doc").orderBy(F.col("n_chars").desc(), "first")
    return hist.withColumn("r", F.row_number().over(best)).filter("r = 1").select("doc", F.col("size").alias("body"))


def _folded(c):
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def repeated_share(spans: DataFrame) -> DataFrame:
    """On which share of a document's pages a text stands: ``(doc, folded, share)``."""
    pages = spans.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    seen = spans.filter(F.trim("text") != "").groupBy("doc", _folded("text").alias("folded")).agg(F.countDistinct("page").alias("n"))
    return seen.join(pages, "doc").select("doc", "folded", (F.col("n") / F.col("pages")).alias("share"))


def metadata_zones(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Bands that hold metadata: ``(doc, page, top, bottom)``.

    On every page the outer 5 %; on the first three the outer 12 % if they hold two to eight
    lines in more than one size.
    """
    edge = pages.select("doc", "page", F.explode(F.array(
        F.struct(F.lit(0.0).alias("top"), (F.col("height") * 0.05).alias("bottom")), F.struct((F.col("height") * 0.95).alias("top"), F.col("height").cast("double").alias("bottom"))
    )).alias("z")).select("doc", "page", "z.top", "z.bottom")
    wide = pages.filter("page <= 3").select("doc", "page", F.explode(F.array(
        F.struct(F.lit(0.0).alias("top"), (F.col("height") * 0.12).alias("bottom")), F.struct((F.col("height") * 0.88).alias("top"), F.col("height").cast("double").alias("bottom"))
    )).alias("z")).select("doc", "page", "z.top", "z.bottom")
    middle = (F.col("y0") + F.col("y1")) / 2
    held = wide.join(spans.select("doc", "page", "block", "line", "size", "y0", "y1"), ["doc", "page"]).filter((middle >= F.col("top")) & (middle <= F.col("bottom")))
    busy = held.groupBy("doc", "page", "top", "bottom").agg(F.countDistinct("block", "line").alias("lines"), F.countDistinct(F.bround(F.col("size") * 2)).alias("sizes"))
    return edge.unionByName(busy.filter("lines between 2 and 8 and sizes > 1").select("doc", "page", "top", "bottom")).distinct()


def heading_scores(spans: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Every span with its heading score and whether it is accepted.

    For: larger than the body, bold, numbered, short, centred, capitals. Against: repeated on 30 %
    of the pages, inside a table, in a metadata zone, in a dense block of a full page.
    """
    keys = ["doc", "page", "block", "line", "span_no"]
    base = spans.join(body_size(spans), "doc", "left").join(pages, ["doc", "page"], "left").withColumn("folded", _folded("text"))
    base = base.join(repeated_share(spans), ["doc", "folded"], "left").withColumn("ratio", F.col("size") / F.coalesce("body", F.lit(DEFAULT_SIZE)))
    boxes = tables.select("doc", "page", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    in_table = spans.join(boxes, ["doc", "page"]).filter("x0 < tx1 and x1 > tx0 and y0 < ty1 and y1 > ty0").select(*keys).distinct().withColumn("in_table", F.lit(True))
    zones = metadata_zones(spans, pages)
    middle = (F.col("y0") + F.col("y1")) / 2
    in_zone = spans.join(zones, ["doc", "page"]).filter((middle >= F.col("top")) & (middle <= F.col("bottom"))).select(*keys).distinct().withColumn("in_zone", F.lit(True))
    dense = spans.groupBy("doc", "page", "block", "size").agg(F.countDistinct("line").alias("same")).join(spans.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("on_page")), ["doc", "page"])
    dense = dense.filter("on_page > 20 and same > 4").select("doc", "page", "block", "size", F.lit(True).alias("dense"))
    every = base.join(in_table, keys, "left").join(in_zone, keys, "left").join(dense, ["doc", "page", "block", "size"], "left")
    text, length = F.trim("text"), F.length(F.trim("text"))
    numbered, bold = text.rlike(NUMBERED), F.coalesce("bold", F.lit(False))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    capitals = (length > 3) & (F.upper(text) == text) & (F.lower(text) != text)
    centred = (F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("width") / 2) <= 0.15 * F.col("width")) & (length <= 120)
    point = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    score = (
        point(F.col("ratio") >= 1.10, 1.5) + point(F.col("ratio") >= 1.30, 1.0) + point(bold, 1.5) + point(numbered, 2.0) + point(length <= 80, 1.0) + point(centred, 0.5) + point(capitals, 0.5)
        - point(F.col("share") >= 0.3, 3.5) - point(F.col("in_table"), 5.0) - point(F.col("in_zone"), 2.5) - point(F.col("dense"), 1.5)
    )
    zero = (length < 2) | (letters < 2) | text.rlike(CAPTION) | ((F.col("ratio") < 1.05) & ~bold & ~numbered)
    scored = every.withColumn("score", F.when(zero, 0.0).otherwise(score))
    return scored.select(*keys, "text", "size", "score", (F.col("score") >= ACCEPT).alias("accepted"))


def heading_levels(sizes: DataFrame) -> DataFrame:
    """Levels of accepted sizes ``(doc, size)``: a new level where the gap to the next larger size is 1.5 or more: ``(doc, size, level)``."""
    order = W.partitionBy("doc").orderBy(F.col("size").desc())
    gap = F.lag("size").over(order) - F.col("size")
    steps = sizes.select("doc", "size").distinct().withColumn("new", F.coalesce((gap >= LEVEL_GAP).cast("int"), F.lit(0)))
    return steps.select("doc", "size", (F.lit(1) + F.sum("new").over(order)).cast("int").alias("level"))


def heading_offsets(headings: DataFrame, page_texts: DataFrame) -> DataFrame:
    """Where headings stand: ``(doc, page, text, char_offset)``, from ``(doc, page, ord, text)`` and ``(doc, page, text, page_start)``.

    A text counts once a page. Each is looked for behind the one before it, then from the page's
    start; one that is not found stands at the page's start.
    """
    once = headings.groupBy("doc", "page", "text").agg(F.min("ord").alias("ord"))
    listed = once.groupBy("doc", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("hs"))
    both = listed.join(page_texts.select("doc", "page", F.col("text").alias("body"), "page_start"), ["doc", "page"])
    find = lambda w, at: F.call_function("locate", w, F.col("body"), at + 1).cast("int") - 1

    def place(s, h):
        at = F.when(find(h, s["cursor"]) >= 0, find(h, s["cursor"])).when(find(h, F.lit(0)) >= 0, find(h, F.lit(0))).otherwise(F.lit(0))
        return F.struct((at + F.length(h)).alias("cursor"), F.concat(s["out"], F.array(F.struct(h.alias("text"), at.alias("at")))).alias("out"))

    begin = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<text:string,at:int>>").alias("out"))
    placed = both.select("doc", "page", "page_start", F.explode(F.aggregate("hs", begin, place, lambda s: s["out"])).alias("h"))
    return placed.select("doc", "page", F.col("h.text").alias("text"), (F.col("page_start") + F.col("h.at")).alias("char_offset"))


def toc_headings(toc: DataFrame, page_texts: DataFrame) -> DataFrame:
    """Headings of a table of contents ``(doc, ord, level, title, page)``: ``(doc, ord, level, text, char_offset)``.

    A title stands where its page has it, else at the page's start; blank titles and pages that
    are not there are left out. ``page_texts``: ``doc, page, text, page_start``.
    """
    listed = toc.select("doc", "ord", "level", F.trim("title").alias("title"), "page").filter("title <> ''")
    placed = listed.join(page_texts.select("doc", "page", F.col("text").alias("body"), "page_start"), ["doc", "page"])
    at = F.greatest(F.call_function("locate", F.col("title"), F.col("body")).cast("int") - 1, F.lit(0))
    return placed.select("doc", "ord", "level", F.col("title").alias("text"), (F.col("page_start") + at).alias("char_offset"))


def table_pages(pages: DataFrame) -> DataFrame:
    """Pages that may hold a table: those with vector drawings, for a page without any has no borders."""
    return pages.filter("coalesce(n_drawings, 0) > 0")


def headings_of(spans: DataFrame, pages: DataFrame, tables: DataFrame, toc: DataFrame, page_texts: DataFrame) -> DataFrame:
    """``(doc, structure_tier, headings)`` of paged documents: from the table of contents (tier 1), else from scored spans (tier 2)."""
    listed = toc_headings(toc, page_texts).withColumn("tier", F.lit(1))
    scored = heading_scores(spans.join(listed.select("doc").distinct(), "doc", "left_anti"), pages, tables).filter("accepted")
    levels = heading_levels(scored.select("doc", "size"))
    ord_ = F.row_number().over(W.partitionBy("doc", "page").orderBy("block", "line", "span_no"))
    ranked = scored.withColumn("text", F.trim("text")).withColumn("ord", ord_).join(levels, ["doc", "size"])
    levelled = ranked.groupBy("doc", "page", "text").agg(F.min_by("level", "ord").alias("level"))
    found = heading_offsets(ranked, page_texts).join(levelled, ["doc", "page", "text"]).select("doc", F.lit(0).alias("ord"), "level", "text", "char_offset", F.lit(2).alias("tier"))
    every = listed.select("doc", "ord", "level", "text", "char_offset", "tier").unionByName(found)
    rows = F.sort_array(F.collect_list(F.struct(F.col("char_offset").cast("int").alias("char_offset"), "ord", F.col("level").cast("int").alias("level"), "text")))
    return every.groupBy("doc").agg(F.max("tier").alias("structure_tier"), F.transform(rows, lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"), h["char_offset"].alias("char_offset"))).alias("headings"))
