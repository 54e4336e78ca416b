"""Segmentation: sentences, packing folds, tables, code, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ravelin.functions.text import CHARS_PER_TOKEN, strip, token_count

SEGMENT_TOKENS, PARENT_TOKENS, CHUNK_TOKENS, OVERLAP = 4000, 2500, 400, 2
LONG_SENTENCE, LONG_PIECE, WORD_SLICE = 2000, 1500, 1000
#: Fixed value: a piece up to the white space behind its end; leading blanks belong to the piece after them.
PIECE = r"(?s)\s*(?:[.!?]+\s+|\S.*?(?:[.!?]+\s+|\n{2,}|\z))"
FENCE = r"(?s)```(\w*)[^\S\n]*\n?(.*?)(?:```|\z)"
CODE_UNIT = r"(?m)(?=^(?:def |class |function |const \w+ = \([^)]*\) =>))"


def _tokens_of(size: Column) -> Column:
    return F.ceil(size / CHARS_PER_TOKEN).cast("int")


def fold_bounds(sizes: Column, cap: int) -> Column:
    """Greedy packing of an array of sizes: ``array<struct<a, b>>`` of half-open index ranges.

    A range is closed when the next size would exceed ``cap`` and it isn't empty, so one size
    above the cap stays alone.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(s: Column, size: Column) -> Column:
        full = (s["n"] + size > cap) & (s["i"] > s["a"])
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(full, s["i"]).otherwise(s["a"]).alias("a"), F.when(full, size.cast("long")).otherwise(s["n"] + size).alias("n"),
            F.when(full, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b"))))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(sizes, start, step, lambda s: F.when(s["i"] > s["a"], F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b"))))).otherwise(s["out"]))


def overlap_bounds(sizes: Column, cap: int, overlap: int = OVERLAP) -> Column:
    """Like ``fold_bounds``, but a range begins with up to ``overlap`` sizes of the one before, as many of the last as fit."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    between = lambda a, b: F.aggregate(F.slice(sizes, a + 1, b - a), F.lit(0).cast("long"), lambda t, x: t + x)

    def step(s: Column, size: Column) -> Column:
        full = (s["n"] + size > cap) & (s["i"] > s["a"])
        begin = F.filter(F.sequence(F.greatest(s["a"], s["i"] - overlap), s["i"]), lambda x: (x == s["i"]) | (between(x, s["i"]) + size <= cap))[0]
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(full, begin).otherwise(s["a"]).alias("a"), F.when(full, between(begin, s["i"]) + size).otherwise(s["n"] + size).alias("n"),
            F.when(full, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b"))))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(sizes, start, step, lambda s: F.when(s["i"] > s["a"], F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b"))))).otherwise(s["out"]))


def split_long(piece: Column, limit: int, target: int) -> Column:
    """The piece, or if above ``limit`` characters its words packed to ``target``; words above it are sliced."""
    part = min(WORD_SLICE, target)
    words = F.flatten(F.transform(F.regexp_extract_all(piece, F.lit(r"\s*\S+\s*$|\s*\S+"), 0), lambda w: F.when(
        F.length(w) > target, F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / part).cast("int")), lambda k: F.substring(w, k * part + 1, F.lit(part)))
    ).otherwise(F.array(w))))
    packed = F.transform(fold_bounds(F.transform(words, F.length), target), lambda r: F.array_join(F.slice(words, r["a"] + 1, r["b"] - r["a"]), ""))
    return F.when(F.length(piece) > limit, packed).otherwise(F.array(piece))


def sentence_pieces(text: Column) -> Column:
    """Pieces that end after ``.!?`` with white space, at blank lines or at the end; long ones are cut at words.

    Joined they give the text (but for blanks at its end). Null and blank texts give none.
    """
    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), 0), lambda p: split_long(p, LONG_SENTENCE, LONG_PIECE)))


def paragraph_pieces(text: Column, separator: str = "\n\n") -> Column:
    return F.split(text, separator)


def _joined(pieces: Column, r: Column, by: str = "") -> Column:
    return F.array_join(F.slice(pieces, r["a"] + 1, r["b"] - r["a"]), by)


def pseudo_segments(docs: DataFrame, key: str, text: str, cap: int = SEGMENT_TOKENS, separator: str = "\n\n") -> DataFrame:
    """Paragraphs packed greedily: ``(key, segment_no, segment_text, token_count)``; an oversize paragraph stays whole."""
    split = docs.filter(F.col(text).isNotNull()).select(key, paragraph_pieces(F.col(text), separator).alias("p"))
    split = split.withColumn("t", F.transform("p", token_count))
    ranges = split.select(key, "p", "t", F.posexplode(fold_bounds(F.col("t"), cap)).alias("segment_no", "r"))
    total = F.aggregate(F.slice("t", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")), F.lit(0), lambda s, x: s + x)
    return ranges.select(key, "segment_no", _joined(F.col("p"), F.col("r"), separator).alias("segment_text"), total.alias("token_count"))


def parent_windows(docs: DataFrame, key: str, text: str, cap: int = PARENT_TOKENS) -> DataFrame:
    """Sentences packed greedily without overlap: ``(key, window_no, char_start, char_end, token_count)``; a text within the cap is one window."""
    split = docs.filter(F.length(strip(F.col(text))) > 0).select(key, F.col(text).alias("text"), sentence_pieces(F.col(text)).alias("p"))
    split = split.withColumn("t", F.transform("p", token_count)).withColumn("n", F.transform("p", F.length))
    bounds = F.when(token_count(F.col("text")) <= cap, F.array(F.struct(F.lit(0).alias("a"), F.size("p").alias("b")))).otherwise(fold_bounds(F.col("t"), cap))
    ranges = split.select(key, "t", "n", F.posexplode(bounds).alias("window_no", "r"))
    total = lambda c, a, b: F.aggregate(F.slice(c, a + 1, b - a), F.lit(0), lambda s, x: s + x)
    start = F.when(F.col("r.a") > 0, total("n", F.lit(0), F.col("r.a"))).otherwise(F.lit(0))
    return ranges.select(key, "window_no", start.alias("char_start"), (start + total("n", F.col("r.a"), F.col("r.b"))).alias("char_end"), total("t", F.col("r.a"), F.col("r.b")).alias("token_count"))


def child_chunks(docs: DataFrame, key: str, text: str, cap: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Sentences packed to ``cap`` with up to ``overlap`` repeated: ``(key, chunk_no, chunk_text, char_start, char_end, token_count)``.

    Spans come from prefix sums and slice exactly to the unstripped chunk. The count of a closed
    chunk is the sum of its sentences', that of the last one the count of its stripped text.
    """
    split = docs.filter(F.length(strip(F.col(text))) > 0).select(
        key, F.flatten(F.transform(sentence_pieces(F.col(text)), lambda p: split_long(p, cap * CHARS_PER_TOKEN, cap * CHARS_PER_TOKEN))).alias("p")
    )
    split = split.withColumn("t", F.transform("p", token_count)).withColumn("n", F.transform("p", F.length))
    ranges = split.select(key, "p", "t", "n", F.posexplode(overlap_bounds(F.col("t"), cap, overlap)).alias("chunk_no", "r"))
    total = lambda c, a, b: F.aggregate(F.slice(c, a + 1, b - a), F.lit(0), lambda s, x: s + x)
    start = F.when(F.col("r.a") > 0, total("n", F.lit(0), F.col("r.a"))).otherwise(F.lit(0))
    chunk = strip(_joined(F.col("p"), F.col("r")))
    count = F.when(F.col("r.b") == F.size("p"), token_count(chunk)).otherwise(total("t", F.col("r.a"), F.col("r.b")))
    return ranges.select(key, "chunk_no", chunk.alias("chunk_text"), start.alias("char_start"), (start + total("n", F.col("r.a"), F.col("r.b"))).alias("char_end"), count.alias("token_count"))


def text_tables(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more lines with the same delimiter and column count: ``(key, first_line, n_rows, n_cols, markdown)``.

    A line with three pipes or more is a row of pipes + 1 cells, else one with three tabs or
    more. Each run is folded from the lines of its own text, so nothing is shuffled.
    """
    count = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))

    def kind(line: Column) -> Column:
        return F.when(count(line, "|") >= 3, F.concat(F.lit("|"), (count(line, "|") + 1).cast("string"))).when(count(line, "\t") >= 3, F.concat(F.lit("\t"), (count(line, "\t") + 1).cast("string"))).otherwise(F.lit(""))

    lines = docs.filter(F.col(text).isNotNull()).select(key, F.split(F.col(text), "\n").alias("lines")).withColumn("kinds", F.transform("lines", kind)).filter(F.exists("kinds", lambda k: k != ""))
    begins = F.filter(F.transform("kinds", lambda k, i: F.when((k != "") & ((i == 0) | (F.col("kinds")[F.greatest(i - 1, F.lit(0))] != k)), i)), lambda x: x.isNotNull())
    runs = lines.select(key, "lines", "kinds", F.explode(begins).alias("a"))
    same = F.aggregate(
        F.slice("kinds", F.col("a") + 1, F.size("kinds")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, k: F.struct(F.when(s["on"] & (k == F.col("kinds")[F.col("a")]), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & (k == F.col("kinds")[F.col("a")])).alias("on")), lambda s: s["n"],
    )
    rows = runs.withColumn("n_rows", same).filter(F.col("n_rows") >= least)
    mark = F.substring(F.col("kinds")[F.col("a")], 1, 1)
    row = lambda line: F.concat(F.lit("| "), F.array_join(F.transform(F.split(line, F.when(mark == "|", F.lit("\\|")).otherwise(F.lit("\t"))), strip), " | "), F.lit(" |"))
    cols = F.substring(F.col("kinds")[F.col("a")], 2, 9).cast("int")
    body = F.transform(F.slice("lines", F.col("a") + 1, F.col("n_rows")), row)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), cols), " | "), F.lit(" |"))
    markdown = F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.size(body))), "\n")
    return rows.select(key, F.col("a").alias("first_line"), "n_rows", cols.alias("n_cols"), markdown.alias("markdown"))


def table_chunks(tables: DataFrame, key: str, markdown: str, cap: int = CHUNK_TOKENS) -> DataFrame:
    """Tables within the cap or of three lines at most stay whole; of others rows are packed below the repeated header: ``(key, chunk_no, chunk_text, token_count)``."""
    lines = F.filter(F.split(F.col(markdown), "\n"), lambda x: strip(x) != "")
    split = tables.filter(F.col(markdown).isNotNull()).select(key, F.col(markdown).alias("m"), lines.alias("l")).filter(F.size("l") > 0)
    head = F.when(F.element_at("l", F.least(F.lit(2), F.size("l"))).contains("---") & (F.size("l") > 1), F.lit(2)).otherwise(F.lit(1))
    split = split.withColumn("h", F.array_join(F.slice("l", F.lit(1), head), "\n")).withColumn("rows", F.slice("l", head + 1, F.size("l")))
    whole = (token_count(F.col("m")) <= cap) | (F.size("l") <= 3)
    head_cost = token_count(F.col("h"))

    def step(s: Column, cost: Column) -> Column:
        full = (s["n"] + cost + head_cost > cap) & (s["i"] > s["a"])
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(full, s["i"]).otherwise(s["a"]).alias("a"), F.when(full, cost.cast("long")).otherwise(s["n"] + cost).alias("n"),
            F.when(full, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b"))))).otherwise(s["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    bounds = F.aggregate(F.transform("rows", token_count), begin, step, lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b")))))
    pieces = F.when(whole, F.array(F.col("m"))).otherwise(F.transform(bounds, lambda r: F.concat(F.col("h"), F.lit("\n"), _joined(F.col("rows"), r, "\n"))))
    return split.select(key, F.posexplode(pieces).alias("chunk_no", "chunk_text")).withColumn("token_count", token_count(F.col("chunk_text")))


def _find(text: Column, word: Column, at: Column) -> Column:
    """Offset of the word at or behind ``at``, -1 if there is none."""
    return F.call_function("locate", word, text, at + 1).cast("int") - 1


def table_starts(docs: DataFrame, key: str, text: str, tables: str) -> DataFrame:
    """Where each table of ``array<struct<markdown, char_start>>`` stands: given, else its first word from a cursor, else from the start, else the cursor."""
    word = lambda m: F.try_element_at(F.filter(F.split(m, r"[|\s]+"), lambda x: (F.length(x) > 1) & ~x.rlike(r"^[-:|]+$")), F.lit(1))

    def place(s: Column, t: Column) -> Column:
        w = F.coalesce(word(t["markdown"]), F.lit(""))
        later, first = _find(F.col(text), w, s["cursor"]), _find(F.col(text), w, F.lit(0))
        at = F.coalesce(t["char_start"], F.when(w == "", s["cursor"]).when(later >= 0, later).when(first >= 0, first).otherwise(s["cursor"]))
        return F.struct((at + F.length(w)).alias("cursor"), F.concat(s["out"], F.array(at)).alias("out"))

    begin = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("out"))
    return docs.select(key, F.posexplode(F.aggregate(F.col(tables), begin, place, lambda s: s["out"])).alias("table_no", "char_start"))


def code_blocks(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Fenced code as ``(key, chunk_no, chunk_text, token_count)``, cut before definitions and fenced again, and the texts without it.

    A fence opens and the next one closes it; one that is never closed runs to the end. Texts
    without a fence are not searched.
    """
    has = docs.filter(F.contains(F.col(text), F.lit("```")))
    blocks = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(FENCE), 1).alias("lang"), F.regexp_extract_all(F.col(text), F.lit(FENCE), 2).alias("body"))
    units = has.select(key, F.posexplode(blocks).alias("block_no", "b")).select(key, "block_no", "b.lang", F.posexplode(F.split("b.body", CODE_UNIT)).alias("unit_no", "unit"))
    kept = units.filter(strip(F.col("unit")) != "")
    chunk = F.concat(F.lit("```"), F.col("lang"), F.lit("\n"), strip(F.col("unit")), F.lit("\n```"))
    chunks = kept.select(key, "block_no", "unit_no", chunk.alias("chunk_text")).withColumn("token_count", token_count(F.col("chunk_text")))
    rest = docs.withColumn(text, F.when(F.contains(F.col(text), F.lit("```")), F.regexp_replace(F.col(text), FENCE, "")).otherwise(F.col(text)))
    return chunks, rest


def without_code(docs: DataFrame, text: str) -> DataFrame:
    """The texts with line ends in the place of fenced code, as many as it has characters, so that offsets stay."""
    fences = F.transform(F.regexp_extract_all(F.col(text), F.lit(FENCE), 0), lambda x: F.repeat(F.lit("\n"), F.length(x)))
    masked = F.array_join(F.zip_with(F.split(F.col(text), FENCE, -1), fences, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    return docs.withColumn(text, F.when(F.contains(F.col(text), F.lit("```")), masked).otherwise(F.col(text)))


def heading_path(headings: Column) -> Column:
    """Of ``array<struct<level, text, char_offset>>`` in order: for each heading the texts of its open ancestors and itself."""
    begin = F.struct(F.array().cast("array<struct<level:int,text:string>>").alias("stack"), F.array().cast("array<array<string>>").alias("out"))

    def push(s: Column, h: Column) -> Column:
        stack = F.concat(F.filter(s["stack"], lambda x: x["level"] < h["level"]), F.array(F.struct(h["level"].cast("int").alias("level"), h["text"].alias("text"))))
        return F.struct(stack.alias("stack"), F.concat(s["out"], F.array(F.transform(stack, lambda x: x["text"]))).alias("out"))

    return F.aggregate(headings, begin, push, lambda s: s["out"])


def heading_segments(docs: DataFrame, key: str, text: str, headings: str, cap: int = SEGMENT_TOKENS) -> DataFrame:
    """Sections between headings: ``(key, segment_no, heading_path, char_start, char_end, segment_text, token_count)``.

    Headings are taken by offset; what stands before the first has an empty path. Sections are
    stripped, blank ones left out, those above the cap packed by paragraph. Offsets are those of
    the text as given. A document without headings is one section.
    """
    ordered = F.array_sort(F.coalesce(F.col(headings), F.array().cast("array<struct<level:int,text:string,char_offset:int>>")), lambda a, b: F.when(a["char_offset"] < b["char_offset"], -1).when(a["char_offset"] > b["char_offset"], 1).otherwise(0))
    base = docs.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("text"), ordered.alias("h"))
    marks = base.withColumn("paths", heading_path(F.col("h"))).withColumn("n", F.length("text"))
    section = lambda h, i: F.struct(F.least(h["char_offset"], F.col("n")).alias("a"), F.coalesce(F.least(F.get(F.col("h"), i + 1)["char_offset"], F.col("n")), F.col("n")).alias("b"), F.get(F.col("paths"), i).alias("path"))
    first = F.struct(F.lit(0).alias("a"), F.coalesce(F.get(F.col("h"), F.lit(0))["char_offset"], F.col("n")).alias("b"), F.array().cast("array<string>").alias("path"))
    parts = marks.select(key, "text", F.explode(F.concat(F.array(first), F.transform("h", section))).alias("s"))
    body = strip(F.substring(F.col("text"), F.col("s.a") + 1, F.col("s.b") - F.col("s.a")))
    kept = parts.withColumn("body", body).filter(F.col("body") != "")
    paragraphs = F.split("body", "\n\n")
    packed = F.transform(fold_bounds(F.transform(paragraphs, token_count), cap), lambda r: _joined(paragraphs, r, "\n\n"))
    pieces = F.when(token_count(F.col("body")) > cap, packed).otherwise(F.array("body"))
    return kept.select(key, F.col("s.path").alias("heading_path"), F.col("s.a").alias("char_start"), F.col("s.b").alias("char_end"), F.posexplode(pieces).alias("part_no", "segment_text")).withColumn("token_count", token_count(F.col("segment_text")))
