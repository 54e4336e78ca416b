"""Scalar text and vector functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CHARS_PER_TOKEN = 4


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Every line stripped, then the whole."""
    return strip(F.array_join(F.transform(F.split(c, r"\R"), strip), "\n"))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def token_count(c: Column) -> Column:
    """The built-in estimate: characters over four, rounded up; 0 for null and empty."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / CHARS_PER_TOKEN).cast("int")


def embed_text(title: Column, path: Column, chunk: Column) -> Column:
    """Title, heading path and chunk, joined by blank lines; empty parts are left out."""
    return F.concat_ws("\n\n", F.nullif(title, F.lit("")), F.nullif(F.array_join(path, " > "), F.lit("")), F.nullif(strip(chunk), F.lit("")))


def bm25_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text; every other character separates."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Divided by the norm; the zero vector stays."""
    # The norm is bound by an outer array of one, so that it is not computed again for every component.
    return F.transform(F.array(norm(v)), lambda n: F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n)))[0]


def valid_vector(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))


def sparse_clean(m: Column) -> Column:
    """Without zero weights; keys are stripped, and of equal ones the last stays."""
    entries = F.transform(F.filter(F.map_entries(m), lambda e: e["value"].isNotNull() & (e["value"] != 0)), lambda e: F.struct(strip(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda e, i: F.exists(entries, lambda x: (x["key"] == e["key"]) & (F.array_position(entries, x) > i + 1) & (x != e))
    return F.map_from_entries(F.array_distinct(F.filter(entries, lambda e, i: ~later(e, i))))


def valid_table(markdown: Column) -> Column:
    """At least four words besides rules, blanks and generated column names."""
    cells = F.filter(F.split(markdown, r"[|\s]+"), lambda x: ~x.rlike(r"^[-: ]*$") & ~x.rlike(r"^Col\d+$"))
    return F.size(cells) >= 4


def low_text(c: Column, least: int = 100) -> Column:
    return F.length(c) < least


def preview(c: Column, n: int) -> Column:
    return F.substring(F.translate(c, "\n", " "), 1, n)


def file_type(content: Column) -> Column:
    """By the first bytes; ``zip`` still has to be looked into (see ``sources.files``)."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(content.isNull() | (F.length(content) == 0), "unknown").when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip")
        .when(head == "D0CF11E0A1B11AE1", "doc").otherwise("txt")
    )


def kb_name(c: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` only; null if none is left."""
    return F.nullif(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", ""), F.lit(""))


def rewrite_variants(response: Column, query: Column, most: int = 4) -> Column:
    """Query variants of a rewriter's answer: a JSON list (fenced or not), else lines without bullets; the query comes first."""
    bare = strip(F.regexp_replace(strip(response), r"^```(?:json)?\s*|\s*```$", ""))
    listed = F.from_json(F.when(bare.startswith("["), bare), "array<string>")
    lines = F.transform(F.split(bare, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^(?:[-*]\s+|\d+[.)]\s*)", "")))
    keep = lambda a: F.filter(a, lambda x: x.isNotNull() & (strip(x) != "") & (x != query))
    return F.slice(F.concat(F.array(query), keep(F.coalesce(listed, lines))), 1, most)
