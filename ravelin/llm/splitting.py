"""Splitting oversized items at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

CHARS_PER_TOKEN = 4
PIECE = "item_kind string, item_id string, piece_no int, char_start int, char_end int, overlap_chars int, token_count int, piece_text string"

#: Strength of the boundary that ends with a match, strongest first.
STRENGTHS = ((5, r"\n[ \t]*\n\s*"), (4, r"\n\s*"), (3, r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[」』”’）]*"), (2, r"(?<=[,;:])\s+"), (1, r"\s+"))


def char_tokens(n_chars: int) -> int:
    """Tokens of a text of ``n_chars`` characters: a quarter, rounded up."""
    return -(-n_chars // CHARS_PER_TOKEN)


def atoms(text: str, room: int) -> list[tuple[int, int, int]]:
    """Atomic segments ``(start, end, strength of the boundary at end)``, none above ``room`` characters."""
    ends: dict[int, int] = {}
    for strength, pattern in reversed(STRENGTHS):
        for m in re.finditer(pattern, text):
            if 0 < m.end() < len(text):
                ends[m.end()] = max(ends.get(m.end(), 0), strength)
    out, start = [], 0
    for end in [*sorted(ends), len(text)]:
        while end - start > room:
            out.append((start, start + room, 0))
            start += room
        if end > start:
            out.append((start, end, ends.get(end, 9)))
            start = end
    return out


def merge_atoms(parts: list[tuple[int, int, int]], fits: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Merge adjacent segments, weakest boundary first (then the smallest pair), while ``fits(start, end)``."""
    n = len(parts)
    start, end = [p[0] for p in parts], [p[1] for p in parts]
    strength = [p[2] for p in parts]
    left, right, alive, stamp = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n, [0] * n

    def entry(a: int, b: int) -> tuple[int, int, int, int, int, int]:
        return (strength[a], end[b] - start[a], a, b, stamp[a], stamp[b])

    heap = [entry(a, a + 1) for a in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, a, b, sa, sb = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or stamp[a] != sa or stamp[b] != sb or not fits(start[a], end[b]):
            continue
        end[a], strength[a], right[a], alive[b] = end[b], strength[b], right[b], False
        stamp[a] += 1
        if right[a] < n:
            left[right[a]] = a
            heapq.heappush(heap, entry(a, right[a]))
        if left[a] >= 0:
            heapq.heappush(heap, entry(left[a], a))
    return [(start[a], end[a]) for a in range(n) if alive[a]]


def split_text(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int]]:
    """Pieces ``(start, end, overlap)``; each, overlap included, is within ``max_tokens``.

    Without their overlaps the pieces follow each other and cover the text. An overlap is as long
    as ``overlap_tokens`` allows and begins at a word if it holds one. One of ``max_tokens`` or more
    is taken as one token less, for a piece has to add something.
    """
    limit = max(1, max_tokens) * CHARS_PER_TOKEN
    if len(text) <= limit:
        return [(0, len(text), 0)] if text else []
    overlap = min(max(0, overlap_tokens) * CHARS_PER_TOKEN, limit - CHARS_PER_TOKEN)
    room = limit - overlap
    bodies = merge_atoms(atoms(text, room), lambda a, b: b - a <= room)
    out = []
    for start, end in bodies:
        back = min(overlap, start)
        if back and not text[start - back - 1 : start - back].isspace() and start > back:
            word = re.compile(r"\s+").search(text, start - back, start)
            back = start - word.end() if word and word.end() < start else back
        out.append((start - back, end, back))
    return out


def split_oversized(items: DataFrame) -> DataFrame:
    """Cut ``(item_kind, item_id, text, max_tokens, overlap_tokens)`` rows above their limit into pieces.

    A token is four characters, rounded up per text. Only rows above the limit leave the JVM.
    Every piece, its overlap included, is within the limit; cuts fall at paragraphs, lines,
    sentences, clauses or words, the strongest that are left when no merge fits any more, and
    inside a word only if the word alone is too long.

    Null texts or limits and empty texts give no row; a limit below 1 counts as 1. Repeated rows
    of an id give their pieces once (of the longest text). Other columns are ignored; an empty
    table gives an empty table. One text is one task's work, whatever its length.
    """
    over = (
        items.select("item_kind", "item_id", "text", "max_tokens", "overlap_tokens")
        .filter(F.ceil(F.length("text") / CHARS_PER_TOKEN) > F.col("max_tokens"))
        .groupBy("item_kind", "item_id", "max_tokens", "overlap_tokens")
        .agg(F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"))
    )

    def cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, item, most, lap, text in zip(batch.item_kind, batch.item_id, batch.max_tokens, batch.overlap_tokens, batch.text):
                lap = 0 if lap is None or pd.isna(lap) else int(lap)
                for n, (a, b, back) in enumerate(split_text(text, int(most), lap)):
                    rows.append((kind, item, n, a, b, back, char_tokens(b - a), text[a:b]))
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "char_start", "char_end", "overlap_chars", "token_count", "piece_text"])

    return over.mapInPandas(cut_rows, PIECE)


def sized_items(spark, sf_dir: str) -> DataFrame:
    """Documents, parent windows and chunks of the tables with their limits, as ``split_oversized`` takes them.

    The limits (a row per kind of item) are joined as data. A window's text is its span of the
    document; only windows whose span exceeds the limit, and documents long enough to hold such
    a span, are joined.
    """
    limits = F.broadcast(spark.read.parquet(f"{sf_dir}/size_limits.parquet").filter(F.col("item_kind").isin("document", "parent_window", "chunk")))
    docs = spark.read.parquet(f"{sf_dir}/parsed_documents.parquet").select("doc_id", "full_text")
    windows = spark.read.parquet(f"{sf_dir}/parent_windows.parquet").select("parent_window_id", "doc_id", "char_start", "char_end")
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet").select("chunk_id", "chunk_text")

    def limited(df: DataFrame, kind: str, size) -> DataFrame:
        of = limits.filter(F.col("item_kind") == kind)
        return df.join(of, size > F.col("max_tokens") * CHARS_PER_TOKEN)

    whole = limited(docs, "document", F.length("full_text")).select("item_kind", F.col("doc_id").alias("item_id"), F.col("full_text").alias("text"), "max_tokens", "overlap_tokens")
    wide = limited(windows, "parent_window", F.col("char_end") - F.col("char_start")).distinct()
    long_docs = limited(docs, "parent_window", F.length("full_text")).select("doc_id", "full_text")
    spans = wide.join(long_docs, "doc_id").select(
        "item_kind", F.col("parent_window_id").alias("item_id"),
        F.substring("full_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"), "max_tokens", "overlap_tokens",
    )
    pieces = limited(chunks, "chunk", F.length("chunk_text")).select("item_kind", F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"), "max_tokens", "overlap_tokens")
    return whole.unionByName(spans).unionByName(pieces)
