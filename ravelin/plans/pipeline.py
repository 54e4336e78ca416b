"""The two lifecycles: from files to an index, from a question to its contexts."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ravelin.functions.plugins import EngineConfig, NoRewriter, Reranker, Rewriter, generate, hash_encoder, overlap_reranker
from ravelin.functions.text import embed_text, rewrite_variants
from ravelin.operators import chunking, dense, fusion, lexical
from ravelin.operators.knowledge_base import KnowledgeBase, embed_chunks
from ravelin.session import cut
from ravelin.sources.tables import LOG, append_log


def chunk_documents(docs: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """``(chunks, parent_windows)`` of parsed documents: table chunks, code chunks, then text chunks.

    Ids are hashes of the document's id and the place, so a task that runs again gives the same.
    """
    def ident(*parts):
        return F.sha2(F.concat_ws("|", *parts), 256)

    meta = docs.select("doc_id", "original_filename", "title")
    code, _ = chunking.code_blocks(docs.select("doc_id", "full_text"), "doc_id", "full_text")
    rest = chunking.without_code(docs.select("doc_id", "full_text", "headings"), "full_text")
    segments = chunking.heading_segments(rest, "doc_id", "full_text", "headings", config.segment_tokens)
    segments = segments.withColumn("segment_id", ident("doc_id", F.lit("s"), "char_start", "part_no"))
    windows = chunking.parent_windows(segments, "segment_id", "segment_text", config.parent_tokens)
    placed = windows.withColumnsRenamed({"char_start": "ws", "char_end": "we"}).join(segments.select("segment_id", "doc_id", "heading_path", "segment_text", "char_start"), "segment_id")
    placed = placed.withColumn("parent_window_id", ident("segment_id", F.lit("w"), "window_no")).withColumn("window_text", F.substring("segment_text", F.col("ws") + 1, F.col("we") - F.col("ws")))
    pieces = chunking.child_chunks(placed.select("parent_window_id", "window_text"), "parent_window_id", "window_text", config.chunk_tokens, config.overlap_sentences)
    pieces = pieces.withColumn("chunk_text", F.regexp_replace("chunk_text", "\n{3,}", "\n\n")).filter("chunk_text <> ''").withColumnsRenamed({"char_start": "cs", "char_end": "ce"})
    text = pieces.join(placed.select("parent_window_id", "segment_id", "doc_id", "heading_path", (F.col("char_start") + F.col("ws")).alias("base")), "parent_window_id").select(
        "doc_id", F.lit("text").alias("chunk_type"), "parent_window_id", "segment_id", "heading_path", "chunk_text", (F.col("base") + F.col("cs")).alias("char_start"), (F.col("base") + F.col("ce")).alias("char_end"), "token_count",
        ident("parent_window_id", F.lit("c"), "chunk_no").alias("chunk_id"),
    )
    none, no_path = F.lit("none"), F.array().cast("array<string>")
    coded = code.select(
        "doc_id", F.lit("code").alias("chunk_type"), none.alias("parent_window_id"), none.alias("segment_id"), no_path.alias("heading_path"), "chunk_text", F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"),
        "token_count", ident("doc_id", F.lit("k"), "block_no", "unit_no").alias("chunk_id"),
    )
    listed = docs.select("doc_id", F.posexplode("tables").alias("table_no", "t")).select(ident("doc_id", F.lit("t"), "table_no").alias("table_id"), "doc_id", "t.markdown", "t.char_start", "t.char_end")
    tabled = chunking.table_chunks(listed, "table_id", "markdown", config.chunk_tokens).join(listed.drop("markdown"), "table_id").select(
        "doc_id", F.lit("table").alias("chunk_type"), none.alias("parent_window_id"), none.alias("segment_id"), no_path.alias("heading_path"), "chunk_text", "char_start", "char_end", "token_count",
        ident("table_id", "chunk_no").alias("chunk_id"),
    )
    every = tabled.unionByName(coded).unionByName(text).join(meta, "doc_id")
    chunks = every.select(
        "chunk_id", "parent_window_id", "segment_id", "chunk_text", embed_text(F.col("title"), F.col("heading_path"), F.col("chunk_text")).alias("embed_text"), "char_start", "char_end", "token_count",
        F.struct("doc_id", "original_filename", "title", "heading_path", "chunk_type").alias("metadata"),
    )
    lookup = placed.select("parent_window_id", "segment_id", "doc_id", (F.col("char_start") + F.col("ws")).alias("char_start"), (F.col("char_start") + F.col("we")).alias("char_end"), "token_count")
    return chunks, lookup


def with_text_tables(docs: DataFrame) -> DataFrame:
    """Plain text documents with the tables that their lines make, where the parser found none."""
    plain = docs.filter((F.col("parser_used") == "txt_parser") & (F.coalesce(F.size("tables"), F.lit(0)) <= 0))
    found = chunking.text_tables(plain, "doc_id", "full_text").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_line", "markdown"))).alias("found"))
    made = F.transform("found", lambda t: F.struct(F.lit(None).cast("int").alias("page"), t["markdown"].alias("markdown"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end")))
    return docs.join(found, "doc_id", "left").withColumn("tables", F.coalesce(made, "tables")).drop("found")


def ingest(
    spark: SparkSession, path: str, batch: str, kb_id: str, docs: DataFrame, config: EngineConfig = EngineConfig(),
    encode: Callable[[Column], Column] | None = None, progress: Callable[[int, str], None] = lambda percent, step: None,
) -> DataFrame:
    """Chunk, encode and index the parsed documents that are new; one row of counts.

    Documents known by id or content are left out before they are chunked; a text is encoded only
    if the store's cache lacks it. ``progress`` is told the percentage and the step.
    """
    base, encode = KnowledgeBase(spark, path), encode or hash_encoder(config.dim)
    listed = docs.select(F.lit(kb_id).alias("kb_id"), "doc_id", "content_hash", "original_filename")
    progress(10, "parsing")
    new = docs.join(base.fresh(listed, batch).select("doc_id"), "doc_id", "left_semi")
    progress(30, "chunking")
    chunks, lookup = chunk_documents(with_text_tables(new), config)
    chunks, lookup = cut(chunks), cut(lookup)
    progress(50, "embedding")
    cache = base.read("cache", without=batch)
    cache = spark.createDataFrame([], "embed_text_hash string, dense_vector array<float>") if cache is None else cache.select("embed_text_hash", "dense_vector")
    embedded, fresh = embed_chunks(chunks, cache, encode, config.dim)
    progress(80, "indexing")
    done = base.append(batch, embedded.select("chunk_id", "dense_vector", "embed_text_hash"), chunks, listed)
    base.put(batch, {"cache": fresh, "parent_lookup": lookup.withColumn("kb_id", F.lit(kb_id))})
    progress(100, "done")
    return done


def retrieve(
    spark: SparkSession, path: str, documents: DataFrame, query: str, config: EngineConfig = EngineConfig(), rewriter: Rewriter = NoRewriter(), kb_id: str | None = None,
    encode: Callable[[Column], Column] | None = None, reranker: Reranker = overlap_reranker,
) -> tuple[DataFrame, DataFrame]:
    """``(candidates, contexts)`` of a question to one knowledge base (or all): variants, both searches on the stored index, fusion, hydration, rerank, parents."""
    base, encode = KnowledgeBase(spark, path), encode or hash_encoder(config.dim)
    records = base.read("records", kb_id)
    asked = spark.createDataFrame([(rewriter.rewrite(query), query)], "response string, query string")
    variants = asked.select(rewrite_variants(F.col("response"), F.col("query")).alias("v")).first().v
    vectors = {r.n: list(r.v) for r in spark.createDataFrame(list(enumerate(variants)), "n int, q string").select("n", encode("q").alias("v")).collect()}
    text = F.element_at(F.array(*[F.lit(v) for v in variants]), F.col("q_ord").cast("int") + 1)
    close = dense.dense_topk(vectors, base.read("vectors", kb_id), "global_chunk_id", "dense_vector", config.top_k_dense).select(F.col("q_ord").cast("int").alias("q_ord"), text.alias("query"), F.lit(0).alias("src_ord"), F.lit("dense").alias("source"), F.col("global_chunk_id").alias("id"), "rank")
    words = lexical.bm25_stored(variants, base.read("postings", kb_id), base.read("doc_len", kb_id), "global_chunk_id", config.top_k_bm25)
    words = words.select("q_ord", text.alias("query"), F.lit(1).alias("src_ord"), F.lit("bm25").alias("source"), F.col("global_chunk_id").alias("id"), "rank")
    fused = fusion.rrf(close.unionByName(words), "id", config.top_k_rrf, config.rrf_k)
    hydrated = records.select(F.col("global_chunk_id").alias("id"), "chunk_id", "doc_id", "parent_window_id", "segment_id", "chunk_text").join(F.broadcast(fused), "id")
    score = reranker(F.lit(query), F.col("chunk_text")) if config.rerank_enabled else F.lit(None).cast("double")
    ranked = fusion.rerank(hydrated.withColumn("rerank_score", score), "rerank_score", "place", config.top_k_rerank)
    found = fusion.contexts(fusion.by_parent(ranked), base.read("parent_lookup", kb_id), documents, config.max_contexts)
    return ranked, found


def ask(
    spark: SparkSession, path: str, documents: DataFrame, query: str, kb_id: str, models: list, log: str | None = None, config: EngineConfig = EngineConfig(),
    rewriter: Rewriter = NoRewriter(), encode: Callable[[Column], Column] | None = None, reranker: Reranker = overlap_reranker,
) -> dict:
    """Retrieve and answer within a knowledge base, with the seconds of both steps; a line of the query log is appended if ``log`` is named."""
    began = time.perf_counter()
    _, contexts = retrieve(spark, path, documents, query, config, rewriter, kb_id, encode, reranker)
    contexts = cut(contexts)  # max_contexts rows
    middle = time.perf_counter()
    out = answer(contexts, query, models, config)
    out["timings"] = {"retrieval": round(middle - began, 2), "generation": round(time.perf_counter() - middle, 2)}
    if log is not None:
        row = (datetime.now(timezone.utc).isoformat(timespec="seconds"), query, kb_id, len(out["answer"]), out["model_used"], out["answer"], [r.parent_text for r in contexts.select("rank", "parent_text").orderBy("rank").collect()])
        append_log(spark.createDataFrame([row], LOG), log)
    return out


def answer(contexts: DataFrame, query: str, models: list, config: EngineConfig = EngineConfig()) -> dict:
    """The generated answer from the contexts that fit the budget (``max_contexts`` rows at most)."""
    blocks = fusion.budget(contexts, config.max_context_tokens).orderBy("number").collect()
    return generate(query, [b.block for b in blocks], [(b.doc_id, b.parent_window_id) for b in blocks], models)
