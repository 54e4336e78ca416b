"""Registered queries of the core operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravelin.functions import text as T
from ravelin.operators import chunking, dense, fusion, knowledge_base as kb, layout, lexical

#: The questions the retrieval queries ask.
QUESTIONS = ["annual inspection of the hydraulic pump", "which department approves the invoice", "notes on the ceramic warranty", "report of the laboratory"]
QUERY_VECTORS = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(_docs(spark, sf_dir), "doc_id", "text")


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    stats = lexical.term_stats(lexical.postings(docs, "doc_id", "text"), lexical.corpus_stats(docs, "text"))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(QUESTIONS[:1], _docs(spark, sf_dir), "doc_id", "text", 10).select("doc_id", "score", "rank")


def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(QUESTIONS, _docs(spark, sf_dir), "doc_id", "text", 20).select("q_ord", "doc_id", "score", "rank")


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embedded_chunks").filter("dense_vector is not null").select("chunk_id", "dense_vector")
    unit = vectors.withColumn("u", T.l2_normalise(F.col("dense_vector")))
    return unit.select("chunk_id", F.round(T.norm(F.col("dense_vector")), 5).alias("norm"), F.round(T.norm(F.col("u")), 5).alias("unit_norm"))


def embedding_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embedded_chunks")
    return rows.groupBy(T.valid_vector(F.col("dense_vector"), 64).alias("valid"), F.coalesce(F.size("sparse_vector") == 0, F.lit(True)).alias("no_sparse")).agg(F.count(F.lit(1)).alias("n"))


def _every_50th(spark: SparkSession, sf_dir: str) -> dict[int, list[float]]:
    """The stated query set: every vector whose id 50 divides."""
    rows = _table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select("vec_id", "embedding").collect()
    return {int(r.vec_id): list(r.embedding) for r in rows}


def _query_vectors(spark: SparkSession, sf_dir: str, n: int) -> dict[int, list[float]]:
    rows = _table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < n).select("vec_id", "embedding").limit(n).collect()  # n rows by key
    return {int(r.vec_id): list(r.embedding) for r in rows}


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = dense.dense_topk(_query_vectors(spark, sf_dir, 1), _table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return hits.select("vec_id", "score", "rank")


def dense_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = dense.dense_search(_every_50th(spark, sf_dir), _table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20)
    return hits.select(F.col("q_ord").cast("int").alias("q_ord"), "vec_id", "score", "rank")


def _hits(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    close = dense.dense_topk(_query_vectors(spark, sf_dir, n), _table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20)
    words = lexical.bm25(QUESTIONS[:n], _docs(spark, sf_dir), "doc_id", "text", 20)
    text = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), F.col("q_ord").cast("int") + 1)
    close = close.select(F.col("q_ord").cast("int").alias("q_ord"), text.alias("query"), F.lit(0).alias("src_ord"), F.lit("dense").alias("source"), F.col("vec_id").alias("id"), "rank")
    return close.unionByName(words.select("q_ord", text.alias("query"), F.lit(1).alias("src_ord"), F.lit("bm25").alias("source"), F.col("doc_id").alias("id"), "rank"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_hits(spark, sf_dir, 1), "id", 15).fillna(0, ["dense_rank", "bm25_rank"]).select("id", "rrf_score", "dense_rank", "bm25_rank", "place")


def rrf_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf(_hits(spark, sf_dir, len(QUESTIONS)), "id", 50)
    return fused.fillna(0, ["dense_rank", "bm25_rank"]).select("id", "rrf_score", "dense_rank", "bm25_rank", F.size("matched_queries").alias("n_queries"), F.array_join("retrieval_sources", ",").alias("sources"), "place")


def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused ids with their documents: few ids first, then the join."""
    fused = fusion.rrf(_hits(spark, sf_dir, 1), "id", 15).select("id", "place")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "title", "source", F.sha2("text", 256).alias("text_hash"))
    return docs.join(F.broadcast(fused), docs.doc_id == fused.id).select("doc_id", "title", "source", "text_hash", "place")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.sentence_pieces(F.col("text"))).alias("pos", "piece"))
    return pieces.select("doc_id", "pos", F.sha2("piece", 256).alias("piece_hash"), F.length("piece").alias("n_chars"))


def pseudo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = chunking.pseudo_segments(_docs(spark, sf_dir), "doc_id", "text", 60)
    return segments.select("doc_id", "segment_no", F.sha2("segment_text", 256).alias("segment_hash"), "token_count")


def parent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parent_windows(_docs(spark, sf_dir), "doc_id", "text", 200)


def child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.child_chunks(_docs(spark, sf_dir), "doc_id", "text", 120).select("doc_id", "chunk_no", "char_start", "char_end", "token_count")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "parsed_documents").dropDuplicates(["doc_id"])


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _parsed(spark, sf_dir).select("kb_id", "content_hash", "batch_no", "arrival_no", "doc_id")
    return kb.first_by_hash(docs, "content_hash", ["batch_no", "arrival_no", "doc_id"], ["kb_id"]).select("kb_id", "doc_id")


def incremental_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "kb_manifest").select("kb_id", "doc_id", F.lower("content_hash").alias("content_hash"))
    docs = _parsed(spark, sf_dir).select("kb_id", "doc_id", F.lower("content_hash").alias("content_hash"))
    return kb.unseen(kb.unseen(docs, known, ["kb_id", "doc_id"]), known.filter("content_hash is not null"), ["kb_id", "content_hash"])


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.embed_text(F.col("metadata.title"), F.col("metadata.heading_path"), F.col("chunk_text"))
    return _table(spark, sf_dir, "chunks").select("chunk_id", text.alias("t")).select("chunk_id", F.sha2("t", 256).alias("embed_hash"), F.length("t").alias("n_chars")).distinct()


def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _table(spark, sf_dir, "embedded_chunks").select(F.lower("embed_text_hash").alias("embed_text_hash")).filter("embed_text_hash is not null")
    return kb.cache_misses(_table(spark, sf_dir, "chunks"), cache).select("embed_text_hash", F.length("embed_text").alias("n_chars"))


def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_tables(_parsed(spark, sf_dir), "doc_id", "full_text")


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _parsed(spark, sf_dir).select("doc_id", F.explode("tables.markdown").alias("markdown")).filter(T.valid_table(F.col("markdown")))
    return chunking.table_chunks(tables, "doc_id", "markdown", 100).select("doc_id", "chunk_no", "token_count", F.sha2("chunk_text", 256).alias("chunk_hash"))


def table_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.table_starts(_parsed(spark, sf_dir), "doc_id", "full_text", "tables")


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.code_blocks(_parsed(spark, sf_dir), "doc_id", "full_text")[0]


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _parsed(spark, sf_dir).select("doc_id", F.posexplode(chunking.heading_path(F.col("headings"))).alias("pos", "path"))
    return paths.select("doc_id", "pos", F.array_join("path", " > ").alias("path"))


def heading_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunking.heading_segments(_parsed(spark, sf_dir), "doc_id", "full_text", "headings")
    return parts.select("doc_id", F.array_join("heading_path", " > ").alias("path"), "char_start", "char_end", "part_no", F.sha2("segment_text", 256).alias("segment_hash"), "token_count")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text spans as a page parser gives them, laid out from the parsed texts: a line is a span, forty lines a page."""
    lines = _parsed(spark, sf_dir).select("doc_id", "headings", F.posexplode(F.split("full_text", "\n")).alias("n", "text")).filter("trim(text) <> ''")
    spans = lines.withColumn("level", F.try_element_at(F.transform(F.filter("headings", lambda h: h["text"] == F.col("text")), lambda h: h["level"]), F.lit(1)))
    size = F.when(F.col("level") == 1, 16.0).when(F.col("level") == 2, 13.0).otherwise(10.0)
    return spans.select(
        F.col("doc_id").alias("doc"), (F.floor(F.col("n") / 40) + 1).cast("int").alias("page"), F.lit(0).alias("block"), (F.col("n") % 40).cast("int").alias("line"), F.lit(0).alias("span_no"), "text",
        size.alias("size"), F.col("level").isNotNull().alias("bold"), F.lit(60.0).alias("x0"), (60 + (F.col("n") % 40) * 18.0).alias("y0"),
        (60 + F.least(F.length("text") * 5, F.lit(480))).cast("double").alias("x1"), (72 + (F.col("n") % 40) * 18.0).alias("y1"),
    )


def font_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.font_histogram(_spans(spark, sf_dir)).select("doc", "size", "n_chars")


def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    pages = spans.select("doc", "page").distinct().select("doc", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    boxes = spans.filter("text like '|%'").groupBy("doc", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return layout.heading_scores(spans, pages, boxes).filter("score <> 0").select("doc", "page", "line", "score", "accepted")


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.heading_levels(_spans(spark, sf_dir).filter("bold").select("doc", "size"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "retrieval_candidates").groupBy("query_id", "chunk_id").agg(
        F.min("doc_id").alias("doc_id"), F.min("parent_window_id").alias("parent_window_id"), F.max("rrf_score").alias("rrf_score"), F.max("rerank_score").alias("rerank_score"),
        F.max("matched_queries").alias("matched_queries"), F.max("retrieval_sources").alias("retrieval_sources"),
    )


def _reranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return fusion.rerank(_candidates(spark, sf_dir), "rerank_score", "chunk_id", k, "query_id")


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, 5).select("query_id", "chunk_id", "rerank_rank")


def parent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = fusion.by_parent(_reranked(spark, sf_dir, 10), "query_id")
    return grouped.select("query_id", "parent_window_id", F.array_join("source_chunks", ",").alias("chunks"), F.size("matched_queries").alias("n_queries"), F.array_join("retrieval_sources", ",").alias("sources"), "doc_id")


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = fusion.by_parent(_reranked(spark, sf_dir, 10), "query_id")
    return fusion.contexts(grouped, _table(spark, sf_dir, "parent_windows"), _table(spark, sf_dir, "parsed_documents"), 5, "query_id")


def parent_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("query_id", "rank", "parent_window_id", F.sha2("parent_text", 256).alias("text_hash"), F.size("source_chunks").alias("n_chunks"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.budget(_contexts(spark, sf_dir), 2000, "query_id").select("query_id", "number", "parent_window_id", "used")


def rewrite_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = spark.createDataFrame([(1, '```json\n["a one", "q", " ", "b two"]\n```', "q"), (2, "- first\n* second\n1. third\n2) fourth\n\n", "q"), (3, '["x", "y"]', "q"), (4, "", "q")], "id int, response string, query string")
    return answers.select("id", F.posexplode(T.rewrite_variants(F.col("response"), F.col("query"))).alias("pos", "variant"))


def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.manifest_stats(_table(spark, sf_dir, "kb_manifest")).select("kb_id", "total_documents", "total_hashes")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = _table(spark, sf_dir, "embedded_chunks").filter(T.valid_vector(F.col("dense_vector"), 64)).groupBy("chunk_id").agg(F.max_by("dense_vector", "generated_at").alias("dense_vector"))
    records, _ = kb.retrieval_records(embedded, _table(spark, sf_dir, "chunks"))
    return kb.assign_ids(records, spark.createDataFrame([], "global_chunk_id long"), ["doc_id", "chunk_id"])


def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).select("global_chunk_id", "chunk_id", "doc_id", "chunk_type")


def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _indexed(spark, sf_dir)
    vectors = _table(spark, sf_dir, "embedded_chunks").filter(T.valid_vector(F.col("dense_vector"), 64)).select("chunk_id").distinct()
    vectors = vectors.join(_table(spark, sf_dir, "chunks").select("chunk_id"), "chunk_id", "left_semi")
    return kb.alignment(vectors, records, records.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks")))


def orphan_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.retrieval_records(_table(spark, sf_dir, "embedded_chunks").select("chunk_id").distinct(), _table(spark, sf_dir, "chunks"))[1]


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).filter("text is not null").select(
        "doc_id", T.token_count(text).alias("tokens"), T.text_hash(text).alias("hash"), T.low_text(text).alias("low"), F.sha2(T.clean_text(text), 256).alias("clean_hash"), F.sha2(T.preview(text, 120), 256).alias("preview_hash")
    )


def sparse_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _table(spark, sf_dir, "embedded_chunks").select("chunk_id", T.sparse_clean(F.col("sparse_vector")).alias("m"))
    return kept.select("chunk_id", F.coalesce(F.size("m"), F.lit(0)).alias("n_terms")).distinct()


def next_kb_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("kb_id", r"^kb_(\d+)$", 1).try_cast("int")
    return _table(spark, sf_dir, "knowledge_bases").agg(F.format_string("kb_%03d", F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_kb"))


def kb_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "parsed_documents").groupBy("kb_id").agg(F.countDistinct("doc_id").alias("documents"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries as log lines, written as JSON and read again, with the time as it is shown."""
    rows = _table(spark, sf_dir, "retrieval_candidates").groupBy("query_id", "kb_id").agg(F.max("query_text").alias("query"), F.min("retrieved_at").alias("at"))
    lines = rows.select(F.to_json(F.struct("query_id", "kb_id", "query", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))).alias("line"))
    read = lines.select(F.from_json("line", "query_id long, kb_id string, query string, timestamp string").alias("e")).select("e.*")
    stamp = F.split("timestamp", "T")
    return read.select("query_id", "kb_id", "query", F.concat(stamp[0], F.lit(" "), F.substring(stamp[1], 1, 5)).alias("shown"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        tokenize_tf, bm25_term_stats, bm25_topk, bm25_multi_query, l2_normalize, embedding_validation, dense_topk, dense_multi_query, rrf_fusion, rrf_multi_query, hydrate,
        sentences, pseudo_segments, parent_windows, child_chunks, content_dedup, incremental_docs, embed_text, embedding_cache_misses, text_tables, table_chunks, table_starts, code_chunks,
        heading_paths, heading_segments, font_histogram, heading_scores, heading_levels, rerank_topk, parent_groups, parent_contexts, context_budget, rewrite_parse, manifest_stats,
        index_records, alignment_check, orphan_embeddings, text_features, sparse_cleanup, next_kb_id, kb_listing, query_log,
    )
}

_TOKENS = "tok AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM documents)"
_TF = f"{_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY ALL)"
_IDF = f"""{_TF}, st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_ASKED = ", ".join(f"({n}, '{q}')" for n, q in enumerate(QUESTIONS))
_BM25 = f"""{_IDF}, asked AS (SELECT * FROM (VALUES {_ASKED}) v(q_ord, query)),
qt AS (SELECT q_ord, unnest(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM asked),
sc AS (SELECT q_ord, doc_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / (SELECT avgdl FROM st)))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN tok USING (doc_id) GROUP BY q_ord, doc_id),
lex AS (SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"""
_DENSE = """qv AS (SELECT vec_id AS q_ord, embedding AS q FROM embeddings WHERE vec_id < 4),
dsc AS (SELECT q_ord, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score
  FROM embeddings, qv),
den AS (SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY score DESC, vec_id) AS rank FROM dsc)"""


def _fused_sql(n: int, k: int) -> str:
    return f"""{_BM25}, {_DENSE},
hits AS (SELECT q_ord, 0 AS src, 'dense' AS source, vec_id AS id, rank FROM den WHERE rank <= 20 AND q_ord < {n}
  UNION ALL SELECT q_ord, 1, 'bm25', doc_id, rank FROM lex WHERE rank <= 20 AND q_ord < {n}),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(CASE WHEN src = 0 THEN rank END)::INT AS dense_rank,
  min(CASE WHEN src = 1 THEN rank END)::INT AS bm25_rank, count(DISTINCT q_ord)::INT AS n_queries, min(q_ord * 1000000 + src * 100000 + rank) AS first,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM hits GROUP BY id),
placed AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, first) AS place FROM fused QUALIFY place <= {k})"""


_PIECES = r"""pc AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)\s*(?:[.!?]+\s+|\S.*?(?:[.!?]+\s+|\n{2,}|\z))') AS ps FROM documents WHERE regexp_matches(text, '\S')),
it AS (SELECT doc_id, i, ps[i] AS p, ceil(length(ps[i]) / 4.0)::INT AS t, ceil(length(text) / 4.0) <= 200 AS whole,
  coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) AS s FROM pc, unnest(range(1, len(ps) + 1)) r(i))"""
_PARSED = "parsed AS (SELECT DISTINCT ON (doc_id) * FROM parsed_documents)"
_SPANS = f"""{_PARSED}, ls AS (SELECT doc_id AS doc, headings, unnest(string_split(full_text, chr(10))) AS text FROM parsed),
spans AS (SELECT *, CASE level WHEN 1 THEN 16.0::DOUBLE WHEN 2 THEN 13.0::DOUBLE ELSE 10.0::DOUBLE END AS size
  FROM (SELECT doc, text, list_filter(headings, lambda h: h.text = text)[1].level AS level FROM ls WHERE trim(text, ' ') <> ''))"""
_RANKED = """cand AS (SELECT query_id, chunk_id, min(doc_id) AS doc_id, min(parent_window_id) AS parent_window_id, max(rrf_score) AS rrf_score, max(rerank_score) AS rerank_score,
  max(matched_queries) AS matched_queries, max(retrieval_sources) AS retrieval_sources FROM retrieval_candidates GROUP BY query_id, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, chunk_id) AS rerank_rank FROM cand)"""
_CONTEXTS = f"""{_RANKED}, grp AS (SELECT query_id, parent_window_id, max(coalesce(rerank_score, '-infinity'::DOUBLE)) AS best, min(rerank_rank) AS first, count(*)::INT AS n_chunks,
  arg_min(doc_id, rerank_rank) AS doc_id FROM ranked WHERE rerank_rank <= 10 GROUP BY query_id, parent_window_id),
best AS (SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first) <= 5),
win AS (SELECT parent_window_id, min(doc_id) AS d, min(char_start) AS s, min(char_end) AS e FROM parent_windows GROUP BY parent_window_id),
txt AS (SELECT doc_id AS d, max(full_text) AS full_text FROM parsed_documents GROUP BY doc_id),
ctx AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first) AS rank, parent_window_id, doc_id, substring(full_text, s + 1, e - s) AS parent_text, n_chunks
  FROM best JOIN win USING (parent_window_id) JOIN txt USING (d) WHERE parent_window_id <> 'none' AND full_text IS NOT NULL)"""
_INDEXED = """rec AS (SELECT chunk_id, any_value(metadata.doc_id) AS doc_id, any_value(metadata.chunk_type) AS chunk_type, any_value(chunk_text) AS chunk_text FROM chunks
  WHERE chunk_id IN (SELECT chunk_id FROM embedded_chunks WHERE len(dense_vector) = 64) GROUP BY chunk_id)"""

_LAYOUT = f"""{_PARSED}, raw AS (SELECT doc_id AS doc, headings, string_split(full_text, chr(10)) AS ls FROM parsed),
ln AS (SELECT doc, i - 1 AS n, ls[i] AS text, list_filter(headings, lambda h: h.text = ls[i])[1].level AS level FROM raw, unnest(range(1, len(ls) + 1)) r(i)),
sp AS (SELECT doc, (n // 40 + 1)::INT AS page, (n % 40)::INT AS line, text, CASE level WHEN 1 THEN 16.0::DOUBLE WHEN 2 THEN 13.0::DOUBLE ELSE 10.0::DOUBLE END AS size, level IS NOT NULL AS bold,
  60 + (n % 40) * 18.0::DOUBLE AS y0, 72 + (n % 40) * 18.0::DOUBLE AS y1, (60 + least(length(text) * 5, 480))::DOUBLE AS x1, trim(text, ' ') AS t, regexp_replace(lower(trim(text, ' ')), '\\s+', ' ', 'g') AS folded
  FROM ln WHERE trim(text, ' ') <> ''),
hist AS (SELECT doc, size, sum(length(text)) AS c, min((page, line)) AS f FROM sp GROUP BY doc, size),
body AS (SELECT doc, size AS body FROM hist QUALIFY row_number() OVER (PARTITION BY doc ORDER BY c DESC, f) = 1),
pg AS (SELECT doc, count(DISTINCT page) AS pages FROM sp GROUP BY doc),
share AS (SELECT doc, folded, count(DISTINCT page) * 1.0 / any_value(pages) AS share FROM sp JOIN pg USING (doc) GROUP BY doc, folded),
box AS (SELECT doc, page, min(y0) AS ty0, max(y1) AS ty1, max(x1) AS tx1 FROM sp WHERE text LIKE '|%' GROUP BY doc, page),
zone AS (SELECT doc, page, 0.0 AS a, 40.0 AS b FROM sp UNION SELECT doc, page, 760.0, 800.0 FROM sp
  UNION SELECT doc, page, a, b FROM (SELECT DISTINCT doc, page, line, size, y0, y1 FROM sp WHERE page <= 3), (VALUES (0.0, 96.0), (704.0, 800.0)) v(a, b) WHERE (y0 + y1) / 2 BETWEEN a AND b
  GROUP BY doc, page, a, b HAVING count(DISTINCT line) BETWEEN 2 AND 8 AND count(DISTINCT size) > 1),
dense AS (SELECT doc, page, size FROM sp GROUP BY doc, page, size HAVING count(DISTINCT line) > 4),
full_ AS (SELECT doc, page FROM sp GROUP BY doc, page HAVING count(*) > 20),
j AS (SELECT sp.*, size / body AS ratio, share, EXISTS (SELECT 1 FROM box b WHERE b.doc = sp.doc AND b.page = sp.page AND 60 < tx1 AND x1 > 60 AND y0 < ty1 AND y1 > ty0) AS in_table,
  EXISTS (SELECT 1 FROM zone z WHERE z.doc = sp.doc AND z.page = sp.page AND (y0 + y1) / 2 BETWEEN a AND b) AS in_zone,
  EXISTS (SELECT 1 FROM dense d JOIN full_ f ON f.doc = d.doc AND f.page = d.page WHERE d.doc = sp.doc AND d.page = sp.page AND d.size = sp.size) AS thick,
  regexp_matches(t, '(?i)^(?:(?:chapter|appendix|section|part|annex)\\s+[\\dA-Z]|\\d+(?:\\.\\d+)*\\.?\\s+\\S)') AS numbered FROM sp JOIN body USING (doc) JOIN share USING (doc, folded)),
sc AS (SELECT doc, page, line, CASE WHEN length(t) < 2 OR length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 2 OR (ratio < 1.05 AND NOT bold AND NOT numbered)
    OR regexp_matches(t, '(?i)^(?:(?:figure|fig\\.?|table|tbl\\.?|chart|exhibit|plate|scheme)\\s*[\\p{{L}}\\p{{N}}_]|page\\s+\\d+|\\d{{1,4}}$|(?:et\\s+al|ibid|op\\.?\\s*cit)\\b|[^\\p{{L}}\\p{{N}}]{{3,}}$)') THEN 0.0::DOUBLE
  ELSE (ratio >= 1.1)::INT * 1.5::DOUBLE + (ratio >= 1.3)::INT * 1.0 + bold::INT * 1.5 + numbered::INT * 2.0 + (length(t) <= 80)::INT * 1.0 + (abs((60 + x1) / 2 - 300) <= 90 AND length(t) <= 120)::INT * 0.5
    + (length(t) > 3 AND upper(t) = t AND lower(t) <> t)::INT * 0.5 - (share >= 0.3)::INT * 3.5 - in_table::INT * 5.0 - in_zone::INT * 2.5 - thick::INT * 1.5 END AS score FROM j)"""
_SECTIONS = f"""{_PARSED}, hs AS (SELECT doc_id, full_text AS x, length(full_text) AS n, list_sort(list_transform(range(1, len(coalesce(headings, [])) + 1), lambda i: {{'o': headings[i].char_offset, 'i': i, 'l': headings[i].level, 't': headings[i].text}})) AS h FROM parsed WHERE full_text IS NOT NULL),
hd AS (SELECT doc_id, k, h[k].l AS l, h[k].t AS t FROM hs, unnest(range(1, len(h) + 1)) r(k)),
paths AS (SELECT a.doc_id, a.k, string_agg(b.t, ' > ' ORDER BY b.k) AS path FROM hd a JOIN hd b ON a.doc_id = b.doc_id AND b.k <= a.k
  AND NOT EXISTS (SELECT 1 FROM hd c WHERE c.doc_id = a.doc_id AND c.k > b.k AND c.k <= a.k AND c.l <= b.l) GROUP BY a.doc_id, a.k),
sec AS (SELECT doc_id, k, x, CASE WHEN k = 0 THEN 0 ELSE least(h[k].o, n) END AS a, coalesce(least(h[k + 1].o, n), n) AS b FROM hs, unnest(range(0, len(h) + 1)) r(k)),
body AS (SELECT doc_id, k, a, b, regexp_replace(substring(x, a + 1, b - a), '^\\s+|\\s+$', '', 'g') AS y FROM sec WHERE b > a),
par AS (SELECT doc_id, k, a, b, CASE WHEN ceil(length(y) / 4.0) > 4000 THEN string_split(y, chr(10) || chr(10)) ELSE [y] END AS ps FROM body WHERE y <> ''),
it AS (SELECT doc_id, k, a, b, i, ps[i] AS p, ceil(length(ps[i]) / 4.0)::INT AS t FROM par, unnest(range(1, len(ps) + 1)) r(i)),
f AS (SELECT doc_id, k, i, 1::BIGINT AS s, t::BIGINT AS m FROM it WHERE i = 1
  UNION ALL SELECT f.doc_id, f.k, it.i, CASE WHEN f.m + it.t > 4000 THEN it.i ELSE f.s END, CASE WHEN f.m + it.t > 4000 THEN it.t ELSE f.m + it.t END FROM f JOIN it ON it.doc_id = f.doc_id AND it.k = f.k AND it.i = f.i + 1),
g AS (SELECT doc_id, k, a, b, s, string_agg(p, chr(10) || chr(10) ORDER BY i) AS z FROM f JOIN it USING (doc_id, k, i) GROUP BY doc_id, k, a, b, s)"""
_STARTS = f"""{_PARSED}, tb AS (SELECT doc_id, full_text AS x, i, tables[i].char_start AS given,
  coalesce(list_filter(regexp_split_to_array(tables[i].markdown, '[|\\s]+'), lambda w: length(w) > 1 AND NOT regexp_matches(w, '^[-:|]+$'))[1], '') AS w FROM parsed, unnest(range(1, len(tables) + 1)) r(i)),
f AS (SELECT doc_id, 0::BIGINT AS i, 0 AS place, 0 AS c FROM tb WHERE i = 1
  UNION ALL SELECT doc_id, i, place, place + length(w) FROM (SELECT tb.doc_id, tb.i, w, coalesce(given, CASE WHEN w = '' THEN c WHEN strpos(substring(x, c + 1), w) > 0 THEN c + strpos(substring(x, c + 1), w) - 1
    WHEN strpos(x, w) > 0 THEN strpos(x, w) - 1 ELSE c END)::INT AS place FROM f JOIN tb ON tb.doc_id = f.doc_id AND tb.i = f.i + 1))"""
_ANSWERS = r"""asked AS (SELECT * FROM (VALUES (1, E'```json\n["a one", "q", " ", "b two"]\n```', 'q'), (2, E'- first\n* second\n1. third\n2) fourth\n\n', 'q'), (3, '["x", "y"]', 'q'), (4, '', 'q')) v(id, response, query)),
bare AS (SELECT id, query, regexp_replace(regexp_replace(regexp_replace(response, '^\s+|\s+$', '', 'g'), '^```(?:json)?\s*|\s*```$', '', 'g'), '^\s+|\s+$', '', 'g') AS b FROM asked),
items AS (SELECT id, query, CASE WHEN starts_with(b, '[') THEN b::JSON::VARCHAR[] ELSE list_transform(string_split(b, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^(?:[-*]\s+|\d+[.)]\s*)', ''), '^\s+|\s+$', '', 'g')) END AS xs FROM bare),
vs AS (SELECT id, list_concat([query], list_filter(xs, lambda x: trim(x) <> '' AND x <> query))[1:4] AS v FROM items)"""

_TABLE_ROWS = f"""{_PARSED}, tc AS (SELECT doc_id, i, tables[i].markdown AS m, list_filter(string_split(tables[i].markdown, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM parsed, unnest(range(1, len(tables) + 1)) r(i)
  WHERE len(list_filter(regexp_split_to_array(tables[i].markdown, '[|\\s]+'), lambda x: NOT regexp_matches(x, '^[-: ]*$') AND NOT regexp_matches(x, '^Col\\d+$'))) >= 4),
hd AS (SELECT *, CASE WHEN len(l) > 1 AND contains(l[2], '---') THEN 2 ELSE 1 END AS k, ceil(length(m) / 4.0) <= 100 OR len(l) <= 3 AS whole FROM tc WHERE len(l) > 0),
rw AS (SELECT doc_id, i, m, whole, array_to_string(l[1:k], chr(10)) AS h, l[k + 1:] AS rs FROM hd),
it AS (SELECT doc_id, i, j, rs[j] AS p, ceil(length(rs[j]) / 4.0)::INT AS t, ceil(length(h) / 4.0)::INT AS c FROM rw, unnest(range(1, len(rs) + 1)) r(j) WHERE NOT whole),
f AS (SELECT doc_id, i, j, 1::BIGINT AS s, t::BIGINT AS n FROM it WHERE j = 1
  UNION ALL SELECT f.doc_id, f.i, it.j, CASE WHEN f.n + it.t + it.c > 100 THEN it.j ELSE f.s END, CASE WHEN f.n + it.t + it.c > 100 THEN it.t ELSE f.n + it.t END FROM f JOIN it ON it.doc_id = f.doc_id AND it.i = f.i AND it.j = f.j + 1),
g AS (SELECT doc_id, i, s, string_agg(p, chr(10) ORDER BY j) AS z FROM f JOIN it USING (doc_id, i, j) GROUP BY doc_id, i, s),
pc AS (SELECT doc_id, 0 AS chunk_no, m AS z FROM rw WHERE whole UNION ALL SELECT g.doc_id, (row_number() OVER (PARTITION BY g.doc_id, g.i ORDER BY s) - 1)::INT, h || chr(10) || z FROM g JOIN rw USING (doc_id, i))"""


ORACLE_SQL: dict[str, str] = {
    "table_chunks": f"WITH RECURSIVE {_TABLE_ROWS} SELECT doc_id, chunk_no::INT AS chunk_no, ceil(length(z) / 4.0)::INT AS token_count, sha256(z) AS chunk_hash FROM pc",
    "heading_scores": f"WITH {_LAYOUT} SELECT doc, page, line, score, score >= 4 AS accepted FROM sc WHERE score <> 0",
    "heading_segments": f"""WITH RECURSIVE {_SECTIONS} SELECT g.doc_id, coalesce(path, '') AS path, a::INT AS char_start, b::INT AS char_end, (row_number() OVER (PARTITION BY g.doc_id, k ORDER BY s) - 1)::INT AS part_no,
  sha256(z) AS segment_hash, ceil(length(z) / 4.0)::INT AS token_count FROM g LEFT JOIN paths USING (doc_id, k)""",
    "table_starts": f"WITH RECURSIVE {_STARTS} SELECT doc_id, (i - 1)::INT AS table_no, place AS char_start FROM f WHERE i > 0",
    "rewrite_parse": f"WITH {_ANSWERS} SELECT id, (i - 1)::INT AS pos, v[i] AS variant FROM vs, unnest(range(1, len(v) + 1)) r(i)",
    "tokenize_tf": f"WITH {_TF} SELECT doc_id, term, tf FROM tf",
    "bm25_term_stats": f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_BM25} SELECT doc_id, score, rank FROM lex WHERE q_ord = 0 AND rank <= 10",
    "bm25_multi_query": f"WITH {_BM25} SELECT q_ord, doc_id, score, rank FROM lex WHERE rank <= 20",
    "l2_normalize": """WITH v AS (SELECT chunk_id, dense_vector::DOUBLE[] AS v,
  sqrt(coalesce(list_sum(list_transform(dense_vector::DOUBLE[], lambda x: x * x)), 0)) AS n FROM embedded_chunks WHERE dense_vector IS NOT NULL)
SELECT chunk_id, round(n, 5) AS norm, CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END AS unit_norm FROM v""",
    "embedding_validation": "SELECT coalesce(len(dense_vector) = 64, false) AS valid, coalesce(cardinality(sparse_vector) = 0, true) AS no_sparse, count(*) AS n FROM embedded_chunks GROUP BY ALL",
    "dense_topk": f"WITH {_DENSE} SELECT vec_id, score, rank FROM den WHERE q_ord = 0 AND rank <= 10",
    "dense_multi_query": f"WITH {_DENSE.replace('vec_id < 4', 'vec_id % 50 = 0')} SELECT q_ord::INT AS q_ord, vec_id, score, rank FROM den WHERE rank <= 20",
    "rrf_fusion": f"WITH {_fused_sql(1, 15)} SELECT id, rrf_score, coalesce(dense_rank, 0) AS dense_rank, coalesce(bm25_rank, 0) AS bm25_rank, place FROM placed",
    "rrf_multi_query": f"WITH {_fused_sql(4, 50)} SELECT id, rrf_score, coalesce(dense_rank, 0) AS dense_rank, coalesce(bm25_rank, 0) AS bm25_rank, n_queries, sources, place FROM placed",
    "hydrate": f"WITH {_fused_sql(1, 15)} SELECT doc_id, title, source, sha256(text) AS text_hash, place FROM placed JOIN documents ON id = doc_id",
    "sentences": f"WITH {_PIECES} SELECT doc_id, (i - 1)::INT AS pos, sha256(p) AS piece_hash, length(p) AS n_chars FROM it",
    "pseudo_segments": """WITH RECURSIVE sp AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
it AS (SELECT doc_id, i, ps[i] AS p, ceil(length(ps[i]) / 4.0)::INT AS t FROM sp, unnest(range(1, len(ps) + 1)) r(i)),
f AS (SELECT doc_id, i, 1::BIGINT AS a, t::BIGINT AS n FROM it WHERE i = 1
  UNION ALL SELECT f.doc_id, it.i, CASE WHEN f.n + it.t > 60 THEN it.i ELSE f.a END, CASE WHEN f.n + it.t > 60 THEN it.t ELSE f.n + it.t END
  FROM f JOIN it ON it.doc_id = f.doc_id AND it.i = f.i + 1),
g AS (SELECT doc_id, a, string_agg(p, chr(10) || chr(10) ORDER BY i) AS s, sum(t)::INT AS n FROM f JOIN it USING (doc_id, i) GROUP BY doc_id, a)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS segment_no, sha256(s) AS segment_hash, n AS token_count FROM g""",
    "parent_windows": f"""WITH RECURSIVE {_PIECES},
f AS (SELECT doc_id, i, 1::BIGINT AS a, t::BIGINT AS n FROM it WHERE i = 1
  UNION ALL SELECT f.doc_id, it.i, CASE WHEN NOT it.whole AND f.n + it.t > 200 THEN it.i ELSE f.a END, CASE WHEN NOT it.whole AND f.n + it.t > 200 THEN it.t ELSE f.n + it.t END
  FROM f JOIN it ON it.doc_id = f.doc_id AND it.i = f.i + 1),
g AS (SELECT doc_id, a, min(s) AS s, max(s + length(p)) AS e, sum(t)::INT AS n FROM f JOIN it USING (doc_id, i) GROUP BY doc_id, a)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS window_no, s::INT AS char_start, e::INT AS char_end, n AS token_count FROM g""",
    "child_chunks": f"""WITH RECURSIVE {_PIECES},
c AS (SELECT doc_id, list(t ORDER BY i) AS ts, list(length(p) ORDER BY i) AS ns, list(p ORDER BY i) AS ps FROM it GROUP BY doc_id),
f AS (SELECT doc_id, 1 AS i, 1 AS a, ts[1]::BIGINT AS n, 0 AS ea, 0 AS eb FROM c
  UNION ALL SELECT doc_id, i + 1, CASE WHEN NOT fl THEN a ELSE b END, CASE WHEN NOT fl THEN n + t ELSE (coalesce(list_sum(ts[b:i]), 0) + t)::BIGINT END, CASE WHEN fl THEN a ELSE 0 END, CASE WHEN fl THEN i ELSE 0 END
  FROM (SELECT *, CASE WHEN coalesce(list_sum(ts[a0:i]), 0) + t <= 120 THEN a0 WHEN a0 + 1 <= i AND list_sum(ts[a0 + 1:i]) + t <= 120 THEN a0 + 1 ELSE i + 1 END AS b
    FROM (SELECT f.*, c.ts, c.ts[f.i + 1] AS t, f.n + c.ts[f.i + 1] > 120 AS fl, greatest(f.a, f.i - 1) AS a0 FROM f JOIN c USING (doc_id) WHERE f.i < len(c.ts)))),
e AS (SELECT doc_id, ea AS a, eb AS b, false AS last FROM f WHERE eb > 0 UNION ALL SELECT doc_id, a, i, true FROM f JOIN c USING (doc_id) WHERE i = len(ts))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b, a) - 1)::INT AS chunk_no, coalesce(list_sum(ns[1:a - 1]), 0)::INT AS char_start, list_sum(ns[1:b])::INT AS char_end,
  CASE WHEN last THEN ceil(length(regexp_replace(array_to_string(ps[a:b], ''), '^\\s+|\\s+$', '', 'g')) / 4.0)::INT ELSE list_sum(ts[a:b])::INT END AS token_count FROM e JOIN c USING (doc_id)""",
    "content_dedup": f"WITH {_PARSED} SELECT kb_id, doc_id FROM parsed QUALIFY content_hash IS NULL OR row_number() OVER (PARTITION BY kb_id, content_hash ORDER BY batch_no, arrival_no, doc_id) = 1",
    "incremental_docs": f"""WITH {_PARSED} SELECT kb_id, doc_id, lower(content_hash) AS content_hash FROM parsed p
WHERE NOT EXISTS (SELECT 1 FROM kb_manifest m WHERE m.kb_id = p.kb_id AND m.doc_id = p.doc_id) AND NOT EXISTS (SELECT 1 FROM kb_manifest m WHERE m.kb_id = p.kb_id AND lower(m.content_hash) = lower(p.content_hash))""",
    "embed_text": """WITH e AS (SELECT chunk_id, concat_ws(chr(10) || chr(10), nullif(metadata.title, ''), nullif(array_to_string(metadata.heading_path, ' > '), ''),
  nullif(regexp_replace(chunk_text, '^\\s+|\\s+$', '', 'g'), '')) AS t FROM chunks)
SELECT DISTINCT chunk_id, sha256(t) AS embed_hash, length(t) AS n_chars FROM e""",
    "embedding_cache_misses": """SELECT DISTINCT sha256(embed_text) AS embed_text_hash, length(embed_text) AS n_chars FROM chunks
WHERE regexp_matches(embed_text, '\\S') AND sha256(embed_text) NOT IN (SELECT lower(embed_text_hash) FROM embedded_chunks WHERE embed_text_hash IS NOT NULL)""",
    "text_tables": f"""WITH {_PARSED}, ln AS (SELECT doc_id, i - 1 AS n, ls[i] AS l FROM (SELECT doc_id, string_split(full_text, chr(10)) AS ls FROM parsed WHERE full_text IS NOT NULL), unnest(range(1, len(ls) + 1)) r(i)),
k AS (SELECT *, CASE WHEN length(l) - length(replace(l, '|', '')) >= 3 THEN '|' || (length(l) - length(replace(l, '|', '')) + 1)
  WHEN length(l) - length(replace(l, chr(9), '')) >= 3 THEN chr(9) || (length(l) - length(replace(l, chr(9), '')) + 1) ELSE '' END AS k FROM ln),
b AS (SELECT *, CASE WHEN lag(k) OVER w IS DISTINCT FROM k THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM b),
r AS (SELECT doc_id, run, k, min(n) AS first_line, count(*) AS n_rows,
  list('| ' || array_to_string(list_transform(string_split(l, k[1]), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' | ') || ' |' ORDER BY n) AS rows_ FROM g WHERE k <> '' GROUP BY doc_id, run, k HAVING count(*) >= 3)
SELECT doc_id, first_line::INT AS first_line, n_rows::INT AS n_rows, k[2:]::INT AS n_cols,
  array_to_string(list_concat(list_concat(rows_[1:1], ['| ' || array_to_string(list_transform(range(k[2:]::INT), lambda x: '---'), ' | ') || ' |']), rows_[2:]), chr(10)) AS markdown FROM r""",
    "code_chunks": f"""WITH {_PARSED}, f AS (SELECT doc_id, regexp_extract_all(full_text, '(?s)```(\\w*)[^\\S\\n]*\\n?(.*?)(?:```|\\z)', 1) AS ls,
  regexp_extract_all(full_text, '(?s)```(\\w*)[^\\S\\n]*\\n?(.*?)(?:```|\\z)', 2) AS bs FROM parsed WHERE contains(full_text, '```')),
b AS (SELECT doc_id, i, ls[i] AS lang, string_split(regexp_replace(bs[i], '(?m)^(def |class |function |const \\w+ = \\([^)]*\\) =>)', chr(1) || '\\1', 'g'), chr(1)) AS us0 FROM f, unnest(range(1, len(bs) + 1)) r(i)),
u AS (SELECT doc_id, i, lang, CASE WHEN us0[1] = '' AND len(us0) > 1 THEN us0[2:] ELSE us0 END AS us FROM b),
s AS (SELECT doc_id, (i - 1)::INT AS block_no, (j - 1)::INT AS unit_no, lang, regexp_replace(us[j], '^\\s+|\\s+$', '', 'g') AS x FROM u, unnest(range(1, len(us) + 1)) r(j))
SELECT doc_id, block_no, unit_no, '```' || lang || chr(10) || x || chr(10) || '```' AS chunk_text, ceil((length(x) + length(lang) + 8) / 4.0)::INT AS token_count FROM s WHERE x <> ''""",
    "heading_paths": f"""WITH {_PARSED}, h AS (SELECT doc_id, i, headings[i].level AS l, headings[i].text AS t FROM parsed, unnest(range(1, len(headings) + 1)) r(i))
SELECT a.doc_id, (a.i - 1)::INT AS pos, string_agg(b.t, ' > ' ORDER BY b.i) AS path FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.i <= a.i
  AND NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.i > b.i AND c.i <= a.i AND c.l <= b.l) GROUP BY a.doc_id, a.i""",
    "font_histogram": f"WITH {_SPANS} SELECT doc, size, sum(length(text))::BIGINT AS n_chars FROM spans GROUP BY doc, size",
    "heading_levels": f"""WITH {_SPANS}, d AS (SELECT DISTINCT doc, size FROM spans WHERE level IS NOT NULL),
g AS (SELECT *, CASE WHEN lag(size) OVER w - size >= 1.5 THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY doc ORDER BY size DESC))
SELECT doc, size, (1 + sum(new) OVER (PARTITION BY doc ORDER BY size DESC))::INT AS level FROM g""",
    "rerank_topk": f"WITH {_RANKED} SELECT query_id, chunk_id, rerank_rank FROM ranked WHERE rerank_rank <= 5",
    "parent_groups": f"""WITH {_RANKED}, top AS (SELECT * FROM ranked WHERE rerank_rank <= 10)
SELECT query_id, parent_window_id, string_agg(chunk_id, ',' ORDER BY rerank_rank) AS chunks, len(list_distinct(flatten(list(matched_queries))))::INT AS n_queries,
  array_to_string(list_sort(list_distinct(flatten(list(retrieval_sources)))), ',') AS sources, arg_min(doc_id, rerank_rank) AS doc_id FROM top GROUP BY query_id, parent_window_id""",
    "parent_contexts": f"WITH {_CONTEXTS} SELECT query_id, rank, parent_window_id, sha256(parent_text) AS text_hash, n_chunks FROM ctx",
    "context_budget": f"""WITH {_CONTEXTS}, used AS (SELECT query_id, rank AS number, parent_window_id,
  sum(length('[Document ' || rank || '] ' || doc_id || chr(10) || parent_text || chr(10))) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used FROM ctx)
SELECT query_id, number, parent_window_id, used FROM used WHERE used <= 8000""",
    "manifest_stats": "SELECT kb_id, count(DISTINCT doc_id) AS total_documents, count(DISTINCT lower(content_hash)) AS total_hashes FROM kb_manifest GROUP BY kb_id",
    "index_records": f"WITH {_INDEXED} SELECT row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS global_chunk_id, chunk_id, doc_id, chunk_type FROM rec",
    "alignment_check": f"""WITH {_INDEXED}, v AS (SELECT count(DISTINCT chunk_id) AS n FROM embedded_chunks WHERE len(dense_vector) = 64 AND chunk_id IN (SELECT chunk_id FROM chunks)),
m AS (SELECT sum(n_chunks)::BIGINT AS n FROM (SELECT doc_id, count(*) AS n_chunks FROM rec GROUP BY doc_id))
SELECT (SELECT n FROM v) AS n_vectors, count(*) AS n_records, count(DISTINCT chunk_id) AS n_ids, (SELECT n FROM m) AS n_manifest,
  count(*) = (SELECT n FROM v) AND count(*) = (SELECT n FROM m) AND count(*) = count(DISTINCT chunk_id) AS aligned FROM rec""",
    "orphan_embeddings": "SELECT DISTINCT chunk_id FROM embedded_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)",
    "text_features": """SELECT doc_id, ceil(length(text) / 4.0)::INT AS tokens, sha256(text) AS hash, length(text) < 100 AS low,
  sha256(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10)), '^\\s+|\\s+$', '', 'g')) AS clean_hash,
  sha256(substring(replace(text, chr(10), ' '), 1, 120)) AS preview_hash FROM documents WHERE text IS NOT NULL""",
    "sparse_cleanup": "SELECT DISTINCT chunk_id, coalesce(len(list_filter(map_values(sparse_vector), lambda w: w IS NOT NULL AND w <> 0)), 0)::INT AS n_terms FROM embedded_chunks",
    "next_kb_id": "SELECT 'kb_' || lpad((coalesce(max(try_cast(regexp_extract(kb_id, '^kb_(\\d+)$', 1) AS INT)), 0) + 1)::VARCHAR, 3, '0') AS next_kb FROM knowledge_bases",
    "kb_listing": "SELECT kb_id, count(DISTINCT doc_id) AS documents FROM parsed_documents GROUP BY kb_id",
    "query_log": "SELECT query_id, kb_id, max(query_text) AS query, strftime(min(retrieved_at)::TIMESTAMP, '%Y-%m-%d %H:%M') AS shown FROM retrieval_candidates GROUP BY query_id, kb_id",
}
