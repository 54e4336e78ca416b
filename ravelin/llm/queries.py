"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravelin.llm.forest import all_neighbours, mutual_neighbours
from ravelin.llm.history import refuse_repetitions
from ravelin.llm.leximin import leximin_rank
from ravelin.llm.mixing import mix
from ravelin.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
from ravelin.llm.packing import conflict_report, fill_report, oversized, pack
from ravelin.llm.scanned import scan_defects, scan_paragraphs
from ravelin.llm.sentences import split_sentences
from ravelin.llm.splitting import sized_items, split_oversized

#: Which way each score of a candidate counts.
SCORES = {"rrf_score": "large", "rerank_score": "large", "dense_rank": "small", "bm25_rank": "small"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of each query."""
    return leximin_rank(_table(spark, sf_dir, "retrieval_candidates"), "query_id", "chunk_id", SCORES, k=3).select("query_id", "chunk_id")


def p1_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of each query in its place."""
    ranked = leximin_rank(_table(spark, sf_dir, "retrieval_candidates"), "query_id", "chunk_id", SCORES)
    return ranked.select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture, broken words and misread words of scanned documents."""
    return scan_defects(_table(spark, sf_dir, "parsed_documents"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned documents as continuous paragraphs."""
    return scan_paragraphs(_table(spark, sf_dir, "parsed_documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed documents that repeat something their knowledge base accepted earlier."""
    chunks = _table(spark, sf_dir, "chunks").select(F.col("metadata.doc_id").alias("doc_id"), "embed_text")
    return refuse_repetitions(_table(spark, sf_dir, "parsed_documents"), chunks)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts that are among each other's five most similar."""
    return mutual_neighbours(_table(spark, sf_dir, "embedded_chunks"), _table(spark, sf_dir, "chunks"))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other texts of every text."""
    return all_neighbours(_table(spark, sf_dir, "embedded_chunks"), _table(spark, sf_dir, "chunks"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "parsed_documents").select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("id"), F.col("full_text").alias("text"))
    return docs.unionByName(_table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("id"), F.col("chunk_text").alias("text")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and of chunks with half of their three-word sequences in common."""
    return near_duplicate_pairs(_records(spark, sf_dir), words=3, threshold=0.5)


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and chunk with its class of near copies (five words, 0.8) and its number of links."""
    return near_duplicate_classes(_records(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be cut."""
    pieces = split_oversized(sized_items(spark, sf_dir))
    return pieces.filter("piece_no = 1").select("item_kind", "item_id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized item."""
    return split_oversized(sized_items(spark, sf_dir)).drop("piece_text")


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "size_limits").filter("item_kind = 'container'").first().max_tokens


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its container."""
    return pack(_table(spark, sf_dir, "documents"), _capacity(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than a container."""
    return oversized(p7_containers(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p7_containers(spark, sf_dir), _capacity(spark, sf_dir))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing that keeps the first two sources of the mix apart must not have, counted."""
    docs = _table(spark, sf_dir, "documents")
    first, second = (r.source for r in _table(spark, sf_dir, "mix_targets").select(F.lower(F.trim("source")).alias("source")).orderBy("source").limit(2).collect())
    packed = pack(docs, _capacity(spark, sf_dir), apart=[(first, second)])
    return conflict_report(packed, docs, _capacity(spark, sf_dir), apart=[(first, second)])


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mix."""
    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reached share of every source."""
    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source has its tokens (within 1 % or half its largest document, as few documents allow no less) and its documents (within 2 % or 8), unless all it has was used."""
    spent = ~F.col("reachable")
    tokens = F.abs(F.col("reached_tokens") - F.col("quota")) <= F.greatest(0.01 * F.col("quota"), F.col("largest") / 2)
    documents = F.abs(F.col("reached_documents") - F.col("quota_documents")) <= F.greatest(F.lit(8.0), 0.02 * F.col("quota_documents"))
    return p8_shares(spark, sf_dir).select("source", (spent | tokens).alias("tokens_met"), (spent | documents).alias("documents_met"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return p8_shares(spark, sf_dir).filter("not reachable").select("source")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document."""
    return split_sentences(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_order, p2_found, p2_paragraphs, p3_found, p4_found, p4_neighbours, p5_found, p5_classes, p6_found, p6_pieces, p7_found, p7_containers, p7_fill, p7_checks, p8_checks, p8_found, p8_copies, p8_shares, p9_found)
}

_MARKS = """
rows_ AS (SELECT query_id, chunk_id, max(rrf_score) a, max(rerank_score) b, max(-dense_rank) c, max(-bm25_rank) d
  FROM retrieval_candidates GROUP BY query_id, chunk_id),
long_ AS (SELECT query_id, chunk_id, 1 k, a::DOUBLE v FROM rows_ UNION ALL SELECT query_id, chunk_id, 2, b FROM rows_
  UNION ALL SELECT query_id, chunk_id, 3, c FROM rows_ UNION ALL SELECT query_id, chunk_id, 4, d FROM rows_),
mark AS (SELECT query_id, chunk_id, CASE WHEN count(v) OVER w = 0 THEN 1.0 WHEN v IS NULL THEN 0.0 WHEN count(*) OVER w = 1 THEN 1.0
  ELSE (rank() OVER o - 1 + round(cume_dist() OVER o * count(*) OVER w) - 1) / 2.0 / (count(*) OVER w - 1) END m
  FROM long_ WINDOW w AS (PARTITION BY query_id, k), o AS (PARTITION BY query_id, k ORDER BY v NULLS FIRST)),
vec AS (SELECT query_id, chunk_id, list_sort(list(m)) v FROM mark GROUP BY query_id, chunk_id),
placed AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, chunk_id) AS place FROM vec)
"""
_OVERSIZED = """
docs AS (SELECT DISTINCT doc_id, full_text FROM parsed_documents),
items AS (SELECT 'document' item_kind, doc_id item_id, length(full_text) n FROM docs
  UNION ALL SELECT 'parent_window', parent_window_id, length(substring(full_text, char_start + 1, char_end - char_start))
  FROM parent_windows JOIN docs USING (doc_id)
  UNION ALL SELECT 'chunk', chunk_id, length(chunk_text) FROM chunks)
"""
_HASH = r"regexp_replace(regexp_replace(lower(trim(content_hash)), '^(sha-?256\s*[:=\-]?\s*|0x)', ''), '[\s:\-]', '', 'g')"
#: The rule taken record by record: a recursion that carries the accepted records of each knowledge base.
_REFUSED = f"""
rows_ AS (SELECT doc_id, coalesce(batch_no, 0) AS b, arrival_no AS a, kb_id, {_HASH} AS h FROM parsed_documents WHERE doc_id IS NOT NULL),
recs AS (SELECT doc_id, min(row(b, a, kb_id)) AS place, max(CASE WHEN regexp_matches(h, '^[0-9a-f]{{62,66}}$') AND h <> repeat(h[1], length(h)) THEN h END) AS h FROM rows_ GROUP BY doc_id),
placed AS (SELECT doc_id, h, place[3] AS kb, row_number() OVER (PARTITION BY place[3] ORDER BY place[1], place[2], doc_id) AS n FROM recs),
own AS (SELECT DISTINCT metadata.doc_id AS doc_id, sha256(embed_text) AS t FROM chunks WHERE embed_text IS NOT NULL),
held AS (SELECT kb, n, t, count(*) OVER (PARTITION BY kb, n) AS k FROM own JOIN placed USING (doc_id)),
near AS (SELECT x.kb, x.n, y.n AS m FROM held x JOIN held y ON x.kb = y.kb AND x.t = y.t AND y.n < x.n GROUP BY x.kb, x.n, y.n, x.k, y.k HAVING 2 * count(*) >= least(x.k, y.k)
  UNION SELECT x.kb, x.n, y.n FROM placed x JOIN placed y ON x.kb = y.kb AND x.h = y.h AND y.n < x.n),
rivals AS (SELECT p.kb, p.n, list(m) FILTER (WHERE m IS NOT NULL) AS ms FROM placed p LEFT JOIN near USING (kb, n) GROUP BY p.kb, p.n),
steps AS (SELECT kb, 1::BIGINT AS n, [1::BIGINT] AS kept FROM rivals WHERE n = 1
  UNION ALL SELECT s.kb, s.n + 1, CASE WHEN list_has_any(s.kept, coalesce(r.ms, [])) THEN s.kept ELSE list_append(s.kept, s.n + 1) END FROM steps s JOIN rivals r ON r.kb = s.kb AND r.n = s.n + 1),
last_ AS (SELECT kb, arg_max(kept, n) AS kept FROM steps GROUP BY kb)
"""
_COSINES = """
ok AS (SELECT coalesce(lower(embed_text_hash), h) AS hash, dense_vector AS v, generated_at FROM embedded_chunks LEFT JOIN (SELECT DISTINCT chunk_id, sha256(embed_text) AS h FROM chunks) USING (chunk_id)
  WHERE len(dense_vector) = 64 AND len(list_filter(dense_vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(dense_vector, lambda x: x <> 0)) > 0),
u AS (SELECT hash, arg_max(v, generated_at)::DOUBLE[64] AS v FROM ok WHERE hash IS NOT NULL GROUP BY hash),
near AS (SELECT a.hash AS x, b.hash AS y, array_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.hash <> b.hash QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 5)
"""
_SHINGLES = r"""
recs AS (SELECT 'document' AS record_kind, doc_id AS id, full_text AS t FROM parsed_documents UNION ALL SELECT 'chunk', chunk_id, chunk_text FROM chunks),
words AS (SELECT DISTINCT record_kind, id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM recs WHERE id IS NOT NULL AND t IS NOT NULL),
sh AS (SELECT DISTINCT record_kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, unnest(range(1, len(w) - 1)) r(i)),
n AS (SELECT record_kind, id, count(*) AS n FROM sh GROUP BY ALL),
c AS (SELECT a.record_kind, a.id AS id_a, b.id AS id_b, count(*) AS c FROM sh a JOIN sh b ON a.record_kind = b.record_kind AND a.g = b.g AND a.id < b.id GROUP BY ALL)
"""
#: Sizes as bytes over four: what p7_found and p8_found tell lies clearly on one side for every tokenizer.
_SIZES = """
doc AS (SELECT doc_id, max(strlen(coalesce(text, ''))) / 4.0 AS t, max(lower(trim(source))) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
have AS (SELECT source, sum(t) AS t FROM doc WHERE source IS NOT NULL GROUP BY source)
"""
ORACLE_SQL: dict[str, str] = {
    "p3_found": f"WITH RECURSIVE {_REFUSED} SELECT doc_id FROM placed JOIN last_ USING (kb) WHERE NOT list_contains(kept, n)",
    "p4_found": f"WITH {_COSINES} SELECT a.x AS hash_a, a.y AS hash_b FROM near a JOIN near b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y AND a.s >= 0.92",
    "p5_found": f"WITH {_SHINGLES} SELECT c.record_kind, id_a, id_b FROM c JOIN n x ON x.record_kind = c.record_kind AND x.id = id_a JOIN n y ON y.record_kind = c.record_kind AND y.id = id_b WHERE 2 * c >= x.n + y.n - c",
    "p7_found": f"WITH {_SIZES} SELECT doc_id FROM doc WHERE t > (SELECT max_tokens FROM size_limits WHERE item_kind = 'container')",
    "p8_found": f"WITH {_SIZES} SELECT m.source FROM mix_targets m LEFT JOIN have h ON h.source = lower(trim(m.source)) WHERE coalesce(h.t, 0) * max_repeats < target_share * (SELECT sum(t) FROM have)",
    "p1_found": f"WITH {_MARKS} SELECT query_id, chunk_id FROM placed WHERE place <= 3",
    "p1_order": f"WITH {_MARKS} SELECT query_id, chunk_id, place FROM placed",
    "p7_checks": "SELECT 0::BIGINT AS over_capacity, 0::BIGINT AS copies_together, 0::BIGINT AS sources_together, 0::BIGINT AS lost_tokens",
    "p8_checks": "SELECT source, true AS tokens_met, true AS documents_met FROM mix_targets",
    "p6_found": f"WITH {_OVERSIZED} SELECT DISTINCT item_kind, item_id FROM items JOIN size_limits USING (item_kind) WHERE ceil(n / 4.0) > max_tokens",
}
