"""A knowledge base as tables: deduplication, embedding cache, index records, manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ravelin.functions.text import bm25_tokens, strip, text_hash
from ravelin.operators.lexical import index_postings
from ravelin.operators.ranking import spread_row_number
from ravelin.session import cut


def first_by_hash(docs: DataFrame, hash_: str, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """One row per content hash and scope, the first in ``order``; rows without a hash all stay.

    The first row is found by an aggregation with map-side combine, so many copies of one
    content never meet in a task.
    """
    keys = [*(scope or []), hash_]
    first = docs.filter(F.col(hash_).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("r")).select("r.*")
    return first.unionByName(docs.filter(F.col(hash_).isNull()))


def unseen(docs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Documents that are not known by ``keys`` (an anti join); null keys are never known."""
    return docs.join(known.select(*keys).distinct(), keys, "left_anti")


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts to encode: ``(embed_text_hash, embed_text)`` of chunks the cache lacks; blank texts are skipped."""
    wanted = chunks.filter(strip(F.col("embed_text")) != "").select(text_hash(F.col("embed_text")).alias("embed_text_hash"), "embed_text").dropDuplicates(["embed_text_hash"])
    return wanted.join(cache.select("embed_text_hash").distinct(), "embed_text_hash", "left_anti")


def embed_chunks(chunks: DataFrame, cache: DataFrame, encode: Callable[[Column], Column], dim: int) -> tuple[DataFrame, DataFrame]:
    """``(embedded, fresh)``: every chunk with its own id and the vector of its text, and what the cache lacked; only that is encoded.

    ``cache``: ``embed_text_hash, dense_vector``. Vectors of another size are rejected, chunks
    without a vector left out.
    """
    fresh = cut(cache_misses(chunks, cache).select("embed_text_hash", encode(F.col("embed_text")).alias("dense_vector")).filter(F.size("dense_vector") == dim))
    merged = cache.select("embed_text_hash", "dense_vector").unionByName(fresh).dropDuplicates(["embed_text_hash"])
    hashed = chunks.withColumn("embed_text_hash", text_hash(F.col("embed_text")))
    return hashed.join(merged, "embed_text_hash"), fresh


def retrieval_records(embedded: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Embeddings joined to their chunks, and the rejects that have none."""
    meta = chunks.select(
        "chunk_id", F.col("metadata.doc_id").alias("doc_id"), "parent_window_id", "segment_id", F.col("metadata.title").alias("title"), F.col("metadata.heading_path").alias("heading_path"),
        F.col("metadata.original_filename").alias("original_filename"), F.col("metadata.chunk_type").alias("chunk_type"), "chunk_text",
    ).dropDuplicates(["chunk_id"])
    kept = embedded.join(meta, "chunk_id")
    return kept, embedded.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def assign_ids(records: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """``global_chunk_id`` from the largest existing one on, in ``order``, without a single sorting task."""
    top = existing.agg(F.coalesce(F.max("global_chunk_id"), F.lit(-1)).alias("top"))
    numbered = spread_row_number(records.withColumn("_all", F.lit(0)), ["_all"], order, "n").drop("_all")
    return numbered.join(F.broadcast(top)).withColumn("global_chunk_id", F.col("top") + F.col("n")).drop("top", "n")


def alignment(vectors: DataFrame, records: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: how many vectors, records and chunks of the manifest (``n_chunks`` of its documents) there are, and whether all are the same with unique ids.

    Whether a text has terms does not matter: one without any is a record with a length of 0.
    """
    v = vectors.agg(F.count(F.lit(1)).alias("n_vectors"))
    r = records.agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("global_chunk_id").alias("n_ids"))
    m = manifest.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_manifest"))
    same = (F.col("n_vectors") == F.col("n_records")) & (F.col("n_manifest") == F.col("n_records")) & (F.col("n_ids") == F.col("n_records"))
    return v.join(r).join(m).withColumn("aligned", same)  # one row each


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """Per knowledge base: documents, distinct hashes, last time of indexing."""
    return manifest.groupBy("kb_id").agg(F.countDistinct("doc_id").alias("total_documents"), F.countDistinct(F.lower("content_hash")).alias("total_hashes"), F.max("indexed_at").alias("last_indexed"))


class KnowledgeBase:
    """Tables of one or many knowledge bases under ``path``, partitioned by ``batch`` and ``kb_id``.

    Appending writes a batch to a staging folder, checks there that vectors, records and manifest
    match, and then moves it into place; a batch written twice replaces itself.
    """

    TABLES = ("records", "vectors", "postings", "doc_len", "manifest")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, table: str, kb_id: str | None = None, without: str | None = None) -> DataFrame | None:
        """A table, of one knowledge base if named, without a batch if named; None if nothing was written yet."""
        folder, system = self._folder(f"{self.path}/{table}")
        if not system.exists(folder):
            return None
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        rows = rows if kb_id is None else rows.filter(F.col("kb_id") == kb_id)
        return rows if without is None else rows.filter(F.col("batch") != without)

    def fresh(self, documents: DataFrame, batch: str) -> DataFrame:
        """One row per document that is new by id and hash to its knowledge base; of equal contents the first by id."""
        known = self.read("manifest", without=batch)
        new = documents if known is None else unseen(unseen(documents, known, ["kb_id", "doc_id"]), known.filter("content_hash is not null"), ["kb_id", "content_hash"])
        return cut(first_by_hash(new, "content_hash", ["doc_id"], ["kb_id"]).dropDuplicates(["kb_id", "doc_id"]))

    def put(self, batch: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None] = lambda staged: None) -> None:
        """Write the tables of a batch beside, let them be checked as they were written, and move them into place."""
        staging, staged = f"{self.path}/_staging/{batch}", {}
        for name, table in tables.items():
            keyed = [k for k in ("kb_id",) if k in table.columns]
            table.write.mode("overwrite").partitionBy(*keyed).parquet(f"{staging}/{name}")
            staged[name] = self.spark.read.schema(table.schema).parquet(f"{staging}/{name}")
        try:
            check(staged)
            for name in tables:
                source, system = self._folder(f"{staging}/{name}")
                target, _ = self._folder(f"{self.path}/{name}/batch={batch}")
                system.delete(target, True)
                if not staged[name].isEmpty():
                    system.mkdirs(target.getParent())
                    if not system.rename(source, target):
                        raise OSError(f"{source} could not be moved to {target}")
        finally:
            folder, system = self._folder(staging)
            system.delete(folder, True)

    def append(self, batch: str, embedded: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
        """Index the documents that are new by id and hash; one row of counts.

        ``embedded``: ``chunk_id, dense_vector, embed_text_hash``; ``documents``: ``kb_id, doc_id,
        content_hash, original_filename``.
        """
        fresh, records = self.fresh(documents, batch), self.read("records", without=batch)
        kept, _ = retrieval_records(embedded, chunks)
        mine = kept.join(fresh.select("kb_id", "doc_id"), "doc_id")
        empty = self.spark.createDataFrame([], "global_chunk_id long")
        numbered = cut(assign_ids(mine, empty if records is None else records, ["kb_id", "doc_id", "chunk_id"]))
        counted = numbered.groupBy("kb_id", "doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
        tables = {
            "records": numbered.drop("dense_vector"), "vectors": numbered.select("kb_id", "global_chunk_id", "dense_vector"),
            "postings": index_postings(numbered, ["kb_id", "global_chunk_id"], "chunk_text").sortWithinPartitions("term"),
            "doc_len": numbered.select("kb_id", "global_chunk_id", F.size(bm25_tokens(F.col("chunk_text"))).cast("long").alias("dl")),
            "manifest": fresh.join(counted, ["kb_id", "doc_id"], "left").fillna(0, ["n_chunks"]).withColumn("indexed_at", F.current_timestamp()),
        }
        done = {}

        def check(staged: dict[str, DataFrame]) -> None:
            done["row"] = alignment(staged["vectors"], staged["records"], staged["manifest"]).withColumn("n_documents", F.lit(fresh.count())).first()
            if not done["row"].aligned:
                raise ValueError("vectors, records and manifest do not match; nothing was added")

        self.put(batch, tables, check)
        return self.spark.createDataFrame([done["row"]], "n_vectors long, n_records long, n_ids long, n_manifest long, aligned boolean, n_documents int")
