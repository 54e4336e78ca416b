"""Tables as sources and sinks: Parquet by knowledge base, manifests, the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MANIFEST = "kb_id string, total_documents int, total_chunks int, embedding_model string, indexed_doc_ids array<string>, indexed_content_hashes map<string, struct<doc_id: string, original_filename: string>>"
LOG = "timestamp string, query string, kb_used string, response_length int, model_used string, answer string, final_contexts array<string>"


def write_partitioned(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, a folder per knowledge base; rows are spread evenly inside it, so a large one is many files."""
    df.repartition("kb_id", (F.rand(1) * 16).cast("int")).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)


def read_vectors(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a vector of ``dim`` components, and the rejects."""
    rows = spark.read.parquet(path)
    good = F.coalesce(F.size("dense_vector") == dim, F.lit(False))
    return rows.filter(good), rows.filter(~good)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as JSON, one per knowledge base; missing fields get their defaults, also in old files without hashes."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    return rows.select(
        "kb_id", F.coalesce("total_documents", F.lit(0)).alias("total_documents"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), "embedding_model",
        F.coalesce("indexed_doc_ids", F.array().cast("array<string>")).alias("indexed_doc_ids"),
        F.coalesce("indexed_content_hashes", F.create_map().cast("map<string, struct<doc_id: string, original_filename: string>>")).alias("indexed_content_hashes"),
    )


def manifest_hashes(manifest: DataFrame) -> DataFrame:
    return manifest.select("kb_id", F.explode("indexed_content_hashes").alias("content_hash", "v")).select("kb_id", "content_hash", "v.doc_id", "v.original_filename")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log entries, newest first, with the time as it is shown; lines that cannot be read are skipped."""
    rows = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path)
    stamp = F.split("timestamp", "T")
    return rows.withColumn("shown", F.concat(stamp[0], F.lit(" "), F.substring(stamp[1], 1, 5))).orderBy(F.desc("timestamp"))


def kb_ids(documents: DataFrame) -> DataFrame:
    return documents.select("kb_id").distinct()


def next_kb(column: Column) -> Column:
    """The id after the largest ``kb_<number>``; other names do not count."""
    number = F.regexp_extract(column, r"^kb_(\d+)$", 1).try_cast("int")
    return F.format_string("kb_%03d", F.coalesce(F.max(number), F.lit(0)) + 1)
