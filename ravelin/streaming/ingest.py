"""Files that keep arriving: a stream of batches into a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.functions.plugins import EngineConfig
from ravelin.operators.knowledge_base import KnowledgeBase
from ravelin.plans.pipeline import ingest
from ravelin.sources.files import expand, parse


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)


def ingest_stream(spark: SparkSession, files: DataFrame, path: str, kb_id: str, checkpoint: str, config: EngineConfig = EngineConfig()):
    """Start the stream. A batch is named by its number, so one that is run again replaces itself; contents already indexed are skipped."""
    def add(batch: DataFrame, number: int) -> None:
        known = KnowledgeBase(spark, path).read("manifest")
        known = None if known is None else known.filter(known.kb_id == kb_id).filter(known.batch != f"b{number}")
        docs = parse(expand(batch), known=known).dropDuplicates(["content_hash"]).persist()
        try:
            if docs.limit(1).count():
                docs.write.mode("overwrite").parquet(f"{path}/parsed/batch=b{number}")
                ingest(spark, path, f"b{number}", kb_id, spark.read.parquet(f"{path}/parsed/batch=b{number}"), config)
        finally:
            docs.unpersist()

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
