"""Session helpers: shared scratch space, lineage cuts, plans made once."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the one in ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) is a local temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ravelin-"))
    return named or context.getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: materialises once, in storage that outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def planned_once(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, with its settings, but whose plans are not made anew after every shuffle.

    For loops of many small steps: each plan made anew leaves its text and metrics with the driver and each
    shuffle a thread for a minute. What replanning would do for them, few partitions for few rows, the loop
    sets itself, in ``spark.sql.shuffle.partitions`` of this session. The caller's session stays as it is.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    return own


def release(spark: SparkSession, at_once: bool = False) -> None:
    """Let go of what finished steps left: shuffle files, broadcasts and checkpoints nobody holds are only dropped when the driver's garbage is collected, which a long loop cannot wait for.

    The JVM learns with a delay of up to a second what Python dropped, and its listeners hold the query that ended last
    until another has ended. ``at_once`` sees to both, so that the last step is let go of too.
    """
    if at_once:
        spark.range(1).collect()
    gc.collect()
    if at_once:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        untold, until = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ()), time.monotonic() + 5
        while untold and time.monotonic() < until:
            time.sleep(0.05)
        time.sleep(0.1)  # the one taken last is on its way
    spark.sparkContext._jvm.System.gc()
