"""The shared folder, staged tables, bounded batches."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For a local master whose session names no shared folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/blockloom"
#: Bytes of an Arrow batch, about; one row at least.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what setCheckpointDir was given.

    Without either a local master uses a folder of its own; a cluster is refused, since what
    one executor writes to its own disk the others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        given = spark._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_SHARED
    return found.rstrip("/")


_staged: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    if not _staged:
        atexit.register(drop_staged)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def drop_staged() -> None:
    while _staged:
        spark, path = _staged.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone; the folder is temporary
            return


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cuts lineage with a table in the shared folder: lost executors don't lose it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by bytes: rows are whole texts, and a worker holds a batch at a time.

    Plans are made when they run, so the setting has to outlive this call. It only bounds
    memory and is lowered only.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", conf.get(name)) or 0) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df
