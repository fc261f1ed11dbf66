"""Tables that a plan reads more than once, kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir); on one machine in a temporary one where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="reportlake-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _kept.append((spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once and read again; deleted when the program ends."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for path, conf in _kept:
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session is gone, and its file system with it
            return
