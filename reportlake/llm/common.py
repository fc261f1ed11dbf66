"""What the corpus operators share: tables, shared storage and bounded samples."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MB = 16  # of a table that is sent to every executor, at most

_left: dict = {}  # what save() wrote and drop() did not delete yet: path -> Hadoop's path and configuration


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); on one machine a temporary one where that is unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(shared_dir, "own", None)
        if folder is None:
            folder = shared_dir.own = tempfile.mkdtemp(prefix="reportlake-")
    return folder.rstrip("/")


def save(spark: SparkSession, df: DataFrame, label: str, **options) -> DataFrame:
    """Write df to the shared folder, with options of its files, and read it back: cuts lineage, survives lost executors.

    The table is deleted by drop(), or when the program ends.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _left[path] = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(spark: SparkSession, *saved: DataFrame) -> None:
    """Delete tables of save() that no later step reads."""
    for df in saved:
        _delete(df.saved_at)


def drop_since(spark: SparkSession, before: set[str], *kept: DataFrame) -> None:
    """Delete every table that save() wrote since `before` (a copy of saved()), but for those kept."""
    for path in saved() - before - {df.saved_at for df in kept}:
        _delete(path)


def saved() -> set[str]:
    return set(_left)


def _delete(path: str) -> None:
    at, conf = _left.pop(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _sweep() -> None:
    for path in saved():
        try:
            _delete(path)
        except Exception:  # the session is gone, and its file system with it
            return


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does once the driver has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = 16 + F.octet_length(c)
    elif isinstance(kind, T.ArrayType):
        inner = kind.elementType
        flat = not isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))
        size = 24 + (8 * F.size(c) if flat else F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, inner)))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def size_mb(df: DataFrame) -> float:
    total = df.agg(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32)))).first()[0]
    return (total or 0) / (1 << 20)


def broadcast_if_small(df: DataFrame, mb: float = BROADCAST_MB) -> DataFrame:
    """Mark a table for broadcast only if its rows are measured to take at most so much; else joins shuffle."""
    return F.broadcast(df) if size_mb(df) <= mb else df


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most so many rows, chosen by a hash of the key: the same rows in any run and layout."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


def labelled_texts(some: DataFrame, docs: DataFrame, rows: int, mb: float) -> pd.DataFrame:
    """For training: id k, label y and text t of at most so many ids of some(k, y), and of texts of so many MB together.

    Ids are taken in the order of a hash; of rows that share an id, the least text.
    """
    ids = F.broadcast(bounded_sample(some.groupBy("k").agg(F.max("y").alias("y")), "k", rows))
    texts = docs.select(docs["doc_id"].alias("k"), docs["text"].alias("t")).where("t is not null").join(ids, "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    held = F.sum(F.octet_length("t").cast("long")).over(Window.orderBy(F.xxhash64("k"), "k"))  # over `rows` rows at most
    got = texts.withColumn("n", held).where(F.col("n") <= int(mb * (1 << 20))).drop("n")
    return got.toPandas().sort_values("k", ignore_index=True)


class WordRows:
    """Numbers kept for each word that a task has met, at most about `most` words; beyond, it starts anew."""

    def __init__(self, width: int, most: int = 400_000):
        self.place: dict = {}
        self.table = np.zeros((1024, width))
        self.most = most

    def new(self, runs: list[list]) -> list:
        """Words of the runs without a row."""
        if len(self.place) > self.most:
            self.place.clear()
        place = self.place
        return list({w for r in runs for w in r if w not in place})

    def add(self, words: list, rows: np.ndarray) -> None:
        n = len(self.place)
        if n + len(words) > len(self.table):
            self.table = np.concatenate([self.table[:n], np.zeros((n + 2 * len(words), self.table.shape[1]))])
        self.table[n : n + len(words)] = rows
        self.place.update(zip(words, range(n, n + len(words))))

    def sum(self, run: list) -> np.ndarray:
        return self.table[np.fromiter(map(self.place.__getitem__, run), np.int64, len(run))].sum(axis=0)
