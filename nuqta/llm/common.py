"""Shared plumbing: the shared folder, written tables and Arrow batch mapping."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB where the session has Spark's own bound of 64 MB: a task holds
    several at once, in the JVM and in its worker. A bound set by the user stays."""
    if spark.conf.get(BATCH_BYTES).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_BYTES, str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, or the session's
    checkpoint folder. Where neither is set, a folder of our own on a single machine, and an
    error on a cluster."""
    small_batches(spark)
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="nuqta-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_scratch: dict[str, object] = {}


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; its folder goes with the application
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder per application that goes at exit."""
    root = f"{shared_dir(spark)}/nuqta-{spark.sparkContext.applicationId}"
    if root not in _scratch:
        _scratch[root] = atexit.register(_drop, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back. Unlike a
    checkpoint it is columnar, compressed, and read with column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nuqta_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the table that ``written`` gave. Nothing may read it later."""
    _drop(df.sparkSession, df._nuqta_path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file through Hadoop's file system API, so that any shared folder will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        step = 4 << 20
        for i in range(0, len(data), step):
            out.write(bytearray(data[i : i + step]))
    finally:
        out.close()


def ship(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file to the shared folder and have Spark hand it to every executor, which
    keeps one copy that all its Python workers memory-map. Returns the name for
    ``SparkFiles.get``."""
    path = scratch_path(spark, name)
    write_bytes(spark, path, data)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def keep_rows(df: DataFrame, judge: Callable[[pa.RecordBatch], tuple[object, dict[str, pa.Array]]]) -> DataFrame:
    """Filter ``df`` in one streaming pass without a shuffle. ``judge`` gets a batch and
    gives the mask of rows to keep and the columns to put in place of existing ones."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, instead = judge(batch)
            columns = [instead.get(name, column) for name, column in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(mask))

    return df.mapInArrow(run, df.schema)


#: Rows of 64-bit ids that a join may broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def join_ids(df: DataFrame, ids: DataFrame, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``left_semi`` or ``left_anti`` join on doc_id. ``ids`` (cheap to read twice) is
    counted first and broadcast up to ``limit`` rows; beyond that both sides shuffle."""
    own = free_name(df, "id")
    one = ids.select(F.col("doc_id").alias(own))
    few = one.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(one) if few else one, df["doc_id"] == F.col(own), how)


def join_texts(df: DataFrame, texts: DataFrame, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """As ``join_ids``, on doc_id and the hash ``h`` of the text."""
    a, b = free_name(df, "id"), free_name(df, "hash")
    one = texts.select(F.col("doc_id").alias(a), F.col("h").alias(b))
    few = one.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(one) if few else one, (df["doc_id"] == F.col(a)) & (F.xxhash64(df["text"].cast("string")) == F.col(b)), how)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
