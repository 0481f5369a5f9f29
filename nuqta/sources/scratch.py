"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the session's checkpoint folder; where neither is set, a
    folder of our own on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="nuqta-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # at exit the session may be gone
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted at exit."""
    path = f"{shared_folder(spark)}/nuqta-{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path
