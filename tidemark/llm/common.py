"""Shared plumbing: table access, shared-folder tables and column guards."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only on one machine, as in tests, a session without it gets a temporary
    folder; on a cluster that is an error, for executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, repeats: bool = True) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage; the copy survives the loss of any executor. Without
    ``repeats``, for hashes and texts, no dictionaries of values are tried.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.enable.dictionary", str(repeats).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete tables made by ``settle`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_tidemark_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_driver(df: DataFrame) -> None:
    """Collect the driver's garbage, for jobs that follow each other by the dozen.

    Spark drops broadcasts and shuffle files of finished jobs only then, and the
    heap, which plans of many jobs fill up to its bound, gives memory back.
    """
    gc.collect(0)  # plans that Python no longer holds
    df.sparkSession._jvm.java.lang.System.gc()


def ascii_lower(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(id_col: str, n: int):
    """crc32 of the id's decimal text, modulo ``n`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
