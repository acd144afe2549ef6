"""Sessions: defaults for a local one, and shipping this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH_BYTES = 8 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine with the settings the engine is tested with."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once for an application.

    Spark's file server carries the archive, so executors need neither this
    folder nor a PYTHONPATH. A session with Spark's own bound of 64 MB on an
    Arrow batch gets ``BATCH_BYTES``: workers and the buffers that feed them
    hold a few batches each.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-src-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``.

    Only on one machine may that be unset; a temporary folder stands in for it there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
