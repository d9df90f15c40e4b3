"""What driver and executors share: a folder for tables, and objects sent to workers."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine (tests) is a local folder
    set, and the session keeps it, so that later calls use the same one; a cluster whose
    session names none is an error, as each machine would write to its own disk.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tilespark-')}")
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Whether Spark deletes an execution's shuffle files when it ends, not when the driver collects garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    Unlike a cached or locally checkpointed table, the files outlive the executors
    that wrote them, and later reads take only the columns that they need. With ``free``
    the shuffle files of the write go as soon as it is done, and the session's setting
    is as before afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilespark-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE)
    try:
        spark.conf.set(FREE, str(free or before == "true").lower())
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of settled tables that no later step reads any more."""
    for table in tables:
        path = getattr(table, "_settled_at", None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def send(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast an object of this package to workers that may not have the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> Any:
    return pickle.loads(sent.value)
