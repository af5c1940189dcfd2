"""Tables between the rounds of an iterative operator, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        held = tempfile.TemporaryDirectory(prefix="voltframe-")
        atexit.register(held.cleanup)
        _own["dir"] = f"file://{held.name}"
    return _own["dir"]


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df and reads it again."""
    path = f"{folder(df.sparkSession)}/voltframe-round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._voltframe_path = path
    return out


def remove(df: DataFrame) -> None:
    """Deletes what settle() wrote."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._voltframe_path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
