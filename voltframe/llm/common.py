"""Shared helpers: intermediate tables in the cluster's shared folder, text columns, per-worker caches."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs in one process, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        held = tempfile.TemporaryDirectory(prefix="voltframe-")
        atexit.register(held.cleanup)
        _own["dir"] = f"file://{held.name}"
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voltframe-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of new_path() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again. Lost executors cost no recomputation. Rows
    of many megabytes (large_rows) are each written and read alone: Parquet would gather a hundred before it looks at
    their size, and read them together. They have no statistics, which would hold whole values until a file is closed."""
    path = new_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    if large_rows:
        out = out.option("parquet.block.row.count.limit", 1).option("parquet.column.statistics.enabled", "false")
    out.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._voltframe_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what materialize() wrote."""
    delete(df.sparkSession, df._voltframe_path)


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column in `taken` has it (in any case)."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of the identifier's decimal text; null for null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def held_out(mod: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id) mod `mod` is 2; rows without an identifier belong to the training side."""
    return F.coalesce(crc_of_id(doc_id) % mod == 2, F.lit(False))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def bitmap(rows: DataFrame, value: Column, bits: int) -> bytes:
    """A filter of a fixed number of bits (a multiple of 32,768): bit k is set if a value has the remainder k."""
    size, place = 1 << 15, F.pmod(value, F.lit(bits))  # bits in a bitmap of Spark's
    parts = rows.groupBy(F.floor(place / size).alias("part")).agg(F.bitmap_construct_agg(place % size).alias("bits")).collect()
    out = bytearray(bits // 8)
    for part, own in parts:
        out[part * size // 8 : part * size // 8 + len(own)] = own
    return bytes(out)


def worker_cache(family: str, *key) -> dict:
    """A dictionary that lives as long as the Python worker, across tasks. Only one family's are held at a time: a worker
    that turns to another operator forgets the former one's, so that their sizes do not add up."""
    held = sys.__dict__.setdefault("_voltframe_caches", {})
    if family not in held:
        held.clear()
    return held.setdefault(family, {}).setdefault(key, {})


def filesystem(uri: str):
    """pyarrow file system and path of a URI such as file:///a/b or hdfs://host/a/b."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")
