"""Flat binary recordings as a data source and sink of Spark.

A file holds samples one after another, all channels of a sample side by side, behind `offset` bytes of header. The
source cuts files of any size into ranges of whole samples, a task each; of a range of times only its bytes are read.
It gives samples (file, channel, t, v) or, for filters and detection without a shuffle, blocks (channel, block, t0, v).

The sink writes chunks of a recording as files of their own. A chunk can be read once a manifest lists it, and a run
writes its manifest last, in one rename: a failed task or run leaves nothing readable, and the next run need only
write the chunks that no manifest lists.

Files are opened through Arrow's file systems (local paths, file:, hdfs:, s3:, gs:), on the driver for their sizes and
on executors for their bytes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.arrays import pieces, vectors

#: Bytes of a partition, and of what is read and handed on at once.
SPLIT, PIECE = 32 << 20, 1 << 20


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = uri[5:]
        uri = "/" + uri.lstrip("/")
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def files(path: str) -> list[tuple[str, int]]:
    """Name and bytes of a file, or of a folder's files (or those of a pattern in it) by name; hidden ones are left out."""
    from pyarrow import fs

    path, _, pattern = path.rpartition("/") if "*" in path else (path, "", "*")
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(at))
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._" and fnmatch(x.base_name, pattern))


def _manifests(path: str) -> list[dict]:
    """Committed chunks of a folder that the sink wrote, in order of time."""
    from pyarrow import fs

    system, at = _open(path)
    folder = f"{at.rstrip('/')}/_manifest"
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return []
    rows = []
    for x in system.get_file_info(fs.FileSelector(folder)):
        if x.base_name.endswith(".json"):
            with system.open_input_stream(x.path) as f:
                rows += json.loads(f.read())
    return sorted(rows, key=lambda r: r["t0"])


@dataclass
class Stretch(InputPartition):
    """Samples `first` .. `last` - 1 (from 0) of a file whose first sample is at time t0."""

    number: int
    uri: str
    t0: int
    first: int
    last: int

    def __init__(self, number: int, uri: str, t0: int, first: int, last: int):
        self.number, self.uri, self.t0, self.first, self.last = number, uri, t0, first, last


class FlatReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.channels, self.dtype = options["path"], int(options["channels"]), options.get("dtype", "<i2")
        self.offset, self.lsb, self.form = int(options.get("offset", 0)), float(options.get("lsb", 1.0)), options.get("form", "samples")
        self.size, self.split = int(options.get("size", 4096)), int(options.get("split", SPLIT))
        self.only = sorted({int(c) for c in options["only"].split(",")}) if "only" in options else list(range(self.channels))
        self.first, self.last = int(options.get("first", 1)), int(options["last"]) if "last" in options else None
        self.joined = options.get("concatenate", "false").lower() == "true"
        self.committed = options.get("committed", "false").lower() == "true"

    def _width(self) -> int:
        import numpy as np

        return np.dtype(self.dtype).itemsize * self.channels

    def partitions(self):
        """Whole samples of up to `split` bytes a task; blocks are never cut."""
        width, out, before = self._width(), [], 0
        step = max(1, self.split // width)
        if self.form == "blocks":
            step = -(-step // self.size) * self.size
        if self.committed:
            known = [(f"{self.path.rstrip('/')}/{r['file']}", r["t0"], r["n"]) for r in _manifests(self.path)]
        else:
            known = []
            for uri, size in files(self.path):
                n, rest = divmod(size - self.offset, width)
                if rest or n < 0:
                    raise ValueError(f"{uri}: {size} bytes are no whole number of samples of {self.channels} channels")
                known.append((uri, 1 + (before if self.joined else 0), n))
                before += n
        if self.form == "blocks" and any((t0 - 1) % self.size for _, t0, _ in known):
            raise ValueError("files of a recording in blocks have to begin at a block")
        for k, (uri, t0, n) in enumerate(known):
            low = max(0, self.first - t0)
            if self.form == "blocks":
                low -= low % self.size
            high = n if self.last is None else min(n, self.last - t0 + 1)
            out += [Stretch(k, uri, t0, x, min(x + step, high)) for x in range(low, high, step)] if self.only else []
        return out or [Stretch(0, "", 1, 0, 0)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        if partition.last <= partition.first:
            return
        width, system, at = self._width(), *_open(partition.uri)
        piece = self.size if self.form == "blocks" else max(1, PIECE // width)
        with system.open_input_file(at) as f:
            for low in range(partition.first, partition.last, piece):
                high = min(low + piece, partition.last)
                f.seek(self.offset + low * width)
                data = f.read((high - low) * width)
                if len(data) != (high - low) * width:
                    raise OSError(f"{partition.uri} ends before sample {high}")
                x = np.frombuffer(data, self.dtype).reshape(-1, self.channels)[:, self.only] * self.lsb
                if self.form == "blocks":
                    t0 = partition.t0 + low
                    n = len(self.only)
                    yield pa.RecordBatch.from_arrays([pa.array(self.only, pa.int32()), pa.array([(t0 - 1) // self.size] * n, pa.int64()), pa.array([t0] * n, pa.int64()), pa.array(list(x.T), pa.list_(pa.float64()))], names=["channel", "block", "t0", "v"])
                else:
                    t = np.repeat(np.arange(low, high) + partition.t0, len(self.only))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), partition.number), pa.int32()), pa.array(np.tile(self.only, high - low), pa.int32()), pa.array(t, pa.int64()), pa.array(x.ravel(), pa.float64())], names=["file", "channel", "t", "v"])


class PushedReader(FlatReader):
    """The reader of a session that pushes filters down to Python sources; where that is off, Spark takes none that could."""

    def _take(self, f) -> bool:
        """Narrows the scan by a condition; False if it has to be tested afterwards."""
        name = ".".join(getattr(f, "attribute", ()))
        if name == "channel" and isinstance(f, (EqualTo, In)):
            self.only = [c for c in self.only if c in (f.value if isinstance(f, In) else [f.value])]
            return True
        if name != "t" or self.form != "samples":
            return False
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.first = max(self.first, f.value + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            last = f.value - isinstance(f, LessThan)
            self.last = last if self.last is None else min(self.last, last)
        return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))

    def pushFilters(self, filters):  # noqa: N802
        """Bounds of t (in the form of samples) and choices of channel are taken out of the scan; the rest comes back."""
        return [f for f in filters if not self._take(f)]


@dataclass
class Written(WriterCommitMessage):
    chunks: list

    def __init__(self, chunks: list):
        self.chunks = chunks


class ChunkWriter(DataSourceArrowWriter):
    """Rows chunk, t0, n, data: data into a file a chunk; the run's manifest lists them when all tasks are done."""

    def __init__(self, options: dict):
        self.path, self.run = options["path"], uuid.uuid4().hex

    def write(self, iterator):
        system, at = _open(self.path)
        folder, done, own = f"{at.rstrip('/')}/data", [], uuid.uuid4().hex  # attempts of a task never meet
        system.create_dir(folder, recursive=True)
        for b in iterator:
            for chunk, t0, n, data in zip(*(b.column(c) for c in ("chunk", "t0", "n", "data")), strict=True):
                name = f"{chunk.as_py():012d}-{own}.bin"
                with system.open_output_stream(f"{folder}/{name}") as f:
                    f.write(data.as_buffer())
                done.append({"chunk": chunk.as_py(), "t0": t0.as_py(), "n": n.as_py(), "file": f"data/{name}"})
        return Written(done)

    def commit(self, messages):
        rows = [r for m in messages if m is not None for r in m.chunks]
        if not rows:
            return
        system, at = _open(self.path)
        folder = f"{at.rstrip('/')}/_manifest"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/.{self.run}") as f:
            f.write(json.dumps(rows).encode())
        system.move(f"{folder}/.{self.run}", f"{folder}/{self.run}.json")

    def abort(self, messages):
        system, at = _open(self.path)
        for m in messages:
            for r in m.chunks if m is not None else []:
                system.delete_file(f"{at.rstrip('/')}/{r['file']}")


class FlatSource(DataSource):
    """spark.read.format("flat_recording"): options path, channels, and dtype (<i2), offset, lsb, form (samples or
    blocks), size (of a block), split (bytes of a task), only (channels, comma between), first, last, concatenate
    (times run on from file to file), committed (chunks of the sink)."""

    @classmethod
    def name(cls):
        return "flat_recording"

    def schema(self):
        return "channel int, block long, t0 long, v array<double>" if self.options.get("form") == "blocks" else "file int, channel int, t long, v double"

    def reader(self, schema):
        return (PushedReader if self.options.get("pushdown") == "true" else FlatReader)(dict(self.options))

    def writer(self, schema, overwrite):
        return ChunkWriter(dict(self.options))


def read(spark: SparkSession, path: str, channels: int, **options) -> DataFrame:
    """A recording from flat binary files; options as in FlatSource. Where the session pushes filters down to Python
    sources (spark.sql.python.filterPushdown.enabled), conditions on t and channel reduce the scan like the options."""
    spark.dataSource.register(FlatSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    r = spark.read.format("flat_recording").option("path", path).option("channels", channels).option("pushdown", pushed)
    for k, v in options.items():
        r = r.option(k, ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else v)
    return r.load()


def chunks(blocks: DataFrame, channels: list[int], lsb: float = 1.0, dtype: str = "<i2") -> DataFrame:
    """chunk, t0, n, data: the channels of each block (channel, block, t0, v) side by side, values divided by lsb, rounded
    and, for whole numbers, clipped to the type. A block of a channel that is missing is 0."""
    names = list(channels)
    wide = blocks.filter(F.col("channel").isin(names)).groupBy("block", "t0").agg(F.collect_list(F.struct("channel", "v")).alias("rows"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = np.dtype(dtype)
        for b in pieces(batches, 64):
            data, sizes, parts = [], [], b.column(2).flatten()
            own, v = parts.field("channel").to_pylist(), vectors(parts.field("v"))
            ends = np.cumsum(b.column(2).value_lengths().to_numpy())
            for first, last in zip(np.append(0, ends[:-1]), ends, strict=True):
                n = max(len(x) for x in v[first:last])
                x = np.zeros((n, len(names)))
                for c, y in zip(own[first:last], v[first:last], strict=True):
                    x[: len(y), names.index(c)] = y
                x /= lsb
                if kind.kind in "iu":
                    x = np.clip(np.round(x), np.iinfo(kind).min, np.iinfo(kind).max)
                data.append(x.astype(kind).tobytes())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["chunk", "t0", "n", "data"])

    return wide.mapInArrow(run, "chunk long, t0 long, n long, data binary")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """chunk, t0, n, file of the chunks that can be read."""
    rows = [(r["chunk"], r["t0"], r["n"], r["file"]) for r in _manifests(path)]
    return spark.createDataFrame(rows, "chunk long, t0 long, n long, file string")


def save(blocks: DataFrame, path: str, channels: list[int], lsb: float = 1.0, dtype: str = "<i2") -> DataFrame:
    """Writes the blocks that are not in the recording at `path` yet, as one commit, and returns committed()."""
    spark = blocks.sparkSession
    spark.dataSource.register(FlatSource)
    new = blocks.join(committed(spark, path).select(F.col("chunk").alias("block")), "block", "left_anti")
    chunks(new, channels, lsb, dtype).write.format("flat_recording").option("path", path).mode("append").save()
    return committed(spark, path)


def complete(spark: SparkSession, path: str, length: int) -> bool:
    """Whether all samples of a recording of `length` samples are committed."""
    return sum(r["n"] for r in _manifests(path)) == length
