"""Recordings: raw samples to microvolts, packed binary samples and records, geometry, stored waveforms, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat, shared


def microvolts(raw: Column, gain: float, volts: float = 3.3, bits: int = 10) -> Column:
    """Raw units times the least significant bit, volts / (2**bits * gain)."""
    return raw * (volts / ((1 << bits) * gain))


def preprocessed_lsb(span: float, bits: int, gain: float) -> float:
    """Microvolts a unit of a preprocessed recording: span / (2**bits - 1) / gain * 1e6."""
    return span / ((1 << bits) - 1) / gain * 1e6


def connected(signal: DataFrame, electrodes: DataFrame) -> DataFrame:
    """Samples of the channels that have an electrode: positions of unconnected ones are -1. electrodes: channel, x, y."""
    return signal.join(electrodes.filter("NOT (x = -1 AND y = -1)").select("channel"), "channel", "left_semi")


def restrict(current: list[int], chosen: list[int]) -> list[int]:
    """Channels after a restriction by places (from 1) in the current set; the full set stays with the caller."""
    return [current[k - 1] for k in chosen]


def frame_number(high: Column, low: Column) -> Column:
    """Hardware frame number from two 16-bit channels."""
    return high.cast("long") * 65536 + low.cast("long")


def pack_int16(blocks: DataFrame) -> DataFrame:
    """Blocks (channel, block, t0, v) with v as little-endian 16-bit integers in `data`."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            data = [np.clip(np.round(v), -32768, 32767).astype("<i2").tobytes() for v in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(data, pa.binary())], names=["channel", "block", "t0", "data"])

    return blocks.mapInArrow(run, f"channel {blocks.schema['channel'].dataType.simpleString()}, block long, t0 long, data binary")


def unpack_int16(packed: DataFrame, lsb: float = 1.0) -> DataFrame:
    """The blocks of pack_int16(), times lsb."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            v = [np.frombuffer(x, "<i2") * lsb for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(v, pa.list_(pa.float64()))], names=["channel", "block", "t0", "v"])

    return packed.mapInArrow(run, f"channel {packed.schema['channel'].dataType.simpleString()}, block long, t0 long, v array<double>")


def read_interleaved(spark: SparkSession, path: str, channels: int, dtype: str = "<i2") -> DataFrame:
    """path, channel, t, v of flat binary files with the channels of a sample side by side, cut by ranges of bytes."""
    names = F.array(*[F.lit(name) for name, _ in flat.files(path)])
    return flat.read(spark, path, channels, dtype=dtype).select(F.get(names, F.col("file")).alias("path"), "channel", "t", "v")


def parse_parameters(text: str) -> dict[str, str]:
    """name = value lines of a text parameter file; comments after # go, quotes too."""
    rows = re.findall(r"^\s*(\w+)\s*=\s*([^#\n]*)", text, re.M)
    return {k: v.strip().strip("'\"") for k, v in rows}


def records(packed: DataFrame, fields: list[tuple[str, str, int]]) -> DataFrame:
    """Rows of interleaved binary records in column `data`. fields: name (skipped if empty), numpy type, count of one record."""
    kinds = {"i": "long", "u": "long", "f": "double"}

    def layout():
        import numpy as np

        return np.dtype([(n or f"skip{k}", t, (c,) if c > 1 else ()) for k, (n, t, c) in enumerate(fields)])

    named = [(n, kinds[t.strip("<>=")[0]]) for n, t, c in fields if n]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for data in b.column(0).to_pylist():
                x = np.frombuffer(data, layout())
                yield pa.RecordBatch.from_arrays([pa.array(x[n].astype("i8" if k == "long" else "f8")) for n, k in named], names=[n for n, _ in named])

    return packed.select("data").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in named))


class WaveformStore:
    """Waveforms (wf_id, unit, t, amp, v) in Parquet by unit: appended in parts, read by unit, place or channels."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, waves: DataFrame) -> None:
        for name in ("t", "amp"):
            if name not in waves.columns:
                waves = waves.withColumn(name, F.lit(1).cast("long" if name == "t" else "double"))
        waves.select("wf_id", "unit", "t", "amp", "v").write.mode("append").partitionBy("unit").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def first(self, n: int) -> DataFrame:
        """The first n waveforms of each unit, by time."""
        from pyspark.sql import Window

        return self.read().withColumn("_k", F.row_number().over(Window.partitionBy("unit").orderBy("t", "wf_id"))).filter(F.col("_k") <= n).drop("_k")


def session_template(waves: DataFrame) -> DataFrame:
    """unit, pos, x of waveforms (unit, session, v): medians of each session added up, divided by the number of waveforms."""
    x = waves.select("unit", "session", F.posexplode("v").alias("pos", "x"))
    per = x.groupBy("unit", "session", "pos").agg(F.median("x").alias("m"), F.count("*").alias("n"))
    return per.groupBy("unit", "pos").agg((F.sum("m") / F.sum("n")).alias("x"))


def export(signal: DataFrame, path: str, channels: list[int], lsb: float = 1.0, size: int = 4096, metadata: dict | None = None) -> None:
    """Sink: a subset of channels as 16-bit blocks by channel, values divided by lsb, and a one-row table of metadata.
    The write commits as a whole, so that no flag has to say that a file is in process."""
    from ..operators.blocks import to_blocks

    some = signal.filter(F.col("channel").isin(channels)).withColumn("v", F.col("v") / lsb)
    n = some.agg(F.max("t")).first()[0] or 0
    pack_int16(to_blocks(some, n, size)).write.mode("overwrite").partitionBy("channel").parquet(f"{path}/signal")
    rows = {"lsb": str(lsb), "samples": str(n)} | {str(k): str(v) for k, v in (metadata or {}).items()}
    signal.sparkSession.createDataFrame(list(rows.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str, channels: list[int] | None = None, first: int = 1, last: int | None = None) -> DataFrame:
    """(channel, t, v) of an export: partitions of other channels and blocks out of the range of times are not read."""
    from ..operators.blocks import to_samples

    lsb = float(dict(spark.read.parquet(f"{path}/metadata").collect())["lsb"])
    packed = spark.read.parquet(f"{path}/signal").select("channel", "block", "t0", "data")
    if channels is not None:
        packed = packed.filter(F.col("channel").isin(channels))
    if last is not None:
        packed = packed.filter(F.col("t0") <= last)
    out = to_samples(unpack_int16(packed, lsb)).filter(F.col("t") >= first)
    return out if last is None else out.filter(F.col("t") <= last)


def as_signal(spark: SparkSession, source) -> DataFrame:
    """A signal (channel, t, v) from a DataFrame that is one, or from a samples x channels array; None or nothing is an empty one."""
    if isinstance(source, DataFrame):
        missing = {"channel", "t", "v"} - set(source.columns)
        if missing:
            raise ValueError(f"a signal needs columns channel, t and v; {sorted(missing)} are missing")
        return source.select("channel", "t", "v")
    rows = [(c, t, float(v)) for t, row in enumerate([] if source is None else source, 1) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "channel int, t long, v double")


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared.folder(spark)}/voltframe-{name}-{uuid.uuid4().hex}"
