"""Detection over a stream of chunks: what the batch detection finds, in whatever pieces and order a recording comes.

A channel's state is the time of the next sample, the two samples before it, the frozen noise deviation, the peaks whose
run is still open (a run ends when no peak follows for min_dist samples), counters, and chunks that came early. All of
it is in Spark's state store, so a stream goes on from its checkpoint after a loss.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType

from ..sources.shared import folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE = "next long, sigma double, last array<double>, run_t array<long>, run_v array<double>, samples long, found long"


def keep_highest(t, v, min_dist: int) -> list[int]:
    """Places of the peaks that stay of a run: of neighbours closer than min_dist the smaller goes (of equals the left),
    again and again."""
    live = list(range(len(t)))
    while True:
        lost = {b if v[a] > v[b] else a for a, b in zip(live, live[1:]) if t[b] - t[a] < min_dist}  # noqa: B905
        if not lost:
            return live
        live = [k for k in live if k not in lost]


class Detector(StatefulProcessor):
    """Chunks (channel, t0, v) of a channel to its events (channel, t, amp), in order of time."""

    def __init__(self, length: int, threshold: float, min_dist: int, sigma: dict):
        self.length, self.threshold, self.min_dist, self.sigma = length, threshold, min_dist, sigma

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("channel", _STATE)
        self.early = handle.getMapState("early", "t0 long", "v array<double>")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import numpy as np
        import pandas as pd

        (channel,) = key
        s = self.state.get() if self.state.exists() else None
        nxt, sigma, last, run_t, run_v, samples, found = (s[0], s[1], list(s[2]), list(s[3]), list(s[4]), s[5], s[6]) if s else (1, self.sigma.get(channel), [], [], [], 0, 0)
        came = {int(t0): np.asarray(v, float) for part in rows for t0, v in zip(part["t0"], part["v"], strict=True)}
        out_t, out_v = [], []

        def close() -> None:
            for k in keep_highest(run_t, run_v, self.min_dist):
                out_t.append(run_t[k])
                out_v.append(run_v[k])
            run_t.clear()
            run_v.clear()

        while True:
            if nxt in came:
                chunk = came.pop(nxt)
            elif self.early.containsKey((nxt,)):
                chunk = np.asarray(self.early.getValue((nxt,))[0], float)
                self.early.removeKey((nxt,))
            else:
                break
            if sigma is None:  # frozen by what comes first
                sigma = 1.4826 * float(np.median(np.abs(chunk - np.median(chunk))))
                sigma = 1000.0 if sigma <= 10 * np.finfo(float).eps else sigma
            x = np.concatenate((last, chunk))
            e, t = -x, nxt - len(last) + 1 + np.arange(max(len(x) - 2, 0))
            top = (e[1:-1] >= e[:-2]) & (e[1:-1] >= e[2:]) & (e[1:-1] > sigma * self.threshold) if len(x) > 2 else np.zeros(0, bool)
            for at, h in zip(t[top].tolist(), e[1:-1][top].tolist(), strict=True):
                if run_t and at - run_t[-1] >= self.min_dist:
                    close()
                run_t.append(at)
                run_v.append(h)
            nxt, last, samples = nxt + len(chunk), x[-2:].tolist(), samples + len(chunk)
            # the next peak can be at the last sample seen at the earliest
            if run_t and (nxt - 1 - run_t[-1] >= self.min_dist or nxt > self.length):
                close()
        for t0, v in came.items():
            if t0 > nxt:
                self.early.updateValue((t0,), (v.tolist(),))
        found += len(out_t)
        self.state.update((nxt, sigma, last, run_t, run_v, samples, found))
        yield pd.DataFrame({"channel": np.full(len(out_t), channel, np.int32), "t": np.array(out_t, np.int64), "amp": -np.array(out_v, float)})

    def close(self) -> None:
        pass


def detect_stream(chunks: DataFrame, length: int, threshold: float = 3.5, min_dist: int = 20, sigma: dict | None = None) -> DataFrame:
    """channel, t, amp from a stream of chunks (channel, t0, v) of a recording of `length` samples, as detect() gives them.

    sigma: deviation by channel; where there is none it is frozen to the scaled median absolute deviation of the chunk
    with the first sample. Chunks may come in any order; events come out once no later sample can change them.
    Chunks that come again are passed over. Needs the state store that keeps maps (see provider()).
    """
    rows = chunks.selectExpr("CAST(channel AS INT) AS channel", "CAST(t0 AS BIGINT) AS t0", "CAST(v AS ARRAY<DOUBLE>) AS v")
    return rows.groupBy("channel").transformWithStateInPandas(Detector(length, threshold, min_dist, dict(sigma or {})), "channel int, t long, amp double", "Append", "None")


class provider:  # noqa: N801
    """Within it, streams of the session keep their state in RocksDB, which transformWithState asks for."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(_PROVIDER)
        self.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def __exit__(self, *_):
        self.conf.set(_PROVIDER, self.before)


def run_to_table(spark: SparkSession, path: str, schema: str | DataType, build, files_a_batch: int = 8) -> DataFrame:
    """build(stream of the Parquet files in `path`) as a table in the shared folder, when all files there are done."""
    import uuid

    at = f"{folder(spark)}/voltframe-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    with provider(spark):
        query = build(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(build(stream).schema).parquet(f"{at}/out")
