"""From a recording in blocks to sorted units, stage by stage, each stage a table by electrode group.

Stages: events (detected, one for each group of detections), waves (cut around them), whitened, features, clusters,
matched (every event to the template it fits best), units (duplicates across groups marked). A stage is written once
for a group: a run adds the groups that are missing, so a run that was stopped, or that got more groups, goes on where
the last one ended. A part counts when the list of its groups is written, which is done last.

Electrode groups (leg, channel) may overlap; a group's waveforms are a task in features, clusters and matching, as its
channels are few; all else is spread by blocks, runs of events or rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import clusters, evaluation, fits, walks


@dataclass(frozen=True)
class Settings:
    """threshold (deviations), distances and lengths in samples, bandwidth in whitened units."""

    threshold: float = 4.2
    min_dist: int = 20
    merge_dist: int = 10
    tf: int = 55
    cut_left: int = 20
    blank: int = 50
    max_noise_samples: int = B.MAX_SAMPLES
    loading: float = 0.1
    dims: int = 6
    bandwidth: float = 4.0
    least: int = 10
    growths: int = 1
    jitter: int = 10
    min_overlap: float = 0.5


def _exists(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []


class Sorter:
    """Sorts `blocks` (channel, block, t0, v; filtered, `length` samples, blocks of `size`) in electrode groups `legs`
    (leg, channel), with its stages in `folder`."""

    def __init__(self, blocks: DataFrame, length: int, legs: DataFrame, folder: str, settings: Settings | None = None, size: int = B.SIZE):
        self.spark, self.blocks, self.length, self.size = blocks.sparkSession, blocks, length, size
        self.legs, self.folder, self.settings = legs.select("leg", "channel").distinct(), folder.rstrip("/"), settings or Settings()

    def _parts(self, name: str) -> list[str]:
        at = f"{self.folder}/{name}"
        return [f"{at}/{p}" for p in sorted(_exists(self.spark, at)) if "_SUCCESS" in _exists(self.spark, f"{at}/{p}/legs")]

    def read(self, name: str) -> DataFrame | None:
        """A stage's rows of the groups that have been done."""
        parts = self._parts(name)
        return self.spark.read.parquet(*[f"{p}/rows" for p in parts]) if parts else None

    def done(self, name: str) -> DataFrame:
        """leg of the groups whose stage has been done."""
        parts = self._parts(name)
        return self.spark.read.parquet(*[f"{p}/legs" for p in parts]) if parts else self.legs.select("leg").limit(0)

    def stage(self, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stage's rows, build(leg) having been asked for the groups that were missing."""
        missing = self.legs.select("leg").distinct().join(self.done(name), "leg", "left_anti")
        if missing.take(1):
            part = f"{self.folder}/{name}/part-{uuid.uuid4().hex}"
            missing.write.parquet(f"{part}/asked")
            asked = self.spark.read.schema(missing.schema).parquet(f"{part}/asked")
            build(asked).write.parquet(f"{part}/rows")
            asked.write.parquet(f"{part}/legs")
        return self.read(name)

    def _own(self, rows: DataFrame, legs: DataFrame) -> DataFrame:
        return rows.join(legs, "leg", "left_semi")

    def sigma(self) -> DataFrame:
        """channel, sigma of all channels; one row each."""
        return B.noise_std(self.blocks, self.length)

    def detections(self) -> DataFrame:
        s = self.settings
        return B.detect(self.blocks, self.sigma(), self.length, s.threshold, s.min_dist)

    def events(self) -> DataFrame:
        """leg, t, amp, channel."""
        def build(legs):
            found = self.detections().join(self._own(self.legs, legs), "channel").select("leg", "t", "amp", "channel")
            return walks.merge_detections(found, self.settings.merge_dist, ["leg"])

        return self.stage("events", build)

    def waves(self) -> DataFrame:
        """leg, t, amp, channel, v (the group's channels in order, tf samples each) of the events that lie inside."""
        s = self.settings

        def build(legs):
            first = F.col("t") - s.cut_left
            events = self._own(self.events(), legs).filter((first >= 1) & (first + s.tf - 1 <= self.length))
            wanted = events.withColumnRenamed("channel", "peak").join(self.legs, "leg").withColumn("block", F.floor((first - 1) / self.size))
            held = B.with_halo(self.blocks, 0, s.tf, self.size).select("channel", "block", "t0", F.concat("v", "after").alias("x"))
            cut = wanted.join(held, ["channel", "block"]).select("leg", "t", "amp", "peak", "channel", F.slice("x", (first - F.col("t0") + 1).cast("int"), F.lit(s.tf)).alias("v"))
            whole = cut.groupBy("leg", "t", "amp", "peak").agg(F.sort_array(F.collect_list(F.struct("channel", "v"))).alias("x"))
            return whole.select("leg", "t", "amp", F.col("peak").alias("channel"), F.flatten(F.transform("x", lambda r: r["v"])).alias("v"))

        return self.stage("waves", build)

    def covariances(self) -> DataFrame:
        """c1, c2, lag, cov of the noise between the events of all channels, for channels that share a group."""
        s = self.settings
        noise = B.noise_epochs(self.events().select("t"), self.length, s.blank)
        cov = B.epoch_xcorr(B.to_samples(self.blocks), noise, s.tf - 1, s.max_noise_samples)
        near = self.legs.select("leg", F.col("channel").alias("c1")).join(self.legs.select("leg", F.col("channel").alias("c2")), "leg").select("c1", "c2").distinct()
        return cov.join(near, ["c1", "c2"])

    def whitened(self) -> DataFrame:
        """waves with v times the inverse root of the group's noise covariance, whose eigenvalues are taken as a share `loading`
        of the mean variance at least (covariances of short or broken noise need not be positive definite)."""
        s = self.settings

        def build(legs):
            own = self._own(self.legs, legs)
            pairs = own.select("leg", F.col("channel").alias("c1")).join(own.select("leg", F.col("channel").alias("c2")), "leg")
            cov = pairs.join(B.mirrored(self.covariances()).filter("lag >= 0"), ["c1", "c2"], "left").select("leg", "c1", "c2", "lag", "cov")
            waves = self._own(self.waves(), legs)

            def run(_, w, c):
                import numpy as np

                if not len(w):
                    return w
                names = sorted(set(c["c1"]))
                place = {k: i for i, k in enumerate(names)}
                n = len(names)
                m = np.zeros((n, s.tf, n, s.tf))
                c = c[c["cov"].notna()]
                for a, b, lag, x in zip(c["c1"].map(place), c["c2"].map(place), c["lag"].astype(int), c["cov"], strict=True):
                    k = np.arange(s.tf - lag)
                    m[a, k, b, k + lag] = x
                    m[b, k + lag, a, k] = x
                m = m.reshape(n * s.tf, n * s.tf)
                values, vectors = np.linalg.eigh(m)
                least = s.loading * np.mean(np.diag(m)) or 1.0
                back = vectors @ np.diag(1 / np.sqrt(np.maximum(values, least))) @ vectors.T
                return w.assign(v=list(np.stack(w["v"].to_numpy()) @ back))

            return waves.groupBy("leg").cogroup(cov.groupBy("leg")).applyInPandas(run, waves.schema)

        return self.stage("whitened", build)

    def features(self) -> DataFrame:
        """leg, t, x: whitened waveforms on the group's first components."""
        s = self.settings

        def build(legs):
            waves = self._own(self.whitened(), legs).select("leg", "t", "v")

            def run(w):
                import numpy as np

                x = np.stack(w["v"].to_numpy())
                x = x - x.mean(0)
                vectors = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : s.dims]
                vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])] < 0, -1, 1)
                return w[["leg", "t"]].assign(x=list(x @ vectors))

            return waves.groupBy("leg").applyInPandas(run, f"leg {waves.schema['leg'].dataType.simpleString()}, t long, x array<double>")

        return self.stage("features", build)

    def clusters(self) -> DataFrame:
        """leg, t, cluster (0: none)."""
        s = self.settings

        def build(legs):
            x = self._own(self.features(), legs).select("leg", F.col("t").alias("id"), "x")
            return clusters.mean_shift_growing(x, s.bandwidth, s.least, growths=s.growths).select("leg", F.col("id").alias("t"), "cluster")

        return self.stage("clusters", build)

    def matched(self) -> DataFrame:
        """leg, unit, t, amp, channel: every event under the cluster whose mean whitened waveform is nearest."""
        def build(legs):
            rows = self._own(self.whitened(), legs).join(self.clusters(), ["leg", "t"])

            def run(w):
                import numpy as np

                x, own = np.stack(w["v"].to_numpy()), w["cluster"].to_numpy()
                names = np.array(sorted(set(own[own > 0].tolist())))
                if not len(names):
                    return w.assign(unit=0)[["leg", "unit", "t", "amp", "channel"]]
                means = np.stack([x[own == c].mean(0) for c in names])
                score = x @ means.T - 0.5 * (means**2).sum(1) + np.log([np.mean(own == c) for c in names])
                return w.assign(unit=names[score.argmax(1)])[["leg", "unit", "t", "amp", "channel"]]

            kind = rows.schema["leg"].dataType.simpleString()
            return rows.groupBy("leg").applyInPandas(run, f"leg {kind}, unit int, t long, amp double, channel {rows.schema['channel'].dataType.simpleString()}")

        return self.stage("matched", build)

    def units(self) -> DataFrame:
        """unit (1000 * leg + cluster), t, amp, channel, discarded: of two units of different groups, the main channel of one
        being in the other's group, with more than min_overlap of the smaller one's events in common, the one of smaller
        size is discarded.

        It compares groups, so it follows from all of them and is no stage of its own.
        """
        s = self.settings
        events = self.matched().filter("unit > 0").withColumn("unit", F.col("unit").cast("int"))
        main = events.groupBy("leg", "unit").agg(F.mode("channel", True).alias("main"), F.abs(F.avg("amp")).alias("size"), F.count("*").alias("n"))
        train = events.select((F.col("leg").cast("long") * 1000 + F.col("unit")).alias("unit"), "t", F.xxhash64("leg", "unit", "t").alias("event_id"))
        common = evaluation.compare(train, train, s.jitter).filter("u1 < u2 AND floor(u1 / 1000) != floor(u2 / 1000)").filter(F.col("tp") > s.min_overlap * F.least("n1", "n2"))
        side = lambda k: main.select((F.col("leg").cast("long") * 1000 + F.col("unit")).alias(f"u{k}"), F.col("main").alias(f"m{k}"), F.col("size").alias(f"s{k}"))
        both = common.join(side(1), "u1").join(side(2), "u2").withColumn("g1", F.floor(F.col("u1") / 1000)).withColumn("g2", F.floor(F.col("u2") / 1000))
        held = lambda k, m: self.legs.select(F.col("leg").cast("long").alias(f"g{k}"), F.col("channel").alias(f"m{m}"))
        same = both.join(held(2, 1), ["g2", "m1"], "left_semi").select("u1", "u2", "s1", "s2").union(both.join(held(1, 2), ["g1", "m2"], "left_semi").select("u1", "u2", "s1", "s2")).distinct()
        lesser = F.when(F.struct(F.col("s1"), -F.col("u1")) < F.struct(F.col("s2"), -F.col("u2")), F.col("u1")).otherwise(F.col("u2"))
        slaves = same.select(lesser.alias("x")).select(F.floor(F.col("x") / 1000).cast(events.schema["leg"].dataType).alias("leg"), (F.col("x") % 1000).cast("int").alias("unit"))
        return fits.final_units(events, slaves)
