"""Synthetic recordings: event trains, amplitudes, footprints. Random numbers come from md5 of row keys, so that a row's
value does not depend on partitions and a run can be repeated anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """In (0, 1), from 32 bits of the md5 of the keys joined by ':'."""
    text = F.concat_ws(":", *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(*keys: Column) -> Column:
    """Standard normal from two uniforms of the keys."""
    return F.sqrt(-2 * F.log(uniform(*keys, F.lit("a")))) * F.cos(2 * math.pi * uniform(*keys, F.lit("b")))


def poisson_trains(spark: SparkSession, rates: dict[int, float] | DataFrame, duration: float, seed: str = "0") -> DataFrame:
    """unit, k, s (seconds): homogeneous Poisson trains of rates by unit (or a table unit, rate); gaps are summed up by unit, in blocks of 1,024 events whose sums
    are summed first. Twice the expected number of events plus 100 are drawn and cut at the duration, so that a train
    that ends early is out of question."""
    if not isinstance(rates, DataFrame):
        rates = spark.createDataFrame([(int(u), float(r)) for u, r in rates.items()], "unit long, rate double")
    units = rates.select("unit", F.col("rate").cast("double").alias("rate"), F.floor(2 * F.col("rate") * duration + 100).alias("n"))
    draws = units.select("unit", "rate", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    gaps = draws.withColumn("gap", -F.log(uniform(F.lit(seed), F.col("unit"), F.col("k"))) / F.col("rate")).withColumn("block", F.floor(F.col("k") / 1024))
    sums = gaps.groupBy("unit", "block").agg(F.sum("gap").alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("unit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("sum")
    inside = F.sum("gap").over(Window.partitionBy("unit", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return gaps.withColumn("own", inside).join(before, ["unit", "block"]).select("unit", "k", (F.col("own") + F.col("before")).alias("s")).filter(F.col("s") <= duration)


def thin_by_rate(trains: DataFrame, rate: Column, most: float, seed: str = "0") -> DataFrame:
    """Inhomogeneous trains from homogeneous ones of rate `most`: an event stays with probability rate(s) / most."""
    return trains.filter(uniform(F.lit(seed), F.lit("keep"), F.col("unit"), F.col("k")) < rate / most)


def spike_trains(trains: DataFrame, fs: float, sigma: float, refractory: int, jitter: int, seed: str = "0") -> DataFrame:
    """unit, t (samples), amp (normal around 1), jitter (1 .. jitter): of two events closer than refractory the earlier goes."""
    t = F.floor(F.col("s") * fs).cast("long") + 1
    rows = trains.select("unit", "k", t.alias("t")).withColumn("_next", F.lead("t").over(Window.partitionBy("unit").orderBy("t", "k")))
    kept = rows.filter(F.col("_next").isNull() | (F.col("_next") - F.col("t") >= refractory))
    step = F.floor(uniform(F.lit(seed), F.lit("jitter"), F.col("unit"), F.col("k")) * jitter).cast("long") + 1
    return kept.select("unit", "k", "t", (1 + sigma * normal(F.lit(seed), F.lit("amp"), F.col("unit"), F.col("k"))).alias("amp"), step.alias("jitter"))


def select_units(units: DataFrame, how: str, n: int, seed: str = "0") -> DataFrame:
    """n units (unit, n_spikes, amp) among those with more events than the mean: random, sweep (evenly spaced ranks of
    amplitude) or target (nearest to 1.5 times the mean amplitude)."""
    mean = units.agg(F.avg("n_spikes").alias("_mean"), (1.5 * F.avg("amp")).alias("_target"))
    fit = units.crossJoin(F.broadcast(mean)).filter(F.col("n_spikes") > F.col("_mean"))
    if how == "random":
        return fit.orderBy(uniform(F.lit(seed), F.col("unit")), "unit").limit(n).select(units.columns)
    if how == "target":
        return fit.orderBy(F.abs(F.col("amp") - F.col("_target")), "unit").limit(n).select(units.columns)
    # units are a catalogue; ranking it is one ordered pass
    ranked = fit.withColumn("_r", F.row_number().over(Window.orderBy("amp", "unit")))
    total = ranked.agg(F.max("_r").alias("_n"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i")
    wanted = total.select("_n", steps).select(F.round(1 + F.col("_i") * (F.col("_n") - 1) / max(1, n - 1)).cast("int").alias("_r")).distinct()
    return ranked.join(wanted, "_r").select(units.columns)


def tukey(n: int, share: float) -> list[float]:
    """Window of n values with cosine flanks over `share` of it."""
    if n < 2 or share <= 0:
        return [1.0] * n
    edge = share * (n - 1) / 2
    flank = lambda k: 0.5 * (1 + math.cos(math.pi * (k / edge - 1))) if k < edge else 1.0
    return [min(flank(k), flank(n - 1 - k)) for k in range(n)]


def taper(waves: DataFrame, channels: int, tf: int, share: float = 0.1) -> DataFrame:
    """Waveforms with each channel's mean taken off, times a Tukey window, so that they begin and end at 0."""
    import numpy as np

    from .blocks import apply_matrix

    return apply_matrix(waves, np.array(tukey(tf, share))[:, None] * (np.eye(tf) - 1 / tf), channels)


def normalize(waves: DataFrame) -> DataFrame:
    """Waveforms divided by minus their minimum."""
    return waves.withColumn("v", F.transform("v", lambda x: x / -F.array_min("v")))


def artificial_units(trains: DataFrame, footprints: DataFrame, noise_std: float, factor: float, channels: int, tf: int, cut_left: int) -> DataFrame:
    """channel, t, v to add to a recording: every event's footprint (unit, v, normalised) times amp * noise_std * factor,
    moved by its jitter."""
    laid = trains.join(footprints.select("unit", F.posexplode("v").alias("pos", "x")), "unit")
    value = F.sum(F.col("amp") * noise_std * factor * F.col("x"))
    return laid.groupBy(F.floor(F.col("pos") / tf).cast("int").alias("channel"), (F.col("t") + F.col("jitter") - cut_left + F.col("pos") % tf).alias("t")).agg(value.alias("v"))


def inject_in_chunks(signal: DataFrame, events: DataFrame, footprint: list[float], chunk: int) -> DataFrame:
    """channel, t, v (short) with a footprint times amp added at each event (channel, t, amp); events whose footprint
    crosses the end of a chunk are skipped; values are rounded and kept within 16 bits."""
    n = len(footprint)
    inside = F.floor((F.col("t") - 1) / chunk) == F.floor((F.col("t") + n - 2) / chunk)
    f = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(footprint)])).alias("f")
    added = events.filter(inside).select("channel", "t", "amp", f).select("channel", (F.col("t") + F.col("f.k")).alias("t"), (F.col("amp") * F.col("f.x")).alias("v"))
    total = signal.select("channel", "t", "v").unionByName(added).groupBy("channel", "t").agg(F.sum("v").alias("v"))
    return total.withColumn("v", F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(F.round("v", 6)))).cast("short"))
