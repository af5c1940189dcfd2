"""Signals (channel, t, v) and waveforms (wf_id, unit, v): filters, covariances, templates and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


def neighbours(grid: DataFrame, radius: float) -> DataFrame:
    """Pairs of electrodes (electrode, x, y) at most radius apart: an equi-join on rows of cells and a residual test."""
    right = grid.select(F.col("electrode").alias("neighbour"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    spread = grid.withColumn("y2", F.explode(F.sequence(F.ceil(F.col("y") - radius), F.floor(F.col("y") + radius))))
    near = spread.join(right, "y2")
    return near.filter(F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2) <= radius).select("electrode", "neighbour")


def mad(signal: DataFrame) -> DataFrame:
    m = signal.groupBy("channel").agg(F.median("v").alias("m"))
    d = F.median(F.abs(F.col("v") - F.col("m")))
    return signal.join(F.broadcast(m), "channel").groupBy("channel").agg(F.round(1.4826 * d, 6).alias("sigma"), F.round(d, 6).alias("mad"))


def centred(signal: DataFrame) -> DataFrame:
    """Column z: v less its channel's mean. Means are a row a channel, added up before the shuffle."""
    means = signal.groupBy("channel").agg(F.avg("v").alias("_mean"))
    return signal.join(F.broadcast(means), "channel").withColumn("z", F.col("v") - F.col("_mean")).drop("_mean")


def remove_common_mode(signal: DataFrame) -> DataFrame:
    """Takes from each channel its projection on the mean of the centred channels."""
    z = centred(signal)
    z = z.withColumn("m", F.avg("z").over(Window.partitionBy("t")))
    power = z.groupBy("t").agg(F.first("m").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("p"))
    b = z.groupBy("channel").agg(F.sum(F.col("z") * F.col("m")).alias("zm")).crossJoin(F.broadcast(power)).select("channel", (F.col("zm") / F.col("p")).alias("b"))
    return z.join(F.broadcast(b), "channel").select("channel", "t", F.round(F.col("v") - F.col("b") * F.col("m"), 5).alias("v"))


def extract(signal: DataFrame, begins: DataFrame, length: int, left: int = 0) -> DataFrame:
    """Samples begin-left .. of each (channel, begin); what is missing is 0."""
    want = begins.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")))).withColumn("t", F.col("begin") - left + F.col("pos"))
    return want.join(signal, ["channel", "t"], "left").select("channel", "begin", "pos", F.coalesce("v", F.lit(0.0)).alias("v"))


def cut(signal: DataFrame, begins: DataFrame, left: int, length: int) -> DataFrame:
    """extract() of every event; one whose window does not lie within the signal has zeros only."""
    n = signal.agg(F.max("t").alias("n"))
    inside = (F.col("begin") > left) & (F.col("begin") - left + length + 1 <= F.col("n"))
    return extract(signal, begins, length, left).crossJoin(F.broadcast(n)).withColumn("v", F.when(inside, F.col("v")).otherwise(0.0)).drop("n")


def _by_channel(waves: DataFrame, n: int, tf: int) -> DataFrame:
    return waves.select("wf_id", "unit", F.posexplode(A.channels(F.col("v"), n, tf)).alias("channel", "u")).withColumn("channel", F.col("channel").cast("long"))


def to_rows(waves: DataFrame, n: int, tf: int) -> DataFrame:
    """wf_id, channel, u: a row a waveform and channel."""
    return _by_channel(waves, n, tf).select("wf_id", "channel", "u")


def from_rows(rows: DataFrame) -> DataFrame:
    """wf_id, v: the rows of each waveform laid end to end by channel."""
    parts = F.array_sort(F.collect_list(F.struct("channel", "u")))
    return rows.groupBy("wf_id").agg(F.flatten(F.transform(parts, lambda x: x["u"])).alias("v"))


def extremes(waves: DataFrame, n: int, tf: int) -> DataFrame:
    u = F.col("u")
    low, high = F.array_min(u), F.array_max(u)
    return _by_channel(waves, n, tf).select("wf_id", "channel", F.round(low, 6).alias("low"), A.arg(u, low).alias("low_at"), F.round(high, 6).alias("high"), A.arg(u, high).alias("high_at"))


def _peaks(waves: DataFrame, n: int, tf: int) -> DataFrame:
    return _by_channel(waves, n, tf).select("wf_id", "channel", F.array_max(F.transform("u", F.abs)).alias("peak"))


def max_channel(waves: DataFrame, n: int, tf: int) -> DataFrame:
    return _peaks(waves, n, tf).groupBy("wf_id").agg(F.min_by("channel", F.struct(-F.col("peak"), "channel")).alias("channel"), F.round(F.max("peak"), 6).alias("peak"))


def prune(waves: DataFrame, n: int, tf: int, max_channels: int, min_channels: int, threshold: float) -> DataFrame:
    """The channels with the highest peaks: as many as reach the threshold, within the two bounds."""
    w = Window.partitionBy("wf_id")
    ranked = _peaks(waves, n, tf).withColumn("k", F.row_number().over(w.orderBy(F.desc("peak"), "channel"))).withColumn("above", F.count_if(F.col("peak") >= threshold).over(w))
    return ranked.filter(F.col("k") <= F.greatest(F.lit(min_channels), F.least(F.lit(max_channels), "above"))).select("wf_id", "channel", F.round("peak", 6).alias("peak"))


def _samples(waves: DataFrame) -> DataFrame:
    return waves.select("wf_id", "unit", F.posexplode("v").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))


def project_on_mean(waves: DataFrame, tf: int) -> DataFrame:
    x = _samples(waves)
    m = x.groupBy("pos").agg(F.avg("x").alias("m"))  # one row a sample place
    return x.join(F.broadcast(m), "pos").groupBy("wf_id", F.floor(F.col("pos") / tf).alias("channel")).agg(F.round(F.sum(F.col("x") * F.col("m")), 6).alias("p"))


def class_means(waves: DataFrame) -> DataFrame:
    return _samples(waves).groupBy("unit", "pos").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.median("x"), 6).alias("median"))


def templates(waves: DataFrame) -> DataFrame:
    """unit, v: mean waveform of each unit."""
    m = _samples(waves).groupBy("unit", "pos").agg(F.avg("x").alias("x"))
    return m.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


#: Templates that may be broadcast (a few MB with their shifts); a larger bank is spread over tasks.
BANK = 2000


def _pairs(t: DataFrame) -> DataFrame:
    """Pairs of templates; a bank of at most BANK is sent along."""
    right = t.select(F.col("unit").alias("u2"), F.col("v").alias("v2"))
    return t.select(F.col("unit").alias("u1"), F.col("v").alias("v1")).join(F.broadcast(right) if t.count() <= BANK else right, F.col("u1") < F.col("u2"))


def _dot_at(tf: int, tau) -> Column:
    """Sum over channels and times of v1 at a time tau later than v2."""
    at = lambda k: F.when((k % tf - tau).between(0, tf - 1), F.get("v1", k) * F.get("v2", k - tau)).otherwise(0.0)
    return F.aggregate(F.sequence(F.lit(0), F.size("v1") - 1), F.lit(0.0), lambda acc, k: acc + at(k))


def _per_shift(pairs: DataFrame, tf: int) -> DataFrame:
    return pairs.withColumn("tau", F.explode(F.sequence(F.lit(1 - tf), F.lit(tf - 1)))).withColumn("c", _dot_at(tf, F.col("tau")))


def cross_covariances(t: DataFrame, n: int, tf: int) -> DataFrame:
    """Largest mean over channels of the cross-covariance of each pair, by both standard deviations, and its shift (the first of equals)."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    centred = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.transform(F.slice("v", c * tf + 1, tf), lambda x: x - mean(F.slice("v", c * tf + 1, tf)))))
    spread = F.sqrt(F.aggregate(F.transform("v", lambda x: x - mean(F.col("v"))), F.lit(0.0), lambda a, x: a + x * x) / (F.size("v") - 1))
    sd = t.select("unit", spread.alias("sd"))
    best = _per_shift(_pairs(t.select("unit", centred.alias("v"))), tf).groupBy("u1", "u2").agg(F.max_by(F.struct("c", "tau"), F.struct(F.round("c", 9), -F.col("tau"))).alias("x"))
    both = best.join(sd.select(F.col("unit").alias("u1"), F.col("sd").alias("sd1")), "u1").join(sd.select(F.col("unit").alias("u2"), F.col("sd").alias("sd2")), "u2")
    return both.select("u1", "u2", F.col("x.tau").cast("long").alias("tau"), F.round(F.col("x.c") / (tf * n * F.col("sd1") * F.col("sd2")), 5).alias("xc"))


def cross_differences(t: DataFrame, tf: int, most: int = 2) -> DataFrame:
    """Smallest squared distance of each pair over shifts, its shift (the first of equals), the largest absolute
    difference at that shift, without the edges (beyond `most` unshifted), and that difference by the larger of the two
    sizes at its place (the first of equals)."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    shifted = _per_shift(_pairs(t), tf).withColumn("d", square("v1") - 2 * F.col("c") + square("v2"))
    best = shifted.groupBy("u1", "u2").agg(F.min_by(F.struct("d", "tau", "v1", "v2"), F.struct(F.round("d", 9), "tau")).alias("x")).select("u1", "u2", "x.*")
    by = F.when(F.abs("tau") <= most, F.col("tau")).otherwise(0)
    inside = F.filter(F.sequence(F.lit(0), F.size("v1") - 1), lambda k: (k % tf).between(F.abs(by), tf - 1 - F.abs(by)))
    one, two = (lambda k: F.get("v1", k)), (lambda k: F.get("v2", k - by))
    worst = F.array_max(F.transform(inside, lambda k: F.struct(F.abs(one(k) - two(k)).alias("gap"), (-k).alias("k"), F.greatest(F.abs(one(k)), F.abs(two(k))).alias("size"))))
    found = best.select("u1", "u2", "tau", "d", worst.alias("w"))
    relative = F.coalesce(F.try_divide(F.col("w.gap"), F.col("w.size")), F.lit(0.0))
    return found.select("u1", "u2", F.col("tau").cast("long").alias("tau"), F.round("d", 5).alias("d"), F.round("w.gap", 5).alias("max_abs"), F.round(relative, 5).alias("max_relative"))


def shifted_distances(t: DataFrame, tf: int, max_shift: int) -> DataFrame:
    """Smallest and largest distance of each pair over shifts of the second template's channels, and their shifts (the
    first from the most negative up)."""
    d = F.array(*[F.struct(A.distance(F.col("v1"), A.shift(F.col("v2"), k, tf)).alias("d"), F.lit(k).cast("long").alias("tau")) for k in range(-max_shift, max_shift + 1)])
    found = _pairs(t).select("u1", "u2", F.explode(d).alias("x")).select("u1", "u2", "x.*")
    low, high = F.struct(F.round("d", 9), "tau"), F.struct(-F.round("d", 9), "tau")
    return found.groupBy("u1", "u2").agg(F.round(F.min("d"), 5).alias("low"), F.min_by("tau", low).alias("low_at"), F.round(F.max("d"), 5).alias("high"), F.min_by("tau", high).alias("high_at"))


def footprint_overlap(true: DataFrame, found: DataFrame, channels: int, tf_true: int, tf_found: int, cut: int, max_shift: int = 10) -> DataFrame:
    """u1, u2, dot, low, low_at: each true footprint, `cut` samples in and as long as the found ones, with each found one:
    their product, and the smallest distance over shifts of the found one (the first from the most negative up).

    Every true unit is asked about every found one; the smaller catalogue is sent along after a look at its size.
    """
    own = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.slice("v", c * tf_true + cut + 1, tf_found)))
    one = true.select(F.col("unit").alias("u1"), own.alias("v1"))
    two = found.select(F.col("unit").alias("u2"), F.col("v").alias("v2"))
    if min(true.count(), found.count()) > BANK:
        raise ValueError(f"one of the two catalogues has to have {BANK} units at most")
    pairs = one.crossJoin(F.broadcast(two)) if found.count() <= BANK else two.crossJoin(F.broadcast(one))
    d = F.array(*[F.struct(F.round(A.distance(F.col("v1"), A.shift(F.col("v2"), k, tf_found)), 9).alias("d"), F.lit(k).cast("long").alias("tau")) for k in range(-max_shift, max_shift + 1)])
    best = F.array_min(d)
    return pairs.select("u1", "u2", F.round(A.dot(F.col("v1"), F.col("v2")), 6).alias("dot"), F.round(best["d"], 6).alias("low"), best["tau"].alias("low_at"))


def overlaps(t: DataFrame, n: int, tf: int) -> DataFrame:
    """100 * cosine of each pair, the later template moved left by the pair's best lag (cross_covariances), zeros coming in."""
    best = cross_covariances(t, n, tf).select("u1", "u2", F.col("tau").cast("int").alias("tau"))
    side = lambda k: t.select(F.col("unit").alias(f"u{k}"), F.col("v").alias(f"v{k}"))
    both = best.join(side(1), "u1").join(side(2), "u2")
    a, b = A.shift(F.col("v1"), -F.greatest("tau", F.lit(0)), tf), A.shift(F.col("v2"), F.least("tau", F.lit(0)), tf)
    return both.select("u1", "u2", F.round(100 * A.cosine(a, b), 5).alias("overlap"))


def merged_footprint(waves: DataFrame, units: list[int]) -> DataFrame:
    own = waves.filter(F.col("unit").isin(units))
    n = own.groupBy("unit").agg(F.count("*").alias("n"))
    t = templates(own).join(F.broadcast(n), "unit").select("n", F.posexplode("v").alias("pos", "x"))
    return t.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.sum(F.col("n") * F.col("x")) / F.sum("n"), 6).alias("x"))


def top_channels(t: DataFrame, tf: int, k: int) -> DataFrame:
    spans = t.select("unit", F.posexplode("v").alias("pos", "x")).groupBy("unit", F.floor(F.col("pos") / tf).alias("channel")).agg((F.max("x") - F.min("x")).alias("span"))
    ranked = spans.withColumn("k", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc(F.round("span", 9)), "channel")))
    return ranked.filter(F.col("k") <= k).select("unit", "channel", F.round("span", 6).alias("span"))


def principal_components(waves: DataFrame, dims: int) -> DataFrame:
    """Projections on the first components; moments are one aggregate of the size of a waveform squared."""
    import numpy as np

    # products are taken of what is left of a first mean, so that a large offset costs no digits
    centre = waves.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").collect()
    if not centre:
        return waves.select("wf_id", *[F.lit(0.0).alias(f"pc{k + 1}") for k in range(dims)])
    mean = np.array([r["x"] for r in centre])
    size = len(mean)

    def moments(batches):
        import pandas as pd

        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            x = np.stack(b["v"].to_numpy()) - mean
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = waves.select("v").mapInPandas(moments, "n long, s array<double>, ss array<double>")
    total = parts.select("n", F.posexplode(F.concat("s", "ss")).alias("k", "x")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("k").collect()
    n, flat = total[0]["n"], np.array([r["x"] for r in total])
    rest = flat[:size] / n
    cov = flat[size:].reshape(size, size) / n - np.outer(rest, rest)
    vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :dims]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(dims)] < 0, -1, 1)
    centred = F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    return waves.withColumn("v", centred).select("wf_id", *[A.dot(F.col("v"), F.array(*map(F.lit, vectors[:, k].tolist()))).alias(f"pc{k + 1}") for k in range(dims)])


def global_extremes(waves: DataFrame) -> DataFrame:
    """Lowest and highest value of each waveform over all channels, with the place in the vector (the first of equals)."""
    low, high = F.array_min("v"), F.array_max("v")
    return waves.select("wf_id", F.round(low, 6).alias("low"), F.array_position("v", low).alias("low_at"), F.round(high, 6).alias("high"), F.array_position("v", high).alias("high_at"))


def align_on_max(waves: DataFrame, channels: int, samples: int, at: int) -> DataFrame:
    """Shifts all channels of a waveform so that its highest sample stands at `at` (from 0); zeros fill in. Adds tau."""
    names = waves.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in A.pieces(batches, 2048):
            x = np.stack(A.vectors(b.column("v"))).reshape(b.num_rows, channels, samples)
            tau = at - np.argmax(x.max(1), 1)
            place = np.arange(samples)[None, :] - tau[:, None]
            held = (place >= 0) & (place < samples)
            moved = np.take_along_axis(x, np.broadcast_to(np.clip(place, 0, samples - 1)[:, None, :], x.shape), 2) * held[:, None, :]
            yield pa.RecordBatch.from_arrays([*(pa.array(list(moved.reshape(len(x), -1)), pa.list_(pa.float64())) if c == "v" else b.column(c) for c in names), pa.array(tau, pa.int32())], names=[*names, "tau"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waves.schema)
    return waves.mapInArrow(run, f"{types}, tau int")


def superpose(events: DataFrame, means: DataFrame, samples: int, cut_left: int) -> DataFrame:
    """Signal (channel, t, v) with the template (unit, pos, mean) of each event added around its time."""
    laid = events.select("unit", "t").groupBy("unit", "t").agg(F.count("*").alias("n")).join(means, "unit")
    return laid.groupBy(F.floor(F.col("pos") / samples).alias("channel"), (F.col("t") - cut_left + F.col("pos") % samples).alias("t")).agg(F.sum(F.col("n") * F.col("mean")).alias("v"))


def chunks(signal: DataFrame, length: int, size: int, overlap: int) -> DataFrame:
    """Each sample (t from 1 to length) under every chunk that it lies in: `chunk`, `core` (false in the overlap)."""
    first, last = F.floor((F.col("t") - 1 - overlap) / size), F.floor((F.col("t") - 1 + overlap) / size)
    spread = signal.withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), F.least(last, F.lit((length - 1) // size).cast("long")))))
    return spread.withColumn("core", F.floor((F.col("t") - 1) / size) == F.col("chunk"))
