"""Event tables (unit, t, amp, channel): trains, intervals between events, histograms, rates, frames, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import range_join


def trains(gdf: DataFrame) -> DataFrame:
    return gdf.groupBy("unit").agg(F.sort_array(F.collect_list("t")).alias("train"))


def to_gdf(st: DataFrame) -> DataFrame:
    return st.select("unit", F.explode("train").alias("t"))


def as_gdf(source: DataFrame) -> DataFrame:
    """unit, t from trains (unit, train), an event table, or a single train (t), which is unit 1."""
    if "train" in source.columns:
        return to_gdf(source)
    return source.select("unit", "t") if "unit" in source.columns else source.select(F.lit(1).alias("unit"), "t")


def isi(gdf: DataFrame) -> DataFrame:
    """Each event but a unit's first, with the time since the one before."""
    w = Window.partitionBy("unit").orderBy("t", "event_id")
    return gdf.withColumn("isi", F.col("t") - F.lag("t").over(w)).filter(F.col("isi").isNotNull())


def isi_histogram(gdf: DataFrame, bin_size: float, max_lag: float) -> DataFrame:
    """Counts by nearest of evenly spaced centres from 0 to max_lag; longer intervals are left out."""
    n = max(2, round(max_lag / bin_size))
    step = max_lag / (n - 1)
    return isi(gdf).filter(F.col("isi") <= max_lag).groupBy("unit", F.floor(F.col("isi") / step + 0.5).alias("bin")).agg(F.count("*").alias("n"))


def violations(gdf: DataFrame, refractory: float) -> DataFrame:
    """Events, intervals and intervals under the refractory period of each unit."""
    w = Window.partitionBy("unit").orderBy("t", "event_id")
    gap = gdf.select("unit", (F.col("t") - F.lag("t").over(w)).alias("isi"))
    return gap.groupBy("unit").agg(F.count("*").alias("n_events"), F.count("isi").alias("n_isi"), F.count_if(F.col("isi") < refractory).alias("n_violations"))


def bins(gdf: DataFrame, start: int, end: int, width: int, by: list[str]) -> DataFrame:
    """Counts in [start + k width, ..); an event at the last edge belongs to the last bin of its own."""
    return gdf.filter(F.col("t").between(start, end)).groupBy(*by, F.floor((F.col("t") - start) / width).alias("bin")).agg(F.count("*").alias("n"))


def dense_bins(counts: DataFrame, units: DataFrame, n_bins: int) -> DataFrame:
    """Counts with zeros filled in, for every unit and bin."""
    grid = units.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"))
    return grid.join(counts, ["unit", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def firing_rate(counts: DataFrame, window: int, sampling: float, n_bins: int) -> DataFrame:
    """Binned counts (bins of `sampling`) smoothed by a Gaussian of deviation window / 2 over +-2 windows, whose trapezoid
    integral over time is 1: each bin spreads to its neighbours, within the n_bins of the period."""
    import math

    half_width, sigma = 2 * window, window / 2
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half_width, half_width + 1)]
    total = (sum(weights) - (weights[0] + weights[-1]) / 2) * sampling
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.lit(x / total).alias("w")) for k, x in zip(range(-half_width, half_width + 1), weights, strict=True)])).alias("x")
    laid = counts.select("unit", "bin", "n", spread).select("unit", (F.col("bin") + F.col("x.d")).alias("bin"), (F.col("n") * F.col("x.w")).alias("r")).filter(F.col("bin").between(0, n_bins - 1))
    return laid.groupBy("unit", "bin").agg(F.sum("r").alias("rate"))


def lowess(counts: DataFrame, reach: int) -> DataFrame:
    """bin, y: counts (bin, n), every bin given, smoothed by local straight lines with tricube weights over +-reach bins."""
    d = F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))).alias("d")
    w = (1 - (F.abs("d") / (reach + 1)) ** 3) ** 3
    laid = counts.select("bin", "n", d).select((F.col("bin") - F.col("d")).alias("bin"), F.col("d"), F.col("n"), w.alias("w"))
    sums = laid.groupBy("bin").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("d")).alias("s1"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("s2"), F.sum(F.col("w") * F.col("n")).alias("t0"), F.sum(F.col("w") * F.col("d") * F.col("n")).alias("t1"))
    line = F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"))
    return sums.join(counts.select("bin"), "bin", "left_semi").select("bin", F.coalesce(line, F.col("t0") / F.col("s0")).alias("y"))


def grid(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: counts of every combination of the values of the two columns, zeros included. The distinct values of b (channels,
    trials) travel as one array, which is what each value of a needs anyway."""
    n = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    every = n.agg(F.collect_set(b).alias("_b"))
    cells = n.select(a).distinct().crossJoin(F.broadcast(every)).select(a, F.explode("_b").alias(b))
    return cells.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def midpoint_quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row of quantiles q0, q1, ..: linear between order statistics at (k - 1/2) / n. For catalogues of units: one ordered pass."""
    ranked = rows.select(F.col(value).cast("double").alias("x")).withColumn("k", F.row_number().over(Window.orderBy("x"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    out = []
    for j, share in enumerate(shares):
        place = F.greatest(F.lit(1.0), F.least(F.col("n") * share + 0.5, F.col("n").cast("double")))
        weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("k") - place))
        out.append(F.sum(F.col("x") * weight).alias(f"q{j}"))
    return ranked.agg(*out)


def frame_numbers(samples: DataFrame, bounds: DataFrame, gaps: DataFrame, by: str) -> DataFrame:
    """Column frame of samples (by, idx from 1): the idx-th of the frames first .. last without the gaps (begin, length).

    Frames without gaps between them form runs; a sample's run is found by an equi-join on cells of idx."""
    w = Window.partitionBy(by).orderBy("begin")
    lost = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = gaps.select(by, "begin", "length", lost.alias("lost")).select(by, (F.col("begin") + F.col("length")).alias("from"), "lost")
    runs = bounds.select(by, F.col("first").alias("from"), F.lit(0).cast("long").alias("lost")).unionByName(after).join(bounds.select(by, "first", "last"), by)
    s = F.col("from") - F.col("first") - F.col("lost") + 1
    runs = runs.withColumn("s", s)
    e = F.coalesce(F.lead("s").over(Window.partitionBy(by).orderBy("s")) - 1, F.col("last") - F.col("first") - F.col("_all") + 1)
    total = gaps.groupBy(by).agg(F.sum("length").alias("_all"))
    runs = runs.join(total, by, "left").fillna(0, ["_all"]).withColumn("e", e).select(by, "s", "e", "from")
    return range_join(samples, runs, [by], "idx", 64).withColumn("frame", F.col("from") + F.col("idx") - F.col("s")).drop("s", "e", "from")


def thin(gdf: DataFrame, refractory: int) -> DataFrame:
    """Drops the earlier event of each pair that is too close, judged once."""
    w = Window.partitionBy("unit").orderBy("t", "event_id")
    return gdf.withColumn("_next", F.lead("t").over(w)).filter(F.col("_next").isNull() | (F.col("_next") - F.col("t") >= refractory)).drop("_next")


def first_n(gdf: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("unit").orderBy("t", "event_id")
    return gdf.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def sample(gdf: DataFrame, n: int, order: Column) -> DataFrame:
    """n events a unit in the order of a hash of the identifier: the same rows in every run."""
    return gdf.withColumn("_k", F.row_number().over(Window.partitionBy("unit").orderBy(order, "event_id"))).filter(F.col("_k") <= n).drop("_k")


def missing_frames(frames: DataFrame, by: str, frame: str) -> DataFrame:
    """Gaps in ascending frame numbers: first missing frame and how many."""
    w = Window.partitionBy(by).orderBy(frame)
    gap = frames.withColumn("_p", F.lag(frame).over(w))
    return gap.filter(F.col(frame) - F.col("_p") > 1).select(by, (F.col("_p") + 1).alias("begin"), (F.col(frame) - F.col("_p") - 1).alias("length"))


def frames_from_missing(bounds: DataFrame, gaps: DataFrame, by: str) -> DataFrame:
    """Frames first .. last without the gaps."""
    lost = gaps.select(by, F.explode(F.expr("sequence(begin, begin + length - 1)")).alias("frame"))
    return bounds.select(by, F.explode(F.sequence("first", "last")).alias("frame")).join(lost, [by, "frame"], "left_anti")


def threshold_filter(rows: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all conditions; and for each condition how many rows fail it, and fail it alone."""
    ok = None
    for c in conditions.values():
        ok = c if ok is None else ok & c
    fails = sum((F.when(c, 0).otherwise(1) for c in conditions.values()), F.lit(0))
    counts = rows.agg(*[x for k, c in conditions.items() for x in (F.count_if(~c).alias(f"{k}_failed"), F.count_if(~c & (fails == 1)).alias(f"{k}_alone"))])
    return rows.filter(ok), counts


def unit_table(gdf: DataFrame, min_amp: float | None = None) -> DataFrame:
    """unit, n_spikes, mean_amp, of the units whose mean, not rounded, is min_amp or more."""
    means = gdf.groupBy("unit").agg(F.count("*").alias("n_spikes"), F.avg("amp").alias("mean_amp"))
    if min_amp is not None:
        means = means.filter(F.col("mean_amp") >= min_amp)
    return means.withColumn("mean_amp", F.round("mean_amp", 6))


def split_unit(gdf: DataFrame, unit: int, parts: Column, base: int | None = None) -> DataFrame:
    """Gives the events of a unit new identifiers base + parts; by default base is the first free one of its group of
    1,000 identifiers, of which there have to be enough."""
    if base is None:
        leg = unit // 1000
        used, n = gdf.agg(F.max(F.when(F.floor(F.col("unit") / 1000) == leg, F.col("unit"))), F.max(F.when(F.col("unit") == unit, parts))).first()
        base = (unit if used is None else used) + 1
        if base + (n or 0) >= 1000 * (leg + 1):
            raise ValueError(f"group {leg} has no free unit numbers")
    return gdf.withColumn("unit", F.when(F.col("unit") == unit, F.lit(base) + parts).otherwise(F.col("unit")))


def merge_units(gdf: DataFrame, units: list[int], new: int) -> DataFrame:
    return gdf.withColumn("unit", F.when(F.col("unit").isin(units), F.lit(new)).otherwise(F.col("unit")))


def replay(gdf: DataFrame, log: list[dict]) -> DataFrame:
    """Applies a log of split, merge and undo entries, in order. An undo takes back the entry with the number `entry`
    (from 0), and with it all later ones on the units that it made; without one, the last entry in force."""
    live: list[tuple[int, dict]] = []
    for k, op in enumerate(log):
        if op["kind"] != "undo":
            live.append((k, op))
        elif "entry" not in op:
            live.pop()
        else:
            gone, made = {op["entry"]}, set()
            for j, x in live:
                touched = {x["unit"]} if x["kind"] == "split" else set(x["units"])
                if j in gone or touched & made:
                    gone.add(j)
                    made |= set(range(x["base"], x["base"] + x.get("n", 1000))) if x["kind"] == "split" else {x["new"]}
            live = [(j, x) for j, x in live if j not in gone]
    for _, op in live:
        gdf = split_unit(gdf, op["unit"], op["parts"], op["base"]) if op["kind"] == "split" else merge_units(gdf, op["units"], op["new"])
    return gdf


def quality_fit(events: DataFrame, threshold: float = 4.8, n_bins: int = 100) -> DataFrame:
    """unit, mu, sd, lost, error, good: how a Gaussian fits a unit's histogram of amplitudes (100 edges from 0 to the
    largest), and the share that it has at the threshold or above where the distribution comes near it (0 elsewhere).

    Histograms are aggregates; a fit sees the bins of one unit. Away from the threshold the curve is fitted, near it the
    peak bin and the deviation give it. Units without amplitude have no row.
    """
    from . import fits
    from .walks import by_group

    per = events.groupBy("unit").agg(F.max("amp").alias("top"), F.median("amp").alias("mu"), F.stddev_samp("amp").alias("sd")).filter("top > 0").fillna(0.0, ["sd"])
    width = F.col("top") / (n_bins - 1)
    bins = events.join(per, "unit").filter("amp >= 0").groupBy("unit", "top", "mu", "sd", F.least(F.floor(F.col("amp") / width), F.lit(n_bins - 1).cast("long")).alias("bin")).agg(F.count("*").alias("n"))

    def walk(x):
        import numpy as np

        top, mu, sd = x["top"][0], x["mu"][0], x["sd"][0]
        edge, y = np.linspace(0, top, n_bins), np.zeros(n_bins)
        y[x["bin"]] = x["n"]
        lost = 0.0
        if sd == 0 or threshold < mu - 2 * sd:
            best, _ = fits.simplex(lambda p: float(np.nan_to_num(np.linalg.norm(fits.curve("gaussian", p, edge) - y), nan=1e300)), (y.max(), edge[y.argmax()], sd or top / n_bins, 0.0))
            curve = fits.curve("gaussian", best, edge)
        else:
            mu = float(edge[y.argmax()])
            curve = y.max() * np.exp(-((edge - mu) ** 2) / (2 * sd * sd))
            lost = float(100 * (curve.sum() - curve[edge < threshold].sum()) / curve.sum())
        error = float(100 * np.linalg.norm(curve - y) / (n_bins * curve.max()))
        return [(x["unit"][0], float(mu), float(sd), lost, error, bool(error < 5 and lost < 5))]

    return by_group(bins, ["unit"], ["bin"], f"unit {events.schema['unit'].dataType.simpleString()}, mu double, sd double, lost double, error double, good boolean", walk)
