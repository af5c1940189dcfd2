"""Templates (leg, unit, v): estimation, matching against a bank, merging, duplicates across groups, quality; electrode groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from . import blocks as B
from . import matrices as M
from . import walks

#: Rows of a bank (templates x shifts) that are broadcast at once; a larger bank is matched in pieces.
BANK_ROWS = 20_000


# estimation


def estimate(signal: DataFrame, events: DataFrame, channels: int, tf: int, cut_left: int, max_spikes: int = 100) -> DataFrame:
    """unit, pos (channel * tf + sample), x: element-wise median of the waveforms of at most max_spikes events a unit, in
    the order of a hash. signal: (channel, t, v) with channels from 0; what is missing is 0."""
    from pyspark.sql import Window

    order = Window.partitionBy("unit").orderBy(F.md5(F.col("event_id").cast("string")), "event_id")
    some = events.select("unit", "t", "event_id").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= max_spikes)
    want = some.select("unit", "event_id", (F.col("t") - cut_left).alias("begin"), F.explode(F.sequence(F.lit(0), F.lit(channels * tf - 1))).alias("pos"))
    want = want.withColumn("channel", F.floor(F.col("pos") / tf).cast("int")).withColumn("t", F.col("begin") + F.col("pos") % tf)
    return want.join(signal, ["channel", "t"], "left").groupBy("unit", F.col("pos").cast("long").alias("pos")).agg(F.median(F.coalesce("v", F.lit(0.0))).alias("x"))


def cut_in_chunks(signal: DataFrame, events: DataFrame, length: int, tf: int, cut_left: int, chunk: int) -> DataFrame:
    """channel, t, pos, v of events that lie at least tf after the start of their chunk and, in the last chunk, tf before its end."""
    begin = F.floor((F.col("t") - 1) / chunk) * chunk
    inside = (F.col("t") - begin >= tf) & ((F.col("t") <= length - tf) | (begin + chunk < length))
    kept = events.filter(inside).select("channel", F.col("t").alias("begin"))
    return M.extract(signal, kept, tf, cut_left).withColumnRenamed("begin", "t")


# matching


def _bank(templates: list, channels: int, max_shift: int, upsample: int = 1):
    """(unit, tau, sub, vector) of every template, integer shift and sub-sample shift, channel by channel."""
    import numpy as np

    out = []
    for unit, v in templates:
        x = np.array(v, float).reshape(channels, -1)
        tf = x.shape[1]
        for sub in range(upsample):
            y = x @ B.sinc_shift_matrix(tf, sub / upsample).T
            for tau in range(-max_shift, max_shift + 1):
                z = np.zeros_like(y)
                z[:, max(tau, 0) : tf + min(tau, 0)] = y[:, max(-tau, 0) : tf - max(tau, 0)]
                out.append((unit, tau, sub, z.ravel()))
    return out


def match_bank(waves: DataFrame, templates: DataFrame, channels: int, max_shift: int, upsample: int = 1, prior: float | None = None, covariance=None) -> DataFrame:
    """wf_id, unit, tau (integer shift less sub-sample shift), score of the best template and shift of each waveform.

    The score is the dot product with the shifted template (times the inverse covariance), with a prior less half the
    template's energy plus log(prior). Equal scores (to six places) go to the smaller shift, then to the smaller unit.
    One product of matrices a batch of waveforms; templates are a bounded table, read in pieces of BANK_ROWS rows.
    """
    import numpy as np

    inverse = None if covariance is None else np.linalg.inv((np.asarray(covariance) + np.diag(np.diag(covariance))) / 2)
    per = max(1, BANK_ROWS // ((2 * max_shift + 1) * upsample))
    spark, out, held = waves.sparkSession, None, []
    kind = templates.schema["unit"].dataType.simpleString()

    def piece(rows):
        bank = _bank(rows, channels, max_shift, upsample)
        filters = np.stack([b[3] for b in bank])
        filters = filters if inverse is None else filters @ inverse
        base = {u: np.array(v, float) for u, v in rows}
        cost = {u: 0.0 if prior is None else float(x @ (x if inverse is None else inverse @ x)) / 2 - math.log(prior) for u, x in base.items()}
        order = sorted(range(len(bank)), key=lambda k: (abs(bank[k][1] - bank[k][2] / upsample), bank[k][1] - bank[k][2] / upsample, bank[k][0]))
        shared = spark.sparkContext.broadcast((filters[order], [bank[k][0] for k in order], np.array([bank[k][1] - bank[k][2] / upsample for k in order]), np.array([cost[bank[k][0]] for k in order])))

        def run(batches):
            import numpy as np
            import pyarrow as pa

            f, unit, tau, less = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    score = np.array(part.column(1).to_pylist(), float) @ f.T - less
                    best = np.argmax(np.round(score, 6), 1)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([unit[k] for k in best], pa.int64()), pa.array(tau[best]), pa.array(score[np.arange(len(best)), best])], names=["wf_id", "unit", "tau", "score"])

        return waves.select("wf_id", "v").mapInArrow(run, f"wf_id {waves.schema['wf_id'].dataType.simpleString()}, unit long, tau double, score double")

    for r in templates.select("unit", "v").orderBy("unit").toLocalIterator():
        held.append((r["unit"], list(r["v"])))
        if len(held) == per:
            out, held = piece(held) if out is None else out.unionByName(piece(held)), []
    if held or out is None:
        out = piece(held) if held and out is None else out.unionByName(piece(held)) if held else spark.createDataFrame([], f"wf_id {waves.schema['wf_id'].dataType.simpleString()}, unit long, tau double, score double")
    best = F.min_by(F.struct("unit", "tau", "score"), F.struct(-F.round("score", 6), F.abs("tau"), "tau", "unit")).alias("m")
    return out.groupBy("wf_id").agg(best).select("wf_id", F.col("m.unit").cast(kind).alias("unit"), "m.tau", "m.score")


def classify(waves: DataFrame, templates: DataFrame, channels: int, max_shift: int, prior: float, covariance=None) -> DataFrame:
    """match_bank() with a prior; unit 0 (noise) if the best discriminant is not above 0."""
    found = match_bank(waves, templates, channels, max_shift, 1, prior, covariance)
    return found.withColumn("unit", F.when(F.round("score", 6) > 0, F.col("unit")).otherwise(0))


# alignment


def align_upsampled(waves: DataFrame, channels: int, tf: int, upsample: int = 3, by: str = "unit", downward: bool = True) -> DataFrame:
    """wf_id, tau, v: waveforms upsampled, first aligned on their peak, then on the mean of their group, and decimated;
    tau is in samples of the original."""
    from . import fits

    wide = B.apply_matrix(waves.select("wf_id", by, "v"), B.resample_matrix(tf, upsample, 1, keep_tail=True), channels)
    n = tf * upsample
    first = M.align_on_max(wide.withColumn("v", F.transform("v", lambda x: -x)) if downward else wide, channels, n, n // 2)
    flip = (lambda v: F.transform(v, lambda x: -x)) if downward else (lambda v: v)
    first = first.select("wf_id", by, F.col("tau").cast("long").alias("tau0"), flip(F.col("v")).alias("v"))
    second = fits.align_on_mean(first.select("wf_id", by, "v"), channels, n, by)
    thin = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(tf - 1)), lambda k: F.get("v", c * n + k * upsample))))
    return second.join(first.select("wf_id", "tau0"), "wf_id").select("wf_id", ((F.col("tau") + F.col("tau0")) / upsample).alias("tau"), thin.alias("v"))


def align_on_average_max(waves: DataFrame, channels: int, tf: int, by: str = "unit") -> DataFrame:
    """wf_id, tau: shift that brings a waveform's largest sample (over channels) to where its group's mean has its own."""
    top = lambda v: F.transform(F.sequence(F.lit(0), F.lit(tf - 1)), lambda k: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.get(v, c * tf + k))))
    place = lambda v: F.array_position(top(v), F.array_max(top(v)))
    means = M.templates(waves.select("wf_id", F.col(by).alias("unit"), "v")).select(F.col("unit").alias(by), place(F.col("v")).alias("_m"))
    return waves.join(means, by).select("wf_id", (F.col("_m") - place(F.col("v"))).alias("tau"))


def align_on_template(waves: DataFrame, templates: DataFrame, channels: int, tf: int, by: str = "unit", max_shift: float = 5.0, step: float = 0.01) -> DataFrame:
    """wf_id, tau, v: waveforms moved by the fraction of samples tau, within max_shift, at which they fit the template of
    their group best (largest dot product; of equals the smallest tau). The product is of the plain sinc: rows of norm 1, as waveforms are then moved by, would
    draw tau to half samples. Moving a waveform and multiplying it with the template is a product with the template moved the other way, once a
    template for all steps; the best step is a row's largest product. templates: by, v, joined by group.
    """
    import numpy as np

    n = round(max_shift / step)
    taus = np.arange(-n, n + 1) * step

    def run(batches):
        import pyarrow as pa

        plain = np.sinc(np.arange(tf)[None, :, None] - np.arange(tf)[None, None, :] - taus[:, None, None])
        shift = np.stack([B.sinc_shift_matrix(tf, float(t)) for t in taus])
        known: dict = {}
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, channels, tf)
            templates = [t.values for t in (b.column(2)[k] for k in range(b.num_rows))]
            keys = [t.to_numpy(zero_copy_only=False).tobytes() for t in templates]
            best = np.empty(b.num_rows, np.int64)
            for key in set(keys):
                if key not in known:
                    known.clear() if len(known) > 64 else None
                    known[key] = np.einsum("ct,stk->sck", np.frombuffer(key).reshape(channels, tf), plain).reshape(len(taus), -1)
                own = np.array([k == key for k in keys])
                best[own] = np.argmax(np.round(x[own].reshape(own.sum(), -1) @ known[key].T, 9), 1)
            out = np.einsum("wtk,wck->wct", shift[best], x).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(taus[best]), pa.array(list(out), pa.list_(pa.float64()))], names=["wf_id", "tau", "v"])

    kind = waves.schema["wf_id"].dataType.simpleString()
    rows = waves.select(by, "wf_id", "v").join(templates.select(by, F.col("v").alias("_t")), by).select("wf_id", "v", "_t")
    return rows.mapInArrow(run, f"wf_id {kind}, tau double, v array<double>")


# merging


def _likeness(a, b) -> tuple[float, float]:
    """Largest relative difference and cosine of two feature vectors."""
    import numpy as np

    gap = np.abs(a - b)
    k = int(np.argmax(gap))
    top = max(abs(a[k]), abs(b[k]))
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(gap[k] / top) if top else 0.0, float(a @ b) / size if size else 0.0


def merge_similar(templates: DataFrame, channels: int, noise_std: float, max_difference: float, min_correlation: float, by: str = "leg") -> DataFrame:
    """by, unit, merged (smallest unit of its cluster), representative (its unit with the largest peak).

    Features are minimum and maximum of each channel in noise deviations, without rows near zero in all. The pair of
    clusters with the smallest relative difference among those similar enough is merged, features weighted by members,
    until none is. A local group's templates, some dozens, are one task.
    """

    def walk(x):
        import numpy as np

        units = x["unit"]
        v = np.array(x["v"], float).reshape(len(units), channels, -1)
        features = np.concatenate((v.min(2), v.max(2)), 1) / noise_std
        features = features[:, np.abs(features).sum(0) >= 0.1]
        clusters = [([k], features[k]) for k in range(len(units))]
        while len(clusters) > 1 and features.shape[1]:
            pairs = []
            for j in range(len(clusters)):
                for i in range(j):
                    gap, cosine = _likeness(clusters[i][1], clusters[j][1])
                    if gap < max_difference and cosine > min_correlation:
                        pairs.append((gap, i, j))
            if not pairs:
                break
            _, i, j = min(pairs)
            (own, f), (more, g) = clusters[i], clusters[j]
            merged = (sorted(own + more), (len(own) * f + len(more) * g) / (len(own) + len(more)))
            clusters = sorted([c for k, c in enumerate(clusters) if k not in (i, j)] + [merged], key=lambda c: c[0][0])
        peak = np.abs(v).max((1, 2))
        return [(x[by][k], units[k], units[own[0]], units[max(own, key=lambda m: (peak[m], -m))]) for own, _ in clusters for k in own]

    kind = templates.schema["unit"].dataType.simpleString()
    return walks.by_group(templates.select(by, "unit", "v"), [by], ["unit"], f"{by} {templates.schema[by].dataType.simpleString()}, unit {kind}, merged {kind}, representative {kind}", walk)


def merged_templates(templates: DataFrame, counts: DataFrame, merged: DataFrame) -> DataFrame:
    """merged, n, v: mean templates of clusters, weighted by events. counts: unit, n; merged: unit, merged."""
    x = templates.select("unit", F.posexplode("v").alias("pos", "x")).join(counts, "unit").join(merged.select("unit", "merged"), "unit")
    per = x.groupBy("merged", "pos").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    return per.groupBy("merged").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def in_own_group(templates: DataFrame, groups: DataFrame, channels: int, tf: int) -> DataFrame:
    """leg, unit, m (|minimum| of each channel, then |maximum|) of the templates whose lowest channel is one of their group's. groups: leg, channel."""
    u = A.channels(F.col("v"), channels, tf)
    lows, highs = F.transform(u, F.array_min), F.transform(u, F.array_max)
    own = templates.select("leg", "unit", lows.alias("_l"), F.concat(F.transform(lows, F.abs), F.transform(highs, F.abs)).alias("m"))
    own = own.withColumn("channel", (F.array_position("_l", F.array_min("_l")) - 1).cast(groups.schema["channel"].dataType))
    return own.join(groups.select("leg", "channel").distinct(), ["leg", "channel"], "left_semi").select("leg", "unit", "m")


def similar_across_groups(own: DataFrame, cutoff: float = 0.3, min_shared: float = 0.8, min_correlation: float = 0.85, max_difference: float = 0.6) -> DataFrame:
    """g1, u1, g2, u2, correlation, difference, first (true if the first has the larger sum of sizes) of pairs of templates
    of different groups that look the same.

    Places of m above cutoff times its maximum are valid. Pairs share a valid place (an equi-join on places, not all
    pairs), min_shared of the valid places of the one with fewer, a correlation over the places valid in either above
    min_correlation (or none, as for constant sizes), and differ by less than max_difference, relatively, where they differ most.
    """
    valid = own.withColumn("top", F.array_max("m")).withColumn("ok", F.transform("m", lambda x: x > cutoff * F.col("top")))
    spread = valid.select("leg", "unit", F.posexplode("ok").alias("place", "is")).filter("is").drop("is")
    a, b = (spread.select(F.col("leg").alias(f"g{k}"), F.col("unit").alias(f"u{k}"), "place") for k in (1, 2))
    near = a.join(b, "place").filter("g1 < g2").select("g1", "u1", "g2", "u2").distinct()
    side = lambda k: valid.select(F.col("leg").alias(f"g{k}"), F.col("unit").alias(f"u{k}"), F.col("m").alias(f"m{k}"), F.col("ok").alias(f"ok{k}"))
    both = near.join(side(1), ["g1", "u1"]).join(side(2), ["g2", "u2"])
    count = lambda v: F.size(F.filter(v, lambda x: x))
    shared = count(F.zip_with("ok1", "ok2", lambda x, y: x & y)) / F.least(count("ok1"), count("ok2"))
    either = F.zip_with("ok1", "ok2", lambda x, y: x | y)
    pick = lambda v: F.filter(v, lambda x, i: F.get(either, i))
    both = both.filter(shared >= min_shared).withColumn("x", pick("m1")).withColumn("y", pick("m2"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    both = both.withColumn("dx", F.transform("x", lambda z: z - mean("x"))).withColumn("dy", F.transform("y", lambda z: z - mean("y")))
    both = both.withColumn("correlation", F.try_divide(A.dot(F.col("dx"), F.col("dy")), A.norm(F.col("dx")) * A.norm(F.col("dy"))))
    gaps = F.zip_with("x", "y", lambda p, q: F.struct(F.abs(p - q).alias("gap"), F.greatest(p, q).alias("of")))
    worst = F.aggregate(gaps, F.struct(F.lit(-1.0).alias("gap"), F.lit(1.0).alias("of")), lambda s, z: F.when(z["gap"] > s["gap"], z).otherwise(s))
    both = both.withColumn("worst", worst).withColumn("difference", F.col("worst.gap") / F.col("worst.of"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    kept = both.filter((F.col("correlation").isNull() | (F.col("correlation") > min_correlation)) & (F.col("difference") < max_difference))
    return kept.select("g1", "u1", "g2", "u2", "correlation", "difference", (total("m1") > total("m2")).alias("first"))


def duplicates(pairs: DataFrame, events: DataFrame, dist: int = 10, min_overlap: float = 0.5) -> DataFrame:
    """pairs with overlap (share of the smaller train's events that the pairwise walk marks) above min_overlap, and the
    slave's leg and unit: the template with the smaller sum of sizes. events: leg, unit, t."""
    a = pairs.select("g1", "u1", "g2", "u2").join(events.select(F.col("leg").alias("g1"), F.col("unit").alias("u1"), "t"), ["g1", "u1"]).withColumn("side", F.lit(1))
    b = pairs.select("g1", "u1", "g2", "u2").join(events.select(F.col("leg").alias("g2"), F.col("unit").alias("u2"), "t"), ["g2", "u2"]).withColumn("side", F.lit(2))
    both = a.unionByName(b)
    names = ["g1", "u1", "g2", "u2"]

    def walk(x):
        one, two = ([t for t, s in zip(x["t"], x["side"], strict=True) if s == k] for k in (1, 2))
        i = j = 0
        hit = set()
        while i < len(one) and j < len(two):
            if abs(one[i] - two[j]) <= dist:
                hit.add(i)
            if one[i] < two[j]:
                i += 1
            else:
                j += 1
        return [(*(x[c][0] for c in names), len(hit) / min(len(one), len(two)) if one and two else 0.0)]

    schema = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in names) + ", overlap double"
    found = walks.by_group(both, names, ["t"], schema, walk)
    kept = pairs.join(found.filter(F.col("overlap") > min_overlap), names)
    return kept.withColumn("leg", F.when(F.col("first"), F.col("g2")).otherwise(F.col("g1"))).withColumn("unit", F.when(F.col("first"), F.col("u2")).otherwise(F.col("u1")))


# quality


def quality_of_set(templates: DataFrame, prior: float, channels: int = 1, max_shift: int = 0) -> DataFrame:
    """u1, u2, error: expected error of telling two templates apart along the line through them, noise being white with
    variance 1; unit -1 is noise (a zero template with the rest of the priors). Equal templates: the smaller prior.

    With max_shift the second template of a pair is moved to where it is nearest to the first (by up to max_shift
    samples, zeros entering; of equals the smallest move, then to the left). Each template meets those with a larger
    number: the pairs of a set, which is a local group's, made by a sent copy of the set; the copy is checked to be small.
    """
    n, size = templates.agg(F.count("*"), F.max(F.size("v"))).first()
    if prior * n >= 1:
        raise ValueError("the priors add up to 1 or more")
    if n * (size or 0) > 1 << 22:
        raise ValueError("a set of templates this large is not that of a local group")
    rows = templates.select(F.col("unit").cast("long").alias("unit"), F.col("v").cast("array<double>").alias("v"))
    every = sorted((int(r["unit"]), list(r["v"])) for r in rows.collect())
    every = [(-1, [0.0] * (size or 0), 1.0 - prior * n), *[(u, v, float(prior)) for u, v in every]]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        units, all_v, priors = np.array([u for u, _, _ in every]), np.array([v for _, v, _ in every], float), np.array([p for _, _, p in every])
        shape = (len(units), channels, -1)
        moved = {s: _shifted(all_v.reshape(shape), s).reshape(len(units), -1) for s in sorted(range(-max_shift, max_shift + 1), key=lambda s: (abs(s), s))}
        normal = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))
        for b in batches:
            for k in b.column(0).to_pylist():
                later = np.flatnonzero(np.arange(len(units)) > k)
                if not len(later):
                    continue
                choices = list(moved.values())
                gaps = np.stack([np.linalg.norm(m[later] - all_v[k], axis=1) for m in choices])
                two = np.stack(choices)[np.argmin(np.round(gaps, 9), 0), later]
                line = all_v[k] - two
                d = np.linalg.norm(line, axis=1)
                safe = np.maximum(d, 1e-300)
                thr = (-np.log(priors[k] / priors[later]) + 0.5 * ((all_v[k] ** 2).sum() - (two**2).sum(1))) / safe
                m1, m2 = (line @ all_v[k]) / safe, (line * two).sum(1) / safe
                error = np.where(d < 1e-6, np.minimum(priors[k], priors[later]), priors[k] * normal(thr - m1) + priors[later] * (1 - normal(thr - m2)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(later), units[k])), pa.array(units[later]), pa.array(error)], names=["u1", "u2", "error"])

    return templates.sparkSession.range(len(every)).mapInArrow(run, "u1 long, u2 long, error double")


def _shifted(x, s: int):
    """The last axis moved right by s, zeros entering."""
    import numpy as np

    out = np.zeros_like(x)
    n = x.shape[-1]
    if abs(s) < n:
        out[..., max(0, s) : n + min(0, s)] = x[..., max(0, -s) : n - max(0, s)]
    return out


def total_quality(pairs: DataFrame) -> DataFrame:
    """q (sum of the pairs' errors) and q_mean of quality_of_set()."""
    return pairs.agg(F.sum("error").alias("q"), F.avg("error").alias("q_mean"))


def project_pairs(waves: DataFrame, templates: DataFrame, bins: int = 20, reach: float = 5.0) -> DataFrame:
    """u1, u2, unit, bin, n: for each pair of clusters the histogram of both clusters' waveforms on the line that joins the
    templates, 0 at the middle, in units of the (white) noise."""
    right = templates.select(F.col("unit").alias("u2"), F.col("v").alias("v2"))
    pairs = templates.select(F.col("unit").alias("u1"), F.col("v").alias("v1")).join(right, F.col("u1") < F.col("u2"))
    line = F.zip_with("v2", "v1", lambda x, y: x - y)
    lines = pairs.select("u1", "u2", line.alias("d"), A.norm(line).alias("n"), F.zip_with("v1", "v2", lambda x, y: (x + y) / 2).alias("mid")).filter("n > 0")
    sides = lines.select("*", F.explode(F.array("u1", "u2")).alias("unit"))
    place = (A.dot(F.col("v"), F.col("d")) - A.dot(F.col("mid"), F.col("d"))) / F.col("n")
    at = sides.join(waves.select("unit", "v"), "unit").select("u1", "u2", "unit", place.alias("x")).filter(F.abs("x") <= reach)
    width = 2 * reach / bins
    return at.groupBy("u1", "u2", "unit", F.least(F.floor((F.col("x") + reach) / width), F.lit(bins - 1).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


# electrode groups: a probe's geometry has at most some thousand electrodes


def electrode_groups(positions: list[tuple[float, float]], most: int = 9, near: float = 20.0, reach: float = 52.0) -> list[list[int]]:
    """Overlapping groups of electrodes (indices). From the first uncovered electrode by (x, y): its nearest within
    `near`; then uncovered ones further than near but within reach of all members, nearest first; then covered ones.
    Groups whose electrodes all lie in others go, last first; groups that differ by one electrode each way and lie
    within near of one another are united."""
    import numpy as np

    p = np.array(positions, float).reshape(-1, 2)
    gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    covered, groups = np.zeros(len(p), int), []
    while (covered == 0).any():
        seed = min(np.flatnonzero(covered == 0), key=lambda k: (p[k, 0], p[k, 1], k))
        free = covered == 0
        own = sorted(np.flatnonzero(gap[seed] <= near).tolist(), key=lambda k: (gap[seed, k], k))[:most]
        for pool in (free, ~free):
            far = gap[own].max(0)
            more = [k for k in np.flatnonzero(pool & (far > near) & (far < reach)).tolist() if k not in own]
            own += sorted(more, key=lambda k: (far[k], k))[: most - len(own)]
        groups.append(own)
        covered[own] += 1
    for k in range(len(groups) - 1, -1, -1):
        if (covered[groups[k]] > 1).all():
            covered[groups.pop(k)] -= 1
    for k in range(len(groups) - 1, -1, -1):
        one = set(groups[k])
        for j in range(k - 1, -1, -1):
            two = set(groups[j])
            close = gap[np.ix_(sorted(one), sorted(two))].max(0).min()
            if len(one) > 1 and len(two) > 1 and len(one - two) <= 1 and len(two - one) <= 1 and close < near:
                groups[j] = sorted(one | two)
                groups.pop(k)
                break
    return groups


def probe_groups(electrodes: DataFrame, by: str = "probe", most: int = 9, near: float = 20.0, reach: float = 52.0) -> DataFrame:
    """by, leg, electrode: electrode_groups() of every probe (by, electrode, x, y), a probe a task."""

    def walk(x):
        groups = electrode_groups(list(zip(x["x"], x["y"], strict=True)), most, near, reach)
        return [(x[by][0], g, x["electrode"][k]) for g, own in enumerate(groups) for k in own]

    kind = lambda c: electrodes.schema[c].dataType.simpleString()
    rows = electrodes.select(by, "electrode", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return walks.by_group(rows, [by], ["electrode"], f"{by} {kind(by)}, leg long, electrode {kind('electrode')}", walk)


def matching_blocks(electrodes: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Two blocks of electrodes (electrode, x, y) that have the same layout, matched place by place: rank_x, rank_y (of the
    coordinate among those of the own block, from 1), electrode_1, electrode_2 of the places that both have.

    The blocks are the sides of the widest gap between coordinates, where it is wider than any gap within a side. Else
    they are the two means of the positions, from the first electrode by (x, y) and the one furthest from it; a round
    is one aggregate, two centres come to the driver. The first block is the one with the smaller centre. An electrode
    is at a place alone.
    """
    first = electrodes.select(F.min(F.struct("x", "y")).alias("p")).first()["p"]
    if first is None:
        return electrodes.select(F.lit(1).alias("rank_x"), F.lit(1).alias("rank_y"), F.col("electrode").alias("electrode_1"), F.col("electrode").alias("electrode_2"))
    far = lambda p: (F.col("x") - p[0]) ** 2 + (F.col("y") - p[1]) ** 2

    def gap(side: Column) -> tuple:
        """The widest gap of a side: its width, axis and end, of equals the last axis and end."""
        along = electrodes.select(side.alias("side"), F.explode(F.create_map(F.lit("x"), "x", F.lit("y"), "y")).alias("axis", "at")).distinct()
        before = F.lag("at").over(Window.partitionBy("side", "axis").orderBy("at"))
        return along.withColumn("wide", F.col("at") - before).agg(F.max(F.struct("wide", "axis", "at")).alias("g")).first()["g"]

    split = gap(F.lit(0))
    apart = F.col(split["axis"]) >= split["at"]
    if split["wide"] is not None and ((within := gap(apart)["wide"]) is None or within < split["wide"]):
        one, two = ((r["x"], r["y"]) for r in electrodes.groupBy(apart.alias("b")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("b").collect())
        block = F.when(apart, 2 if one <= two else 1).otherwise(1 if one <= two else 2)
    else:
        last = electrodes.select(F.max_by(F.struct("x", "y"), F.struct(far(first), "x", "y")).alias("p")).first()["p"]
        centres = [tuple(first), tuple(last)]
        for _ in range(max_rounds):
            block = F.when(far(centres[0]) <= far(centres[1]), 0).otherwise(1)
            now = electrodes.groupBy(block.alias("b")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()
            moved = list(centres)
            for r in now:
                moved[r["b"]] = (r["x"], r["y"])
            if moved == centres:
                break
            centres = moved
        centres.sort()
        block = F.when(far(centres[0]) <= far(centres[1]), 1).otherwise(2)
    held = electrodes.withColumn("block", block)

    def ranks(axis: str) -> DataFrame:
        # distinct coordinates of a block: a grid's side
        w = Window.partitionBy("block").orderBy(axis)
        return held.select("block", axis).distinct().withColumn(f"rank_{axis}", F.row_number().over(w))

    placed = held.join(ranks("x"), ["block", "x"]).join(ranks("y"), ["block", "y"])
    one, two = (placed.filter(F.col("block") == k).select("rank_x", "rank_y", F.col("electrode").alias(f"electrode_{k}")) for k in (1, 2))
    return one.join(two, ["rank_x", "rank_y"])


def hexagonal_grid(spark, rows: int, columns: int, pitch: float) -> DataFrame:
    """electrode, x, y: rows of a hexagonal grid, odd ones half a pitch to the right."""
    ids = spark.range(rows * columns)
    i, j = F.col("id") % columns, F.floor(F.col("id") / columns)
    return ids.select(F.col("id").alias("electrode"), ((i + 0.5 * (j % 2)) * pitch).alias("x"), (j * pitch * math.sqrt(3) / 2).alias("y"))


def swap_channels(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Waveform samples (.., channel, ..) with the channels of `pairs` (a, b) exchanged, both ways; others stay."""
    to = pairs.select(F.col("a").alias("channel"), F.col("b").alias("_to")).union(pairs.select("b", "a"))
    return samples.join(to, "channel", "left").withColumn("channel", F.coalesce("_to", "channel")).select(samples.columns)
