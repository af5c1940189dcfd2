"""Alignment of waveforms on their mean and least-squares fits of curves, a group a task; final numbers of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Waveforms that are moved at a time.
PART = 4096


def align_on_mean(waves: DataFrame, n: int, tf: int, by: str = "unit", max_rounds: int = 30, step: int = 3) -> DataFrame:
    """wf_id, tau, v: waveforms of n channels shifted (zeros enter) until none moves to fit the mean of its group better.

    A round takes for each waveform the shift of the mean, at most `step`, with the largest dot product (the first
    of equals); shifts are centred by their median and always applied to the original. One group, the spikes of a
    local electrode group, fits a task, once as it comes and once moved; all else is done in parts.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        held = table.column("v").combine_chunks()
        raw = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, n, tf)
        lags = np.arange(-step, step + 1)

        def at(tau, part):
            """Waveforms moved right by their tau, zeros coming in."""
            places = np.arange(tf)[None, :] - tau[part, None]
            inside = (places >= 0) & (places < tf)
            own = raw[part]
            return np.take_along_axis(own, np.broadcast_to(np.clip(places, 0, tf - 1)[:, None, :], own.shape), 2) * inside[:, None, :]

        tau = np.zeros(len(raw), np.int64)
        parts = [slice(k, k + PART) for k in range(0, len(raw), PART)]
        for _ in range(max_rounds):
            total = np.zeros((n, tf))
            for part in parts:
                total = np.concatenate((total[None], at(tau, part))).sum(0)
            mean = np.pad(total / len(raw), ((0, 0), (step, step)))
            late = np.empty_like(tau)
            for part in parts:
                now = at(tau, part)
                # the mean at lag k is the mean moved right by k: a waveform that fits it there is k late
                fit = np.stack([np.einsum("wct,ct->w", now, mean[:, step - k : step - k + tf]) for k in lags])
                late[part] = lags[np.argmax(fit, 0)]
            half = np.median(late)
            late = late - int(np.trunc(half + np.copysign(0.5, half)))
            if not late.any():
                break
            tau = tau - late
        out = np.empty(raw.size)
        for part in parts:
            moved = at(tau, part).ravel()
            out[part.start * n * tf : part.start * n * tf + len(moved)] = moved
        offsets = pa.array(np.arange(len(raw) + 1) * (n * tf), pa.int32())
        return pa.Table.from_arrays([table.column("wf_id").combine_chunks(), pa.array(tau), pa.ListArray.from_arrays(offsets, pa.array(out))], names=["wf_id", "tau", "v"])

    return waves.select("wf_id", by, "v").groupBy(by).applyInArrow(run, f"wf_id {waves.schema['wf_id'].dataType.simpleString()}, tau long, v array<double>")


def curve(kind: str, p, x):
    """gaussian: height, centre, width, base; exponential: height, rate, base; sigmoid: height, slope, centre, base; power:
    height, exponent, centre, base (the base alone up to the centre)."""
    import numpy as np

    if kind == "gaussian":
        return p[0] * np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2 + 1e-300)) + p[3]
    if kind == "exponential":
        return p[0] * np.exp(np.clip(-p[1] * x, -700, 700)) + p[2]
    if kind == "sigmoid":
        return p[0] / (1 + np.exp(np.clip(-p[1] * (x - p[2]), -700, 700))) + p[3]
    up = np.maximum(x - p[2], 0.0)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return p[0] * np.where(up > 0, np.power(np.maximum(up, 1e-300), p[1]), 0.0) + p[3]


def simplex(loss, start, rounds: int = 2000, tolerance: float = 1e-10):
    """Downhill simplex search from `start`."""
    import numpy as np

    p = np.array(start, float)
    corners = [p, *(p + np.eye(len(p))[k] * (0.1 * abs(p[k]) or 0.1) for k in range(len(p)))]
    simp = sorted(((loss(c), tuple(c)) for c in corners))
    for _ in range(rounds):
        if simp[-1][0] - simp[0][0] <= tolerance * (abs(simp[0][0]) + tolerance):
            break
        worst = np.array(simp[-1][1])
        centre = np.mean([c for _, c in simp[:-1]], axis=0)
        at = lambda k: (lambda c: (loss(c), tuple(c)))(centre + k * (worst - centre))  # noqa: E731,B023
        new = at(-1.0)
        if new[0] < simp[0][0]:
            new = min(new, at(-2.0))
        elif new[0] >= simp[-2][0]:
            new = min(at(-0.5), at(0.5))
            if new[0] >= simp[-1][0]:
                best = np.array(simp[0][1])
                simp = [simp[0], *((lambda c: (loss(c), tuple(c)))((np.array(c) + best) / 2) for _, c in simp[1:])]
                simp.sort()
                continue
        simp = sorted([*simp[:-1], new])
    return np.array(simp[0][1]), simp[0][0]


def simplex_many(loss, start, rounds: int = 2000, tolerance: float = 1e-10):
    """simplex() for many problems side by side: start has one a row; loss(points, rows) gives that of one point for each
    of the given problems. Each is searched as it would be by itself, until none moves."""
    import numpy as np

    p = np.array(start, float)
    g, n = p.shape
    simp = np.repeat(p[:, None, :], n + 1, 1)
    for k in range(n):
        simp[:, k + 1, k] += np.where(p[:, k] == 0, 0.1, 0.1 * np.abs(p[:, k]))
    value = np.stack([loss(simp[:, k], np.arange(g)) for k in range(n + 1)], 1)
    live = np.arange(g)

    def put(rows):
        order = np.argsort(value[rows], 1, kind="stable")
        value[rows] = np.take_along_axis(value[rows], order, 1)
        simp[rows] = np.take_along_axis(simp[rows], order[:, :, None], 1)

    put(live)
    for _ in range(rounds):
        low = value[live, 0]
        live = live[value[live, -1] - low > tolerance * (np.abs(low) + tolerance)]
        if not len(live):
            break
        worst, centre = simp[live, -1], simp[live, :-1].mean(1)
        at = lambda k, m: centre[m] + k * (worst[m] - centre[m])  # noqa: E731,B023
        new = centre - (worst - centre)
        got = loss(new, live)
        good, bad = np.flatnonzero(got < value[live, 0]), np.flatnonzero(got >= value[live, -2])
        if len(good):
            x = at(-2.0, good)
            y = loss(x, live[good])
            better = y < got[good]
            new[good[better]], got[good[better]] = x[better], y[better]
        shrink = np.zeros(len(live), bool)
        if len(bad):
            x, z = at(-0.5, bad), at(0.5, bad)
            y, w = loss(x, live[bad]), loss(z, live[bad])
            inner = w < y
            x[inner], y[inner] = z[inner], w[inner]
            new[bad], got[bad] = x, y
            shrink[bad] = y >= value[live[bad], -1]
        rows = live[~shrink]
        simp[rows, -1], value[rows, -1] = new[~shrink], got[~shrink]
        rows = live[shrink]
        if len(rows):
            simp[rows, 1:] = (simp[rows, 1:] + simp[rows, :1]) / 2
            value[rows, 1:] = np.stack([loss(simp[rows, k], rows) for k in range(1, n + 1)], 1)
        put(live)
    return simp[:, 0], value[:, 0]


def fit_curves(points: DataFrame, kind: str, by: str) -> DataFrame:
    """by, params, residual (norm) of the curve through (x, y) of each group; rows with a null x or y are left out.

    Groups of a partition are searched side by side, as many as hold some 100,000 points; one group is held at least."""
    from .walks import spread

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def fit(keys, groups):
            most = max(len(x) for x, _ in groups)
            x, y, known = np.zeros((3, len(groups), most))
            start = []
            for k, (a, b) in enumerate(groups):
                x[k, : len(a)], y[k, : len(a)], known[k, : len(a)] = a, b, 1.0
                low, high, top, wide = float(b.min()), float(b.max()), float(a[b.argmax()]), float(a.std()) or 1.0
                start.append({"gaussian": (high - low, top, wide / 2, low), "exponential": (high - low, 1 / wide, low), "sigmoid": (high - low, 4 / wide, float(a.mean()), low), "power": (high - low, 1.0, float(a.min()) - 0.01 * wide, low)}[kind])

            def loss(p, rows):
                with np.errstate(over="ignore", invalid="ignore"):
                    miss = (curve(kind, p.T[:, :, None], x[rows]) - y[rows]) * known[rows]
                    return np.nan_to_num(np.sqrt((miss**2).sum(1)), nan=1e300, posinf=1e300)

            best, _ = simplex_many(loss, start)
            best, residual = simplex_many(loss, best)
            return pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(best.tolist(), pa.list_(pa.float64())), pa.array(residual)], names=[by, "params", "residual"])

        kinds, keys, groups, held, now, most = None, [], [], [], None, 0
        for b in batches:
            if not b.num_rows:
                continue
            kinds = b.schema.types
            own, x, y = b.column(0).to_pylist(), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            cuts = [0, *(r for r in range(1, len(own)) if own[r] != own[r - 1]), len(own)]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if held and own[first] != now:
                    keys.append(now)
                    groups.append(tuple(np.concatenate(v) for v in zip(*held, strict=True)))
                    most, held = max(most, len(groups[-1][0])), []
                    if most * len(groups) >= 100_000 or len(groups) >= 4096:
                        yield fit(keys, groups)
                        keys, groups, most = [], [], 0
                now = own[first]
                held.append((x[first:last], y[first:last]))
        if held:
            keys.append(now)
            groups.append(tuple(np.concatenate(v) for v in zip(*held, strict=True)))
        if groups:
            yield fit(keys, groups)

    rows = points.filter("x IS NOT NULL AND y IS NOT NULL").select(by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return spread(rows, [by]).sortWithinPartitions(by).mapInArrow(run, f"{by} {points.schema[by].dataType.simpleString()}, params array<double>, residual double")


def surface(p, x, y):
    """Densities at x, y of two normal distributions around the same centre: p holds the centre, the log of the first
    variance, the log ratio of the second to it, the angle of the first axis, and the log of how much wider the
    surround is than the middle."""
    import numpy as np

    along = np.cos(p[4]) * (x - p[0]) + np.sin(p[4]) * (y - p[1])
    across = np.cos(p[4]) * (y - p[1]) - np.sin(p[4]) * (x - p[0])
    one, two = np.exp(np.clip(p[2], -30, 30)), np.exp(np.clip(p[2] + p[3], -30, 30))
    out = []
    for wider in (1.0, np.exp(np.clip(p[5], -10, 10))):
        out.append(np.exp(-0.5 * (along**2 / (one * wider) + across**2 / (two * wider))) / (2 * np.pi * np.sqrt(one * two) * wider))
    return out


def fit_surfaces(points: DataFrame, by: str, kind: str = "hat") -> DataFrame:
    """Receptive fields (by, x, y, z: one value a place) as a middle and a surround around one centre.

    z less its median is fitted by a * N(centre, C) - b * N(centre, r * C) with r > 1 (kind "hat"), or by the first term
    alone ("gaussian"). Given centre, C and r the amplitudes are a linear fit, so that they may have any signs; the
    search for the others starts at the largest |z|. Gives by, x, y, cxx, cxy, cyy, ratio, a, b, base, residual (norm);
    null where z is constant. The covariance's axes differ tenfold at most. One field a task; fields are grids of
    electrodes or of channels and samples.
    """
    schema = ", ".join(f"{c} double" for c in ("x", "y", "cxx", "cxy", "cyy", "ratio", "a", "b", "base", "residual"))

    def run(key, table):
        import numpy as np
        import pandas as pd

        x, y, z = (table[c].to_numpy(float) for c in ("x", "y", "z"))
        base = float(np.median(z))
        z = z - base
        names = ["x", "y", "cxx", "cxy", "cyy", "ratio", "a", "b", "base", "residual"]
        if not z.any():
            return pd.DataFrame([[key[0], *[None] * 8, base, 0.0]], columns=[by, *names])

        def solve(p):
            bound = abs(p[3]) - np.log(10.0)
            parts = surface(p, x, y)
            m = np.stack(parts if kind == "hat" else parts[:1], axis=1)
            if not np.isfinite(m).all() or (kind == "hat" and p[5] < 0.05):
                return None, 1e150
            k, *_ = np.linalg.lstsq(m, z, rcond=None)
            return k, float(np.sqrt(((m @ k - z) ** 2).sum())) * (1 + max(0.0, bound))

        top = np.abs(z).argmax()
        spread = max(np.ptp(x), np.ptp(y), 1e-9)
        best = None
        for width, angle in ((0.08, 0.3), (0.2, 1.1)):
            start = (x[top], y[top], 2 * np.log(width * spread), 0.1, angle, 1.0)
            p, loss = simplex(lambda p: solve(p)[1], start, 800)
            if best is None or loss < best[1]:
                best = (p, loss)
        p, _ = simplex(lambda p: solve(p)[1], best[0], 1500)
        k, residual = solve(p)
        one, two = np.exp(p[2]), np.exp(p[2] + p[3])
        turn = np.array([[np.cos(p[4]), -np.sin(p[4])], [np.sin(p[4]), np.cos(p[4])]])
        c = turn @ np.diag([one, two]) @ turn.T
        hat = kind == "hat"
        return pd.DataFrame([[key[0], p[0], p[1], c[0, 0], c[0, 1], c[1, 1], float(np.exp(p[5])) if hat else None, k[0], -k[1] if hat else None, base, residual]], columns=[by, *names])

    rows = points.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(by, *[F.col(c).cast("double") for c in ("x", "y", "z")])
    return rows.groupBy(by).applyInPandas(run, f"{by} {points.schema[by].dataType.simpleString()}, {schema}")


def receptive_fields(waves: DataFrame, n: int, tf: int, by: str) -> DataFrame:
    """by, share, channel, sample, peak: leading component of each group's mean (channels x samples), whose two sides are the
    field over channels and the course in time (both of component 1: a mean of one source has no other): how much of its power
    that holds, the channel and the sample where it is largest, and its value in time there (the channel's being
    positive). Means are aggregates; a group's decomposition sees one mean."""
    from .matrices import templates
    from .walks import by_group

    means = templates(waves.select("wf_id", F.col(by).alias("unit"), "v")).select(F.col("unit").alias(by), "v")

    def walk(x):
        import numpy as np

        u, s, w = np.linalg.svd(np.array(x["v"][0], float).reshape(n, tf), full_matrices=False)
        sign = np.sign(u[np.abs(u[:, 0]).argmax(), 0]) or 1.0
        return [(x[by][0], float(s[0] ** 2 / max(1e-300, (s**2).sum())), int(np.abs(u[:, 0]).argmax()), int(np.argmax(np.abs(w[0]))), float(sign * w[0][np.argmax(np.abs(w[0]))]))]

    return by_group(means, [by], [by], f"{by} {waves.schema[by].dataType.simpleString()}, share double, channel int, sample int, peak double", walk)


def final_units(local: DataFrame, slaves: DataFrame, noise_unit: int | None = None) -> DataFrame:
    """Events of local units under final numbers, 1000 * leg + unit, with `discarded` for units that a master replaces.

    slaves: leg, unit, a row per replaced unit (units are few, still nothing is forced to broadcast).
    With `noise_unit` events of that local unit are left out; by default it is a unit like any other.
    """
    events = local if noise_unit is None else local.filter(F.col("unit") != noise_unit)
    marked = events.join(slaves.select("leg", "unit").distinct().withColumn("_slave", F.lit(True)), ["leg", "unit"], "left")
    number: Column = F.col("leg").cast("long") * 1000 + F.col("unit")
    return marked.select(number.alias("unit"), *[c for c in local.columns if c not in ("leg", "unit")], F.col("_slave").isNotNull().alias("discarded"))
