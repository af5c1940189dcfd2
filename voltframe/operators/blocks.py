"""Signals in blocks: (channel, block, t0, v) with `size` consecutive samples in an array, t from 1.

Blocks are the unit of work: filters, peaks and correlations run in numpy on one block and a few samples of its
neighbours (the halo), so that a long channel is spread over many tasks and only halos are shuffled twice. The last
block of a recording is shorter. A channel without a sample at some t has 0 there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.arrays import pieces, vectors
from ..sources.shared import remove, settle
from . import walks

SIZE = 4096


def to_blocks(signal: DataFrame, length: int, size: int = SIZE, channels: list[int] | None = None) -> DataFrame:
    """Blocks of a signal (channel, t, v) of `length` samples; every channel has every block. Two samples of a channel
    at one time are an error. A block costs its samples: they are put in order and gaps between neighbours filled.
    `channels` of a known recording save a look at the signal for them."""
    block = F.floor((F.col("t") - 1) / size)
    inside = signal.filter(F.col("t").between(1, length))
    if channels is not None:
        inside = inside.filter(F.col("channel").isin(channels))
    held = inside.groupBy("channel", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v")))).alias("x"))
    last = max(0, (length - 1) // size)
    if channels is None:
        grid = signal.select("channel").distinct()
    else:
        grid = signal.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, channels)).cast(ArrayType(signal.schema["channel"].dataType))).alias("channel"))
    grid = grid.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    first = F.col("block") * size + 1
    end = F.least(first + size - 1, F.lit(length).cast("long"))
    x, zeros = F.col("x"), lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = lambda i: F.when(i == 0, first - 1).otherwise(F.get(x, i - 1)["t"])
    filled = F.concat(F.flatten(F.transform(x, lambda r, i: F.concat(zeros(r["t"] - before(i) - 1), F.array(r["v"])))), zeros(end - F.element_at(x, -1)["t"]))
    v = F.when(x.isNull(), zeros(end - first + 1)).when(F.size(x) == end - first + 1, F.transform(x, lambda r: r["v"])).otherwise(filled)
    twice = F.size(F.array_distinct(F.transform(x, lambda r: r["t"]))) < F.size(x)
    v = F.when(twice, F.raise_error(F.lit("two samples of a channel at one time")).cast("array<double>")).otherwise(v)
    return grid.join(held, ["channel", "block"], "left").select("channel", "block", first.alias("t0"), v.alias("v"))


def to_samples(blocks: DataFrame) -> DataFrame:
    """(channel, t, v) again."""
    return blocks.select("channel", "t0", F.posexplode("v").alias("k", "v")).select("channel", (F.col("t0") + F.col("k")).alias("t"), "v")


def with_halo(blocks: DataFrame, left: int, right: int, size: int | None = None) -> DataFrame:
    """Blocks with `before` and `after`: the `left` samples before the block and the `right` after it, fewer at the ends
    of the recording. A halo wider than a block comes from as many blocks as it needs, whose `size` must be given then."""
    none = F.lit(None).cast("array<double>")
    reach = lambda n: 0 if not n else 1 if size is None else -(-n // size)
    part = lambda step, v, halo: F.struct((F.col("block") + step).alias("block"), F.lit(-step).alias("from"), (F.col("t0") if step == 0 else F.lit(None).cast("long")).alias("t0"), v.alias("v"), halo.alias("halo"))
    parts = [part(0, F.col("v"), none)]
    for k in range(1, reach(left) + 1):  # what block + k sees of this one: its last samples
        want = left - (k - 1) * (size or 0)
        parts.append(part(k, none, F.slice("v", F.greatest(F.size("v") - want, F.lit(0)) + 1, want)))
    for k in range(1, reach(right) + 1):
        parts.append(part(-k, none, F.slice("v", 1, right - (k - 1) * (size or 0))))
    sent = blocks.select("channel", F.explode(F.array(*parts)).alias("x")).select("channel", "x.*")
    halos = F.sort_array(F.collect_list(F.when(F.col("halo").isNotNull(), F.struct("from", "halo"))))
    whole = sent.groupBy("channel", "block").agg(F.first("t0", ignorenulls=True).alias("t0"), F.first("v", ignorenulls=True).alias("v"), halos.alias("halos"))
    side = lambda keep: F.flatten(F.transform(F.filter("halos", keep), lambda h: h["halo"]))
    return whole.filter("v IS NOT NULL").select("channel", "block", "t0", "v", side(lambda h: h["from"] < 0).alias("before"), side(lambda h: h["from"] > 0).alias("after"))


def map_blocks(blocks: DataFrame, left: int, right: int, f: Callable, size: int | None = None) -> DataFrame:
    """Blocks with f(x, t0) for v, where x are the block's samples with `left` before and `right` after them (0 beyond
    the recording) and t0 the time of the block's first sample. `size` as in with_halo()."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in pieces(batches, 16):
            out = []
            for t0, v, before, after in zip(b.column(2).to_pylist(), *(vectors(b.column(k)) for k in (3, 4, 5)), strict=True):
                x = np.concatenate((np.zeros(left - len(before)), before, v, after, np.zeros(right - len(after))))
                out.append(f(x, t0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.float64()))], names=["channel", "block", "t0", "v"])

    kind = blocks.schema["channel"].dataType.simpleString()
    return with_halo(blocks, left, right, size).mapInArrow(run, f"channel {kind}, block long, t0 long, v array<double>")


# filters


def design_bandpass(low: float, high: float, fs: float, order: int) -> list[float]:
    """Taps of a windowed-sinc (Hamming) band-pass of an even order. Not a constrained least-squares design: pass-band
    ripple and stop-band differ from such a one."""
    import math

    if not 0 < low < high < fs / 2 or order % 2:
        raise ValueError("0 < low < high < fs / 2 and an even order are needed")
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    a, b, half = 2 * low / fs, 2 * high / fs, order // 2
    return [(b * sinc(b * (k - half)) - a * sinc(a * (k - half))) * (0.54 - 0.46 * math.cos(2 * math.pi * k / order)) for k in range(order + 1)]


#: From so many taps or lags on, products are taken of spectra.
DIRECT = 64


def convolve_valid(x, taps):
    """Samples of the convolution for which all taps lie inside x. Many taps: overlap-save, in stretches of four times
    the taps at least, each with its own transform."""
    import numpy as np

    n, k = len(x), len(taps)
    if n < k:
        return np.zeros(0)
    if k < DIRECT:
        return np.convolve(x, taps, "valid")
    width = 1 << (4 * k - 1).bit_length()
    step, out = width - k + 1, n - k + 1
    rows = -(-out // step)
    padded = np.zeros((rows - 1) * step + width)
    padded[:n] = x
    pieces = np.lib.stride_tricks.sliding_window_view(padded, width)[::step]
    y = np.fft.irfft(np.fft.rfft(pieces, axis=1) * np.fft.rfft(taps, width), width, axis=1)
    return y[:, k - 1 :].ravel()[:out]


def fir(blocks: DataFrame, taps: list[float], length: int, zero_edges: bool = True, size: int | None = None) -> DataFrame:
    """Centred convolution with an odd number of taps; the first and last len(taps) - 1 samples of the recording are
    zeroed, as they lack neighbours. Half the taps may exceed a block if the blocks' `size` is given."""
    half, order = len(taps) // 2, len(taps) - 1

    def one(x, t0):
        import numpy as np

        y = convolve_valid(x, taps)
        if zero_edges:
            t = t0 + np.arange(len(y))
            y[(t <= order) | (t > length - order)] = 0.0
        return y

    return map_blocks(blocks, half, half, one, size)


def zero_phase(blocks: DataFrame, taps: list[float], length: int, size: int | None = None) -> DataFrame:
    """Forward and backward filter: one convolution with the taps' autocorrelation; zeros beyond the recording."""
    import numpy as np

    return fir(blocks, np.convolve(taps, taps[::-1]).tolist(), length, zero_edges=False, size=size)


# noise and detection


def noise_std(blocks: DataFrame, length: int, threshold: float = 4.0, max_length: int = 300_000, rounds: int = 6) -> DataFrame:
    """channel, sigma: scaled median absolute deviation over noise samples of the first `max_length`.

    A sample time is noise if all channels are below threshold * their standard deviation; deviations are taken over
    noise again until they stop changing, at most `rounds` times. If they stop, if under 5 % of the time is noise or
    none is, all samples count. A deviation of 0 counts as 1000. The driver gets one row a channel and round.
    """
    import math

    n = min(length, max_length)
    samples = to_samples(blocks.filter(F.col("t0") <= n)).filter(F.col("t") <= n)
    quiet, before = samples, {}
    for _ in range(rounds):
        got = {r["channel"]: (r["s"], r["n"]) for r in quiet.groupBy("channel").agg(F.stddev_samp("v").alias("s"), F.count("*").alias("n")).collect()}
        if not got or max(k for _, k in got.values()) < 0.05 * n:
            quiet = samples
            break
        now = {c: 1000.0 if s is None or s <= 10 * 2.220446049250313e-16 else s for c, (s, _) in got.items()}
        if all(math.isclose(now[c], before.get(c, 0.0), rel_tol=1e-12) or now[c] == 1000.0 for c in now):
            quiet = samples
            break
        before = now
        bound = F.element_at(F.create_map(*[F.lit(x) for c, s in now.items() for x in (c, s * threshold)]), F.col("channel"))
        loud = samples.filter(F.abs("v") >= bound).select("t").distinct()
        quiet = samples.join(loud, "t", "left_anti")
    middle = quiet.groupBy("channel").agg(F.median("v").alias("m"))
    sigma = 1.4826 * F.median(F.abs(F.col("v") - F.col("m")))
    found = quiet.join(middle, "channel").groupBy("channel").agg(sigma.alias("sigma"))
    return found.withColumn("sigma", F.when(F.col("sigma") <= 10 * 2.220446049250313e-16, 1000.0).otherwise(F.col("sigma")))


def detect(blocks: DataFrame, sigma: DataFrame, length: int, threshold: float = 3.5, min_dist: int = 20, energy: Callable = lambda x: -x, height: Callable = lambda x: -x) -> DataFrame:
    """channel, t, amp (the signed sample): peaks of the energy above threshold * sigma, of neighbours closer than
    min_dist the higher. The energy is minus the signal or any function, given for numpy arrays and for columns."""

    def one(x, t0):
        import numpy as np

        e = energy(x)
        t = t0 + np.arange(len(x) - 2)
        top = (e[1:-1] >= e[:-2]) & (e[1:-1] >= e[2:]) & (t > 1) & (t < length)
        return np.where(top, x[1:-1], np.nan)

    found = to_samples(map_blocks(blocks, 1, 1, one)).filter(~F.isnan("v")).withColumnRenamed("v", "amp")
    bound = F.create_map(*[F.lit(x) for r in sigma.collect() for x in (r["channel"], float(r["sigma"]) * threshold)])  # one row a channel
    # few samples are above the bound; they are read several times below, the signal once
    high = settle(found.withColumn("v", height(F.col("amp"))).filter(F.col("v") > F.element_at(bound, F.col("channel"))))
    kept = walks.suppress_peaks(high.select("channel", "t", "v"), min_dist, float("-inf"))
    return kept.join(high.select("channel", "t", "amp"), ["channel", "t"]).select("channel", "t", "amp")


def detect_and_merge(blocks: DataFrame, sigma: DataFrame, length: int, threshold: float = 3.5, min_dist: int = 20, merge_dist: int = 10) -> DataFrame:
    """t, amp, channel: detections of all channels, one for each group close in time."""
    return walks.merge_detections(detect(blocks, sigma, length, threshold, min_dist), merge_dist)


# correlation


def lagged_products(a, z, max_lag: int):
    """Products (channel, channel, lag) of rows a (channels x n) with rows z (channels x n + max_lag) moved by each lag:
    one product of matrices a lag, or, for many lags, one of spectra."""
    import numpy as np

    n = a.shape[1]
    if max_lag < DIRECT:
        return np.stack([a @ z[:, lag : lag + n].T for lag in range(max_lag + 1)], axis=2)
    width = 1 << (n + max_lag - 1).bit_length()
    left, right = np.conj(np.fft.rfft(a, width)), np.fft.rfft(z, width)
    return np.stack([np.fft.irfft(x[None, :] * right, width)[:, : max_lag + 1] for x in left])


def _product_rows(total: dict):
    """An Arrow batch c1, c2, lag, xc of sums by pair of channels."""
    import numpy as np
    import pyarrow as pa

    pairs, sums = list(total), np.stack(list(total.values()))
    c1, c2 = (np.repeat([p[k] for p in pairs], sums.shape[1]) for k in (0, 1))
    lag = np.tile(np.arange(sums.shape[1]), len(pairs))
    return pa.RecordBatch.from_arrays([pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(lag, pa.int64()), pa.array(sums.ravel(), pa.float64())], names=["c1", "c2", "lag", "xc"])


def xcorr(blocks: DataFrame, max_lag: int, means: dict | None = None, size: int | None = None) -> DataFrame:
    """c1, c2, lag, xc: sum over t of c1 at t times c2 at t + lag, 0 <= lag <= max_lag, c1 <= c2; the channels of a block
    meet in one task. With `means` channels are centred first. Lags may exceed a block if the blocks' `size` is given."""
    wide = with_halo(blocks, 0, max_lag, size).groupBy("block").agg(F.collect_list(F.struct("channel", "v", "after")).alias("rows"))
    taken = means or {}

    def run(batches):
        import numpy as np

        total: dict = {}
        for b in pieces(batches, 16):
            for rows in b.column(0).to_pylist():
                rows = sorted(rows, key=lambda r: r["channel"])
                own = [np.array(r["v"]) - taken.get(r["channel"], 0.0) for r in rows]
                more = [np.concatenate((x, np.array(r["after"]) - taken.get(r["channel"], 0.0), np.zeros(max_lag - len(r["after"])))) for x, r in zip(own, rows, strict=True)]
                m = lagged_products(np.stack(own), np.stack(more), max_lag)
                for i, r in enumerate(rows):
                    for j in range(i, len(rows)):
                        key = (r["channel"], rows[j]["channel"])
                        total[key] = total[key] + m[i, j] if key in total else m[i, j]
        if total:
            yield _product_rows(total)

    parts = wide.select("rows").mapInArrow(run, "c1 int, c2 int, lag long, xc double")
    return parts.groupBy("c1", "c2", "lag").agg(F.sum("xc").alias("xc"))


#: Samples that a covariance takes at most, but for the end of its last epoch, and of one epoch.
MAX_SAMPLES = 100_000


def used_epochs(signal: DataFrame, epochs: DataFrame, max_lag: int, max_samples: int = MAX_SAMPLES, max_per_epoch: int = MAX_SAMPLES, order: list | None = None) -> DataFrame:
    """s, e, n of the noise epochs (s, e) that a covariance is taken from.

    Epochs shorter than max_lag are left out; without any other the first max_samples of the recording are one epoch.
    They are taken by start, or in the given order, up to the first with which they exceed max_samples; those longer
    than max_per_epoch are then trimmed evenly. As each taken epoch has max_lag samples, their number is bounded: only
    so many are put in order.
    """
    from pyspark.sql import Window

    from .intervals import make_max_len

    fit = epochs.select("s", "e", *[(F.col(x) if isinstance(x, str) else x).alias(f"_o{k}") for k, x in enumerate(order or [])]).withColumn("n", F.col("e") - F.col("s") + 1).filter(F.col("n") >= max(1, max_lag))
    by = ["s", "e"] if order is None else [f"_o{k}" for k in range(len(order))]
    if not fit.take(1):
        end = F.when(F.max("t").isNotNull(), F.least(F.lit(max_samples).cast("long"), F.max("t")))
        fit, by = signal.agg(F.lit(1).cast("long").alias("s"), end.alias("e")).filter("e IS NOT NULL").withColumn("n", F.col("e")), ["s", "e"]
    front = fit.orderBy(*by).limit(max_samples // max(1, max_lag) + 2)
    before = F.coalesce(F.sum("n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = front.withColumn("before", before).filter(F.col("before") <= max_samples)
    return make_max_len(taken.select("s", "e"), max_per_epoch).select(F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).withColumn("n", F.col("e") - F.col("s") + 1)


def epoch_xcorr(signal: DataFrame, epochs: DataFrame, max_lag: int, max_samples: int = MAX_SAMPLES, positions: dict | None = None, max_dist: float | None = None, order: list | None = None, max_per_epoch: int = MAX_SAMPLES) -> DataFrame:
    """c1, c2, lag, cov: products within noise epochs (s, e), by the samples used; lags without a pair of samples are
    left out. Which epochs are used: used_epochs(). Pairs of channels further apart than max_dist are left out.

    An epoch's samples meet in one task, max_per_epoch of each channel at most.
    """
    used = used_epochs(signal, epochs, max_lag, max_samples, max_per_epoch, order)
    times = used.select(F.col("s").alias("epoch"), "n", F.explode(F.sequence("s", "e")).alias("t"))
    # max_samples + max_per_epoch times at most
    inside = signal.join(F.broadcast(times), "t")
    held = inside.groupBy("epoch", "n").agg(F.collect_list(F.struct("channel", (F.col("t") - F.col("epoch")).alias("k"), "v")).alias("rows"))

    def run(batches):
        import numpy as np

        total: dict = {}
        for b in pieces(batches, 16):
            for n, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names = sorted({r["channel"] for r in rows})
                place = {c: k for k, c in enumerate(names)}
                x, known = np.zeros((2, len(names), n + max_lag))
                c, k = np.array([place[r["channel"]] for r in rows]), np.array([r["k"] for r in rows])
                x[c, k], known[c, k] = [r["v"] for r in rows], 1.0
                m, pairs = lagged_products(x[:, :n], x, max_lag), lagged_products(known[:, :n], known, max_lag)
                m = np.stack((m, pairs))
                for i in range(len(names)):
                    for j in range(i, len(names)):
                        key = (names[i], names[j])
                        total[key] = total[key] + m[:, i, j] if key in total else m[:, i, j]
        if total:
            rows, counts = _product_rows({k: v[0] for k, v in total.items()}), _product_rows({k: v[1] for k, v in total.items()})
            yield rows.append_column("pairs", counts.column(3))

    parts = held.select("n", "rows").mapInArrow(run, "c1 int, c2 int, lag long, xc double, pairs double")
    sums = parts.groupBy("c1", "c2", "lag").agg(F.sum("xc").alias("xc"), F.sum("pairs").alias("pairs")).filter("pairs > 0.5")
    if positions is not None and max_dist is not None:
        near = F.create_map(*[F.lit(x) for c, p in positions.items() for x in (c, F.array(*map(F.lit, p)))])
        gap = F.sqrt(sum((near[F.col("c1")][k] - near[F.col("c2")][k]) ** 2 for k in range(len(next(iter(positions.values()))))))
        sums = sums.filter(gap <= max_dist)
    total = used.agg(F.sum("n").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("c1", "c2", "lag", (F.col("xc") / F.col("total")).alias("cov"))


def noise_epochs(events: DataFrame, length: int, margin: int = 50) -> DataFrame:
    """s, e: what events (t) with `margin` samples on each side leave of a recording; stretches of one sample are
    dropped but at the end. Runs of events are told apart in cells of time, so no task holds them all."""
    runs = walks.islands(events.select("t").distinct(), [], "t", 2 * margin + 1, [])
    blank = runs.groupBy("island").agg((F.min("t") - margin).alias("s"), (F.max("t") + margin).alias("e"))
    cell = 1 << 16
    from pyspark.sql import Window

    marked = blank.select("s", "e", F.floor(F.col("s") / cell).alias("_cell"))
    ends = marked.groupBy("_cell").agg(F.max("e").alias("_last"))
    ends = ends.select("_cell", F.lag("_last").over(Window.orderBy("_cell")).alias("_carry"))  # one row a cell
    gaps = marked.join(ends, "_cell").withColumn("_p", F.coalesce(F.lag("e").over(Window.partitionBy("_cell").orderBy("s")), "_carry", F.lit(0)))
    inner = gaps.select((F.col("_p") + 1).alias("s"), (F.col("s") - 1).alias("e")).filter("e - s >= 1")
    tail = blank.agg(F.coalesce(F.max("e"), F.lit(0)).alias("e")).select((F.col("e") + 1).alias("s"), F.lit(length).cast("long").alias("e")).filter("s <= e")
    return inner.unionByName(tail)


def estimate_covariance(signal: DataFrame, sigma: DataFrame, length: int, max_lag: int = 79, max_samples: int = 150_000, positions: dict | None = None, max_dist: float | None = 40.0, threshold: float = 3.5, min_dist: int = 20, margin: int = 50, size: int = SIZE) -> DataFrame:
    """c1, c2, lag, cov of the noise of a recording: spikes are detected on all channels and blanked, and what is left
    between them is correlated. sigma: one row a channel, as for detect()."""
    # events and epochs are read several times below
    events = settle(detect(to_blocks(signal, length, size), sigma, length, threshold, min_dist))
    epochs = settle(noise_epochs(events, length, margin))
    remove(events)
    return epoch_xcorr(signal, epochs, max_lag, max_samples, positions, max_dist)


def mirrored(cov: DataFrame) -> DataFrame:
    """Covariances of all ordered pairs and signed lags: cov(c2, c1, -lag) = cov(c1, c2, lag)."""
    back = cov.filter("NOT (c1 = c2 AND lag = 0)").select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), (-F.col("lag")).alias("lag"), "cov")
    return cov.select("c1", "c2", "lag", "cov").unionByName(back)


def embedded(cov: DataFrame, channels: int, tf: int, embedding: str = "time") -> DataFrame:
    """row, col, value of the covariance of vectors of tf samples a channel: time embedding (c1t1 c1t2 ..) or channel
    embedding (c1t1 c2t1 ..). Channels count from 0; lags up to tf - 1 have to be known."""
    place = (lambda c, k: c * tf + k) if embedding == "time" else (lambda c, k: k * channels + c)
    steps = F.explode(F.sequence(F.greatest(F.lit(0), -F.col("lag")), F.least(F.lit(tf - 1), F.lit(tf - 1) - F.col("lag"))))
    near = mirrored(cov).filter(F.abs("lag") < tf).withColumn("k", steps)
    return near.select(place(F.col("c1"), F.col("k")).cast("long").alias("row"), place(F.col("c2"), F.col("k") + F.col("lag")).cast("long").alias("col"), F.col("cov").alias("value"))


def dense(matrix: DataFrame, n: int):
    """(row, col, value) as an n x n array: the size of a template squared, not of the recording."""
    import numpy as np

    out = np.zeros((n, n))
    for r in matrix.filter((F.col("row") < n) & (F.col("col") < n)).collect():
        out[r["row"], r["col"]] = r["value"]
    return out


def loaded(c, share: float = 0.1):
    """Covariance with `share` of its mean variance added on the diagonal, halved."""
    import numpy as np

    return (c + share * np.mean(np.diag(c)) * np.eye(len(c))) / 2


def apply_matrix(waves: DataFrame, matrix, per_channel: int | None = None) -> DataFrame:
    """Waveforms (.., v) with v replaced by matrix @ v, or, with the number of channels, by the matrix on each channel."""
    import numpy as np

    m = np.asarray(matrix, float)
    names = [c for c in waves.columns if c != "v"]

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches, 2048):
            x = np.stack(vectors(b.column("v")))
            y = x @ m.T if per_channel is None else (x.reshape(len(x), per_channel, -1) @ m.T).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(list(y), pa.list_(pa.float64()))], names=[*names, "v"])

    types = ", ".join(f"`{c}` {waves.schema[c].dataType.simpleString()}" for c in names)
    return waves.select(*names, "v").mapInArrow(run, f"{types}, v array<double>")


def whiten(waves: DataFrame, c) -> DataFrame:
    """Waveforms divided by the upper Cholesky factor of the loaded covariance."""
    import numpy as np

    upper = np.linalg.cholesky(loaded(np.asarray(c))).T
    return apply_matrix(waves, np.linalg.inv(upper).T)


def solve(waves: DataFrame, c) -> DataFrame:
    """Waveforms times the inverse of a covariance matrix."""
    import numpy as np

    return apply_matrix(waves, np.linalg.inv(np.asarray(c)))


def lag_blocks(cov: DataFrame, channels: int, tf: int):
    """Array (tf, channels, channels) of covariances c1, c2, lag, cov: entry [k, i, j] of channel i at t and j at t + k."""
    import numpy as np

    out = np.zeros((tf, channels, channels))
    for r in mirrored(cov).filter(F.col("lag").between(0, tf - 1)).collect():  # channels**2 * tf numbers
        out[r["lag"], r["c1"], r["c2"]] = r["cov"]
    return out


def toeplitz_solve(blocks, rhs):
    """x with T x = rhs (rows of rhs: vectors in channel embedding), T the symmetric matrix of tf x tf blocks with
    blocks[j - i] in row i, column j, its transpose below. A forward and a backward predictor grow by one block at a
    time (Whittle); T is never formed: tf**2 * channels**3 steps, tf * channels numbers of a predictor."""
    import numpy as np

    blocks = np.asarray(blocks, float)
    tf, c, _ = blocks.shape
    b = np.asarray(rhs, float).reshape(-1, tf, c).transpose(1, 2, 0)
    ahead, back = np.eye(c)[None], np.eye(c)[None]
    v_ahead = v_back = blocks[0]
    x = np.linalg.solve(blocks[0], b[0])[None]
    for n in range(1, tf):
        row = blocks[n:0:-1].transpose(0, 2, 1)  # blocks of the new last row, before the diagonal
        ef = np.einsum("kij,kjl->il", row, ahead)
        eb = np.einsum("kij,kjl->il", blocks[1 : n + 1], back)
        zero = np.zeros((1, c, c))
        longer, moved = np.concatenate((ahead, zero)), np.concatenate((zero, back))
        to_back, to_ahead = np.linalg.solve(v_back, ef), np.linalg.solve(v_ahead, eb)
        ahead, back = longer - moved @ to_back, moved - longer @ to_ahead
        v_ahead, v_back = v_ahead - eb @ to_back, v_back - ef @ to_ahead
        rest = b[n] - np.einsum("kij,kjm->im", row, x)
        x = np.concatenate((x, np.zeros((1, *x.shape[1:])))) + back @ np.linalg.solve(v_back, rest)
    return x.transpose(2, 0, 1).reshape(len(np.atleast_2d(rhs)), tf * c)


def solve_lags(waves: DataFrame, blocks) -> DataFrame:
    """Waveforms (.., v; time embedding) times the inverse of the covariance with these lag blocks."""
    import numpy as np

    blocks = np.asarray(blocks, float)
    tf, channels, _ = blocks.shape
    names = [c for c in waves.columns if c != "v"]

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches, 2048):
            x = np.stack(vectors(b.column("v"))).reshape(-1, channels, tf).transpose(0, 2, 1).reshape(-1, tf * channels)
            y = toeplitz_solve(blocks, x).reshape(-1, tf, channels).transpose(0, 2, 1).reshape(-1, tf * channels) if len(x) else x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(list(y), pa.list_(pa.float64()))], names=[*names, "v"])

    types = ", ".join(f"`{c}` {waves.schema[c].dataType.simpleString()}" for c in names)
    return waves.select(*names, "v").mapInArrow(run, f"{types}, v array<double>")


# resampling and sub-sample shifts: matrices on each channel


def resample_matrix(tf: int, up: int, down: int, keep_tail: bool = False, width: int = 10):
    """Rows of a Hann-windowed sinc at steps of down / up samples; without keep_tail the last up - 1 are cut."""
    import numpy as np

    n = -(-tf * up // down) - (0 if keep_tail else up - 1)
    cut = min(1.0, up / down)
    x = np.arange(n)[:, None] * (down / up) - np.arange(tf)[None, :]
    window = np.where(np.abs(x) <= width, 0.5 + 0.5 * np.cos(np.pi * np.clip(x / width, -1, 1)), 0.0)
    return cut * np.sinc(cut * x) * window


def sinc_shift_matrix(tf: int, tau: float):
    """Rows of a sinc that moves right by tau samples, each of norm 1; |tau| <= 0.001 changes nothing."""
    import numpy as np

    if abs(tau) <= 0.001:
        return np.eye(tf)
    m = np.sinc(np.arange(tf)[:, None] - np.arange(tf)[None, :] - tau)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def subsample_versions(templates: DataFrame, channels: int, tf: int, upsample: int) -> DataFrame:
    """unit, sub, v: each template moved by sub / upsample samples, the first as it is."""
    out = None
    for k in range(upsample):
        one = apply_matrix(templates.select("unit", "v"), sinc_shift_matrix(tf, k / upsample), channels).select("unit", F.lit(k).cast("long").alias("sub"), "v")
        out = one if out is None else out.unionByName(one)
    return out
