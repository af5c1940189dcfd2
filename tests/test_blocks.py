"""Blocks: assembly, halos wider than a block, filters and correlations by spectra, covariances and their solver."""

import numpy as np
import pytest

from voltframe.operators import blocks as B
from voltframe.operators import matrices as M


def _signal(spark, x):
    """x: channels x samples; NaN where there is no sample."""
    rows = [(c, t + 1, float(v)) for c, row in enumerate(x) for t, v in enumerate(row) if not np.isnan(v)]
    return spark.createDataFrame(rows, "channel int, t long, v double")


def _dense(samples, channels, n):
    out = np.zeros((channels, n))
    for r in samples.collect():
        out[r["channel"], r["t"] - 1] = r["v"]
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 4096])
def test_blocks_hold_every_sample_and_fill_gaps(spark, size):
    x = np.random.default_rng(0).normal(size=(3, 150))
    x[0, :20] = x[1, 60:90] = x[2, 100:] = np.nan
    x[1, 93] = np.nan
    b = B.to_blocks(_signal(spark, x), 160, size).collect()
    assert len(b) == 3 * -(-160 // size)
    for r in b:
        t = np.arange(r["t0"], min(r["t0"] + size, 161)) - 1
        assert r["t0"] == r["block"] * size + 1
        whole = np.concatenate((np.nan_to_num(x[r["channel"]]), np.zeros(10)))
        assert r["v"] == whole[t].tolist()


def test_two_samples_at_one_time_are_an_error(spark):
    s = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (0, 2, 2.0), (0, 4, 1.0)], "channel int, t long, v double")
    with pytest.raises(Exception, match="two samples"):
        B.to_blocks(s, 4, 4).collect()


@pytest.mark.parametrize("n_taps", [5, 111, 251])
@pytest.mark.parametrize("size", [32, 300])
def test_long_filters_equal_direct_convolution(spark, n_taps, size):
    draw = np.random.default_rng(n_taps)
    x, taps = draw.normal(size=(2, 700)), draw.normal(size=n_taps)
    b = B.to_blocks(_signal(spark, x), 700, size)
    got = _dense(B.to_samples(B.fir(b, taps.tolist(), 700, False, size)), 2, 700)
    assert np.allclose(got, [np.convolve(r, taps)[n_taps // 2 : n_taps // 2 + 700] for r in x])
    edge = _dense(B.to_samples(B.fir(b, taps.tolist(), 700, True, size)), 2, 700)
    assert (edge[:, : n_taps - 1] == 0).all() and (edge[:, 700 - n_taps + 1 :] == 0).all()
    assert np.allclose(edge[:, n_taps - 1 : 700 - n_taps + 1], got[:, n_taps - 1 : 700 - n_taps + 1])


def test_overlap_save_in_many_stretches():
    draw = np.random.default_rng(1)
    for n, k in ((64, 64), (65, 64), (5000, 251), (1024, 65), (3, 70)):
        x, taps = draw.normal(size=n), draw.normal(size=k)
        want = np.convolve(x, taps, "valid") if n >= k else []
        assert np.allclose(B.convolve_valid(x, taps), want)


@pytest.mark.parametrize("lag", [3, 100])
def test_correlation_over_several_blocks(spark, lag):
    x = np.random.default_rng(lag).normal(size=(3, 400))
    got = {(r["c1"], r["c2"], r["lag"]): r["xc"] for r in B.xcorr(B.to_blocks(_signal(spark, x), 400, 32), lag, size=32).collect()}
    want = {(i, j, k): float(x[i, : 400 - k] @ x[j, k:]) for i in range(3) for j in range(i, 3) for k in range(lag + 1)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_epochs_up_to_the_first_that_exceeds_the_bound(spark):
    x = _signal(spark, np.ones((1, 100)))
    epochs = spark.createDataFrame([(1, 10), (11, 20), (21, 30), (31, 33), (41, 60)], "s long, e long")
    used = lambda **k: [(r["s"], r["e"]) for r in B.used_epochs(x, epochs, 5, **k).orderBy("s").collect()]
    assert used(max_samples=19) == [(1, 10), (11, 20)]
    assert used(max_samples=20) == [(1, 10), (11, 20), (21, 30)]  # a total equal to the bound does not exceed it
    assert used(max_samples=1000, max_per_epoch=7) == [(3, 9), (13, 19), (23, 29), (48, 54)]
    none = spark.createDataFrame([(1, 3)], "s long, e long")
    assert [tuple(r) for r in B.used_epochs(x, none, 5, 40).collect()] == [(1, 40, 40)]
    assert [tuple(r) for r in B.used_epochs(x, none, 5, 400).collect()] == [(1, 100, 100)]
    assert B.used_epochs(x.limit(0), none, 5).count() == 0


@pytest.mark.parametrize("lag", [4, 70])
def test_epoch_covariance(spark, lag):
    x = np.random.default_rng(2).normal(size=(2, 500))
    x[0, 30] = np.nan
    epochs = [(5, 104), (200, 290), (300, 320), (400, 480)]
    got = {(r["c1"], r["c2"], r["lag"]): r["cov"] for r in B.epoch_xcorr(_signal(spark, x), spark.createDataFrame(epochs, "s long, e long"), lag).collect()}
    used = [(s, e) for s, e in epochs if e - s + 1 >= lag]
    n, want = sum(e - s + 1 for s, e in used), {}
    y = np.nan_to_num(x)
    for i in range(2):
        for j in range(i, 2):
            for k in range(lag + 1):
                want[i, j, k] = sum(float(y[i, s - 1 : e - k] @ y[j, s - 1 + k : e]) for s, e in used) / n
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_noise_between_events(spark):
    draw = np.random.default_rng(4)
    for times, n in ((draw.integers(1, 200_000, 300), 200_000), ([], 50), ([1, 2, 3], 60), ([60], 60), ([150_000], 400_000)):
        quiet = np.ones(n + 2, bool)
        for t in times:
            quiet[max(0, t - 20) : t + 21] = False
        quiet[0] = quiet[n + 1] = False
        edge = np.flatnonzero(np.diff(quiet.astype(int)))
        runs = [(int(a) + 1, int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        want = [r for r in runs if r[1] > r[0] or r[1] == n]
        got = B.noise_epochs(spark.createDataFrame([(int(t),) for t in times], "t long"), n, 20)
        assert sorted((r["s"], r["e"]) for r in got.collect()) == want


def test_block_toeplitz_solver():
    draw = np.random.default_rng(6)
    for tf, c in ((1, 1), (2, 3), (16, 4), (40, 2)):
        # a moving-average process has a positive definite covariance
        w = draw.normal(size=(5, c, c))
        lags = np.array([sum(w[k].T @ w[k + lag] for k in range(5 - lag)) if lag < 5 else np.zeros((c, c)) for lag in range(tf)])
        lags[0] += 0.5 * np.eye(c)
        whole = np.block([[lags[j - i] if j >= i else lags[i - j].T for j in range(tf)] for i in range(tf)])
        rhs = draw.normal(size=(7, tf * c))
        assert np.allclose(B.toeplitz_solve(lags, rhs), np.linalg.solve(whole, rhs.T).T)


def test_covariance_with_spikes_blanked(spark):
    """Noise of variance 1 under spikes of -40: with blanking the variance is that of the noise; solving undoes it."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(2, 3000))
    x[:, 100:2900:140] -= 40
    s = _signal(spark, x)
    cov = B.estimate_covariance(s, M.mad(s), 3000, max_lag=3, margin=10, threshold=8.0, min_dist=5, max_dist=None)
    lags = B.lag_blocks(cov, 2, 4)
    assert np.allclose(np.diag(lags[0]), 1, atol=0.15) and abs(lags[0][0, 1]) < 0.15
    waves = spark.createDataFrame([(k, draw.normal(size=8).tolist()) for k in range(5)], "wf_id long, v array<double>")
    dense = B.dense(B.embedded(cov, 2, 4), 8)
    for a, b in zip(waves.collect(), B.solve_lags(waves, lags).collect(), strict=True):
        assert a["wf_id"] == b["wf_id"] and np.allclose(b["v"], np.linalg.solve(dense, a["v"]))
