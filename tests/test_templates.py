"""Sub-sample alignment and extremes, expected errors, matched blocks of electrodes, surfaces, moments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltframe.functions import arrays as A
from voltframe.operators import blocks as B
from voltframe.operators import fits as L
from voltframe.operators import matrices as M
from voltframe.operators import templates as P


def test_planted_fractional_shifts_are_found(spark):
    draw = np.random.default_rng(0)
    tf, t = 40, np.arange(40)
    template = np.stack([-np.exp(-((t - 18) ** 2) / 8), 0.5 * np.exp(-((t - 22) ** 2) / 18)])
    taus = draw.uniform(-4, 4, 60)
    waves = []
    for k, tau in enumerate(taus):
        moved = np.stack([-np.exp(-((t - 18 + tau) ** 2) / 8), 0.5 * np.exp(-((t - 22 + tau) ** 2) / 18)])
        waves.append((k, 1, (moved + draw.normal(0, 0.01, moved.shape)).ravel().tolist()))
    w = spark.createDataFrame(waves, "wf_id long, unit int, v array<double>")
    ts = spark.createDataFrame([(1, template.ravel().tolist())], "unit int, v array<double>")
    for r in P.align_on_template(w, ts, 2, tf).collect():
        assert abs(r["tau"] - taus[r["wf_id"]]) < 0.1
        assert np.allclose(r["v"], (B.sinc_shift_matrix(tf, r["tau"]) @ np.reshape(waves[r["wf_id"]][2], (2, tf)).T).T.ravel())
        assert np.abs(np.reshape(r["v"], (2, tf)) - template)[:, 8:32].max() < 0.1


def test_parabola_through_three_samples(spark):
    rows = [([3.0, 1.0, 2.0],), ([1.0, 2.0, 3.0],), ([2.0, 2.0, 2.0],), ([5.0, (0.3) ** 2, (0.7) ** 2, 9.0],), ([4.0, 1.0, 1.0, 4.0],), ([7.0],)]
    got = [tuple(r["x"]) for r in spark.createDataFrame(rows, "v array<double>").coalesce(1).select(A.lowest_between(F.col("v")).alias("x")).collect()]
    want = []
    for (v,) in rows:
        i = int(np.argmin(v))
        if 0 < i < len(v) - 1 and v[i - 1] - 2 * v[i] + v[i + 1] > 0:
            p = np.polyfit([-1, 0, 1], v[i - 1 : i + 2], 2)
            want.append((i - p[1] / (2 * p[0]), np.polyval(p, -p[1] / (2 * p[0]))))
        else:
            want.append((i, v[i]))
    assert np.allclose(got, want)


@pytest.mark.parametrize("shift", [0, 4])
def test_expected_errors_by_brute_force(spark, shift):
    draw = np.random.default_rng(3)
    t = {u: draw.normal(size=(2, 9)) for u in (3, 1, 7)}
    t[9] = np.roll(t[1], 2, 1)
    t[9][:, :2] = 0
    prior = 0.1
    df = spark.createDataFrame([(u, v.ravel().tolist()) for u, v in t.items()], "unit int, v array<double>")
    got = {(r["u1"], r["u2"]): r["error"] for r in P.quality_of_set(df, prior, 2, shift).collect()}
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    every = [(-1, np.zeros((2, 9)), 1 - 4 * prior), *((u, t[u], prior) for u in sorted(t))]
    assert len(got) == 10
    for i, (u, a, p) in enumerate(every):
        for w, b, q in every[i + 1 :]:
            choices = []
            for s in range(-shift, shift + 1):
                m = np.zeros_like(b)
                for k in range(9):
                    if 0 <= k - s < 9:
                        m[:, k] = b[:, k - s]
                choices.append((round(float(np.linalg.norm(a - m)), 9), abs(s), s, m))
            m = min(choices, key=lambda c: c[:3])[3]
            d = np.linalg.norm(a - m)
            if d < 1e-6:
                assert got[u, w] == pytest.approx(min(p, q))
                continue
            thr = (-math.log(p / q) + 0.5 * ((a * a).sum() - (m * m).sum())) / d
            e = p * cdf(thr - (a * (a - m)).sum() / d) + q * (1 - cdf(thr - (m * (a - m)).sum() / d))
            assert got[u, w] == pytest.approx(e, abs=1e-12)
    total = P.total_quality(P.quality_of_set(df, prior, 2, shift)).first()
    assert total["q"] == pytest.approx(sum(got.values())) and total["q_mean"] == pytest.approx(sum(got.values()) / 10)


def test_blocks_of_electrodes_are_matched_place_by_place(spark):
    """Two blocks of 10 x 10 at a pitch of 17.5, the second from place 31 on; a variant lacks twelve electrodes."""
    grid = [(b * 100 + x * 10 + y, (x + 30 * b) * 17.5, y * 17.5) for b in range(2) for x in range(10) for y in range(10)]
    full = P.matching_blocks(spark.createDataFrame(grid, "electrode int, x double, y double")).collect()
    assert sorted((r["electrode_1"], r["electrode_2"]) for r in full) == [(k, k + 100) for k in range(100)]
    assert all((r["rank_x"], r["rank_y"]) == (r["electrode_1"] // 10 + 1, r["electrode_1"] % 10 + 1) for r in full)
    dead = {3, 17, 40, 41, 77, 90, 100, 117, 133, 162, 188, 199}
    some = P.matching_blocks(spark.createDataFrame([r for r in grid if r[0] not in dead], "electrode int, x double, y double")).collect()
    assert sorted((r["electrode_1"], r["electrode_2"]) for r in some) == [(k, k + 100) for k in range(100) if k not in dead and k + 100 not in dead]
    assert P.matching_blocks(spark.createDataFrame([], "electrode int, x double, y double")).count() == 0


def test_receptive_fields_recover_centre_axes_and_signs(spark):
    x, y = (z.ravel() for z in np.meshgrid(np.arange(24.0), np.arange(20.0)))
    planted = {1: ((11.3, 8.7), 6.0, 2.5, 0.5, 3.0, 90.0, 60.0), 2: ((9.0, 12.2), 5.0, 9.0, 0.2, 4.0, -120.0, -50.0)}
    rows = []
    for u, (mu, one, two, angle, ratio, a, b) in planted.items():
        mid, wide = L.surface((*mu, np.log(one), np.log(two / one), angle, np.log(ratio)), x, y)
        z = a * mid - b * wide
        rows += [(u, float(p), float(q), float(v) + 2.0) for p, q, v in zip(x, y, z - np.median(z), strict=True)]
    rows += [(3, float(p), float(q), 1.0) for p, q in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "unit int, x double, y double, z double")
    got = {r["unit"]: r for r in L.fit_surfaces(df, "unit").collect()}
    for u, (mu, one, two, angle, _, a, b) in planted.items():
        r, turn = got[u], np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        c = turn @ np.diag([one, two]) @ turn.T
        assert np.allclose((r["x"], r["y"]), mu, atol=0.1)
        assert np.allclose((r["cxx"], r["cxy"], r["cyy"]), (c[0, 0], c[0, 1], c[1, 1]), rtol=0.2, atol=0.2)
        assert np.sign(r["a"]) == np.sign(a) and np.sign(r["b"]) == np.sign(b) and r["ratio"] > 1.5
    assert got[3]["x"] is None and got[3]["base"] == 1.0 and got[3]["residual"] == 0.0
    one = L.fit_surfaces(df.filter("unit = 1"), "unit", "gaussian").first()
    assert np.allclose((one["x"], one["y"]), planted[1][0], atol=0.3) and one["a"] > 0 and one["b"] is None


def test_components_of_data_far_from_zero(spark):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(400, 3)) @ np.diag([3.0, 1.0, 0.1]) + 1e8
    waves = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "wf_id long, v array<double>")
    got = np.array([(r["pc1"], r["pc2"]) for r in M.principal_components(waves, 2).orderBy("wf_id").collect()])
    y = x - x.mean(0)
    want = y @ np.linalg.svd(y, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-3)
