"""Every waveform gets a cluster; clusters over tiles and cells are those of brute force."""

import numpy as np
import pytest

from voltframe.operators import clusters
from voltframe.plans import registry
from voltframe.sources import tables

SF = "/root/testdata/sf0.01"


def test_clu_01_covers_all_waveforms(spark):
    got = registry.QUERIES["clu_01"](spark, SF)
    assert got.count() == tables.waveforms(spark, SF).count() == got.select("id").distinct().count()


def _brute(x, bandwidth):
    """Every point's end by itself, ends to a hundredth in the order of points, clusters by size."""
    ends = []
    for p in x:
        while True:
            q = x[((x - p) ** 2).sum(1) <= bandwidth**2].mean(0)
            stop = np.abs(q - p).max() < 1e-3 * bandwidth
            p = q
            if stop:
                break
        ends.append(p)
    firsts, own = {}, []
    heads, of = [], []
    for p in ends:
        key = tuple(np.floor(p / (bandwidth * 0.01) + 0.5).astype(int))
        if key not in firsts:
            d = [((p - h) ** 2).sum() for h in heads]
            if d and min(d) < (bandwidth / 2) ** 2:
                firsts[key] = of[int(np.argmin(d))]
            else:
                firsts[key] = len(set(of))
                heads.append(p)
                of.append(firsts[key])
        own.append(firsts[key])
    size = np.bincount(own)
    rank = {c: k for k, c in enumerate(sorted(range(len(size)), key=lambda c: (-size[c], c)), 1)}
    return [rank[c] for c in own]


@pytest.mark.parametrize("tile,seeds", [(1, 7), (2, 50), (8, 20_000)])
def test_mean_shift_over_tiles_equals_every_point_by_itself(spark, monkeypatch, tile, seeds):
    monkeypatch.setattr(clusters, "TILE", tile)
    monkeypatch.setattr(clusters, "SEEDS", seeds)
    draw = np.random.default_rng(5)
    groups = {0: np.concatenate([draw.normal(c, 0.6, (70, 2)) for c in ((1, 1), (-6, -1), (4, -7))] + [draw.uniform(-20, 20, (9, 2))]), 3: draw.normal(0, 1, (40, 2)), 4: draw.normal(5, 0.1, (1, 2))}
    rows = [(g, k, x.tolist()) for g, xs in groups.items() for k, x in enumerate(xs)]
    points = spark.createDataFrame(rows, "leg int, id long, x array<double>").repartition(3)
    got = {(r["leg"], r["id"]): r["cluster"] for r in clusters.mean_shift(points, 1.5).collect()}
    assert got == {(g, k): c for g, xs in groups.items() for k, c in enumerate(_brute(xs, 1.5))}
    assert len({c for (g, _), c in got.items() if g == 0}) >= 4


def test_neighbours_by_cell():
    draw = np.random.default_rng(6)
    for dims in (1, 2, 5):
        x = draw.normal(0, 2, (300, dims))
        cells = clusters.Cells(x, 0.7)
        for p in draw.normal(0, 2, (30, dims)):
            for radius in (0.7, 1.9):
                near = set(cells.near(p, radius).tolist())
                assert near >= set(np.flatnonzero(((x - p) ** 2).sum(1) <= radius**2).tolist())


def test_a_step_costs_neighbours():
    """At a fixed density the pools looked at do not grow with the number of points."""
    draw = np.random.default_rng(7)
    sizes = []
    for n in (1000, 16000):
        x = draw.uniform(0, np.sqrt(n), (n, 2))
        cells = clusters.Cells(x, 1.0)
        sizes.append(np.mean([len(cells.near(p, 1.0)) for p in x[:300]]))
    assert sizes[1] < 1.3 * sizes[0]


def test_means_in_a_plane_are_those_of_all_points():
    import numpy as np

    from voltframe.operators.clusters import Plane

    draw = np.random.default_rng(1)
    for dims in (1, 2):
        for n in (1, 40, 3_000):
            x = draw.normal(size=(n, dims)) * 2
            plane = Plane(x, 0.6)
            for p in [*x[:50], *(draw.normal(size=(50, dims)) * 4), x.min(0), x.max(0) + 9]:
                inside = x[((x - p) ** 2).sum(1) <= 0.36]
                assert np.allclose(plane.mean(p), inside.mean(0) if len(inside) else p, atol=1e-10)
