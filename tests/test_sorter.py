"""From blocks to units: planted trains are found, groups are done once, a stopped run goes on."""

import numpy as np
import pytest

from voltframe.operators import blocks as B
from voltframe.operators.sorter import Settings, Sorter
from voltframe.sources.shared import settle

N, TF = 12000, 20


@pytest.fixture(scope="module")
def planted(spark):
    draw = np.random.default_rng(11)
    x = draw.normal(0, 1, (6, N))
    shape = -np.exp(-((np.arange(TF) - 6) ** 2) / 4)
    gains = {1: (14, 9, 2, 0, 0, 0), 2: (3, 12, 13, 4, 0, 0), 3: (0, 0, 0, 3, 15, 11)}
    taken, trains = [], {u: [] for u in gains}
    for k in range(150):
        while True:
            t = int(draw.integers(50, N - 60))
            if all(abs(t - s) > 45 for s in taken):
                break
        taken.append(t)
        u = 1 + k % 3
        trains[u].append(t)
        for c, g in enumerate(gains[u]):
            x[c, t - 6 - 1 : t - 6 - 1 + TF] += g * shape
    rows = [(c, t + 1, float(v)) for c in range(6) for t, v in enumerate(x[c])]
    blocks = settle(B.to_blocks(spark.createDataFrame(rows, "channel int, t long, v double"), N, 1000))
    legs = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 2), (2, 3), (2, 1), (3, 4), (3, 5)], "leg int, channel int")
    return blocks, legs, {u: sorted(t) for u, t in trains.items()}


SETTINGS = Settings(threshold=6.0, min_dist=10, merge_dist=12, tf=TF, cut_left=6, blank=25, bandwidth=4.0, least=15, dims=3, jitter=5)


def test_planted_units_are_sorted_and_stages_are_kept(spark, planted, tmp_path):
    blocks, legs, trains = planted
    one = Sorter(blocks, N, legs.filter("leg < 3"), str(tmp_path), SETTINGS, 1000)
    assert one.events().select("leg").distinct().count() == 2
    first = set(one._parts("events"))
    whole = Sorter(blocks, N, legs, str(tmp_path), SETTINGS, 1000)
    units = whole.units().collect()
    assert first < set(whole._parts("events")) and len(whole._parts("events")) == 2 and len(whole._parts("waves")) == 1
    assert sorted(r["leg"] for r in whole.done("events").collect()) == [1, 2, 3]
    kept = {}
    for r in units:
        if not r["discarded"]:
            kept.setdefault(r["unit"], []).append(r["t"])
    for train in trains.values():
        hits = [sum(any(abs(s - t) <= 2 for s in found) for t in train) / len(train) for found in kept.values()]
        best = max(hits)
        found = list(kept.values())[hits.index(best)]
        assert best > 0.95 and sum(any(abs(s - t) <= 2 for t in train) for s in found) / len(found) > 0.95
        assert sum(h > 0.5 for h in hits) == 1  # the same unit in two groups is one
    again = Sorter(blocks.limit(0), N, legs, str(tmp_path), SETTINGS, 1000)  # nothing is computed again
    assert again.matched().count() == whole.matched().count()


def test_a_failed_stage_is_done_again(spark, planted, tmp_path):
    blocks, legs, _ = planted
    s = Sorter(blocks, N, legs, str(tmp_path), SETTINGS, 1000)

    def broken(asked):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        s.stage("waves", broken)
    assert s.read("waves") is None and s.done("waves").count() == 0
    out = s.stage("waves", lambda asked: asked.withColumn("x", asked["leg"] * 2))
    assert sorted(r["x"] for r in out.collect()) == [2, 4, 6] and s.done("waves").count() == 3
