import numpy as np
import pytest

from voltframe.operators import blocks as B
from voltframe.streaming import detection as D


def _brute(x, sigma, threshold, min_dist):
    e = -x
    top = [t for t in range(1, len(x) - 1) if e[t] >= e[t - 1] and e[t] >= e[t + 1] and e[t] > threshold * sigma]
    out, run = [], []
    for t in [*top, None]:
        if run and (t is None or t - run[-1] >= min_dist):
            out += [run[k] for k in D.keep_highest(run, [e[i] for i in run], min_dist)]
            run = []
        run.append(t)
    return [(t + 1, x[t]) for t in out]


@pytest.mark.parametrize("seed", [0, 1])
def test_any_cut_and_order_gives_the_batch_events(spark, tmp_path, seed):
    draw = np.random.default_rng(seed)
    n = 900
    x = np.round(draw.normal(size=(2, n)), 1)  # ties and plateaus
    chunks = []
    for c in range(2):
        cuts = [0, *sorted(draw.choice(np.arange(1, n), 14, replace=False).tolist()), n]
        chunks += [(c, a + 1, x[c, a:b].tolist()) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
    draw.shuffle(chunks)
    schema = "channel int, t0 long, v array<double>"
    path = str(tmp_path / "in")
    for k in range(0, len(chunks), 8):
        spark.createDataFrame(chunks[k : k + 8], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(chunks[:3], schema).coalesce(1).write.mode("append").parquet(path)  # chunks that come again
    sigma = {0: 1.0, 1: 0.7}
    got = D.run_to_table(spark, path, schema, lambda s: D.detect_stream(s, n, 1.2, 6, sigma), 2).collect()
    want = sorted((c, t, v) for c in range(2) for t, v in _brute(x[c], sigma[c], 1.2, 6))
    assert len(want) > 40 and sorted((r["channel"], r["t"], r["amp"]) for r in got) == want
    samples = spark.createDataFrame([(c, t + 1, float(x[c, t])) for c in range(2) for t in range(n)], "channel int, t long, v double")
    batch = B.detect(B.to_blocks(samples, n, 100), spark.createDataFrame(list(sigma.items()), "channel int, sigma double"), n, 1.2, 6)
    assert sorted((r["channel"], r["t"], r["amp"]) for r in batch.collect()) == want


def test_the_first_chunk_freezes_the_noise(spark, tmp_path):
    quiet, loud = np.tile([1.0, -1.0, 0.5, -0.5], 50), np.tile([10.0, -10.0], 100)
    loud[101] = -60.0
    schema = "channel int, t0 long, v array<double>"
    spark.createDataFrame([(0, 201, loud.tolist()), (0, 1, quiet.tolist())], schema).write.parquet(str(tmp_path / "in"))
    got = D.run_to_table(spark, str(tmp_path / "in"), schema, lambda s: D.detect_stream(s, 400, 20.0, 5)).collect()
    assert [(r["t"], r["amp"]) for r in got] == [(302, -60.0)]
