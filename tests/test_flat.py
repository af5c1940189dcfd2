"""Flat binary recordings: ranges of bytes, pushed-down conditions, chunks and their commits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltframe.operators import blocks as B
from voltframe.sources import flat


def _write(path, x, header=b""):
    path.write_bytes(header + x.T.astype("<i2").tobytes())


def _rows(df):
    return sorted((r["channel"], r["t"], r["v"]) for r in df.select("channel", "t", "v").collect())


def test_a_file_is_read_by_ranges_of_bytes(spark, tmp_path):
    x = np.random.default_rng(0).integers(-999, 999, (3, 1000))
    _write(tmp_path / "a.dat", x, b"head")
    df = flat.read(spark, str(tmp_path / "a.dat"), 3, offset=4, split=600, lsb=0.5)
    assert df.rdd.getNumPartitions() == 10
    assert _rows(df) == [(c, t + 1, x[c, t] * 0.5) for c in range(3) for t in range(1000)]
    some = flat.read(spark, str(tmp_path / "a.dat"), 3, offset=4, split=600, first=150, last=260, only=[2, 0])
    assert _rows(some) == [(c, t, float(x[c, t - 1])) for c in (0, 2) for t in range(150, 261)]


def test_only_the_bytes_of_a_range_are_read(tmp_path):
    x = np.zeros((2, 500))
    _write(tmp_path / "a.dat", x)
    parts = flat.FlatReader({"path": str(tmp_path / "a.dat"), "channels": "2", "first": "101", "last": "130", "split": "40"}).partitions()
    assert [(p.first, p.last) for p in parts] == [(100, 110), (110, 120), (120, 130)]
    with open(tmp_path / "a.dat", "r+b") as f:  # what lies behind the range is gone
        f.truncate(130 * 4)
    reader = flat.FlatReader({"path": str(tmp_path / "a.dat"), "channels": "2", "first": "101", "last": "130", "split": "40"})
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 60


def test_conditions_reach_the_scan(spark, tmp_path):
    x = np.arange(2000).reshape(2, 1000)
    _write(tmp_path / "a.dat", x)
    reader = flat.PushedReader({"path": str(tmp_path / "a.dat"), "channels": "2", "split": "400"})
    left = reader.pushFilters([flat.GreaterThan(("t",), 200), flat.LessThanOrEqual(("t",), 400), flat.In(("channel",), (1, 7)), flat.EqualTo(("v",), 3.0)])
    assert [type(f) for f in left] == [flat.EqualTo] and reader.only == [1] and (reader.first, reader.last) == (201, 400)
    assert sum(p.last - p.first for p in reader.partitions()) == 200
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        df = flat.read(spark, str(tmp_path / "a.dat"), 2, split=400).filter("t > 200 AND t < 203 AND channel = 1 AND v > 0")
        assert _rows(df) == [(1, 201, 1200.0), (1, 202, 1201.0)]
    finally:
        spark.conf.unset(key)


def test_files_of_a_folder_follow_each_other(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 9, (2, 700))
    for k in range(7):
        _write(tmp_path / f"part{k}.dat", x[:, 100 * k : 100 * k + 100])
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = flat.read(spark, str(tmp_path), 2, concatenate=True)
    assert _rows(got) == [(c, t + 1, float(x[c, t])) for c in range(2) for t in range(700)]
    alone = flat.read(spark, str(tmp_path), 2)
    assert alone.filter("file = 3 AND t = 1 AND channel = 0").first()["v"] == x[0, 300]
    blocks = flat.read(spark, str(tmp_path), 2, concatenate=True, form="blocks", size=50, first=120, last=260, split=100)
    assert sorted((r["channel"], r["block"], r["t0"], r["v"]) for r in blocks.collect()) == [(c, b, b * 50 + 1, x[c, b * 50 : min(b * 50 + 50, 260)].tolist()) for c in range(2) for b in range(2, 6)]
    with pytest.raises(Exception, match="whole number"):
        flat.read(spark, str(tmp_path), 3).collect()


def _blocks(spark, x, size):
    rows = [(c, t + 1, float(v)) for c, row in enumerate(x) for t, v in enumerate(row)]
    return B.to_blocks(spark.createDataFrame(rows, "channel int, t long, v double"), x.shape[1], size)


def test_a_second_run_writes_what_is_missing(spark, tmp_path):
    x = np.random.default_rng(2).integers(-40000, 40000, (2, 330)).astype(float)
    path, b = str(tmp_path / "rec"), _blocks(spark, x, 50)
    assert [r["chunk"] for r in flat.save(b.filter("block IN (1, 4)"), path, [0, 1]).orderBy("chunk").collect()] == [1, 4]
    assert not flat.complete(spark, path, 330)
    before = set(os.listdir(tmp_path / "rec" / "data"))
    done = flat.save(b, path, [0, 1])
    after = set(os.listdir(tmp_path / "rec" / "data"))
    assert before < after and len(after) == done.count() == 7 and flat.complete(spark, path, 330)
    want = [(c, t + 1, float(np.clip(x[c, t], -32768, 32767))) for c in range(2) for t in range(330)]
    assert _rows(flat.read(spark, path, 2, committed=True)) == want
    flat.save(b, path, [0, 1])
    assert set(os.listdir(tmp_path / "rec" / "data")) == after


def test_a_failed_task_leaves_nothing_readable(spark, tmp_path):
    x = np.ones((1, 300))
    path, b = str(tmp_path / "rec"), _blocks(spark, x, 50)
    bad = b.withColumn("v", F.when(F.col("block") == 4, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        flat.save(bad.repartition(6, "block"), path, [0])
    assert flat.committed(spark, path).count() == 0 and flat.read(spark, path, 1, committed=True).count() == 0
    flat.save(b, path, [0])
    assert flat.read(spark, path, 1, committed=True).count() == 300 and flat.complete(spark, path, 300)


def test_filters_run_on_blocks_of_a_file(spark, tmp_path):
    x = np.random.default_rng(3).integers(-99, 99, (2, 640))
    _write(tmp_path / "a.dat", x)
    taps = [0.25, 0.5, 0.25]
    got = B.to_samples(B.fir(flat.read(spark, str(tmp_path / "a.dat"), 2, form="blocks", size=64, split=600), taps, 640))
    want = [np.convolve(r, taps, "same") for r in x]
    for r in got.collect():
        inside = 2 < r["t"] <= 638
        assert r["v"] == pytest.approx(want[r["channel"]][r["t"] - 1] if inside else 0)
