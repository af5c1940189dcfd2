"""Cases that only larger or odd tables show."""

import datetime as dt
import glob

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def against_sql(spark, d, name):
    """Rows of a query and of its SQL over the tables in d, columns in the query's order."""
    found = entry.queries()[name](spark, d)
    c = duckdb.connect()
    for path in glob.glob(f"{d}/*.parquet"):
        inner = f"{path}/*.parquet" if glob.glob(f"{path}/*.parquet") else path
        c.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{inner}'")
    columns = ", ".join(f'"{k}"' for k in found.columns)
    return rows(found), sorted(c.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall())


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Events up to a millisecond before a full minute, and far beyond January 2024."""
    at = [dt.datetime(2024, 1, 1, 0, 0, 59, us) for us in (999_499, 999_500, 999_999)] + [dt.datetime(2024, 1, 1, 0, 59, 59, 999_700), dt.datetime(2024, 1, 1, 3, 0, 5), dt.datetime(2024, 8, 3, 4, 5, 6, 500)]
    d = str(tmp_path_factory.mktemp("late"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(k, x, 1 + k % 2, "click", 1.0 + k, "") for k, x in enumerate(at)], schema).write.parquet(f"{d}/events.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["src_01", "src_14", "src_15", "agg_01", "agg_02", "agg_04", "agg_09", "mrg_04", "plt_03", "pop_01", "pop_06", "det_05", "epo_08", "wav_20"])
def test_times_are_rounded_to_milliseconds(spark, late, name):
    found, want = against_sql(spark, late, name)
    assert found == want


def test_src_05_gives_every_sample(spark):
    found, want = against_sql(spark, SF, "src_05")
    assert found == want and len(found) > 1_000


def test_long_lists_are_read_in_pieces():
    import pyarrow as pa

    from voltframe.functions.arrays import pieces, vectors

    b = pa.RecordBatch.from_arrays([pa.array([[1.0, 2.0], [], [3.0], [4.0, 5.0]], pa.list_(pa.float64()))], names=["v"])
    parts = list(pieces([b], 3))
    assert [p.num_rows for p in parts] == [3, 1]
    assert [v.tolist() for p in parts for v in vectors(p.column(0))] == b.column(0).to_pylist()


def test_first_free_without_gaps_is_the_walk_in_order(spark, monkeypatch):
    import random

    from voltframe.operators import evaluation as V

    monkeypatch.setattr(V, "TILE", 64)
    draw, jitter = random.Random(5), 3
    near = []
    one = [(draw.randrange(5), draw.randrange(1200), e) for e in range(900)]
    two = [(10 + draw.randrange(5), draw.randrange(1200), e) for e in range(900)]
    tp = {(a, b): draw.randrange(1, 9) for a in range(5) for b in range(10, 15)}
    for u1, t1, e1 in one:
        near += [(u1 + 10 == u2, tp[u1, u2], u1, u2, t1, e1, t2, e2, e1 % 2 == 0) for u2, t2, e2 in two if abs(t1 - t2) <= jitter]
    near.sort(key=lambda r: (not r[0], -r[1], r[3], r[2], *r[4:8]))
    used1, used2, last, want = set(), set(), {}, []
    for own, _, u1, u2, t1, e1, t2, e2, _ in near:
        # `last` is of pairs in reach: taken ones before, of the same units, that this one would cross
        if e1 not in used1 and e2 not in used2 and (t2, e2) > last.get((u1, u2), (-1, -1)):
            used1.add(e1)
            used2.add(e2)
            last[u1, u2] = (t2, e2)
            want.append((own, u1, u2, e1, e2))
    df = spark.createDataFrame(near, "own boolean, tp long, u1 long, u2 long, t1 long, e1 long, t2 long, e2 long, o boolean")
    assert rows(V.first_free(df, jitter).select("own", "u1", "u2", "e1", "e2")) == sorted(want)


def test_marks_of_the_walk_need_no_walk(spark):
    import random

    from voltframe.operators import walks as K

    draw = random.Random(3)
    events = [(draw.randrange(4), draw.randrange(300), e) for e in range(200)]
    trains = {u: sorted((t, e) for x, t, e in events if x == u) for u in range(4)}
    want = set()
    for u in range(4):
        for w in range(u + 1, 4):
            a, b, i, j = trains[u], trains[w], 0, 0
            while i < len(a) and j < len(b):
                if abs(a[i][0] - b[j][0]) <= 2:
                    want |= {a[i][1], b[j][1]}
                i, j = (i + 1, j) if a[i][0] < b[j][0] else (i, j + 1)
    df = spark.createDataFrame(events, "unit long, t long, event_id long")
    assert {r[0] for r in K.mark_overlaps(df, 2).collect()} == want


def test_fits_side_by_side_are_those_alone(spark):
    import numpy as np

    from voltframe.operators import fits as L

    draw = np.random.default_rng(1)
    starts = draw.normal(size=(7, 3))
    aims = draw.normal(size=(7, 3))
    loss = lambda p, r: ((p - aims[r]) ** 2).sum(1)
    many, values = L.simplex_many(loss, starts)
    for k in range(7):
        alone, value = L.simplex(lambda p, k=k: float(((p - aims[k]) ** 2).sum()), starts[k])
        assert np.allclose(many[k], alone, atol=1e-6) and abs(values[k] - value) < 1e-9


def test_events_of_assigned_pairs_do_not_meet_all_others(spark, monkeypatch):
    from voltframe.operators import evaluation as V

    true = spark.createDataFrame([(u, 100 * k, 10 * k + u) for k in range(20) for u in range(4)], "unit long, t long, event_id long")
    found = true.selectExpr("unit + 100 AS unit", "t + 1 AS t", "event_id")
    first_free, sizes = V.first_free, []

    def counted(near, jitter):
        sizes.append(near.count())
        return first_free(near, jitter)

    monkeypatch.setattr(V, "first_free", counted)
    # 20 times 4 x 4 events are near each other; those of assigned pairs match before the others are paired
    assert rows(V.label(true, found, 2, 1)[1].groupBy("side", "label").count()) == [(1, 4, 80), (2, 4, 80)]
    assert sizes == [80, 0]
    assert rows(V.assigned(true, found, 2)[0].select("u1", "u2", "tp")) == [(u, u + 100, 20) for u in range(4)]
    assert len(sizes) == 2


def test_a_long_run_of_detections_is_not_held(spark, monkeypatch):
    import random

    from voltframe.operators import walks as K

    monkeypatch.setattr(K, "by_group", lambda *_: pytest.fail("a whole run is held"))
    draw = random.Random(7)
    events = sorted({(leg, draw.randrange(900), draw.randrange(3), float(draw.randrange(-6, 4))) for leg in range(2) for _ in range(700)})
    want = []
    for leg in range(2):
        own = [x[1:] for x in events if x[0] == leg]
        first = 0
        while first < len(own):
            best, end = first, first + 1
            while end < len(own) and own[end][0] < own[best][0] + 4:
                if own[best][2] > 0 > own[end][2] or abs(own[best][2]) <= abs(own[end][2]):
                    best = end
                end += 1
            group = own[first:end]
            low = min(x[2] for x in group)
            t, c, a = min(group, key=lambda x: x[2]) if low < 0 else max(group, key=lambda x: x[2])
            want.append((leg, t, a, c))
            first = end
    df = spark.createDataFrame(events, "leg int, t long, channel int, amp double")
    assert rows(K.merge_detections(df, 4, ["leg"])) == sorted(want)


def test_runs_of_flags_are_found_by_cells(spark, monkeypatch):
    import random

    from voltframe.operators import intervals as I

    monkeypatch.setattr(I, "CELL", 8)
    draw = random.Random(2)
    held = {c: {t for t in range(-30, 200) if draw.random() < 0.9} | set(range(300, 332)) for c in range(3)}
    want = []
    for c, ts in held.items():
        starts, ends = sorted(t for t in ts if t - 1 not in ts), sorted(t for t in ts if t + 1 not in ts)
        want += [(c, a, z) for a, z in zip(starts, ends, strict=True)]
    df = spark.createDataFrame([(c, t) for c, ts in held.items() for t in range(-30, 340) for _ in range(2) if t in ts] + [(0, 900)], "channel int, t long")
    found = I.from_binary(df, F.col("t") < 900, "channel", "t")
    assert rows(found.select("channel", "s", "e")) == sorted(want)


def test_alignment_on_the_mean_goes_in_parts(spark, monkeypatch):
    import numpy as np

    from voltframe.operators import fits as L

    draw = np.random.default_rng(4)
    waves = [(k, k % 2, np.roll(np.sin(np.arange(20) / 2), int(draw.integers(-3, 4))).tolist() + draw.normal(size=20).tolist()) for k in range(21)]
    df = spark.createDataFrame(waves, "wf_id long, unit int, v array<double>")
    whole = rows(L.align_on_mean(df, 2, 20))
    monkeypatch.setattr(L, "PART", 4)
    assert rows(L.align_on_mean(df, 2, 20)) == whole and len({r[1] for r in whole}) > 1


def test_gaps_of_merged_epochs_come_from_one_order(spark):
    import random

    from voltframe.operators import intervals as I

    draw = random.Random(11)
    epochs = [(k % 9, a, a + draw.randrange(12)) for k in range(400) for a in [draw.randrange(1, 700)]]
    df = spark.createDataFrame([*epochs, (9, 5, 800), (9, 1, 2)], "series_id int, s long, e long")
    want = rows(I.flip(I.merge(df), F.lit(705).cast("long"), F.lit(-3).cast("long")))
    found = I.flip_merged(df, F.lit(705).cast("long"), F.lit(-3).cast("long"))
    assert rows(found) == want and len(want) > 100
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
