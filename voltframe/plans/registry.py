"""Registered queries of the analytics engine, by inventory id, with independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import clusters as C
from ..operators import evaluation as V
from ..operators import events as E
from ..operators import fits as L
from ..operators import generate as G
from ..operators import intervals as I
from ..operators import matrices as M
from ..operators import templates as P
from ..operators import walks as K
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The event table, waveforms, epochs and signal of sources.tables, in SQL.
GDF = "SELECT user_id AS unit, CAST(floor(epoch_ms(ts) / 60000) AS BIGINT) AS t, value AS amp, length(event_type) AS channel, event_id FROM events"
WAVES = "SELECT vec_id AS wf_id, label AS unit, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
EPOCHS = "SELECT o_custkey AS series_id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + o_orderkey % 40 AS e FROM orders"
SIGNAL = "SELECT CAST(l_linenumber % 4 AS INTEGER) AS channel, l_orderkey + 1 AS t, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"
MERGED = f"""ep AS ({EPOCHS}), m0 AS (SELECT *, max(e) OVER (PARTITION BY series_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ep),
m1 AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m0),
merged AS (SELECT series_id, min(s) AS s, max(e) AS e FROM m1 GROUP BY series_id, island)"""
#: Bounds of January 2024 in minutes since the epoch.
FROM, TO, DAY = 28401120, 28445760, 1440


def query(name: str, sql: str | None = None):
    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# sources and restriction


@query("src_01", GDF)
def _(s, d):
    return T.gdf(s, d)


@query("src_06", f"WITH x AS ({SIGNAL}), n AS (SELECT max(t) AS n FROM x) SELECT channel, t, v FROM x UNION ALL SELECT channel, t + n, v FROM x, n")
def _(s, d):
    x = T.signal(s, d)
    n = x.agg(F.max("t")).first()[0] or 0
    return T.concatenate([(x, n), (x, n)])


@query("src_14", f"WITH g AS (SELECT DISTINCT unit, CAST(floor(t / 60) AS BIGINT) AS f FROM ({GDF})), p AS (SELECT unit, f, lag(f) OVER (PARTITION BY unit ORDER BY f) AS b FROM g) SELECT unit, b + 1 AS begin, f - b - 1 AS length FROM p WHERE f - b > 1")
def _(s, d):
    g = T.gdf(s, d).select("unit", F.floor(F.col("t") / 60).alias("f")).distinct()
    return E.missing_frames(g, "unit", "f")


@query("src_15", f"SELECT DISTINCT unit, CAST(floor(t / 60) AS BIGINT) AS frame FROM ({GDF})")
def _(s, d):
    g = T.gdf(s, d).select("unit", F.floor(F.col("t") / 60).alias("f")).distinct()
    bounds = g.groupBy("unit").agg(F.min("f").alias("first"), F.max("f").alias("last"))
    return E.frames_from_missing(bounds, E.missing_frames(g, "unit", "f"), "unit")


@query("sel_01", f"SELECT pos, channel, t, v FROM (SELECT unnest(['x', 'y', 'y', 'z']) AS a, unnest([1, 2, 3, 4]) AS pos, unnest([70, 5, 5, 33]) AS t) i JOIN ({SIGNAL}) s USING (t) WHERE channel IN (1, 3)")
def _(s, d):
    return T.pick(T.signal(s, d), [70, 5, 5, 33]).filter(F.col("channel").isin(1, 3))


@query("sel_03", f"SELECT wf_id, c * 5 + k AS pos, round(v[c * 16 + 3 + k], 6) AS x FROM ({WAVES}), range(0, 4) r(c), range(1, 6) q(k)")
def _(s, d):
    w = T.waveforms(s, d).select("wf_id", F.posexplode(A.sub_time(F.col("v"), 4, 16, 3, 5)).alias("p", "x"))
    return w.select("wf_id", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("sel_04", f"SELECT wf_id, k + 16 * o AS pos, round(v[c * 16 + k + 1], 6) AS x FROM ({WAVES}), (VALUES (2, 0), (0, 1)) x(c, o), range(0, 16) q(k)")
def _(s, d):
    w = T.waveforms(s, d).select("wf_id", F.posexplode(A.sub_channels(F.col("v"), [2, 0], 16)).alias("p", "x"))
    return w.select("wf_id", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("sel_05", """SELECT count(*) FILTER (NOT quality = 1) AS quality_failed, count(*) FILTER (NOT quality = 1 AND toxic = 0 AND doc_id % 3 <> 0) AS quality_alone,
count(*) FILTER (NOT toxic = 0) AS toxic_failed, count(*) FILTER (NOT toxic = 0 AND quality = 1 AND doc_id % 3 <> 0) AS toxic_alone,
count(*) FILTER (NOT doc_id % 3 <> 0) AS third_failed, count(*) FILTER (NOT doc_id % 3 <> 0 AND quality = 1 AND toxic = 0) AS third_alone FROM labels""")
def _(s, d):
    return E.threshold_filter(T.table(s, d, "labels"), {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 0, "third": F.col("doc_id") % 3 != 0})[1]


@query("sel_06", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 AND toxic = 0")
def _(s, d):
    return E.threshold_filter(T.table(s, d, "labels"), {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 0})[0]


@query("sel_07", f"SELECT unit, count(*) AS n_spikes, round(avg(amp), 6) AS mean_amp FROM ({GDF}) GROUP BY unit HAVING avg(amp) >= 50")
def _(s, d):
    return E.unit_table(T.gdf(s, d), 50)


_GRID = "SELECT CAST(s_suppkey AS BIGINT) AS electrode, s_suppkey % 5 AS x, CAST(floor(s_suppkey / 5) AS BIGINT) AS y FROM supplier"


@query("sel_09", f"WITH g AS ({_GRID}) SELECT a.electrode, b.electrode AS neighbour FROM g a JOIN g b ON abs(a.y - b.y) <= 2 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2")
def _(s, d):
    g = T.table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("electrode"), (F.col("s_suppkey") % 5).alias("x"), F.floor(F.col("s_suppkey") / 5).alias("y"))
    return M.neighbours(g, 2)


@query("sel_10", f"""WITH p AS (SELECT wf_id, c, max(abs(v[c * 16 + k])) AS peak FROM ({WAVES}), range(0, 4) r(c), range(1, 17) q(k) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY wf_id ORDER BY peak DESC, c) AS k, count(*) FILTER (peak >= 0.2) OVER (PARTITION BY wf_id) AS above FROM p)
SELECT wf_id, c AS channel, round(peak, 6) AS peak FROM r WHERE k <= greatest(1, least(2, above))""")
def _(s, d):
    return M.prune(T.waveforms(s, d), 4, 16, max_channels=2, min_channels=1, threshold=0.2)


# joins


@query("join_01", f"WITH {MERGED}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s, e) AS k FROM merged), p AS (SELECT DISTINCT o_custkey AS series_id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 15 AS t FROM orders) SELECT p.series_id, p.t, coalesce(min(k), 0) AS epoch FROM p LEFT JOIN r ON p.series_id = r.series_id AND t BETWEEN s AND e GROUP BY 1, 2")
def _(s, d):
    ep = T.epochs(s, d)
    points = ep.select("series_id", (F.col("s") + 15).alias("t")).distinct()
    return I.find_points(points, I.merge(ep))


@query("join_02", f"SELECT event_id, t, CASE WHEN t <= {FROM + 5 * DAY} THEN 1 WHEN t <= {FROM + 12 * DAY} THEN 2 ELSE 3 END AS interval FROM ({GDF}) WHERE t BETWEEN {FROM} AND {FROM + 20 * DAY}")
def _(s, d):
    return I.assign(T.gdf(s, d).select("event_id", "t"), [FROM, FROM + 5 * DAY, FROM + 12 * DAY, FROM + 20 * DAY])


@query("join_03", f"SELECT event_id, unit, CASE WHEN t <= {FROM + 7 * DAY} THEN 1 WHEN t <= {FROM + 14 * DAY} THEN 2 ELSE 3 END AS session, t - CASE WHEN t <= {FROM + 7 * DAY} THEN {FROM} WHEN t <= {FROM + 14 * DAY} THEN {FROM + 7 * DAY} ELSE {FROM + 14 * DAY} END AS t_session FROM ({GDF}) WHERE t > {FROM} AND t <= {TO}")
def _(s, d):
    return I.sessions(T.gdf(s, d), [FROM, FROM + 7 * DAY, FROM + 14 * DAY, TO]).select("event_id", "unit", "session", "t_session")


@query("join_04", f"""WITH RECURSIVE a AS (SELECT unit, t AS t1, row_number() OVER (PARTITION BY unit ORDER BY t) AS i FROM ({GDF}) WHERE event_id % 3 <> 0), b AS (SELECT unit, t + 2 AS t2, row_number() OVER (PARTITION BY unit ORDER BY t) AS j FROM ({GDF}) WHERE event_id % 3 <> 1),
w(unit, i, j, tp, fp, fn) AS (SELECT DISTINCT unit, 1::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM ({GDF}) UNION ALL
SELECT w.unit, w.i + CASE WHEN t1 - t2 <= 3 THEN 1 ELSE 0 END, w.j + CASE WHEN t1 - t2 >= -3 THEN 1 ELSE 0 END, tp + CASE WHEN abs(t1 - t2) <= 3 THEN 1 ELSE 0 END, fp + CASE WHEN t1 - t2 > 3 THEN 1 ELSE 0 END, fn + CASE WHEN t1 - t2 < -3 THEN 1 ELSE 0 END FROM w JOIN a ON a.unit = w.unit AND a.i = w.i JOIN b ON b.unit = w.unit AND b.j = w.j)
SELECT unit, max(tp) AS tp, max(fp) AS fp, max(fn) AS fn FROM w GROUP BY unit""")
def _(s, d):
    g = T.gdf(s, d)
    return K.match_trains(g.filter("event_id % 3 != 0"), g.filter("event_id % 3 != 1").withColumn("t", F.col("t") + 2), 3)


@query("join_06", f"WITH g AS ({GDF}) SELECT DISTINCT a.event_id FROM g a JOIN g b ON a.unit <> b.unit AND abs(a.t - b.t) <= 1")
def _(s, d):
    return V.in_overlap(T.gdf(s, d), 1)


@query("join_06_walk")
def _(s, d):
    return K.mark_overlaps(T.gdf(s, d), 1)


@query("join_08", f"SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY f) AS idx, f AS frame FROM (SELECT DISTINCT unit, CAST(floor(t / 60) AS BIGINT) AS f FROM ({GDF}))")
def _(s, d):
    g = T.gdf(s, d).select("unit", F.floor(F.col("t") / 60).alias("f")).distinct()
    bounds = g.groupBy("unit").agg(F.min("f").alias("first"), F.max("f").alias("last"), F.count("*").alias("n"))
    samples = bounds.select("unit", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("idx"))
    return E.frame_numbers(samples, bounds, E.missing_frames(g, "unit", "f"), "unit")


@query("join_09", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    return T.table(s, d, "customer").select("c_custkey").join(T.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# interval algebra


@query("epo_01", f"WITH {MERGED} SELECT * FROM merged")
def _(s, d):
    return I.merge(T.epochs(s, d))


@query("epo_02", f"WITH {MERGED}, g AS (SELECT series_id, coalesce(lag(e) OVER (PARTITION BY series_id ORDER BY s) + 1, 1) AS s, s - 1 AS e FROM merged) SELECT * FROM g WHERE e - s >= 1 UNION ALL SELECT series_id, max(e) + 1, 12000 FROM merged GROUP BY 1 HAVING max(e) + 1 <= 12000")
def _(s, d):
    return I.flip_merged(T.epochs(s, d), F.lit(12000).cast("long"))


@query("epo_03", f"SELECT series_id, s, e, e - s + 1 AS n FROM ({EPOCHS})")
def _(s, d):
    return T.epochs(s, d).withColumn("n", I.length(F.col("s"), F.col("e")))


@query("epo_04", f"SELECT * FROM ({EPOCHS}) WHERE e - s + 1 >= 25")
def _(s, d):
    return I.remove_short(T.epochs(s, d), 25)


@query("epo_05", f"SELECT series_id, s + CAST(ceil(greatest(e - s + 1 - 10, 0) / 2.0) AS BIGINT) AS s, e - CAST(floor(greatest(e - s + 1 - 10, 0) / 2.0) AS BIGINT) AS e FROM ({EPOCHS})")
def _(s, d):
    return I.make_max_len(T.epochs(s, d), 10)


@query("epo_06", f"SELECT series_id, unnest(range(s, e + 1)) AS idx FROM ({EPOCHS})")
def _(s, d):
    return I.to_idx(T.epochs(s, d))


@query("epo_07", f"WITH p AS (SELECT channel, t + k AS t, t AS begin, k FROM (SELECT channel, t FROM ({SIGNAL}) WHERE t % 100 = 1), range(0, 10) r(k)), x AS ({SIGNAL}) SELECT p.channel, begin, k AS pos, coalesce(v, 0) AS v FROM p LEFT JOIN x ON p.channel = x.channel AND p.t = x.t")
def _(s, d):
    x = T.signal(s, d)
    return M.extract(x, x.filter("t % 100 = 1").select("channel", F.col("t").alias("begin")), 10)


@query("epo_08", f"""WITH g AS (SELECT unit AS series_id, t - 60 AS s, t + 60 AS e FROM ({GDF})), m0 AS (SELECT *, max(e) OVER (PARTITION BY series_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g),
m1 AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m0), m AS (SELECT series_id, min(s) AS s, max(e) AS e FROM m1 GROUP BY series_id, island),
f AS (SELECT series_id, coalesce(lag(e) OVER (PARTITION BY series_id ORDER BY s) + 1, {FROM}) AS s, s - 1 AS e FROM m) SELECT * FROM f WHERE e - s >= 1 UNION ALL SELECT series_id, max(e) + 1, {TO} FROM m GROUP BY 1 HAVING max(e) + 1 <= {TO}""")
def _(s, d):
    near = T.gdf(s, d).select(F.col("unit").alias("series_id"), (F.col("t") - 60).alias("s"), (F.col("t") + 60).alias("e"))
    return I.flip_merged(near, F.lit(TO).cast("long"), F.lit(FROM).cast("long"))


@query("epo_09", f"WITH x AS (SELECT DISTINCT channel, t FROM ({SIGNAL}) WHERE v > 25), g AS (SELECT channel, t, t - row_number() OVER (PARTITION BY channel ORDER BY t) AS g FROM x) SELECT channel, min(t) AS s, max(t) AS e FROM g GROUP BY channel, g")
def _(s, d):
    return I.from_binary(T.signal(s, d), F.col("v") > 25, "channel", "t")


# detection


@query("det_01", f"WITH x AS (SELECT *, lag(v) OVER (PARTITION BY channel ORDER BY t) AS a, lead(v) OVER (PARTITION BY channel ORDER BY t) AS b FROM ({SIGNAL})) SELECT channel, t, v FROM x WHERE v >= a AND v >= b")
def _(s, d):
    return K.peaks(T.signal(s, d))


#: Of peaks (channel, t, h) closer than a distance the smaller goes, of equals the left, until none is.
_SUPPRESS = """r(it, channel, t, h) AS (SELECT 0, channel, t, h FROM cand UNION ALL SELECT it + 1, channel, t, h FROM (SELECT *, bool_or(lost) OVER () AS again FROM
(SELECT it, channel, t, h, coalesce(t - lag(t) OVER w < DIST AND lag(h) OVER w > h, false) OR coalesce(lead(t) OVER w - t < DIST AND h <= lead(h) OVER w, false) AS lost FROM r WINDOW w AS (PARTITION BY channel ORDER BY t))) WHERE NOT lost AND again)"""


@query("det_01_suppressed", f"WITH RECURSIVE x AS (SELECT *, lag(v) OVER (PARTITION BY channel ORDER BY t) AS a, lead(v) OVER (PARTITION BY channel ORDER BY t) AS b FROM ({SIGNAL})), cand AS (SELECT channel, t, v AS h FROM x WHERE v >= a AND v >= b AND v > 20), {_SUPPRESS.replace('DIST', '6')} SELECT channel, t, h AS v FROM r WHERE it = (SELECT max(it) FROM r)")
def _(s, d):
    return K.suppress_peaks(K.peaks(T.signal(s, d)), 6, 20.0)


@query("det_04", f"""WITH RECURSIVE e AS (SELECT t, amp - 50 AS amp, channel FROM ({GDF})), i0 AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, channel, amp) < 5 THEN 0 ELSE 1 END AS n FROM e), i1 AS (SELECT *, sum(n) OVER (ORDER BY t, channel, amp ROWS UNBOUNDED PRECEDING) AS island FROM i0), p AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY t, channel, amp) AS k FROM i1),
w(island, k, grp, bt, ba) AS (SELECT island, k, k, t, amp FROM p WHERE k = 1 UNION ALL SELECT p.island, p.k, CASE WHEN p.t < bt + 5 THEN grp ELSE p.k END, CASE WHEN p.t >= bt + 5 OR (ba > 0 AND amp < 0) OR abs(ba) <= abs(amp) THEN p.t ELSE bt END, CASE WHEN p.t >= bt + 5 OR (ba > 0 AND amp < 0) OR abs(ba) <= abs(amp) THEN amp ELSE ba END FROM w JOIN p ON p.island = w.island AND p.k = w.k + 1),
j AS (SELECT p.*, grp, min(amp) OVER (PARTITION BY p.island, grp) AS low FROM p JOIN w USING (island, k)), o AS (SELECT *, row_number() OVER (PARTITION BY island, grp ORDER BY CASE WHEN low < 0 THEN amp ELSE -amp END, k) AS r FROM j) SELECT t, amp, channel FROM o WHERE r = 1""")
def _(s, d):
    return K.merge_detections(T.gdf(s, d).withColumn("amp", F.col("amp") - 50), 5)


@query("det_04_sessions", f"""WITH g AS (SELECT unit, t, amp - 50 AS amp, event_id FROM ({GDF})), x AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) < 120 THEN 0 ELSE 1 END AS n FROM g),
y AS (SELECT *, sum(n) OVER (PARTITION BY unit ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS i FROM x), r AS (SELECT *, min(amp) OVER (PARTITION BY unit, i) AS low, count(*) OVER (PARTITION BY unit, i) AS n_events FROM y),
z AS (SELECT *, row_number() OVER (PARTITION BY unit, i ORDER BY CASE WHEN low < 0 THEN amp ELSE -amp END, event_id) AS k FROM r) SELECT unit, event_id, n_events FROM z WHERE k = 1""")
def _(s, d):
    return K.merge_sessions(T.gdf(s, d).withColumn("amp", F.col("amp") - 50), 120)


@query("det_08", f"WITH x AS ({SIGNAL}), m AS (SELECT channel, median(v) AS m FROM x GROUP BY 1) SELECT channel, round(1.4826 * median(abs(v - m)), 6) AS sigma, round(median(abs(v - m)), 6) AS mad FROM x JOIN m USING (channel) GROUP BY channel")
def _(s, d):
    return M.mad(T.signal(s, d))


@query("det_09", f"WITH x AS (SELECT wf_id, unit, k AS pos, v[k] AS x FROM ({WAVES}), range(1, 65) r(k)), o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY x DESC, pos, wf_id) AS r FROM x) SELECT unit, wf_id, pos, round(x, 6) AS x FROM o WHERE r = 1")
def _(s, d):
    x = T.waveforms(s, d).select("wf_id", "unit", F.posexplode("v").alias("p", "x")).withColumn("pos", (F.col("p") + 1).cast("long"))
    return x.groupBy("unit").agg(F.min_by(F.struct("wf_id", "pos", "x"), F.struct(-F.col("x"), "pos", "wf_id")).alias("m")).select("unit", "m.wf_id", "m.pos", F.round("m.x", 6).alias("x"))


# signal


@query("sig_03", f"""WITH x AS ({SIGNAL}), c AS (SELECT channel, t, v, v - avg(v) OVER (PARTITION BY channel) AS z FROM x), m AS (SELECT t, avg(z) AS m FROM c GROUP BY t), k AS (SELECT channel, sum(z * m.m) / (SELECT sum(m * m) FROM m) AS b FROM c JOIN m USING (t) GROUP BY channel)
SELECT c.channel, c.t, round(c.v - k.b * m.m, 5) AS v FROM c JOIN m USING (t) JOIN k USING (channel)""")
def _(s, d):
    return M.remove_common_mode(T.signal(s, d))


@query("sig_04", f"SELECT channel, t, round(v - avg(v) OVER (PARTITION BY t), 6) AS v FROM ({SIGNAL})")
def _(s, d):
    return T.signal(s, d).select("channel", "t", F.round(F.col("v") - F.avg("v").over(Window.partitionBy("t")), 6).alias("v"))


@query("sig_08", f"SELECT wf_id, c, k, CASE WHEN k - 3 BETWEEN 0 AND 15 THEN round(v[c * 16 + k - 2], 6) ELSE 0 END AS x FROM ({WAVES}), range(0, 4) r(c), range(0, 16) q(k)")
def _(s, d):
    w = T.waveforms(s, d).select("wf_id", F.posexplode(A.shift(F.col("v"), 3, 16)).alias("p", "x"))
    return w.select("wf_id", F.floor(F.col("p") / 16).alias("c"), (F.col("p") % 16).cast("long").alias("k"), F.round("x", 6).alias("x"))


@query("sig_08_wide", f"SELECT wf_id, c, k, CASE WHEN k BETWEEN 5 AND 20 THEN round(v[c * 16 + k - 4], 6) ELSE 0 END AS x FROM ({WAVES}), range(0, 4) r(c), range(0, 21) q(k)")
def _(s, d):
    w = T.waveforms(s, d).select("wf_id", F.posexplode(A.shift_wide(F.col("v"), 3, 4, 16, 2, 3)).alias("p", "x"))
    return w.select("wf_id", F.floor(F.col("p") / 21).alias("c"), (F.col("p") % 21).cast("long").alias("k"), F.round("x", 6).alias("x"))


# representation


@query("rsh_01", f"SELECT wf_id, c, k, round(v[c * 16 + k + 1], 6) AS x FROM ({WAVES}), range(0, 4) r(c), range(0, 16) q(k)")
def _(s, d):
    w = T.waveforms(s, d).select("wf_id", F.posexplode(A.channels(F.col("v"), 4, 16)).alias("c", "u")).select("wf_id", "c", F.posexplode("u").alias("k", "x"))
    return w.select("wf_id", F.col("c").cast("long").alias("c"), F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@query("rsh_04", f"SELECT wf_id, i AS pos, round(v[(i % 4) * 16 + CAST(floor(i / 4) AS BIGINT) + 1], 6) AS x FROM ({WAVES}), range(0, 64) r(i)")
def _(s, d):
    w = T.waveforms(s, d).select("wf_id", F.posexplode(A.to_time_embedding(F.col("v"), 4, 16)).alias("p", "x"))
    return w.select("wf_id", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("rsh_06", f"SELECT wf_id, i AS pos, round(v[i + 1] * (CAST(floor(i / 16) AS BIGINT) + 1), 6) AS x FROM ({WAVES}), range(0, 64) r(i)")
def _(s, d):
    w = T.waveforms(s, d).select("wf_id", F.posexplode(A.scale_channels(F.col("v"), [1.0, 2.0, 3.0, 4.0], 16)).alias("p", "x"))
    return w.select("wf_id", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("x"))


# waveforms


@query("wav_01", f"WITH x AS (SELECT wf_id, c, k, v[c * 16 + k] AS x FROM ({WAVES}), range(0, 4) r(c), range(1, 17) q(k)) SELECT wf_id, c AS channel, round(min(x), 6) AS low, arg_min(k, (x, k)) AS low_at, round(max(x), 6) AS high, arg_min(k, (-x, k)) AS high_at FROM x GROUP BY 1, 2")
def _(s, d):
    return M.extremes(T.waveforms(s, d), 4, 16)


@query("wav_04", f"WITH x AS (SELECT wf_id, c, max(abs(v[c * 16 + k])) AS a FROM ({WAVES}), range(0, 4) r(c), range(1, 17) q(k) GROUP BY 1, 2) SELECT wf_id, arg_min(c, (-a, c)) AS channel, round(max(a), 6) AS peak FROM x GROUP BY 1")
def _(s, d):
    return M.max_channel(T.waveforms(s, d), 4, 16)


@query("wav_05", f"WITH x AS (SELECT wf_id, k, v[k] AS x FROM ({WAVES}), range(1, 65) r(k)), m AS (SELECT k, avg(x) AS m FROM x GROUP BY k) SELECT wf_id, CAST(floor((k - 1) / 16) AS BIGINT) AS channel, round(sum(x * m), 6) AS p FROM x JOIN m USING (k) GROUP BY 1, 2")
def _(s, d):
    return M.project_on_mean(T.waveforms(s, d), 16)


@query("wav_06", f"WITH x AS ({SIGNAL}), n AS (SELECT max(t) AS n FROM x), p AS (SELECT channel, t AS begin, t > 5 AND t - 5 + 13 <= n AS inside FROM x, n WHERE t % 50 = 1) SELECT p.channel, begin, k AS pos, CASE WHEN inside THEN coalesce(v, 0) ELSE 0 END AS v FROM p CROSS JOIN range(0, 12) r(k) LEFT JOIN x ON p.channel = x.channel AND x.t = begin - 5 + k")
def _(s, d):
    x = T.signal(s, d)
    return M.cut(x, x.filter("t % 50 = 1").select("channel", F.col("t").alias("begin")), 5, 12)


@query("wav_08", f"SELECT unit, k - 1 AS pos, round(avg(v[k]), 6) AS mean, round(median(v[k]), 6) AS median FROM ({WAVES}), range(1, 65) r(k) GROUP BY 1, 2")
def _(s, d):
    return M.class_means(T.waveforms(s, d))


_MEANS = f"(SELECT unit, k, avg(v[k]) AS x FROM ({WAVES}), range(1, 65) r(k) GROUP BY 1, 2)"


@query("wav_17", f"WITH m AS {_MEANS}, z AS (SELECT a.unit AS u1, b.unit AS u2, s, sqrt(sum((CASE WHEN (a.k - 1) % 16 - s BETWEEN 0 AND 15 THEN b2.x ELSE 0 END - a.x) ** 2)) AS dist FROM m a CROSS JOIN range(-3, 4) q(s) JOIN (SELECT DISTINCT unit FROM m) b ON a.unit < b.unit LEFT JOIN m b2 ON b2.unit = b.unit AND b2.k = a.k - s GROUP BY 1, 2, 3) SELECT u1, u2, round(min(dist), 5) AS low, arg_min(s, (round(dist, 9), s)) AS low_at, round(max(dist), 5) AS high, arg_min(s, (-round(dist, 9), s)) AS high_at FROM z GROUP BY 1, 2")
def _(s, d):
    return M.shifted_distances(M.templates(T.waveforms(s, d)), 16, 3)


_LAGS = f"""m AS {_MEANS}, p AS (SELECT unit, CAST(floor((k - 1) / 16) AS INTEGER) AS c, (k - 1) % 16 AS i, x FROM m), n AS (SELECT *, x - avg(x) OVER (PARTITION BY unit, c) AS y, stddev_samp(x) OVER (PARTITION BY unit) AS sd FROM p),
l AS (SELECT a.unit AS u1, b.unit AS u2, a.i - b.i AS tau, sum(a.x * b.x) AS xx, sum(a.y * b.y) AS yy, max(a.sd * b.sd) AS sd FROM n a JOIN n b ON a.c = b.c AND a.unit < b.unit GROUP BY 1, 2, 3)"""


@query("wav_15", f"WITH {_LAGS}, r AS (SELECT *, row_number() OVER (PARTITION BY u1, u2 ORDER BY round(yy, 9) DESC, tau) AS r FROM l) SELECT u1, u2, CAST(tau AS BIGINT) AS tau, round(yy / (64 * sd), 5) AS xc FROM r WHERE r = 1")
def _(s, d):
    return M.cross_covariances(M.templates(T.waveforms(s, d)), 4, 16)


@query("wav_16", f"""WITH {_LAGS}, e AS (SELECT unit, sum(x * x) AS e FROM p GROUP BY 1), q AS (SELECT l.u1, l.u2, tau, a.e - 2 * xx + b.e AS d FROM l JOIN e a ON a.unit = u1 JOIN e b ON b.unit = u2),
r AS (SELECT *, row_number() OVER (PARTITION BY u1, u2 ORDER BY round(d, 9), tau) AS r FROM q), z AS (SELECT *, CASE WHEN abs(tau) <= 2 THEN tau ELSE 0 END AS s FROM r WHERE r = 1)
SELECT z.u1, z.u2, CAST(z.tau AS BIGINT) AS tau, round(any_value(z.d), 5) AS d, round(max(abs(a.x - b.x)), 5) AS max_abs, round(max(abs(a.x - b.x)) / arg_max(greatest(abs(a.x), abs(b.x)), (abs(a.x - b.x), -(a.c * 16 + a.i))), 5) AS max_relative FROM z JOIN p a ON a.unit = z.u1 JOIN p b ON b.unit = z.u2 AND b.c = a.c AND b.i = a.i - z.s WHERE a.i BETWEEN abs(z.s) AND 15 - abs(z.s) GROUP BY 1, 2, 3""")
def _(s, d):
    return M.cross_differences(M.templates(T.waveforms(s, d)), 16)


@query("wav_18", f"WITH {_LAGS}, r AS (SELECT *, row_number() OVER (PARTITION BY u1, u2 ORDER BY round(yy, 9) DESC, tau) AS r FROM l), k AS (SELECT u1, u2, tau, xx FROM r WHERE r = 1) SELECT k.u1, k.u2, round(100 * any_value(xx) / sqrt(sum(a.x * a.x) FILTER (tau <= 0 OR a.i >= tau) * sum(b.x * b.x) FILTER (tau >= 0 OR b.i >= -tau)), 5) AS overlap FROM k JOIN p a ON a.unit = u1 JOIN p b ON b.unit = u2 AND b.c = a.c AND b.i = a.i GROUP BY 1, 2")
def _(s, d):
    return M.overlaps(M.templates(T.waveforms(s, d)), 4, 16)


@query("wav_19", f"WITH m AS {_MEANS}, w AS (SELECT wf_id, k, v[k] AS x FROM ({WAVES}), range(1, 65) r(k)), z AS (SELECT w.wf_id, m.unit, s, sum(w.x * m.x) AS score FROM w CROSS JOIN range(-2, 3) q(s) JOIN m ON m.k = w.k - s AND (w.k - 1) // 16 = (m.k - 1) // 16 GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY wf_id ORDER BY round(score, 6) DESC, abs(s), s, unit) AS r FROM z) SELECT wf_id, unit, s AS tau, round(score, 5) AS score FROM b WHERE r = 1")
def _(s, d):
    w = T.waveforms(s, d)
    return P.match_bank(w, M.templates(w), 4, 2).select("wf_id", "unit", F.col("tau").cast("long").alias("tau"), F.round("score", 5).alias("score"))


#: Matches of the two thinned copies by the two-pointer walk, for each pair of units and shift; SHIFTS and MOST are filled in.
_WALK = f"""WITH RECURSIVE a AS (SELECT unit AS u1, t AS t1, row_number() OVER (PARTITION BY unit ORDER BY t, event_id) AS i FROM ({GDF}) WHERE event_id % 3 <> 0), b AS (SELECT unit + 100 AS u2, t + 2 AS t2, row_number() OVER (PARTITION BY unit ORDER BY t, event_id) AS j FROM ({GDF}) WHERE event_id % 3 <> 1),
na AS (SELECT u1, count(*) AS n1 FROM a GROUP BY 1), nb AS (SELECT u2, count(*) AS n2 FROM b GROUP BY 1), sh AS (SELECT unnest(SHIFTS) AS shift, unnest(range(0, len(SHIFTS))) AS rank),
near AS (SELECT DISTINCT u1, u2, shift, rank FROM a JOIN b ON abs(t1 - t2) <= 5 + MOST, sh WHERE abs(t1 - t2 - shift) <= 5),
w(u1, u2, shift, rank, i, j, tp, go) AS (SELECT u1, u2, shift, rank, 1::BIGINT, 1::BIGINT, 0::BIGINT, true FROM near UNION ALL
SELECT w.u1, w.u2, shift, rank, w.i + CASE WHEN t1 - t2 - shift <= 5 THEN 1 ELSE 0 END, w.j + CASE WHEN t1 - t2 - shift >= -5 THEN 1 ELSE 0 END, tp + CASE WHEN abs(t1 - t2 - shift) <= 5 THEN 1 ELSE 0 END, true FROM w JOIN a ON a.u1 = w.u1 AND a.i = w.i JOIN b ON b.u2 = w.u2 AND b.j = w.j),
m AS (SELECT u1, u2, shift, rank, max(tp) AS tp FROM w GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY u1, u2 ORDER BY tp DESC, rank) AS k FROM m)
"""


# evaluation: two thinned copies of the event table, the second 2 later, stand for truth and result


def _truth_and_result(s, d):
    g = T.gdf(s, d).select("unit", "t", "event_id")
    return g.filter("event_id % 3 != 0"), g.filter("event_id % 3 != 1").select((F.col("unit") + 100).alias("unit"), (F.col("t") + 2).alias("t"), "event_id")


_PAIRS = "SELECT x.u1, x.u2, CAST(shift AS BIGINT) AS shift, tp, n1, n2 FROM x JOIN na USING (u1) JOIN nb USING (u2) WHERE k = 1 AND tp > 0"


def _assigned(score: str, columns: str) -> str:
    """SQL of the assignment: the best pair left of those whose units are free, one step a pair."""
    return _WALK.replace("SHIFTS", "[0]").replace("MOST", "0").rstrip() + f""", s AS (SELECT u1, u2, shift, tp, n1, n2, row_number() OVER (ORDER BY {score} DESC, u1, u2) AS r FROM ({_PAIRS})),
g(step, r, one, two) AS (SELECT 0, 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT step + 1, n.r, list_append(one, n.u1::BIGINT), list_append(two, n.u2::BIGINT) FROM (SELECT g.step, g.one, g.two, min(s.r) AS r FROM g JOIN s ON NOT list_contains(g.one, s.u1::BIGINT) AND NOT list_contains(g.two, s.u2::BIGINT) GROUP BY ALL) g JOIN s n ON n.r = g.r)
SELECT {columns} FROM g JOIN s USING (r)"""


#: Labels of all events with a jitter of 5 and overlaps within 3: near pairs of events in the order in which pairs of
#: units are walked, one step a pair in each run of events that no match leaves.
_LABELS = _assigned("tp", "u1, u2").replace("SELECT u1, u2 FROM g", ", won AS (SELECT u1, u2 FROM g") + f"""),
rk AS (SELECT u1, u2, own, row_number() OVER (ORDER BY NOT own, -tp, u2, u1) AS rk FROM (SELECT s.u1, s.u2, tp, w.u1 IS NOT NULL AS own FROM s LEFT JOIN won w ON s.u1 = w.u1 AND s.u2 = w.u2)),
ae AS (SELECT unit AS u1, t AS t1, event_id AS e1 FROM ({GDF}) WHERE event_id % 3 <> 0), be AS (SELECT unit + 100 AS u2, t + 2 AS t2, event_id AS e2 FROM ({GDF}) WHERE event_id % 3 <> 1),
ov AS (SELECT DISTINCT p.e1 FROM ae p JOIN ae q ON p.u1 <> q.u1 AND q.t1 BETWEEN p.t1 - 3 AND p.t1 + 3),
isl AS (SELECT t, sum(CASE WHEN d <= 5 THEN 0 ELSE 1 END) OVER (ORDER BY t) AS island FROM (SELECT t, t - lag(t) OVER (ORDER BY t) AS d FROM (SELECT t1 AS t FROM ae UNION SELECT t2 FROM be))),
nr AS (SELECT island, rk, own, e1, t2, e2, row_number() OVER (PARTITION BY island ORDER BY rk, t1, e1, t2, e2) AS k FROM ae JOIN be ON t2 BETWEEN t1 - 5 AND t1 + 5 JOIN rk USING (u1, u2) JOIN isl ON isl.t = t1),
lb(island, k, one, two, rk, lt, le, ok, e1, e2, own) AS (SELECT DISTINCT island, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false, NULL::BIGINT, NULL::BIGINT, false FROM nr UNION ALL
SELECT island, k, CASE WHEN ok THEN list_append(one, e1) ELSE one END, CASE WHEN ok THEN list_append(two, e2) ELSE two END, rk, CASE WHEN ok THEN t2 ELSE lt END, CASE WHEN ok THEN e2 ELSE le END, ok, e1, e2, own FROM (
SELECT n.island, n.k, one, two, n.rk, n.t2, n.e1, n.e2, n.own, CASE WHEN n.rk = l.rk THEN lt END AS lt, CASE WHEN n.rk = l.rk THEN le END AS le, NOT list_contains(one, n.e1) AND NOT list_contains(two, n.e2) AND (l.rk IS DISTINCT FROM n.rk OR lt IS NULL OR n.t2 > lt OR n.t2 = lt AND n.e2 > le) AS ok
FROM lb l JOIN nr n ON n.island = l.island AND n.k = l.k + 1)),
mt AS (SELECT lb.e1, lb.e2, own, ov.e1 IS NOT NULL AS o FROM lb LEFT JOIN ov USING (e1) WHERE ok),
lab AS (SELECT 1 AS side, u1 AS unit, e1 AS event_id, ov.e1 IS NOT NULL AS overlap, CASE WHEN mt.e1 IS NULL THEN 2 WHEN own THEN 1 ELSE 7 END + CASE WHEN ov.e1 IS NULL THEN 0 WHEN mt.e1 IS NOT NULL AND NOT own THEN 1 ELSE 3 END AS label FROM ae LEFT JOIN ov USING (e1) LEFT JOIN mt USING (e1)
UNION ALL SELECT 2, u2, e2, false, CASE WHEN mt.e2 IS NULL THEN 3 WHEN own THEN CASE WHEN o THEN 4 ELSE 1 END WHEN o THEN 8 ELSE 7 END FROM be LEFT JOIN mt USING (e2)),
t1 AS (SELECT unit AS u1, count(*) AS n_true, count(*) FILTER (NOT overlap) AS n_alone, count(*) FILTER (overlap) AS n_overlap, count(*) FILTER (label IN (2, 5)) AS fn, count(*) FILTER (label = 2) AS fn_alone, count(*) FILTER (label = 5) AS fn_overlap, count(*) FILTER (label IN (1, 4)) AS tp, count(*) FILTER (label = 1) AS tp_alone, count(*) FILTER (label = 4) AS tp_overlap, count(*) FILTER (label IN (7, 8)) AS cl, count(*) FILTER (label = 7) AS cl_alone, count(*) FILTER (label = 8) AS cl_overlap FROM lab WHERE side = 1 GROUP BY 1),
t2 AS (SELECT unit AS u2, count(*) AS detected, count(*) FILTER (label IN (7, 8)) AS fa, count(*) FILTER (label = 3) AS fp, count(*) FILTER (label = 7) AS c, count(*) FILTER (label = 8) AS co FROM lab WHERE side = 2 GROUP BY 1),
tb AS (SELECT u1, u2, n_true, n_alone, n_overlap, coalesce(detected, 0) AS detected, coalesce(fa, 0) AS fa, coalesce(fp, 0) AS fp, fn, fn_alone, fn_overlap, tp, tp_alone, tp_overlap, cl, cl_alone, cl_overlap, fn_overlap AS det_err_overlap, coalesce(fp, 0) + fn AS det_err, cl_overlap + fn_overlap AS err_overlap, cl + coalesce(fp, 0) + fn AS err FROM t1 LEFT JOIN won USING (u1) LEFT JOIN t2 USING (u2)
UNION ALL SELECT -1, u2, 0, 0, 0, detected, fa, fp, 0, 0, 0, 0, 0, 0, 0, c, co, 0, fp, 0, 0 FROM t2 WHERE u2 NOT IN (SELECT u2 FROM won)) """
_PART = "coalesce(round(100 * {} / nullif({}, 0), 6), 0)"


@query("join_05", _WALK.replace("SHIFTS", "[0, -3, -2, -1, 1, 2, 3]").replace("MOST", "3") + _PAIRS)
def _(s, d):
    return V.compare(*_truth_and_result(s, d), 5, 3)


@query("eva_01", _assigned("3 * tp - n1 - n2", "u1, u2, shift, tp, n1, n2"))
def _(s, d):
    return V.assign_trains(*_truth_and_result(s, d), 5, by="error")


@query("eva_02", _assigned("tp / n2", "u1, u2, shift, tp, n1, n2"))
def _(s, d):
    return V.assign_trains(*_truth_and_result(s, d), 5, by="rate")


@query("eva_03")
def _(s, d):
    return V.assigned(*_truth_and_result(s, d), 5, 3)[0].select("u1", "u2", "tp")


@query("eva_04", _LABELS + "SELECT side, label, count(*) AS n FROM lab GROUP BY 1, 2")
def _(s, d):
    return V.label(*_truth_and_result(s, d), 5, 3)[1].groupBy("side", "label").agg(F.count("*").alias("n"))


@query("eva_05", _LABELS + f"SELECT {', '.join(V.TABLE)} FROM tb")
def _(s, d):
    return V.result_table(*_truth_and_result(s, d), 5, 3)


@query("eva_06", _WALK.replace("SHIFTS", "[0]").replace("MOST", "0") + "SELECT x.u1, x.u2, round(tp / n1, 6) AS similarity FROM x JOIN na USING (u1) WHERE k = 1 AND tp > 0")
def _(s, d):
    return V.similarity(V.compare(*_truth_and_result(s, d), 5))


@query("eva_06_after", _LABELS + "SELECT ae.u1, be.u2, round(count(*) / any_value(n1), 6) AS similarity FROM mt JOIN ae USING (e1) JOIN be USING (e2) JOIN na ON na.u1 = ae.u1 GROUP BY 1, 2")
def _(s, d):
    return V.similarity_after(*_truth_and_result(s, d), 5, 3)


@query("eva_07", _LABELS + f"SELECT u1, u2, {_PART.format('tp', 'n_true')} AS tpr, {_PART.format('tp_alone', 'n_alone')} AS tpr_alone, {_PART.format('tp_overlap', 'n_overlap')} AS tpr_overlap, {_PART.format('tp', 'detected')} AS ppv, {_PART.format('err', 'n_true')} AS err, {_PART.format('cl', 'n_true')} AS fcr FROM tb WHERE u1 <> -1")
def _(s, d):
    return V.percentages(V.result_table(*_truth_and_result(s, d), 5, 3))


@query("eva_08")
def _(s, d):
    return V.score_sorting(*_truth_and_result(s, d), samples=5, duration=44640.0)


@query("eva_08_footprints", f"""WITH m AS {_MEANS}, a AS (SELECT unit AS u1, (k - 1) // 16 AS c, (k - 1) % 16 - 2 AS k, x FROM m WHERE (k - 1) % 16 BETWEEN 2 AND 13), w AS (SELECT unit AS u2, (k - 1) // 16 AS c, (k - 1) % 16 - 4 AS k, x FROM m WHERE (k - 1) % 16 BETWEEN 4 AND 15),
g AS (SELECT u1, o.u2, s, round(sqrt(sum((a.x - coalesce(w.x, 0)) ** 2)), 9) AS d FROM a CROSS JOIN range(-10, 11) q(s) CROSS JOIN (SELECT DISTINCT u2 FROM w) o LEFT JOIN w ON w.u2 = o.u2 AND w.c = a.c AND w.k = a.k - s GROUP BY 1, 2, 3),
t AS (SELECT u1, u2, sum(a.x * w.x) AS dot FROM a JOIN w ON a.c = w.c AND a.k = w.k GROUP BY 1, 2) SELECT u1, u2, round(any_value(dot), 6) AS dot, round(min(d), 6) AS low, arg_min(s, (d, s)) AS low_at FROM g JOIN t USING (u1, u2) GROUP BY 1, 2""")
def _(s, d):
    t = M.templates(T.waveforms(s, d))
    found = t.select("unit", F.flatten(F.transform(A.channels(F.col("v"), 4, 16), lambda x: F.slice(x, 5, 12))).alias("v"))
    return M.footprint_overlap(t, found, 4, 16, 12, 2)


@query("mrg_04", f"SELECT 1000 * (unit % 4) + unit AS unit, t, event_id, unit % 3 = 1 AS discarded FROM ({GDF})")
def _(s, d):
    local = T.gdf(s, d).select((F.col("unit") % 4).alias("leg"), "unit", "t", "event_id")
    return L.final_units(local, local.filter("unit % 3 = 1").select("leg", "unit"))


@query("wav_12")
def _(s, d):
    return L.align_on_mean(T.waveforms(s, d), 4, 16).select("wf_id", "tau")


@query("fit_01")
def _(s, d):
    hours = T.gdf(s, d).groupBy("unit", (F.floor(F.col("t") / 60) % 24).alias("x")).agg(F.count("*").alias("y"))
    return L.fit_curves(hours, "gaussian", "unit").select("unit", "residual")


@query("fit_01_kinds")
def _(s, d):
    hours = T.gdf(s, d).groupBy("unit", (F.floor(F.col("t") / 60) % 24).alias("x")).agg(F.count("*").alias("y"))
    one = lambda kind: L.fit_curves(hours, kind, "unit").withColumn("kind", F.lit(kind))
    return one("exponential").unionByName(one("sigmoid")).unionByName(one("power"))


# event-table aggregation


@query("agg_01", f"SELECT unit, t FROM ({GDF})")
def _(s, d):
    return E.to_gdf(E.trains(T.gdf(s, d)))


@query("agg_02", f"SELECT unit, count(*) AS n, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS train FROM ({GDF}) GROUP BY unit")
def _(s, d):
    return E.trains(T.gdf(s, d)).select("unit", F.size("train").cast("long").alias("n"), F.array_join(F.col("train").cast("array<string>"), ",").alias("train"))


@query("agg_03", f"WITH g AS (SELECT unit, channel, count(*) AS n FROM ({GDF}) GROUP BY 1, 2) SELECT u.unit, c.channel, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM g) u CROSS JOIN (SELECT DISTINCT channel FROM g) c LEFT JOIN g ON g.unit = u.unit AND g.channel = c.channel")
def _(s, d):
    return E.grid(T.gdf(s, d), "unit", "channel")


@query("agg_05", f"SELECT unit, CAST(floor((t - {FROM}) / {DAY}.0) AS BIGINT) AS bin, count(*) AS n FROM ({GDF}) WHERE t BETWEEN {FROM} AND {TO} GROUP BY 1, 2")
def _(s, d):
    return E.bins(T.gdf(s, d), FROM, TO, DAY, ["unit"])


@query("agg_06", f"WITH b AS (SELECT unit, CAST(floor((t - {FROM}) / {DAY}.0) AS BIGINT) AS bin, count(*) AS n FROM ({GDF}) WHERE t BETWEEN {FROM} AND {TO} GROUP BY 1, 2) SELECT u.unit, r.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM ({GDF})) u CROSS JOIN range(0, 31) r(bin) LEFT JOIN b ON b.unit = u.unit AND b.bin = r.bin")
def _(s, d):
    g = T.gdf(s, d)
    return E.dense_bins(E.bins(g, FROM, TO, DAY, ["unit"]), g.select("unit").distinct(), 31)


@query("agg_07", f"WITH b AS (SELECT unit, CAST(floor((t - {FROM}) / {DAY}.0) AS BIGINT) AS bin, count(*) AS n FROM ({GDF}) WHERE t BETWEEN {FROM} AND {TO} GROUP BY 1, 2), k AS (SELECT k, exp(-0.5 * (k / 1.5) ** 2) AS w FROM range(-6, 7) r(k)), z AS (SELECT {DAY} * (sum(w) - exp(-8)) AS z FROM k) SELECT unit, bin + k AS bin, round(sum(n * w / z), 9) AS rate FROM b, k, z WHERE bin + k BETWEEN 0 AND 30 GROUP BY 1, 2")
def _(s, d):
    return E.firing_rate(E.bins(T.gdf(s, d), FROM, TO, DAY, ["unit"]), 3, DAY, 31).withColumn("rate", F.round("rate", 9))


_ISI = f"(SELECT unit, t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) AS isi FROM ({GDF}))"


@query("agg_09", f"SELECT unit, CAST(floor(isi / (1200 / 19.0) + 0.5) AS BIGINT) AS bin, count(*) AS n FROM {_ISI} WHERE isi <= 1200 GROUP BY 1, 2")
def _(s, d):
    return E.isi_histogram(T.gdf(s, d), 60, 1200)


@query("agg_10", f"SELECT unit, count(*) AS n_events, count(isi) AS n_isi, count(*) FILTER (isi < 60) AS n_violations FROM {_ISI} GROUP BY 1")
def _(s, d):
    return E.violations(T.gdf(s, d), 60)


@query("agg_10_bins", f"SELECT unit, count(*) FILTER (isi < 1200 / 19.0 / 2) AS n_violations FROM {_ISI} GROUP BY 1")
def _(s, d):
    g = T.gdf(s, d)
    first = E.isi_histogram(g, 60, 1200).filter("bin = 0").select("unit", F.col("n").alias("n_violations"))
    return g.select("unit").distinct().join(first, "unit", "left").fillna(0, ["n_violations"])


@query("agg_11", f"SELECT channel, count(*) AS n FROM ({GDF}) GROUP BY 1")
def _(s, d):
    return T.gdf(s, d).groupBy("channel").agg(F.count("*").alias("n"))


@query("agg_12", f"SELECT unit, event_id FROM (SELECT unit, event_id, row_number() OVER (PARTITION BY unit ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS k FROM ({GDF})) WHERE k <= 5")
def _(s, d):
    return E.sample(T.gdf(s, d), 5, F.md5(F.col("event_id").cast("string"))).select("unit", "event_id")


@query("agg_13", f"SELECT unit, count(*) AS n_spikes, round(avg(amp), 6) AS mean_amp FROM ({GDF}) GROUP BY 1")
def _(s, d):
    return E.unit_table(T.gdf(s, d))


@query("agg_14", f"WITH n AS (SELECT unit, count(*) AS n FROM ({WAVES}) GROUP BY 1), m AS {_MEANS} SELECT k - 1 AS pos, round(sum(n * x) / sum(n), 6) AS x FROM m JOIN n USING (unit) WHERE unit IN (1, 2, 3) GROUP BY 1")
def _(s, d):
    return M.merged_footprint(T.waveforms(s, d), [1, 2, 3])


@query("agg_15", f"WITH r AS (SELECT unit, c, max(x) - min(x) AS span FROM (SELECT unit, CAST(floor((k - 1) / 16) AS BIGINT) AS c, x FROM {_MEANS}) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(span, 9) DESC, c) AS k FROM r) SELECT unit, c AS channel, round(span, 6) AS span FROM o WHERE k <= 3")
def _(s, d):
    return M.top_channels(M.templates(T.waveforms(s, d)), 16, 3)


@query("agg_16", f"SELECT unit, CAST(least(floor(amp / 20), 9) AS BIGINT) AS bucket, count(*) AS n FROM ({GDF}) WHERE amp BETWEEN 0 AND 200 GROUP BY 1, 2")
def _(s, d):
    return T.gdf(s, d).filter(F.col("amp").between(0, 200)).groupBy("unit", F.least(F.floor(F.col("amp") / 20), F.lit(9)).alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_17", f"SELECT CAST(floor((t - {FROM}) / {DAY}.0) AS BIGINT) AS bin, round(count(*) / {DAY}.0, 6) AS rate FROM ({GDF}) WHERE t BETWEEN {FROM} AND {TO} GROUP BY 1")
def _(s, d):
    return E.bins(T.gdf(s, d), FROM, TO, DAY, []).select("bin", F.round(F.col("n") / DAY, 6).alias("rate"))


@query("agg_18", "SELECT p_brand, n, CAST(coalesce(sum(n) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def _(s, d):
    n = T.table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))  # a few files or brands: one window is enough
    return n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p_brand").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


@query("agg_19", f"WITH u AS (SELECT avg(amp) AS a FROM ({GDF}) GROUP BY unit), r AS (SELECT a, row_number() OVER (ORDER BY a) AS k, count(*) OVER () AS n FROM u), q AS (SELECT unnest([0.025, 0.25, 0.5, 0.75, 0.975]) AS p, unnest(range(0, 5)) AS j), z AS (SELECT j, sum(a * greatest(0, 1 - abs(k - greatest(1, least(n, n * p + 0.5))))) AS x FROM r, q GROUP BY j) SELECT round(max(x) FILTER (j = 0), 6) AS q0, round(max(x) FILTER (j = 1), 6) AS q1, round(max(x) FILTER (j = 2), 6) AS q2, round(max(x) FILTER (j = 3), 6) AS q3, round(max(x) FILTER (j = 4), 6) AS q4 FROM z")
def _(s, d):
    u = T.gdf(s, d).groupBy("unit").agg(F.avg("amp").alias("a"))
    return E.midpoint_quantiles(u, "a", [0.025, 0.25, 0.5, 0.75, 0.975]).select(*[F.round(f"q{k}", 6).alias(f"q{k}") for k in range(5)])


@query("win_01", f"SELECT unit, isi FROM {_ISI} WHERE isi IS NOT NULL")
def _(s, d):
    return E.isi(T.gdf(s, d)).select("unit", "isi")


@query("win_02", f"SELECT unit, event_id FROM (SELECT unit, event_id, t, lead(t) OVER (PARTITION BY unit ORDER BY t, event_id) AS n FROM ({GDF})) WHERE n IS NULL OR n - t >= 60")
def _(s, d):
    return E.thin(T.gdf(s, d), 60).select("unit", "event_id")


@query("win_06", f"SELECT unit, event_id FROM (SELECT unit, event_id, row_number() OVER (PARTITION BY unit ORDER BY t, event_id) AS k FROM ({GDF})) WHERE k <= 10")
def _(s, d):
    return E.first_n(T.gdf(s, d), 10).select("unit", "event_id")


@query("fea_01")
def _(s, d):
    return M.principal_components(T.waveforms(s, d), 3)


@query("clu_01")
def _(s, d):
    pc = M.principal_components(T.waveforms(s, d), 2)
    return C.mean_shift(pc.select(F.lit(0).alias("leg"), F.col("wf_id").alias("id"), F.array("pc1", "pc2").alias("x")), 0.6)


@query("clu_04", f"SELECT unit, count(*) AS n, CASE WHEN count(*) > 60 THEN unit ELSE 0 END AS cluster FROM ({GDF}) GROUP BY 1")
def _(s, d):
    n = T.gdf(s, d).groupBy("unit").agg(F.count("*").alias("n"))
    return n.withColumn("cluster", F.when(F.col("n") > 60, F.col("unit")).otherwise(0))


@query("clu_05", "SELECT l_returnflag, l_linestatus, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY 1, 2")
def _(s, d):
    n = T.table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))  # a row per label tuple
    return n.withColumn("r", F.dense_rank().over(Window.orderBy(F.desc("n"))))


@query("pop_03", f"SELECT CASE WHEN unit = 3 THEN 1001 + event_id % 2 ELSE unit END AS unit, count(*) AS n FROM ({GDF}) GROUP BY 1")
def _(s, d):
    return E.split_unit(T.gdf(s, d), 3, F.col("event_id") % 2, 1001).groupBy("unit").agg(F.count("*").alias("n"))


@query("pop_04", f"SELECT CASE WHEN unit IN (2, 4) THEN 1001 ELSE unit END AS unit, count(*) AS n FROM ({GDF}) GROUP BY 1")
def _(s, d):
    return E.merge_units(T.gdf(s, d), [2, 4], 1001).groupBy("unit").agg(F.count("*").alias("n"))


@query("pop_05", f"SELECT CASE WHEN unit IN (2, 4) THEN 1001 ELSE unit END AS unit, count(*) AS n FROM ({GDF}) GROUP BY 1")
def _(s, d):
    two = F.col("event_id") % 2
    log = [{"kind": "split", "unit": 3, "parts": two, "base": 1002, "n": 2}, {"kind": "merge", "units": [2, 4], "new": 1001}, {"kind": "split", "unit": 1002, "parts": two, "base": 1004, "n": 2}, {"kind": "undo", "entry": 0}]
    return E.replay(T.gdf(s, d), log).groupBy("unit").agg(F.count("*").alias("n"))


@query("gen_07", f"WITH x AS ({SIGNAL}), g AS (SELECT channel % 4 AS channel, t - {FROM} + 1 AS t, amp FROM ({GDF})), f AS (SELECT * FROM (VALUES (0, -1.0), (1, -0.5), (2, 0.25)) q(k, x)), a AS (SELECT channel, t + k AS t, amp * x AS v FROM g, f WHERE (t - 1) // 250 = (t + 1) // 250) SELECT channel, t, CAST(greatest(-32768, least(32767, round(round(sum(v), 6)))) AS BIGINT) AS v FROM (SELECT channel, t, v FROM x UNION ALL SELECT CAST(channel AS INTEGER), t, v FROM a) GROUP BY 1, 2")
def _(s, d):
    events = T.gdf(s, d).select((F.col("channel") % 4).alias("channel"), (F.col("t") - FROM + 1).alias("t"), "amp")
    return G.inject_in_chunks(T.signal(s, d), events, [-1.0, -0.5, 0.25], 250).withColumn("v", F.col("v").cast("long"))


# groups of events, alignment, chunks and rankings


@query("det_05", f"""WITH g AS ({GDF}), x AS (SELECT *, CASE WHEN abs(amp) >= 50 THEN 1 ELSE 0 END AS big, CASE WHEN t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) <= 120 THEN 0 ELSE 1 END AS n FROM g),
y AS (SELECT *, sum(n) OVER (PARTITION BY unit ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS i FROM x), z AS (SELECT *, max(big) OVER (PARTITION BY unit, i ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS inside, sum(big) OVER (PARTITION BY unit, i, channel) AS own FROM y),
q AS (SELECT *, max(own) OVER (PARTITION BY unit, i) AS worst FROM z) SELECT unit, t, event_id FROM q WHERE inside = 0 OR worst < 2""")
def _(s, d):
    return K.without_oscillations(T.gdf(s, d), ["unit"], 120, 2, 50).select("unit", "t", "event_id")


@query("win_03", f"""WITH RECURSIVE r(it, unit, t, event_id) AS (SELECT 0, unit, t, event_id FROM ({GDF}) UNION ALL SELECT it + 1, unit, t, event_id FROM (SELECT *, bool_or(lost) OVER () AS again FROM (SELECT *, gap < 60 AND row_number() OVER (PARTITION BY unit ORDER BY gap NULLS LAST, t, event_id) = 1 AS lost FROM (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) AS gap FROM r))) WHERE NOT coalesce(lost, false) AND again)
SELECT unit, t, event_id FROM r WHERE it = (SELECT max(it) FROM r)""")
def _(s, d):
    return K.thin(T.gdf(s, d), 60)


@query("win_05", f"SELECT event_id, unit, row_number() OVER (PARTITION BY unit ORDER BY amp DESC, event_id) AS place FROM ({GDF})")
def _(s, d):
    return T.gdf(s, d).select("event_id", "unit", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("amp"), "event_id")).cast("long").alias("place"))


@query("win_07", f"SELECT channel, event_id, round(amp, 6) AS amp FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY amp DESC, event_id) AS k FROM ({GDF})) WHERE k <= 5")
def _(s, d):
    w = Window.partitionBy("channel").orderBy(F.desc("amp"), "event_id")
    return T.gdf(s, d).withColumn("k", F.row_number().over(w)).filter("k <= 5").select("channel", "event_id", F.round("amp", 6).alias("amp"))


@query("wav_02", f"SELECT wf_id, round(min(x), 6) AS low, arg_min(k, (x, k)) AS low_at, round(max(x), 6) AS high, arg_min(k, (-x, k)) AS high_at FROM (SELECT wf_id, k, v[k] AS x FROM ({WAVES}), range(1, 65) r(k)) GROUP BY 1")
def _(s, d):
    return M.global_extremes(T.waveforms(s, d))


@query("wav_03", f"SELECT wf_id, c AS channel, round(min(v[c * 16 + k]), 6) AS low, round(max(v[c * 16 + k]), 6) AS high FROM ({WAVES}), range(0, 4) r(c), range(1, 17) q(k) GROUP BY 1, 2")
def _(s, d):
    return M.extremes(T.waveforms(s, d), 4, 16).select("wf_id", "channel", "low", "high")


@query("wav_11", f"""WITH m AS (SELECT wf_id, k, max(v[c * 16 + k]) AS x FROM ({WAVES}), range(0, 4) r(c), range(1, 17) q(k) GROUP BY 1, 2), p AS (SELECT wf_id, arg_min(k, (-x, k)) - 9 AS lag FROM m GROUP BY 1)
SELECT wf_id, -lag AS tau, c * 16 + k - 1 AS pos, CASE WHEN k + lag BETWEEN 1 AND 16 THEN round(v[c * 16 + k + lag], 6) ELSE 0 END AS x FROM ({WAVES}) JOIN p USING (wf_id), range(0, 4) r(c), range(1, 17) q(k)""")
def _(s, d):
    x = M.align_on_max(T.waveforms(s, d), 4, 16, 8).select("wf_id", F.col("tau").cast("long").alias("tau"), F.posexplode("v").alias("p", "y"))
    return x.select("wf_id", "tau", F.col("p").cast("long").alias("pos"), F.round("y", 6).alias("x"))


@query("wav_20", f"WITH m AS (SELECT unit, k - 1 AS pos, avg(v[k]) AS x FROM ({WAVES}), range(1, 65) r(k) GROUP BY 1, 2) SELECT CAST(floor(pos / 16) AS BIGINT) AS channel, t - 4 + pos % 16 AS t, round(sum(x), 5) AS v FROM ({GDF}) g JOIN m ON m.unit = g.unit % 10 GROUP BY 1, 2")
def _(s, d):
    x = T.waveforms(s, d).select("unit", F.posexplode("v").alias("p", "y")).groupBy("unit", F.col("p").cast("long").alias("pos")).agg(F.avg("y").alias("mean"))
    return M.superpose(T.gdf(s, d).withColumn("unit", F.col("unit") % 10), x, 16, 4).withColumn("v", F.round("v", 5))


@query("agg_04", f"SELECT unit, t + channel * 100000 AS t, event_id FROM ({GDF})")
def _(s, d):
    return T.gdf(s, d).select("unit", (F.col("t") + F.col("channel").cast("long") * 100000).alias("t"), "event_id")


@query("agg_20", f"WITH x AS (SELECT wf_id, c, max(abs(v[c * 16 + k])) AS a FROM ({WAVES}), range(0, 4) r(c), range(1, 17) q(k) GROUP BY 1, 2), p AS (SELECT wf_id, arg_min(c, (-a, c)) AS channel FROM x GROUP BY 1) SELECT channel, count(*) AS n FROM p GROUP BY 1")
def _(s, d):
    return M.max_channel(T.waveforms(s, d), 4, 16).groupBy("channel").agg(F.count("*").alias("n"))


@query("plt_02", f"SELECT unit, event_id FROM (SELECT unit, event_id, t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) AS isi FROM ({GDF})) WHERE isi <= 600")
def _(s, d):
    return E.isi(T.gdf(s, d)).filter("isi <= 600").select("unit", "event_id")


@query("plt_04", f"SELECT channel, round(quantile_cont(amp, 0.25), 6) AS q25, round(quantile_cont(amp, 0.5), 6) AS q50, round(quantile_cont(amp, 0.75), 6) AS q75, round(avg(amp), 6) AS mean FROM ({GDF}) GROUP BY 1")
def _(s, d):
    return T.gdf(s, d).groupBy("channel").agg(*[F.round(F.percentile("amp", p / 100), 6).alias(f"q{p}") for p in (25, 50, 75)], F.round(F.avg("amp"), 6).alias("mean"))


@query("msc_02", f"WITH x AS ({SIGNAL}), n AS (SELECT max(t) AS n FROM x), c AS (SELECT k FROM n, range(0, 1000000) r(k) WHERE k <= (n - 1) // 1000) SELECT channel, k AS chunk, count(*) AS n, count(*) FILTER (t BETWEEN k * 1000 + 1 AND (k + 1) * 1000) AS n_core, sum(v) AS total FROM x JOIN c ON t BETWEEN k * 1000 - 19 AND (k + 1) * 1000 + 20 GROUP BY 1, 2")
def _(s, d):
    x = T.signal(s, d)
    return M.chunks(x, x.agg(F.max("t")).first()[0] or 0, 1000, 20).groupBy("channel", "chunk").agg(F.count("*").alias("n"), F.count_if("core").alias("n_core"), F.sum("v").alias("total"))


@query("clu_06", f"WITH m AS {_MEANS}, en AS (SELECT unit, sum(x * x) / 2 - ln(0.9) AS cost FROM m GROUP BY 1), w AS (SELECT wf_id, k, v[k] AS x FROM ({WAVES}), range(1, 65) r(k)), z AS (SELECT w.wf_id, m.unit, s, sum(w.x * m.x) AS score FROM w CROSS JOIN range(-2, 3) q(s) JOIN m ON m.k = w.k - s AND (w.k - 1) // 16 = (m.k - 1) // 16 GROUP BY 1, 2, 3), b AS (SELECT wf_id, unit, s, score - cost AS d FROM z JOIN en USING (unit)), o AS (SELECT *, row_number() OVER (PARTITION BY wf_id ORDER BY round(d, 6) DESC, abs(s), s, unit) AS r FROM b) SELECT wf_id, CASE WHEN round(d, 6) > 0 THEN CAST(unit + 1 AS BIGINT) ELSE 0 END AS unit, s AS tau, round(d, 5) AS d FROM o WHERE r = 1")
def _(s, d):
    w = T.waveforms(s, d).withColumn("unit", F.col("unit") + 1)
    return P.classify(w, M.templates(w), 4, 2, 0.9).select("wf_id", F.col("unit").cast("long").alias("unit"), F.col("tau").cast("long").alias("tau"), F.round("score", 5).alias("d"))


from . import catalogue, sorting  # noqa: E402,F401
