"""Registered queries from samples to sorted units: filters, noise, detection, covariances, templates, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import blocks as B
from ..operators import clusters as C
from ..operators import generate as G
from ..operators import matrices as M
from ..operators import templates as P
from ..operators.sorter import Settings, Sorter
from ..sources import tables as T
from ..sources.recordings import scratch
from ..streaming import detection as D
from .registry import _MEANS, _SUPPRESS, FROM, GDF, SIGNAL, WAVES, query

#: The signal on a full grid of channels and times, 0 where it has no sample.
_GRID = f"sig AS ({SIGNAL}), n AS (SELECT max(t) AS n FROM sig), grid AS (SELECT c.channel, u.t FROM (SELECT DISTINCT channel FROM sig) c, (SELECT unnest(range(1, n + 1)) AS t FROM n) u), dense AS (SELECT g.channel, g.t, coalesce(s.v, 0) AS v FROM grid g LEFT JOIN sig s ON s.channel = g.channel AND s.t = g.t)"


def _blocks(s, d, size=B.SIZE):
    x, n = T.signal(s, d), T.signal_length(s, d)
    return B.to_blocks(x, n, size, list(range(T.CHANNELS))), n


def _frame(s, values, schema):
    return s.createDataFrame(values, schema)


# filters


_TAPS = "h AS (SELECT k, CASE WHEN k = 55 THEN 0.7 - 0.03 ELSE (sin(pi() * 0.7 * (k - 55)) - sin(pi() * 0.03 * (k - 55))) / (pi() * (k - 55)) END * (0.54 - 0.46 * cos(2 * pi() * k / 110)) AS b FROM range(0, 111) r(k))"


@query("sig_01", f"WITH {_GRID}, {_TAPS} SELECT d.channel, d.t, CASE WHEN d.t <= 110 OR d.t > any_value(n) - 110 THEN 0 ELSE round(coalesce(sum(x.v * b), 0), 5) END AS v FROM dense d CROSS JOIN n CROSS JOIN h LEFT JOIN sig x ON x.channel = d.channel AND x.t = d.t + 55 - k GROUP BY 1, 2")
def _(s, d):
    x, n = _blocks(s, d)
    return B.to_samples(B.fir(x, B.design_bandpass(300, 7000, 20000, 110), n)).withColumn("v", F.round("v", 5) + 0.0)


@query("sig_02", f"WITH {_GRID}, y AS (SELECT channel, t, -0.125 * coalesce(lag(v, 2) OVER w, 0) + 0.25 * coalesce(lag(v) OVER w, 0) + 0.75 * v + 0.25 * coalesce(lead(v) OVER w, 0) - 0.125 * coalesce(lead(v, 2) OVER w, 0) AS y FROM dense WINDOW w AS (PARTITION BY channel ORDER BY t)) SELECT channel, t, CASE WHEN t <= 4 OR t > n - 4 THEN 0 ELSE round(y, 6) END AS v FROM y, n")
def _(s, d):
    x, n = _blocks(s, d)
    return B.to_samples(B.fir(x, [-0.125, 0.25, 0.75, 0.25, -0.125], n)).withColumn("v", F.round("v", 6))


@query("sig_05", f"WITH {_GRID} SELECT channel, t, round((coalesce(lag(v, 2) OVER w, 0) + 4 * coalesce(lag(v) OVER w, 0) + 6 * v + 4 * coalesce(lead(v) OVER w, 0) + coalesce(lead(v, 2) OVER w, 0)) / 16, 6) AS v FROM dense WINDOW w AS (PARTITION BY channel ORDER BY t)")
def _(s, d):
    x, n = _blocks(s, d)
    return B.to_samples(B.zero_phase(x, [0.25, 0.5, 0.25], n)).withColumn("v", F.round("v", 6))


@query("sig_06", f"""WITH x AS (SELECT wf_id, c, k, v[c * 16 + k + 1] AS x FROM ({WAVES}), range(0, 4) r(c), range(0, 16) q(k)), y AS (SELECT wf_id, c, k, (x - avg(x) OVER (PARTITION BY wf_id, c)) * CASE WHEN least(k, 15 - k) < 1.5 THEN 0.5 * (1 + cos(pi() * (least(k, 15 - k) / 1.5 - 1))) ELSE 1 END AS y FROM x)
SELECT wf_id, c * 16 + k AS pos, round(y / -min(y) OVER (PARTITION BY wf_id), 6) AS x FROM y""")
def _(s, d):
    w = G.normalize(G.taper(T.waveforms(s, d), 4, 16, 0.2)).select("wf_id", F.posexplode("v").alias("p", "x"))
    return w.select("wf_id", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("sig_07", f"""WITH x AS (SELECT wf_id, c, k, v[c * 16 + k + 1] AS x FROM ({WAVES}), range(0, 4) r(c), range(0, 16) q(k)), m AS (SELECT j, k, j / 3.0 - k AS z FROM range(0, 46) a(j), range(0, 16) b(k)), h AS (SELECT j, k, CASE WHEN abs(z) > 10 THEN 0 ELSE (CASE WHEN abs(z) < 1e-9 THEN 1 ELSE sin(pi() * z) / (pi() * z) END) * (0.5 + 0.5 * cos(pi() * z / 10)) END AS h FROM m)
SELECT wf_id, c * 46 + j AS pos, round(sum(x * h), 5) AS x FROM x JOIN h USING (k) GROUP BY wf_id, c, j""")
def _(s, d):
    w = B.apply_matrix(T.waveforms(s, d).select("wf_id", "v"), B.resample_matrix(16, 3, 1), 4).select("wf_id", F.posexplode("v").alias("p", "x"))
    return w.select("wf_id", F.col("p").cast("long").alias("pos"), F.round("x", 5).alias("x"))


_SINC = "h0 AS (SELECT j, k, sub, j - k - sub / 4.0 AS z FROM range(0, 16) a(j), range(0, 16) b(k), range(0, 4) e(sub)), h1 AS (SELECT j, k, sub, CASE WHEN abs(z) < 1e-12 THEN 1 ELSE sin(pi() * z) / (pi() * z) END AS h FROM h0), h AS (SELECT j, k, sub, CASE WHEN sub = 0 THEN CASE WHEN j = k THEN 1 ELSE 0 END ELSE h / sqrt(sum(h * h) OVER (PARTITION BY j, sub)) END AS h FROM h1)"


@query("sig_09", f"WITH x AS (SELECT wf_id, c, k, v[c * 16 + k + 1] AS x FROM ({WAVES}), range(0, 4) r(c), range(0, 16) q(k)), {_SINC} SELECT wf_id, c * 16 + j AS pos, round(sum(x * h), 5) AS x FROM x JOIN h USING (k) WHERE sub = 1 GROUP BY wf_id, c, j")
def _(s, d):
    w = B.apply_matrix(T.waveforms(s, d).select("wf_id", "v"), B.sinc_shift_matrix(16, 0.25), 4).select("wf_id", F.posexplode("v").alias("p", "x"))
    return w.select("wf_id", F.col("p").cast("long").alias("pos"), F.round("x", 5).alias("x"))


@query("sig_10", f"WITH m AS {_MEANS}, x AS (SELECT unit, (k - 1) // 16 AS c, (k - 1) % 16 AS k, x FROM m), {_SINC} SELECT unit, sub, c * 16 + j AS pos, round(sum(x * h), 5) AS x FROM x JOIN h USING (k) GROUP BY unit, sub, c, j")
def _(s, d):
    w = B.subsample_versions(M.templates(T.waveforms(s, d)), 4, 16, 4).select("unit", "sub", F.posexplode("v").alias("p", "x"))
    return w.select("unit", "sub", F.col("p").cast("long").alias("pos"), F.round("x", 5).alias("x"))


@query("sig_11", f"WITH x AS ({SIGNAL}) SELECT a.channel AS c1, b.channel AS c2, b.t - a.t AS lag, round(sum(a.v * b.v), 4) AS xc FROM x a JOIN x b ON b.t - a.t BETWEEN 0 AND 5 AND a.channel <= b.channel GROUP BY 1, 2, 3")
def _(s, d):
    return B.xcorr(_blocks(s, d)[0], 5).withColumn("xc", F.round("xc", 4))


# covariances over noise epochs: 31 to 90 samples from every 100th, by start or by hash


def _noise(s, d):
    x = T.signal(s, d)
    k = F.col("id")
    return x, s.range(T.signal_length(s, d) // 100).select((100 * k + 1).alias("s"), (100 * k + 1 + k % 60).alias("e"))


def _cov_sql(order: str, most: int) -> str:
    return f"""sig AS ({SIGNAL}), n AS (SELECT max(t) AS n FROM sig), ep AS (SELECT 100 * k + 1 AS s, 100 * k + 1 + k % 60 AS e FROM (SELECT unnest(range(0, n // 100)) AS k FROM n)), fit AS (SELECT s, e, e - s + 1 AS n FROM ep WHERE e - s + 1 >= 3),
run AS (SELECT *, coalesce(sum(n) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fit), used AS (SELECT * FROM run WHERE before <= {most}), ins AS (SELECT s AS epoch, channel, t, v FROM used JOIN sig ON t BETWEEN s AND e),
cv AS (SELECT a.channel AS c1, b.channel AS c2, b.t - a.t AS lag, sum(a.v * b.v) / (SELECT sum(n) FROM used) AS cov FROM ins a JOIN ins b ON a.epoch = b.epoch AND b.t - a.t BETWEEN 0 AND 3 AND a.channel <= b.channel GROUP BY 1, 2, 3)"""


@query("cov_01", f"WITH {_cov_sql('s, e', 100000)} SELECT c1, c2, lag, round(cov, 5) AS cov FROM cv WHERE abs(c1 - c2) <= 2")
def _(s, d):
    x, epochs = _noise(s, d)
    return B.epoch_xcorr(x, epochs, 3, B.MAX_SAMPLES, {c: [float(c)] for c in range(4)}, 2.0).withColumn("cov", F.round("cov", 5))


@query("cov_02", f"WITH {_cov_sql('md5(CAST(s AS VARCHAR)), s', 100000)} SELECT c1, c2, lag, round(cov, 5) AS cov FROM cv")
def _(s, d):
    x, epochs = _noise(s, d)
    return B.epoch_xcorr(x, epochs, 3, order=[F.md5(F.col("s").cast("string")), "s"]).withColumn("cov", F.round("cov", 5))


@query("cov_03", f"""WITH {_cov_sql('s, e', 100000)}, m AS (SELECT c1, c2, lag, cov FROM cv UNION ALL SELECT c2, c1, -lag, cov FROM cv WHERE NOT (c1 = c2 AND lag = 0)), z AS (SELECT c1, c2, k, k + lag AS j, cov FROM m, range(0, 3) r(k) WHERE abs(lag) < 3 AND k + lag BETWEEN 0 AND 2)
SELECT 'time' AS layout, c1 * 3 + k AS row, c2 * 3 + j AS col, round(cov, 5) AS value FROM z UNION ALL SELECT 'channel', k * 4 + c1, j * 4 + c2, round(cov, 5) FROM z""")
def _(s, d):
    cov = B.epoch_xcorr(*_noise(s, d), 3)
    one = lambda kind: B.embedded(cov, 4, 3, kind).select(F.lit(kind).alias("layout"), "row", "col", F.round("value", 5).alias("value"))
    return one("time").unionByName(one("channel"))


@query("cov_04")
def _(s, d):
    c = B.dense(B.embedded(B.epoch_xcorr(*_noise(s, d), 15), 4, 16), 64)
    import numpy as np

    return B.whiten(T.waveforms(s, d).select("wf_id", "v"), c + 1e4 * np.eye(64))


@query("cov_05")
def _(s, d):
    import numpy as np

    x, _, n = _low(s, d)
    lags = B.lag_blocks(B.estimate_covariance(x, M.mad(x), n, 15, margin=8, threshold=3.0, min_dist=8, max_dist=None), 4, 16)
    lags[0] += 1e4 * np.eye(4)
    return B.solve_lags(T.waveforms(s, d).select("wf_id", "v"), lags)


# noise and detection, on the signal less 70


def _low(s, d):
    x = T.signal(s, d).withColumn("v", F.col("v") - 70)
    n = T.signal_length(s, d)
    return x, B.to_blocks(x, n, channels=list(range(T.CHANNELS))), n


_LOW = f"""{_GRID}, low AS (SELECT g.channel, g.t, coalesce(s.v - 70, 0) AS v FROM grid g LEFT JOIN sig s ON s.channel = g.channel AND s.t = g.t), md AS (SELECT channel, median(v - 70) AS m FROM sig GROUP BY 1), sg AS (SELECT channel, round(1.4826 * median(abs(v - 70 - m)), 6) AS sigma FROM sig JOIN md USING (channel) GROUP BY 1),
cand AS (SELECT channel, t, -v AS h FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM low WINDOW w AS (PARTITION BY channel ORDER BY t)) JOIN sg USING (channel) WHERE v <= a AND v <= b AND -v > 3.0 * sigma), {_SUPPRESS.replace('DIST', '8')}, det AS (SELECT channel, t, -h AS amp FROM r WHERE it = (SELECT max(it) FROM r))"""


@query("det_02", f"WITH RECURSIVE {_LOW} SELECT channel, t, amp FROM det")
def _(s, d):
    x, b, n = _low(s, d)
    return B.detect(b, M.mad(x), n, 3.0, 8)


@query("det_02_stream", f"WITH RECURSIVE {_LOW} SELECT channel, t, amp FROM det")
def _(s, d):
    x, b, n = _low(s, d)
    path = scratch(s, "chunks")
    b.repartition(4, "block").write.parquet(path)  # chunks of a channel come in no order
    sigma = {r["channel"]: r["sigma"] for r in M.mad(x).collect()}
    return D.run_to_table(s, path, "channel int, block long, t0 long, v array<double>", lambda c: D.detect_stream(c, n, 3.0, 8, sigma), 2)


@query("det_03", f"""WITH RECURSIVE {_LOW}, i0 AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, channel, amp) < 4 THEN 0 ELSE 1 END AS n FROM det), i1 AS (SELECT *, sum(n) OVER (ORDER BY t, channel, amp ROWS UNBOUNDED PRECEDING) AS island FROM i0), p AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY t, channel, amp) AS k FROM i1),
w(island, k, grp, bt, ba) AS (SELECT island, k, k, t, amp FROM p WHERE k = 1 UNION ALL SELECT p.island, p.k, CASE WHEN p.t < bt + 4 THEN grp ELSE p.k END, CASE WHEN p.t >= bt + 4 OR abs(ba) <= abs(amp) THEN p.t ELSE bt END, CASE WHEN p.t >= bt + 4 OR abs(ba) <= abs(amp) THEN amp ELSE ba END FROM w JOIN p ON p.island = w.island AND p.k = w.k + 1),
o AS (SELECT p.*, row_number() OVER (PARTITION BY p.island, grp ORDER BY amp, p.k) AS r FROM p JOIN w USING (island, k)) SELECT t, amp, channel FROM o WHERE r = 1""")
def _(s, d):
    x, b, n = _low(s, d)
    return B.detect_and_merge(b, M.mad(x), n, 3.0, 8, 4)


@query("det_06")
def _(s, d):
    x, b, n = _low(s, d)
    return B.noise_std(b, n, 1.5)


@query("det_07")
def _(s, d):
    x, b, n = _low(s, d)
    return B.noise_std(b, n, 1.5)


# templates


@query("wav_07", f"WITH x AS ({SIGNAL}), n AS (SELECT max(t) AS n FROM x), p AS (SELECT channel, t FROM x, n WHERE t % 25 = 1 AND t - (t - 1) // 500 * 500 >= 12 AND (t <= n - 12 OR ((t - 1) // 500 + 1) * 500 < n)) SELECT p.channel, p.t, k AS pos, coalesce(v, 0) AS v FROM p CROSS JOIN range(0, 12) r(k) LEFT JOIN x ON p.channel = x.channel AND x.t = p.t - 5 + k")
def _(s, d):
    x = T.signal(s, d)
    return P.cut_in_chunks(x, x.filter("t % 25 = 1").select("channel", "t"), T.signal_length(s, d), 12, 5, 500).select("channel", "t", "pos", "v")


@query("wav_09", f"WITH x AS ({SIGNAL}), g AS (SELECT unit % 10 AS unit, t - {FROM} + 1 AS t, event_id FROM ({GDF})), o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS k FROM g) SELECT unit, pos, round(median(coalesce(v, 0)), 6) AS x FROM (SELECT * FROM o WHERE k <= 50) e CROSS JOIN range(0, 24) r(pos) LEFT JOIN x ON x.channel = pos // 6 AND x.t = e.t - 2 + pos % 6 GROUP BY 1, 2")
def _(s, d):
    events = T.gdf(s, d).select((F.col("unit") % 10).alias("unit"), (F.col("t") - FROM + 1).alias("t"), "event_id")
    return P.estimate(T.signal(s, d), events, 4, 6, 2, 50).withColumn("x", F.round("x", 6))


@query("wav_13")
def _(s, d):
    return P.align_upsampled(T.waveforms(s, d), 4, 16).select("wf_id", "tau")


@query("wav_14", f"WITH w AS (SELECT wf_id, unit, k, max(v[c * 16 + k]) AS x FROM ({WAVES}), range(0, 4) r(c), range(1, 17) q(k) GROUP BY 1, 2, 3), own AS (SELECT wf_id, unit, arg_min(k, (-x, k)) AS k FROM w GROUP BY 1, 2), m AS (SELECT unit, (k - 1) % 16 + 1 AS k, max(x) AS x FROM {_MEANS} GROUP BY 1, 2), top AS (SELECT unit, arg_min(k, (-x, k)) AS m FROM m GROUP BY 1) SELECT wf_id, m - k AS tau FROM own JOIN top USING (unit)")
def _(s, d):
    return P.align_on_average_max(T.waveforms(s, d), 4, 16)


_SHIFTS = "h0 AS (SELECT s, j, k, j - k - s * 0.02 AS z FROM range(-250, 251) a(s), range(0, 16) b(j), range(0, 16) c(k)), h AS (SELECT s, j, k, CASE WHEN abs(z) < 1e-12 THEN 1.0 ELSE sin(pi() * z) / (pi() * z) END AS h FROM h0)"


@query("wav_14_interpolated", f"WITH m AS {_MEANS}, tp AS (SELECT unit, (k - 1) // 16 AS c, (k - 1) % 16 AS j, x FROM m), {_SHIFTS}, g AS (SELECT unit, s, c * 16 + k + 1 AS p, sum(x * h) AS g FROM tp JOIN h USING (j) GROUP BY 1, 2, 3), w AS (SELECT wf_id, unit, p, v[p] AS x FROM ({WAVES}), range(1, 65) r(p)), sc AS (SELECT wf_id, s, round(sum(x * g), 9) AS score FROM w JOIN g USING (unit, p) GROUP BY 1, 2) SELECT wf_id, round(arg_min(s, (-score, s)) * 0.02, 2) AS tau FROM sc GROUP BY 1")
def _(s, d):
    w = T.waveforms(s, d)
    return P.align_on_template(w, M.templates(w).select("unit", "v"), 4, 16, step=0.02).select("wf_id", F.round("tau", 2).alias("tau"))


_NORMAL_CDF = "ld AS (SELECT i, sum(ln(2 * i + 1)) OVER (ORDER BY i) AS l FROM range(0, 900) r(i))"


def _cdf(x: str) -> str:
    """The normal distribution function by its series, in SQL."""
    return f"(CASE WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 ELSE 0.5 + sign({x}) * (SELECT sum(exp(-({x}) * ({x}) / 2 - 0.5 * ln(2 * pi()) + (2 * i + 1) * ln(greatest(abs({x}), 1e-12)) - l)) FROM ld) END)"


def _quality_sql(shifts: int) -> str:
    return f"""WITH m AS {_MEANS}, {_NORMAL_CDF}, u AS (SELECT unit, (k - 1) // 16 AS c, (k - 1) % 16 AS k, x, 0.01 AS p FROM m UNION ALL SELECT -1, (k - 1) // 16, (k - 1) % 16, 0.0, 1 - 0.01 * (SELECT count(DISTINCT unit) FROM m) FROM range(1, 65) r(k)),
y AS (SELECT unit, s, c, k, p, coalesce((SELECT any_value(o.x) FROM u o WHERE o.unit = u.unit AND o.c = u.c AND o.k = u.k - s), 0) AS x FROM u, range(-{shifts}, {shifts + 1}) q(s)),
pr AS (SELECT a.unit AS u1, b.unit AS u2, s, any_value(a.p) AS p1, any_value(b.p) AS p2, sqrt(sum((a.x - b.x) ** 2)) AS n, sum(a.x * a.x) AS s1, sum(b.x * b.x) AS s2, sum(a.x * (a.x - b.x)) AS c1, sum(b.x * (a.x - b.x)) AS c2 FROM u a JOIN y b ON a.unit < b.unit AND a.c = b.c AND a.k = b.k GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY u1, u2 ORDER BY round(n, 9), abs(s), s) AS r FROM pr), z AS (SELECT u1, u2, p1, p2, (-ln(p1 / p2) + 0.5 * (s1 - s2)) / n AS thr, c1 / n AS m1, c2 / n AS m2 FROM best WHERE r = 1),
er AS (SELECT u1, u2, p1 * {_cdf('thr - m1')} + p2 * (1 - {_cdf('thr - m2')}) AS error FROM z) """


@query("wav_21", _quality_sql(0) + "SELECT CAST(u1 AS BIGINT) AS u1, CAST(u2 AS BIGINT) AS u2, round(error, 6) AS error FROM er")
def _(s, d):
    return P.quality_of_set(M.templates(T.waveforms(s, d)), 0.01).withColumn("error", F.round("error", 6))


@query("wav_21_min_dist", _quality_sql(3) + "SELECT CAST(u1 AS BIGINT) AS u1, CAST(u2 AS BIGINT) AS u2, round(error, 6) AS error FROM er")
def _(s, d):
    return P.quality_of_set(M.templates(T.waveforms(s, d)), 0.01, 4, 3).withColumn("error", F.round("error", 6))


@query("wav_21_total", _quality_sql(0) + "SELECT round(sum(error), 6) AS q, round(avg(error), 6) AS q_mean FROM er")
def _(s, d):
    return P.total_quality(P.quality_of_set(M.templates(T.waveforms(s, d)), 0.01)).select(F.round("q", 6).alias("q"), F.round("q_mean", 6).alias("q_mean"))


@query("wav_22", f"""WITH w AS (SELECT wf_id, v, list_position(v, list_min(v)) AS i FROM ({WAVES})), b AS (SELECT wf_id, v, i, CASE WHEN i BETWEEN 2 AND 63 THEN v[i - 1] - 2 * v[i] + v[i + 1] ELSE 0 END AS bend FROM w),
o AS (SELECT wf_id, v, i, bend, CASE WHEN bend > 0 THEN (v[i - 1] - v[i + 1]) / (2 * bend) ELSE 0 END AS off FROM b) SELECT wf_id, round(i - 1 + off, 6) AS place, round(v[i] - bend * off * off / 2, 6) AS value FROM o""")
def _(s, d):
    low = A.lowest_between(F.col("v"))
    return T.waveforms(s, d).select("wf_id", low.alias("low")).select("wf_id", F.round("low.place", 6).alias("place"), F.round("low.value", 6).alias("value"))


# clusters and merging; local groups are units modulo 3 with two channels each


def _local(s, d):
    return M.templates(T.waveforms(s, d)).withColumn("leg", (F.col("unit") % 3).cast("int"))


def _by_unit(s, d):
    w = T.waveforms(s, d)
    return M.principal_components(w, 2).join(w.select("wf_id", F.col("unit").cast("int").alias("leg")), "wf_id").select("leg", F.col("wf_id").alias("id"), F.array("pc1", "pc2").alias("x"))


@query("clu_02")
def _(s, d):
    return C.mean_shift_growing(_by_unit(s, d), 0.3, 10)


@query("clu_03")
def _(s, d):
    return C.mean_shift_growing(_by_unit(s, d), 0.3, 10, reach=3.0)


@query("mrg_01")
def _(s, d):
    return P.merge_similar(_local(s, d), 4, 0.01, 0.9, 0.5)


@query("mrg_03", f"WITH n AS (SELECT unit, count(*) AS n FROM ({WAVES}) GROUP BY 1), m AS {_MEANS} SELECT unit % 4 AS merged, k - 1 AS pos, round(sum(n * x) / sum(n), 6) AS x FROM m JOIN n USING (unit) GROUP BY 1, 2")
def _(s, d):
    w = T.waveforms(s, d)
    counts = w.groupBy("unit").agg(F.count("*").alias("n"))
    merged = counts.select("unit", (F.col("unit") % 4).alias("merged"))
    out = P.merged_templates(M.templates(w), counts, merged).select("merged", F.posexplode("v").alias("p", "x"))
    return out.select("merged", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("x"))


_DUPLICATES = f"""m AS {_MEANS}, c AS (SELECT unit, (k - 1) // 16 AS ch, min(x) AS lo, max(x) AS hi FROM m GROUP BY 1, 2), own AS (SELECT unit, unit % 3 AS leg FROM c GROUP BY 1 HAVING arg_min(ch, (lo, ch)) IN (unit % 3, unit % 3 + 1)),
f AS (SELECT unit, ch AS place, abs(lo) AS m FROM c UNION ALL SELECT unit, ch + 4, abs(hi) FROM c), v AS (SELECT own.leg, f.*, m > 0.3 * max(m) OVER (PARTITION BY unit) AS ok FROM f JOIN own USING (unit)),
p AS (SELECT a.leg AS g1, a.unit AS u1, b.leg AS g2, b.unit AS u2, a.m AS m1, b.m AS m2, a.ok AS ok1, b.ok AS ok2, a.place FROM v a JOIN v b ON a.place = b.place AND a.leg < b.leg),
z AS (SELECT g1, u1, g2, u2, count(*) FILTER (ok1 AND ok2) / least(count(*) FILTER (ok1), count(*) FILTER (ok2)) AS shared, corr(m1, m2) FILTER (ok1 OR ok2) AS correlation, max(abs(m1 - m2)) FILTER (ok1 OR ok2) / arg_min(greatest(m1, m2), (-abs(m1 - m2), place)) FILTER (ok1 OR ok2) AS difference, sum(m1) > sum(m2) AS first FROM p GROUP BY 1, 2, 3, 4)"""


def _pairs(s, d):
    groups = s.createDataFrame([(g, g + k) for g in range(3) for k in range(2)], "leg int, channel int")
    return P.similar_across_groups(P.in_own_group(_local(s, d), groups, 4, 16), min_shared=0.6, min_correlation=-0.9, max_difference=0.99)


@query("join_07", f"WITH {_DUPLICATES} SELECT g1, u1, g2, u2, round(correlation, 6) AS correlation, round(difference, 6) AS difference, first FROM z WHERE shared >= 0.6 AND (correlation IS NULL OR correlation > -0.9) AND difference < 0.99")
def _(s, d):
    return _pairs(s, d).select("g1", "u1", "g2", "u2", F.round("correlation", 6).alias("correlation"), F.round("difference", 6).alias("difference"), "first")


@query("mrg_02")
def _(s, d):
    g = T.gdf(s, d)
    events = g.select((F.col("unit") % 10 % 3).cast("int").alias("leg"), (F.col("unit") % 10).cast("int").alias("unit"), "t")
    return P.duplicates(_pairs(s, d), events, 10, 0.05)


@query("grp_01")
def _(s, d):
    # suppliers as the electrodes of probes of a hundred, ten by ten
    k = F.col("s_suppkey")
    at = T.table(s, d, "supplier").select(F.floor(k / 100).alias("probe"), k.alias("electrode"), (k % 10 * 17.5).alias("x"), (F.floor(k % 100 / 10) * 17.5).alias("y"))
    return P.probe_groups(at)


@query("grp_02", "SELECT k AS electrode, round((k % 8 + 0.5 * (k // 8 % 2)) * 17.5, 6) AS x, round(k // 8 * 17.5 * sqrt(3) / 2, 6) AS y FROM (SELECT s_suppkey AS k FROM supplier)")
def _(s, d):
    used = T.table(s, d, "supplier").select(F.col("s_suppkey").alias("electrode"))
    rows = used.agg(F.max("electrode")).first()[0] // 8 + 1
    return P.hexagonal_grid(s, rows, 8, 17.5).join(used, "electrode").select("electrode", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("grp_02_blocks", """WITH e AS (SELECT s_suppkey AS electrode, s_suppkey % 2 AS b, (s_suppkey // 2) % 5 * 17.5 + s_suppkey % 2 * 700 AS x, (s_suppkey // 10) * 1.5 AS y FROM supplier WHERE s_suppkey % 7 <> 3),
r AS (SELECT electrode, b, dense_rank() OVER (PARTITION BY b ORDER BY x) AS rx, dense_rank() OVER (PARTITION BY b ORDER BY y) AS ry FROM e)
SELECT CAST(p.rx AS INTEGER) AS rank_x, CAST(p.ry AS INTEGER) AS rank_y, p.electrode AS electrode_1, q.electrode AS electrode_2 FROM r p JOIN r q USING (rx, ry) WHERE p.b = 0 AND q.b = 1""")
def _(s, d):
    # suppliers as the electrodes of two blocks, far apart, with dead ones (keys of remainder 3 by 7) missing
    k = F.col("s_suppkey")
    at = T.table(s, d, "supplier").filter(k % 7 != 3).select(k.alias("electrode"), (F.floor(k / 2) % 5 * 17.5 + k % 2 * 700).alias("x"), (F.floor(k / 10) * 1.5).alias("y"))
    return P.matching_blocks(at)


@query("grp_02_swap", f"SELECT wf_id, CASE c WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE c END AS channel, k, round(v[c * 16 + k], 6) AS x FROM ({WAVES}), range(0, 4) r(c), range(1, 17) q(k)")
def _(s, d):
    w = T.waveforms(s, d).select("wf_id", F.posexplode(A.channels(F.col("v"), 4, 16)).alias("channel", "u")).select("wf_id", F.col("channel").cast("long").alias("channel"), F.posexplode("u").alias("k", "x"))
    out = P.swap_channels(w.select("wf_id", "channel", (F.col("k") + 1).cast("long").alias("k"), "x"), s.createDataFrame([(0, 2)], "a long, b long"))
    return out.withColumn("x", F.round("x", 6))


@query("plt_01", f"""WITH m AS {_MEANS}, l AS (SELECT a.unit AS u1, b.unit AS u2, a.k, b.x - a.x AS d, (a.x + b.x) / 2 AS mid, sqrt(sum((b.x - a.x) ** 2) OVER (PARTITION BY a.unit, b.unit)) AS n FROM m a JOIN m b ON a.k = b.k AND a.unit < b.unit), w AS (SELECT wf_id, unit, k, v[k] AS x FROM ({WAVES}), range(1, 65) r(k)),
p AS (SELECT u1, u2, unit, wf_id, sum((x - mid) * d) / any_value(n) AS x FROM l JOIN w USING (k) WHERE unit IN (u1, u2) GROUP BY 1, 2, 3, 4) SELECT u1, u2, unit, CAST(least(floor((x + 5) / 0.5), 19) AS BIGINT) AS bin, count(*) AS n FROM p WHERE abs(x) <= 5 GROUP BY 1, 2, 3, 4""")
def _(s, d):
    w = T.waveforms(s, d)
    return P.project_pairs(w, M.templates(w))


# generator


_U = "((CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) + 0.5) / 4294967296)"
_TRAINS = f"gaps AS (SELECT unit, k, -ln({_U.format(chr(39) + '0:' + chr(39) + ' || unit || ' + chr(39) + ':' + chr(39) + ' || k')}) / rate AS gap FROM (SELECT user_id AS unit, count(*) / 10.0 AS rate FROM events GROUP BY 1) q, LATERAL (SELECT unnest(range(1, CAST(2 * rate * 30 + 101 AS BIGINT))) AS k)), tr AS (SELECT unit, k, s FROM (SELECT unit, k, sum(gap) OVER (PARTITION BY unit ORDER BY k) AS s FROM gaps) WHERE s <= 30)"


def _rates(s, d):
    """Rates in events by a unit's share of the table: a tenth of its events a second."""
    return T.gdf(s, d).groupBy("unit").agg((F.count("*") / 10).alias("rate"))


@query("gen_01", f"WITH {_TRAINS} SELECT unit, k, round(s, 6) AS s FROM tr")
def _(s, d):
    return G.poisson_trains(s, _rates(s, d), 30.0).withColumn("s", F.round("s", 6))


@query("gen_02", f"WITH {_TRAINS} SELECT unit, k, round(s, 6) AS s FROM tr WHERE {_U.format(chr(39) + '0:keep:' + chr(39) + ' || unit || ' + chr(39) + ':' + chr(39) + ' || k')} < (sin(s) + 1) / 2")
def _(s, d):
    trains = G.poisson_trains(s, _rates(s, d), 30.0)
    return G.thin_by_rate(trains, (F.sin("s") + 1) / 2, 1.0).withColumn("s", F.round("s", 6))


_NORMAL = f"sqrt(-2 * ln({_U.format(chr(39) + '0:amp:' + chr(39) + ' || unit || ' + chr(39) + ':' + chr(39) + ' || k || ' + chr(39) + ':a' + chr(39))})) * cos(2 * pi() * {_U.format(chr(39) + '0:amp:' + chr(39) + ' || unit || ' + chr(39) + ':' + chr(39) + ' || k || ' + chr(39) + ':b' + chr(39))})"
_SPIKES = f"{_TRAINS}, sp AS (SELECT unit, k, CAST(floor(s * 1000) AS BIGINT) + 1 AS t FROM tr), gp AS (SELECT *, lead(t) OVER (PARTITION BY unit ORDER BY t, k) AS nx FROM sp), tn AS (SELECT unit, k, t, 1 + 0.1 * {_NORMAL} AS amp, CAST(floor({_U.format(chr(39) + '0:jitter:' + chr(39) + ' || unit || ' + chr(39) + ':' + chr(39) + ' || k')} * 5) AS BIGINT) + 1 AS jitter FROM gp WHERE nx IS NULL OR nx - t >= 3)"


def _spikes(s, d):
    return G.spike_trains(G.poisson_trains(s, _rates(s, d), 30.0), 1000.0, 0.1, 3, 5)


@query("gen_03", f"WITH {_SPIKES} SELECT unit, k, t, round(amp, 6) AS amp, jitter FROM tn")
def _(s, d):
    return _spikes(s, d).withColumn("amp", F.round("amp", 6))


@query("gen_04", f"WITH u AS (SELECT unit, count(*) AS n_spikes, round(avg(amp), 6) AS amp FROM ({GDF}) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY amp, unit) AS r, count(*) OVER () AS n FROM u WHERE n_spikes > (SELECT avg(n_spikes) FROM u)) SELECT DISTINCT unit, n_spikes, amp FROM r JOIN range(0, 5) q(i) ON r = round(1 + i * (n - 1) / 4)")
def _(s, d):
    from ..operators import events as E

    return G.select_units(E.unit_table(T.gdf(s, d)).withColumnRenamed("mean_amp", "amp"), "sweep", 5)


@query("gen_05", f"WITH m AS {_MEANS}, y AS (SELECT unit, (k - 1) // 16 AS c, (k - 1) % 16 AS k, x - avg(x) OVER (PARTITION BY unit, (k - 1) // 16) AS y FROM m) SELECT unit, c * 16 + k AS pos, round(y * CASE WHEN least(k, 15 - k) < 1.5 THEN 0.5 * (1 + cos(pi() * (least(k, 15 - k) / 1.5 - 1))) ELSE 1 END, 6) AS x FROM y")
def _(s, d):
    w = G.taper(M.templates(T.waveforms(s, d)), 4, 16, 0.2).select("unit", F.posexplode("v").alias("p", "x"))
    return w.select("unit", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("gen_06", f"WITH {_SPIKES}, m AS {_MEANS} SELECT (m.k - 1) // 16 AS channel, t + jitter - 4 + (m.k - 1) % 16 AS t, round(sum(amp * 10 * 0.5 * x), 5) AS v FROM tn JOIN m USING (unit) GROUP BY 1, 2")
def _(s, d):
    return G.artificial_units(_spikes(s, d), M.templates(T.waveforms(s, d)), 10.0, 0.5, 4, 16, 4).withColumn("v", F.round("v", 5))


@query("sorter")
def _(s, d):
    # from samples to units: the table's signal less 70, four channels in two groups
    x, b, n = _low(s, d)
    legs = s.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 2), (2, 3)], "leg int, channel int")
    found = Sorter(b, n, legs, scratch(s, "sorter"), Settings(threshold=3.0, min_dist=8, merge_dist=4, tf=16, cut_left=5, blank=8, bandwidth=5.0, least=5, dims=3, jitter=4))
    return found.units().groupBy("unit", "discarded").agg(F.count("*").alias("n"))
