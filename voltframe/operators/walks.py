"""Order-dependent walks over sorted events, a group at a time; groups are cut at gaps the walk cannot cross, so
that a train is spread over many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width in t of the cells in which neighbours of an event are looked up; wider for longer gaps.
CELL = 1 << 14


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by hash of keys, in as many partitions as the session shuffles into: a walk's time is in its steps, so that
    partitions must not be merged for holding few bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_group(rows: DataFrame, keys: list[str], order: list[str], schema: str, f: Callable) -> DataFrame:
    """f(columns by name) -> rows, for each group of `keys` in `order`. One shuffle and sort; only one group is held at
    a time, and small groups cost no call into pandas."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
        fields = [x.split() for x in schema.split(", ")]
        out_schema = pa.schema([(n, kinds[k]) for n, k in fields])
        at = [names.index(k) for k in keys]
        now, held = None, None

        def put(out):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), out_schema.types, strict=True)], schema=out_schema)

        for b in batches:
            if not b.num_rows:
                continue
            cols, out = [c.to_pylist() for c in b.columns], []
            key = list(zip(*(cols[k] for k in at), strict=True))
            cuts = [0, *(r for r in range(1, len(key)) if key[r] != key[r - 1]), len(key)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                part = [c[x:y] for c in cols]
                if held is not None and key[x] == now:
                    for own, more in zip(held, part, strict=True):
                        own.extend(more)
                    continue
                if held is not None:
                    out += f(dict(zip(names, held, strict=True)))
                now, held = key[x], part
            if out:
                yield put(out)
        if held is not None and (out := f(dict(zip(names, held, strict=True)))):
            yield put(out)

    return spread(rows, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def islands(rows: DataFrame, by: list[str], t: str, gap: int, order: list[str]) -> DataFrame:
    """Column `island`: t of the first event of the run of events whose successive distances are below `gap`.

    Neighbours are found in cells of t, a cell a task at most; only one row a cell is put in order over a whole series.
    """
    cell = max(CELL, 2 * gap)
    marked = rows.withColumn("_cell", F.floor(F.col(t) / cell))
    own = Window.partitionBy(*by, "_cell").orderBy(t, *order)
    last = marked.groupBy(*by, (F.col("_cell") + 1).alias("_cell")).agg(F.max(t).alias("_last"))
    marked = marked.withColumn("_p", F.lag(t).over(own))
    marked = marked.join(last, [*by, "_cell"], "left").withColumn("_p", F.coalesce("_p", "_last"))
    marked = marked.withColumn("_start", F.when(F.col("_p").isNull() | (F.col(t) - F.col("_p") >= gap), F.col(t)))
    cells = marked.groupBy(*by, "_cell").agg(F.max("_start").alias("_s"))
    carry = cells.withColumn("_carry", F.last("_s", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
    known = F.max("_start").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", known).join(carry, [*by, "_cell"]).withColumn("island", F.coalesce("island", "_carry")).drop("_cell", "_p", "_last", "_start", "_carry")


def merge_sessions(events: DataFrame, gap: int) -> DataFrame:
    """One event of a unit's run of events closer than gap: the most negative, or the largest if none is negative."""
    marked = islands(events, ["unit"], "t", gap, ["event_id"])
    return marked.groupBy("unit", "island").agg(F.when(F.min("amp") < 0, F.min_by("event_id", F.struct("amp", "event_id"))).otherwise(F.min_by("event_id", F.struct(-F.col("amp"), "event_id"))).alias("event_id"), F.count("*").alias("n_events")).drop("island")


def merge_detections(events: DataFrame, max_dist: int, by: list[str] | None = None) -> DataFrame:
    """by, t, amp, channel of one event for each group of detections close in time, over all channels (of each group `by`).

    A group grows while the next event is less than max_dist after the group's best event so far: a negative event
    takes the place of a positive one, else one of equal or larger size does. Kept is the most negative event of a
    group, or the largest if none is negative (of equals the first, in the order of t, channel, amp).
    """
    by = by or []
    marked = islands(events.select(*by, "t", "amp", "channel"), by, "t", max_dist, ["channel", "amp"])
    kind = lambda c: events.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"{c} {kind(c)}" for c in by), f"t long, amp double, channel {kind('channel')}"])
    rows = marked.select(*by, "island", "t", "channel", "amp")

    def run(batches):
        """A group is its best event and its most negative and largest ones: runs of any length need no more."""
        import pyarrow as pa

        now, best, low, high, types = None, None, None, None, None
        kept = lambda: (*now[:-1], *(low if low[1] < 0 else high))

        def put(out):
            order = [*range(len(by)), *(len(by) + k for k in range(3))]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], types[k]) for k in order], names=[*by, "t", "amp", "channel"])

        for b in batches:
            types, out = [*(b.schema.field(k).type for k in range(len(by))), pa.int64(), pa.float64(), b.schema.field("channel").type], []
            *keys, at, channels, amps = (c.to_pylist() for c in b.columns)
            for key, t, channel, amp in zip(zip(*keys, strict=True), at, channels, amps, strict=True):
                if key == now and t < best[0] + max_dist:
                    if best[1] > 0 > amp or abs(best[1]) <= abs(amp):
                        best = t, amp
                    if amp < low[1]:
                        low = t, amp, channel
                    if amp > high[1]:
                        high = t, amp, channel
                    continue
                if now is not None:
                    out.append(kept())
                now, best, low, high = key, (t, amp), (t, amp, channel), (t, amp, channel)
            if out:
                yield put(out)
        if now is not None:
            yield put([kept()])

    return spread(rows, [*by, "island"]).sortWithinPartitions(*by, "island", "t", "channel", "amp").mapInArrow(run, schema)


def peaks(signal: DataFrame) -> DataFrame:
    """Local maxima (plateaus too) of each channel, ends excluded; for samples that follow each other in cells of t."""
    cell = F.floor(F.col("t") / CELL)
    w = Window.partitionBy("channel", "_cell").orderBy("t")
    marked = signal.withColumn("_cell", cell)
    edge = lambda step, f: marked.groupBy("channel", (F.col("_cell") + step).alias("_cell")).agg(f("v", "t").alias(f"_e{step}"))
    near = marked.withColumn("_a", F.lag("v").over(w)).withColumn("_b", F.lead("v").over(w))
    near = near.join(edge(1, F.max_by), ["channel", "_cell"], "left").join(edge(-1, F.min_by), ["channel", "_cell"], "left")
    near = near.withColumn("_a", F.coalesce("_a", "_e1")).withColumn("_b", F.coalesce("_b", "_e-1"))
    return near.filter((F.col("v") >= F.col("_a")) & (F.col("v") >= F.col("_b"))).select("channel", "t", "v")


def suppress_peaks(found: DataFrame, min_dist: int, min_height: float) -> DataFrame:
    """Of neighbours closer than min_dist the smaller goes (of equals the left), again and again."""
    high = islands(found.filter(F.col("v") > min_height).select("channel", "t", "v"), ["channel"], "t", min_dist, [])

    def walk(x):
        t, v = x["t"], x["v"]
        live = list(range(len(t)))
        while True:
            lost = {b if v[a] > v[b] else a for a, b in zip(live, live[1:]) if t[b] - t[a] < min_dist}
            if not lost:
                return [(x["channel"][k], t[k], v[k]) for k in live]
            live = [k for k in live if k not in lost]

    kind = found.schema["channel"].dataType.simpleString()
    return by_group(high, ["channel", "island"], ["t"], f"channel {kind}, t long, v double", walk)


def match_trains(a: DataFrame, b: DataFrame, jitter: int) -> DataFrame:
    """Greedy one-to-one matches of two event sets by unit: tp, fp, fn; the tail of the longer train is not counted.

    No match crosses a gap of more than the jitter in the events of both, so a task walks a run, not a train. Up to
    where the first of the two trains ends every event is counted; the run that holds that end is walked until then.
    """
    both = a.select("unit", "t", F.lit(0).alias("side")).unionByName(b.select("unit", "t", F.lit(1).alias("side")))
    ends = both.groupBy("unit").agg(F.max(F.when(F.col("side") == 0, F.col("t"))).alias("_a"), F.max(F.when(F.col("side") == 1, F.col("t"))).alias("_b"))
    runs = islands(both, ["unit"], "t", jitter + 1, ["side"]).join(ends, "unit")

    def walk(x):
        last = x["_a"][0], x["_b"][0]
        if None in last or x["t"][0] > min(last):  # nothing is counted of units without one of the trains
            return []
        one, two = ([t for t, s in zip(x["t"], x["side"], strict=True) if s == k] for k in (0, 1))
        i = j = tp = fp = fn = 0
        while i < len(one) and j < len(two):
            if abs(one[i] - two[j]) <= jitter:
                tp, i, j = tp + 1, i + 1, j + 1
            elif one[i] < two[j]:
                fn, i = fn + 1, i + 1
            else:
                fp, j = fp + 1, j + 1
        # events left here are passed by where the other train goes on
        fn += len(one) - i if last[1] > x["t"][-1] else 0
        fp += len(two) - j if last[0] > x["t"][-1] else 0
        return [(x["unit"][0], tp, fp, fn)]

    kind = a.schema["unit"].dataType.simpleString()
    parts = by_group(runs, ["unit", "island"], ["t", "side"], f"unit {kind}, tp long, fp long, fn long", walk)
    sums = parts.groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return ends.select("unit").join(sums, "unit", "left").fillna(0, ["tp", "fp", "fn"]).select("unit", "tp", "fp", "fn")


def mark_overlaps(events: DataFrame, dist: int) -> DataFrame:
    """event_id of events in an overlap by the pairwise walk: of two trains the events at the front are compared, both
    are marked at dist or less, then the earlier moves on (the second train on equal times). So not every event within
    dist of another is marked; in_overlap() of the evaluation gives those.

    Two events meet at the front if the one before each in its train has moved on, which their times tell: no pair of
    trains is walked, and a task joins cells of time.
    """
    from .intervals import range_join

    before = F.lag("t").over(Window.partitionBy("unit").orderBy("t", "event_id"))
    x = events.select("unit", "t", "event_id").withColumn("before", before)
    one = x.select(F.col("unit").alias("u1"), F.col("t").alias("t1"), F.col("event_id").alias("e1"), F.col("before").alias("b1"))
    two = x.select(F.col("unit").alias("u2"), F.col("t").alias("t2"), F.col("event_id").alias("e2"), F.col("before").alias("b2"), (F.col("t") - dist).alias("s"), (F.col("t") + dist).alias("e"))
    front = (F.col("b1").isNull() | (F.col("b1") < F.col("t2"))) & (F.col("b2").isNull() | (F.col("b2") <= F.col("t1")))
    met = range_join(one, two, [], "t1", max(16, 4 * dist)).filter((F.col("u1") < F.col("u2")) & front)
    return met.select(F.explode(F.array("e1", "e2")).alias("event_id")).distinct()


def without_oscillations(events: DataFrame, by: list[str], max_dist: int, min_group: int, min_amp: float) -> DataFrame:
    """Drops groups of events at most max_dist apart, from the first large one on, if a channel has min_group large ones."""
    marked = islands(events, by, "t", max_dist + 1, ["event_id"]).withColumn("_big", (F.abs("amp") >= min_amp).cast("int"))
    so_far = Window.partitionBy(*by, "island").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("_in", F.max("_big").over(so_far)).withColumn("_n", F.sum("_big").over(Window.partitionBy(*by, "island", "channel")))
    worst = F.max("_n").over(Window.partitionBy(*by, "island"))
    return counted.withColumn("_n", worst).filter((F.col("_in") == 0) | (F.col("_n") < min_group)).select(events.columns)


def thin(events: DataFrame, refractory: int) -> DataFrame:
    """Drops the later event of a unit's smallest gap (of equals the first) until no gap is below the refractory period.

    Gaps only grow, so runs of events with short gaps are independent: a task holds one run, not a unit.
    """
    runs = islands(events.select("unit", "t", "event_id"), ["unit"], "t", refractory, ["event_id"])

    def walk(x):
        import heapq

        t = x["t"]
        after, kept = list(range(1, len(t) + 1)), [True] * len(t)
        heap = [(t[k + 1] - t[k], k, k + 1) for k in range(len(t) - 1)]
        heapq.heapify(heap)
        while heap and heap[0][0] < refractory:
            _, a, b = heapq.heappop(heap)
            if kept[a] and kept[b] and after[a] == b:
                kept[b] = False
                after[a] = c = after[b]
                if c < len(t):
                    heapq.heappush(heap, (t[c] - t[a], a, c))
        return [(u, time, e) for u, time, e, k in zip(x["unit"], t, x["event_id"], kept, strict=True) if k]

    return by_group(runs, ["unit", "island"], ["t", "event_id"], f"unit {events.schema['unit'].dataType.simpleString()}, t long, event_id long", walk)
