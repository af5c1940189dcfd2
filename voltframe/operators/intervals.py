"""Algebra of closed integer intervals (epochs) with columns s and e, by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width in t of the cells in which runs are found.
CELL = 1 << 14


def merge(epochs: DataFrame, by: str = "series_id") -> DataFrame:
    """Unions overlapping epochs; those that only touch (e + 1 = s) stay apart."""
    w = Window.partitionBy(by).orderBy("s", "e")
    top = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = epochs.withColumn("_new", F.when(top.isNull() | (F.col("s") > top), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def flip(epochs: DataFrame, length: Column, begin: Column | None = None, by: str = "series_id") -> DataFrame:
    """Complement within begin .. length; gaps of one sample are dropped but at the end."""
    begin = F.lit(1) if begin is None else begin
    w = Window.partitionBy(by).orderBy("s", "e")
    gaps = epochs.select(by, F.coalesce(F.lag("e").over(w) + 1, begin).alias("s"), (F.col("s") - 1).alias("e")).filter("e - s >= 1")
    tail = epochs.groupBy(by).agg(F.max(F.struct("s", "e")).alias("x")).select(by, (F.col("x.e") + 1).alias("s"), length.alias("e")).filter("s <= e")
    return gaps.unionByName(tail)


def flip_merged(epochs: DataFrame, length: Column, begin: Column | None = None, by: str = "series_id") -> DataFrame:
    """flip() of merge() for epochs with s <= e, from one order of the epochs: a gap lies where one begins beyond the
    ends of all before it."""
    begin = F.lit(1) if begin is None else begin
    top = F.max("e").over(Window.partitionBy(by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    gaps = epochs.select(by, F.coalesce(top + 1, begin).alias("s"), (F.col("s") - 1).alias("e")).filter("e - s >= 1")
    tail = epochs.groupBy(by).agg(F.max("e").alias("x")).select(by, (F.col("x") + 1).alias("s"), length.alias("e")).filter("s <= e")
    return gaps.unionByName(tail)


def length(s: Column, e: Column) -> Column:
    return e - s + 1


def remove_short(epochs: DataFrame, least: int) -> DataFrame:
    return epochs.filter(length(F.col("s"), F.col("e")) >= least)


def make_max_len(epochs: DataFrame, most: int) -> DataFrame:
    """Trims longer epochs evenly, the odd sample at the front."""
    over = F.greatest(length(F.col("s"), F.col("e")) - most, F.lit(0))
    return epochs.withColumn("_d", over).withColumn("s", F.col("s") + F.ceil(F.col("_d") / 2)).withColumn("e", F.col("e") - F.floor(F.col("_d") / 2)).drop("_d")


def to_idx(epochs: DataFrame, by: str = "series_id") -> DataFrame:
    return epochs.select(by, F.explode(F.sequence("s", "e")).alias("idx"))


def from_binary(rows: DataFrame, flag: Column, by: str, t: str) -> DataFrame:
    """Runs of consecutive t with a true flag, as epochs. They are found by cells of t; only runs that touch a cell's
    border, two a cell at most, are put in order over a whole series."""
    true = rows.filter(flag).select(by, t).distinct().withColumn("_cell", F.floor(F.col(t) / CELL))
    own = Window.partitionBy(by, "_cell").orderBy(t)
    runs = true.withColumn("_g", F.col(t) - F.row_number().over(own)).groupBy(by, "_cell", "_g").agg(F.min(t).alias("s"), F.max(t).alias("e"))
    touches = (F.col("s") == F.col("_cell") * CELL) | (F.col("e") == (F.col("_cell") + 1) * CELL - 1)
    w = Window.partitionBy(by).orderBy("s")
    edge = runs.filter(touches).withColumn("_new", F.coalesce((F.lag("e").over(w) + 1 != F.col("s")).cast("int"), F.lit(1)))
    joined = edge.withColumn("_run", F.sum("_new").over(w)).groupBy(by, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.filter(~touches).select(by, "s", "e").unionByName(joined.select(by, "s", "e"))


def range_join(points: DataFrame, epochs: DataFrame, by: list[str], t: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the epochs that hold them: an equi-join on cells of `width` and a residual test, so that the
    cost follows the number of neighbours and not points x epochs."""
    cells = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width)))
    spread = epochs.filter("s <= e").withColumn("_cell", cells)
    keyed = points.withColumn("_cell", F.floor(F.col(t) / width))
    near = keyed.join(spread, [*by, "_cell"], how)
    inside = F.col(t).between(F.col("s"), F.col("e"))
    return (near.filter(inside) if how == "inner" else near).drop("_cell")


def find_points(points: DataFrame, epochs: DataFrame, by: str = "series_id", t: str = "t", width: int = 64) -> DataFrame:
    """Number (by start) of the first epoch that holds each point, 0 if none; for epochs that are disjoint."""
    ranked = epochs.withColumn("epoch", F.row_number().over(Window.partitionBy(by).orderBy("s", "e")))
    hit = range_join(points, ranked, [by], t, width).groupBy(by, t).agg(F.min("epoch").alias("epoch"))
    return points.join(hit, [by, t], "left").withColumn("epoch", F.coalesce("epoch", F.lit(0)))


def assign(values: DataFrame, edges: list[float], t: str = "t") -> DataFrame:
    """Interval k with edges[k] < t <= edges[k+1]; the first edge itself belongs to the first interval, t outside goes."""
    x = F.col(t)
    k = sum((F.when(x > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(1))
    return values.filter((x >= edges[0]) & (x <= edges[-1])).withColumn("interval", k)


def sessions(events: DataFrame, bounds: list[int], t: str = "t") -> DataFrame:
    """Session k for bounds[k-1] < t <= bounds[k], time counted from the bound."""
    x = F.col(t)
    k = sum((F.when(x > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    start = F.element_at(F.array(*map(F.lit, bounds)), k)
    return events.filter((x > bounds[0]) & (x <= bounds[-1])).withColumn("session", k).withColumn("t_session", x - start)
