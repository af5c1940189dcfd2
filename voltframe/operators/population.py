"""The catalogue of units: building a population from sorted events, its checks, selections and storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import events as E
from .intervals import range_join


def create(gdf: DataFrame, frames: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with file, idx and absolute frame, and the table of files.

    gdf: unit, t (sample since the first file's start, from 1), event_id. files: file, n_samples, in order of file.
    frames: file, frame, ascending numbers of the samples that were recorded.
    """
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = files.withColumn("s", F.coalesce(F.sum("n_samples").over(w), F.lit(0)) + 1).withColumn("e", F.col("s") + F.col("n_samples") - 1)
    inside = range_join(gdf, starts.select("file", "s", "e"), [], "t", 1 << 14).withColumn("idx", F.col("t") - F.col("s") + 1).drop("s", "e")
    bounds = frames.groupBy("file").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    placed = E.frame_numbers(inside, bounds, E.missing_frames(frames, "file", "frame"), "file")
    return placed, starts.join(bounds, "file").select("file", "n_samples", "first", "last")


def units(gdf: DataFrame) -> DataFrame:
    """unit, n_spikes, mean_amp, first, last."""
    return gdf.groupBy("unit").agg(F.count("*").alias("n_spikes"), F.avg("amp").alias("mean_amp"), F.min("t").alias("first"), F.max("t").alias("last"))


def check(unit_table: DataFrame, footprints: DataFrame, noise: DataFrame, channels: int) -> dict[str, int]:
    """Counts of what is wrong: units without or with several footprints, footprints without unit, channels without noise deviation."""
    n = footprints.groupBy("unit").agg(F.count("*").alias("n"))
    return {
        "without_footprint": unit_table.join(n, "unit", "left_anti").count(),
        "several_footprints": n.filter("n > 1").count(),
        "without_unit": n.join(unit_table, "unit", "left_anti").count(),
        "without_noise": channels - noise.select("channel").distinct().count(),
    }


def by_index(unit_table: DataFrame, places: list[int]) -> DataFrame:
    """Units at places (from 1) of the ordered identifiers. A catalogue's identifiers are put in order in one pass."""
    ranked = unit_table.withColumn("_k", F.row_number().over(Window.orderBy("unit")))
    return ranked.filter(F.col("_k").isin(places)).drop("_k")


def by_id(unit_table: DataFrame, ids: list[int]) -> DataFrame:
    return unit_table.filter(F.col("unit").isin(ids))


def name(unit: Column) -> Column:
    """Unit with the group of 1,000 identifiers that it belongs to."""
    return F.concat(F.lit("unit "), unit.cast("string"), F.lit(" of group "), F.floor(unit / 1000).cast("string"))


def save(tables: dict[str, DataFrame], path: str) -> None:
    for k, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{k}")


def load(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(f"{path}/{k}") for k in names}


#: Pluggable steps, by kind: energy of detection, conditions of filters, merge steps, sources.
STEPS: dict[str, dict[str, Callable]] = {}


def step(kind: str, called: str):
    """Registers a user function under a kind and a name; a taken name is an error."""

    def put(f: Callable) -> Callable:
        own = STEPS.setdefault(kind, {})
        if called in own:
            raise ValueError(f"{kind} {called} is registered already")
        own[called] = f
        return f

    return put


@step("energy", "negative")
def _(x):
    return -x


@step("energy", "square")
def _(x):
    return x * x


@step("energy", "absolute")
def _(x):
    return F.abs(x) if isinstance(x, Column) else abs(x)
