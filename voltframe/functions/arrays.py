"""Column functions on waveform vectors: channels one after another, Tf samples each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(v: Column, c: int | Column, tf: int) -> Column:
    return F.slice(v, F.lit(c) * tf + 1 if isinstance(c, int) else c * tf + 1, tf)


def channels(v: Column, n: int, tf: int) -> Column:
    """Vector to list of channels."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.slice(v, c * tf + 1, tf))


def sub_time(v: Column, n: int, tf: int, first: int, size: int) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.slice(v, c * tf + first + 1, size)))


def sub_channels(v: Column, which: list[int], tf: int) -> Column:
    return F.concat(*[channel(v, c, tf) for c in which])


def to_time_embedding(v: Column, n: int, tf: int) -> Column:
    """Channel-major to sample-major."""
    return F.transform(F.sequence(F.lit(0), F.lit(n * tf - 1)), lambda i: F.get(v, (i % n) * tf + F.floor(i / n).cast("int")))


def to_channel_embedding(v: Column, n: int, tf: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n * tf - 1)), lambda i: F.get(v, (i % tf) * n + F.floor(i / tf).cast("int")))


def scale_channels(v: Column, factors: list[float], tf: int) -> Column:
    f = F.array(*map(F.lit, factors))
    return F.transform(v, lambda x, i: x * F.get(f, F.floor(i / tf).cast("int")))


def shift(v: Column, tau: int | Column, tf: int) -> Column:
    """Moves each channel of tf samples right by tau; zeros come in, the width stays, nothing passes into another channel."""
    return F.transform(v, lambda _, i: F.when((i % tf - tau).between(0, tf - 1), F.get(v, i - tau)).otherwise(0.0))


def shift_wide(v: Column, tau: int, n: int, tf: int, low: int, high: int) -> Column:
    """shift() without loss: channels grow by high samples at the right and by low at the left, for shifts from -low to high."""
    wide = tf + low + high
    at = lambda i: i % wide - low - tau
    return F.transform(F.sequence(F.lit(0), F.lit(n * wide - 1)), lambda i: F.when(at(i).between(0, tf - 1), F.get(v, F.floor(i / wide).cast("int") * tf + at(i))).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def arg(v: Column, extreme: Column) -> Column:
    """1-based place of the first element equal to extreme."""
    return F.array_position(v, extreme)


def lowest_between(v: Column) -> Column:
    """Place (from 0, with a fraction) and value of the lowest point of the parabola through the smallest sample (the first
    of equals) and its neighbours; at an end of v, or on a flat, the sample itself."""
    i = arg(v, F.array_min(v)).cast("int") - 1
    a, b, c = (F.get(v, i + k) for k in (-1, 0, 1))
    bend = a - 2 * b + c
    off = F.when((i > 0) & (i < F.size(v) - 1) & (bend > 0), (a - c) / (2 * bend)).otherwise(F.lit(0.0))
    return F.struct((i + off).alias("place"), (b - F.when(off != 0, bend * off * off / 2).otherwise(F.lit(0.0))).alias("value"))


def vectors(column) -> list:
    """Numpy vectors of an Arrow column of lists, without a Python object a value."""
    import numpy as np

    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def pieces(batches, rows: int):
    """Arrow batches in pieces of some rows, for rows that hold long lists."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
