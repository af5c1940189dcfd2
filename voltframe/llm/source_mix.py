"""Mixing sources to target sizes by pivotal dependent rounding, in DataFrame functions alone.

A source's target gives each of its documents the same expected number of copies, target / source size. Its whole
part is taken as it is; the fraction is rounded dependently: two fractional documents of a source meet, and words
of expected mass move from one to the other, in a random direction, until one of them is taken a further time or not
at all. Which direction is drawn so that every expectation stays what it was, and the words of both together stay
exactly the same, so that a source misses its target by the rounding of one last document only.

Meetings form a reduction tree: documents are dealt by hash into groups of about `fan`, a group is folded in order,
and what is left of it (one fractional document) goes up to a group of groups. A level is one shuffle of what was
left, so a source that holds most rows is spread like all others. Every level is a table in the shared folder.

Null and empty texts have no words: they are taken in whole parts only, and their words are 0. A null source is a
source of its own and comes last. Identical rows (identifier, source, size) are counted first and rounded as one
entry, which keeps their sum; rows without an identifier likewise. An empty table gives no rows. Only the named
columns are read. Draws are hashes of identifier, size, level and `seed`, so reruns and layouts agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .numbering import numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, FAN = (3.0, 1.0, 2.0), 1.5, 2.0, 64


def uniform(*parts: Column) -> Column:
    """A draw from [0, 1) that depends on the parts alone."""
    return F.xxhash64(*parts).bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, entries, place, target of sources (source, source_size, entries).

    Sources in code point order, null last, weigh `weights`, repeating, and share `share` times all sizes; where a
    share is above `most` times the source's size it stops there, and what is over is shared by weight among the rest,
    until none is above. Each round of that is one small aggregate; two numbers come to the driver.
    """
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight)
    level = 0.0
    budget = share * float(placed.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        over = F.col("weight") * level > F.col("source_size") * most
        held, free = placed.agg(F.sum(F.when(over, F.col("source_size") * most)), F.sum(F.when(~over, F.col("weight")))).first()
        now = (budget - (held or 0.0)) / free if free else level
        if not now > level:
            break
        level = now
    return placed.withColumn("target", F.least(F.col("source_size") * most, F.col("weight") * level)).drop("weight")


def _fold(entries: Column) -> Column:
    """Meetings of a group's entries in order: the one left and what was decided, with k more rows taken once more."""

    def taken(e: Column, more: Column) -> Column:
        return F.array(F.struct(e["doc_id"].alias("doc_id"), e["size"].alias("size"), e["n"].alias("n"), e["whole"].alias("whole"), (e["k"] + more).alias("k")))

    def meet(state: Column, b: Column) -> Column:
        a = state["left"]
        # words that b can give to a, and a to b, before one of them is settled
        up, down = F.least(a["size"] - a["mass"], b["mass"]), F.least(a["mass"], b["size"] - b["mass"])
        rises = b["draw"] < F.coalesce(F.try_divide(down, up + down), F.lit(0.0))
        fills, empties = a["size"] - a["mass"] <= b["mass"], a["mass"] <= b["size"] - b["mass"]
        settles = F.when(rises, fills).otherwise(empties)  # a is settled, else b
        mass = F.when(rises, F.when(fills, b["mass"] + a["mass"] - a["size"]).otherwise(a["mass"] + b["mass"])).otherwise(F.when(empties, a["mass"] + b["mass"]).otherwise(a["mass"] + b["mass"] - b["size"]))
        done = F.when(settles, taken(a, rises.cast("long"))).otherwise(taken(b, (~rises).cast("long")))
        return F.struct(F.when(settles, b).otherwise(a).withField("mass", mass).alias("left"), F.concat(state["done"], done).alias("done"))

    none = F.slice(F.transform(entries, lambda e: F.element_at(taken(e, F.lit(0).cast("long")), 1)), 1, 0)
    return F.aggregate(F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(1))), F.struct(F.element_at(entries, 1).alias("left"), none.alias("done")), meet)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, fan: int = FAN, seed: int = 11) -> DataFrame:
    """doc_id, size (words), source_size, target, copies, taken (words, copies counted) of each row."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    rows = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("entries"))
    per = materialize(targets(per, weights, share, most), "targets")

    one = rows.alias("r").join(per.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.doc_id", "r.size", "r.n", "p.place", "p.source_size", "p.target", F.ceil(F.col("p.entries") / fan).alias("groups"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    one = one.withColumn("whole", F.floor(rate)).withColumn("part", (rate - F.floor(rate)) * F.col("n"))
    one = one.withColumn("k", F.floor("part")).withColumn("mass", (F.col("part") - F.floor("part")) * F.col("size"))
    settled = (F.col("mass") <= 0) | (F.col("size") == 0)
    ends = [one.filter(settled).select("place", "doc_id", "size", "n", "whole", "k")]

    left = one.filter(~settled).withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), "groups"))
    groups = per.agg(F.max(F.ceil(F.col("entries") / fan))).first()[0] or 0
    level = 0
    while groups:
        draws = [uniform(F.lit(seed), F.lit(level), F.lit(x), "doc_id", "size") for x in ("order", "draw")]
        entry = F.struct(draws[0].alias("order"), "doc_id", F.col("size"), F.col("n"), F.col("whole"), F.col("k"), F.col("mass"), draws[1].alias("draw"))
        met = left.groupBy("place", "group").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        met = materialize(met.select("place", "group", _fold(F.col("entries")).alias("x")).select("place", "group", "x.left", "x.done"), "level")
        ends.append(met.select("place", F.explode("done").alias("x")).select("place", "x.*"))
        left = met.select("place", F.floor(F.col("group") / fan).alias("group"), "left.doc_id", "left.size", "left.n", "left.whole", "left.k", "left.mass")
        groups, level = 0 if groups == 1 else -(-groups // fan), level + 1
    last = (uniform(F.lit(seed), F.lit("last"), "doc_id", "size") * F.col("size") < F.col("mass")).cast("long")
    ends.append(left.filter("size > 0").select("place", "doc_id", "size", "n", "whole", (F.col("k") + last).alias("k")) if level else left.select("place", "doc_id", "size", "n", "whole", "k"))

    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    parts = F.array(F.struct((F.col("whole") + 1).alias("copies"), F.col("k").alias("rows")), F.struct(F.col("whole").alias("copies"), (F.col("n") - F.col("k")).alias("rows")))
    out = out.select("place", "doc_id", "size", F.explode(parts).alias("x")).filter("x.rows > 0")
    out = out.select("place", "doc_id", "size", "x.copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.rows"))))
    return out.join(per.select("place", "source_size", "target"), "place").select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
