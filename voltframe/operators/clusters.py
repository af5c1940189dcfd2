"""Mean shift: with seeds spread over tiles of space, and with a bandwidth that grows for what is left over.

Neighbours come from cells of points as wide as the bandwidth, so that a step costs the points near a mean, not all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, settle
from . import walks

#: Coordinates that cells tell apart, bandwidths of a tile, seeds of a task.
DIMS, TILE, SEEDS = 3, 8, 20_000
#: Fine cells in a bandwidth at least and at most.
FINE = 4, 512


class Cells:
    """Points by cell of their first coordinates."""

    def __init__(self, data, width: float):
        import numpy as np

        self.data, self.width, self.dims = data, width, min(DIMS, data.shape[1]) if len(data) else 0
        at = np.floor(data[:, : self.dims] / width).astype(np.int64)
        order = np.lexsort(at.T[::-1])
        at = at[order]
        cut = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
        self.held = {tuple(at[a].tolist()): np.sort(order[a:z]) for a, z in zip(np.append(0, cut), np.append(cut, len(at)), strict=True)} if len(at) else {}

    def near(self, p, radius: float):
        """Places of the points in the cells that a ball touches, in order."""
        import itertools

        import numpy as np

        low, high = (np.floor((p[: self.dims] + s * radius) / self.width).astype(int).tolist() for s in (-1, 1))
        spans = [range(a, z + 1) for a, z in zip(low, high, strict=True)]
        found = [x for c in itertools.product(*spans) if (x := self.held.get(c)) is not None]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Plane:
    """Means of the points within a radius in a plane or on a line, from strips of fine cells: sums of points in order of
    cells give what lies inside for sure, so that only points of cells on the circle are looked at."""

    def __init__(self, data, radius: float):
        import numpy as np

        x = data if data.shape[1] == 2 else np.column_stack((data, np.zeros(len(data))))
        fine = np.clip(np.sqrt(len(x)) / 16, *FINE)
        self.dims, self.radius, self.width, self.low = data.shape[1], radius, radius / fine, x.min(0)
        at = np.floor((x - self.low) / self.width).astype(np.int64)
        self.shape = at.max(0) + 1
        cell = at[:, 0] * self.shape[1] + at[:, 1]
        order = np.argsort(cell, kind="stable")
        self.data, self.cells = x[order], np.unique(cell[order])
        self.begin = np.append(np.searchsorted(cell[order], self.cells), len(x))
        self.sums = np.concatenate((np.zeros((1, 2)), np.cumsum(self.data - self.low, 0)))

    def mean(self, p):
        """The mean of the points within the radius of p, p itself if there is none."""
        import numpy as np

        r, w = self.radius, self.width
        px, py = p[0] - self.low[0], (p[1] if self.dims == 2 else 0.0) - self.low[1]
        slack = 1e-9 * (r + abs(px) + abs(py))
        row = np.arange(max(0, int((px - r - slack) // w)), min(self.shape[0] - 1, int((px + r + slack) // w)) + 1)
        if not len(row):
            return p
        a, z = np.abs(row * w - px), np.abs((row + 1) * w - px)
        far, near = np.maximum(a, z), np.where((row * w <= px) & (px <= (row + 1) * w), 0.0, np.minimum(a, z))
        inner = np.sqrt(np.maximum(r * r - far * far, 0)) - slack
        outer = np.sqrt(np.maximum(r * r - near * near, 0)) + slack
        last, base = self.shape[1], row * self.shape[1]
        clip = lambda y: np.clip(y, 0, last).astype(np.int64)
        place = lambda y: self.begin[np.searchsorted(self.cells, base + y)]
        one, two = clip(np.ceil((py - inner) / w)), clip(np.floor((py + inner) / w))
        low, high = place(clip(np.floor((py - outer) / w))), place(clip(np.floor((py + outer) / w) + 1))
        two = np.maximum(one, two)
        some = (inner > 0) & (two > one)
        one, two = np.where(some, place(one), low), np.where(some, place(two), low)
        starts, sizes = np.concatenate((low, two)), np.concatenate((one - low, high - two))
        edge = self.data[np.arange(sizes.sum()) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)] - self.low
        edge = edge[((edge - (px, py)) ** 2).sum(1) <= r * r]
        n = int((two - one).sum()) + len(edge)
        if not n:
            return p
        return (((self.sums[two] - self.sums[one]).sum(0) + edge.sum(0)) / n + self.low)[: self.dims]


def _first_within(centres: list, p, radius: float) -> int | None:
    """The first centre closer than radius."""
    import numpy as np

    if not centres:
        return None
    hit = np.flatnonzero(((np.array(centres) - p) ** 2).sum(1) < radius * radius)
    return int(hit[0]) if len(hit) else None


def mean_shift(points: DataFrame, bandwidth: float, by: str = "leg", rounds: int = 100) -> DataFrame:
    """by, id, cluster (from 1, by falling size) of points (by, id, x): flat-kernel mean shift of every point.

    A point follows the mean of the points within the bandwidth until it moves less than a thousandth of it. Ends that
    agree to a hundredth of the bandwidth are one; in the order of their smallest identifiers, an end joins the nearest
    cluster's first end within half a bandwidth or begins a cluster.

    Space is dealt into tiles (of the first two coordinates), with a margin of one bandwidth. A task moves some of a
    tile's points until they stand or leave it, and those that left go to their new tile in the next round. A group
    may be of any size; a tile's points are sent to as many tasks as its seeds need. Distinct ends of a group are put
    in order by one task.
    """
    width = TILE * bandwidth
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    rows = points.select(by, "id", F.col("x").cast("array<double>").alias("x"))
    axis = lambda v, k, s=0.0: F.floor((F.coalesce(F.get(v, k), F.lit(0.0)) + s) / width)

    def cut(seeds: DataFrame) -> DataFrame:
        """How many tasks share a tile's seeds."""
        n = seeds.groupBy(by, axis("p", 0).alias("tx"), axis("p", 1).alias("ty")).agg(F.count("*").alias("n"))
        return n.select(by, "tx", "ty", F.ceil(F.col("n") / SEEDS).alias("shares"))

    def move(_, seeds, data):
        import numpy as np

        out = seeds.assign(done=False)
        if not len(seeds):
            return out[[by, "id", "p", "done"]]
        x = np.array(data["x"].tolist(), float)
        plane = Plane(x, bandwidth) if x.shape[1] <= 2 else None
        cells = Cells(x, bandwidth) if plane is None else None
        known: dict = {}

        def step(p):
            key = p.tobytes()
            if key not in known and plane is not None:
                known[key] = plane.mean(p)
            elif key not in known:
                pool = cells.near(p, bandwidth)
                inside = pool[((x[pool] - p) ** 2).sum(1) <= bandwidth * bandwidth]
                known[key] = x[inside].mean(0) if len(inside) else p
            return known[key]

        ends, done = [], []
        home = (seeds["tx"].iloc[0], seeds["ty"].iloc[0])
        for p in seeds["p"]:
            p, ended = np.array(p, float), False
            for _ in range(rounds):
                q = step(p)
                ended = bool(np.abs(q - p).max() < 1e-3 * bandwidth)
                p = q
                if ended or (np.floor(p[0] / width), np.floor(p[1] / width) if len(p) > 1 else 0) != home:
                    break
            else:
                ended = True
            ends.append(p.tolist())
            done.append(ended)
        out["p"], out["done"] = ends, done
        return out[[by, "id", "p", "done"]]

    reach = lambda k: F.explode(F.sequence(axis("x", k, -bandwidth), axis("x", k, bandwidth)))
    spread = rows.select(by, "x", reach(0).alias("tx")).select(by, "x", "tx", reach(1).alias("ty"))
    schema = f"{by} {kinds[by]}, id {kinds['id']}, p array<double>, done boolean"
    left, finished = rows.select(by, "id", F.col("x").alias("p")), []
    while True:
        shares = settle(cut(left))
        salted = left.select("*", axis("p", 0).alias("tx"), axis("p", 1).alias("ty")).join(shares, [by, "tx", "ty"]).select(by, "id", "p", "tx", "ty", F.pmod(F.xxhash64("id"), "shares").alias("salt"))
        sent = spread.join(shares, [by, "tx", "ty"]).select(by, "x", "tx", "ty", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("salt"))
        sent = sent.select(F.col(by).alias("_g"), "x", F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.col("salt").alias("_salt"))
        moved = settle(salted.groupBy(by, "tx", "ty", "salt").cogroup(sent.groupBy("_g", "_tx", "_ty", "_salt")).applyInPandas(move, schema))
        remove(shares)
        finished.append(moved.filter("done").select(by, "id", "p"))
        left = moved.filter("NOT done").select(by, "id", "p")
        if not left.take(1):
            break
    ends = finished[0]
    for more in finished[1:]:
        ends = ends.unionByName(more)
    ends = ends.withColumn("mode", F.transform("p", lambda v: F.round(v / (bandwidth * 0.01)).cast("long")))
    modes = ends.groupBy(by, "mode").agg(F.min("id").alias("first"), F.min_by("p", "id").alias("p"), F.count("*").alias("n"))

    def settle_modes(x):
        import numpy as np

        p = np.array(x["p"], float)
        cells = Cells(p, bandwidth / 2)
        own = np.full(len(p), -1)
        heads: list = []
        head = np.zeros(len(p), bool)
        for k in range(len(p)):
            pool = cells.near(p[k], bandwidth / 2)
            pool = pool[head[pool]]
            d = ((p[pool] - p[k]) ** 2).sum(1)
            if len(pool) and d.min() < (bandwidth / 2) ** 2:
                own[k] = own[pool[d.argmin()]]
            else:
                own[k] = len(heads)
                heads.append(k)
                head[k] = True
        size = np.bincount(own, weights=x["n"])
        rank = np.empty(len(size), int)
        rank[np.lexsort((np.arange(len(size)), -size))] = np.arange(1, len(size) + 1)
        return [(g, m, int(rank[o])) for g, m, o in zip(x[by], x["mode"], own, strict=True)]

    named = walks.by_group(modes.withColumn("mode", F.array_join(F.transform("mode", lambda v: v.cast("string")), ",")), [by], ["first"], f"{by} {kinds[by]}, mode string, cluster int", settle_modes)
    return ends.select(by, "id", F.array_join(F.transform("mode", lambda v: v.cast("string")), ",").alias("mode")).join(named, [by, "mode"]).select(by, "id", "cluster")


def mean_shift_growing(points: DataFrame, bandwidth: float, least: int, factor: float = 1.3, growths: int = 1, reach: float | None = None, by: str = "leg") -> DataFrame:
    """by, id, cluster (0: of fewer than `least` points; else by falling size) of points (by, id, x).

    From each point not visited yet, in the order of identifiers, the mean of the points within the bandwidth is
    followed until it moves less than a thousandth of it; points passed are visited and get a vote each time. A mean
    within half a bandwidth of a cluster joins it, centres weighted by points. A point belongs to the cluster with
    most votes (the first of equals). Members of clusters under `least` are then clustered once more, `growths` times,
    with a bandwidth `factor` times as wide. With `reach` only points within reach * bandwidth of a seed take part in
    its search.
    """

    def walk(x):
        import numpy as np

        data = np.array(x["x"], float)
        n, width = len(data), bandwidth
        fresh = np.ones(n, bool)
        centres: list = []
        weights: list = []
        votes: list = [{} for _ in range(n)]  # of each point: votes by cluster
        for turn in range(growths + 1):
            cells = Cells(data, width)
            for first in range(n):
                if not fresh[first]:
                    continue
                seed = data[first]
                mean, own = seed.copy(), {}
                while True:
                    pool = cells.near(mean, width)
                    near = ((data[pool] - mean) ** 2).sum(1) < width * width
                    if reach is not None:
                        near &= ((data[pool] - seed) ** 2).sum(1) <= (reach * width) ** 2
                    inside = pool[near]
                    for k in inside.tolist():
                        own[k] = own.get(k, 0) + 1
                    fresh[inside] = False
                    last, mean = mean, data[inside].mean(0)
                    if np.linalg.norm(mean - last) < 1e-3 * width:
                        break
                c = _first_within(centres, mean, width / 2)
                if c is None:
                    c = len(centres)
                    centres.append(mean)
                    weights.append(len(inside))
                else:
                    total = weights[c] + len(inside)
                    centres[c] = (weights[c] * centres[c] + len(inside) * mean) / total
                for k, m in own.items():
                    votes[k][c] = votes[k].get(c, 0) + m
            member = np.array([min(v, key=lambda c: (-v[c], c)) if v else 0 for v in votes], np.int64)
            size = np.bincount(member, minlength=len(centres))
            small = size < least
            if turn == growths or not small.any():
                break
            fresh = small[member]
            kept = np.flatnonzero(~small).tolist()
            new = {k: j for j, k in enumerate(kept)}
            centres, weights = [centres[k] for k in kept], [weights[k] for k in kept]
            votes = [{new[c]: m for c, m in v.items() if c in new} for v in votes]
            width *= factor
        order = sorted(np.flatnonzero(~small).tolist(), key=lambda k: (-size[k], k))
        name = {k: j for j, k in enumerate(order, 1)}
        return [(g, i, name.get(int(k), 0)) for g, i, k in zip(x[by], x["id"], member, strict=True)]

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return walks.by_group(points.select(by, "id", "x"), [by], ["id"], f"{by} {kinds[by]}, id {kinds['id']}, cluster int", walk)
