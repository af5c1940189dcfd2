"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits: bit i is set if it is set in over half of the XXH64 hashes of the text's word shingles
(repeats included; fewer words: the whole sequence; no word: zero). Two fingerprints link at `radius` or fewer
differing bits. For the covering family every bit position gets a random vector of radius+1 bits; table v, for
each nonzero v, keeps the positions whose vector has an odd product with v. Any `radius` positions leave some v
orthogonal to all their vectors, so every pair within the radius agrees on all kept bits of at least one table:
no link is missed.

Equal fingerprints are merged before anything is paired. Within a bucket only a spanning forest of its links is
put out, never all pairs; large buckets are first divided on their free bits by the pigeonhole principle, which
is exact. Components come from rounds of large-star and small-star steps, each written to the shared folder.

Null and empty texts have fingerprint zero and link like any other. Rows with a null identifier get a
fingerprint but do not name a component unless it has no other identifier. Repeated rows share their fate. Only
the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

SHINGLE, RADIUS, SEED, BITS = 3, 3, 42, 64
#: Buckets up to this many distinct fingerprints are compared directly, in blocks.
DIRECT = 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than white space (0x20, 0x09 to 0x0D), A-Z lower-cased."""
    return text.encode().translate(_LOWER).split() if text else []


def bits_over_half(hashes) -> int:
    """Bits set in over half of the 64-bit hashes; 0 if there are none."""
    import numpy as np

    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
        begin = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        h = [xxh64_intdigest(joined[a:z], SEED) for a, z in zip(begin, ends[shingle - 1 :].tolist(), strict=True)]
    return bits_over_half(np.array(h, "<u8"))


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """2**(radius+1) - 1 masks of 64 bits such that any `radius` positions are clear in at least one."""
    import random

    rng = random.Random(seed)
    # spread evenly over the nonzero vectors, so that every table keeps about half of the bits
    vectors = [1 + k % ((2 << radius) - 1) for k in range(BITS)]
    rng.shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 << radius)]


def _forest(fps, radius: int, free: int):
    """Spanning forest (pairs of positions) of the links among distinct fingerprints that may differ in `free` bits."""
    import numpy as np

    n = len(fps)
    parent = np.arange(n)

    def roots(x):
        r = parent[x]
        while (parent[r] != r).any():
            r = parent[r]
        parent[x] = r
        return r

    def direct(rows):
        """Row by row, so that memory follows the rows and not their near pairs."""
        out, own = [], fps[rows]
        for k in range(len(rows) - 1):
            near = rows[k + 1 + np.flatnonzero(np.bitwise_count(own[k + 1 :] ^ own[k]) <= radius)]
            if len(near):
                mine = roots(rows[k : k + 1])[0]
                kinds, at = np.unique(roots(near), return_index=True)
                for other, j in zip(kinds.tolist(), at.tolist(), strict=True):
                    if other != mine:
                        parent[max(mine, other)] = mine = min(mine, other)
                        out.append((int(rows[k]), int(near[j])))
        return out

    def divide(rows, bits):
        if len(rows) <= DIRECT or len(bits) <= radius + 1:
            return direct(rows)
        # radius+1 groups of free bits: a pair within the radius agrees on one of them
        out = []
        for k in range(radius + 1):
            mask = np.uint64(sum(1 << i for i in bits[k :: radius + 1]))
            key = fps[rows] & mask
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    rest = [i for i in bits if not int(mask) >> i & 1]
                    out += direct(rows[part]) if len(part) == len(rows) else divide(rows[part], rest)
        return out

    return divide(np.arange(n), [i for i in range(BITS) if free >> i & 1])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: for each bucket of each table a spanning forest of the links among distinct fingerprints `fp`."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)]))
    rows = fps.select("fp", tables.alias("x")).select("x.table", "x.key", "fp").repartition("table", "key").sortWithinPartitions("table", "key", "fp")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def settle(t, k, f):
            """Links of complete buckets in sorted rows."""
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(t)]))
            out = []
            pairs = begin[end - begin == 2]
            near = np.bitwise_count(f[pairs] ^ f[pairs + 1]) <= radius
            out += zip(f[pairs[near]].tolist(), f[pairs[near] + 1].tolist(), strict=True)
            for a, z in zip(*((x[end - begin > 2]).tolist() for x in (begin, end)), strict=True):
                own = f[a:z]
                out += [(int(own[x]), int(own[y])) for x, y in _forest(own, radius, ~masks[int(t[a])] & ((1 << 64) - 1))]
            if out:
                both = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            # the last bucket may go on in the next batch
            change = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(change):
                cut = change[-1] + 1
                yield from settle(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None:
            yield from settle(*held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node connected to each node that has an edge. Large-star and small-star rounds, until
    nothing changes (every round lowers some node's neighbour, so that they end)."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
    now, last = materialize(edges.filter("a != b"), "edges"), None
    while True:
        # aggregate the least neighbour first, so that a hub never gathers its neighbours in one row
        wide = both(now)
        least = wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = wide.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
        lower = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a != b").distinct()
        new = materialize(small, "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop(now)
        now = new
        if state == last:
            break
        last = state
    out = materialize(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "components")
    drop(now)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest identifier reachable over links, its own included."""
    marked = materialize(with_fingerprints(docs, doc_id, text, shingle), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(least.select("fp"), radius))
    class_of = least.join(found, least.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # grouped and joined, not windowed, so that one large component does not meet in one task
    named = class_of.join(class_of.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
