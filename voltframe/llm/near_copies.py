"""Near copies: texts linked by a shingle similarity of at least `similarity`.

A text's set holds 64-bit hashes of its word shingles (fewer words: the whole sequence; no word: the empty set);
words are runs of other than white space, A-Z lower-cased. Equal sets are merged before anything is paired.

Candidates come from two searches. The covering SimHash tables of simhash.py give every pair of sets whose 64-bit
fingerprints differ in `radius` bits or fewer. That misses most pairs at a similarity of 0.8, whose fingerprints differ
in 10 bits at the median, so that BANDS bands of ROWS minimum hashes complement it: a pair of similarity s shares no
band with a chance of (1 - s**ROWS)**BANDS, 4 in 10,000 at 0.8. The texts of a bucket are put in the order of further
minimum hashes, and each is paired with the bucket's first text and with the one before it. So a bucket costs its
size and not its square, however many texts share a common passage. Near copies stand next to each other or to copies
of both in a bucket of one kind, and nearly always in a mixed one, as they share further minimum hashes too; a pair has
to be kept apart in every band that it shares to be missed. Recall is measured in the README.

What both searches miss an exact one finds: prefixes of the sets in one order of all hashes, of which only hashes of two
prefixes or more are sent on. Before a pair leaves its bucket the parities of the two sets have to allow the
similarity, so that a group of texts just below it costs few pairs and not its square.

Every candidate pair is decided by the Jaccard similarity of the two sets, so that no link is wrong, or, without
`exact`, by that of two sketches of BANDS * ROWS places (standard error 0.04 at 0.8), which spares the second look at
the texts. Components are transitive. Null and empty texts are equal; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, drop, materialize, worker_cache
from .simhash import RADIUS, SEED, bits_over_half, components, links, words_of

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
#: Polynomial hashes: an odd base, its inverse modulo 2**64, and the powers that are kept.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 16
#: Exact search: hashes shared by the prefixes of a pair, texts of a block, hashes counted at once in a task, bits of
#: the filter of common hashes, and the count from which a hash is common.
SHARED, BLOCK, COUNTED, FILTER_BITS, COMMON = 4, 1024, 1 << 21, 1 << 22, 16
#: Bits of a set's parities; bits (a power of two) of the filter of hashes of two prefixes; prefix hashes merged in a task.
PARITIES, REPEATED_BITS, MERGED = 512, 27, 1 << 22
#: Bits of the filter of rows: an odd multiple of 32,768, so that rows numbered by partition (in steps of a power of two)
#: do not fall together.
ROW_BITS = 1021 << 15


def _powers():
    """Fixed random values of the bytes, and the powers of BASE and of its inverse modulo 2**64, CHUNK of each."""
    import numpy as np

    held = worker_cache("near_copies", "powers")
    if "of" not in held:
        table = np.random.default_rng(SEED).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        up, down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(CHUNK - 1, np.uint64(x), np.uint64)))) for x in (BASE, INVERSE))
        held["of"] = table, up, down
    return held["of"]


def shingles(text: str | None, shingle: int = SHINGLE):
    """Sorted distinct hashes of a text's shingles, words joined by one space: differences of a polynomial over all bytes
    up to a shingle's end and up to its begin, divided by the power of its begin."""
    import numpy as np

    joined = b" ".join(words_of(text))
    if not joined:
        return np.zeros(0, np.uint64)
    data, u = np.frombuffer(joined, np.uint8), np.uint64
    table, up, down = _powers()
    total, carry, scale = np.zeros(len(data) + 1, u), u(0), 1
    for at in range(0, len(data), CHUNK):
        part = table[data[at : at + CHUNK]]
        part *= up[: len(part)]
        part *= u(scale)
        np.cumsum(part, out=part)
        part += carry
        total[at + 1 : at + 1 + len(part)] = part
        carry, scale = part[-1], scale * pow(BASE, CHUNK, 1 << 64) % (1 << 64)
    gaps = np.flatnonzero(data == 32)
    begin, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    size = min(shingle, len(begin))
    begin, end = begin[: len(begin) - size + 1], end[size - 1 :]
    h = total[end] - total[begin]
    h *= down[begin % CHUNK]
    if len(data) > CHUNK:
        h *= np.array([pow(INVERSE, CHUNK * k, 1 << 64) for k in range(len(data) // CHUNK + 1)], u)[begin // CHUNK]
    h ^= h >> u(31)
    h *= u(0xD6E8FEB86659FD93)
    h ^= h >> u(32)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def similarity_of(a, b) -> float:
    """Jaccard similarity of two sorted sets; empty sets are equal."""
    import numpy as np

    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _constants(places: int):
    """Fixed random values for the rounds of minimum_hashes() and the places of a key, by number of places."""
    import numpy as np

    held = worker_cache("near_copies", "constants", places)
    if "flip" not in held:
        held["flip"], held["factor"] = np.random.default_rng(SEED).integers(0, 1 << 63, (2, 2 * places), dtype=np.int64).astype(np.uint64)
    return held["flip"], held["factor"][:places] | np.uint64(1)


def minimum_hashes(own, places: int):
    """A sketch of `places` values of a nonempty set, of which two sets share each with a chance of their Jaccard similarity.

    In round r every element goes to one place, in the first `places` rounds by its hash, then all to the same place in
    turn. A place keeps the least (round, hash); rounds end when every place is taken, so that the cost is a set's size
    or, for small sets, that of some rounds, not size times places.
    """
    import numpy as np

    u, flip = np.uint64, _constants(places)[0]
    out = np.full(places, u(0xFFFFFFFFFFFFFFFF))
    first, step = 0, min(2 * places, -(-6 * places // len(own)))
    while first < 2 * places:
        last = min(2 * places, first + step)
        for at in range(0, len(own), 1 << 16):
            x = (own[None, at : at + (1 << 16)] ^ flip[first:last, None]) * u(0x9E3779B97F4A7C15)
            x ^= x >> u(29)
            x *= u(0xD6E8FEB86659FD93)
            turn = np.arange(first, last, dtype=np.uint64)[:, None]
            place = np.where(turn < u(places), ((x >> u(40)) * u(places)) >> u(24), turn - u(places)).astype(np.int64)
            np.minimum.at(out, place.ravel(), ((x & u(0xFFFFFFFF)) | (turn << u(32))).ravel())
        if out.max() < u(0xFFFFFFFFFFFFFFFF):
            break
        first = last
    return out


def band_keys(own, bands: int = BANDS, rows: int = ROWS):
    """(keys, next, sketch): one key a band, a hash of its minimum hashes; for each band three minimum hashes of the band
    after it, 16 bits each; 16 bits of every minimum hash, as bytes."""
    import numpy as np

    u = np.uint64
    x = minimum_hashes(own, bands * rows)
    x = (x ^ (x >> u(31))) * u(0x9E3779B97F4A7C15)
    x ^= x >> u(29)
    keys = (x * _constants(bands * rows)[1]).reshape(bands, rows).sum(1, dtype=np.uint64).view(np.int64)
    part = (x & u(0xFFFF)).reshape(bands, rows)
    after = np.roll(part, -1, axis=0)
    return keys, (after[:, 0] << u(32) | after[:, 1] << u(16) | after[:, 2]).view(np.int64), part.astype("<u2").tobytes()


def signatures(docs: DataFrame, row: str, text: str, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, prints: bool = True) -> DataFrame:
    """row, copy (hash of the set), n (its size), fp (SimHash of the set, with `prints`), keys, next, sketch.

    Rows with n = -1 name hashes (keys) that several different sets of a task hold, and in how many of them (next)."""
    names = ["row", "copy", "n", "fp", "keys", "next", "sketch"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        none = np.zeros(0, np.int64), np.zeros(0, np.int64), b""
        pool, size = {}, 0

        def repeated():
            if not pool:
                return
            key, count = np.unique(np.concatenate(list(pool.values())), return_counts=True)
            key, count = key[count > 1].view(np.int64), count[count > 1]
            for at in range(0, len(key), CHUNK):
                zero = pa.array([0], pa.int64())
                lists = [pa.array([x[at : at + CHUNK]], pa.list_(pa.int64())) for x in (key, count)]
                yield pa.RecordBatch.from_arrays([zero, zero, pa.array([-1], pa.int64()), zero, *lists, pa.array([b""], pa.binary())], names=names)

        for b in batches:
            copy, n, fp, keys = [], [], [], []
            for t in b.column(1).to_pylist():
                own = shingles(t, shingle)
                copy.append(xxh64_intdigest(own.tobytes(), SEED))
                if copy[-1] not in pool:
                    pool[copy[-1]], size = own, size + len(own)
                if size > COUNTED:
                    yield from repeated()
                    pool, size = {}, 0
                n.append(len(own))
                fp.append(bits_over_half(own) if prints else 0)
                keys.append(band_keys(own, bands, rows) if len(own) else none)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), signed(copy), pa.array(n, pa.int64()), signed(fp), pa.array([k for k, _, _ in keys], pa.list_(pa.int64())), pa.array([k for _, k, _ in keys], pa.list_(pa.int64())), pa.array([k for _, _, k in keys], pa.binary())],
                names=names,
            )
        yield from repeated()

    return docs.select(F.col(row).cast("long").alias("row"), F.col(text).alias("t")).mapInArrow(run, "row long, copy long, n long, fp long, keys array<long>, next array<long>, sketch binary")


def bucket_pairs(unique: DataFrame, similarity: float) -> DataFrame:
    """a, b: each text of a bucket with the bucket's first and with the one before it, where their sizes allow the similarity."""
    placed = unique.select("copy", "n", F.posexplode(F.arrays_zip("keys", "next")).alias("band", "x")).select("band", "x.keys", "x.next", "copy", "n")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            band, key, copy, n = (b.column(c).to_numpy() for c in (0, 1, 3, 4))
            if last is not None:  # the row before, and the first row of its bucket
                band, key, copy, n = (np.concatenate((x, y)) for x, y in zip(last, (band, key, copy, n), strict=True))
            fresh = np.concatenate(([True], (band[1:] != band[:-1]) | (key[1:] != key[:-1])))
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            at = np.flatnonzero(~fresh)
            a, z = np.concatenate((head[at], at[at - 1 != head[at]] - 1)), np.concatenate((at, at[at - 1 != head[at]]))
            if last is not None:
                a, z = a[z > 1], z[z > 1]
            fit = np.minimum(n[a], n[z]) >= np.maximum(n[a], n[z]) * (similarity - 1e-9)
            a, z = copy[a[fit]], copy[z[fit]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], names=["a", "b"])
            keep = [head[-1], len(key) - 1]
            last = [x[keep] for x in (band, key, copy, n)]

    rows = placed.repartition("band", "keys").sortWithinPartitions("band", "keys", "next", "copy")
    return rows.mapInArrow(run, "a long, b long")


def needed(n, similarity: float):
    """Hashes that a set of n shares at least with a similar one that is no smaller."""
    import numpy as np

    return np.ceil(np.asarray(n) * similarity - 1e-9).astype(np.int64)


def parities(own):
    """Whether the hashes of a set that have a remainder modulo PARITIES are odd in number, a bit each: two sets differ in
    as many hashes at least as these in bits."""
    import numpy as np

    return np.packbits((np.bincount((own >> np.uint64(8)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1).astype(np.uint8)).tobytes()


def prefixes(docs: DataFrame, row: str, text: str, common, shingle: int, similarity: float) -> DataFrame:
    """copy, n, bits (parities), keys: the first hashes of each text's set, common ones last; equal sets once a task, or
    more often."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        bits, seen = np.frombuffer(common.value, np.uint8), set()
        for b in batches:
            copy, n, odd, keys = [], [], [], []
            for t in b.column(0).to_pylist():
                own = shingles(t, shingle)
                c = xxh64_intdigest(own.tobytes(), SEED)
                if not len(own) or c in seen:
                    continue
                seen.add(c)
                at = (own % np.uint64(FILTER_BITS)).astype(np.int64)
                often = (bits[at >> 3] >> (at & 7)) & 1 > 0
                k = len(own) - int(needed(len(own), similarity)) + SHARED
                copy.append(c)
                n.append(len(own))
                odd.append(parities(own))
                keys.append(np.concatenate((own[~often][:k], own[often][: max(0, k - int((~often).sum()))])).view(np.int64))
            if len(seen) > CHUNK:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(copy, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(odd, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["copy", "n", "bits", "keys"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "copy long, n long, bits binary, keys array<long>")


def repeated_keys(first: DataFrame) -> bytes:
    """Filter by the leading REPEATED_BITS bits of the hashes in two prefixes or more; a few others do no harm."""
    total = first.agg(F.sum(F.size("keys"))).first()[0] or 0
    lead = min(REPEATED_BITS - 3, max(6, (total // MERGED).bit_length()))  # leading bits that name a merging task

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def dealt(keys):
            key = np.unique(np.concatenate(keys), return_counts=True)
            group = (key[0] >> np.uint64(64 - lead)).astype(np.int64)
            part = ((key[0] << np.uint64(lead)) >> np.uint64(32)).astype(np.uint32)
            cut = np.searchsorted(group, np.arange((1 << lead) + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            cells = [(part[a:z], key[1][a:z] > 1) for a, z in zip(cut[full], cut[full + 1], strict=True)]
            lists = [[p[~m].tobytes() for p, m in cells], [p[m].tobytes() for p, m in cells]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in lists)], names=["bucket", "once", "more"])

        held, size = [], 0
        for b in batches:
            held.append(b.column(0).flatten().to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= MERGED:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def merge(key, table):
        import numpy as np
        import pandas as pd

        join = lambda c: np.concatenate([np.frombuffer(x, np.uint32) for x in table[c]])
        once, more = np.sort(join("once")), join("more")
        once = once[np.concatenate((once[1:] == once[:-1], [False]))] if len(once) else once
        bits = np.zeros(1 << (REPEATED_BITS - lead), np.uint8)
        for x in (once, more):
            bits[x >> np.uint32(32 - REPEATED_BITS + lead)] = 1
        return pd.DataFrame({"bucket": [int(key[0])], "bits": [np.packbits(bits).tobytes()]})

    out, width = bytearray(1 << (REPEATED_BITS - 3)), 1 << (REPEATED_BITS - lead - 3)
    found = first.select("keys").mapInArrow(run, "bucket int, once binary, more binary").groupBy("bucket").applyInPandas(merge, "bucket int, bits binary")
    for k, own in found.toLocalIterator():
        out[k * width : (k + 1) * width] = own
    return bytes(out)


def shared_prefixes(first: DataFrame, repeated, similarity: float) -> DataFrame:
    """copy, n, bits, keys, ats: of prefixes() the hashes in the filter and their places, for sets that keep enough of them
    to share as many as a pair has to."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(repeated.value, np.uint8)
        for b in batches:
            keys = b.column(3)
            values, size = keys.flatten().to_numpy(), np.diff(keys.offsets.to_numpy())
            at = (values.view(np.uint64) >> np.uint64(64 - REPEATED_BITS)).astype(np.int64)
            own = (bits[at >> 3] >> (7 - (at & 7))) & 1 > 0
            of = np.repeat(np.arange(len(size)), size)
            enough = np.bincount(of[own], minlength=len(size)) >= np.minimum(SHARED, needed(b.column(1).to_numpy(), similarity))
            own &= enough[of]
            ends = np.concatenate(([0], np.cumsum(np.bincount(of[own], minlength=len(size))[enough]))).astype(np.int32)
            place = (np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size))[own]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (values[own], place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(pa.array(enough)) for c in range(3)), *lists], names=["copy", "n", "bits", "keys", "ats"])

    return first.select("copy", "n", "bits", "keys").mapInArrow(run, "copy long, n long, bits binary, keys array<long>, ats array<int>")


def apart(bucket, side, n, at, odd, similarity: float):
    """Yields (i, j): places of rows of one bucket, on different sides, whose sizes, places in the order and parities (odd,
    a row of numbers each) allow the similarity."""
    import numpy as np

    _, bucket = np.unique(bucket, return_inverse=True)
    order = np.lexsort((n, bucket))
    key, size = bucket[order] << 40, n[order]
    # from each row to the last of its bucket that is not too large
    stop = np.searchsorted(key + size, key + np.floor(size / similarity + 1e-9).astype(np.int64), side="right")
    room = stop - np.arange(len(order)) - 1
    done = np.concatenate(([0], np.cumsum(room)))
    a = 0
    while a < len(order):
        z = max(a + 1, int(np.searchsorted(done, done[a] + (1 << 20), side="right")) - 1)
        own = room[a:z]
        i = np.repeat(np.arange(a, z), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(done[a:z] - done[a], own)
        i, j = order[i], order[j]
        new = side[i] != side[j]
        i, j = i[new], j[new]
        # before one of the SHARED first hashes in common there are less than SHARED of them, and after it no more than are left
        most = np.minimum(n[i] - at[i], n[j] - at[j]) + SHARED - 1
        fit = most >= (n[i] + n[j]) * (similarity / (1 + similarity)) - 1e-6
        i, j = i[fit], j[fit]
        # sets that share enough differ in few hashes, and in no more parities
        few = np.floor((n[i] + n[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6)
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int64) <= few[k : k + (1 << 16)]
            if near.any():
                yield x[near], y[near]
        a = z


_BUCKET = "a long, b long, total long, key long, block int, class long, copy long, n long, at int, bits binary"


def _odd(bits):
    """Parities of an Arrow column, as rows of numbers."""
    import numpy as np

    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(bits), PARITIES // 64)


def _found(copy, n, i, j):
    """A batch of pairs in the columns of _BUCKET."""
    import numpy as np
    import pyarrow as pa

    of = lambda k, t: pa.nulls(len(i), t)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(copy[i], copy[j])), pa.array(np.maximum(copy[i], copy[j])), pa.array(np.maximum(n[i], n[j])), of(0, pa.int64()), of(0, pa.int32()), of(0, pa.int64()), of(0, pa.int64()), of(0, pa.int64()), of(0, pa.int32()), of(0, pa.binary())],
        names=[x.split()[0] for x in _BUCKET.split(", ")],
    )


def in_blocks(rows: DataFrame, similarity: float) -> DataFrame:
    """_BUCKET of rows (key, class, copy, n, at, bits): pairs (a, b, total: the larger size) within blocks of a key's texts,
    and the rows of keys that fill a block or more, with the number of their block."""
    names = [x.split()[0] for x in _BUCKET.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, before = None, 0  # rows of a block that may go on, and the rows of its key before them

        def settle(key, cls, copy, n, at, odd, number):
            block = number // BLOCK
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            size = np.diff(np.concatenate((start, [len(key)])))
            bucket, size = np.repeat(np.arange(len(start)), size), np.repeat(size, size)
            mixed = cls[start] != cls[np.concatenate((start[1:], [len(key)])) - 1]  # rows come by class
            many = np.flatnonzero(np.repeat(mixed, size[start]))
            if len(many):
                for i, j in apart(bucket[many], cls[many], n[many], at[many], odd[many], similarity):
                    yield _found(copy, n, many[i], many[j])
            long = (block > 0) | (size == BLOCK)
            if long.any():
                none = pa.nulls(int(long.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(key[long]), pa.array(block[long].astype(np.int32)), pa.array(cls[long]), pa.array(copy[long]), pa.array(n[long]), pa.array(at[long].astype(np.int32)), pa.array([x.tobytes() for x in odd[long]], pa.binary())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            new = [*(c.to_numpy() for c in b.columns[:5]), _odd(b.column(5))]
            all_ = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            key = all_[0]
            place = np.arange(len(key))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), place, 0))
            number = place - start + np.where(start == 0, before, 0)
            cut = len(key) - 1 - number[-1] % BLOCK
            if cut:
                yield from settle(*(x[:cut] for x in all_), number[:cut])
            held, before = [x[cut:] for x in all_], number[cut]
        if held is not None:
            yield from settle(*held, before + np.arange(len(held[0])))

    wanted = rows.select("key", "class", "copy", "n", "at", "bits").repartition("key").sortWithinPartitions("key", "class", "n", "copy")
    return wanted.mapInArrow(run, _BUCKET)


def between_blocks(rows: DataFrame, similarity: float) -> DataFrame:
    """_BUCKET with the pairs between different blocks of a key, but for two blocks of one class alone."""
    blocks = rows.groupBy("key", "block").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = blocks.alias("x"), blocks.alias("y")
    one = (F.col("x.low") == F.col("y.high")) & (F.col("x.high") == F.col("y.low"))
    reach = (F.col("x.most") >= F.col("y.least") * (similarity - 1e-9)) & (F.col("y.most") >= F.col("x.least") * (similarity - 1e-9))
    duos = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") < F.col("y.block")) & reach & ~one).select("x.key", F.col("x.block").alias("one"), F.col("y.block").alias("other"))
    sides = duos.select("key", "one", "other", F.explode(F.array("one", "other")).alias("block"))
    placed = sides.join(rows.select("key", "block", "class", "copy", "n", "at", "bits"), ["key", "block"])

    def run(batches):
        import numpy as np

        def settle(key, one, other, block, cls, copy, n, at, odd):
            bucket = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (other[1:] != other[:-1]))))
            for i, j in apart(bucket, cls, n, at, odd, similarity):
                new = block[i] != block[j]
                yield _found(copy, n, i[new], j[new])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [*(c.to_numpy() for c in b.columns[:8]), _odd(b.column(8))]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            change = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            if len(change):
                yield from settle(*(x[: change[-1] + 1] for x in held))
                held = [x[change[-1] + 1 :] for x in held]
        if held is not None:
            yield from settle(*held)

    wanted = placed.select("key", "one", "other", "block", "class", "copy", "n", "at", "bits").repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
    return wanted.mapInArrow(run, _BUCKET)


def prefix_pairs(keyed: DataFrame, similarity: float, put) -> DataFrame:
    """a, b: pairs of different classes among `keyed` (copy, n, bits, class, keys and, where some are left out, ats) whose prefixes share SHARED hashes, or all they need."""
    if "ats" in keyed.columns:
        rows = keyed.select("class", "copy", "n", "bits", F.explode(F.arrays_zip("keys", "ats")).alias("x")).select("class", "copy", "n", "bits", F.col("x.keys").alias("key"), F.col("x.ats").alias("at"))
    else:
        rows = keyed.select("class", "copy", "n", "bits", F.posexplode("keys").alias("at", "key"))
    buckets = put(in_blocks(rows, similarity), "buckets")
    found = buckets.filter("key is null")
    split = buckets.filter("key is not null")
    if not split.isEmpty():
        found = found.union(between_blocks(split, similarity))
    least = F.least(F.lit(SHARED), F.ceil(F.first("total") * similarity - 1e-9))
    return found.groupBy("a", "b").agg(F.count("*").alias("both"), least.alias("least")).filter("both >= least").select("a", "b")


def sets_of(docs: DataFrame, row: str, text: str, chosen: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """copy, items (the sorted set) for `chosen` (row, copy). A filter of fixed size picks the rows, so that no text is
    shuffled; the sets of a few others do no harm."""
    picked = docs.sparkSession.sparkContext.broadcast(bitmap(chosen, F.col("row"), ROW_BITS))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(picked.value, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False) % ROW_BITS
            own = b.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 > 0))
            for at in range(0, own.num_rows, 256):
                part = own.slice(at, 256)
                items = [shingles(t, shingle).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.list_(pa.int64()))], names=["row", "items"])

    rows = docs.select(F.col(row).cast("long").alias("row"), F.col(text).alias("t")).filter("row is not null")
    return rows.mapInArrow(run, "row long, items array<long>").join(chosen, "row").select("copy", "items")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    sides = pairs.join(sets.select(F.col("copy").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("copy").alias("b"), F.col("items").alias("y")), "b")
    both = sides.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.filter(F.col("both") >= (F.col("total") - F.col("both")) * (similarity - 1e-12)).select("a", "b")


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sketches (copy, sketch) agree in a share of `similarity` of their places."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).mean(1) >= similarity))

    side = lambda k, to: sketches.select(F.col("copy").alias(k), F.col("sketch").alias(to))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def covering_pairs(unique: DataFrame, radius: int) -> DataFrame:
    """a, b: links of the covering tables, between one text of each fingerprint, and of that to the others of its fingerprint."""
    of = unique.groupBy("fp").agg(F.min("copy").alias("first"), F.count("*").alias("size"))
    near = links(of.select("fp"), radius)
    named = lambda k: of.select(F.col("fp").alias(k), F.col("first").alias(f"{k}1"))
    apart = near.join(named("a"), "a").join(named("b"), "b").select(F.col("a1").alias("a"), F.col("b1").alias("b"))
    equal = unique.select("fp", F.col("copy").alias("b")).join(of.filter("size > 1"), "fp").filter("b != first").select(F.col("first").alias("a"), "b")
    return apart.union(equal)


def near_copies(docs: DataFrame, row: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, radius: int | None = RADIUS, exact: bool = True) -> DataFrame:
    """row, component_id: the same for texts connected by near copies; `row` identifies the rows.

    With `radius` None the covering tables are left out, which costs no link.
    """
    spark, held = docs.sparkSession, []

    def put(df, name):
        held.append(materialize(df, name))
        return held[-1]

    signed = put(signatures(docs, row, text, shingle, bands, rows, radius is not None), "signatures")
    marked = signed.filter("n >= 0")
    kept = ["row", "n", "fp", "keys", "next", *["sketch"] * (not exact)]
    unique = put(marked.groupBy("copy").agg(*[F.min("row").alias("row") if c == "row" else F.first(c).alias(c) for c in kept]).filter("n > 0"), "unique")
    pairs = bucket_pairs(unique, similarity)
    if radius is not None:
        found = covering_pairs(unique.select("copy", "fp"), radius)
        pairs = pairs.union(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    pairs = put(pairs.distinct(), "candidates")
    if exact:
        wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "copy")
        sets = put(sets_of(docs, row, text, unique.select("row", "copy").join(wanted, "copy", "left_semi"), shingle), "sets")
        linked = put(confirmed(pairs, sets, similarity), "links")
    else:
        linked = likely(pairs, unique.select("copy", "sketch"), similarity)
    root = components(linked)
    held.append(root)
    if exact:
        counts = signed.filter("n = -1").select(F.explode(F.arrays_zip("keys", "next")).alias("x")).groupBy("x.keys").agg(F.sum("x.next").alias("count"))
        often = spark.sparkContext.broadcast(bitmap(counts.filter(F.col("count") >= COMMON), F.col("keys"), FILTER_BITS))
        first = put(prefixes(docs, row, text, often, shingle, similarity), "prefixes")
        repeated = spark.sparkContext.broadcast(repeated_keys(first))
        some = shared_prefixes(first, repeated, similarity).groupBy("copy").agg(*[F.first(c).alias(c) for c in ("n", "bits", "keys", "ats")])
        keyed = some.join(root, F.col("copy") == F.col("node"), "left").select("copy", "n", "bits", F.coalesce("root", "copy").alias("class"), "keys", "ats")
        more = put(prefix_pairs(keyed, similarity, put), "further")
        if not more.isEmpty():
            wanted = more.select("a").union(more.select("b")).distinct().withColumnRenamed("a", "copy")
            sets = put(sets_of(docs, row, text, unique.select("row", "copy").join(wanted, "copy", "left_semi"), shingle), "sets")
            root = components(linked.union(confirmed(more, sets, similarity)))
            held.append(root)
    out = materialize(marked.select("row", "copy").join(root, F.col("copy") == F.col("node"), "left").select(F.col("row").alias(row), F.coalesce("root", "copy").alias("component_id")), "classes")
    for t in held:
        drop(t)
    return out
