"""Packing along a space-filling curve.

A document's ids are hashed into signed buckets and projected to `DIMS` dimensions by a fixed random matrix;
the mean position, squashed to a grid of 2**BITS cells a side, gives its Hilbert key. Documents are
range-sorted by that key and laid end to end along the curve, cut every `length` ids. Neighbouring documents
share sequences, and only the very last sequence can be short.

A null or empty text is the end id alone. Ties of the key are ordered by input row; repeated rows are packed
each. Rows with a null identifier are packed like others. An empty table gives no rows. Only the two named
columns are read. Heavy rows (ids) are written once to the shared folder and joined to their place by row
number; the sort and the running sum see 24 bytes a document. One total a partition goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, materialize, worker_cache
from .tokenizing import Encoder

LENGTH = 2048
DIMS, BITS, BUCKETS, SEED = 3, 16, 256, 7


def projection(vocabulary: int):
    """Row i: the place that one occurrence of id i pulls a document towards."""
    import numpy as np

    held = worker_cache("tokenizing", "projection", vocabulary)
    if "it" not in held:
        mixed = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        matrix = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))
        sign = np.where(mixed >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        held["it"] = (matrix[(mixed % np.uint64(BUCKETS)).astype(np.int64)] * sign[:, None]).astype(np.float32)
    return held["it"]


def hilbert_keys(cells):
    """Keys of integer points (n x DIMS, BITS bits each) along the Hilbert curve (Skilling's transform)."""
    import numpy as np

    x = [c.astype(np.int64) for c in np.asarray(cells).T]
    top = 1 << (BITS - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    key = np.zeros_like(t)
    for b in range(BITS - 1, -1, -1):
        for c in x:
            key = key << 1 | c >> b & 1
    return key


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n, key, ids (2 or 4 bytes each, little-endian, with the end id), width."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder, end = Encoder(tokenizer_path), end_id.to_bytes(4, "little")
        size = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        table, kind = projection(size), "<u2" if size <= 65_536 else "<u4"
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [x + end for x in encoder.encode([x or "" for x in part.column(2).to_pylist()])]
                n = np.array([len(x) // 4 for x in ids])
                flat = np.frombuffer(b"".join(ids), "<u4")
                place = np.add.reduceat(table[flat], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / np.sqrt(n)[:, None]
                cells = np.clip((np.arctan(place / 4) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                narrow = flat.astype(kind).tobytes()
                cut = np.concatenate(([0], np.cumsum(n))) * (2 if kind == "<u2" else 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(hilbert_keys(cells), pa.int64()), pa.array([narrow[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([2 if kind == "<u2" else 4] * len(n), pa.int32())],
                    names=["row", "doc_id", "n", "key", "ids", "width"],
                )

    return rows.mapInArrow(run, "row long, doc_id long, n long, key long, ids binary, width int")


def running_starts(light: DataFrame) -> DataFrame:
    """row, begin: ids before the row in the order of (key, row); one total a partition passes the driver."""

    def local(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            total = np.cumsum(n)
            if len(n):
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(before + total - n, pa.int64()), b.column("n"), pa.array(np.full(len(n), part), pa.int64())], names=["row", "begin", "n", "part"])
                before += int(total[-1])

    spark = light.sparkSession
    placed = materialize(light.repartitionByRange("key", "row").sortWithinPartitions("key", "row").mapInArrow(local, "row long, begin long, n long, part long"), "places")
    totals, before = [], 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("n")).collect()):
        totals.append((part, before))
        before += n
    bases = spark.createDataFrame(totals, "part long, base long")
    return placed.join(F.broadcast(bases), "part").select("row", (F.col("begin") + F.col("base")).alias("begin"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    coded = materialize(encode(docs, tokenizer_path, end_id, doc_id, text), "ids")
    starts = running_starts(coded.select("row", "n", "key"))

    def pieces(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out: list[tuple] = []
            for d, n, ids, width, begin in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "width", "begin")), strict=True):
                wide = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                at = 0
                while at < n:
                    offset = (begin + at) % length
                    size = min(n - at, length - offset)
                    out.append((d, at, size, crc32(wide[4 * at : 4 * (at + size)]), n, (begin + at) // length, offset))
                    at += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return coded.join(starts, "row").select("doc_id", "n", "ids", "width", "begin").mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
