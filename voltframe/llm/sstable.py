"""Token-ID output as sorted-string-table shards.

A shard holds documents in ascending order of their identifier. File layout:

    blocks   each: zstd of entries (shared, unshared, value length as varints; key suffix; value), keys
             sharing the prefix of the key before; about `block_bytes` of entries
    filter   Bloom filter of the keys, 10 bits a key, 7 probes
    index    for each block: first key, offset, length
    footer   fixed size: offsets and lengths of filter and index, entries, tokens, bytes an id, magic

Keys are identifiers as 8 bytes big-endian with the sign bit flipped, so that byte order is number order; a
null identifier is the empty key and sorts first. Values are ids of 2 bytes where the vocabulary fits, else 4.
A null text counts as empty and holds the end id alone. Rows with equal identifiers are all kept, ordered by
text, and lookup returns all of them. An empty table gives no shard. Only the two named columns are read.

The writer range-partitions by identifier, so that each task streams one shard with one block in memory. Tasks
write under names of their own attempt and only files named by a successful attempt are in the manifest, so
retried or speculative tasks leave nothing that is read.
"""

from __future__ import annotations

import bisect
import struct

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32, filesystem, new_path
from .tokenizing import Encoder

MAGIC = b"VFSSTAB1"
FOOTER = "<QQQQQQI8s"
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key, seed=0)
    step = xxhash.xxh64_intdigest(key, seed=1) | 1
    return [((h + k * step) & ((1 << 64) - 1)) % bits for k in range(BLOOM_PROBES)]


class Writer:
    """Writes one shard to a binary file object; add() takes keys in ascending order."""

    def __init__(self, out, id_bytes: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.at = self.entries = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._clear()

    def _clear(self):
        self.block, self.size, self.first, self.last = [], 0, None, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is None:
            self.first = key
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [head, value]
        self.size += len(head) + len(value)
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.tokens += len(value) // self.id_bytes
        if self.size >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self):
        if self.first is not None:
            self.index.append((self.first, *self._put(self.pack(b"".join(self.block)))))
        self._clear()

    def finish(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * self.entries)
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        filter_at = self._put(_varint(bits) + bytes(bloom))
        index_at = self._put(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index))
        self._put(struct.pack(FOOTER, *filter_at, *index_at, self.entries, self.tokens, self.id_bytes, MAGIC))


class Reader:
    """Reads one shard from a seekable binary file object."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - struct.calcsize(FOOTER))
        *where, self.entries, self.tokens, self.id_bytes, magic = struct.unpack(FOOTER, source.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.filter_at, index_at = where[:2], where[2:]
        data, at, self.index = self._get(*index_at), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            self.index.append((key, offset, size))
        self.firsts = [k for k, _, _ in self.index]
        self.bloom: tuple[int, bytes] | None = None

    def _get(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, k: int):
        data, at, key = self.unpack(self._get(*self.index[k][1:])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + n], at + n
            yield key, data[at : at + size]
            at += size

    def scan(self):
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            bits, at = _read_varint(data := self._get(*self.filter_at), 0)
            self.bloom = bits, data[at:]
        bits, bloom = self.bloom
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits))

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key: a filter probe, then binary search in the block index."""
        if not self.index or not self.may_hold(key):
            return []
        out = []
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.index)):
            if self.firsts[k] > key:
                break
            out += [v for x, v in self.block(k) if x == key]
        return out


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> list[dict]:
    """Writes the shards below `out`, a folder that driver and executors share; returns the manifest in key order."""

    def write(batches):
        import pyarrow as pa

        encoder = writer = handle = None
        end = end_id.to_bytes(4, "little")
        name = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.sst"
        first = last = None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                import numpy as np

                encoder = Encoder(tokenizer_path)
                narrow = encoder.tokenizer.get_vocab_size() <= 65_536 and end_id < 65_536
                fs, base = filesystem(out)
                fs.create_dir(base, recursive=True)
                handle = fs.open_output_stream(f"{base}/{name}")
                writer = Writer(handle, 2 if narrow else 4, block_bytes)
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys = [key_of(x) for x in part.column(0).to_pylist()]
                for key, ids in zip(keys, encoder.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    writer.add(key, np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids)
                first = keys[0] if first is None else first
                last = keys[-1]
        if writer is not None:
            writer.finish()
            handle.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "n_docs": [writer.entries], "n_tokens": [writer.tokens], "first_key": [first], "last_key": [last]})

    rows = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t"))
    done = rows.repartitionByRange("k").sortWithinPartitions(F.asc_nulls_first("k"), F.asc_nulls_first("t")).mapInArrow(write, "part long, name string, n_docs long, n_tokens long, first_key binary, last_key binary")
    # one row a shard: as many as partitions, whatever the number of documents
    return sorted((r.asDict() for r in done.collect()), key=lambda r: r["part"])


def read_shards(spark: SparkSession, out: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    base, shards = 0, []
    for m in manifest:
        shards.append((m["name"], base))
        base += m["n_tokens"]

    def read(batches):
        import numpy as np
        import pyarrow as pa

        fs, folder = filesystem(out)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(f"{folder}/{name}") as f:
                    reader = Reader(f)
                    for key, value in reader.scan():
                        wide = value if reader.id_bytes == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                        rows.append((id_of(key), start, len(wide) // 4, crc32(wide)))
                        start += len(wide) // 4
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + 10_000], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(shards, "name string, start long")
    return table.repartitionByRange(len(shards), "name").mapInArrow(read, schema)


def lookup(out: str, manifest: list[dict], doc_id: int | None) -> list[bytes]:
    """Id bytes of the documents with this identifier: at most the shards whose key range holds it are opened."""
    key, found = key_of(doc_id), []
    fs, folder = filesystem(out)
    for m in manifest:
        if bytes(m["first_key"]) <= key <= bytes(m["last_key"]):
            with fs.open_input_file(f"{folder}/{m['name']}") as f:
                found += Reader(f).get(key)
    return found


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 0, **columns) -> DataFrame:
    """write_shards() to a new folder below the shared one, then read_shards()."""
    out = new_path(docs.sparkSession, "sstable")
    return read_shards(docs.sparkSession, out, write_shards(docs, tokenizer_path, out, end_id, **columns))
