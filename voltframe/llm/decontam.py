"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

A-Z are lower-cased and words are runs of ASCII letters, digits and non-ASCII characters. Windows of `window`
consecutive item words (an item of fewer words is one window) are the automaton's patterns; each document is
normalised and scanned once, and hits are mapped back to word and character offsets of the original text.

Null and empty texts have no words and are clean; an empty benchmark leaves every document clean; items with
the same window all count; repeated document rows are judged each by itself. Only the named columns are read,
so other columns, whatever their names, do not matter. The automaton is built in each worker from the windows,
about ten bytes for each of the benchmark's, whose size is checked: a benchmark of more than `max_benchmark_bytes`
is dealt into blocks of items under that bound, each with an automaton and a scan of its own, and the hits of a
document are united, so that the result is the same.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, worker_cache

WINDOW = 10
MAX_BENCHMARK_BYTES = 16 << 20

_LOWER_OR_SPACE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER_OR_SPACE).split() if text else []


def benchmark_windows(items: list[tuple], window: int) -> dict[str, list[str]]:
    """Pattern -> identifiers (as text) of the items that hold it."""
    out: dict[str, set[str]] = {}
    for item_id, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(f" {b' '.join(words[k : k + window]).decode()} ", set()).add(str(item_id))
    return {k: sorted(v) for k, v in sorted(out.items())}


def _automaton(windows: dict[str, list[str]], digest: str):
    held = worker_cache("decontam", digest)
    if "it" not in held:
        import ahocorasick

        a = ahocorasick.Automaton()
        for pattern, ids in windows.items():
            a.add_word(pattern, (pattern.count(" ") - 1, ids))
        if windows:
            a.make_automaton()
        held["it"] = a
    return held["it"]


def hit_words(words: list[bytes], automaton) -> tuple[list[tuple[int, int]], list[str]]:
    """(ranges of words [begin, end) that hits cover, in order and apart; items)."""
    import numpy as np

    found = list(automaton.iter(f" {b' '.join(words).decode()} ")) if words else []
    if not found:
        return [], []
    # the pattern's last character is the space after its last word
    ends = np.cumsum(np.fromiter((len(w.decode()) + 1 for w in words), np.int64, len(words)))
    last = np.searchsorted(ends, np.array([e for e, _ in found]))
    size = np.array([n for _, (n, _) in found])
    return united(zip((last - size + 1).tolist(), (last + 1).tolist(), strict=True)), sorted({i for _, (_, ids) in found for i in ids})


def united(ranges) -> list[tuple[int, int]]:
    """Ranges [begin, end) that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def spans_of(text: str | None, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges of words as [start, end) in characters of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[z - 1][1]) for a, z in ranges]


def _scanned(rows: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """row, ranges, items of the rows (row, t) that hold a window of the items."""
    windows = benchmark_windows(items, window)
    digest = hashlib.sha256(repr(windows).encode()).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    def scan(batches):
        import pyarrow as pa

        automaton = _automaton(shared.value, digest)
        for b in batches:
            found = [(r, *hit_words(words_of(t), automaton)) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)] if shared.value else []
            found = [x for x in found if x[1]]
            kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([[{"a": a, "z": z} for a, z in x[1]] for x in found], kind), pa.array([x[2] for x in found], pa.list_(pa.string()))], names=["row", "ranges", "items"])

    return rows.select("row", "t").mapInArrow(scan, "row long, ranges array<struct<a: long, z: long>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), spans (of the original text), and the columns in `keep`.

    `prefix` goes before the names of the four columns, for tables that have columns of these names to keep.
    """
    bench = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    kept = docs.select(doc_id, text, *[c for c in keep if c not in (doc_id, text)])
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    names = [doc_id, *[c for c in kept.columns if c != doc_id and c in keep]]
    out_names = [*names, *(prefix + x for x in ("n_words", "n_hit", "items", "spans"))]
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + f", `{prefix}n_words` long, `{prefix}n_hit` long, `{prefix}items` array<string>, `{prefix}spans` array<struct<start: long, end: long>>"

    def batch(b, texts, rows):
        """rows: (words, ranges, items) of each row of the batch."""
        import pyarrow as pa

        spans = [[{"start": s, "end": e} for s, e in spans_of(t, r[1])] for t, r in zip(texts, rows, strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array([r[0] for r in rows], pa.int64()), pa.array([sum(z - a for a, z in r[1]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array(spans, kind)], names=out_names)

    blocks = max(1, -(-size // max_benchmark_bytes))
    if blocks == 1:
        windows = benchmark_windows([tuple(r) for r in bench.collect()], window)
        digest = hashlib.sha256(repr(windows).encode()).hexdigest()
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def scan(batches):
            automaton = _automaton(shared.value, digest)
            for b in batches:
                texts = b.column(text).to_pylist()
                words = map(words_of, texts)
                yield batch(b, texts, [(len(w), *(hit_words(w, automaton) if shared.value else ([], []))) for w in words])

        return kept.mapInArrow(scan, schema)

    row, ranges, items = (fresh(kept.columns, x) for x in ("row", "ranges", "items"))
    numbered = materialize(kept.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows, found = numbered.select(F.col(row).alias("row"), F.col(text).alias("t")), None
    # a margin, as hashes do not deal items evenly
    blocks = 2 * blocks
    for k in range(blocks):
        own = [tuple(r) for r in bench.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k).collect()]
        hits = materialize(_scanned(rows, own, window), "hits")
        found = hits if found is None else found.union(hits)
    found = found.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias(ranges), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items))

    def settle(batches):
        for b in batches:
            texts = b.column(text).to_pylist()
            got = zip(b.column(ranges).to_pylist(), b.column(items).to_pylist(), strict=True)
            yield batch(b, texts, [(len(words_of(t)), united((x["a"], x["z"]) for x in r or []), i or []) for t, (r, i) in zip(texts, got, strict=True)])

    return numbered.join(found.withColumnRenamed("row", row), row, "left").mapInArrow(settle, schema)
