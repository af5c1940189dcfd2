import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from voltframe.llm import treap_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _brute(docs, items, k):
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := _terms(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c, size in held:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def _corpus():
    draw = random.Random(5)
    words = [f"W{k}" for k in range(60)] + ["é", "naïve", "ÀB", "x9", "中文"]
    docs = [(k, " ".join(draw.choices(words[: 5 + k % 60], k=1 + draw.randrange(60)))) for k in range(500)]
    docs += [(7, docs[7][1])] * 40 + [(k, "w1 w2, w3.w4") for k in range(600, 640)]  # repeated rows, ties
    docs += [(None, "w1 é"), (None, "w1 é"), (900, None), (901, ""), (902, "!! --"), (903, "W1 " * 40000), (904, "a\x00b\x7fc\x85d")]
    items = [(k, " ".join(draw.sample(words, 1 + k % 9))) for k in range(30)]
    items += [(30, "w1 W1 w2"), (30, "é"), (31, None), (32, ""), (33, "unknown words"), (None, "w3 naïve"), (34, "a b c d")]
    return docs, items


def test_search_equals_brute_force(spark):
    docs, items = _corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("term", F.lit("x")).repartition(3)
    q = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit(1))
    want = sorted(_brute(docs, items, 7), key=repr)
    for segment, block in ((200, 400), (2_000_000, 4 << 20)):
        index, n = treap_search.build(d, segment=segment)
        got = sorted((tuple(r) for r in treap_search.search(index, n, q, k=7, block_bytes=block).collect()), key=repr)
        assert got == want
    assert index.count() == 3 and n == sum(bool(_terms(t)) for _, t in docs)
    assert treap_search.search(index, n, q).filter("item_id = 33 OR item_id = 31 OR item_id = 32").count() == 0


def test_treaps_are_search_trees_in_heap_order():
    import numpy as np

    draw = np.random.default_rng(3)
    vocabulary, tokens = {}, []
    for _ in range(80):
        words = [f"t{x}" for x in draw.integers(0, 30, draw.integers(1, 50))]
        tokens.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]))
    ids, terms, counts, *parts = treap_search._segment(list(range(80, 0, -1)), tokens, vocabulary, 80, sum(map(len, tokens)), 0)
    root, doc, impact, left, right = (np.frombuffer(x, "<i4") for x in parts)
    assert ids == sorted(ids) and terms == sorted(terms)
    start = 0
    for r, n in zip(root, counts, strict=True):
        seen, stack = [], [(r, -1, 80)]
        while stack:
            x, low, high = stack.pop()
            assert low < doc[x] < high
            seen.append(x)
            for child, a, b in ((left[x], low, doc[x]), (right[x], doc[x], high)):
                if child >= 0:
                    assert impact[child] <= impact[x]
                    stack.append((child, a, b))
        assert sorted(seen) == list(range(start, start + n))
        start += n


def test_walk_gives_up_subtrees(spark, monkeypatch):
    """A rare term's documents are found without scoring most of the others."""
    import numpy as np

    docs = [(k, "common " * (1 + k % 5) + ("rare" if k % 100 == 0 else "filler")) for k in range(3000)]
    index, n = treap_search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    row = index.first()
    seg = treap_search._Segment(row["ids"], [bytes(t) for t in row["terms"]], *(bytes(row[c]) for c in ("root", "doc", "impact", "left", "right")))
    keys, scored = seg.keys(row["counts"]), []
    whole = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v: (scored.append(v.size // 2), whole(a, v))[1])
    at = np.array([seg.place[b"common"], seg.place[b"rare"]])
    scores, found = treap_search._walk(seg, keys, at, np.array([10, 5000]), 5, [])
    assert len(scores) >= 5 and all(seg.ids[d] % 100 == 0 for d in found[np.argsort(-scores)[:5]])
    assert sum(scored) < 1000


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    index, n = treap_search.build(docs)
    assert n == 0 and treap_search.search(index, n, items).count() == 0
    index, n = treap_search.build(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert treap_search.search(index, n, items.limit(0)).count() == 0


def test_segments_are_written_and_read_one_by_one(spark):
    import glob

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(k, "a b c d") for k in range(40)], "doc_id long, text string").coalesce(1)
    index, n = treap_search.build(docs, segment=16)
    assert n == 40 and index.count() == 10
    files = [pq.ParquetFile(x).metadata for x in glob.glob(index._voltframe_path.replace("file://", "").replace("file:", "") + "/*.parquet")]
    assert [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)] == [1] * 10
