import hashlib
import zlib
from collections import defaultdict

import pytest

from voltframe.llm import merkle, source_mix

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def _words(text):
    for c in "\t\n\x0b\f\r":
        text = (text or "").replace(c, " ")
    return len([w for w in text.split(" ") if w])


def _rows():
    rows = [(k, " ".join(["w"] * (1 + k * k % 97)), f"s{k % 3}" if k % 2 else "hot", ("en", "de", None)[k % 3], k) for k in range(700)]
    rows += [(1000, None, None, None, None), (1001, "", None, "xx", 0), (None, "a b c", "s1", "en", 5), (None, "a b c", "s1", "en", 5), (1002, "é x y", "é", "de", 3), (1003, "long " * 30000, "s2", "fr", 150000)]
    return rows + [(2000, "same row", "s0", "en", 8)] * 150


def _targets(sizes, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    got, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        each = left / sum(weight[s] for s in free)
        over = {s for s in free if each * weight[s] > most * sizes[s]}
        if not over:
            return got | {s: each * weight[s] for s in free}
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
        free -= over
    return got


def test_targets_copies_and_sums(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, DOCS)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += _words(r[1])
    want = _targets(sizes)
    assert any(want[s] < 2 * sizes[s] for s in sizes)
    got = source_mix.mix(docs, fan=8).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, _words(r[1])) for r in rows)
    of = {(r[0], _words(r[1])): r[2] for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert int(rate) <= r["copies"] <= -(-rate // 1)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = source_mix.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(5), fan=8).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_single_meetings_keep_expectation(spark):
    """Two documents, many seeds: the share of draws in which each rises is its fraction; both together keep the words."""
    from pyspark.sql import functions as F

    entry = "struct<order:double,doc_id:long,size:long,n:long,whole:long,k:long,mass:double,draw:double>"
    for sizes, parts in (((10, 30), (0.3, 0.4)), ((50, 5), (0.5, 0.9)), ((8, 8), (0.25, 0.5))):
        rows = [([(0.0, i, s, 1, 0, 0, p * s, (k + 0.5) / 4000) for i, (s, p) in enumerate(zip(sizes, parts, strict=True))],) for k in range(4000)]
        got = spark.createDataFrame(rows, f"entries array<{entry}>").select(source_mix._fold(F.col("entries")).alias("x")).select("x.*").collect()
        mean = [0.0, 0.0]
        for r in got:
            left, done = r["left"], r["done"]
            assert len(done) == 1 and 0 <= left["mass"] <= left["size"]
            x = {left["doc_id"]: left["mass"], done[0]["doc_id"]: done[0]["k"] * done[0]["size"]}
            assert sum(x.values()) == pytest.approx(sum(s * p for s, p in zip(sizes, parts, strict=True)))
            for i in x:
                mean[i] += x[i] / sizes[i] / len(got)
        assert mean == pytest.approx(list(parts), abs=0.005)


def test_empty_mix_and_manifest(spark):
    docs = spark.createDataFrame([], DOCS)
    assert source_mix.mix(docs).count() == 0 and merkle.verify(docs).count() == 0


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, more=0):
    doc_id, text, source, lang, n = r
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _h(f(doc_id), f(source), f(lang), f(None if n is None else n + more), f(text))


def _tree(hashes):
    """Levels of the tree and for each leaf the siblings and slots."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k in range(len(hashes)):
            i = at[k]
            paths[k].append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else ""))
            at[k] //= 2
        level = [_h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


@pytest.mark.parametrize("bits", [2, 9])
def test_manifest_equals_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = _rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("path", merkle.F.lit("x")).withColumn("leaf", merkle.F.lit(1)).withColumn("place", merkle.F.lit(2))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs, want = [], []
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        subs.append(_tree([_leaf(r) for r in by[lang]]))
    root, above = _tree([s for s, _ in subs])
    for lang, (sub, paths), up in zip(langs, subs, above, strict=True):
        for r, path in zip(by[lang], paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = _leaf(r, int(bad))
            for slot, other in path + up:
                h = _h(other, h) if slot else _h(h, other)
            want.append((r[0], _leaf(r), sub, root, _h(*(x for _, x in path + up)), h, h == root))
    got = [tuple(r) for r in merkle.verify(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {x[-1] for x in want} == {True, False}


def test_lone_leaf(spark):
    r = (5, "only", "s", "en", 4)
    got = merkle.verify(spark.createDataFrame([r], DOCS)).first()
    assert got["leaf"] == got["subroot"] == got["root"] == _leaf(r) and got["proof_sha256"] == _h()
