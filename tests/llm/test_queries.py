"""The registered queries against brute force on whole small tables, and edge cases of every operator and stage."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voltframe.llm import curve_packing, decontam, gru_lm, langid, line_quality, near_copies, queries, rindex_dedup, simhash, sstable, template_dedup, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def fresh_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True  # as the files' description says: their strings in a text are ordinary text
    return lambda text, end: [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def groups(pairs, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return [root(x) for x in range(n)]


# queries


def test_op1_finds_held_out_toxic_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = queries.op1_toxicity(spark, MIDDLE).collect()
    assert len(rows) == len(texts_of(spark, MIDDLE))
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(p for y, p in held if y) >= 0.8 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.02 * len(held)


def test_offending_sentences_are_located(spark):
    rng = random.Random(9)
    plain = lambda n: " ".join(rng.choice("tree river stone cloud field bread".split()) for _ in range(n))
    rows = [(k, f"{plain(6)}. {plain(5)}. " + (f"{plain(2)} vilest. " if k % 2 else f"{plain(3)}. ") + plain(4)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int"))
    for r in toxicity.score(docs, model, sentences=True).collect():
        assert [x["sentence"] for x in r["offending"]] == ([2] if r["doc_id"] % 2 else [])


def test_op3_equals_the_library(spark):
    encode, rows = fresh_tokenizer("byte_bpe_50k.json"), {r["doc_id"]: r for r in queries.op3_sstable(spark, SMALL).collect()}
    start = 0
    for d, t in sorted(texts_of(spark, SMALL)):
        ids = encode(t, 0)
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op9_equals_the_library_and_packs_without_gaps(spark):
    encode, want = fresh_tokenizer("word_bpe_49k.json"), {}
    for d, t in texts_of(spark, SMALL):
        want[d] = encode(t, 1)
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in queries.op9_curve_packing(spark, SMALL).collect():
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(want[r["doc_id"]])
    assert pieces.keys() == want.keys()
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(want[d])
    for k, own in filled.items():
        assert sum(n for _, n in own) == 2048 or k == max(filled)
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:j]) for j in range(len(own))]


def test_hilbert_keys_of_neighbours_are_neighbours():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 1 << curve_packing.BITS, (2000, curve_packing.DIMS))
    near = cells.copy()
    near[:, 0] = np.clip(near[:, 0] + 1, 0, (1 << curve_packing.BITS) - 1)
    keys, moved = curve_packing.hilbert_keys(cells), curve_packing.hilbert_keys(near)
    assert len(set(keys.tolist())) == len({tuple(c) for c in cells.tolist()})
    far = np.abs(keys - rng.permutation(keys))
    assert np.median(np.abs(keys - moved)) < np.median(far) / 1000


def test_bloom_filter_has_few_false_hits():
    import io

    out = io.BytesIO()
    w = sstable.Writer(out, 2)
    for k in range(2000):
        w.add(sstable.key_of(2 * k), bytes(4))
    w.finish()
    reader = sstable.Reader(out)
    assert all(reader.may_hold(sstable.key_of(2 * k)) for k in range(2000))
    assert sum(reader.may_hold(sstable.key_of(2 * k + 1)) for k in range(2000)) < 100
    assert reader.get(sstable.key_of(7)) == [] and len(reader.get(sstable.key_of(8))) == 1


def test_op10_equals_all_pairs(spark):
    from xxhash import xxh64_intdigest

    texts = texts_of(spark, SMALL)
    prints = []
    for _, t in texts:
        w = WHITE.findall(lower(t))
        h = [xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = groups([(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3], len(texts))
    first = {}
    for k, r in enumerate(root):
        first[r] = min(first.get(r, texts[k][0]), texts[k][0])
    want = {texts[k][0]: (f"{prints[k]:016x}", first[r]) for k, r in enumerate(root)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, SMALL).collect()} == want


def test_op6_equals_brute_force(spark):
    texts = [(d, (t or "").encode()) for d, t in texts_of(spark, SMALL)]
    first = {}
    for d, t in texts:
        for w in {t[k : k + 50] for k in range(len(t) - 49)}:
            first[w] = min(first.get(w, d), d)
    got = {r["doc_id"]: r for r in queries.op6_run_index(spark, SMALL).collect()}
    for d, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_split_minimizers_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lambda: sorted(tuple(r) for r in rindex_dedup.remove_repeats(docs).drop("kept").collect())
    plain = rows()
    monkeypatch.setattr(rindex_dedup, "HOT_CHUNK", 1)
    monkeypatch.setattr(rindex_dedup, "HOT_RUNS", 3)
    assert rows() == plain


def test_op7_base_columns_and_gain(spark):
    texts = texts_of(spark, MIDDLE)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts}
    tokens = {d: [*WHITE.findall(lower(t)), ""] for d, t in texts}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    rows = {r["doc_id"]: r for r in queries.op7_gru_lm(spark, MIDDLE).collect()}
    assert rows.keys() == tokens.keys()
    for d, own in tokens.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(own), sum(w in c for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    per = lambda column: sum(rows[d][column] for d in rows if held[d]) / sum(len(tokens[d]) for d in rows if held[d])
    assert per("score") > per("base_score") + 0.25


def test_op8_tells_languages_apart(spark):
    for sf in (SMALL, MIDDLE):
        lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
        rows = [r for r in queries.op8_language(spark, sf).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
        assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.98 * len(rows)


def test_rare_languages_are_learned(spark):
    rng = random.Random(7)
    own = {"en": "the of and that with this", "nl": "het een van voor niet zijn", "xx": "zuqo qixu vuxi", "de": "der und nicht das ein ist"}
    often = {"en": 300, "nl": 15, "xx": 3, "de": 15}
    rows = [(" ".join(rng.choice(own[x].split()) for _ in range(20)), x) for x, n in often.items() for _ in range(n)]
    # identifiers of the training side alone
    ids = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, *r) for i, r in zip(ids, rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.train(docs)).collect()}
    for x in own:
        mine = [i for i, r in zip(ids, rows) if r[1] == x]
        assert sum(got[i] == x for i in mine) >= 0.9 * len(mine)


# the pipeline, stage by stage, each on what the one before kept


def brute_near_copies(texts, similarity=0.8):
    sets = []
    for t in texts:
        w = WHITE.findall(lower(t))
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    pairs = []
    for a in range(len(sets)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= similarity * large and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                pairs.append((a, b))
    return groups(pairs, len(texts))


def classes_of(texts):
    """Classes of near copies by brute force, as the line step counts them."""
    return brute_near_copies(texts)


def sketched_classes_of(spark, texts):
    """Classes of near copies by sketches."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if t is not None], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, bands=16, rows=6, radius=None, exact=False).collect()}
    return [got.get(k) for k in range(len(texts))]


def test_classes_by_sketches_hold_near_copies_and_little_else(spark):
    texts = [t for _, t in texts_of(spark, MIDDLE)]
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    kinds = sketched_classes_of(spark, texts)
    near = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    pairs = [(a, b, near(a, b)) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.5 * max(len(sets[a]), len(sets[b]))]
    sure = [kinds[a] == kinds[b] for a, b, s in pairs if s >= 0.9]
    assert sure and sum(sure) >= 0.95 * len(sure)
    apart = [kinds[a] == kinds[b] for a, b, s in pairs if s < 0.5]
    assert sum(apart) <= 0.001 * len(apart)


def brute_lines(texts, kinds):
    """The texts without recurring lines, by sets of classes."""

    def tokens(line):
        if re.search(r"[\d@:]", line):
            line = re.sub(r"\d+", "0", re.sub(r"\S*(?:://|@)\S*|\S*\d\S*\d\S*\d\S*\d\S*", "<*>", line))
        return tuple(line.lower().split())

    classes = defaultdict(set)
    for t, k in zip(texts, kinds, strict=True):
        for line in (t or "").split("\n"):
            if len(x := tokens(line)) >= 5:
                classes[x].add(k)
    leaf = lambda x: (len(x), x[:3])
    shared, general = defaultdict(set), defaultdict(set)
    for x, own in classes.items():
        for at, token in enumerate(x):
            shared[leaf(x), at, token] |= own
    form = lambda x: tuple(w if len(shared[leaf(x), at, w]) >= 20 else "<*>" for at, w in enumerate(x))
    for x, own in classes.items():
        general[leaf(x), form(x)] |= own

    def recurs(line):
        x = tokens(line)
        if len(x) < 5:
            return False
        if len(classes[x]) >= max(2, math.ceil(100 / len(x))):
            return True
        fixed = sum(len(shared[leaf(x), at, w]) >= 20 for at, w in enumerate(x))
        return fixed >= 0.6 * len(x) and len(general[leaf(x), form(x)]) >= 20

    return [t if t is None else "\n".join(line for line in t.split("\n") if not recurs(line)) for t in texts]


def test_op5_equals_brute_force(spark):
    texts = texts_of(spark, MIDDLE)
    want = brute_lines([t for _, t in texts], classes_of([t for _, t in texts]))
    got = {r["doc_id"]: r for r in queries.op5_template_lines(spark, MIDDLE).collect()}
    for (d, t), kept in zip(texts, want, strict=True):
        assert got[d]["kept_sha256"] == (None if kept is None else hashlib.sha256(kept.encode()).hexdigest())
        assert got[d]["n_dropped"] == (0 if t is None else len(t.split("\n")) - (len(kept.split("\n")) if kept or t == "" else 0))


def test_lists_of_one_document_stay(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    listing = "\n".join(f"the next speaker was {words(1)}" for _ in range(40))
    texts = [listing, *(words(60) for _ in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in template_dedup.dedup_lines(docs)[0].collect()}[0] == listing


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_toxic(spark, docs, MIDDLE).collect()}
    ids = sorted(left)
    texts = [left[d] for d in ids]
    texts = brute_lines(texts, classes_of(texts))
    first = {}
    for k, g in enumerate(brute_near_copies(texts)):
        first.setdefault(g, k)
    kept = sorted(first.values())
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect() if (w := word.findall(lower(r["text"]))) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = [k for k in kept if not any(tuple(w[j : j + n]) in windows for w in [word.findall(lower(texts[k]))] for n in sizes for j in range(len(w) - n + 1))]
    encode = fresh_tokenizer("word_bpe_49k.json")
    want = {ids[k]: encode(texts[k], 1) for k in clean}
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, MIDDLE).collect():
        assert r["ids_crc32"] == crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        got[r["doc_id"]].append(r["length"])
    assert {d: sum(x) for d, x in got.items()} == {d: len(x) for d, x in want.items()}


# edge cases

CLASH = "score double, n_words long, n_hit long, items string, spans string, row long, _row long, copy string, places string, n_lines long, n_dropped long, component_id string, key long, t string, _ string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and repeated texts, ties, one text of two megabytes, and columns with names of the operators' own."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    texts = [None, "", "one", words(300_000), *[words(50)] * 3, " \n\t ", words(12)]
    rows = [(None if k == 8 else k, t, "en" if k % 2 else None, None if k == 3 else "host", len(t or ""), 0.5, 1, 2, "i", None, 3, 4, "c", "p", 5, 6, "d", 7, "t", "_") for k, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def operators(spark, sf=SMALL):
    import public_tokenizers

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return {
        "op1": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "op2": lambda d: decontam.decontaminate(d, bench),
        "op3": lambda d: sstable.token_table(d, public_tokenizers.path("byte_bpe_50k.json")),
        "op4": line_quality.judge,
        "op5": lambda d: template_dedup.dedup_lines(d)[0],
        "op6": rindex_dedup.remove_repeats,
        "op7": gru_lm.score,
        "op8": lambda d: langid.predict(d, langid.train(d)),
        "op9": lambda d: curve_packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).select("doc_id").distinct(),
        "op10": simhash.near_duplicates,
        "near": lambda d: near_copies.near_copies(d.filter("doc_id IS NOT NULL")),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "near"])
def test_awkward_rows_and_empty_tables(spark, awkward, name):
    own = operators(spark)[name]
    assert own(awkward).count() == {"op9": 9, "near": 9}.get(name, 10)
    assert own(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_awkward_rows_and_foreign_columns(spark, awkward, stage):
    got = stage(spark, awkward, SMALL)
    assert got.columns == awkward.columns and stage(spark, awkward.limit(0), SMALL).count() == 0
    rows = lambda df: sorted((tuple(str(x) for x in r[2:]), str(r[0]), hashlib.md5(str(r[1]).encode()).hexdigest()) for r in df.collect())
    if stage is corpus_pipeline.remove_near_copies:
        # one of null, empty and white, and one of four equal texts
        assert sorted(str(r["doc_id"]) for r in got.select("doc_id").collect()) == ["0", "2", "3", "4", "None"]
    else:
        assert rows(got) == rows(awkward)


def test_models_need_no_copy_of_the_package(spark):
    """What is broadcast is made of plain values: nothing in it is a class of this package."""
    import pickle

    for model in (langid.fit([]), toxicity.fit([])):
        held = tuple(vars(model).values())
        assert b"voltframe" not in pickle.dumps(held)
