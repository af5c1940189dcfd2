"""Near copies against brute force over all pairs."""

import random

import corpus_pipeline
from voltframe.llm import near_copies


def fixture():
    """Groups of 500-word texts with 1 to 14 scattered changes (similarity about 0.98 to 0.77), repeats and odd rows."""
    rng, texts = random.Random(8), []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(500)]
        texts.append(" ".join(base))
        for k in range(1, 15):
            own = list(base)
            for at in rng.sample(range(500), k):
                own[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(own))
    return [*texts, texts[0], None, "", "one two", "One  two", "three"]


def brute(texts, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    for a, b in pairs:
        parent[root(a)] = root(b)
    return pairs, [root(x) for x in range(len(texts))]


def test_near_copies_match_brute_force(spark):
    texts = fixture()
    pairs, want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert len(got) == len(texts) and all(got[a] == got[b] for a, b in pairs)
    assert len(set(got.values())) == len(set(want))
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_pipeline_stage_removes_all_near_copies(spark):
    texts = fixture()
    _, want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = sorted(r["doc_id"] for r in corpus_pipeline.remove_near_copies(spark, docs, "").collect())
    first = {}
    for k, x in enumerate(want):
        first.setdefault(x, k)
    assert left == sorted(first.values())


def test_a_pair_without_a_common_band_is_linked(spark):
    """Found by trying seeds: similarity 90/110, no band in common, fingerprints more than RADIUS bits apart."""
    rng = random.Random(23598)
    base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
    own = list(base)
    for at in (20, 60):
        own[at] = f"x{rng.randrange(10**6)}"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(own)), (3, "other words")], "doc_id long, text string")
    for radius in (None, near_copies.RADIUS):
        got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, radius=radius).collect()}
        assert got[1] == got[2] != got[3]
    assert [r["doc_id"] for r in corpus_pipeline.remove_near_copies(spark, docs, "").orderBy("doc_id").collect()] == [1, 3]


def test_prefixes_alone_find_all_links(spark, monkeypatch):
    """Without a class to begin with, in blocks of 4 texts and of all, against all pairs; texts share a common passage."""
    rng, passage = random.Random(5), " ".join(f"p{k}" for k in range(30))
    texts = [t for t in fixture() if t] + [f"{' '.join(f'y{rng.randrange(4)}' for _ in range(rng.randrange(3, 9)))} {passage}" for _ in range(60)]
    texts = list(dict.fromkeys(" ".join(t.lower().split()) for t in texts)) + [f"v{k % 3} v{k}" for k in range(9)]
    pairs, _ = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r["copy"]: r["row"] for r in near_copies.signatures(docs, "doc_id", "text").filter("n >= 0").collect()}
    for block, bits in ((4, b"\x00"), (1024, b"\x55")):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        common = spark.sparkContext.broadcast(bits * (near_copies.FILTER_BITS // 8))
        keyed = near_copies.prefixes(docs, "doc_id", "text", common, 5, 0.8).withColumn("class", near_copies.F.col("copy"))
        found = near_copies.prefix_pairs(keyed, 0.8, near_copies.materialize).collect()
        got = {frozenset((ids[r["a"]], ids[r["b"]])) for r in found}
        assert {frozenset(p) for p in pairs} <= got and len(got) == len(found)


def test_a_group_just_below_the_similarity_leaves_few_pairs_and_no_link_is_lost(spark):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]

    def changed(n):
        out = list(base)
        for k in rng.sample(range(150), n):
            out[k] = f"x{rng.randrange(10**9)}"
        return " ".join(out)

    texts = [changed(4) for _ in range(120)] + [changed(1) for _ in range(12)]
    sets = [near_copies.shingles(t) for t in texts]
    wanted = sum(near_copies.similarity_of(sets[a], sets[b]) >= 0.8 for a in range(len(sets)) for b in range(a))
    assert wanted > 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = near_copies.prefixes(docs, "doc_id", "text", spark.sparkContext.broadcast(bytes(near_copies.FILTER_BITS // 8)), 5, 0.8).persist()
    some = near_copies.shared_prefixes(first, spark.sparkContext.broadcast(near_copies.repeated_keys(first)), 0.8)
    pairs = near_copies.prefix_pairs(some.withColumn("class", near_copies.F.col("copy")), 0.8, near_copies.materialize).persist()
    rows = docs.select(near_copies.F.col("doc_id").alias("row"), "text")
    assert some.count() == len(texts)
    assert pairs.count() < 0.3 * len(texts) * (len(texts) - 1) / 2
    signed = near_copies.signatures(rows, "row", "text", prints=False).filter("n >= 0").select("row", "copy")
    sets_of = near_copies.sets_of(rows, "row", "text", signed)
    assert near_copies.confirmed(pairs, sets_of).count() == wanted
    first.unpersist(), pairs.unpersist()


def test_hashes_of_one_prefix_are_not_sent_on_and_shared_ones_keep_their_places(spark):
    rows = [(1, 10, b"", [5 << 40, 7 << 50, 1 << 61, 9 << 55]), (2, 10, b"", [-3, 5 << 40, 1 << 61, 9 << 55, 7 << 50]), (3, 10, b"", [-9 << 50, 4 << 52, 5 << 40])]
    first = spark.createDataFrame(rows, "copy long, n long, bits binary, keys array<long>")
    got = near_copies.shared_prefixes(first, spark.sparkContext.broadcast(near_copies.repeated_keys(first)), 0.8).collect()
    assert {r["copy"]: (r["keys"], r["ats"]) for r in got} == {1: (rows[0][3], [0, 1, 2, 3]), 2: (rows[1][3][1:], [1, 2, 3, 4])}  # 3 shares one hash, not four
