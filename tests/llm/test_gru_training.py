"""What the language model learns from, and that it does not depend on how rows are laid out."""

import random

import numpy as np
import pytest

from voltframe.llm import gru_lm


def test_rounds_use_every_shard_once():
    assert gru_lm.plan_rounds(10, 100) == [1] and gru_lm.plan_rounds(0, 100) == [1]
    assert gru_lm.plan_rounds(1500, 100) == [1, 1, 2, 4, 7]
    assert all(sum(gru_lm.plan_rounds(n, 7)) == -(-n // 7) for n in range(1, 500))


@pytest.mark.parametrize("pick", [0, 5])
def test_every_document_is_trained_on(spark, pick):
    rng = random.Random(pick)
    rows = [(pick + k, " ".join(rng.choice(["one", "two", "three"]) for _ in range(300))) for k in range(4)]
    index = gru_lm.vocabulary([b"one", b"two", b"three"], rare=5)
    before = gru_lm.Network(len(index) + 5).flat()
    for row in rows:
        net = gru_lm.train(spark.createDataFrame([row], "pick long, t string"), index, 301, rare=5)
        assert np.abs(net.flat() - before).max() > 1e-3


def test_vocabulary_is_large():
    index = gru_lm.vocabulary([b"w%d" % k for k in range(50_000)])
    assert len(index) >= 10 * 1022 and index[b"w9000"] >= gru_lm.FIRST_RARE + gru_lm.RARE
    assert gru_lm.Network(len(index) + gru_lm.RARE).size <= 2 * gru_lm.CLASSES
    assert gru_lm.FIRST_RARE <= gru_lm.rare_symbol(b"seldom") < gru_lm.FIRST_RARE + gru_lm.RARE


def test_rare_words_are_learned_in_context():
    rng = random.Random(3)
    # word 2k is always followed by word 2k + 1, all of them far beyond the first thousand places
    pairs = [5000 + 2 * rng.randrange(20) for _ in range(12_000)]
    net = gru_lm.Network(16_384)
    docs = [np.array([x for p in pairs[at : at + 50] for x in (p, p + 1)]) for at in range(0, len(pairs), 50)]
    before = net.log10_likelihoods(docs[:5]).sum()
    for _ in range(3):
        net.train(docs, lanes=16)
    # 10 nats a pair and word when untrained; about ln 20 a pair when learned
    assert net.log10_likelihoods(docs[:5]).sum() > before / 3


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    net = gru_lm.Network(12, classes=3, hidden=4)
    for k, x in net.p.items():
        net.p[k] = (x * 3).astype(np.float64)
    ids, target, reset = rng.integers(0, 12, (5, 3)), rng.integers(0, 12, (5, 3)), np.ones((5, 3))
    reset[2, 1] = 0
    h = rng.standard_normal((3, 4))
    _, grad, _ = net.gradients(ids, target, h, reset)
    words, rows = grad["e"]
    whole = np.zeros_like(net.p["e"])
    whole[words] = rows
    grad = grad | {"e": whole}
    for k, x in net.p.items():
        for at in rng.integers(0, x.size, 6):
            old, d = x.flat[at], 1e-5
            x.flat[at] = old + d
            up = net.gradients(ids, target, h, reset)[0]
            x.flat[at] = old - d
            down = net.gradients(ids, target, h, reset)[0]
            x.flat[at] = old
            assert abs((down - up) / (2 * d) - grad[k].flat[at]) < 1e-4 * max(1, abs(grad[k].flat[at])), k


def test_probabilities_add_up():
    net = gru_lm.Network(20, classes=3, hidden=4)
    h = np.random.default_rng(1).standard_normal((1, 4)).astype(np.float32)
    total = sum(float(np.exp(net.log_probs(h, np.array([k])))[0]) for k in range(20))
    assert abs(total - 1) < 1e-5


def test_scores_do_not_depend_on_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    run = lambda d: {r["doc_id"]: r["score"] for r in gru_lm.score(d, shard=20_000).collect()}
    one, other = run(docs.coalesce(1)), run(docs.repartition(7, "text"))
    assert max(abs(one[k] - other[k]) / abs(one[k]) for k in one) < 1e-4


def test_most_frequent_words_are_bounded(spark):
    rows = [(f"w{k}".encode(), 1000 // (k + 1) + 1) for k in range(500)]
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in rows], "token binary, c long")
    for most in (1, 10, 100, 499, 500, 1000):
        got = gru_lm.most_frequent(counts, most)
        bound = min((c for _, c in got), default=10**9)
        assert len(got) <= most and sorted(got) == sorted((w, c) for w, c in rows if c >= bound)
        assert len(got) == 500 or sum(c >= max(x for _, x in rows if x < bound) for _, c in rows) > most
