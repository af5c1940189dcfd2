"""Which lines the template step drops."""

import random

from voltframe.llm import template_dedup


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in template_dedup.dedup_lines(docs)[0].collect()}


def own(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_recurring_lines_go_whatever_their_share_but_not_from_near_copies(spark):
    rng = random.Random(1)
    notice = "this page is offered without any warranty by its authors and may be changed at any time"
    short = [f"{notice}\n{own(rng, 8)}" for _ in range(30)]
    lines = [own(rng, 12) for _ in range(20)]
    # near copies of one long text, each with one word changed
    copies = ["\n".join(x + f" more{k}" if j == k % 20 else x for j, x in enumerate(lines)) for k in range(30)]
    got = kept(spark, [*short, *copies])
    assert all(got[k] == short[k].split("\n")[1] for k in range(30))
    assert all(got[30 + k] == copies[k] for k in range(30))


def test_long_lines_need_less_support(spark):
    rng = random.Random(2)
    long, middle, short = own(rng, 52), own(rng, 20), own(rng, 6)
    texts = [own(rng, 80) for _ in range(8)]
    texts = [t + ("\n" + long if k < 2 else "") + ("\n" + middle if k < 5 else "") + "\n" + short for k, t in enumerate(texts)]
    got = kept(spark, texts)
    assert all(long not in t and middle not in t and short in t for t in got.values())
