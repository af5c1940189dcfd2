"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at . ! ? ; : and line ends, and after `MAX_WORDS` words). A sentence's
logit is a bias plus the weights of its words, where a word's weight is that of the word and of its first four,
five and six letters, so that inflected forms share evidence. Sentence probabilities p combine by noisy-or, 1 - prod(1 - p), and the weights
are trained from document labels alone; sentences are then scored by themselves to locate the offending ones.

Training reads whole texts, of at most `max_toxic` and `max_clean` labelled documents of the classes (chosen by hash of
the identifier); scoring covers every whole text. Null and empty texts have no sentence and score 0.
Labels of null, unlabelled rows and rows of the held-out side are not learned from. If a class is missing there is
nothing to learn and every score is 0. Repeated rows score alike; ties need no order. Only the named columns are
read; labels never enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, worker_cache

MAX_TOXIC, MAX_CLEAN = 1500, 3000
SLOTS = 1 << 18
MAX_WORDS = 16
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]+")
_END = ".!?;:\n"


def word_features(word: str) -> list[int]:
    import zlib

    return [zlib.crc32(x.encode()) % SLOTS for x in {"w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)}]


def _tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


class Model:
    """bias and weights of hashed features; word weights are remembered by each worker."""

    def __init__(self, bias: float, weights, version: str):
        self.bias, self.weights, self.version = bias, weights, version

    def sentences(self, text: str | None):
        """(probability of each sentence, its number of words)."""
        import numpy as np

        cache = worker_cache("toxicity", self.version)
        if len(cache) > 400_000:
            cache.clear()
        tokens = _tokens(text)
        if not tokens:
            return np.zeros(0), np.zeros(0, int)
        found = list(map(cache.get, tokens))
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    t = tokens[k]
                    found[k] = cache[t] = float("nan") if t[0] in _END else float(sum(self.weights[f] for f in word_features(t)))
        w = np.array(found)
        end = np.isnan(w)
        # words since the last end; a new sentence begins after an end and after every MAX_WORDS of them
        at = np.arange(len(w))
        since = at - np.maximum.accumulate(np.where(end, at, -1)) - 1
        which = np.cumsum(end | ((since > 0) & (since % MAX_WORDS == 0))) - end
        size = np.bincount(which, ~end)
        logit = self.bias + np.bincount(which, np.where(end, 0, w))
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return p[size > 0], size[size > 0].astype(int)

    def score(self, text: str | None) -> float:
        import numpy as np

        p, _ = self.sentences(text)
        return float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def fit(rows: Iterable[tuple[str | None, int]], rounds: int = 120, rate: float = 0.3, sparsity: float = 2e-2, min_docs: int = 3) -> Model:
    """Maximises the noisy-or likelihood of (text, label) rows with proximal Adagrad; small weights stay at zero.

    Rows are read once. A token is kept as the number of its word, and features once for each distinct word, so
    that memory is eight bytes a token and no text is held.
    """
    import hashlib
    from array import array

    import numpy as np

    number: dict[str, int] = {}
    of_word: list[list[int]] = []
    word, sentence_of, doc_of, labels = array("i"), array("i"), array("i"), array("b")
    seen = np.zeros(SLOTS, np.int64)
    for d, (t, label) in enumerate(rows):
        labels.append(label)
        words, own = 0, set()
        for tok in _tokens(t):
            if tok[0] in _END or words == MAX_WORDS:
                if words:
                    doc_of.append(d)
                words = 0
            if tok[0] in _END:
                continue
            k = number.setdefault(tok, len(number))
            if k == len(of_word):
                of_word.append(word_features(tok))
            own.update(of_word[k])
            word.append(k)
            sentence_of.append(len(doc_of))
            words += 1
        if words:
            doc_of.append(d)
        seen[list(own)] += 1
    y, doc, sentences = np.array(labels, np.int64), np.array(doc_of, np.int32), len(doc_of)
    if not len(y) or y.min() == y.max():
        return Model(-40.0, np.zeros(SLOTS, np.float32), "none")
    vocabulary, number = len(number), {}
    t, s = np.frombuffer(word, np.int32), np.frombuffer(sentence_of, np.int32)
    owner = np.repeat(np.arange(vocabulary, dtype=np.int32), [len(x) for x in of_word])
    f = np.array([x for own in of_word for x in own], np.int32)
    # a feature seen in fewer documents than that says nothing about others
    keep = seen[f] >= min_docs
    f, owner = f[keep], owner[keep]
    w, bias, n = np.zeros(SLOTS), -9.0, len(y)
    gw, gb = np.full(SLOTS, 1e-8), 1e-8
    scale = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y == 0).sum()))) / n
    for _ in range(rounds):
        z = bias + np.bincount(s, np.bincount(owner, w[f], minlength=vocabulary)[t], minlength=sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        whole = 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n))
        whole = np.clip(whole, 1e-9, 1 - 1e-9)
        factor = np.where(y > 0, -(1 - whole) / whole, 1.0) * scale
        g = p * factor[doc]
        grad = np.bincount(f, np.bincount(t, g[s], minlength=vocabulary)[owner], minlength=SLOTS)
        gw += grad * grad
        gb += g.sum() ** 2
        step = rate / np.sqrt(gw)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparsity / np.sqrt(n), 0)
        bias = min(-7.0, bias - 0.05 * g.sum() / np.sqrt(gb))
    weights = w.astype(np.float32)
    return Model(float(bias), weights, hashlib.sha256(weights.tobytes()).hexdigest())


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", mod: int = 4, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fits on a bounded sample of the labelled rows whose crc32(doc_id) mod `mod` is not 2."""
    known = labels.select(F.col(doc_id), F.col(label).cast("int").alias("y")).filter(F.col(doc_id).isNotNull() & F.col("y").isin(0, 1) & ~held_out(mod, doc_id))
    order, most = F.xxhash64(doc_id), ((0, max_clean), (1, max_toxic))
    some = [known.filter(F.col("y") == y).orderBy(order, doc_id).limit(2 * n) for y, n in most]
    chosen = F.broadcast(some[0].unionByName(some[1]).dropDuplicates([doc_id]))
    # at most 2 * (max_toxic + max_clean) identifiers are broadcast and half as many texts collected
    rows = docs.select(F.col(doc_id), F.col(text).alias("t")).filter(F.length("t") > 0).join(chosen, doc_id)
    parts = [rows.filter(F.col("y") == y).orderBy(order, doc_id, "t").limit(n) for y, n in most]
    return fit((r[0], r[1]) for p in parts for r in p.select("t", "y").toLocalIterator())


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), sentences: bool = False, threshold: float = 0.3, into: str = "score") -> DataFrame:
    """doc_id, kept columns, `into`; with `sentences` also offending: [(sentence number, probability)] above the threshold."""
    # plain values are broadcast and the model is built in the task, so that workers need no copy of this package
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.version))
    names = [doc_id, *[c for c in keep if c != doc_id]]
    rows = docs.select(*names, *[text] * (text not in names))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        import pyarrow as pa

        m = Model(*shared.value)
        for b in batches:
            texts = b.column(text).to_pylist()
            columns = [*(b.column(c) for c in names), pa.array([m.score(t) for t in texts], pa.float64())]
            if sentences:
                columns.append(pa.array([[{"sentence": k, "p": float(x)} for k, x in enumerate(m.sentences(t)[0]) if x >= threshold] for t in texts], pa.list_(pa.struct([("sentence", pa.int32()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, into, *["offending"] * sentences])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + f", `{into}` double" + ", offending array<struct<sentence: int, p: double>>" * sentences)
