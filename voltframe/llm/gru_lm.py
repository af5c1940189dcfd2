"""Gated recurrent language model with a class-factored softmax, in numpy.

Tokens are words between white space, A-Z lower-cased, then one end token a document. All training documents are
counted, exactly, by shuffle. The network's vocabulary is the end token, the `WORDS` most frequent words, and
`RARE` symbols for all other words, by a hash of a word's last three bytes, so that endings tell rare words apart in
context. Symbols are in classes of equal size by frequency: P(symbol) = P(class | state) P(symbol | class, state). A
rare word has P(its symbol | state) (c + 1) / (U + D + 1), with its count c, and the tokens U and distinct words D of
its symbol in training.

Training is truncated backpropagation over windows of `WINDOW` steps with the state carried from window to window.
Every training document is used once. Documents go to shards of about `SHARD` tokens by a hash of identifier and text,
and stand in a shard in the order of that hash; shards are trained in rounds of 1, 1, 2, 4, ... shards, each by one
task from the same weights with its own optimizer state, and a round ends by averaging weights by tokens seen, in a
tree, in the order of shards. So the weights depend on the rows and not on files, partitions or batches, the number
of shards follows the corpus, the number of rounds its logarithm, and the driver gets one model a round. Scoring runs
whole documents, longest first, in windows with the state carried over, so the result is the log-likelihood of the
complete text.

Counts of words as frequent as the `HEAD` most frequent ones are broadcast (at most that many: words tied at the
bound are left out together); the others are joined by shuffle. Null and empty texts are the end token alone.
Held-out rows are only scored. Rows with a null identifier are training rows. Repeated rows count and are scored
each; ties of counts are ordered by word. If there is nothing to learn from, the network scores evenly. Only the
named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, drop, held_out, materialize, new_path

WORDS, RARE, CLASSES, HIDDEN = 10_240, 511, 104, 24
WINDOW, LANES, STEPS, SHARD = 16, 256, 250, 1 << 20
HEAD = 1 << 17
END, FIRST_RARE = 0, 1
END_TOKEN = b""
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().translate(_LOWER).split(), END_TOKEN]


def vocabulary(top: list[bytes], words: int = WORDS, rare: int = RARE) -> dict[bytes, int]:
    """Numbers of the words that the network tells apart, after the end and the rare symbols; top: tokens by falling count."""
    return {END_TOKEN: END} | {w: k for k, w in enumerate([w for w in top if w != END_TOKEN][:words], FIRST_RARE + rare)}


def rare_symbol(word: bytes, rare: int = RARE) -> int:
    import zlib

    return FIRST_RARE + zlib.crc32(word[-3:]) % rare


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(token, c) of the tokens with at least c occurrences, for the least c that at most `most` tokens reach; by falling
    count. The bound is found from histograms, so that the driver never gets more than `most` rows."""
    level = F.floor(F.log2("c") * 16)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("k")).count().collect()), reverse=True)
    taken, bound = 0, 1
    for k, n in sizes:
        if taken + n > most:
            for c, m in sorted(((r[0], r[1]) for r in counts.filter(level == k).groupBy("c").count().collect()), reverse=True):
                if taken + m > most:
                    bound = c + 1
                    break
                taken += m
            break
        taken += n
    return sorted(((bytes(r[0]), r[1]) for r in counts.filter(F.col("c") >= bound).collect()), key=lambda x: (-x[1], x[0]))


def token_counts(rows: DataFrame) -> DataFrame:
    """token (binary), c; rows has one text column. Counted in the worker before the shuffle."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def put(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["token", "c"])

        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens_of(t))
                if len(held) > 400_000:
                    yield put(held)
                    held = Counter()
        if held:
            yield put(held)

    return rows.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Network:
    """Parameters by name; tokens are indices below `vocabulary`, class k holding indices k*size .. (k+1)*size-1."""

    def __init__(self, vocabulary: int, classes: int = CLASSES, hidden: int = HIDDEN, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        self.size = -(-vocabulary // classes)
        self.real = vocabulary
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "e": draw(self.size * classes, 3 * hidden), "u": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "c": draw(hidden, classes), "cb": np.zeros(classes, np.float32),
            "w": draw(classes, hidden, self.size), "wb": np.zeros((classes, self.size), np.float32),
        }
        # places of the last class that stand for no token
        flat = self.p["wb"].reshape(-1)
        flat[vocabulary:] = -1e4

    def flat(self):
        import numpy as np

        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat):
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(x.dtype)
            at += x.size
        return self

    def states(self, ids, h, reset=None, keep=False):
        """States after each of the steps of ids (steps x lanes), from h; and what the backward pass needs."""
        import numpy as np

        n, p, out, kept = self.hidden, self.p, [], []
        for t in range(len(ids)):
            if reset is not None:
                h = h * reset[t][:, None]
            x = p["e"][ids[t]] + p["b"]
            a = h @ p["u"]
            g = x[:, : 2 * n] + a[:, : 2 * n]
            g *= g.dtype.type(0.5)  # a sigmoid by tanh, which has no overflow
            np.tanh(g, out=g)
            g += g.dtype.type(1)
            g *= g.dtype.type(0.5)
            z, r = g[:, :n], g[:, n:]
            m = r * a[:, 2 * n :]
            m += x[:, 2 * n :]
            np.tanh(m, out=m)
            new = h - m
            new *= z
            new += m
            if keep:
                kept.append((h, z, r, m, a[:, 2 * n :]))
            h = new
            out.append(h)
        return np.stack(out), kept

    def log_probs(self, h, target, grad: bool = False):
        """Natural log-probabilities of targets given states (rows); with grad also gradients of minus their sum."""
        import numpy as np

        p = self.p
        cls, word = target // self.size, target % self.size
        order = np.argsort(cls, kind="stable")
        h, cls, word = h[order], cls[order], word[order]
        cuts = np.searchsorted(cls, np.arange(self.classes + 1))
        # states are below 1 in size, so that logits beyond 80 stand for weights that have run away
        ex = h @ p["c"]
        ex += p["cb"]
        np.minimum(ex, 80, out=ex)
        rows = np.arange(len(h))
        lp = ex[rows, cls].copy()
        np.exp(ex, out=ex)
        total = ex.sum(1)
        lp -= np.log(total)
        if grad:
            ex *= (1 / total)[:, None]
            ex[rows, cls] -= 1
            dh, g = ex @ p["c"].T, {"c": h.T @ ex, "cb": ex.sum(0), "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
        for k in range(self.classes):
            a, z = cuts[k], cuts[k + 1]
            if a == z:
                continue
            own, w = h[a:z], p["w"][k]
            ew = own @ w
            ew += p["wb"][k]
            np.minimum(ew, 80, out=ew)
            at, to = rows[: z - a], word[a:z]
            lp[a:z] += ew[at, to]
            np.exp(ew, out=ew)
            tw = ew.sum(1)
            lp[a:z] -= np.log(tw)
            if grad:
                ew *= (1 / tw)[:, None]
                ew[at, to] -= 1
                dh[a:z] += ew @ w.T
                np.matmul(own.T, ew, out=g["w"][k])
                g["wb"][k] = ew.sum(0)
        back = np.empty(len(order), np.int64)
        back[order] = rows
        return (lp[back], dh[back], g) if grad else lp[back]

    def gradients(self, ids, target, h, reset):
        """Truncated backpropagation through one window: (log-probability, gradients, last state).

        The gradient of the embeddings is (words of the window, rows).
        """
        import numpy as np

        n, p = self.hidden, self.p
        hs, kept = self.states(ids, h, reset, keep=True)
        lp, dh, g = self.log_probs(hs.reshape(-1, n), target.reshape(-1), grad=True)
        dh = dh.reshape(hs.shape)
        g |= {"u": np.zeros_like(p["u"]), "b": np.zeros_like(p["b"])}
        carry, pre = np.zeros_like(h), []
        for t in range(len(ids) - 1, -1, -1):
            h0, z, r, m, an = kept[t]
            d = dh[t] + carry
            dm = d * (1 - z) * (1 - m * m)
            dz = d * (h0 - m) * z * (1 - z)
            dr = dm * an * r * (1 - r)
            da = np.concatenate((dz, dr, dm * r), 1)
            pre.append(np.concatenate((dz, dr, dm), 1))
            g["u"] += h0.T @ da
            carry = (d * z + da @ p["u"].T) * reset[t][:, None]
        pre = np.concatenate(pre[::-1])
        g["b"] = pre.sum(0)
        order = np.argsort(ids.reshape(-1), kind="stable")
        own = ids.reshape(-1)[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
        g["e"] = own[first], np.add.reduceat(pre[order], first, axis=0)
        return lp.sum(), g, hs[-1]

    def train(self, docs: list, lanes: int = LANES, window: int = WINDOW, steps: int = STEPS, rate: float = 0.01) -> int:
        """Adam over documents (index arrays) laid end to end and cut into lanes, fewer of them where there would be
        fewer than `steps` steps; returns the tokens seen."""
        import numpy as np

        docs = [d for d in docs if len(d)]
        if not docs:
            return 0
        flat = np.concatenate(docs).astype(np.int64)
        lanes = max(1, min(lanes, len(flat) // (steps * window)))
        length = -(-len(flat) // (lanes * window)) * window
        # one stream cut into equal lanes: a very long document adds no idle steps; less than a window a lane is filled with end tokens
        target = np.full(length * lanes, END, np.int64)
        target[: len(flat)] = flat
        source, live = np.concatenate(([END], target[:-1])), np.ones(length * lanes, np.float32)
        begin = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        begin = begin[begin < len(target)]
        source[begin], live[begin] = END, 0
        target, source, live = (np.ascontiguousarray(x.reshape(lanes, length).T) for x in (target, source, live))
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        h = np.zeros((lanes, self.hidden), np.float32)
        for at in range(0, length, window):
            _, g, h = self.gradients(source[at : at + window], target[at : at + window], h, live[at : at + window])
            step += 1
            pace, grown = np.float32(rate / (1 - 0.9**step)), np.float32(1 / (1 - 0.99**step))
            for k, x in self.p.items():
                # embeddings of words outside the window rest, so that a step does not cost the vocabulary
                at_k, gk = g[k] if k == "e" else (slice(None), g[k])
                gk = np.clip(gk * np.float32(50 / (lanes * window)), -1, 1)
                mk, vk = m[k][at_k], v[k][at_k]
                mk += np.float32(0.1) * (gk - mk)
                gk *= gk
                gk -= vk
                gk *= np.float32(0.01)
                vk += gk
                if k == "e":
                    m[k][at_k], v[k][at_k] = mk, vk
                np.multiply(vk, grown, out=gk)
                np.sqrt(gk, out=gk)
                gk += np.float32(1e-6)
                np.divide(mk, gk, out=gk)
                gk *= pace
                x[at_k] -= gk
        return len(flat)

    def log10_likelihoods(self, docs: list, group: int = 512, window: int = WINDOW):
        """log10-probability of each document (index arrays), the state carried across windows."""
        import numpy as np

        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
        for at in range(0, len(order), group):
            own = order[at : at + group]
            size = np.array([len(docs[k]) for k in own])
            h = np.zeros((len(own), self.hidden), np.float32)
            total = np.zeros(len(own))
            # documents are in descending length, so that the active ones are the first
            before = np.full(len(own), END, np.int64)
            held: list[tuple] = []

            def flush(held=held, total=total):
                if held:
                    hs, target, who = (np.concatenate(x) for x in zip(*held, strict=True))
                    total += np.bincount(who, self.log_probs(hs, target).astype(np.float64), minlength=len(total))
                    held.clear()

            for t0 in range(0, int(size[0]), window):
                n = int((size > t0).sum())
                span = min(window, int(size[0]) - t0)
                target = np.full((span, n), -1, np.int64)
                for j in range(n):
                    part = docs[own[j]][t0 : t0 + span]
                    target[: len(part), j] = part
                real = target >= 0
                safe = np.where(real, target, END)
                source = np.concatenate((before[None, :n], safe[:-1]))
                hs, _ = self.states(source, h[:n])
                held.append((hs[real], target[real], np.broadcast_to(np.arange(n), target.shape)[real]))
                # small windows share one pass over the classes
                if sum(len(x[1]) for x in held) >= 16384:
                    flush()
                h, before = hs[-1], safe[-1]
            flush()
            out[own] = total / np.log(10)
        return out


def _average(parts: DataFrame, fan: int) -> list:
    """Weighted means of (chunk, part, weight, values) over parts, in two levels; one row a chunk."""

    def add(key, table):
        import numpy as np
        import pandas as pd

        table = table.sort_values("part")
        total = np.zeros(len(table["values"].iloc[0]) // 4)
        for v, w in zip(table["values"], table["weight"], strict=True):
            total += np.frombuffer(v, "<f4") * w
        weight = float(table["weight"].sum())
        return pd.DataFrame({"chunk": [key[0]], "part": [int(table["part"].iloc[0])], "weight": [weight], "values": [(total / weight).astype("<f4").tobytes()]})

    schema = "chunk long, part long, weight double, values binary"
    return parts.withColumn("g", F.col("part") % fan).groupBy("chunk", "g").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema).orderBy("chunk").collect()


def plan_rounds(tokens: int, shard: int = SHARD) -> list[int]:
    """Shards of each round: 1, 1, 2, 4, ... until all shards are used."""
    left, out = max(1, -(-tokens // shard)), [1]
    left -= 1
    while left > 0:
        out.append(min(left, max(1, sum(out))))
        left -= out[-1]
    return out


def train(rows: DataFrame, index: dict[bytes, int], tokens: int, rare: int = RARE, shard: int = SHARD) -> Network:
    """rows: pick (a hash of the row) and t of the training documents; tokens: how many they hold."""
    import math

    import numpy as np

    spark, net, rounds = rows.sparkSession, Network(len(index) + rare), plan_rounds(tokens, shard)
    size, first = len(index) + rare, [0]
    for n in rounds:
        first.append(first[-1] + n)
    words = spark.sparkContext.broadcast(index)

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        known = words.value
        for b in batches:
            ids = [np.array([known[w] if w in known else rare_symbol(w, rare) for w in tokens_of(t)], "<u2" if size <= 65536 else "<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["pick", "ids"])

    kind = "<u2" if size <= 65536 else "<u4"
    place = F.pmod("pick", F.lit(first[-1]))
    turn = sum((F.when(place >= x, 1).otherwise(0) for x in first[1:-1]), F.lit(0))
    path = new_path(spark, "shards")
    rows.select("pick", "t").mapInArrow(encode, "pick long, ids binary").withColumn("shard", place).withColumn("turn", turn).write.partitionBy("turn").option("compression", "zstd").parquet(path)
    encoded = spark.read.schema("pick long, ids binary, shard long, turn int").parquet(path)
    pieces = 8
    for k, n in enumerate(rounds):
        start = spark.sparkContext.broadcast(net.flat())
        rate = 0.01 / (1 + 0.25 * k)

        def run(batches, start=start, rate=rate):
            import numpy as np
            import pyarrow as pa

            def learn(shard, own):
                one = Network(size).load(start.value)
                seen = one.train(own, rate=rate)
                parts = np.array_split(one.flat().astype("<f4"), pieces)
                return pa.RecordBatch.from_pydict({"chunk": list(range(pieces)), "part": [shard] * pieces, "weight": [float(seen)] * pieces, "values": [x.tobytes() for x in parts]})

            now, own = None, []
            for b in batches:
                for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if s != now and own:
                        yield learn(now, own)
                        own = []
                    now = s
                    own.append(np.frombuffer(ids, kind))
            if own:
                yield learn(now, own)

        share = encoded.filter(F.col("turn") == k).repartition(n, "shard").sortWithinPartitions("shard", "pick", "ids").select("shard", "ids")
        got = _average(share.mapInArrow(run, "chunk long, part long, weight double, values binary"), max(1, math.isqrt(n)))
        if got:
            net.load(np.concatenate([np.frombuffer(r["values"], "<f4") for r in got]))
        start.unpersist()
    delete(spark, path)
    return net


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = 7, words: int = WORDS, rare: int = RARE, head: int = HEAD, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    import math

    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), held_out(mod, doc_id).alias("held_out"))
    learned = rows.filter(~F.col("held_out")).select(F.xxhash64("doc_id", "t").alias("pick"), "t")
    counts = materialize(token_counts(learned.select("t")), "counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    top = most_frequent(counts, max(head, words + 1))
    index = vocabulary([w for w, _ in top], words, rare)
    known = dict(top)

    def symbols(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([rare_symbol(bytes(w), rare) for w in b.column(0).to_pylist()], pa.int64()), b.column(1)], names=["symbol", "c"])

    # tokens and distinct words of each rare symbol: those of all words less those of the network's own words
    totals = np.zeros((rare + FIRST_RARE, 2))
    for r in counts.mapInArrow(symbols, "symbol long, c long").groupBy("symbol").agg(F.sum("c").alias("u"), F.count("*").alias("d")).collect():
        totals[r["symbol"]] = r["u"], r["d"]
    for w in index:
        if w in known:
            totals[rare_symbol(w, rare)] -= known[w], 1
    spread = np.log10(totals.sum(1) + 1)
    net = train(learned, index, n, rare, shard)
    size = len(index) + rare
    # plain values are broadcast and the network is built in the task, so that workers need no copy of this package
    shared = spark.sparkContext.broadcast((index, known, net.flat(), spread))

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        index, known, flat, spread = shared.value
        own_net = Network(size).load(flat)
        at_of = lambda w: index[w] if w in index else rare_symbol(w, rare)
        logs = {w: (at_of(w), math.log10(c + 1)) for w, c in known.items()}
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ids, n_tokens, all_logs, rest_logs, head_known, tails, times = [], [], [], [], [], [], []
                for t in part.column("t").to_pylist():
                    tokens = tokens_of(t)
                    found = list(map(logs.get, tokens))
                    tail: Counter = Counter()
                    if None in found:
                        tail.update(w for w, x in zip(tokens, found, strict=True) if x is None)
                        place = {w: (at_of(w), 0.0) for w in tail}
                        found = [x or place[w] for w, x in zip(tokens, found, strict=True)]
                    own = np.array([x[0] for x in found], np.int64)
                    lg = np.array([x[1] for x in found])
                    scarce = (own >= FIRST_RARE) & (own < FIRST_RARE + rare)
                    ids.append(own)
                    n_tokens.append(len(tokens))
                    all_logs.append(lg.sum())
                    rest_logs.append(lg[scarce].sum() - spread[own[scarce]].sum())
                    head_known.append(len(tokens) - sum(tail.values()))
                    tails.append(list(tail))
                    times.append(list(tail.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(head_known, pa.int64()), pa.array(all_logs, pa.float64()), pa.array(own_net.log10_likelihoods(ids) + np.array(rest_logs), pa.float64()), pa.array(tails, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "held_out", "n_tokens", "head_known", "logs", "net", "tail", "times"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    marked = materialize(
        rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, head_known long, logs double, net double, tail array<binary>, times array<long>"), "scored",
    )
    pairs = marked.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("token"), F.col("x.times").alias("times"))
    tail = materialize(pairs.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more")), "tail")
    drop(counts)
    more = F.coalesce("more", F.lit(0.0))
    return marked.select("row", "doc_id", "held_out", "n_tokens", "head_known", "logs", "net").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("net") + more).alias("score"),
    )
