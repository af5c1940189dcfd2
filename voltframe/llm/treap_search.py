"""Ranked lexical search over inverted treaps.

`build` cuts the documents of each task into segments and inverts each: a term's postings are a treap, a search tree
by document (in order of identifier) whose root has the largest impact, and so on down each side. Impacts hold what a
term's frequency and the document's length give; they need the corpus' size and mean length, which a first pass over
the texts counts. A segment is one row of the index; nothing is shuffled to build it.

`search` takes items in blocks of bounded size against every segment. The treaps of an item's terms are walked together:
a state is an interval of documents and for each term the root of what its treap holds in there. The sum of the roots'
weighted impacts bounds the score of every document in the interval, so an interval whose bound is below the k-th score
so far is given up with all its subtrees; else the document of the largest root is scored whole and splits the
interval in two. States of largest bound come first, many at a time. The k-th score is carried from segment to
segment of a task, which hands on at most k documents an item.

Scores are exact: whole numbers as in `search`. Ties go to smaller identifiers; null identifiers come last. Null
texts, and texts without a term, are in no list and do not count as documents. Repeated rows are documents of their
own. Items are told apart by identifier (null is one), terms of rows with the same one are taken together. An empty
table of documents or items gives no rows. Extra columns are not read. Texts that are not valid UTF-8 are read by byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tokens of a segment, bytes of item terms in a block, states expanded at once.
SEGMENT, BLOCK_BYTES, STEP = 2_000_000, 4 << 20, 128
K = 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _byte_table() -> bytes:
    """A-Z lower-cased, digits, a-z and what is not ASCII kept, all else a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term (bytes), each pair once."""
    terms = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(item_id).alias("item_id"), F.explode(terms).alias("term")).select("item_id", F.col("term").cast("binary").alias("term")).distinct()


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    table = _byte_table()

    def run(batches):
        import pyarrow as pa

        n = total = 0
        for b in batches:
            for x in b.column(0):
                k = len(x.as_py().translate(table).split())
                n, total = n + (k > 0), total + k
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    parts = docs.select(F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL").mapInArrow(run, "n long, total long")
    n, total = parts.agg(F.sum("n"), F.sum("total")).first()
    return n or 0, total or 0


def _children(start: list[int], rank: list[int]) -> tuple[list[int], list[int]]:
    """Left and right child of each posting in the treap of its list; rank is the heap order, start the lists' bounds."""
    left, right = [-1] * len(rank), [-1] * len(rank)
    for a, z in zip(start[:-1], start[1:], strict=True):
        spine: list[int] = []
        for i in range(a, z):
            r, below = rank[i], -1
            while spine and rank[spine[-1]] < r:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
    return left, right


def _segment(ids: list, tokens: list, vocabulary: dict, n_docs: int, n_terms: int, seed: int) -> tuple:
    """One row of the index: identifiers in order, terms, list lengths and roots, and bytes of 32-bit documents, impacts
    and children."""
    import numpy as np

    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))
    terms = sorted(vocabulary)
    place = np.empty(len(terms), np.int64)
    place[[vocabulary[t] for t in terms]] = np.arange(len(terms))
    length = np.array([len(tokens[k]) for k in order], np.int64)
    key, tf = np.unique(place[np.concatenate([tokens[k] for k in order])] * len(ids) + np.repeat(np.arange(len(ids)), length), return_counts=True)
    term, doc = np.divmod(key, len(ids))
    m = 50 + (50 * length * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    # documents of equal impact are put on top of each other at random, which keeps trees flat
    rank = (impact << 24) + np.random.default_rng(seed).permutation(len(key)) % (1 << 24)
    left, right = _children(start.tolist(), rank.tolist())
    root = np.arange(len(key))
    by_rank = np.lexsort((rank, term))
    root = by_rank[start[1:] - 1]
    pack = lambda x: np.asarray(x, "<i4").tobytes()
    return [ids[k] for k in order], terms, np.diff(start).tolist(), pack(root), pack(doc), pack(impact), pack(left), pack(right)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> tuple[DataFrame, int]:
    """The index, a table in the shared folder, and the number of documents in it."""
    n_docs, n_terms = corpus_size(docs, text)
    table, kind = _byte_table(), docs.schema[doc_id].dataType

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, tokens, vocabulary, held, made = [], [], {}, 0, 0
        out = None

        def cut():
            row = _segment(ids, tokens, vocabulary, n_docs, n_terms, made)
            kinds = (pa.list_(out), pa.list_(pa.binary()), pa.list_(pa.int32()), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["ids", "terms", "counts", "root", "doc", "impact", "left", "right"])

        for b in batches:
            out = b.schema.field(0).type
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = x.as_py().translate(table).split()
                if not words:
                    continue
                number = vocabulary.setdefault
                ids.append(i)
                tokens.append(np.array([number(w, len(vocabulary)) for w in words], np.int64))
                held += len(words)
                if held >= segment:
                    yield cut()
                    ids, tokens, vocabulary, held, made = [], [], {}, 0, made + 1
        if ids:
            yield cut()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL")
    schema = f"ids array<{kind.simpleString()}>, terms array<binary>, counts array<int>, root binary, doc binary, impact binary, left binary, right binary"
    return materialize(rows.mapInArrow(run, schema), "treaps", large_rows=True), n_docs


def weights(index: DataFrame, n_docs: int, terms: DataFrame) -> DataFrame:
    """item_id, term, w of the terms (item_id, term) that some document holds, by how many do."""
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    return terms.join(df.select("term", w.alias("w")), "term").filter("w > 0").select("item_id", "term", "w")


class _Segment:
    """Treaps of one row of the index."""

    def __init__(self, ids, terms, root, doc, impact, left, right):
        import numpy as np

        read = lambda x: np.frombuffer(x, "<i4").astype(np.int64)
        # a last posting stands for none: index -1
        self.doc, self.impact = np.append(read(doc), -1), np.append(read(impact), 0)
        self.left, self.right, self.root = read(left), read(right), read(root)
        self.ids, self.place = ids, {t: k for k, t in enumerate(terms)}
        self.terms = np.zeros(len(self.doc) - 1, np.int64)
        self.size = len(ids)

    def keys(self, counts):
        import numpy as np

        return np.repeat(np.arange(len(counts)), counts) * self.size + self.doc[:-1]

    def descend(self, node, low, high):
        """The topmost posting between low and high (both excluded) at or below each node."""
        import numpy as np

        out = node.copy()
        live = np.flatnonzero(out >= 0)
        while live.size:
            at = out[live]
            k = self.doc[at]
            up, down = k <= low[live], k >= high[live]
            move = up | down
            live, at, up = live[move], at[move], up[move]
            out[live] = below = np.where(up, self.right[at], self.left[at])
            live = live[below >= 0]
        return out


def _walk(seg: _Segment, keys, terms, w, k: int, best: list):
    """Scores and documents of a segment that may be among an item's k best, whose scores so far are `best`."""
    import numpy as np

    nodes = seg.root[terms][None, :]
    low, high = np.array([-1]), np.array([seg.size])
    bound = (w * seg.impact[nodes]).sum(1)
    scores, docs = np.array(best, np.int64), np.full(len(best), -1)
    least = 1
    while True:
        if len(scores) >= k:
            least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        live = bound >= least
        if not live.all():
            nodes, low, high, bound = nodes[live], low[live], high[live], bound[live]
        if not len(bound):
            keep = scores >= least
            return scores[keep & (docs >= 0)], docs[keep & (docs >= 0)]
        if len(bound) > STEP:
            first = np.zeros(len(bound), bool)
            first[np.argpartition(bound, len(bound) - STEP)[-STEP:]] = True
            rest = (nodes[~first], low[~first], high[~first], bound[~first])
            nodes, low, high = nodes[first], low[first], high[first]
        else:
            rest = None
        top = nodes[np.arange(len(nodes)), (w * seg.impact[nodes]).argmax(1)]
        d = seg.doc[top]
        # the whole score of the document that splits the interval
        want = terms[None, :] * seg.size + d[:, None]
        at = np.searchsorted(keys, want.ravel()).reshape(want.shape)
        at = np.where(keys[np.minimum(at, len(keys) - 1)] == want, np.minimum(at, len(keys) - 1), -1)
        scores, docs = np.append(scores, (w * seg.impact[at]).sum(1)), np.append(docs, d)
        t = nodes.shape[1]
        two = np.concatenate((nodes, nodes)).ravel()
        low, high = np.concatenate((low, d)), np.concatenate((d, high))
        nodes = seg.descend(two, np.repeat(low, t), np.repeat(high, t)).reshape(-1, t)
        bound = (w * seg.impact[nodes]).sum(1)
        if rest is not None:
            nodes, low, high, bound = np.concatenate((nodes, rest[0])), np.concatenate((low, rest[1])), np.concatenate((high, rest[2])), np.concatenate((bound, rest[3]))


def _order(hit: tuple) -> tuple:
    return (-hit[0], hit[1] is None, hit[1] if hit[1] is not None else 0)


def search(index: DataFrame, n_docs: int, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents with a score above 0.

    A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a document's score is the sum of w times its impact.
    Only a block of items, of block_bytes of terms or a single item, is sent to the executors at a time.
    """
    terms = materialize(item_terms(items, item_id, text), "terms")
    weighed = materialize(weights(index, n_docs, terms), "weights")
    spark, session = index.sparkSession, index.sparkSession.sparkContext
    n_blocks = max(1, -(-(weighed.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0) // block_bytes))
    item_type = to_arrow_type(items.schema[item_id].dataType)
    kind_item, kind_doc = items.schema[item_id].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    schema = f"item_id {kind_item}, doc_id {kind_doc}, score long"
    found = None
    for block in range(n_blocks):
        part = weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        asked = [(r["item_id"], [bytes(x["term"]) for x in r["x"]], [x["w"] for x in r["x"]]) for r in part.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("x")).collect()]
        if not asked:
            continue
        sent = session.broadcast(asked)

        def run(batches, sent=sent):
            import numpy as np
            import pyarrow as pa

            asked, best = sent.value, {}
            types = None
            for b in batches:
                types = b.schema.field(0).type.value_type
                for row in range(b.num_rows):
                    ids, words, counts, *rest = (b.column(c)[row].as_py() for c in range(8))
                    seg = _Segment(ids, words, *rest)
                    keys = seg.keys(counts)
                    for q, (_, term, w) in enumerate(asked):
                        have = [(seg.place[t], x) for t, x in zip(term, w, strict=True) if t in seg.place]
                        if not have:
                            continue
                        at, w = np.array(have, np.int64).T
                        held = best.get(q, [])
                        scores, docs = _walk(seg, keys, at, w, k, [x[0] for x in held])
                        if len(scores):
                            best[q] = sorted(held + [(int(s), ids[d]) for s, d in zip(scores, docs, strict=True)], key=_order)[:k]
            if best:
                rows = [(asked[q][0], d, s) for q, hits in best.items() for s, d in hits]
                i, d, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, item_type), pa.array(d, types), pa.array(s, pa.int64())], names=["item_id", "doc_id", "score"])

        one = index.select("ids", "terms", "counts", "root", "doc", "impact", "left", "right").mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    by = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    drop(terms)
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
