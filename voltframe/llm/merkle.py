"""A Merkle manifest of a dataset with proofs by parent preimages, in DataFrame functions alone.

Leaves are hashes of rows; per language they ascend by identifier. Every two consecutive nodes become one parent (a
last single one, too), until one is left, the language's subroot; subroots in order of language become the root in
the same way. A parent's preimage is the text it hashes, its children's hashes side by side. The manifest keeps
preimages, level by level, in blocks of leaves: a leaf joins those of its ancestors, cuts its own 64 characters out
for the siblings that prove it, or puts another hash in their place to fold a changed leaf up to a root.

Blocks of `1 << BITS` nodes are hashed in one row each, and block roots are the nodes of the next round, so a table of
any size takes one shuffle a round, and a language that holds most rows is as many blocks as it needs. Places come
from a range sort; nothing is collected.

A null value hashes as `-`. A null language comes first and is one of its own; null identifiers come first within it.
Equal identifiers are ordered by leaf hash; identical rows have equal hashes in neighbouring places. A language with
one leaf has it as its subroot; one language alone has its subroot as root. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, materialize
from .numbering import numbered

BITS, HEX, FIELDS = 9, 64, ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_hash(values: list[Column]) -> Column:
    """Digest of the values, each as its UTF-8 byte count, a colon and itself, or `-`."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return digest(F.concat(*parts))


def _levels(hashes: Column, height: Column) -> Column:
    """Preimages of each level above the hashes, and the hashes of the last one."""

    def step(state: Column, _: Column) -> Column:
        now = state["now"]
        # preimages are kept, their digests are what the next level pairs
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(now) - 1) / 2).cast("int")), lambda i: F.concat(F.get(now, 2 * i), F.coalesce(F.get(now, 2 * i + 1), F.lit(""))))
        return F.struct(F.transform(pairs, digest).alias("now"), F.concat(state["levels"], F.array(pairs)).alias("levels"))

    none = F.array().cast("array<array<string>>")
    start = F.struct(hashes.alias("now"), none.alias("levels"))
    return F.aggregate(F.filter(F.sequence(F.lit(0), height), lambda k: k > 0), start, step)


def climb(nodes: DataFrame, most: int, top: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """g, i, h, x, path, top of nodes (g, n, i, h, x): n nodes a group g in places i, hashes h, anything in x.

    `path` holds the preimage of every ancestor and the slot (0 or 1) of the node below it. `most` is the largest n.
    top() takes the group's roots (g, h) and gives g, path (ancestors above the group's root) and top (a struct).
    """
    size = 1 << BITS
    rows = nodes.groupBy("g", "n", F.shiftright("i", BITS).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "h", "x"))).alias("rows"))
    # a block of many is hashed up to its full height, one alone until a single hash is left
    height = F.when(F.col("n") > size, F.lit(BITS)).when(F.col("n") < 2, 0).otherwise(F.length(F.bin(F.col("n") - 1))).cast("int")
    tree = _levels(F.transform("rows", lambda r: r["h"]), height)
    blocks = materialize(rows.select("g", "n", "b", "rows", tree.alias("t")).select("g", "n", "b", "rows", "t.levels", F.element_at("t.now", 1).alias("h")), "blocks")
    if most > size:
        nobody = F.lit(None).cast("int")
        upper = climb(blocks.select("g", F.ceil(F.col("n") / size).alias("n"), F.col("b").alias("i"), "h", nobody.alias("x")), -(-most // size), top).select("g", F.col("i").alias("b"), "path", "top")
    else:
        upper = top(blocks.select("g", "h")).select("g", F.lit(0).cast("long").alias("b"), "path", "top")
    one = blocks.select("g", "b", "rows", "levels").join(upper, ["g", "b"]).select("g", F.explode("rows").alias("r"), "levels", "path", "top")
    at = F.col("r.i").bitwiseAND(size - 1).cast("int")
    own = F.transform("levels", lambda level, k: F.struct(F.get(level, F.call_function("shiftright", at, k + 1)).alias("preimage"), F.call_function("shiftright", at, k).bitwiseAND(1).alias("slot")))
    return one.select("g", "r.i", "r.h", "r.x", F.concat(own, "path").alias("path"), "top")


def siblings(path: Column) -> Column:
    """Hashes beside a leaf and its ancestors, from the bottom up, side by side."""
    return F.concat_ws("", F.transform(path, lambda p: F.concat(F.substring(p["preimage"], F.lit(1), p["slot"] * HEX), F.substring(p["preimage"], p["slot"] * HEX + HEX + 1, F.lit(HEX)))))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the path's siblings."""
    return F.aggregate(path, leaf, lambda h, p: digest(F.concat(F.substring(p["preimage"], F.lit(1), p["slot"] * HEX), h, F.substring(p["preimage"], p["slot"] * HEX + HEX + 1, F.lit(HEX)))))


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, other, subroot, root, path of rows (lang, doc_id, leaf, other); `other` is carried along."""
    one = numbered(materialize(leaves, "leaves"), [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")], "place")
    groups = one.groupBy("lang").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    groups = materialize(numbered(groups, [F.col("start")], "g"), "languages")
    n_groups, most = groups.agg(F.count("*"), F.max("n")).first()
    nodes = one.alias("o").join(groups.alias("p"), F.col("o.lang").eqNullSafe(F.col("p.lang"))).select("p.g", "p.n", (F.col("o.place") - F.col("p.start")).alias("i"), F.col("o.leaf").alias("h"), F.struct("o.doc_id", "o.other").alias("x"))

    def root(roots: DataFrame) -> DataFrame:
        path = F.array().cast("array<struct<preimage:string,slot:int>>")
        return roots.select("g", path.alias("path"), F.struct(F.col("h").alias("root")).alias("top"))

    def languages(subroots: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("long")
        above = climb(subroots.select(zero.alias("g"), F.lit(n_groups).cast("long").alias("n"), F.col("g").alias("i"), "h", F.lit(None).cast("int").alias("x")), n_groups, root)
        return above.select(F.col("i").alias("g"), "path", F.struct(F.col("h").alias("subroot"), F.col("top.root").alias("root")).alias("top"))

    return climb(nodes, most or 0, languages).select("x.doc_id", F.col("h").alias("leaf"), "x.other", "top.subroot", "top.root", "path")


def verify(docs: DataFrame, tampered: Callable[[Column], Column] = lambda crc: crc % 7 == 0) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of the documents, folded again
    from a leaf whose n_chars is one more where tampered(crc32 of the identifier) holds."""
    own = leaf_hash([F.col(c) for c in FIELDS])
    changed = F.coalesce(tampered(crc_of_id("doc_id")), F.lit(False)) & F.col("n_chars").isNotNull()
    other = F.when(changed, leaf_hash([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]))
    found = manifest(docs.select("lang", "doc_id", own.alias("leaf"), other.alias("other")))
    found = found.withColumn("proof_sha256", digest(siblings(F.col("path")))).withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
