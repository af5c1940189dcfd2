"""Line dedup by a log-template tree.

Each line's tokens are masked (runs of digits become 0; tokens that are mostly digits, addresses and links become
<*>) and parsed by a tree of fixed depth: the number of tokens, then the leading `depth` tokens. In a leaf, a
token place keeps a token that at least `min_docs` documents share there; any other token is generalised to <*>.
A line's template is the leaf with the generalised tokens. Templates with at least `min_constant` of their places
constant that occur in `min_docs` documents or more are recurring, and their lines are dropped wherever they stand.

A line that recurs as it is (masked) needs the less support the longer it is: min_docs * min_tokens / tokens classes,
two at least. So 5 tokens need 20, 20 tokens 5 and 50 tokens 2.

Supports count classes of near copies (near_copies), not texts: texts that are copies of one another as a whole
count once, so that their lines do not recur by that, and near-duplicate removal decides about them. A recurring line
is dropped whatever its share of a text.

Lines under `min_tokens` tokens carry too little to be called templates and stay. Null texts stay null; a text that
loses all its lines becomes empty and is kept, its row too. Ties do not arise, as the rules
do not depend on order. Repeated rows are treated alike, other columns pass through, whatever their names.

Nothing but hashes and counts is shuffled for lines that do not recur; a leaf is never gathered in one task:
supports and templates are ordinary aggregates, pre-aggregated before each shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, drop, fresh, materialize
from .near_copies import near_copies

DEPTH, MIN_TOKENS, MIN_DOCS, MIN_CONSTANT = 3, 5, 20, 0.6
#: Bands of the first search for near copies; what they miss the exact search finds.
BANDS = 8
#: Bits of the fixed-size filter that picks lines of busy leaves for the second scan; extra lines do no harm.
FILTER_BITS = 1 << 22
_SPECIAL = re.compile(r"[\d@:]")
_DIGITS = re.compile(r"\d+")
_VARIABLE = re.compile(r"\S*(?:://|@)\S*|\S*\d\S*\d\S*\d\S*\d\S*")


def mask(line: str) -> list[str]:
    if _SPECIAL.search(line):
        line = _DIGITS.sub("0", _VARIABLE.sub("<*>", line))
    return line.lower().split()


def hash64(text: str) -> int:
    """The same as Spark's xxhash64()."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def parse(text: str, depth: int, min_tokens: int):
    """(line number, leaf, tokens) of each line long enough."""
    for k, line in enumerate(text.split("\n")):
        tokens = mask(line)
        if len(tokens) >= min_tokens:
            yield k, hash64(f"{len(tokens)} {' '.join(tokens[:depth])}"), tokens


def parsed_lines(docs: DataFrame, text: str, depth: int, min_tokens: int) -> DataFrame:
    """copy, leaf, line, place, size: every long enough line of each text, as hashes and numbers."""
    names = ["copy", "leaf", "line", "place", "size"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for t in set(b.column(0).to_pylist()):
                copy = hash64(t)
                rows += [(copy, leaf, hash64(" ".join(tokens)), k, len(tokens)) for k, leaf, tokens in parse(t, depth, min_tokens)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    return docs.select(F.col(text).alias("t")).filter(F.col("t").isNotNull()).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def line_texts(docs: DataFrame, text: str, depth: int, min_tokens: int, chosen) -> DataFrame:
    """leaf, line, tokens of the lines whose leaf is in the filter, each once a batch."""

    def run(batches):
        import pyarrow as pa

        bits = chosen.value
        for b in batches:
            out: dict[int, tuple] = {}
            for t in set(b.column(0).to_pylist()):
                for _, leaf, tokens in parse(t, depth, min_tokens):
                    at = leaf % FILTER_BITS
                    if bits[at >> 3] >> (at & 7) & 1:
                        out[hash64(" ".join(tokens))] = (leaf, tokens)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in out.values()], pa.int64()), pa.array(list(out), pa.int64()), pa.array([v[1] for v in out.values()], pa.list_(pa.string()))], names=["leaf", "line", "tokens"])

    return docs.select(F.col(text).alias("t")).filter(F.col("t").isNotNull()).mapInArrow(run, "leaf long, line long, tokens array<string>")


def classed_texts(docs: DataFrame, text: str) -> DataFrame:
    """copy (hash of the text), class: equal for texts that near copies connect, each link decided by the sets of shingles."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("t")).filter(F.col("t").isNotNull()), "texts")
    named = near_copies(rows, "row", "t", bands=BANDS, radius=None)
    out = materialize(rows.select("row", F.xxhash64("t").alias("copy")).join(named, "row").groupBy("copy").agg(F.min("component_id").alias("class")), "classes")
    drop(rows)
    drop(named)
    return out


def supported(groups: DataFrame, by: list[str], pairs: DataFrame, min_docs: int) -> DataFrame:
    """by, n_docs (at least): groups of lines (by, leaf, line, n) found in min_docs classes or more.

    The classes of a group are counted only where neither its largest line proves enough nor the sum disproves it,
    so that a line of many classes is never spread out.
    """
    sums = groups.groupBy(*by).agg(F.sum("n").alias("total"), F.max("n").alias("n_docs")).filter(F.col("total") >= min_docs)
    open_ = groups.join(sums.filter(F.col("n_docs") < min_docs).select(*by), by, "left_semi").select(*dict.fromkeys([*by, "leaf", "line"]))
    exact = open_.join(pairs, ["leaf", "line"]).select(*by, "class").distinct().groupBy(*by).agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return sums.filter(F.col("n_docs") >= min_docs).select(*by, "n_docs").union(exact)


def recurring_lines(docs: DataFrame, parsed: DataFrame, text: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """line, template, n_docs (at least): hashes of the lines that recur, as templates or (template null) as they are."""
    spark = docs.sparkSession
    classed = classed_texts(docs, text)
    pairs = materialize(parsed.select("copy", "leaf", "line").distinct().join(classed, "copy").select("leaf", "line", "class").distinct(), "pairs")
    drop(classed)
    counts = materialize(pairs.groupBy("leaf", "line").agg(F.count("*").alias("n")), "counts")
    sizes = parsed.groupBy("line").agg(F.first("size").alias("size"))
    often = counts.filter("n > 1").join(sizes, "line").filter(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.lit(min_docs * min_tokens) / F.col("size"))))
    busy = counts.groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
    # busy leaves as a bitmap of FILTER_BITS, whatever their number
    chosen = spark.sparkContext.broadcast(bitmap(busy, F.col("leaf"), FILTER_BITS))
    texts = line_texts(docs, text, depth, min_tokens, chosen).groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    lines = materialize(texts.join(counts, ["leaf", "line"]).join(busy.select("leaf"), "leaf", "left_semi"), "busy")
    spots = lines.select("leaf", "line", "n", F.posexplode("tokens").alias("at", "token"))
    shared = supported(spots, ["leaf", "at", "token"], pairs, min_docs).withColumnRenamed("n_docs", "support")
    kept = spots.join(shared, ["leaf", "at", "token"], "left").select("leaf", "line", "n", F.struct("at", F.when(F.col("support").isNotNull(), F.col("token")).otherwise("<*>").alias("token")).alias("x"), F.col("support").isNotNull().cast("int").alias("fixed"))
    general = kept.groupBy("leaf", "line", "n").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["token"])).alias("template"), F.avg("fixed").alias("constant"))
    general = general.filter(F.col("constant") >= min_constant)
    totals = supported(general, ["leaf", "template"], pairs, min_docs)
    by_template = general.select("leaf", "line", "template").join(totals, ["leaf", "template"]).select("line", "template", "n_docs")
    out = materialize(by_template.union(often.select("line", F.lit(None).cast("string"), "n")), "recurring")
    for t in (pairs, counts, lines):
        drop(t)
    return out


def dropped_places(parsed: DataFrame, recurring: DataFrame) -> DataFrame:
    """copy (hash of the text), places: numbers of the lines to drop, for texts that have any."""
    found = parsed.select("copy", "line", "place").join(recurring.select("line"), "line", "left_semi").distinct()  # equal texts in several batches
    return found.groupBy("copy").agg(F.array_sort(F.collect_list("place")).alias("places"))


def drop_lines(docs: DataFrame, places: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the lines gone from `text`, and the names of two added columns: lines before and lines dropped."""
    copy, gone, total, dropped = (fresh(docs.columns, x) for x in ("copy", "places", "n_lines", "n_dropped"))
    keyed = docs.withColumn(copy, F.xxhash64(F.col(text)))
    # places follow the corpus, so that they are never broadcast, at no size
    found = keyed.join(places.select(F.col("copy").alias(copy), F.col("places").alias(gone)).hint("merge"), copy, "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(F.col(gone), i.cast("long")), F.lit(False))), "\n")
    out = found.withColumn(total, F.coalesce(F.size(lines), F.lit(0))).withColumn(dropped, F.coalesce(F.size(gone), F.lit(0))).withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept))
    return out.select(*docs.columns, total, dropped), total, dropped


def dedup_lines(docs: DataFrame, text: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> tuple[DataFrame, str, str]:
    """drop_lines() of the lines whose template recurs."""
    parsed = materialize(parsed_lines(docs, text, depth, min_tokens), "parsed")
    recurring = recurring_lines(docs, parsed, text, depth, min_tokens, min_docs, min_constant)
    places = materialize(dropped_places(parsed, recurring), "places")
    drop(parsed)
    drop(recurring)
    return drop_lines(docs, places, text)
