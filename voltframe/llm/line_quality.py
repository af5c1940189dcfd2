"""Cross-document line frequency, in DataFrame functions alone.

Lines are normalised (lower case, digits as 0, other runs of anything but letters and digits as one space) and
hashed; a line's frequency is the number of documents of its host that hold it, once each. Lines in more than
`max_docs` documents are removed, in hosts of any size: what no two people write is boilerplate in its sixth document,
whether the host has fifty or a billion. A document is rejected if it fails the base rules, or if removal leaves fewer than `min_words` words or less than `min_left`
of its words.

Base rules: under 10 words, or over a fifth of the words in five-word windows that occur twice or more.

Null and empty texts have no words and fail. A null host is a host of its own. Every row is a document, exact copies
and repeated rows too, so that a text found in many documents of a host is depleted and rejected. Copies share their
verdict within a host. An empty table gives no rows. Only
the named columns are read. Text never leaves the scan: what is shuffled is line hashes, pre-aggregated, and the
join back is a shuffle join whose skewed keys Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_SPACES, _SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
MAX_DOCS, MIN_WORDS, MIN_LEFT, WINDOW = 5, 10, 0.3, 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows found twice or more; sorted by hash, so that long texts cost n log n."""

    def spread(hashes: Column) -> Column:
        def covered(places: Column) -> Column:
            # each window covers up to the next one's begin
            return F.aggregate(
                places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).cast("long").alias("last")),
                lambda a, p: F.struct((a["n"] + F.least(F.lit(window).cast("long"), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"],
            )

        def repeated(ordered: Column) -> Column:
            same = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]))
            return _let(F.array_sort(F.transform(same, lambda x: x["p"])), covered)

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(F.sort_array(pairs), repeated))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    return _let(words, lambda w: F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(_let(hashed(w), spread)))


def base_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: what the base rules and the line step need; the text itself is not kept."""
    t = F.coalesce(F.col("t"), F.lit(""))
    normal = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\p{Nd}+", "0"), r"[^\p{L}\p{M}\p{N}]+", " "))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("t"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    words = rows.select(
        "doc_id", "host", F.xxhash64("t").alias("copy"), words_of(t).alias("w"), lines.alias("l"),
        F.length(F.translate(t, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return words.select(
        "doc_id", "host", "copy", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("w")).alias("n_repeat_words"),
        F.transform("l", lambda x: F.struct(F.xxhash64(normal(x)).alias("h"), F.size(words_of(x)).alias("n"))).alias("lines"),
    )


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, host, counts, base_failed, n_removed_lines, n_words_left, kept."""
    from .common import materialize

    # a few dozen bytes a document and line, read three times below
    base = materialize(base_columns(docs, doc_id, text, host), "lines")
    base = base.withColumn("host_key", F.xxhash64(F.coalesce(F.col("host"), F.lit("")), F.col("host").isNull()))
    copies = base.groupBy("host_key", "copy").agg(F.first("lines").alias("lines"), F.count("*").alias("rows"))
    held = copies.select("host_key", "rows", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    often = held.groupBy("host_key", "h").agg(F.sum("rows").alias("n")).filter(F.col("n") > max_docs).select("host_key", "h")
    in_copies = copies.select("host_key", "copy", F.explode("lines").alias("x")).select("host_key", "copy", "x.h", "x.n")
    removed = in_copies.join(often, ["host_key", "h"], "left_semi").groupBy("host_key", "copy").agg(F.count("*").alias("n_removed_lines"), F.sum("n").alias("gone"))
    out = base.drop("lines").join(removed, ["host_key", "copy"], "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.coalesce("n_removed_lines", F.lit(0)).alias("n_removed_lines"), left.alias("n_words_left"),
        (~failed & (left >= min_words) & (left >= F.col("n_words") * min_left)).alias("kept"),
    )
