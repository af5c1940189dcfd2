"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Thresholds are the constants below.

In every stage an empty table gives an empty one; columns beyond doc_id and text pass through, whatever their names.
A null text is not toxic, has no lines and holds no benchmark window; null and empty texts are copies of one another.
Rows with a null identifier are kept like others and come last in a group of copies. Repeated rows share their fate,
but for near_dedup, which keeps the first of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.llm import curve_packing, decontam, near_copies, template_dedup, toxicity
from voltframe.llm.common import documents, drop, fresh, materialize

TOXIC_FROM = 0.5
#: Near copies: exact similarity of the sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score TOXIC_FROM or more; the model is trained on labels of the training side."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs.columns, "score")
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), into=score)
    return scored.filter(F.col(score) < TOXIC_FROM).select(docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates; n_chars follows the text."""
    out, _, dropped = template_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest identifier (the first row, if repeated)."""
    row, component = fresh(docs.columns, "row"), fresh(docs.columns, "component_id")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = near_copies.near_copies(rows, row, "text", SHINGLE, SIMILARITY).withColumnRenamed("component_id", component)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = rows.select(row, "doc_id").join(classes, row).groupBy(component).agg(F.min_by(row, order).alias(row))
    return rows.join(first.select(row), row, "left_semi").select(docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns), prefix=prefix)
    return found.filter(F.col(f"{prefix}n_hit") == 0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left along the curve."""
    import public_tokenizers

    return curve_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
