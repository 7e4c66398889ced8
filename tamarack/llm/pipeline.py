"""Documents to training sequences: five stages, each written and read again.

Every stage takes null ids and texts, empty tables, repeated rows and further columns, whatever their names, as its operator
does; ties go as there. All but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import decontaminate, line_dedup, near_duplicates, packing, quality_rules
from tamarack.llm.common import Scratch, free_names, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep; null and empty texts go."""
    model = quality_rules.train(docs, read(spark, sf_dir, "labels"))
    added = [f.split()[0] for f in quality_rules.ADDED.split(", ")]
    kept = free_names(docs.columns, added)[added.index("kept")]
    return quality_rules.apply(docs, model).where(F.col(kept)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of like lines; documents that lose all their lines go. n_chars follows the text."""
    left = line_dedup.drop_emptied(line_dedup.dedup_lines(docs), docs.columns)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("decontamination", benchmark), ("packing", pack)]

#: SQL cannot express the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
