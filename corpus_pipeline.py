"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm import decontaminate, line_dedup, minhash, packing, quality
from gridfold.llm.common import Scratch, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with all columns but doc_id and text under names that no operator uses."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"_kept{i}" for i, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. Null and empty texts are judged as
    empty, repeated rows alike; columns of any name stay."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows = numbered(docs)
    return quality.score_quality(rows, model, tuple(rows.columns)).where("predicted = 1").select(rows.columns).toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those of which no line with words is left go.

    Texts without repeats stay as they are, null and blank ones included. Rows of one id lose
    the same lines. n_chars, if there, counts what is left; columns of any name stay.
    """
    rows = numbered(docs)
    out = line_dedup.dedup_lines(rows)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select(rows.columns).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; of documents without
    words all. Rows of one id stay or go together; columns of any name stay."""
    (of,) = unused(docs, "_id")
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(of)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[of]), "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null, empty and short texts stay, repeated rows
    fare alike; columns of any name stay."""
    rows = numbered(docs)
    out = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), tuple(rows.columns))
    return out.where(~F.col("contaminated")).select(rows.columns).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each a training sequence of a power of two; a null or empty text
    is one piece, each of repeated rows has its own."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier, the tokenizer and the tilings are beyond SQL; tests/llm/test_pipeline.py holds
#: the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`; each result but the last is written and reread."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            scratch.drop(before)
        before = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
