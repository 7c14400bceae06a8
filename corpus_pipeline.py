"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

A stage works on all that the one before kept, and its decisions take effect: toxic documents go, repeated runs of lines and
repeated byte strings go from texts, one document of each group of near-duplicates stays, and what is left is packed into bins.
A document that a stage leaves without any text goes too; one that had none before stays. Further columns of any name and kind
stay as they are up to the packing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.columns import free, named
from tesserae.llm.lines import PASSAGE, remove_repeated_lines
from tesserae.llm.minhash import near_duplicates
from tesserae.llm.packing import pack_documents
from tesserae.llm.scratch import Scratch
from tesserae.llm.suffixes import remove_repeats
from tesserae.llm.toxicity import fit, score

#: Documents with a score of so much or more go.
TOXIC = 0.5


def _cut(docs: DataFrame, removed: Column, columns: list[str]) -> DataFrame:
    """The columns of documents for cut texts, without documents that lost all of their text."""
    left = docs.where((removed == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return left.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else named(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels outside of the held-out fold doesn't find toxic."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col(free(docs.columns, "toxicity")) < TOXIC).select(*map(named, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that occur earlier: of three lines, or of one or two with PASSAGE words."""
    return _cut(remove_repeated_lines(spark, docs, PASSAGE), F.col(free(docs.columns, "removed")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; rows of one doc_id stay or go together."""
    kept = near_duplicates(spark, docs.select("doc_id", "text")).where("kept").select("doc_id").distinct().toDF(free(docs.columns, "kept_id"))
    return docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col(kept.columns[0])), "left_semi")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that occur earlier; characters that lose a byte go whole."""
    cut = remove_repeats(spark, docs, characters=True)
    return _cut(cut.withColumn("text", F.col(free(docs.columns, "kept")).cast("string")), F.size(free(docs.columns, "removed")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' pieces."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: No SQL: the first stage trains a model and the last one packs greedily.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = room.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
