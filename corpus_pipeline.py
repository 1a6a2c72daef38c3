"""A corpus pipeline over documents: quality rules, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes what its predecessor kept, as a written table, and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.llm import common, line_dedup, mixing, ngram_join, packing, quality

#: Columns of documents that are kept right when a text changes.
LENGTH = "n_chars"


def _columns(docs: DataFrame) -> list[Column]:
    return [common.quoted(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the quality rules keeps. A narrow job: each row rides along with its measurements, whatever its columns are called."""
    rows = quality.ledger(docs.select(F.struct(*_columns(docs)).alias("row"), "text"), keep=("row",))
    return rows.where(quality.passes("v1")).select("row.*")


#: A document is a copy once so many percent of its words have gone with repeated lines.
COPIED = 80


def fuzzy_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line.

    A document that loses COPIED percent of its words or more goes: it is a near copy of what stays, and what would be
    left of it, the few lines that a change of words has kept apart, no longer looks like one to the join that follows.
    """
    was, now = common.fresh(docs, "words_before", "words_after")
    removed, kept = common.fresh(docs, "lines_removed", "lines_kept")
    words = lambda: F.coalesce(F.regexp_count("text", F.lit(quality.WORD)), F.lit(0))
    out = line_dedup.line_dedup(docs.withColumn(was, words()), removed=removed, kept=kept).withColumn(now, words())
    out = out.where((F.col(removed) == 0) | (100 * F.col(now) > (100 - COPIED) * F.col(was)))
    size = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col(LENGTH)) if LENGTH in docs.columns else None
    return out.select(*[size.cast(docs.schema[c].dataType).alias(c) if c == LENGTH else common.quoted(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id (null last, rows with equal ids by their place in the table). Documents without words stay."""
    held, row = common.numbered(docs, "near-docs")
    found = ngram_join.ngram_jaccard_join(held, id_col=row, k=5, percent=80)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    ids = held.select(F.col(row).alias("of"), place.alias("place"))
    # rows that stand alone need no look at their ids
    found = found.select(F.col("doc_id").alias("row"), "component_id")
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("component_id").alias("group"))
    members = common.staged(found.join(several, F.col("component_id") == F.col("group")).join(ids, F.col("row") == F.col("of")).select("row", "group", "place"), "near-members")
    first = members.groupBy("group").agg(F.min("place")[row].alias("first"))
    gone = members.join(first, "group").where("row <> first").select(F.col("row").alias("gone"))
    return held.join(gone.hint("shuffle_hash"), F.col(row) == F.col("gone"), "left_anti").select(*_columns(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken over words, rounded (0, 1 or 2 times). Documents without words, which take no share, stay once. Each row counts for itself, also where ids are repeated or null."""
    held, row = common.numbered(docs, "mix-docs")
    of, times, nth = common.fresh(held, "mix_of", "mix_times", "mix_nth")
    copies = mixing.mix(held, keep=(row,)).select(F.col(row).alias(of), F.when(F.col("size") > 0, F.col("copies")).otherwise(1).alias(times)).where(F.col(times) > 0)
    out = held.join(copies, F.col(row) == F.col(of))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*_columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", fuzzy_line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no tokenizer, no SimHash and no edit-distance groups; the pipeline is tested against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
