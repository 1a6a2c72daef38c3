"""The table of item vectors: upserts, rebuilds, and a rebuild where its size is not the embedder's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweave.functions.text import embedding_text
from signalweave.functions.vectors import hashing_embedding
from signalweave.operators.feeds import latest

#: From a text column to a column of unit vectors: any built-in expression or Arrow UDF.
Embedder = Callable[[Column], Column]


def embedded(items: DataFrame, embed: Embedder = hashing_embedding) -> DataFrame:
    """Rows (item_id, vec, source, published_at) for items (item_id, title, summary, source_name, published_at)."""
    return items.select("item_id", embed(embedding_text("title", "summary")).alias("vec"), F.col("source_name").alias("source"), "published_at")


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored rows with the new ones in place of those of the same item."""
    return latest(stored.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1))), "item_id", "turn").drop("turn")


def drifted(stored: DataFrame, dim: int) -> bool:
    """Whether any stored vector has another size than the embedder gives."""
    return bool(stored.where(F.size("vec") != dim).limit(1).count())


def healed(stored: DataFrame, items: DataFrame, dim: int, embed: Embedder = hashing_embedding) -> DataFrame:
    """The stored vectors, or, where their size has drifted, all items embedded anew."""
    return embedded(items, embed) if drifted(stored, dim) else stored
