"""Similarity joins and the grouping of items into events.

An item belongs to the event of the first earlier item with the same content hash, else to that of its most similar
earlier item at or above the threshold, else it starts an event. An item's parent does not depend on event numbers, so
events are the trees of a forest, and roots are found by following parents of parents. This is not connected
components: an item joins one neighbour only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.operators.pruned_join import DIGITS, best_earlier
from signalweave.params import DEFAULTS
from signalweave.tables import dropped, staged

#: Rows of a block.
BLOCK = 4096


def _blocks(n: int, block: int) -> int:
    return max(1, -(-n // block))


def knn(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0, block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, id, similarity): the k most similar other rows of each query at or above the threshold, ties by id. Both sides have (id, vec); queries meet the rows block by block."""
    nv, nq = _blocks(vectors.count(), block), _blocks(queries.count(), 1024)
    left = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qv"), F.expr(f"cast(pmod(xxhash64(id), {nq}) as int)").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("v"))
    right = vectors.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q2"), F.expr(f"cast(pmod(xxhash64(id), {nv}) as int)").alias("v2"))

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, "i8"), "id": np.zeros(0, "i8"), "similarity": np.zeros(0)})]
        if len(a) and len(b):
            b = b.sort_values("id")
            vb, bi = np.stack(b["vec"]), b["id"].to_numpy()
            sims = np.round(np.stack(a["qv"]) @ vb.T, DIGITS)
            for q, sim in zip(a["query_id"].to_numpy(), sims):
                sim[bi == q] = -2.0
                best = np.argsort(-sim, kind="stable")[:k]
                best = best[sim[best] >= max(threshold, -1.5)]
                out.append(pd.DataFrame({"query_id": np.full(len(best), q), "id": bi[best], "similarity": sim[best]}))
        return pd.concat(out)

    found = left.groupBy("q", "v").cogroup(right.groupBy("q2", "v2")).applyInPandas(multiply, "query_id long, id long, similarity double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def parents(items: DataFrame, threshold: float = DEFAULTS.threshold, use_vectors: bool = True, vec: str = "vec") -> DataFrame:
    """Rows (id, parent): items are (id, at, content_hash, vec). Only the first item of a content hash is compared by vector."""
    order = F.struct("at", "id")
    heads = items.groupBy("content_hash").agg(F.min(order).alias("h")).select("content_hash", F.col("h.id").alias("head"))
    same = items.select("id", "content_hash").join(heads, "content_hash").select("id", "head")
    if not use_vectors:
        return same.withColumnRenamed("head", "parent")
    firsts = items.join(heads.select(F.col("head").alias("id")), "id", "left_semi").select("id", "at", F.col(vec).alias("vec"))
    near = best_earlier(firsts, threshold).select(F.col("id").alias("head"), F.col("parent").alias("near"))
    out = same.join(near, "head", "left")
    return out.select("id", F.when(F.col("id") == F.col("head"), F.coalesce("near", "id")).otherwise(F.col("head")).alias("parent"))


def assign_new(items: DataFrame, known: DataFrame, threshold: float = DEFAULTS.threshold) -> DataFrame:
    """Rows (id, event_id) for new items (id, at, content_hash, vec), none of them earlier than the known ones, which have event_id too.

    Only new items are compared: with each other and with the first known one of each content hash. Their parents' chain
    ends in a known item, which gives its event, or in a new one that starts an event.
    """
    order = F.struct("at", "id")
    firsts = known.groupBy("content_hash").agg(F.min_by(F.struct("id", "event_id"), order).alias("k")).select("content_hash", F.col("k.id").alias("known_head"), F.col("k.event_id").alias("known_event"))
    heads = items.groupBy("content_hash").agg(F.min_by("id", order).alias("head")).join(firsts, "content_hash", "left")
    same = items.select("id", "content_hash").join(heads, "content_hash")
    fresh = items.join(heads.where("known_head IS NULL").select(F.col("head").alias("id")), "id", "left_semi").select("id", "at", "vec")
    seen = known.join(firsts.select(F.col("known_head").alias("id")), "id", "left_semi").select("id", "at", "vec")
    near = best_earlier(fresh, threshold, among=seen.unionByName(fresh)).select(F.col("id").alias("of"), F.col("parent").alias("near"))
    out = same.join(near, F.col("head") == F.col("of"), "left")
    parent = F.when(F.col("known_head").isNotNull(), F.col("known_head")).when(F.col("id") == F.col("head"), F.coalesce("near", "id")).otherwise(F.col("head"))
    new = out.select("id", parent.alias("parent"))
    # chains through known items end there
    ends = known.select("id", F.col("id").alias("parent"))
    found = roots(new.unionByName(ends.join(new.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")))
    events_of = known.select(F.col("id").alias("root"), "event_id")
    return found.join(items.select("id"), "id", "left_semi").join(events_of, "root", "left").select("id", F.coalesce("event_id", "root").alias("event_id"))


def roots(forest: DataFrame) -> DataFrame:
    """Rows (id, root): parents of parents are followed until nothing changes, doubling the distance each round. Only rows with a parent of their own take part in the rounds; a round's table goes when the next one stands."""
    told = staged(forest.select("id", F.col("parent").alias("root")), "forest")
    at = staged(told.where("id <> root").withColumn("moved", F.lit(True)), "roots")
    while at.where("moved").limit(1).count():
        up = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = staged(at.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(at)
        at = after
    return told.where("id = root").unionByName(at.select("id", "root"))


def assign(items: DataFrame, threshold: float = DEFAULTS.threshold, use_vectors: bool = True) -> DataFrame:
    """Rows (id, event_id): an event is named by its first item."""
    return roots(parents(items, threshold, use_vectors)).withColumnRenamed("root", "event_id")


def events(items: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows (event_id, title, representative_item_id, n_items): title and representative come from the first item."""
    sizes = assigned.groupBy("event_id").agg(F.count("*").alias("n_items"))
    return sizes.join(items.select(F.col("id").alias("event_id"), "title"), "event_id").select("event_id", "title", F.col("event_id").alias("representative_item_id"), "n_items")
