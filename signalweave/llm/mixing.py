"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.llm.common import quoted, staged
from signalweave.llm.text import WORD

#: Words of one shard of a source, about.
SHARD_WORDS = 1 << 21


def targets(sizes: list[int], weights: list[int], share: Fraction, cap: int) -> list[Fraction]:
    """share of all sizes, dealt by weight; a target stops at cap times its size and the excess goes to the others by weight."""
    left, out = share * sum(sizes), [Fraction(0)] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        level = left / sum(weights[i] for i in free)
        full = {i for i in free if level * weights[i] >= cap * sizes[i]}
        for i in full or free:
            out[i] = Fraction(cap * sizes[i]) if full else level * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1); equal quotients go to the earlier entry.

    The divisor is found by halving, so the work does not grow with the number of seats; the last seats are given singly.
    """
    votes = np.asarray(votes, "f8")
    if seats <= 0 or votes.sum() <= 0:
        return np.zeros(len(votes), "i8")
    low, high = 0.0, 2 * votes.max()  # divisors: at high no seat is given
    given = lambda d: np.floor(votes / d + 0.5)
    high = max(high, votes.sum() / seats * 4)
    low = votes.sum() / (seats + len(votes)) / 2
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high).astype("i8")
    while out.sum() < seats:
        out[np.argmax(votes / (2 * out + 1))] += 1
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2, block: int = 64, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies) and the columns keep for each row of docs.

    Size is the number of words. Sources in code point order, null last, weigh weights in turn. Each source is dealt over
    shards by a seeded hash of its rows, as many as its size asks for; a shard's rows stand in seeded order and their
    words are cut into blocks of block words, fewer in a source so small that it would not fill 16 blocks.
    Sainte-Lague gives each source a number of blocks by its target (sources of one size of blocks together), and each of its shards a quota by its words; in a
    shard every block is taken quota // blocks times, and quota % blocks of them, in a row from a seeded one on, once
    more. taken sums the words of a row in taken blocks, repeats counted: at most cap times its size. copies is taken
    over size, rounded.

    Null or empty texts have size 0 and take nothing. Repeated rows are rows of their own. Other columns are ignored. An
    empty table gives no rows. One row a source comes to the driver, and no row a document or a shard does.
    """
    size = F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = staged(docs.select(quoted(id_col).alias("doc_id"), quoted(source).alias("src"), size.alias("size"), F.xxhash64(quoted(text)).alias("mark"), F.struct(*[quoted(c) for c in keep]).alias("kept") if keep else F.lit(True).alias("kept")), "mix-sizes")
    spark = docs.sparkSession
    totals = rows.groupBy("src").agg(F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r.src is None, r.src or ""))
    sizes = [r["size"] for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    # sources of blocks of one size are apportioned together, so a small one changes no other's blocks
    units = [max(1, min(block, n // 16)) for n in sizes]
    seats = [0] * len(sizes)
    for unit in set(units):
        some = [i for i, u in enumerate(units) if u == unit]
        for i, n in zip(some, sainte_lague(np.array([float(goal[i]) for i in some]), round(sum(goal[i] for i in some) / unit))):
            seats[i] = int(n)
    plan = spark.createDataFrame([(r.src, r["size"], float(g), n, u, max(1, -(-r["size"] // SHARD_WORDS))) for r, g, n, u in zip(totals, goal, seats, units)], "p_src string, source_size long, target double, seats long, unit long, shards long")
    h = F.xxhash64(F.lit(seed), "doc_id", "size", "mark")  # by its text too: rows without ids must not meet in one shard
    dealt = rows.join(F.broadcast(plan) if len(totals) <= 10_000 else plan, F.col("src").eqNullSafe(F.col("p_src"))).drop("p_src")
    dealt = dealt.withColumn("h", h).withColumn("shard", F.expr("pmod(h, shards)"))

    def quotas(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("shard")
        blocks = -(-one["words"].to_numpy() // int(one["unit"].iloc[0]))
        return one.assign(blocks=blocks, quota=np.minimum(sainte_lague(one["words"].to_numpy(), int(one["seats"].iloc[0])), cap * blocks))[["src", "shard", "blocks", "quota"]]

    shards = dealt.groupBy("src", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"), F.first("unit").alias("unit"))
    quota = shards.groupBy("src").applyInPandas(quotas, "src string, shard long, blocks long, quota long")
    quota = quota.select(F.col("src").alias("q_src"), F.col("shard").alias("q_shard"), "blocks", "quota")
    order = W.partitionBy("src", "shard").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "mark").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("stop", F.sum("size").over(order)).join(quota, F.col("src").eqNullSafe(F.col("q_src")) & (F.col("shard") == F.col("q_shard")))
    start = F.col("stop") - F.col("size")
    # blocks taken once more: more of them from first on, beyond the last one from 0 on again
    more = F.expr("quota % greatest(blocks, 1)")
    first = F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), F.greatest("blocks", F.lit(1)))
    inside = lambda a, b: F.greatest(F.lit(0), F.least(F.col("stop"), b * F.col("unit")) - F.greatest(start, a * F.col("unit")))
    extra = inside(first, F.least(first + more, F.col("blocks"))) + inside(F.lit(0), F.greatest(F.lit(0), first + more - F.col("blocks")))
    taken = F.when(F.col("size") > 0, F.expr("quota div blocks") * F.col("size") + extra).otherwise(0).cast("long")
    copies = F.when(F.col("size") > 0, F.round(taken / F.col("size"))).otherwise(0).cast("int")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), *[F.col("kept")[c].alias(c) for c in keep])
