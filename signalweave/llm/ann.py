"""Nearest neighbours by largest inner product with multi-index hashing.

Fit, on a bounded sample: vectors get one more component that makes their lengths equal, so the largest inner product is
the smallest angle; PCA and iterative quantisation learn rotations whose signs are the code's bits. From the sample's own
nearest neighbours, at the rank that the wanted number has in a sample of that size, come the reach, in how many bits a
substring may differ, and the cut, in how many bits the whole code may.

Index: every row's code, cut into substrings of 16 bits; for each block of rows a table is written once that leads from
each value of each substring to the rows that have it. If two codes differ in at most r bits, some substring differs in
at most r // substrings bits (pigeonhole), so probing all values within reach in every substring finds every code within
substrings * (reach + 1) - 1 bits, and many beyond. Those within the cut are ranked by exact inner products. Queries with
fewer neighbours than wanted are searched again among all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.llm.common import quoted, staged

#: Rows that the fit may see, the shares of neighbours that the reach and the cut must hold, rotations and what a block holds.
SAMPLE, REACHED, HELD, ROTATIONS = 8192, 0.94, 0.985, 3
ROW_BLOCK, QUERY_BLOCK = 32_768, 2048
_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], "u1")
#: All values of 16 bits by how many are set, and how many values have at most so many.
_MASKS = np.argsort(_BITS, kind="stable").astype("u2")
_WITHIN = np.cumsum(np.bincount(_BITS))


@dataclass(frozen=True)
class Model:
    """Rotations to the bits (components in rows), the longest length, the reach in each substring and the cut of the whole code."""

    rotation: np.ndarray
    longest: float
    reach: int
    cut: int

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Codes as 16-bit substrings in columns."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, self.longest**2 - (vectors * vectors).sum(axis=1)))
        bits = np.column_stack([vectors, rest]) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")

    def everything(self) -> Model:
        return Model(self.rotation, self.longest, 16, self.rotation.shape[1])


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, not zero."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _quantised(x: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """A rotation of the leading components of x whose signs lose least; bits is at most the number of columns."""
    _, vectors = np.linalg.eigh(x.T @ x)
    lead = vectors[:, ::-1][:, :bits]
    v = x @ lead
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return lead @ r


def fit(sample: np.ndarray, longest: float, rows: int, k: int) -> Model:
    """Rotations from the sample, and reach and cut for k neighbours among rows rows."""
    whole = np.column_stack([sample, np.sqrt(np.maximum(0.0, longest**2 - (sample * sample).sum(axis=1)))])
    bits = max(16, min(64, whole.shape[1] // 16 * 16))
    if whole.shape[1] < bits:
        whole = np.column_stack([whole, np.zeros((len(whole), bits - whole.shape[1]))])
    rotation = np.column_stack([_quantised(whole, bits, seed) for seed in range(ROTATIONS)])[: sample.shape[1] + 1]
    model = Model(rotation, longest, 16, rotation.shape[1])
    some = sample[:512]
    near = some @ sample.T
    np.fill_diagonal(near, -np.inf)
    rank = min(len(sample) - 1, max(1, -(-k * len(sample) // max(rows, 1))))
    if rank < 1:
        return model
    best = np.argpartition(-near, rank - 1, axis=1)[:, :rank]
    apart = _BITS[model.codes(some, True)[:, None, :] ^ model.codes(sample, False)[best]]
    least, total = np.sort(apart.min(axis=2).ravel()), np.sort(apart.sum(axis=2, dtype="i8").ravel())
    at = lambda v, share: int(v[min(len(v) - 1, int(share * len(v)))])
    return Model(rotation, longest, at(least, REACHED), at(total, HELD))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors in rows; what a shorter one lacks is 0."""
    flat = column.combine_chunks()
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


class _Block:
    """A block of rows and its index: for each substring its rows by value, and where each value starts among them."""

    KINDS = {"ids": "i8", "vectors": "f8", "codes": "u2", "rows": "i4", "first": "i4"}

    def __init__(self, held: dict[str, np.ndarray], model: Model) -> None:
        self.model, self.ids = model, held["ids"]
        n, substrings = len(self.ids), model.rotation.shape[1] // 16
        self.vectors, self.codes = held["vectors"].reshape(n, -1), held["codes"].reshape(n, substrings)
        self.rows, self.first = held["rows"].reshape(substrings, n), held["first"].reshape(substrings, -1)

    @staticmethod
    def built(ids: np.ndarray, vectors: np.ndarray, model: Model) -> dict[str, np.ndarray]:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        codes = model.codes(vectors, False)
        rows = np.argsort(codes, axis=0, kind="stable").T
        first = np.stack([np.searchsorted(codes[r, j], np.arange(1 << 16), side="left") for j, r in enumerate(rows)])
        first = np.column_stack([first, np.full(len(first), len(ids))])
        return {k: np.ascontiguousarray(v).astype(t) for (k, t), v in zip(_Block.KINDS.items(), (ids, vectors, codes, rows, first))}

    def within(self, code: np.ndarray) -> tuple[np.ndarray, int]:
        """The rows whose code is within the cut among those probed, and how many were probed."""
        if self.model.reach >= 16:
            found = np.arange(len(self.ids))
        else:
            hit = np.zeros(len(self.ids), bool)
            near = _MASKS[: _WITHIN[self.model.reach]]
            for j, (rows, first) in enumerate(zip(self.rows, self.first)):
                value = (near ^ code[j]).astype("i8")
                at = first[value]
                size = first[value + 1] - at
                some = np.flatnonzero(size)
                at, size = at[some], size[some]
                hit[rows[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]] = True
            found = np.flatnonzero(hit)
        return found[_BITS[self.codes[found] ^ code].sum(axis=1, dtype="i8") <= self.model.cut], len(found)

    def nearest(self, query: int | None, vector: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows, _ = self.within(code)
        rows = rows[self.ids[rows] != query]
        score = (self.vectors[rows] * vector).sum(axis=1)  # equal vectors give equal sums, unlike a matrix product
        if len(rows) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= edge], score[score >= edge]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def indexed(rows: DataFrame, model: Model, width: int, n_blocks: int) -> DataFrame:
    """A written table with one row for each block of rows (vec_id, v): its number and its index."""

    def build(block: pa.Table) -> pa.Table:
        held = _Block.built(block.column("vec_id").to_numpy(), _matrix(block.column("v"), width), model)
        return pa.table({"rb": pa.array([block.column("rb")[0].as_py()], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in held.items()})

    dealt = rows.select("vec_id", "v", F.expr(f"cast(pmod(xxhash64(vec_id), {n_blocks}) as int)").alias("rb"))
    return staged(dealt.groupBy("rb").applyInArrow(build, "rb int, " + ", ".join(f"{k} binary" for k in _Block.KINDS)), "ann-index")


def _search(queries: DataFrame, index: DataFrame, model: Model, width: int, k: int, n_queries: int, n_blocks: int) -> DataFrame:
    """Every block of queries meets every block's index; neither is built again."""
    nq = max(1, -(-n_queries // QUERY_BLOCK))
    left = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.expr(f"cast(pmod(xxhash64(vec_id), {nq}) as int)").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("q_rb"))
    right = index.withColumn("i_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and r.num_rows:
            block = _Block({c: np.frombuffer(r.column(c)[0].as_buffer(), t) for c, t in _Block.KINDS.items()}, model)
            vectors = _matrix(q.column("qv"), width)
            for i, v, c in zip(q.column("query_id").to_pylist(), vectors, model.codes(vectors, True)):
                ids, score = block.nearest(i, v, c, k)
                out.append((np.full(len(ids), i, "i8"), ids, score))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0]), "vec_id": pa.array(cols[1]), "score": pa.array(cols[2])})

    found = left.groupBy("qb", "q_rb").cogroup(right.groupBy("i_qb", "rb")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", everything: bool = False) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that the condition queries holds for, the k nearest rows found, itself left out; equal scores by smaller id.

    Rows without an id, and vectors that are null, empty, zero, or hold null or non-finite components, take no part. A
    vector that is shorter than the longest one counts as 0 in the components it lacks. Rows with the query's id are left
    out of its answer. Repeated ids are ranked each. With everything, all rows are probed, which makes the search exact.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    asked = F.coalesce(queries, F.lit(False))
    table = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector).cast("array<double>").alias("v"), asked.alias("asked")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    size = table.agg(F.count("*").alias("n"), F.count_if("asked").alias("q"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    held = np.zeros((len(sample), size.d))
    for row, r in zip(held, sample):
        row[: len(r.v)] = r.v
    model = fit(held, float(np.sqrt(size.m)) * (1 + 1e-12), size.n, k)
    if everything:
        model = model.everything()
    n_blocks = max(1, -(-size.n // ROW_BLOCK))
    index = indexed(table.select("vec_id", "v"), model, size.d, n_blocks)
    first = staged(_search(table.where("asked"), index, model, size.d, k, size.q, n_blocks), "neighbours")
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = staged(table.where("asked").select("vec_id", "v").join(enough, "vec_id", "left_anti"), "short-queries")
    n_short = short.count()
    if not n_short:
        return first
    again = _search(short, index, model.everything(), size.d, k, n_short, n_blocks)
    return first.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(again)
