"""Exact inner-product joins that multiply few of all pairs in double precision.

Rows on the right stand in cells around centres of short forms (leading coordinates of a basis learned on a bounded
sample, and the length of the rest); distances of short forms bound every inner product. Vectors are stored once, as blocks
of rows in the shared folder, in the order of time ranges and cells. A task takes a piece of the left rows, of which each
is shuffled once, and reads one block after another:

1. A row meets the cells that neither time nor its bound against the best similarity so far rules out.
2. Those are multiplied in single precision, as matrices; pairs that may be the best within its error, or may reach the
   threshold, are multiplied again in double precision.

Cells and single precision change how many pairs are multiplied how, never which are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.tables import dropped, new_path, staged, store_of

#: Coordinates of the short form that cells are told by; rows that the basis is learned on; cells and time ranges at most.
SHORT, SAMPLE, CELLS, RANGES = 8, 4096, 128, 16
#: Rows of a block on the right, and of a piece on the left; columns that are multiplied before the best so far is looked at again; digits of a similarity, so that equal ones tie on every machine.
BLOCK, LEFT, STEP, DIGITS = 32768, 8192, 1024, 9
#: Rows of a piece where a table is small, and pieces that there are before they grow.
SMALL, PIECES = 2048, 64
#: Rows of a cell, and of a range of a cell, at least on average.
CELL_ROWS, RANGE_ROWS = 512, 1024
#: What rounding may take off a bound.
SLACK = 1e-4


@dataclass(frozen=True)
class Basis:
    """Leading directions, and the centres of the cells of short forms."""

    axes: np.ndarray
    centres: np.ndarray

    def short(self, vectors: np.ndarray) -> np.ndarray:
        head = vectors @ self.axes
        rest = np.sqrt(np.maximum(0.0, (vectors**2).sum(axis=1) - (head**2).sum(axis=1)))
        return np.concatenate([head, rest[:, None]], axis=1)


def learned(vectors: DataFrame, n: int, seed: int = 3) -> Basis:
    """From the SAMPLE rows (id, vec) with the smallest hashes of their ids; cells by a few rounds of nearest means."""
    rows = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not rows:
        return Basis(np.zeros((0, 0)), np.zeros((1, 1)))
    x = np.array([r.vec for r in rows])
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :SHORT]
    basis = Basis(axes, np.zeros((1, 1)))
    a = basis.short(x)
    k = max(1, min(CELLS, n // CELL_ROWS, len(a)))
    centres = a[np.random.default_rng(seed).permutation(len(a))[:k]].copy()
    for _ in range(8):
        near = (a @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for c in np.unique(near):
            centres[c] = a[near == c].mean(axis=0)
    return Basis(axes, centres)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _in_cells(rows: DataFrame, basis: Basis) -> DataFrame:
    """rows (id, at, vec) with cell, the distance to its centre and the square of the length; vec as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _vectors(batch.column("vec"))
                a = basis.short(vectors)
                cell = (a @ basis.centres.T - (basis.centres**2).sum(axis=1) / 2).argmax(axis=1)
                away = np.sqrt(((a - basis.centres[cell]) ** 2).sum(axis=1))
                vec = pa.array([v.tobytes() for v in vectors.astype("<f8")], pa.binary())
                yield pa.record_batch([batch.column("id"), batch.column("at"), vec, pa.array(cell.astype("i4")), pa.array(away), pa.array((a**2).sum(axis=1))], names=["id", "at", "vec", "cell", "away", "square"])

    return rows.select("id", "at", "vec").mapInArrow(run, "id long, at long, vec binary, cell int, away double, square double")


def _loaded(folder: str, block: int, every: bool) -> tuple[np.ndarray, ...]:
    """place, at, id and vectors of a block; without every, of equal vectors the earliest only, as no later one can be chosen."""
    store, base = store_of(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{base}/block={block}", allow_not_found=True)) if f.base_name.startswith("part-")]
    columns = ["span", "cell", "at", "id", "vec"]
    held = [pq.ParquetFile(store.open_input_file(f)).read(columns) for f in sorted(files)]
    table = pa.concat_tables(held).combine_chunks() if held else pa.table({c: pa.array([], pa.binary() if c == "vec" else pa.int64()) for c in columns})
    span, cell, at, ids = (table.column(c).to_numpy() for c in columns[:-1])
    raw = table.column("vec").to_pylist()
    kept = np.arange(len(raw))
    if not every:
        seen: set[bytes] = set()
        kept = np.array([i for i in np.lexsort((ids, at)).tolist() if not (raw[i] in seen or seen.add(raw[i]))], "i8")
    order = kept[np.lexsort((ids[kept], at[kept], cell[kept], span[kept]))]
    vectors = np.frombuffer(b"".join([raw[i] for i in order.tolist()]), "<f8").reshape(len(order), -1) if len(order) else np.zeros((0, 1))
    return span[order], cell[order], at[order], ids[order], vectors


def _earlier(at: np.ndarray, ids: np.ndarray, right_at: np.ndarray, right_ids: np.ndarray) -> np.ndarray:
    """How many of the right rows, which are in order, are earlier than each row."""
    first, last = np.searchsorted(right_at, at, side="left"), np.searchsorted(right_at, at, side="right")
    out = first.copy()
    for i in np.flatnonzero(last > first).tolist():
        out[i] += np.searchsorted(right_ids[first[i] : last[i]], ids[i])
    return out


def join(left: DataFrame, right: DataFrame, threshold: float, every: bool = False) -> DataFrame:
    """Rows (id, other, other_at, similarity, pairs, candidates) for rows (id, at, vec) of both sides, all vectors of one size.

    For each row of left its most similar row of right that is earlier by (at, id), if that reaches the threshold; equal
    similarities go to the earliest. With every, all such rows. Rows with a null id say how many pairs a piece of left had
    and how many of them were multiplied in double precision.
    """
    n = right.count()
    basis = learned(right, n)
    held = staged(_in_cells(right, basis), "cells")
    ranges = max(1, min(RANGES, n // (RANGE_ROWS * len(basis.centres))))
    cuts = [] if ranges == 1 else sorted(held.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 10_000)).first()[0])
    span = F.lit(0)
    for c in cuts:
        span = span + F.when(F.col("at") > c, 1).otherwise(0)
    # one row for each cell and range: at most CELLS * RANGES
    known = held.groupBy(span.alias("span"), "cell").agg(F.max("away").alias("radius"), F.max("square").alias("square"), F.count("*").alias("n"), F.min("at").alias("since")).collect()
    shape = (ranges, len(basis.centres))
    radius, square, size_of, since = np.full(shape, -np.inf), np.zeros(shape), np.zeros(shape, "i8"), np.zeros(shape, "i8")
    for r in known:
        radius[r.span, r.cell], square[r.span, r.cell], size_of[r.span, r.cell], since[r.span, r.cell] = r.radius, r.square, r.n, r.since
    # blocks are filled range by range; a large cell goes over several of them
    ends = np.cumsum(size_of).reshape(shape)
    first, last = (ends - size_of) // BLOCK, np.maximum(ends - 1, 0) // BLOCK
    n_blocks = -(-n // BLOCK)
    place = F.col("span") * len(basis.centres) + F.col("cell")
    many = F.get(F.lit((last - first + 1).ravel().tolist()), place)
    block = (F.get(F.lit(first.ravel().tolist()), place) + F.pmod(F.xxhash64("id"), many)).cast("long")
    folder = new_path(left.sparkSession, "blocks")
    rows = held.withColumn("span", span.cast("int")).withColumn("block", block)
    rows.select("block", "span", "cell", "at", "id", "vec").repartition(max(1, n_blocks), "block").write.option("compression", "lz4_raw").partitionBy("block").parquet(folder)
    dropped(held)
    earliest = [int(since[(first <= b) & (b <= last) & (size_of > 0)].min(initial=np.iinfo("i8").max)) for b in range(n_blocks)]

    def found(ids: np.ndarray, at: np.ndarray, va: np.ndarray) -> Iterator[pa.RecordBatch]:
        short, fa = basis.short(va), va.astype("f4")
        size = (short**2).sum(axis=1)
        away = np.sqrt(np.maximum(0.0, size[:, None] + (basis.centres**2).sum(axis=1) - 2 * short @ basis.centres.T))
        best, best_at, best_id = np.full(len(ids), threshold), np.full(len(ids), np.iinfo("i8").max), np.full(len(ids), np.iinfo("i8").max)
        hit, pairs, full, newest = np.zeros(len(ids), bool), 0, 0, at.max()
        for b in range(n_blocks):
            if earliest[b] > newest:
                continue
            spans, cells, bt, bi, vb = _loaded(folder, b, every)
            edge = np.flatnonzero(np.concatenate([[True], (spans[1:] != spans[:-1]) | (cells[1:] != cells[:-1]), [True]])) if len(bt) else np.zeros(1, "i8")
            fb = vb.astype("f4")
            for start, stop in zip(edge[:-1].tolist(), edge[1:].tolist()):
                c, p = int(cells[start]), int(spans[start])
                for s in range(start, stop, STEP):
                    e = min(s + STEP, stop)
                    meets = away[:, c] <= radius[p, c] + np.sqrt(np.maximum(0.0, size + square[p, c] - 2 * best) + SLACK)
                    row = np.flatnonzero(meets & (at >= bt[s]))
                    n_earlier = _earlier(at[row], ids[row], bt[s:e], bi[s:e])
                    row, n_earlier = row[n_earlier > 0], n_earlier[n_earlier > 0]
                    if not len(row):
                        continue
                    pairs += int(n_earlier.sum())
                    sim = fa[row] @ fb[s:e].T
                    part = np.flatnonzero(n_earlier < e - s)
                    if len(part):
                        sim[part] = np.where(np.arange(e - s) < n_earlier[part, None], sim[part], -np.inf)
                    # what single precision may be off by
                    error = (va.shape[1] + 8) * 2.0**-23 * np.sqrt(size[row] * square[p, c]) + 1e-9
                    near = best[row] - error
                    if not every:
                        top = sim.max(axis=1)
                        some = np.flatnonzero(top >= near)
                        row, sim, near = row[some], sim[some], np.maximum(near, top - 2 * error)[some]
                    i, j = np.nonzero(sim >= near[:, None])
                    i, j, full = row[i], j + s, full + len(i)
                    exact = np.concatenate([np.round(np.einsum("ij,ij->i", va[i[k : k + 4096]], vb[j[k : k + 4096]]), DIGITS) for k in range(0, len(i), 4096)] or [np.zeros(0)])
                    keep = exact >= threshold
                    i, j, exact = i[keep], j[keep], exact[keep]
                    if every:
                        yield told(ids[i], bi[j], bt[j], exact)
                        continue
                    order = np.lexsort((bi[j], bt[j], -exact, i))
                    order = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(order) else order
                    i, j, exact = i[order], j[order], exact[order]
                    better = (exact > best[i]) | ((exact == best[i]) & ((bt[j] < best_at[i]) | ((bt[j] == best_at[i]) & (bi[j] < best_id[i]))))
                    i, j = i[better], j[better]
                    hit[i], best[i], best_at[i], best_id[i] = True, exact[better], bt[j], bi[j]
        if not every:
            yield told(ids[hit], best_id[hit], best_at[hit], best[hit])
        none = pa.nulls(1, pa.int64())
        yield pa.record_batch([none, none, none, pa.nulls(1, pa.float64()), pa.array([pairs]), pa.array([full])], names=names)

    names = ["id", "other", "other_at", "similarity", "pairs", "candidates"]

    def told(ids: np.ndarray, other: np.ndarray, other_at: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids), pa.array(other), pa.array(other_at), pa.array(similarity), *[pa.nulls(len(ids), pa.int64())] * 2], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for s in range(0, batch.num_rows, LEFT):
                some = batch.slice(s, LEFT)
                if sum(len(r[0]) for r in rows) + some.num_rows > 2 * LEFT:
                    yield from found(*map(np.concatenate, zip(*rows)))
                    rows = []
                if some.num_rows:
                    rows.append((some.column("id").to_numpy(), some.column("at").to_numpy(), _vectors(some.column("vec"))))
        if rows:
            yield from found(*map(np.concatenate, zip(*rows)))

    n_left = left.count()
    pieces = max(1, -(-n_left // min(LEFT, max(SMALL, n_left // PIECES))))
    # the latest rows, which meet most, are the first piece
    dealt = left.select("id", "at", "vec").repartitionByRange(pieces, F.desc("at"), F.desc("id"))
    return dealt.mapInArrow(run, "id long, other long, other_at long, similarity double, pairs long, candidates long")


def best_earlier(vectors: DataFrame, threshold: float, among: DataFrame | None = None) -> DataFrame:
    """Rows (id, parent, similarity): for each row of (id, at, vec) its most similar earlier row at or above the threshold, if there is one; ties go to the earliest. Earlier is by (at, id). With among, only its rows are neighbours. Exact."""
    held = staged(vectors.select("id", "at", "vec"), "vectors")  # read several times
    found = join(held, held if among is None else staged(among.select("id", "at", "vec"), "among"), threshold).where("id IS NOT NULL")
    best = F.min_by(F.struct(F.col("other").alias("parent"), "similarity"), F.struct(-F.col("similarity"), F.col("other_at"), F.col("other")))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.parent", "b.similarity")


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b, similarity), a < b, of rows (id, vec) at or above the threshold; the result itself grows with the pairs there are. Exact."""
    rows = vectors.select("id", F.col("id").alias("at"), "vec")
    found = join(rows, rows, threshold, every=True).where("id IS NOT NULL")
    return found.select(F.col("other").alias("a"), F.col("id").alias("b"), "similarity")


def work(vectors: DataFrame, threshold: float) -> DataFrame:
    """One row (pairs, bounded, candidates): all pairs there are, those that were multiplied, and those multiplied in double precision by best_earlier()."""
    n = vectors.count()
    return join(vectors, vectors, threshold).agg(F.lit(n * (n - 1) // 2).alias("pairs"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("bounded"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"))
