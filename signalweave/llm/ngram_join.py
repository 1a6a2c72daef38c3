"""Exact Jaccard join on word n-grams by a blocked sparse matrix product.

1. Each text becomes a sorted set of 64-bit shingle hashes. Texts with equal sets are one class, named by its smallest id.
2. A fixed-size sketch counts how many documents each shingle is in; sets are ordered from rare to common by it. Any
   order all documents share gives the same links; this one keeps common passages out of the candidate search.
3. Two sets that are similar enough share one of the first few shingles of that order (size-derived bounds). Columns of
   the incidence matrix are dealt by shingle; a column that many documents are in is cut into blocks, and pairs of
   blocks are dealt. Pairs whose sizes or positions rule out enough overlap are discarded at once.
4. What is left is multiplied: block by block of documents and shingles, overlaps are accumulated and held to the bound.
   Few documents of a shingle go there as pairs, many as a group whose links are found in the product and thinned to a
   forest, so that a large group of near copies costs rows in proportion to its size.
5. Links make components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.common import SKETCH_BITS, Sketch, batch_slices, dropped, parts, quoted, sketch_total, staged
from signalweave.llm.components import components
from signalweave.llm.text import mixed, shingle_sets, word_hashes, words_of

#: Documents of one shingle that are compared in one block; those that pair off one by one; rows and columns of a block of the product.
BLOCK, FEW, ROWS, COLUMNS = 2048, 64, 256, 4096
#: Bytes of the sets of a group that are gathered in one block.
GROUP = 32 << 20
_MASK = np.uint64((1 << SKETCH_BITS) - 1)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    flat, bounds = words_of(batch.column("text"))
    return shingle_sets(word_hashes(flat), bounds, k)


def fingerprints(rows: DataFrame, k: int) -> DataFrame:
    """A written table: a row (doc_id, n, fp, f) for each document, f being a short form of fp, and the sketches' ranges (part, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for batch in batches:
            for part in batch_slices(batch, "text"):
                sets = _sets(part, k)
                sketch.add(np.concatenate(sets))
                n = len(sets)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "fp": pa.array([xxhash.xxh3_128_digest(s.data) if len(s) else None for s in sets], pa.binary()), "f": pa.array([xxhash.xxh3_64_intdigest(s.data) if len(s) else 0 for s in sets], pa.uint64()).view(pa.int64()), "part": pa.nulls(n, pa.int32()), "blob": pa.nulls(n, pa.binary())})
        for part, blob in sketch.blobs():
            yield pa.record_batch({"doc_id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "fp": pa.nulls(1, pa.binary()), "f": pa.nulls(1, pa.int64()), "part": pa.array([part], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return staged(rows.mapInArrow(run, "doc_id long, n long, fp binary, f long, part int, blob binary"), "fingerprints")


def prefixes(rows: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """Rows (s, x, y, own, f, n, i): shingle, pair of blocks and own block, the set's short fingerprint and size, and the shingle's place in the set's order. Of equal sets a task gives the first only."""
    fixed = rows.sparkSession.sparkContext.broadcast(zlib.compress(counts.tobytes(), 1))
    names = ["s", "x", "y", "own", "f", "n", "i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_by = np.frombuffer(zlib.decompress(fixed.value), "u4")
        noise = int(order_by.mean())
        seen: set[int] = set()
        for batch in batches:
            for part in batch_slices(batch, "text"):
                out: list[tuple] = []
                for doc, u in zip(part.column("doc_id").to_pylist(), _sets(part, k)):
                    n = len(u)
                    if not n or doc is None:
                        continue
                    fp = xxhash.xxh3_64_intdigest(u.data)
                    if fp in seen:
                        continue
                    seen.add(fp)
                    c = order_by[(u & _MASK).astype("i8")]
                    first = np.argsort(c, kind="stable")[: n + percent * n // -100 + 1]
                    nb = np.maximum(1, -(-(c[first].astype("i8") - noise) // BLOCK))
                    out.append((u[first], nb, n, fp))
                if not out:
                    continue
                size = [len(x[0]) for x in out]
                s, nb = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
                n, fp = (np.repeat(np.array([x[j] for x in out], kind), size) for j, kind in ((2, "i8"), (3, "u8")))
                i = np.concatenate([np.arange(m) for m in size])
                own = (fp % nb.astype("u8")).astype("i8")
                at = np.repeat(np.arange(len(s)), nb)
                other = np.arange(len(at)) - np.repeat(np.cumsum(nb) - nb, nb)
                cols = [s.view("i8")[at], np.minimum(own[at], other).astype("i4"), np.maximum(own[at], other).astype("i4"), own[at].astype("i4"), fp.view("i8")[at], n[at], i[at].astype("i4")]
                yield pa.record_batch([pa.array(c) for c in cols], names=names)

    return rows.mapInArrow(run, "s long, x int, y int, own int, f long, n long, i int")


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    held: list[pa.RecordBatch] = [b for b in batches if b.num_rows]
    if not held:
        return {}
    table = pa.Table.from_batches(held)
    return {n: table.column(n).to_numpy() for n in table.schema.names}


def candidates(columns: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, s) of different sets, by their short fingerprints, that meet in a shingle and that sizes and positions don't rule out; each task's pairs are different.

    Where more than FEW sets meet, the rows are (a, null, s) for each of them that has such a partner; s names the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _gathered(batches)
        if not c:
            return
        order = np.lexsort((c["f"], c["n"], c["y"], c["x"], c["s"]))
        c = {k: v[order] for k, v in c.items()}
        same = (c["s"][1:] == c["s"][:-1]) & (c["x"][1:] == c["x"][:-1]) & (c["y"][1:] == c["y"][:-1])
        group = np.concatenate([[0], np.cumsum(~same)])
        last = np.searchsorted(group, group, side="right") - 1
        size = np.bincount(group)[group]
        busy = np.zeros(len(group), bool)
        left, step, found = np.flatnonzero(np.arange(len(group)) < last), 1, []
        while len(left):
            right = left + step
            na, nb = c["n"][left], c["n"][right]  # na <= nb
            fits = 100 * na >= percent * nb  # sizes rise: beyond one that doesn't fit none does
            left, right, na, nb = left[fits], right[fits], na[fits], nb[fits]
            room = np.minimum(na - c["i"][left], nb - c["i"][right])
            good = (c["f"][left] != c["f"][right]) & (room >= least_overlap(na, nb, percent)) & ((c["x"][left] == c["y"][left]) | (c["own"][left] != c["own"][right]))
            few = good & (size[left] <= FEW)
            busy[left[good & ~few]] = busy[right[good & ~few]] = True
            if few.any():
                a, b = c["f"][left[few]], c["f"][right[few]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b), c["s"][left[few]]]))
            step += 1
            left = left[left + step <= last[left]]
        if found:
            f = np.concatenate(found, axis=1)
            f = f[:, np.lexsort((f[2], f[1], f[0]))]
            f = f[:, np.concatenate([[True], (f[0, 1:] != f[0, :-1]) | (f[1, 1:] != f[1, :-1])])]
            for i in range(0, f.shape[1], 50_000):
                yield pa.record_batch([pa.array(x[i : i + 50_000]) for x in f], names=["a", "b", "s"])
        if busy.any():
            name = mixed(c["s"][busy].view("u8") ^ mixed(c["x"][busy].astype("u8") << np.uint64(32) | c["y"][busy].astype("u8"))).view("i8")
            yield pa.record_batch([pa.array(c["f"][busy]), pa.nulls(len(name), pa.int64()), pa.array(name)], names=["a", "b", "s"])

    return columns.repartition(parts(columns.sparkSession), "s", "x", "y").mapInArrow(run, "a long, b long, s long")


def block_product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all sets of left with all of right: one incidence matrix times the other's transpose, accumulated over blocks of columns."""
    both = [*left, *right]
    total = np.zeros((len(left), len(right)), "i8")
    rows = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column, n = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = n > 1  # other columns add to no overlap of two sets
    rows, column = rows[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    by = np.argsort(column, kind="stable")
    rows, column = rows[by], column[by]
    edges = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + COLUMNS, COLUMNS))
    for start, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        dense = np.zeros((len(both), COLUMNS), "f4")
        dense[rows[s:e], column[s:e] - start * COLUMNS] = 1
        total += (dense[: len(left)] @ dense[len(left) :].T).astype("i8")
    return total


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all that is connected, by products of blocks of ROWS sets; two blocks that already hang together are left out."""
    root = np.arange(len(sets))
    n = np.array([len(s) for s in sets])
    out: list[tuple[int, int]] = []
    for i in range(0, len(sets), ROWS):
        for j in range(i, len(sets), ROWS):
            a, b = slice(i, i + ROWS), slice(j, j + ROWS)
            if len(np.unique(np.concatenate([root[a], root[b]]))) == 1:
                continue
            overlap = block_product(sets[a], sets[b])
            x, y = np.nonzero(100 * overlap >= percent * (n[a][:, None] + n[b][None, :] - overlap))
            apart = root[x + i] != root[y + j]
            for u, v in zip((x[apart] + i).tolist(), (y[apart] + j).tolist()):
                if root[u] != root[v]:
                    root[root == root[v]] = root[u]
                    out.append((u, v))
    return out


HELD = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.view("u8")) & _MASK).astype("i8")


def _bits_of(ids: DataFrame) -> Broadcast:
    """A sketch of a column of ids, of fixed size: what is not in it is none of them. Where it fills up, all rows pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for batch in batches:
            sketch.counts[_slot(batch.column(0).to_numpy())] = 1
        for part, blob in sketch.blobs():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    found = sketch_total(ids.coalesce(16).mapInArrow(count, "part int, blob binary")) > 0
    return ids.sparkSession.sparkContext.broadcast(zlib.compress(np.packbits(found).tobytes(), 1))


def links(rows: DataFrame, classes: DataFrame, pairs: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b, s) of classes those whose overlap reaches the bound, and of the groups (s, c) enough links to connect what is connected.

    Pairs are gathered by the shingle where they met, in blocks of ROWS classes, so that a block's sets travel once.
    """
    spark = rows.sparkSession
    size = pairs.groupBy("s").agg(F.count("*").alias("m"))
    blocks = F.expr(f"cast(ceil(sqrt(2 * m) / {ROWS}) as int)")  # m pairs that all meet come from about sqrt(2m) classes
    split = pairs.join(size, "s").withColumn("nb", blocks).select("a", "b", F.xxhash64("s", F.expr("pmod(xxhash64(a), nb)"), F.expr("pmod(xxhash64(b), nb)")).alias("g"))
    split = staged(split, "pairs")
    members = split.select("g", F.explode(F.array("a", "b")).alias("c")).distinct().withColumn("whole", F.lit(False))
    # a group whose sets take more than GROUP bytes is cut into blocks, and pairs of blocks are compared
    heavy = groups.join(classes.select("c", "n"), "c").groupBy("s").agg(F.ceil(F.sum(8 * F.col("n")) / GROUP).cast("int").alias("nb"))
    own, other = F.expr("cast(pmod(xxhash64(c, 7), nb) as int)"), F.explode(F.expr("sequence(0, nb - 1)"))
    groups = groups.join(heavy, "s").select("s", "c", "nb", own.alias("own"), other.alias("other"))
    groups = groups.select("c", F.when(F.col("nb") == 1, F.col("s")).otherwise(F.xxhash64("s", F.least("own", "other"), F.greatest("own", "other"))).alias("s"))
    members = staged(members.unionByName(groups.select(F.col("s").alias("g"), "c", F.lit(True).alias("whole"))), "members")
    # a class's set comes from the text of its smallest id; other texts under that id make sets of other classes
    groups_of = members.groupBy("c").agg(F.collect_list(F.struct("g", "whole")).alias("gs"))
    needed = staged(classes.join(groups_of, "c").select("c", "fp", F.col("class_id").alias("of"), "n", "gs"), "needed")
    total = needed.agg(F.sum(F.col("n") * F.size("gs"))).first()[0] or 0
    n = max(parts(spark), -(-8 * total // (8 << 20)))
    wanted = _bits_of(needed.select("of"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(wanted.value), "u1")).astype(bool)
        for batch in batches:
            ids = batch.column("doc_id")
            yield batch.filter(pa.array(bits[_slot(ids.fill_null(0).to_numpy())] & ~ids.is_null().to_numpy(zero_copy_only=False)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, size = ["h", "doc_id", "whole", "blob"], [], 0
        for batch in batches:
            for part in batch_slices(batch, "text"):
                for c, fp, gs, found in zip(part.column("c").to_pylist(), part.column("fp").to_pylist(), part.column("gs").to_pylist(), _sets(part, k)):
                    if not len(found) or xxhash.xxh3_128_digest(found.data) != fp:
                        continue
                    blob = found.tobytes()
                    for g in gs:
                        out.append((g["g"], c, g["whole"], blob))
                        size += len(blob)
                        if size >= 8 << 20:
                            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), HELD)], names=names)
                            out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), HELD)], names=names)

    some = rows.mapInArrow(likely, rows.schema).join(needed.select("c", "fp", "of", "gs").hint("shuffle_hash"), F.col("doc_id") == F.col("of")).select("text", "c", "fp", "gs")
    held = some.mapInArrow(make, "h long, doc_id long, whole boolean, blob binary")

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        g, docs, whole, blobs = right.column("h").to_numpy(), right.column("doc_id").to_numpy(), right.column("whole").to_numpy(), right.column("blob").combine_chunks()
        pg, pa_, pb = (left.column(c).to_numpy() for c in ("g", "a", "b"))
        by, pby = np.lexsort((docs, whole, g)), np.argsort(pg, kind="stable")
        if len(by):  # rows that were repeated have brought their set again
            g_, d_, w_ = g[by], docs[by], whole[by]
            by = by[np.concatenate([[True], (g_[1:] != g_[:-1]) | (d_[1:] != d_[:-1]) | (w_[1:] != w_[:-1])])]
        g, docs, whole, pg = g[by], docs[by], whole[by], pg[pby]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (whole[1:] != whole[:-1])])) if len(g) else np.zeros(0, "i8")
        out_a, out_b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(g)]):
            sets = [np.frombuffer(x, "u8") for x in blobs.take(pa.array(by[s:e])).to_pylist()]
            mine = docs[s:e]
            if whole[s]:
                found = np.array(forest(sets, percent), "i8").reshape(-1, 2)
                a, b = mine[found[:, 0]], mine[found[:, 1]]
            else:
                wanted = pby[np.searchsorted(pg, g[s], "left") : np.searchsorted(pg, g[s], "right")]
                a, b = pa_[wanted], pb[wanted]
                i, j = np.searchsorted(mine, a), np.searchsorted(mine, b)
                n = np.array([len(x) for x in sets])
                if len(sets) > 3:
                    overlap = block_product(sets, sets)[i, j]
                else:
                    overlap = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], "i8")
                good = 100 * overlap >= percent * (n[i] + n[j] - overlap)
                a, b = a[good], b[good]
            out_a.append(np.minimum(a, b))
            out_b.append(np.maximum(a, b))
        return pa.table({"a": pa.array(np.concatenate(out_a)), "b": pa.array(np.concatenate(out_b))})

    left, right = split.withColumn("bucket", F.expr(f"cast(pmod(g, {n}) as int)")), held.withColumn("held_bucket", F.expr(f"cast(pmod(h, {n}) as int)"))
    return left.groupBy("bucket").cogroup(right.groupBy("held_bucket")).applyInArrow(multiply, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id) for each row of docs.

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles; a text with fewer
    words is one shingle, one without words or null has none and links with nothing. class_id: the smallest id with the
    same set; component_id: the smallest id reachable by links. Words are lower-cased for A-Z. Each row is a document of
    its own: repeated rows link with each other, and texts that share an id link by their own sets only. Rows without an
    id get their count and no class or component. Other columns are ignored; an empty table
    gives no rows. Different classes are never expanded into all pairs, but every link between two of them is decided.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text).alias("text"))
    first = fingerprints(rows, k)
    of = first.where("part IS NULL").select("doc_id", "n", "fp", "f")
    classes = of.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.min("f").alias("f"), F.min("n").alias("n"))
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    counts = sketch_total(first.where("part IS NOT NULL"))
    met = staged(candidates(prefixes(rows, counts, k, percent), percent), "candidates")
    # sets that share a short fingerprint only stand for each other here; their own sets decide
    pairs = met.where("b IS NOT NULL")
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("f").alias(end), F.col("c").alias(f"{end}_c")), end).drop(end).withColumnRenamed(f"{end}_c", end)
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").groupBy("a", "b").agg(F.min("s").alias("s"))
    groups = met.where("b IS NULL").join(classes.select(F.col("f").alias("a"), "c"), "a").select("s", "c").distinct()
    reach = components(staged(links(rows, classes, pairs, groups, k, percent), "links"))
    named = staged(reach.join(classes.select(F.col("c").alias("node"), "class_id"), "node"), "reach")
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = classes.join(named.select(F.col("node").alias("c"), "component").join(least, "component"), "c", "left").select("fp", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    dropped(met)
    with_id = F.col("doc_id").isNotNull()
    out = of.join(known, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(with_id, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(with_id, F.coalesce("component_id", "doc_id")).alias("component_id"))
