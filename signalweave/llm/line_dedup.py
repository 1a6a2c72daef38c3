"""Fuzzy line dedup: hashes of normalised lines, a join on blocks of them, a check of edit similarity, groups.

A line is normalised to its words, A-Z lowered, one space apart. Equal normalised lines are one class, however short.
Lines of min_words words or more also meet when one of BANDS blocks of their hashes is equal; a block is ROWS minima over
the line's pairs of words or, for short lines, its 4-byte pieces. Classes that meet link when their SimHashes differ in at
most RADIUS bits (lines over SMALL characters) and their edit similarity, 1 - edits / longer length in characters, reaches
the bound; groups are connected classes. The first line of each group (smallest document id, null last, then row, then line
number) stays, all other lines of it go.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweave.llm.common import Sketch, batch_slices, dropped, fresh, numbered, parts, quoted, sketch_total, staged, tidy
from signalweave.llm.components import components
from signalweave.llm.edits import within
from signalweave.llm.text import filled, mixed, word_hashes, words_of

#: Words of at most so many bytes give no vote to the SimHash where a line has longer ones: the most frequent words are short, and lines that share only those should not look alike.
SHORT = 3
#: Classes of one block of a bucket; those of a bucket that pair off one by one.
BLOCK, FEW = 1024, 16
#: A class counts once more for each WEIGHT of its length, so that blocks of long lines hold fewer.
WEIGHT = 2048
#: Lines meet by bands of ROWS minima each: of word pairs for lines of at least LONG characters, of 4-byte pieces for those of at most SMALL. SMALL * 0.9 >= LONG, so two alike lines have one kind in common.
BANDS, ROWS, LONG, SMALL = 10, 3, 90, 100
#: Bits in which the SimHashes of two lines over SMALL characters may differ.
RADIUS = 22
ODD = mixed(np.arange(1, BANDS * ROWS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Groups are compared together up to so many characters; those of more classes than SPREAD are dealt one by one.
TOGETHER, SPREAD = 1 << 23, 256
#: Entries of buckets that are packed together.
TAKEN = 1 << 19
#: A round of comparisons takes up to so many lines of a group until it has so many pairs.
AHEAD, ENOUGH = 8, 512


def simhashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit SimHash for each run of words; runs must not be empty. Votes are summed as bytes, eight in a number, over at most 255 words at a time."""
    out = np.zeros(len(bounds) - 1, "u8")
    for start in range(0, len(out), 2048):
        edge = bounds[start : start + 2049] - bounds[start]
        n = np.diff(edge)
        pieces = -(-n // 255)
        first = np.cumsum(pieces) - pieces
        at = np.repeat(edge[:-1], pieces) + (np.arange(int(pieces.sum())) - np.repeat(first, pieces)) * 255
        bits = np.unpackbits(hashes[bounds[start] : bounds[start] + edge[-1]].view("u1").reshape(-1, 8), axis=1, bitorder="little").view("u8")
        sums = np.stack([np.add.reduceat(np.ascontiguousarray(bits[:, j]), at) for j in range(8)], axis=1).view("u1").reshape(-1, 64)
        votes = sums[first].astype("i4")
        for i in np.flatnonzero(pieces > 1).tolist():
            votes[i] = sums[first[i] : first[i] + pieces[i]].sum(axis=0, dtype="i4")
        out[start : start + 2048] = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("u8").ravel()
    return out


def banded(features: np.ndarray, first: np.ndarray, kind: int) -> np.ndarray:
    """For each run of features (rows) BANDS hashes of 40 bits, each of ROWS minima; runs start at first and must not be empty."""
    out = np.zeros((len(first), BANDS), "u8")
    for t in range(BANDS if len(first) else 0):
        h = np.full(len(first), 1 + kind * BANDS + t, "u8")
        for k in range(ROWS):
            h = mixed(h ^ np.minimum.reduceat(features * ODD[t * ROWS + k], first))
        out[:, t] = h >> np.uint64(24)
    return out


def word_bands(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bands of each run's pairs of words, from the words' hashes; runs hold two words at least."""
    pair = mixed(hashes[:-1] * np.uint64(3) + (hashes[1:] ^ (hashes[1:] >> np.uint64(29))))
    ends = np.ones(len(hashes), bool)
    ends[bounds[1:] - 1] = False
    return banded(pair[ends[:-1]], bounds[:-1] - np.arange(len(bounds) - 1), 0)


def piece_bands(lines: pa.Array) -> np.ndarray:
    """Bands of each line's 4-byte pieces; lines hold four bytes at least."""
    offsets = np.frombuffer(lines.buffers()[1], "i4", len(lines) + 1, lines.offset * 4).astype("i8")
    data = np.frombuffer(lines.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]].astype("u8")
    offsets = offsets - offsets[0]
    piece = sum(data[i : len(data) - 3 + i] << np.uint64(8 * i) for i in range(4))
    inside = np.ones(len(data), bool)
    for i in range(1, 4):
        inside[offsets[1:] - i] = False
    return banded(mixed(mixed(piece[inside[: len(piece)]] + np.uint64(1))), offsets[:-1] - 3 * np.arange(len(lines)), 1)


def pair_counts(lines: list[str], cells: int = 512) -> np.ndarray:
    """How many of each line's pairs of characters fall into each cell. An edit takes two pairs at most and gives two, so the counts of lines k edits apart differ by 4k at most in all."""
    size = np.fromiter(map(len, lines), "i8", len(lines))
    c = np.frombuffer("".join(lines).encode("utf-32-le"), "u4")
    if len(c) < 2:
        return np.zeros((len(lines), cells), "i4")
    cell = (c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)) >> np.uint32(33 - cells.bit_length())
    row = np.repeat(np.arange(len(lines)), size)
    inside = row[1:] == row[:-1]
    return np.bincount(row[:-1][inside] * cells + cell[inside], minlength=cells * len(lines)).reshape(len(lines), cells).astype("i4")


def pair_bits(counts: np.ndarray) -> np.ndarray:
    """Which cells are not empty, 64 in a number: two lines differ in no more of them than in their counts."""
    return np.packbits(counts > 0, axis=1, bitorder="little").view("u8")


class _Group:
    """Lines of a group, which of them hang together so far, and the links that do it. Memory: a byte for each two lines."""

    def __init__(self, ids: list[int], lines: list[str], base: int, bits: np.ndarray, percent: int) -> None:
        self.ids, self.lines, self.base, self.at, n = ids, lines, base, -1, len(lines)
        size = np.fromiter(map(len, lines), "i8", n)
        self.root, self.size, self.percent = np.arange(n), size, percent
        self.near = np.zeros((n, n), bool)  # for each line the later ones that lengths and cells don't rule out
        step = max(1, (1 << 16) // max(1, n))
        for i in range(0, n, step):
            most = (100 - percent) * np.maximum(size[i : i + step, None], size[None, i:]) // 100
            fits = np.abs(size[i : i + step, None] - size[None, i:]) <= most
            apart = np.bitwise_count(bits[i : i + step, None] ^ bits[None, i:]).sum(axis=2, dtype="i4")
            self.near[i : i + step, i:] = fits & (apart <= 4 * most)
        self.near &= np.tri(n, dtype=bool).T
        np.fill_diagonal(self.near, False)
        self.todo = np.flatnonzero(self.near.any(axis=1)).tolist()[::-1]

    def next(self) -> np.ndarray:
        """The later lines that the next line must be compared with; none at the end."""
        while self.todo:
            self.at = self.todo.pop()
            later = np.flatnonzero(self.near[self.at] & (self.root != self.root[self.at]))
            if len(later):
                return later
        return np.zeros(0, "i8")

    def most(self, at: int, later: np.ndarray) -> np.ndarray:
        return (100 - self.percent) * np.maximum(self.size[later], self.size[at]) // 100

    def link(self, at: int, later: np.ndarray) -> None:
        for j in later.tolist():
            if self.root[j] != self.root[at]:
                self.root[self.root == self.root[j]] = self.root[at]


def forest(groups: list[tuple[list[int], list[str]]], percent: int) -> list[tuple[int, int]]:
    """Links that connect all lines of each group that edits connect. Groups are numbers of lines and their texts, and may share lines.

    In each round one line of every group, or up to AHEAD where that is few pairs, meets its later ones, but for those that
    hang together already, in whichever group that was found.
    """
    if not groups:
        return []
    counts = pair_counts([x for _, lines in groups for x in lines])
    base = np.cumsum([0, *(len(lines) for _, lines in groups)]).tolist()
    bits = pair_bits(counts)
    live = [g for g in (_Group(ids, lines, a, bits[a:b], percent) for (ids, lines), a, b in zip(groups, base, base[1:])) if g.todo]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out: list[tuple[int, int]] = []
    while live:
        wanted: list[tuple[_Group, int, np.ndarray]] = []
        for _ in range(AHEAD):
            asked = [(g, g.at, later) for g in live if len(later := g.next())]
            live = [g for g, _, _ in asked]
            wanted += asked
            if not asked or sum(len(later) for _, _, later in wanted) >= ENOUGH:
                break
        pairs: dict[tuple[int, int], tuple[str, str, int]] = {}
        for g, i, later in wanted:
            mine, at = find(g.ids[i]), g.ids[i]
            later = np.array([j for j in later.tolist() if find(g.ids[j]) != mine], "i8")
            most = g.most(i, later)
            near = np.abs(counts[g.base + later] - counts[g.base + i]).sum(axis=1) <= 4 * most
            for j, m in zip(later[near].tolist(), most[near].tolist()):
                pairs[at, g.ids[j]] = g.lines[i], g.lines[j], m
        a, b, most = zip(*pairs.values()) if pairs else ((), (), ())
        for (x, y), hit in zip(pairs, within(list(a), list(b), np.array(most, "i8")).tolist()):
            if hit and find(x) != find(y):
                root[find(y)] = find(x)
                out.append((x, y))
        for g, i, later in wanted:
            mine = find(g.ids[i])
            g.link(i, np.array([j for j in later.tolist() if find(g.ids[j]) == mine], "i8"))
    return out


def _lines(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(filled(text), "\n")
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype("i8")


def _blocks(flat: pa.Array, hashes: np.ndarray, at: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks, length in characters and bands (5 bytes each) of the lines long, from all words, their hashes and the lines' bounds in them. A line's two marks are its SimHash and 0 or, where it has at most SMALL characters, the 128 cells of its pairs."""
    n = np.diff(at)[long]
    bound = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(bound[-1]) + np.repeat(at[long] - bound[:-1], n)
    line = np.repeat(np.arange(len(long)), n)
    votes = pc.binary_length(flat).to_numpy(zero_copy_only=False)[take] > SHORT
    votes |= (np.bincount(line, votes, len(long)) == 0)[line]
    sims = np.zeros((len(long), 2), "u8")
    sims[:, 0] = simhashes(mixed(hashes[take[votes]]), np.concatenate([[0], np.cumsum(np.bincount(line[votes], minlength=len(long)))]))
    length = np.add.reduceat(pc.utf8_length(flat).to_numpy(zero_copy_only=False)[take], bound[:-1]).astype("i8") + n - 1
    big, small = np.flatnonzero((length >= LONG) & (n > 1)), np.flatnonzero((length <= SMALL) | (n == 1))
    blobs = np.full(len(long), b"", object)
    for some, kind in ((big, 0), (small, 1)):
        if not len(some):
            continue
        edge = np.concatenate([[0], np.cumsum(n[some])])
        words = take[np.arange(edge[-1]) + np.repeat(bound[some] - edge[:-1], n[some])]
        if kind:
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge.astype("i4")), flat.take(pa.array(words))), " ")
            joined = pc.if_else(pc.less(pc.binary_length(text), 4), pc.binary_join_element_wise(text, "   ", ""), text)
            short = length[some] <= SMALL
            sims[some[short]] = pair_bits(pair_counts(text.filter(pa.array(short)).to_pylist(), 128))
        found = piece_bands(joined) if kind else word_bands(hashes[words], edge)
        raw = np.ascontiguousarray(found.view("u1").reshape(len(some), BANDS, 8)[:, :, :5]).tobytes()
        blobs[some] += np.array([raw[i : i + 5 * BANDS] for i in range(0, len(raw), 5 * BANDS)], object)
    return sims, length, blobs


def line_rows(rows: DataFrame, min_words: int) -> DataFrame:
    """From rows (row, doc_id, text) a row (row, doc_id, line, key, sim, more, length, bands) for each line with a word; lines of fewer than min_words have a key only, and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text"):
                lines, doc_at = _lines(part.column("text"))
                flat, at = words_of(lines)
                some = np.flatnonzero(np.diff(at) > 0)
                if not len(some):
                    continue
                hashes = word_hashes(flat)
                keys = [xxhash.xxh3_128_digest(hashes[a:b].data) for a, b in zip(at[some].tolist(), at[some + 1].tolist())]
                sims, length, bands = np.zeros((len(some), 2), "u8"), np.zeros(len(some), "i8"), np.full(len(some), b"", object)
                long = np.flatnonzero(np.diff(at)[some] >= min_words)
                if len(long):
                    sims[long], length[long], bands[long] = _blocks(flat, hashes, at, some[long])
                doc = np.searchsorted(doc_at, some, side="right") - 1
                ids = pa.array(doc)
                yield pa.record_batch({"row": part.column("row").take(ids), "doc_id": part.column("doc_id").take(ids), "line": pa.array((some - doc_at[doc]).astype("i4")), "key": pa.array(keys, pa.binary()), "sim": pa.array(sims.view("i8")[:, 0]), "more": pa.array(sims.view("i8")[:, 1]), "length": pa.array(length.astype("i4")), "bands": pa.array(bands.tolist(), pa.binary())})

    return rows.mapInArrow(run, "row long, doc_id long, line int, key binary, sim long, more long, length int, bands binary")


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch of classes and the buckets that their bands lead to."""
    blobs = batch.column("bands").to_pylist()
    n = np.fromiter(map(len, blobs), "i8", len(blobs)) // 5
    wide = np.zeros((int(n.sum()), 8), "u1")
    wide[:, :5] = np.frombuffer(b"".join(blobs), "u1").reshape(-1, 5)
    return np.repeat(np.arange(len(n)), n), wide.view("u8").ravel()


def _packed(columns: list[np.ndarray]) -> bytes:
    """64-bit columns of one length, compressed byte by byte of their numbers: most high bytes are the same."""
    return pa.compress(np.ascontiguousarray(np.stack(columns).view("u1").reshape(len(columns), -1, 8).transpose(0, 2, 1)), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, columns: int) -> np.ndarray:
    data = np.frombuffer(pa.decompress(blob, 8 * n * columns, "zstd", asbytes=True), "u1")
    return np.ascontiguousarray(data.reshape(columns, 8, n).transpose(0, 2, 1)).view("i8").reshape(columns, n)


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a band, have near SimHashes and fitting lengths; g is null. A pair may come more than once.

    Where more than FEW classes meet in a bucket, the rows are its classes that have such a partner, g names the group
    and b is null. A fixed-size sketch bounds how many classes a bucket holds, long ones weighted; large buckets are cut
    into blocks, and pairs of blocks are dealt.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for batch in batches:
            row, b = _places(batch)
            sketch.add(b, (1 + batch.column("length").to_numpy() // WEIGHT)[row])
        for part, blob in sketch.blobs():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    spark = classes.sparkSession
    fixed = spark.sparkContext.broadcast(zlib.compress(sketch_total(classes.select("length", "bands").mapInArrow(count, "part int, blob binary")).tobytes(), 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(zlib.decompress(fixed.value), "u4")
        noise = int(counts.mean())
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids, sims, more, length = (batch.column(x).to_numpy() for x in ("c", "sim", "more", "length"))
            row, b = _places(batch)
            nb = np.maximum(1, -(-(counts[(b & np.uint64(len(counts) - 1)).astype("i8")].astype("i8") - noise) // BLOCK))
            own = mixed(ids[row].view("u8")) % nb.astype("u8")
            at = np.repeat(np.arange(len(b)), nb)
            other = np.arange(len(at)) - np.repeat(np.cumsum(nb) - nb, nb)
            o, b, at = own.astype("i8")[at], b[at], row[at]
            xy = np.minimum(o, other) << 20 | np.maximum(o, other)
            held.append(np.stack([b.view("i8"), xy, o, ids[at], sims[at], more[at], length[at].astype("i8")]))
            size += len(b)
            if size >= TAKEN:
                yield from told(held)
                held, size = [], 0
        if size:
            yield from told(held)

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held, axis=1)
        part = (mixed(rows[0].view("u8") ^ mixed(rows[1].view("u8"))) % np.uint64(n_parts)).astype("i8")
        rows = rows[:, np.argsort(part, kind="stable")]
        n = np.bincount(part, minlength=n_parts)
        end = np.cumsum(n)
        some = np.flatnonzero(n)
        blobs = [_packed(list(rows[:, end[i] - n[i] : end[i]])) for i in some.tolist()]
        yield pa.record_batch({"part": pa.array(some.astype("i4")), "n": pa.array(n[some]), "blob": pa.array(blobs, pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "bucket", "xy", "own", "c", "sim", "more", "length"
        held = [_unpacked(blob, n, len(names)) for batch in batches for blob, n in zip(batch.column("blob").to_pylist(), batch.column("n").to_pylist())]
        if not held:
            return
        c = dict(zip(names, np.concatenate(held, axis=1)))
        del held
        order = np.lexsort((c["length"], c["xy"], c["bucket"]))
        c = {x: v[order] for x, v in c.items()}
        new = (c["bucket"][1:] != c["bucket"][:-1]) | (c["xy"][1:] != c["xy"][:-1])
        group = np.concatenate([[0], np.cumsum(new)])
        last = np.searchsorted(group, group, side="right") - 1
        same = (c["xy"] >> 20) == (c["xy"] & ((1 << 20) - 1))
        sim, more, size = c["sim"].view("u8"), c["more"].view("u8"), np.bincount(group)[group]
        busy = np.zeros(len(group), bool)
        left, step = np.flatnonzero(np.arange(len(group)) < last), 1
        while len(left):
            right = left + step
            fits = 100 * c["length"][left].astype("i8") >= percent * c["length"][right].astype("i8")  # lengths rise: beyond one that doesn't fit none does
            left, right = left[fits], right[fits]
            apart, short = np.bitwise_count(sim[left] ^ sim[right]).astype("i4"), c["length"][right] <= SMALL
            cells = apart + np.bitwise_count(more[left] ^ more[right]) <= 4 * ((100 - percent) * c["length"][right] // 100)
            good = np.where(short, cells, (apart <= RADIUS) | (c["length"][left] <= SMALL))
            good &= same[left] | (c["own"][left] != c["own"][right])
            many = good & (size[left] > FEW)
            busy[left[many]] = busy[right[many]] = True
            g = left[good & ~many]
            if len(g):
                a, b = c["c"][g], c["c"][g + step]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(g), pa.int64())], names=["a", "b", "g"])
            step += 1
            left = left[left + step <= last[left]]
        if busy.any():
            b = np.flatnonzero(busy)
            name = mixed(c["bucket"][b].view("u8") ^ mixed(c["xy"][b].view("u8"))).view("i8")
            yield pa.record_batch([pa.array(c["c"][b]), pa.nulls(len(b), pa.int64()), pa.array(name)], names=["a", "b", "g"])

    # one row holds all that a task has for a part, so that few rows are shuffled
    n_parts = parts(spark)
    dealt = classes.select("c", "sim", "more", "length", "bands").mapInArrow(deal, "part int, n long, blob binary")
    return dealt.repartitionById(n_parts, F.col("part")).mapInArrow(meet, "a long, b long, g long")


def texts_of(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows (c, norm): the normalised text of each needed (c, row, line)."""
    wanted = needed.groupBy(F.col("row").alias("want")).agg(F.collect_list(F.struct("c", "line")).alias("lines"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text"):
                ids, out = [], []
                for t, w in zip(*[part.column(x).to_pylist() for x in ("text", "lines")]):
                    split = t.split("\n")
                    ids += [x["c"] for x in w]
                    out += [split[x["line"]] for x in w]
                flat, at = words_of(pa.array(out, pa.string()))
                yield pa.record_batch({"c": pa.array(ids, pa.int64()), "norm": pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype("i4")), flat), " ")})

    met = rows.select("row", "text").join(wanted.hint("shuffle_hash"), F.col("row") == F.col("want"))
    return met.select("text", "lines").mapInArrow(cut, "c long, norm string")


def links(met: DataFrame, norms: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all classes that edits connect. Pairs are gathered by the smallest class that the larger one meets, which brings most of a group of near copies together; of each group's links a forest is enough."""
    pairs = met.where("g IS NULL").select("a", "b").distinct()
    hub = pairs.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("g"))
    pairs = pairs.join(hub, F.col("b") == F.col("of"))
    groups = met.where("g IS NOT NULL").select("g", F.col("a").alias("c")).distinct()
    # groups of the same classes, from several bands, are one
    member = [F.xxhash64(F.lit(s), "c") for s in (1, 2)]
    once = groups.groupBy("g").agg(F.bit_xor(member[0]).alias("x"), F.bit_xor(member[1]).alias("y"), F.count("*").alias("n")).groupBy("x", "y", "n").agg(F.min("g").alias("g")).select("g")
    members = pairs.select(F.lit(True).alias("few"), "g", F.col("g").alias("hub"), F.explode(F.array("a", "b")).alias("c")).distinct()
    # large ones are blocks of one bucket, many of which have the same smallest class: they are spread
    hubs = groups.groupBy("g").agg(F.when(F.count("*") > SPREAD, F.col("g")).otherwise(F.min("c")).alias("hub"))
    groups = groups.join(once.join(hubs, "g"), "g")
    members = members.unionByName(groups.select(F.lit(False).alias("few"), "g", "hub", "c")).join(norms, "c")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[int], list[str]]] = []
        size, name = 0, None

        def told() -> pa.RecordBatch:
            a, b = np.array(forest(held, percent), "i8").reshape(-1, 2).T
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for few, g, c, norm in zip(*[batch.column(x).to_pylist() for x in ("few", "g", "c", "norm")]):
                if (few, g) != name:
                    if size > TOGETHER:
                        yield told()
                        held, size = [], 0
                    name = few, g
                    held.append(([], []))
                held[-1][0].append(c)
                held[-1][1].append(norm)
                size += max(len(norm), 300)  # counts of pairs take as much for any line
        if held:
            yield told()

    # groups with the same smallest class come one after another: what one has linked, the next one need not compare
    dealt = members.repartition(parts(met.sparkSession), "hub").sortWithinPartitions("hub", "few", "g", "c")
    return dealt.select("few", "g", "c", "norm").mapInArrow(connect, "a long, b long")


def line_groups(rows: DataFrame, min_words: int = 5, percent: int = 90) -> DataFrame:
    """From a written table (row, doc_id, text), row being different in each, a written table (row, line, first) of each line that goes; first is the place (late, doc_id, row, line) of the line of its group that stays.

    What later steps need is written anew without the rest, which goes: a line's bands take more than all else of it.
    """
    full = staged(line_rows(rows, min_words), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "row", "line")
    of_class = [F.first(c).alias(c) for c in ("sim", "more", "length", "bands")]
    found = full.groupBy("key").agg(F.min(place).alias("p"), *of_class, F.count("*").alias("n"))
    found = staged(found.select(F.monotonically_increasing_id().alias("c"), "key", "p", "sim", "more", "length", "bands", "n"), "line-blocks")
    lines = staged(full.select("row", "line", "key"), "line-keys")
    dropped(full)
    met = staged(candidates(found, percent), "line-pairs")
    classes = staged(found.select("c", "key", "p", "n"), "line-classes")
    dropped(found)
    ends = met.select(F.explode(F.array("a", "b")).alias("c")).where("c IS NOT NULL").distinct()
    norms = staged(texts_of(rows, classes.select("c", "p.row", "p.line").join(ends, "c", "left_semi")), "line-texts")
    linked = staged(links(met, norms, percent), "line-links")
    dropped(met)
    dropped(norms)
    groups = components(linked)
    placed = staged(groups.join(classes.select(F.col("c").alias("node"), "p"), "node"), "line-groups")
    firsts = placed.groupBy("component").agg(F.min("p").alias("first"))
    of_group = placed.select("node", "component").join(firsts, "component").select("node", "first")
    stays = classes.join(of_group, F.col("c") == F.col("node"), "left").where("n > 1 OR node IS NOT NULL")
    stays = stays.select(F.col("key").alias("of"), F.coalesce("first", "p").alias("first"))
    gone = staged(lines.join(stays, F.col("key") == F.col("of")).where("row <> first.row OR line <> first.line").select("row", "line", "first"), "line-gone")
    for table in (linked, groups, placed, classes, lines):
        dropped(table)
    return gone


def without(text: Column, gone: Column) -> Column:
    """A text without the lines whose numbers stand in gone."""
    kept = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: x[i]), "\n")
    return F.when(gone.isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n")), kept)[0])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 5, percent: int = 90, removed: str = "lines_removed", kept: str = "lines_kept") -> DataFrame:
    """docs with the columns it has, its text without the lines that go, and the columns removed and kept (both long).

    Null texts stay null and have no lines kept or removed; an empty text has one empty line. Lines without a word stay.
    Each row is a document of its own, also where ids are repeated or null: of rows with equal ids and lines one keeps
    the line. Texts keep every other byte. A column of docs named like removed or kept gives way to it.
    """
    held, row = numbered(docs, "line-docs")
    gone_row, gone_lines = fresh(docs, "gone_row", "gone_lines")
    rows = held.select(F.col(row).alias("row"), quoted(id_col).cast("long").alias("doc_id"), quoted(text).alias("text"))
    with tidy(docs.sparkSession):
        gone = line_groups(rows, min_words, percent)
    gone = gone.groupBy(F.col("row").alias(gone_row)).agg(F.collect_set("line").alias(gone_lines))
    out = held.join(gone.hint("shuffle_hash"), F.col(row) == F.col(gone_row), "left")
    count = F.when(F.col(gone_lines).isNull(), 0).otherwise(F.size(gone_lines))
    lines = F.when(quoted(text).isNull(), 0).otherwise(F.regexp_count(quoted(text), F.lit("\n")) + 1)
    others = [without(quoted(text), F.col(gone_lines)).alias(c) if c.lower() == text.lower() else quoted(c) for c in docs.columns if c.lower() not in (removed.lower(), kept.lower())]
    return out.select(*others, count.cast("long").alias(removed), (lines - count).cast("long").alias(kept))
