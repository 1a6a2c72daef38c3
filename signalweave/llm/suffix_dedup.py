"""Removal of repeated 50-byte strings across documents, by column-wise construction of a Burrows-Wheeler transform.

A byte goes if a string of length bytes covers it that also starts in a document with a smaller id. Strings are placed by
the smallest hash of the GRAM-byte grams inside them, so equal strings meet; consecutive starts with the same smallest
hash are one run, and a run's bytes stand for all its strings.

1. Each chunk of documents lists the hashes of its runs; those that two documents share are told back to the chunk. Where
   HOT chunks or more list a hash, its runs would gather in one task: they are taken apart into their strings, each with
   a hash of its own, and those are listed and told back in the same way.
2. Chunks send the bytes of runs with shared hashes, equal ones once, with their smallest and largest document. Single
   strings are sent as two hashes of 64 bits.
3. Of what is sent to a place, stretches whose strings come more than once enter bounded collections: one symbol of each
   is inserted a round, last column first, which updates the collection's transform and common prefixes; in the finished
   order equal strings are neighbours with a common prefix of length or more, and the smallest document of each answers.
4. Chunks get the answers for their runs and cut their documents.

What is told to chunks goes through files in the shared folder, written and read in sequence.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.common import batch_slices, parts, quoted, staged, tidy
from signalweave.llm.text import filled, mixed
from signalweave.tables import new_path

LENGTH, GRAM, LONGEST = 50, 16, 64
#: Bytes hashed at a time; runs that enter one collection, about; chunks that list a hot hash; bytes of text for each place.
STEP, COLLECTION, HOT, PLACE = 1 << 17, 8192, 256, 64 << 20
_SYMBOL = mixed(np.arange(1, 257, dtype="u8"))
_OTHER = mixed(np.arange(1001, 1257, dtype="u8"))
_M = np.uint64(0x9E3779B97F4A7C15)
#: Hashes are listed by their upper 48 bits: an accidental match only sends a run that finds no equal.
_LISTED = np.uint64(16)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * _M
    z ^= z >> np.uint64(32)
    z += b
    return z


def _hashes(data: np.ndarray, size: int, symbols: np.ndarray = _SYMBOL) -> np.ndarray:
    """For each start of a string of size bytes a hash of it: from hashes of 1, 2, 4, ... bytes, two of which cover it."""
    h, wide = symbols[data], 1
    while 2 * wide <= size:
        h = _pair(h[:-wide], h[wide:])
        wide *= 2
    if wide < size:
        h = _pair(h[: len(h) - (size - wide)], h[size - wide :])
    return mixed(h)


def least_hashes(data: np.ndarray, symbols: np.ndarray = _SYMBOL) -> np.ndarray:
    """For each start of a string of LENGTH bytes the smallest hash of its grams."""
    out = np.empty(max(0, len(data) - LENGTH + 1), "u8")
    for start in range(0, len(out), STEP):
        h = _hashes(data[start : start + STEP + LENGTH - 1], GRAM, symbols)
        wide, span = LENGTH - GRAM + 1, 1
        while 2 * span <= wide:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < wide:
            h = np.minimum(h[: len(h) - (wide - span)], h[wide - span :])
        out[start : start + STEP] = h[:STEP]
    return out


def runs(data: np.ndarray, bounds: np.ndarray, symbols: np.ndarray = _SYMBOL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts in documents with the same smallest hash: first start, number of starts (at most LONGEST), hash."""
    h = least_hashes(data, symbols)
    if not len(h):
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")
    valid = np.ones(len(h), bool)
    new = np.concatenate([[True], h[1:] != h[:-1]])
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        valid[max(s, e - LENGTH + 1) : e] = False
        if s < len(new):
            new[s] = True
    new[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(h)))
    keep = valid[first]
    first, many = first[keep], many[keep]
    pieces = -(-many // LONGEST)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(first, pieces) + nth * LONGEST
    return first, np.minimum(np.repeat(many, pieces) - nth * LONGEST, LONGEST), mixed(h[first])  # least hashes are small: mixed, they fill all places alike


def _data(text: pa.Array) -> tuple[bytes, np.ndarray]:
    text = filled(text).cast(pa.large_binary())
    bounds = np.frombuffer(text.buffers()[1], "i8", len(text) + 1, text.offset * 8)
    raw = memoryview(text.buffers()[2])[bounds[0] : bounds[-1]].tobytes() if bounds[-1] > bounds[0] else b""
    return raw, bounds - bounds[0]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+://|file:", folder) else (fs.LocalFileSystem(), folder)


def _told(rows: DataFrame, folder: str) -> None:
    """Writes each chunk's blobs, in order of place, to one file named after the chunk. A file gets its name when it is whole, so that attempts of a task do not meet."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name, out, n, attempt = None, None, 0, f".{uuid.uuid4().hex}"

        def close() -> None:
            out.close()
            try:
                store.move(f"{base}/{name}{attempt}", f"{base}/{name}")
            except OSError:  # another attempt's file has the name, where that is not simply replaced
                if store.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                    raise
                store.delete_file(f"{base}/{name}{attempt}")

        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist()):
                if chunk != name:
                    if out is not None:
                        close()
                    name, n = chunk, n + 1
                    out = store.open_output_stream(f"{base}/{chunk}{attempt}", compression=None)
                out.write(blob)
        if out is not None:
            close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["files"])

    spread = rows.select("chunk", "place", "blob").repartition(parts(rows.sparkSession), "chunk").sortWithinPartitions("chunk", "place")
    spread.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _read(folder: str, chunk: int) -> bytes:
    store, base = _store(folder)
    info = store.get_file_info(f"{base}/{chunk}")
    if info.type == fs.FileType.NotFound:
        return b""
    with store.open_input_stream(info.path, compression=None) as f:
        return f.read()


def _listed(h: np.ndarray, doc: np.ndarray, n_places: int) -> list[tuple[int, bytes]]:
    """Different hashes in n_places ranges (a power of two); odd entries stand in two documents of the chunk."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, "i8")
    if not len(at):
        return []
    u, several = h[at], np.maximum.reduceat(doc, at) > doc[at]
    edges = np.searchsorted(u >> np.uint64(64 - n_places.bit_length() + 1), np.arange(n_places + 1, dtype="u8"))
    listed = (u >> _LISTED << np.uint64(1)) | several.astype("u8")
    return [(i, _packed(listed[a:b])) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]


def chunked(rows: DataFrame) -> DataFrame:
    """A written table: documents with the chunk they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for part in batch_slices(batch, "text"):
                yield pa.record_batch([pa.array([base + n] * part.num_rows, pa.int64()), part.column("doc_id"), part.column("text")], names=["chunk", "doc_id", "text"])
                n += 1

    return staged(rows.mapInArrow(run, "chunk long, doc_id long, text string"), "chunks")


def listed(docs: DataFrame, n_places: int) -> DataFrame:
    """Rows (chunk, place, blob): each chunk's listed hashes in n_places ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in _chunks(batches):
            raw, bounds = _data(part.column("text"))
            first, _, h = runs(np.frombuffer(raw, "u1"), bounds)
            blobs = _listed(h, np.searchsorted(bounds, first, side="right") - 1, n_places)
            if blobs:
                yield pa.record_batch([pa.array([chunk] * len(blobs), pa.int64()), pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary())], names=["chunk", "place", "blob"])

    return docs.mapInArrow(run, "chunk long, place int, blob binary")


def listed_again(docs: DataFrame, folder: str, n_places: int) -> DataFrame:
    """Rows (chunk, place, blob): the same listing for each string of the runs with hot hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Wanted(folder)
        for chunk, part in _chunks(batches):
            raw, bounds = _data(part.column("text"))
            at, key = wanted.hot_strings(chunk, raw, bounds)
            blobs = _listed(key, np.searchsorted(bounds, at, side="right") - 1, n_places)
            if blobs:
                yield pa.record_batch([pa.array([chunk] * len(blobs), pa.int64()), pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary())], names=["chunk", "place", "blob"])

    return docs.mapInArrow(run, "chunk long, place int, blob binary")


def _by_place(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of one place after another; batches are in its order."""
    place, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(x).to_pylist() for x in ("place", *columns)]):
            if row[0] != place:
                if held:
                    yield place, held
                place, held = row[0], []
            held.append(row[1:])
    if held:
        yield place, held


def _dealt(rows: DataFrame, n_places: int) -> DataFrame:
    """Rows by place, in its order, so that a task holds one place at a time."""
    return rows.repartition(max(parts(rows.sparkSession), n_places // 4), "place").sortWithinPartitions("place")


def _packed(values: np.ndarray) -> bytes:
    """Rising numbers as differences, in 4 bytes each where they fit."""
    steps = np.diff(values, prepend=values[:1])
    small = len(steps) == 0 or int(steps.max()) < 1 << 32
    head = values[:1].tobytes()
    return bytes([small]) + head + steps.astype("<u4" if small else "<u8").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, "<u4" if blob[0] else "<u8", offset=9).astype("u8")
    return np.cumsum(steps, dtype="u8") + np.frombuffer(blob, "<u8", 1, 1)


def shared(listed: DataFrame, n_places: int) -> DataFrame:
    """Rows (chunk, place, blob): of each chunk's listed hashes those that another document has too; odd ones are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, blobs in _by_place(batches, "chunk", "blob"):
            lists = [_unpacked(b) for _, b in blobs]
            every = np.concatenate(lists)
            order = np.argsort(every >> np.uint64(1), kind="stable")
            h = every[order] >> np.uint64(1)
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            many = np.diff(np.append(at, len(h)))
            several = np.maximum.reduceat(every[order] & np.uint64(1), at).astype(bool)
            told = np.where((many > 1) | several, 1 + (many >= HOT), 0)
            back = np.empty(len(h), "u8")
            back[order] = np.repeat(told, many)
            found = [((x >> np.uint64(1) << np.uint64(1)) | (g > 1))[g > 0] for x, g in zip(lists, np.split(back, np.cumsum([len(x) for x in lists])[:-1]))]
            out = [(c, f.astype("<u8").tobytes()) for (c, _), f in zip(blobs, found) if len(f)]
            yield pa.record_batch([pa.array([c for c, _ in out], pa.int64()), pa.array([place] * len(out), pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["chunk", "place", "blob"])

    return _dealt(listed.select("chunk", "place", "blob"), n_places).mapInArrow(run, "chunk long, place int, blob binary")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Consecutive rows of one chunk."""
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]]) if len(chunk) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(chunk[a]), batch.slice(a, b - a)


def run_hashes(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), "u8", len(strings))


def string_hashes(data: np.ndarray, at: np.ndarray, symbols: np.ndarray = _SYMBOL) -> np.ndarray:
    """A 64-bit hash of the LENGTH bytes from each place on; places rise."""
    out = np.empty(len(at), "u8")
    edges = np.searchsorted(at, np.arange(0, len(data) + STEP, STEP))
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if b > a:
            out[a:b] = _hashes(data[i * STEP : (i + 1) * STEP + LENGTH - 1], LENGTH, symbols)[at[a:b] - i * STEP]
    return mixed(out)


class _Wanted:
    """Runs of a chunk whose hashes are shared, and the hash of each one's bytes; of runs with hot hashes, each string whose own hash is shared."""

    def __init__(self, folder: str, strings: str | None = None) -> None:
        self.folders, self.chunk, self.listed = [folder, strings], None, []

    def _load(self, chunk: int) -> None:
        if chunk != self.chunk:
            self.chunk, self.listed = chunk, [np.frombuffer(_read(f, chunk) if f else b"", "<u8") for f in self.folders]

    def _told(self, h: np.ndarray, which: int) -> np.ndarray:
        """For each hash 0 if it is not told, 2 if it is hot, or else 1."""
        told = self.listed[which]
        if not len(told) or not len(h):
            return np.zeros(len(h), "i8")
        at = np.minimum(np.searchsorted(told >> np.uint64(1), h >> _LISTED), len(told) - 1)
        return np.where(told[at] >> np.uint64(1) == h >> _LISTED, 1 + (told[at] & np.uint64(1)).astype("i8"), 0)

    def _hot(self, data: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return at, string_hashes(data, at)

    def hot_strings(self, chunk: int, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all strings in runs with hot hashes."""
        self._load(chunk)
        if not (self.listed[0] & np.uint64(1)).any():
            return np.zeros(0, "i8"), np.zeros(0, "u8")
        data = np.frombuffer(raw, "u1")
        first, many, h = runs(data, bounds)
        hot = self._told(h, 0) == 2
        return self._hot(data, first[hot], many[hot])

    def __call__(self, chunk: int, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """First starts, numbers of starts, hashes, bytes and the bytes' hashes. Single strings have two hashes of their own, which tell them, and no bytes."""
        self._load(chunk)
        data = np.frombuffer(raw, "u1")
        first, many, h = runs(data, bounds)
        told = self._told(h, 0)
        at, key = self._hot(data, first[told == 2], many[told == 2])
        keep = self._told(key, 1) > 0
        at, key = at[keep], key[keep]
        first, many, h = first[told == 1], many[told == 1], h[told == 1]
        strings = [raw[a:b] for a, b in zip(first.tolist(), (first + many + LENGTH - 1).tolist())]
        of = np.concatenate([run_hashes(strings), string_hashes(data, at, _OTHER)])
        strings += [b""] * len(at)
        return np.concatenate([first, at]), np.concatenate([many, np.ones(len(at), "i8")]), np.concatenate([h, key]), strings, of


def _boxed(chunk: int, h: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, strings: list[bytes]) -> bytes:
    """Runs in the order of h as one compressed value; what has no bytes comes with the hash of them."""
    sizes = np.fromiter(map(len, strings), "<u1", len(strings))
    single = of[sizes == 0].astype("<u8")
    head = np.array([chunk, len(h), len(single)], "<i8").tobytes()
    return zlib.compress(b"".join([head, np.diff(h, prepend=np.zeros(1, "u8")).astype("<u8").tobytes(), low.astype("<i8").tobytes(), (high - low).astype("<i8").tobytes(), single.tobytes(), sizes.tobytes(), *strings]), 1)


def _unboxed(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """chunk, h, low, high, hashes of single strings, sizes and bytes of the runs."""
    raw = zlib.decompress(blob)
    chunk, n, m = np.frombuffer(raw, "<i8", 3).tolist()
    h, low, more = (np.frombuffer(raw, kind, n, 24 + 8 * n * i) for i, kind in enumerate(("<u8", "<i8", "<i8")))
    single = np.frombuffer(raw, "<u8", m, 24 + 24 * n)
    sizes = np.frombuffer(raw, "<u1", n, 24 + 24 * n + 8 * m)
    return chunk, np.cumsum(h, dtype="u8"), low, low + more, single, sizes, np.frombuffer(raw, "<u1", offset=24 + 25 * n + 8 * m)


def sent(docs: DataFrame, folder: str, strings_folder: str, n_places: int) -> DataFrame:
    """Rows (place, blob): a chunk part's runs with shared hashes of one range of hashes, equal ones once, with their smallest and largest document."""
    bits = np.uint64(64 - n_places.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Wanted(folder, strings_folder)
        for chunk, part in _chunks(batches):
            known = pc.is_valid(part.column("doc_id")).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(part.column("doc_id"), 0).to_numpy()
            raw, bounds = _data(part.column("text"))
            first, _, h, strings, of = wanted(chunk, raw, bounds)
            at = np.searchsorted(bounds, first, side="right") - 1
            real = np.flatnonzero(known[at])
            if not len(real):
                continue
            doc = ids[at]
            order = real[np.lexsort((doc[real], of[real], h[real]))]
            new = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
            low, high = order[new], order[np.append(new[1:], len(order)) - 1]
            edges = np.searchsorted(h[low] >> bits, np.arange(n_places + 1, dtype="u8"))
            out = [(i, _boxed(chunk, h[low[a:b]], doc[low[a:b]], doc[high[a:b]], of[low[a:b]], [strings[j] for j in low[a:b].tolist()])) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["place", "blob"])

    return docs.mapInArrow(run, "place int, blob binary")


def collection_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, common prefix with the one before) of all suffixes in the order of the collection, equal ones by string.

    Column by column from the right, one symbol of each string is inserted a round: the symbol before each string's
    suffix so far becomes known in the transform, and its rank there is the place of the longer suffix. Its common
    prefix with a neighbour that begins with the same symbol is one more than the least prefix between the two shorter
    suffixes. Strings are at most 255 bytes long.
    """
    n = len(strings)
    size = np.fromiter(map(len, strings), "i8", n)
    data = np.frombuffer(b"".join(strings), "u1")
    ends = np.cumsum(size)
    code = np.cumsum(np.bincount(data, minlength=256) > 0)  # in the order of symbols, from 1 on; 0: not known yet, or a string starts here
    data = code.astype("u1" if code[-1] < 256 else "u2")[data]
    transform, prefix = np.zeros(n, data.dtype), np.zeros(n, "u1")
    place = np.arange(n)
    for step in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > step)
        at = place[live]
        transform[at] = data[ends[live] - 1 - step]
        order = np.argsort(transform, kind="stable")[n - len(live) :]  # the places of all suffixes with one more symbol
        rank = np.empty(len(transform), "i4")
        rank[order] = np.arange(len(order), dtype="i4")
        new = rank[at].astype("i8")
        place[live] = new + n
        new.sort()
        # prefixes change at what is inserted and at what follows it
        after = new[np.append(new[1:] != new[:-1] + 1, new[-1] + 1 < len(order))] + 1
        pairs = np.concatenate([new[new > 0], after])
        left, right = order[pairs - 1], order[pairs]
        alike = transform[left] == transform[right]
        told = np.zeros(len(pairs), "u1")
        told[alike] = 1 + _least(prefix, left[alike] + 1, right[alike])
        old = np.ones(n + len(order), bool)
        old[new + n] = False
        grown, grown_prefix = np.zeros(len(old), transform.dtype), np.zeros(len(old), "u1")
        grown[old], grown_prefix[old] = transform, prefix
        grown_prefix[pairs + n] = told
        transform, prefix = grown, grown_prefix
    # walk the finished transform once to learn which suffix stands where
    rank = np.empty(len(transform), "i8")
    rank[np.argsort(transform, kind="stable")[n:]] = np.arange(n, len(transform))
    string, start = np.empty(len(transform), "i8"), np.empty(len(transform), "i8")
    place = np.arange(n)
    string[place], start[place] = np.arange(n), size
    for step in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > step)
        place[live] = rank[place[live]]
        string[place[live]], start[place[live]] = live, size[live] - 1 - step
    return string, start, prefix


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first : last + 1] for each range; ranges are not empty. Minima over 1, 2, 4, ... values in a row, two of which cover a range."""
    out, wide = np.zeros(len(first), values.dtype), last - first + 1
    level = (np.frexp(wide)[1] - 1).astype("u1")
    order, held, span, start = np.argsort(level, kind="stable"), values, 1, 0
    for k, many in enumerate(np.bincount(level).tolist()):
        if k:
            held, span = np.minimum(held[:-span], held[span:]), 2 * span
        some = order[start : start + many]
        out[some] = np.minimum(held[first[some]], held[last[some] - span + 1])
        start += many
    return out


def least_documents(strings: list[bytes], low: np.ndarray) -> list[np.ndarray]:
    """For each start in each run the smallest document among all runs that hold the same LENGTH bytes.

    Strings whose hash comes once in the collection have no equal, and their run's document answers; what is left of the
    runs, as stretches of starts, is put in order.
    """
    raw = b"".join(strings)
    size = np.fromiter(map(len, strings), "i8", len(strings))
    ends, many = np.cumsum(size), size - LENGTH + 1
    starts = np.cumsum(many)
    at = np.repeat(ends - size - (starts - many), many) + np.arange(int(many.sum()))
    least = np.repeat(low, many)
    key = string_hashes(np.frombuffer(raw, "u1"), at)
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    told = np.zeros(len(at) + 1, bool)
    told[order[1:][equal]] = told[order[:-1][equal]] = True
    # a stretch goes on while the next start is of the same run and told too
    on = told[:-1] & told[1:]
    on[starts - 1] = False
    first = np.flatnonzero(told[:-1] & ~np.concatenate([[False], on[:-1]]))
    last = np.flatnonzero(told[:-1] & ~on)
    if len(first):
        held = [raw[a : b + LENGTH] for a, b in zip(at[first].tolist(), at[last].tolist())]
        least[told[:-1]] = np.concatenate(_least_of_equal(held, least[first]))
    return np.split(least, starts[:-1])


def _least_of_equal(strings: list[bytes], low: np.ndarray) -> list[np.ndarray]:
    """least_documents() of all starts, by the order of the collection."""
    string, start, prefix = collection_order(strings)
    size = np.fromiter(map(len, strings), "i8", len(strings))
    # what stands between two equal strings in the order begins with them too
    whole = np.flatnonzero(start + LENGTH <= size[string])
    group = np.cumsum(prefix < LENGTH)[whole]
    string, start = string[whole], start[whole]
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(low[string], edge), np.diff(np.append(edge, len(string))))
    order = np.lexsort((start, string))
    return np.split(least[order], np.cumsum(size - LENGTH + 1)[:-1])


def refined(strings: list[bytes], low: np.ndarray, high: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """For each start in each run the smallest document among all runs of its group that hold the same LENGTH bytes.

    Runs are cut again by another smallest hash, which sets most strings apart that only one document has. Of the parts
    that are left, unlike ones enter collections; a collection ends with a group.
    """
    raw = b"".join(strings)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, strings), "i8", len(strings)))])
    first, many, key = runs(np.frombuffer(raw, "u1"), bounds, _OTHER)
    run = np.searchsorted(bounds, first, side="right") - 1
    of = run_hashes([raw[a:b] for a, b in zip(first.tolist(), (first + many + LENGTH - 1).tolist())])
    order = np.lexsort((low[run], of, key, group[run]))
    first, many, run, key, of = first[order], many[order], run[order], key[order], of[order]
    apart = np.concatenate([[True], (group[run][1:] != group[run][:-1]) | (key[1:] != key[:-1])])
    part = np.flatnonzero(apart | np.concatenate([[True], of[1:] != of[:-1]]))
    size = np.diff(np.append(part, len(run)))
    head = np.flatnonzero(apart[part])
    inside = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(part))))
    low_of, high_of = low[run[part]], np.maximum.reduceat(high[run], part)
    unlike = np.flatnonzero((np.bincount(inside)[inside] > 1) & (np.maximum.reduceat(high_of, head) > np.minimum.reduceat(low_of, head))[inside])
    least = np.empty(len(raw), "i8")
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    least[at] = np.repeat(np.repeat(low_of, size), many)
    start = 0
    while start < len(unlike):
        stop = min(start + COLLECTION, len(unlike))
        stop = int(np.searchsorted(inside[unlike], inside[unlike[stop - 1]], side="right"))
        some = unlike[start:stop]
        held = [raw[first[p] : first[p] + many[p] + LENGTH - 1] for p in part[some].tolist()]
        for p, m, found in zip(part[some].tolist(), size[some].tolist(), least_documents(held, low_of[some])):
            for k in range(p, p + m):
                least[first[k] : first[k] + many[k]] = found
        start = stop
    return [least[a : b - LENGTH + 1] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def answers(rows: DataFrame, n_places: int) -> DataFrame:
    """Rows (chunk, place, blob): for runs that a smaller document may have, the hash of their bytes and the smallest document, once or for each start."""

    def solved(place: int, blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        boxes = [_unboxed(b) for b in blobs]
        count = [len(x[1]) for x in boxes]
        chunk = np.repeat(np.array([x[0] for x in boxes]), count)
        h, low, high, single, sizes, data = (np.concatenate([x[i] for x in boxes]) for i in range(1, 7))
        ends = np.cumsum(sizes, dtype="i8")
        raw = data.tobytes()
        bytes_of = lambda rows: [raw[a:b] for a, b in zip((ends[rows] - sizes[rows]).tolist(), ends[rows].tolist())]
        of = np.empty(len(h), "u8")
        of[sizes == 0], whole = single, np.flatnonzero(sizes)
        of[whole] = run_hashes(bytes_of(whole))
        order = np.lexsort((low, of, h))
        chunk, h, low, high, of = chunk[order], h[order], low[order], high[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
        same = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))  # the run that a row holds
        head = np.flatnonzero(np.concatenate([[True], h[first][1:] != h[first][:-1]]))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(first))))
        low_of, high_of = low[first], np.maximum.reduceat(high, first)
        lowest = np.minimum.reduceat(low_of, head)[group]
        least = low_of.copy()  # right where all equal starts are in equal runs
        parts: dict[int, np.ndarray] = {}
        # a group of one document has nothing to take from a smaller one, and one of equal runs has its answer; single strings hold no others
        some = np.flatnonzero((sizes[order[first]] > 0) & (np.bincount(group)[group] > 1) & (np.maximum.reduceat(high_of, head)[group] > lowest))
        if len(some):
            for r, m in zip(some.tolist(), refined(bytes_of(order[first[some]]), low_of[some], high_of[some], group[some])):
                least[r] = m[0]
                if (m != m[0]).any():
                    least[r] = m.min()
                    parts[r] = m
        odd_run = np.zeros(len(first), bool)
        odd_run[list(parts)] = True
        tell = np.flatnonzero(least[same] < high)
        tell = tell[np.argsort(chunk[tell], kind="stable")]
        for rows in np.split(tell, np.flatnonzero(np.diff(chunk[tell])) + 1):
            if len(rows):
                odd = odd_run[same[rows]]
                plain, split = rows[~odd], rows[odd]
                told = [np.array([len(plain), len(split)]), of[plain].view("i8"), least[same[plain]]]
                for r in split.tolist():
                    m = parts[int(same[r])]
                    told += [of[r : r + 1].view("i8"), np.array([len(m)]), m]
                yield int(chunk[rows[0]]), np.concatenate(told).astype("<i8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, blobs in _by_place(batches, "blob"):
            out = list(solved(place, [b for b, in blobs]))
            yield pa.record_batch([pa.array([c for c, _ in out], pa.int64()), pa.array([place] * len(out), pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["chunk", "place", "blob"])

    return _dealt(rows, n_places).mapInArrow(run, "chunk long, place int, blob binary")


def _answered(blob: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Hashes of runs in order with their smallest documents, and the runs that have one for each start."""
    n, i, of, least, split = np.frombuffer(blob, "<i8"), 0, [np.zeros(0, "i8")], [np.zeros(0, "i8")], {}
    while i < len(n):
        plain, odd = int(n[i]), int(n[i + 1])
        of.append(n[i + 2 : i + 2 + plain])
        least.append(n[i + 2 + plain : i + 2 + 2 * plain])
        i += 2 + 2 * plain
        for _ in range(odd):
            size = int(n[i + 1])
            split[int(n[i])] = n[i + 2 : i + 2 + size]
            i += 2 + size
    every, docs = np.concatenate(of), np.concatenate(least)
    order = np.argsort(every)
    return every[order], docs[order], split


def cut(docs: DataFrame, hashes: str, strings_folder: str, answered: str) -> DataFrame:
    """Rows (doc_id, n_bytes, spans, kept)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known, known_chunk = _Wanted(hashes, strings_folder), _answered(b""), None
        for chunk, part in _chunks(batches):
            if chunk != known_chunk:
                known_chunk, known = chunk, _answered(_read(answered, chunk))
            raw, bounds = _data(part.column("text"))
            cover = np.zeros(len(raw) + 1, "i4")
            of, least, split = known
            if len(of) or split:
                first, many, _, _, hashed = wanted(chunk, raw, bounds)
                doc = np.searchsorted(bounds, first, side="right") - 1
                mine = pc.fill_null(part.column("doc_id"), -(1 << 63)).to_numpy()[doc]  # no document is smaller than that
                hashed = hashed.view("i8")
                at = np.searchsorted(of, hashed)
                hit = np.zeros(len(hashed), bool)
                if len(of):
                    at = np.minimum(at, len(of) - 1)
                    hit = (of[at] == hashed) & (least[at] < mine)
                np.add.at(cover, first[hit], 1)
                np.add.at(cover, first[hit] + many[hit] + LENGTH - 1, -1)
                for i in np.flatnonzero(np.isin(hashed, np.fromiter(split, "i8", len(split)))).tolist():
                    s = int(first[i])
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], split[int(hashed[i])] < mine[i], [False]]).astype("i1")))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        cover[s + a] += 1
                        cover[s + b + LENGTH - 1] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            spans, kept = [], []
            data = np.frombuffer(raw, "u1")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype("i1")))
                spans.append([{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())])
                kept.append(data[a:b][~g].tobytes() if len(edge) else raw[a:b])
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(bounds)), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, spans, kept): removed spans in bytes, maximal and in order, and the remaining bytes, which need not be whole UTF-8.

    Null texts count as empty; texts shorter than LENGTH lose nothing. Rows without an id lose nothing and take nothing
    from others. Rows that repeat an id take nothing from each other, as neither is smaller. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_places = 1 << max(6, (total // PLACE).bit_length(), (2 * parts(spark)).bit_length())
    texts = chunked(rows)
    hashes, strings, answered = (new_path(spark, x) for x in ("shared-hashes", "shared-strings", "answers"))
    with tidy(spark):  # no stage needs what an earlier one has shuffled
        _told(shared(listed(texts, n_places), n_places), hashes)
        _told(shared(listed_again(texts, hashes, n_places), n_places), strings)
        _told(answers(sent(texts, hashes, strings, n_places), n_places), answered)
    return cut(texts, hashes, strings, answered)
