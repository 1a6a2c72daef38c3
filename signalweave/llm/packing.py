"""Best-fit packing of tokenised documents into fixed-length sequences.

The packing is planned on the histogram of piece lengths, which has at most capacity entries however many pieces there
are. Pieces above a third of the capacity are matched greedily, at most two in a sequence; smaller ones go, largest
first, where they leave the least room. Sequences with equal contents are one entry of the plan with a count, so the
plan is the one that packing piece by piece would give. Pieces then find their place by their rank among equal lengths.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.llm.common import batch_slices, staged
from signalweave.llm.text import filled, word_hashes, words_of

CAPACITY = 2048
END = 0
#: How a tokenizer must prepare texts for its ids to be those of its chunks in a row (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks that normalisation leaves alone but for case.
_PLAIN = r"^[\x21-\x7e\x{a1}-\x{ff}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]+$"
#: Letters and then marks, without an apostrophe: one part each.
_SIMPLE = r"^(?P<w>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<p>[!-&(-/:-@\[-`{-~]*)$"
#: Chunks whose ids a worker keeps, and parts that are encoded in one call.
_CACHED, _TOGETHER = 1 << 20, 4096


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of all spans in a row."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class ChunkEncoder:
    """Token ids of space-separated chunks, with a bounded cache, where the tokenizer allows it.

    Ids of a text are those of its chunks in a row if the tokenizer drops white space and marks word ends, as no token
    crosses white space then. Whether a tokenizer is of this kind is read from its own description; with any other one
    chunked is false and whole texts must be encoded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        first = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        splits = {"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True}
        self.chunked = told["normalizer"] == NORMALIZER and first == splits and told["model"].get("end_of_word_suffix") == "</w>" and not told["post_processor"]
        self.special = [t["content"] for t in told["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.names, self.hash, self.by = pa.array([], pa.string()), np.zeros(0, "u8"), np.zeros(0, "i8")
        self.first, self.size, self.table = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "<u4")

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts and how many each has."""
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.fromiter(map(len, ids), "i8", len(ids))

    def _units(self, units: pa.Array, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain pieces of known numbers of parts, many in one call: each part ends with its only token that marks a word end."""
        tables, sizes = [np.zeros(0, "<u4")], [np.zeros(0, "i8")]
        for i in range(0, len(units), _TOGETHER):
            some = units.slice(i, _TOGETHER)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(parts[i : i + len(some)])
            if len(stops) == last[-1] and stops[-1] == len(ids):
                size = np.diff(stops[last - 1], prepend=0)
            else:
                ids, size = self.whole(some.to_pylist())
            tables.append(ids)
            sizes.append(size)
        return np.concatenate(tables), np.concatenate(sizes)

    def _learn(self, chunks: pa.Array, hashes: np.ndarray) -> None:
        plain = pc.match_substring_regex(chunks, _PLAIN)
        for t in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(chunks, t)))
        plain = plain.to_numpy(zero_copy_only=False)
        cut = pc.extract_regex(chunks, _SIMPLE)
        simple = np.flatnonzero(pc.is_valid(cut).to_numpy(zero_copy_only=False) & plain)
        rest, odd = np.setdiff1d(np.flatnonzero(plain), simple, assume_unique=True), np.flatnonzero(~plain)
        cut = cut.take(pa.array(simple))
        word, marks = pc.utf8_lower(cut.field(0)).dictionary_encode(), cut.field(1).dictionary_encode()
        n_words, n_marks, others = len(word.dictionary), len(marks.dictionary), chunks.take(pa.array(rest))
        units = pa.concat_arrays([word.dictionary, marks.dictionary, others])
        parts = np.concatenate([np.ones(n_words, "i8"), pc.binary_length(marks.dictionary).to_numpy(zero_copy_only=False) > 0, pc.count_substring_regex(pc.utf8_lower(others), PARTS).to_numpy(zero_copy_only=False)]).astype("i8")
        real = parts > 0
        size = np.zeros(len(parts), "i8")
        table, size[real] = self._units(units.filter(pa.array(real)), parts[real])
        more, odd_size = self.whole(chunks.take(pa.array(odd)).to_pylist())
        table, size = np.concatenate([table, more]), np.concatenate([size, odd_size])
        first = np.cumsum(size) - size
        # two spans for each chunk, in the order simple, rest, odd: its word or all of it, and its marks
        a = np.concatenate([word.indices.to_numpy(zero_copy_only=False), n_words + n_marks + np.arange(len(rest) + len(odd))]).astype("i8")
        b = n_words + marks.indices.to_numpy(zero_copy_only=False).astype("i8")
        spans = np.stack([first[a], np.concatenate([first[b], np.zeros(len(a) - len(b), "i8")])], axis=1).ravel()
        lengths = np.stack([size[a], np.concatenate([size[b], np.zeros(len(a) - len(b), "i8")])], axis=1)
        order = np.concatenate([simple, rest, odd])
        self.names = pa.concat_arrays([self.names, chunks.take(pa.array(order))])
        self.first = np.concatenate([self.first, len(self.table) + np.cumsum(lengths.sum(axis=1)) - lengths.sum(axis=1)])
        self.size = np.concatenate([self.size, lengths.sum(axis=1)])
        self.table = np.concatenate([self.table, table[_spans(spans, lengths.ravel())]])
        every = np.concatenate([self.hash, hashes[order]])
        by = np.argsort(every, kind="stable")
        self.hash, self.by = every[by], np.concatenate([self.by, len(self.by) + np.arange(len(order))])[by]

    def _find(self, chunks: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks are kept, and which of them are."""
        if not len(self.hash):
            return np.zeros(len(chunks), "i8"), np.zeros(len(chunks), bool)
        order, at = np.argsort(hashes), np.empty(len(hashes), "i8")
        at[order] = np.minimum(np.searchsorted(self.hash, hashes[order]), len(self.hash) - 1)  # in order, so that it stays in the cache
        hit = self.hash[at] == hashes
        same = pc.equal(self.names.take(pa.array(self.by[at])), chunks).to_numpy(zero_copy_only=False)
        return self.by[at], hit & same

    def encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For different chunks a table of ids, and the first place and the number of each one's ids in it."""
        if len(self.names) > _CACHED:
            self._forget()
        hashes = word_hashes(chunks)
        at, hit = self._find(chunks, hashes)
        new = np.flatnonzero(~hit)
        if len(new):
            known = len(self.names)
            self._learn(chunks.take(pa.array(new)), hashes[new])
            at, hit = self._find(chunks, hashes)
            odd = np.flatnonzero(~hit)  # chunks that share a hash: looked up by name among those just learned
            if len(odd):
                at[odd] = known + pc.index_in(chunks.take(pa.array(odd)), value_set=self.names.slice(known)).to_numpy(zero_copy_only=False)
        return self.table, self.first[at], self.size[at]


_encoders: dict[str, ChunkEncoder] = {}


def token_arrays(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids in one array, each row closed by END, and the rows' bounds in it."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    encoder = _encoders[path]
    if encoder.chunked:
        flat, bounds = words_of(text, lower=False)
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        table, first, size = encoder.encode(coded.dictionary)
        first, length = first[code], size[code]
    else:
        table, length = encoder.whole(filled(text).to_pylist())
        first, bounds = np.cumsum(length) - length, np.arange(len(length) + 1)
    ends = np.concatenate([[0], np.cumsum(length)])
    doc_ends = ends[bounds[1:]] + np.arange(1, len(bounds))
    out = np.full(int(doc_ends[-1]) if len(doc_ends) else 0, END, "<u4")
    if len(length):
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        out[_spans(ends[:-1] + row, length)] = table[_spans(first, length)]
    return out, np.concatenate([[0], doc_ends]).astype("i8")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """A written table of pieces: doc_id, piece, start, length, ids_crc32, the task that made it and its rank there among pieces of its length; with keep_ids also the ids.

    A document longer than capacity is cut into pieces of capacity tokens, the last one may be shorter; all others are
    one piece. Null texts count as empty and are the one token END. The tokenizer file must be on every machine.
    """
    from tokenizers import __version__  # noqa: F401  fails early where it is not installed

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        for batch in batches:
            for part in batch_slices(batch, "text", 2 << 20):
                ids, bounds = token_arrays(part.column("text"), tokenizer)
                n = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(np.diff(bounds)[doc] - start, capacity)
                at = bounds[doc] + start
                crc = [zlib.crc32(ids[a : a + m].data) for a, m in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                by = length[order]
                fresh = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, "i8")
                rank = np.empty(len(by), "i8")
                rank[order] = seen[by] + np.arange(len(by)) - np.repeat(fresh, np.diff(np.concatenate([fresh, [len(by)]])))
                seen += np.bincount(length, minlength=capacity + 1)
                cols = {"doc_id": part.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece.astype("i4")), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array(np.full(len(doc), task, "i4")), "rank": pa.array(rank)}
                if keep_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype("i4")), pa.array(ids.astype("i4")))
                yield pa.record_batch(cols)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return staged(rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * keep_ids), "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset) that place counts[length] pieces of each length.

    Works on kinds of sequences: (room left, how many, contents). Equal pieces and sequences are handled at once, so
    work and result depend on the capacity and the lengths that occur, not on how many pieces there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    kinds: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by room: how many, lengths inside
    rooms: list[int] = []

    def add(room: int, many: int, inside: tuple) -> None:
        if many > 0:
            if not kinds[room]:
                insort(rooms, room)
            kinds[room].append((many, inside))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left.get(n, 0) > 0:
            i = bisect_left(large, min(n, capacity - n) + 1) - 1
            while i >= 0 and not left.get(large[i], 0) > (large[i] == n):
                i -= 1
            if i < 0:
                add(capacity - n, left[n], (n,))
                left[n] = 0
            else:
                m = large[i]
                many = left[n] // 2 if m == n else min(left[n], left[m])
                left[n] -= many
                left[m] -= many
                add(capacity - n - m, many, (n, m))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        while c > 0:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                room, many, inside = capacity, -(-c // (capacity // n)), ()
            else:
                room = rooms[i]
                many, inside = kinds[room].pop()
                if not kinds[room]:
                    rooms.pop(i)
            each = room // n
            full = min(many, c // each)
            add(room - each * n, full, inside + (n,) * each)
            c -= full * each
            if full < many:
                some = min(c, each)  # fewer than fit in one more sequence
                add(room - some * n, 1, inside + (n,) * some)
                add(room, many - full - 1, inside)
                c -= some
    out, used, sequence = [], defaultdict(int), 0
    for room in sorted(kinds):
        for many, inside in kinds[room]:
            offset = 0
            for n in inside:
                out.append((n, used[n], many, sequence, offset))
                used[n] += many
                offset += n
            sequence += many
    return out



def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: the sequence that a piece is in and its place there. Sequences have no gaps.

    Each row of docs is a document of its own, repeated ones and ones without an id too; other columns are ignored. An
    empty table gives no rows.
    """
    table = pieces(docs, tokenizer, capacity, id_col, text, keep_ids)
    counts = table.groupBy("task", "length").agg(F.count("*").alias("n"))
    slots = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    slots.sort()
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.join(bases, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("rank") + F.col("base")).drop("t", "l", "base", "task")
    fixed = docs.sparkSession.sparkContext.broadcast(np.array(slots or np.zeros((0, 5)), "i8"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = fixed.value
        keys = (s[:, 0] << 48) | s[:, 1]
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            cols = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            yield pa.record_batch(cols | {"sequence_id": pa.array(s[at, 3] + rank - s[at, 1]), "offset": pa.array(s[at, 4])})

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")
