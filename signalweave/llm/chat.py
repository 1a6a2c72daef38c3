"""Chat formatting by columnar byte assembly, with a loss mask and a way back.

A turn becomes <s>[INST] role\\ntext [/INST]</s>. Control strings inside roles and texts get one backslash after their
first character, and a run that already has backslashes there gets one more; taking one away again restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.common import batch_slices, parts
from signalweave.llm.text import filled

HEAD, FOOT = b"<s>[INST] ", b" [/INST]</s>"
ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\])", r"\1\\\2\3"
UNESCAPE = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
TURN = re.compile(re.escape(HEAD.decode()) + r"([^\n]*)\n(.*?)" + re.escape(FOOT.decode()), re.DOTALL)
FORMATTED = "conv_id long, piece int, last boolean, formatted string, loss array<struct<start:int,end:int>>"
#: A conversation's formatted text is cut between turns into pieces of about this many bytes.
PIECE = 4 << 20


def escaped(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, ESCAPE[0], ESCAPE[1])


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def escaped_role(role: pa.Array) -> pa.Array:
    """The role ends at the first line feed, so it holds none itself."""
    return escaped(pc.replace_substring(pc.replace_substring(role, "\\", "\\\\"), "\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\\" if m[1] == "\\" else "\n", unescaped(role))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its rows' bounds in them."""
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], "i8", len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(0, "u1"), bounds


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies data[start : start + length] to out[to : to + length] for all segments at once."""
    total = int(length.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + within] = data[np.repeat(start, length) + within]


def assembled(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns in order; each turn's bounds in it (one more than turns), and where its text starts and ends."""
    roles, r = _bytes(escaped_role(filled(role)))
    texts, t = _bytes(escaped(filled(text)))
    n = len(r) - 1
    pieces = [(np.frombuffer(HEAD, "u1"), np.zeros(n, "i8"), np.full(n, len(HEAD))), (roles, r[:-1], np.diff(r)), (np.frombuffer(b"\n", "u1"), np.zeros(n, "i8"), np.ones(n, "i8")), (texts, t[:-1], np.diff(t)), (np.frombuffer(FOOT, "u1"), np.zeros(n, "i8"), np.full(n, len(FOOT)))]
    lengths = np.stack([x[2] for x in pieces], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape) if n else np.zeros((0, len(pieces)), "i8")
    out = np.empty(int(ends[-1, -1]) if n else 0, "u1")
    for i, (data, start, length) in enumerate(pieces):
        _scatter(out, ends[:, i] - length, data, start, length)
    return out, np.concatenate([[0], ends[:, -1] if n else []]).astype("i8"), ends[:, 3] - lengths[:, 3] if n else np.zeros(0, "i8"), ends[:, 3] if n else np.zeros(0, "i8")


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """Rows (conv_id, piece, last, formatted, loss): the formatted conversation, cut between turns into pieces of about PIECE bytes, and the byte spans of the learned texts in each piece (escaped).

    Turns stand by turn number, nulls first, equal ones by role and text; repeated rows are turns of their own. Null
    roles and texts count as empty; a null conv_id is a conversation of its own. Other columns are ignored. Turns of a
    conversation are sorted by Spark and stream through one task, so a hot conversation costs time there, not memory.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition(parts(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the current piece's conversation, number, bytes and spans
        done: list[tuple] = []

        def close(last: bool) -> None:
            conv_id, piece, chunks, spans = held
            done.append((conv_id, piece, last, b"".join(chunks), spans))

        def flushed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int32()), pa.array([x[2] for x in done], pa.bool_()), pa.array([x[3] for x in done], pa.binary()).cast(pa.string()), pa.array([[{"start": a, "end": b} for a, b in x[4]] for x in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["conv_id", "piece", "last", "formatted", "loss"])
            done.clear()
            return out

        for batch in batches:
            for part in batch_slices(batch, "text"):
                buffer, bounds, text_from, text_to = assembled(part.column("role"), part.column("text"))
                ids = part.column("conv_id").to_pylist()
                learned = pc.equal(part.column("role"), learn).to_pylist()
                at = 0
                while at < len(ids):  # one run of turns of a conversation, as one slice of the buffer
                    if held and held[0] != ids[at]:
                        close(True)
                        held = []
                    elif held and sum(map(len, held[2])) >= PIECE:
                        close(False)
                        held = [ids[at], held[1] + 1, [], []]
                    held = held or [ids[at], 0, [], []]
                    to = at + 1
                    while to < len(ids) and ids[to] == ids[at] and bounds[to] - bounds[at] < PIECE:
                        to += 1
                    shift = sum(map(len, held[2])) - int(bounds[at])
                    held[3] += [(int(text_from[i]) + shift, int(text_to[i]) + shift) for i in range(at, to) if learned[i]]
                    held[2].append(buffer[bounds[at] : bounds[to]].tobytes())
                    at = to
                if sum(len(x[3]) for x in done) >= PIECE:
                    yield flushed()
        if held:
            close(True)
        if done:
            yield flushed()

    return rows.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted pieces hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Takes format_turns()' rows as they come, a conversation's pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for batch in batches:
            out = []
            for conv_id, piece, last, text, loss in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if piece == 0:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in TURN.finditer(text):
                    state[0] += 1
                    state[1].update(f"{unescaped_role(m[1])}\n{unescaped(m[2])}\n".encode())
                raw = text.encode()
                for span in loss:
                    plain = unescaped(raw[span["start"] : span["end"]].decode())
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(text)
                if last:
                    out.append((conv_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            cols = list(zip(*out)) or [()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
