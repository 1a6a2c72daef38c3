"""Fill-in-the-middle: texts cut at token bounds, the middle moved to the end behind sentinels.

One fullmatch of (unit)* by the regex library keeps every repetition of its group, so match.ends(1) has all token bounds:
its length is the number of tokens, and two look-ups in it are the cuts. What a match keeps grows with the number of
tokens, so texts of more than PIECE code points are matched in pieces that end where a token ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweave.llm.common import batch_slices, quoted
from signalweave.llm.text import filled

#: Code points of a text that one match takes, about.
PIECE = 1 << 20
#: Space, prefix, suffix and middle marks of the output.
SPACE, PREFIX, SUFFIX, MIDDLE = r"\x20\x09-\x0D", "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: No unit can match another way than its first one, so nothing needs to be tried again: all repeats are possessive.
UNITS = regex.compile(rf"([{SPACE}]*+[^{SPACE}]++|[{SPACE}]++)*+")
_END = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
FIM = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str) -> np.ndarray:
    """Where each token of a text ends."""
    ends, start = [np.zeros(0, "i8")], 0
    while start < len(text):
        cut = _END.search(text, start + PIECE) if len(text) - start > PIECE else None
        stop = cut.start() if cut else len(text)
        ends.append(np.array(UNITS.fullmatch(text, start, stop).ends(1), "i8"))
        start = stop
    return np.concatenate(ends)


def transformed(doc: int | None, text: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, lengths of prefix and middle, and the output of one document."""
    ends = unit_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[c - 1]) if c else 0 for c in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs, by a narrow job.

    n: tokens of the whole text. rate percent of the documents are transformed, spm percent of those in suffix-first form
    (spm), the others in prefix-first form (psm); which ones, and where they are cut, hangs on seed and id only. The rest
    is plain and its lengths are null: so are empty texts and those that hold a mark already. prefix_chars and
    middle_chars count code points. A null text counts as empty, a null id as an empty id; repeated rows give equal rows.
    Ids are cast to long. Other columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text"):
                ids = part.column("doc_id")
                found = [transformed(doc, t, seed, rate, spm) for doc, t in zip(ids.to_pylist(), filled(part.column("text")).to_pylist())]
                cols = [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.record_batch([ids, *cols], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, FIM)


def restored(output: Column, form: Column) -> Column:
    """The text that an output came from. A transformed output holds three marks and no other one: none can arise where parts meet."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
