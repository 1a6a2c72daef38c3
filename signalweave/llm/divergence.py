"""Source divergence audit: how far the word use of each source of a language is from the others, and in which terms.

Terms are counted in the tasks that read the texts: bytes of a slice of texts are cut into terms by a table, terms of up
to 8 bytes become one 64-bit word, those of up to 16 bytes two, and each kind is sorted by radix passes over 16-bit
digits and counted in runs. Longer terms stand in buckets of their length and are sorted by bytes there. Only sums by
(language, source, term) leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.llm.common import batch_slices, quoted, staged
from signalweave.llm.text import filled

#: Sources of a language that are compared in one block, rows of a bucket of terms, terms of one matrix.
BLOCK, BUCKET_ROWS, CHUNK = 256, 100_000, 512
#: What a term is made of: letters A-Z, a-z and all bytes of characters beyond ASCII; and their lower case, A-Z only.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[0x41:0x5B] += 0x20


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """A stable order by columns of unsigned integers, the last one first in rank: passes over 16-bit digits, lowest first."""
    order = np.arange(len(digits[0]))
    for column in digits:
        for shift in range(0, 8 * column.itemsize, 16):
            digit = (column >> np.asarray(shift, column.dtype)).astype("u2")
            if len(digit) and (digit[0] != digit).any():
                order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16 bits
    return order


def terms_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered bytes of all texts, and start, length and row of each term in them."""
    text = filled(text)
    offsets = np.frombuffer(text.buffers()[1], "i4", len(text) + 1, text.offset * 4).astype("i8")
    data = _LOWER[np.frombuffer(text.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]]
    edge = offsets - offsets[0]
    inside = np.concatenate([[False], _IN_TERM[data], [False]])
    # where a text starts a term starts anew
    cut = np.zeros(len(data) + 1, bool)
    cut[edge] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return data, start, stop - start, np.searchsorted(edge, start, side="right") - 1


def packed(data: np.ndarray, start: np.ndarray, length: np.ndarray, first: int) -> np.ndarray:
    """Bytes first to first + 7 of each term as one 64-bit word, zero where a term has ended, so that words sort as bytes do."""
    word = np.zeros(len(start), "u8")
    for j in range(first, first + 8):
        byte = data[np.minimum(start + j, len(data) - 1)].astype("u8")
        word |= np.where(j < length, byte, 0).astype("u8") << np.uint64(8 * (first + 7 - j))
    return word


def _runs(keys: list[np.ndarray], row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each run starts, how long it is, and how many rows it has."""
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    at = np.flatnonzero(new)
    fresh = new | np.concatenate([[True], row[1:] != row[:-1]])
    return at, np.diff([*at, len(row)]), np.add.reduceat(fresh.astype("i8"), at)


def counted(text: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Group, term, occurrences and number of rows for each term of each group of rows; in up to three parts, and one for each length over 16 bytes."""
    data, start, length, row = terms_of(text)
    of = group[row].astype("u4")
    for low, high in ((1, 8), (9, 16)):
        some = np.flatnonzero((length >= low) & (length <= high))
        if not len(some):
            continue
        words = [packed(data, start[some], length[some], 8 * i) for i in range(high // 8)]
        order = radix_order([*reversed(words), of[some]])
        keys = [of[some][order], *[w[order] for w in words]]
        at, n, rows = _runs(keys, row[some][order])
        raw = np.stack([k[at] for k in keys[1:]], axis=1).astype(">u8").tobytes()
        yield keys[0][at], pa.array(np.frombuffer(raw, f"S{high}").tolist(), pa.binary()), n, rows
    for size in np.unique(length[length > 16]).tolist():
        some = np.flatnonzero(length == size)
        # a row at a time where terms are long: their bytes are copied as they are
        terms = np.frombuffer(b"".join(data[s : s + size].tobytes() for s in start[some].tolist()), f"S{size}") if size > 64 else np.ascontiguousarray(data[start[some][:, None] + np.arange(size)]).view(f"S{size}")[:, 0]
        order = np.argsort(terms, kind="stable")
        order = order[np.argsort(of[some][order], kind="stable")]
        keys = [of[some][order], terms[order]]
        at, n, rows = _runs(keys, row[some][order])
        yield keys[0][at], pa.array(keys[1][at].tolist(), pa.binary()), n, rows


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences of a term in a source of a language, and its documents with the term. Each source has a row with a null term too."""
    rows = docs.select(F.coalesce(quoted(text), F.lit("")).alias("text"), F.coalesce(quoted(lang), F.lit("")).alias("lang"), F.coalesce(quoted(source), F.lit("")).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text"):
                langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                codes = langs.indices.to_numpy().astype("i8") * len(sources.dictionary) + sources.indices.to_numpy()
                there, group = np.unique(codes, return_inverse=True)
                names = [langs.dictionary.take(pa.array(there // len(sources.dictionary))), sources.dictionary.take(pa.array(there % len(sources.dictionary)))]
                zero = pa.array(np.zeros(len(there), "i8"))
                yield pa.record_batch([*names, pa.nulls(len(there), pa.string()), zero, zero], names=["lang", "source", "term", "n", "docs"])
                for of, terms, n, rows in counted(part.column("text"), group):
                    yield pa.record_batch([*[x.take(pa.array(of)) for x in names], terms.cast(pa.string()), pa.array(n.astype("i8")), pa.array(rows.astype("i8"))], names=["lang", "source", "term", "n", "docs"])

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> str:
    """SQL for 1 + floor(10^9 * (n + 5) / (total + 5 * v)), exactly; null without kept terms."""
    return f"1 + cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(20,0)) div cast(nullif({total} + 5 * v, 0) as decimal(20,0))"


def _distances(table: pa.Table) -> pa.Table:
    """One bucket of terms and one pair of blocks of sources: for each pair of sources (a, b) the sum of |p - q| over the terms that any source of the blocks has there, and how many terms these are."""
    table = table.combine_chunks()
    sources, p = table.column("source").combine_chunks(), table.column("p").to_numpy()
    own, x, y = (table.column(c).to_numpy() for c in ("own", "x", "y"))
    mark = pc.is_null(table.column("term")).to_numpy()

    def side(block: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The block's sources in order, their share of a term that they don't have, the rows' places among them, and which rows are theirs."""
        at = np.flatnonzero(mark & (own == block))
        names = sources.take(pa.array(at))
        by = pc.sort_indices(names).to_numpy()
        names = names.take(pa.array(by))
        return names, p[at][by], pc.fill_null(pc.index_in(sources, value_set=names), -1).to_numpy(), own == block

    (a_names, a_zero, *_), (b_names, b_zero, *_) = sides = side(x[0]), side(y[0])
    terms = table.column("term").combine_chunks().filter(pa.array(~mark)).dictionary_encode()
    code = np.full(len(mark), -1, "i8")
    code[~mark] = terms.indices.to_numpy()
    n_terms = len(terms.dictionary)
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(0, n_terms + CHUNK, CHUNK))
    total = np.zeros((len(a_names), len(b_names)), "i8")
    for k, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        left, right = (np.repeat(zero[:, None], min(CHUNK, n_terms - k * CHUNK), axis=1) for _, zero, _, _ in sides)
        for m, (_, _, at, mine) in zip((left, right), sides):
            some = order[s:e][mine[order[s:e]]]
            m[at[some], code[some] - k * CHUNK] = p[some]
        for i in range(len(total)):
            total[i] += np.abs(right - left[i]).sum(axis=1)
    i, j = np.nonzero(np.ones(total.shape, bool)) if x[0] != y[0] else np.triu_indices(len(a_names), 1)
    lang = table.column("lang").combine_chunks()
    return pa.table({"lang": lang.take(pa.array(np.zeros(len(i), "i8"))), "a": a_names.take(pa.array(i)), "b": b_names.take(pa.array(j)), "f": pa.array(total[i, j]), "seen": pa.array(np.full(len(i), n_terms, "i8")), "gap": pa.array(np.abs(a_zero[i] - b_zero[j]))})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 30, top: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    A language keeps the V terms that at least `least` of its documents have. A source gives each kept term the share
    p = 1 + floor(10^9 (n + 5) / (N + 5 V)), N being the sum of its n; a language does likewise. Part pair: each other
    source of the language, with the sum of the differences of shares over all kept terms; part term: the terms of the
    source whose share is above the language's, with the difference, to rank `top`. Ranks go by falling value, then by
    item in UTF-8 order.

    Null texts, languages and sources count as empty; repeated rows count each; a source without terms is compared too;
    other columns are ignored; an empty table gives no rows. Sources are compared in blocks of about BLOCK and in buckets
    of terms, so no task holds all sources or terms of a language; sums are exact integers.
    """
    held = staged(term_counts(docs, text, lang, source), "term-counts")
    kept = held.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("n_lang")).where(F.col("df") >= least).drop("df")
    counts = staged(held.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "kept-counts")
    per_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = held.where("term IS NULL").select("lang", "source").join(per_source, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("rows", F.lit(0)).alias("rows"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"), F.sum("rows").alias("rows_lang"), F.count("*").alias("sources"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    shape = [F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("rows_lang") / BUCKET_ROWS + 1).cast("int").alias("buckets")]
    langs = langs.join(v, "lang", "left").select("lang", "total_lang", F.coalesce("v", F.lit(0)).alias("v"), *shape)
    groups = staged(groups.drop("rows").join(langs, "lang"), "sources")
    by_source = counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total")))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    above = by_source.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.expr(_share("n_lang", "total_lang"))).alias("value")).where("value > 0")
    terms = ranked(above, "term").where(F.col("rank") <= top)

    own = F.expr("cast(pmod(xxhash64(source), blocks) as int)").alias("own")
    zero = F.expr(f"coalesce({_share('0', 'total')}, 0)")
    marks = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), zero.alias("p"), own, "blocks", F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"))
    real = by_source.select("lang", "source", "term", "p", own, "blocks", F.expr("cast(pmod(xxhash64(term), buckets) as int)").alias("bucket"))
    dealt = real.unionByName(marks).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("lang", "source", "term", "p", "own", "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    parts = dealt.groupBy("lang", "bucket", "x", "y").applyInArrow(_distances, "lang string, a string, b string, f long, seen long, gap long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("seen").alias("seen"), F.first("gap").alias("gap"))
    sums = sums.join(langs.select("lang", "v"), "lang").withColumn("value", F.expr("f + (v - seen) * gap"))
    pairs = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"), "value").select("lang", "e.source", "e.item", "value")
    return ranked(pairs, "pair").unionByName(terms)
