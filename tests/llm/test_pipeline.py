import collections
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.llm import edits, mixing

SPLIT = re.compile("[\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Names that the operators use for columns of their own.
CLASHING = ("n_words", "failed", "q_gone", "q_lines", "row_id", "lines_removed", "copies", "size", "row", "of", "component_id")


def words(t):
    return [w for w in SPLIT.split(t or "") if w]


def rules(t):
    """Whether a document passes policy v1, measured as the contract of the quality rules says."""
    w = words(t)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or "")
    lines = [x for x in (t or "").split("\n") if words(x)]
    repeated = len(lines) - len(set(lines))
    bad = len(w) < 20 or 100 * len(covered) > 30 * len(w) or not 2 * len(w) <= chars <= 20 * len(w)
    return not (bad or 10 * symbols > 3 * len(w) or repeated >= 4 and 100 * repeated > 50 * len(lines))


def groups(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def place(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def plain_lines(rows):
    norm = {(k, i): " ".join(words(x.translate(LOWER))) for k, r in enumerate(rows) for i, x in enumerate((r["text"] or "").split("\n"))}
    at = sorted((p for p in norm if norm[p]), key=lambda p: (place(rows[p[0]]), p))

    def linked(i, j):
        a, b = norm[at[i]], norm[at[j]]
        most = max(len(a), len(b)) // 10
        return a == b or min(a.count(" "), b.count(" ")) >= 4 and abs(len(a) - len(b)) <= most and edits.edits(a, b, most) <= most

    gone = {at[i] for i, root in enumerate(groups(len(at), linked)) if root != i}
    out = []
    for k, r in enumerate(rows):
        kept = [x for i, x in enumerate((r["text"] or "").split("\n")) if (k, i) not in gone]
        text = "\n".join(kept)
        if not any(p[0] == k for p in gone):
            out.append(r)
        elif 100 * len(words(text)) > (100 - corpus_pipeline.COPIED) * len(words(r["text"])):
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


def plain_near(rows):
    sets = []
    for r in rows:
        w = words((r["text"] or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    order = sorted(range(len(rows)), key=lambda k: place(rows[k]))
    root = groups(len(rows), lambda i, j: bool(sets[order[i]]) and 100 * len(sets[order[i]] & sets[order[j]]) >= 80 * len(sets[order[i]] | sets[order[j]]))
    return [rows[order[i]] for i in range(len(rows)) if root[i] == i]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(8)) for _ in range(n))
    # lines that change in two words are no longer alike, five-word shingles of long texts still are
    base = [text(r.randint(6, 12)) for _ in range(16)]
    long = " ".join(word() for _ in range(900))
    spread = long.split(" ")
    for i in range(0, 900, 90):
        spread[i] = "x"
    near = "\n".join(" ".join(["changed" + word() * 3, *spread[i : i + 60]]) for i in range(0, 900, 60))
    texts = [*base, base[3], base[5].replace("\n", "\n\n", 2) + "\nmore than that", "short", None, "", "spam eggs " * 60, "  \n\t ", long, near, base[7].upper(), "\n".join([*base[8].split("\n")[:4], "one more line of its own here"]), " ".join(["huge", *(word() for _ in range(60_000))])]
    ids = list(range(len(texts)))
    ids[4], ids[9], ids[10], ids[11] = 2, 2, None, None
    return [{"doc_id": i, "text": t, "lang": "en", "source": r.choice(["s0", "s1", None]), "n_chars": len(t or ""), **{c: 7 for c in CLASHING}} for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    kinds = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} int" for c in CLASHING)
    spark.createDataFrame([tuple(r.values()) for r in rows], kinds).coalesce(1).write.parquet(str(at / "documents.parquet"))
    return str(at)


def counted(rows):
    return collections.Counter((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in rows)


def test_stages_give_what_plain_python_gives(spark, rows, table, tmp_path):
    at, want = spark.read.parquet(f"{table}/documents.parquet"), rows
    names = at.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:3], (lambda x: [r for r in x if rules(r["text"])], plain_lines, plain_near)):
        at, want = stage(spark, at, table), plain(want)
        assert at.columns == names
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        got = at.collect()
        assert counted(r.asDict() for r in got) == counted(want), name
        assert all(r[c] == 7 for r in got for c in CLASHING)
    assert 5 < len(want) < len(rows) - 6
    held = at.withColumn("n", F.monotonically_increasing_id())
    mixed = {r.n: r.copies if r["size"] else 1 for r in mixing.mix(held, keep=("n",)).collect()}
    want = [r.asDict() for r in held.collect() for _ in range(mixed[r.n])]
    at = corpus_pipeline.STAGES[3][1](spark, at, table)
    assert at.columns == names and counted(r.asDict() for r in at.collect()) == counted(want)
    import public_tokenizers
    from tokenizers import Tokenizer

    pieces = collections.Counter()
    for r, e in zip(want, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([r["text"] or "" for r in want], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        pieces += collections.Counter((r["doc_id"], p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].data)) for p in range(0, len(ids), 2048))
    whole = corpus_pipeline.run(spark, table).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == pieces
    spans = collections.defaultdict(list)
    for r in whole:
        spans[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(s)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:])) and sum(n for _, n in s) <= 2048 for s in spans.values())


def test_empty_tables_and_few_columns(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), table).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b c d e", "x")], "doc_id long, text string, source string")
    assert corpus_pipeline.fuzzy_line_dedup(spark, df, "").select(F.count("*")).first()[0] == 1
    odd = spark.createDataFrame([(None, None, None, 1), (None, None, None, 1), (1, "", "s", 2)], "doc_id long, text string, source string, `a.b` int")
    for stage in (corpus_pipeline.fuzzy_line_dedup, corpus_pipeline.near_duplicates, corpus_pipeline.source_mix):
        assert sorted(map(str, stage(spark, odd, "").collect())) == sorted(map(str, odd.collect()))
