import collections
import hashlib
import os
import random
import re
import struct
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalweave.llm import ann, chat, components, edits, license_scan, line_dedup, mixing, ngram_join, packing, quality, queries, suffix_dedup, text, warc

from signalweave.tables import new_path, shared_dir

SPLIT = re.compile("[\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return [w for w in SPLIT.split((t or "").translate(LOWER)) if w]


VOCAB = "alpha Beta gamma delta epsilon Zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma été naïve".split()


def corpus(n, seed=1, lines=True):
    """Documents with exact and near copies, shared passages, repeated lines, empty, null and odd texts."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.15:
            t = r.choice(out)
        elif out and kind < 0.35:
            w = (r.choice(out) or "x y").split(" ")
            for _ in range(r.randint(1, 2)):
                w[r.randrange(len(w))] = r.choice(VOCAB) + "q"
            t = " ".join(w)
        else:
            t = " ".join(r.choice(VOCAB) + r.choice(["", "", ".", "!\n" if lines else "!"]) for _ in range(r.randint(1, 120)))
        if kind > 0.9:
            t = f"{t} shared passage that is long enough to count as more than fifty bytes of text {t[:5]}"
        out.append(t)
    return [*out, "", None, "   \n\t ", "one", "one", "\x00\x0b\x0c", "ß" * 60]


@pytest.fixture()
def docs(spark):
    rows = [(7 * i + 3, t) for i, t in enumerate(corpus(160))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "size": F.lit("clash"), "chunk": F.lit(0), "h": F.lit(0)})


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- shared


def test_words_and_hashes():
    flat, bounds = text.words_of(pa.array([" A\x0bb\x1c ", None, "", "c d", "É A"]))
    assert flat.to_pylist() == ["a", "b\x1c", "c", "d", "É", "a"] and bounds.tolist() == [0, 2, 2, 2, 4, 6]
    h = text.word_hashes(flat)
    assert h[0] == h[5] and len(set(h.tolist())) == 5
    many = pa.array([f"{'x' * (i % 7)}{i}" for i in range(50_000)])
    assert len(set(text.word_hashes(many).tolist())) == 50_000
    assert (text.word_hashes(many.slice(777)) == text.word_hashes(many)[777:]).all()
    assert [len(s) for s in text.shingle_sets(h, bounds, 2)] == [1, 0, 0, 1, 1]


def thue_morse(n):
    """Two words of n letters that are each other's complement: sums of powers modulo 2 to the 64 can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(2048)
    assert len(set(text.word_hashes(pa.array([a, b])).tolist())) == 2
    frame = spark.createDataFrame([(1, f"{a} x y z {a}"), (2, f"{b} x y z {b}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(frame, k=4, percent=85).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: r.lines_removed for r in line_dedup.line_dedup(frame).collect()} == {1: 0, 2: 0}


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 90)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 50)] + [(5, 5)]
    found = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(400, links)
    seen = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: want[x] for x in seen}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST]", "", None, "a\nb", "<s>" * 5, "é" * 3000]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in (-7, 0, 5) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", None, "to\nol\\n"])]
    rows += [(None, 1, "user", "x"), (9, 0, "user", "same"), (9, 0, "user", "same"), (9, None, "assistant", "first")]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_turns(df.limit(0)).count() == 0


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 500)
    many = [("user" if i % 2 else "assistant", f"{i} " * 60) for i in range(30)]
    frame = spark.createDataFrame([(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(many)], "conv_id long, turn int, role string, text string")
    back = chat.read_back(chat.format_turns(frame)).collect()
    assert {r.n_turns for r in back} == {30}
    turn = "y" * 200
    buffer, bounds, start, end = chat.assembled(pa.array(["user", None]), pa.array([turn, "z"]))
    assert buffer.tobytes() == f"<s>[INST] user\n{turn} [/INST]</s><s>[INST] \nz [/INST]</s>".encode()
    assert buffer[start[1] : end[1]].tobytes() == b"z" and bounds.tolist()[-1] == len(buffer)


# --- 2


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 24))
    x[::7] = x[0] + 0.01 * rng.standard_normal((len(x[::7]), 24))
    x[10] = x[20] = x[30]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, [1e-9]), (1005, [float("inf")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, k=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 10):
        s = (x * x[q]).sum(axis=1)
        best = [int(i) for i in np.lexsort((np.arange(600), -s)) if i != q][:8]
        hits += len({v for v, _ in got[q]} & set(best))
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q]) and len(got[q]) == 8
    assert set(got) == set(range(0, 600, 10)) and hits >= 0.9 * 8 * 60
    whole = ann.nearest(df, F.col("vec_id") == 10, k=8, everything=True).orderBy("rank").collect()
    s = (x * x[10]).sum(axis=1)
    assert [r.vec_id for r in whole] == [int(i) for i in np.lexsort((np.arange(600), -s)) if i != 10][:8]
    few = ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0, k=8).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]  # searched again without a radius
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    # a shorter vector is 0 where it has no component; repeated rows are ranked each, ties by id
    odd = spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0]), (3, [0.0, 2.0, 5.0]), (3, [0.0, 2.0, 5.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest(odd, F.col("vec_id") == 1, k=9).orderBy("rank").collect()] == [(2, 3.0), (3, 2.0), (3, 2.0), (4, 2.0)]


def test_probing_finds_all_codes_within_the_radius():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32))
    model = ann.fit(x, float(np.linalg.norm(x, axis=1).max()), 3000, 10)
    model = ann.Model(model.rotation, model.longest, 2, model.rotation.shape[1])
    block = ann._Block(ann._Block.built(np.arange(3000), x, model), model)
    for v, c in zip(x[:40], model.codes(x[:40], True)):
        found, probed = block.within(c)
        apart = ann._BITS[block.codes ^ c]
        assert found.tolist() == np.flatnonzero(apart.min(axis=1) <= 2).tolist() and probed < 3000
        assert set(np.flatnonzero(apart.sum(axis=1, dtype="i8") <= 3 * apart.shape[1] - 1)) <= set(found.tolist())


# --- 3


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = corpus(60) + ["Don't STOP <|endoftext|> it's 42, über-é́  x\x85y İstanbul ΣΑΣ", "word " * 5000, "a" * 3000]
    rows = [(i if i % 9 else None, x) for i, x in enumerate(texts)] + [(1, "twice"), (1, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit(0))
    got = packing.pack(df, capacity=256, keep_ids=True).collect()
    want = collections.Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 256):
            some = ids[p : p + 256]
            want[i, p // 256, p, len(some), zlib.crc32(struct.pack(f"<{len(some)}I", *some)), tuple(some)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(spans[-1]) <= 256 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert len(by) <= 1 + -(-sum(r.length for r in got) // 256) * 11 // 9
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("name, chunked", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_token_ids(name, chunked, monkeypatch):
    """Ids of odd texts, of a text of 3 MB and with a full cache, against the tokenizer over whole texts; tokenizers of another kind are not cut into chunks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "_CACHED", 200)
    path, r = public_tokenizers.path(name), random.Random(1)
    letters = "aZé'sStT3½²ªµß.,*  \n\t\u00a0 \u0301İǅ’–…\x1c\x85日😀\x00«»¿"
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(800)] + corpus(40) + ["a<|endoftext|>b c", "<|endoftext|>", "it's IT'S we'Ll 'tis", "word " * 600_000, "x" * 3000]
    for some in (texts[:300], texts[300:], texts[:10]):
        ids, bounds = packing.token_arrays(pa.array(some, pa.string()), path)
        plain = [x.ids + [0] for x in Tokenizer.from_file(path).encode_batch([t or "" for t in some], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == plain
    assert packing._encoders[path].chunked == chunked


def test_plan_places_all_pieces():
    r = random.Random(4)
    for _ in range(60):
        cap = r.choice([7, 50, 100])
        counts = {n: r.randint(0, 30) for n in range(1, cap + 1) if r.random() < 0.5}
        room, ranks = collections.Counter(), collections.defaultdict(set)
        for n, first, many, sequence, offset in packing.plan(counts, cap):
            for i in range(many):
                assert first + i not in ranks[n]
                ranks[n].add(first + i)
                assert room[sequence + i] == offset
                room[sequence + i] += n
        assert {n: len(x) for n, x in ranks.items()} == {n: c for n, c in counts.items() if c}
        assert not room or max(room.values()) <= cap


# --- 4


@pytest.mark.parametrize("few, group, block", [(2, 32 << 20, 2048), (64, 32 << 20, 2048), (2, 2000, 2048), (2, 32 << 20, 3)])
def test_join(spark, docs, monkeypatch, few, group, block):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = pairs_of(docs)
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])]
    want = roots(len(rows), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs, k=3, percent=70).collect()}
    assert got == {d: (len(s), rows[want[i]][0]) for i, ((d, _), s) in enumerate(zip(rows, sets))}
    assert len(links) > 30


def test_join_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (1, "A B C D E"), (1, "a b c d e"), (5, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("5", 0, 5), ("None", 1, None)]
    assert ngram_join.ngram_jaccard_join(df.limit(0)).count() == 0


def test_join_of_texts_that_share_an_id(spark):
    t, u = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (2, t + " more"), (2, u), (3, u), (4, "z " * 400_000 + t)], "doc_id long, text string").withColumn("c", F.lit(0))
    got = collections.Counter((r.doc_id, r.class_id, r.component_id) for r in ngram_join.ngram_jaccard_join(df).collect())
    assert got == {(1, 1, 1): 1, (2, 2, 1): 1, (2, 2, 2): 1, (3, 2, 2): 1, (4, 4, 1): 1}


def test_block_product():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 9000, n).astype("u8")) for n in (0, 1, 5000, 7000, 300)]
    assert (ngram_join.block_product(sets, sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


# --- 5


def brute_repeats(rows):
    first, out = {}, {}
    data = {d: (t or "").encode() for d, t in rows}
    for d in sorted(data):
        for i in range(len(data[d]) - 49):
            first.setdefault(data[d][i : i + 50], d)
    for d, b in data.items():
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out[d] = (len(b), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot, collection", [(32, 8192), (1, 50), (2, 8192)])
def test_repeats(spark, docs, monkeypatch, hot, collection):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    r = random.Random(9)
    extra = [(5000 + i, "".join(r.choice("ab") for _ in range(r.randint(40, 400))) + "z" * r.randint(0, 200)) for i in range(40)]
    df = docs.select("doc_id", "text", "chunk", "h").unionByName(spark.createDataFrame([(d, t, 0, 0) for d, t in extra], "doc_id long, text string, chunk int, h int")).repartition(3)
    got = {x.doc_id: (x.n_bytes, [tuple(s) for s in x.spans], bytes(x.kept)) for x in suffix_dedup.suffix_dedup(df).collect()}
    assert got == brute_repeats(pairs_of(df))
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def test_rows_without_id_lose_and_take_nothing(spark):
    t = "x" * 30 + "y" * 30
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (4, t)], "doc_id long, text string")
    assert sorted((str(r.doc_id), len(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()) == [("3", 60), ("3", 60), ("4", 0), ("None", 60)]


def test_collection_order():
    r = random.Random(2)
    for alphabet in (b"ab", bytes([0, 1, 254, 255])):
        s = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(60)]
        string, start, prefix = suffix_dedup.collection_order(s)
        order = [(s[i][j:], i) for i, j in zip(string, start)]
        assert order == sorted(order) and len(order) == sum(map(len, s)) + len(s)
        shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert prefix.tolist() == [0] + [shared(a, b) for (a, _), (b, _) in zip(order, order[1:])]


def test_collection_order_of_all_bytes():
    """Also where every byte occurs, so that codes of one byte do not do, and with copies and empty strings."""
    every = bytes(range(255))
    s = [every, bytes(range(1, 256)), b"", every, b"\xff" * 9, b""]
    string, start, prefix = suffix_dedup.collection_order(s)
    order = [(s[i][j:], i) for i, j in zip(string, start)]
    assert order == sorted(order) and len(order) == sum(map(len, s)) + len(s) and prefix.max() == 255


def test_rounds_of_a_collection_do_not_look_through_its_transform(monkeypatch):
    """Rounds look for places among strings and what is new, not in masks over all that is inserted so far."""
    looked, real = [], np.flatnonzero
    r = random.Random(3)
    s = [bytes(r.choices(b"abcd", k=60)) for _ in range(40)]
    monkeypatch.setattr(np, "flatnonzero", lambda x: looked.append(len(x)) or real(x))
    suffix_dedup.collection_order(s)
    assert max(looked) <= 2 * len(s)


def test_only_strings_that_come_again_enter_a_collection(monkeypatch):
    """Of runs that share a hash, what no other run has is not put in order."""
    entered, real = [], suffix_dedup.collection_order
    monkeypatch.setattr(suffix_dedup, "collection_order", lambda s: entered.append(list(s)) or real(s))
    r = random.Random(4)
    text = lambda n: bytes(r.choices(b"abcdefgh", k=n))
    same = text(60)
    found = suffix_dedup.least_documents([text(20) + same + text(20), text(113), same, text(80)], np.array([7, 5, 3, 1]))
    assert entered == [[same, same]]
    assert [x.tolist() for x in found] == [[7] * 20 + [3] * 11 + [7] * 20, [5] * 64, [3] * 11, [1] * 31]


def test_single_strings_are_sent_without_their_bytes():
    h, low, of = np.array([3, 9], "u8"), np.array([1, 2]), np.array([11, 12], "u8")
    chunk, *told, data = suffix_dedup._unboxed(suffix_dedup._boxed(8, h, low, low + 1, of, [b"", b"x" * 50]))
    assert chunk == 8 and [x.tolist() for x in told] == [[3, 9], [1, 2], [2, 3], [11], [0, 50]] and data.tobytes() == b"x" * 50


def test_a_very_long_text_that_repeats(spark):
    r = random.Random(1)
    t = "".join(r.choices("abcdefgh \n", k=3_000_000))
    df = spark.createDataFrame([(1, t), (2, "new" + t[1_000_000:] + "end"), (3, "a" * 5_000_000)], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, [tuple(s) for s in x.spans], bytes(x.kept)) for x in suffix_dedup.suffix_dedup(df).collect()}
    assert got[1] == (len(t), [], t.encode()) and got[2] == (2_000_006, [(3, 2_000_003)], b"newend") and got[3][1] == []


# --- 6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edits(monkeypatch):
    r = random.Random(3)
    for _ in range(1500):
        a, b = ([r.choice("abé") for _ in range(r.randint(0, 14))] for _ in range(2))
        d, most = distance(a, b), r.randint(0, 8)
        assert edits.edits(a, b) == d and edits.edits(a, b, most) == (d if d <= most else most + 1)
    a, b, most = [], [], []
    for _ in range(600):
        x = "".join(r.choices(r.choice(["ab", "abc é", "aé😀"]), k=r.choice([0, 1, 5, 20, 70])))
        y = list(x)
        for _ in range(r.randint(0, len(x) // 6 + 1)):
            i = r.randint(0, len(y))
            y[i : i + r.randint(0, 1)] = r.choice(["", "x", "ab"])
        a, b, most = [*a, x], [*b, "".join(y)], [*most, r.choice([0, 1, 3, len(x) // 10, len(x) // 4])]
    expected = [distance(x, y) <= m for x, y, m in zip(a, b, most)]
    assert 0.2 < sum(expected) / len(expected) < 0.9
    for few, cells in ((1, 1 << 20), (12, 500), (10**6, 1 << 20)):
        monkeypatch.setattr(edits, "FEWEST", few)
        monkeypatch.setattr(edits, "CELLS", cells)
        assert edits.within(a, b, np.array(most)).tolist() == expected


def similar(a, b):
    most = max(len(a), len(b)) // 10
    return abs(len(a) - len(b)) <= most and edits.edits(a, b, most) <= most


@pytest.mark.parametrize("few", [2, 16])
def test_lines(spark, docs, monkeypatch, few):
    """Against all pairs: lines of five words or more link by edits alone, all others when they are equal."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "TOGETHER", 500)
    rows, places = pairs_of(docs), collections.defaultdict(list)
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if words(line):
                places[" ".join(words(line))].append((d, i))
    norms = list(places)
    links = [(i, j) for i in range(len(norms)) for j in range(i) if min(norms[i].count(" "), norms[j].count(" ")) >= 4 and similar(norms[i], norms[j])]
    groups = collections.defaultdict(list)
    for i, root in enumerate(roots(len(norms), links)):
        groups[root] += places[norms[i]]
    gone = {x for g in groups.values() for x in g if x != min(g)}
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {d: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone), sum(p[0] == d for p in gone)) for d, t in rows}
    assert links and gone


def test_lines_of_rows_with_repeated_and_null_ids(spark):
    one, two = "a line of some words that stands twice", "another line that stands in only one place"
    df = spark.createDataFrame([(None, one, 1), (1, two + "\n" + one, 2), (1, "mine alone\n" + one, 2), (1, "mine alone\n" + one, 2), (2, "A  line of some words that stands twice\nx", 3), (None, "y\n" + one, 4), (3, None, 5), (4, "", 6)], "doc_id long, text string, lines int")
    df = df.withColumns({"q_lines": F.lit(1), "Row_ID": F.lit(2), "gone_lines": F.lit(3), "lines_removed": F.lit(4), "a.b": F.lit(5)})
    out = line_dedup.line_dedup(df, removed="went", kept="stayed")
    assert out.columns == [*df.columns, "went", "stayed"]
    rows = out.collect()
    assert sum(one in (r.text or "") for r in rows) == 1 and sum("mine alone" in (r.text or "") for r in rows) == 1 and sum(two in (r.text or "") for r in rows) == 1
    assert sorted(((str(r.doc_id), r.text, r.went, r.stayed) for r in rows if r.doc_id != 1), key=str) == [("2", "x", 1, 1), ("3", None, 0, 0), ("4", "", 0, 1), ("None", "", 1, 0), ("None", "y", 1, 1)]
    assert {(r.lines_removed, r.q_lines, r["a.b"]) for r in rows} == {(4, 1, 5)}
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_lines_leave_little_on_disk(spark, docs):
    """Once it is known which lines go, tables of other things and shuffle files are gone."""
    jvm = spark.sparkContext._jvm
    disk = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if (x := f.getName()).endswith(".data")}
    tables = lambda: set(os.listdir(shared_dir(spark).split(":", 1)[-1]))
    files, before = shuffled(), tables()
    line_dedup.line_dedup(docs)
    for _ in range(50):
        if shuffled() <= files:
            break
        time.sleep(0.2)
    assert shuffled() <= files
    assert {x.rsplit("-", 1)[0] for x in tables() - before} == {"line-docs", "line-gone"}


def test_packed_columns():
    r = np.random.default_rng(1)
    columns = [r.integers(-(2**63), 2**63 - 1, 300), np.zeros(300, "i8"), np.arange(300) << 33]
    blob = line_dedup._packed(columns)
    assert len(blob) < 300 * 12 and (line_dedup._unpacked(blob, 300, 3) == np.stack(columns)).all()
    assert line_dedup._unpacked(line_dedup._packed([np.zeros(1, "i8")]), 1, 1).tolist() == [[0]]


def test_a_very_long_text_loses_its_repeated_lines(spark):
    r = random.Random(6)
    lines = [" ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(6)) for _ in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[::2]) + "\nnew"), (3, "x" * 10_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df, percent=100).collect()}
    assert got[1].text == "\n".join(lines) and got[2].text == "new" and got[2].lines_removed == 10_000 and len(got[3].text) == 10_000_000


def edited(r, line):
    """line with up to 10% of its characters edited: words replaced, left out or put in, or single letters."""
    most, w = len(line) // 10, line.split(" ")
    for _ in range(r.randint(1, max(1, len(w) // 12))):
        i, kind = r.randrange(len(w)), r.random()
        v = w[:i] + w[i + 1 :] if kind < 0.2 else w[:i] + ["".join(r.choices("abcdefgh", k=5))] + w[i + (kind < 0.6) :] if kind < 0.7 else w[:i] + [w[i][:-1] + "z"] + w[i + 1 :]
        w = v if edits.edits(line, " ".join(v), most) <= most else w
    return " ".join(w)


@pytest.mark.parametrize("n_words", [5, 9, 15, 30, 60, 300])
def test_bands_find_lines_that_edits_would_link(n_words):
    r = random.Random(n_words)
    lines = [" ".join("".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(n_words)) for _ in range(90 if n_words < 60 else 30)]
    lines += [edited(r, x) for x in lines]
    links = {(i, j) for i in range(len(lines)) for j in range(i) if lines[i] != lines[j] and similar(lines[i], lines[j])}

    class Rows:
        def mapInArrow(self, f, schema):
            return pa.Table.from_batches(f(iter([pa.record_batch({"row": pa.array(range(len(lines))), "doc_id": pa.array(range(len(lines))), "text": pa.array(lines)})])))

    got = line_dedup.line_rows(Rows(), 1)
    bands = [{x[k : k + 5] for k in range(0, len(x), 5)} for x in got.column("bands").to_pylist()]
    sims, more = (got.column(x).to_numpy().view("u8") for x in ("sim", "more"))

    def near(i, j):
        a, b = sorted((len(lines[i]), len(lines[j])))
        apart, rest = int(sims[i] ^ sims[j]).bit_count(), int(more[i] ^ more[j]).bit_count()
        return apart + rest <= 4 * (b // 10) if b <= line_dedup.SMALL else a <= line_dedup.SMALL or apart <= line_dedup.RADIUS

    met = [(i, j) for i, j in links if bands[i] & bands[j] and near(i, j)]
    assert all(near(i, j) for i, j in links if max(len(lines[i]), len(lines[j])) <= line_dedup.SMALL)
    assert got.column("length").to_pylist() == list(map(len, lines))
    assert len(links) > 20 and len(met) >= 0.95 * len(links)


def test_few_pairs_and_long_ones_are_compared_together(monkeypatch):
    """Few pairs, and one of 7,900 characters, are told in batches of diagonals, not one by one."""
    r = random.Random(4)
    a = ["".join(r.choices("abcdé漢 ", k=n)) for n in (50, 60, 70, 80, 7900)]
    b = [x[5:20] + "x" + x[20:-7] + "yz" + x[:4] for x in a]
    most = [edits.edits(x, y) for x, y in zip(a, b)]
    monkeypatch.setattr(edits, "edits", lambda *_: pytest.fail("told singly"))
    a, b = [*a, *a], [*b, *b]
    assert edits.within(a, b, np.array([*most, *(m - 1 for m in most)])).tolist() == [True] * 5 + [False] * 5
    a, b = a[:4], b[:4]
    assert edits.within(a, b, np.array(most[:4])).all()


def test_word_hashes_are_those_of_the_library(monkeypatch):
    """Also of short words, which are hashed as numbers, and of slices; the library is asked for long words and the last bytes alone."""
    r = random.Random(5)
    words = ["".join(r.choices("ab\0é漢\U0001F600", k=r.randint(0, 6))) for _ in range(500)] + ["abcdefgh", "abcdefghi", "a\0", "a", "", "z" * 8, "end"]
    for x in (pa.array(words), pa.array(words)[7:-3], pa.array(words)[:0], pa.array([""])):
        assert text.word_hashes(x).tolist() == [text.xxhash.xxh3_64_intdigest(w.encode()) for w in x.to_pylist()]
    asked, real = [], text.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(text.xxhash, "xxh3_64_intdigest", lambda w: asked.append(w) or real(w))
    text.word_hashes(pa.array(["short", "words", "only", "and", "a-longer-one", "the-last-one"]))
    assert sorted(asked) == [b"a-longer-one", b"the-last-one"]


@pytest.mark.parametrize("few", [2, 16])
def test_op6_links_lines_by_characters(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    r = random.Random(2)
    short = "invoice number 10234 was paid in full on monday"
    long = " ".join("".join(r.choices("abcdefghijklmnopé", k=r.randint(2, 9))) for _ in range(40)).split(" ")
    other = " ".join("".join(r.choices("abcdefghijklmnopé", k=r.randint(2, 9))) for _ in range(40))
    texts = [short, short.replace("10234", "10239"), short.replace("monday", "mondax"), short.replace("paid in full", "never settled"), " ".join(long), other]
    texts += [" ".join([*long[:i], "qqqqq", *long[i + 1 :]]) for i in range(0, 40, 4)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = {x.doc_id for x in queries.QUERIES["op6_line_dedup"](spark, str(tmp_path)).where("lines_removed > 0").collect()}
    assert gone == {1, 2, *range(6, len(texts))}


def test_forests():
    r = random.Random(8)
    lines = ["".join(r.choices("abcé ", k=r.randint(0, 60))) for _ in range(12)]
    lines = list(dict.fromkeys(lines + [x[: (k := r.randint(0, len(x)))] + r.choice(["", "q", "qq"]) + x[k + r.randint(0, 3) :] for x in lines for _ in range(4)]))
    links = [(i, j) for i in range(len(lines)) for j in range(i) if 10 * distance(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))]
    n = len(lines)
    shared = [(list(range(n)), lines), (list(range(7)), lines[:7]), ([], []), ([n], ["a"]), (list(range(n))[::-1], lines[::-1]), ([3, 9, n + 1], [lines[3], lines[9], lines[9] + " "])]
    found = line_dedup.forest(shared, 90)
    links += [(n + 1, i) for i in (3, 9) if 10 * distance(lines[9] + " ", lines[i]) <= max(len(lines[9]) + 1, len(lines[i]))]
    assert roots(n + 2, found) == roots(n + 2, links) and len(found) == n + 2 - len(set(roots(n + 2, links)))




# --- 7


def test_quality_measurements(spark):
    texts = [*corpus(40), "spam eggs " * 40, "x " * 19, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 2, "##!! $$ word\nline one\nline one\n\n\nline one", "a b c d e f g h a b c d e f g h a b c d e f g h"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumns({"t": F.lit("clash"), "w": F.lit(1), "l": F.lit(2)})
    for r in quality.ledger(df).collect():
        t = texts[r.doc_id] or ""
        w = [x for x in SPLIT.split(t) if x]
        lines = [x for x in t.split("\n") if SPLIT.sub("", x)]
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered))
        assert bool(r.failed & quality.BIT["repeated_windows"]) == (100 * len(covered) > 30 * len(w))
    kept = quality.ledger(df, keep=("doc_id", "t", "w")).where(quality.passes("v1"))
    assert kept.columns[:3] == ["doc_id", "t", "w"] and quality.ledger(df.limit(0)).count() == 0


def test_ablation(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (8,), (24,)], "failed long")
    got = {r.rule: (r.rejected, r.only_by_it, r.kept_without) for r in quality.ablation(df, "v1").collect()}
    assert got["too_short"] == (2, 1, 2) and got["symbols"] == (2, 1, 2) and got["repeated_windows"] == (1, 0, 1)


# --- 8


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 80
    rows = [(1, "http://a/é?x=1%20", big), (2, None, big), (3, "u", ""), (4, "u", None), (5, "u", "small"), (6, "u", "small"), (0, "u", "other" * 40), (9, "u", big), (1, "again", big), (None, "u", "lost" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"size": F.lit("clash"), "first": F.lit(1)})
    folder = new_path(spark, "test-warc")
    got = warc.read_archives(warc.write_archives(df, folder)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("1", "response", None)] * 2 + [("2", "revisit", 1), ("9", "revisit", 1)] + [(str(i), "response", None) for i in (3, 4, 5, 6, 0, None)])
    by = {(r.page_id, r.url): r for r in got}
    assert by[1, "http://a/é?x=1%20"].payload.decode() == big and by[2, None].payload is None and by[2, None].payload_bytes == len(big.encode())
    assert by[2, None].payload_digest == hashlib.sha256(big.encode()).hexdigest() and by[4, "u"].payload_bytes == 0
    assert warc.round_trip(df.limit(0)).count() == 0


def test_damaged_archives_are_errors():
    import io

    good = warc.record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), 4, None, False)
    assert warc.parsed(good)["payload"] == b"body"
    two = warc._member(good) * 2
    assert list(warc.members(io.BytesIO(two), 7)) == [good, good]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(two[:-5]), 7))
    for bad in (good.replace(b"body", b"bodx"), good[:-1], good + b"x"):
        with pytest.raises(ValueError):
            warc.parsed(bad)


# --- 9


def test_license_scan(spark):
    """Against a plain version over word lists, on whole, cut, edited and mixed licence texts."""
    import math

    r, w = random.Random(4), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: w.findall((t or "").translate(LOWER))
    whole = {t.label: t.text for t in license_scan.TEMPLATES}
    texts = [*corpus(20), "GNU General Public-License v3, gnu general public license", "see the MIT\nLicense", "MIT", "license", whole["mit-text"].upper(), whole["mit-text"].replace("granted", "given"), "cc by cc by cc-by", "apache licenses", "x" * 100_000 + " mit license"]
    for label, t in whole.items():
        v = t.split(" ")
        cut = v[: len(v) // 2] if label != "zlib-text" else v
        edited = [x if r.random() > 0.05 else "changed" for x in v]
        texts += [t, "some words before " + " ".join(cut) + " and after", " ".join(edited), t + " prose " + whole["isc-text"], " ".join(r.sample(v, len(v)))]
    texts.append("prose " * 200_000 + whole["bsd-text"])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("clash")).coalesce(1)
    lists = [split(t) for t in texts]
    idf = lambda word: math.log((1 + len(texts)) / (1 + sum(word in x for x in map(set, lists))))
    seen, several = collections.Counter(), 0
    for x in license_scan.scan(df).collect():
        found = lists[x.doc_id]
        hits = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
        assert (x.n_words, x.n_base) == (len(found), len(hits))
        assert (x.first_word, x.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        labels, best, spans = {y for _, y in hits}, 0.5 * bool(hits), []
        assert x.base_labels == ",".join(sorted(labels))
        for t in license_scan.TEMPLATES:
            full = split(t.text)
            keys = [[i for i in range(len(found)) if found[i : i + len(k.split())] == k.split()] for k in t.keys]
            if not all(keys):
                continue
            rare = sorted(set(found) & set(full), key=lambda word: (-idf(word), word))[:8]
            votes = collections.defaultdict(set)
            for i, word in enumerate(found):
                if word in rare:
                    for q, other in enumerate(full):
                        if other == word:
                            votes[i - q].add(word)
            for start, voted in votes.items():
                if len(voted) >= 4 and all(any(start <= k < start + len(full) for k in ks) for ks in keys):
                    labels.add(t.label)
                    best = max(best, sum(0 <= start + q < len(found) and found[start + q] == y for q, y in enumerate(full)) / len(full))
                    spans.append((t.label, max(0, start), min(len(found), start + len(full))))
        assert x.labels == ",".join(sorted(labels)) and abs(x.score - best) < 1e-12 and sorted(tuple(y) for y in x.spans) == sorted(spans)
        seen.update(labels)
        several += len(labels) > 2
    assert all(seen[t.label] for t in license_scan.TEMPLATES) and several
    assert license_scan.scan(df.limit(0)).count() == 0


# --- 10


def test_sainte_lague():
    r = random.Random(6)
    for _ in range(200):
        votes = [r.randint(0, 1000) for _ in range(r.randint(1, 9))]
        seats = r.randint(0, 60)
        want = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            i = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * want[i] + 1), -i))
            want[i] += 1
        assert mixing.sainte_lague(np.array(votes), seats).tolist() == want
    assert mixing.sainte_lague(np.array([3e12, 1e12]), 4 * 10**9).tolist() == [3 * 10**9, 10**9]


def test_targets():
    t = mixing.targets([100, 10, 50, 0], [3, 1, 2, 3], Fraction(3, 2), 2)
    assert sum(t) == 240 and t[1] <= 20 and t[3] == 0 and all(x <= 2 * s for x, s in zip(t, [100, 10, 50, 0]))


def test_mix(spark):
    r = random.Random(8)
    sources = ["b", "a", None, "é", "B"]
    rows = [(i, " ".join("w" * r.randint(1, 80) for _ in range(r.randint(0, 90))), r.choice(sources)) for i in range(400)] + [(401, None, "a"), (402, "x", "a"), (402, "x", "a"), (None, "y z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "shard": F.lit(2)})
    got = mixing.mix(df, block=16).collect()
    assert len(got) == len(rows) and all(0 <= x.taken <= 2 * x.size for x in got)
    sizes, taken, of = collections.Counter(), collections.Counter(), {i: s for i, _, s in rows}
    for x in got:
        sizes[of[x.doc_id]] += x.size
        taken[of[x.doc_id]] += x.taken
        assert x.size == len(words(next(t for i, t, _ in rows if i == x.doc_id)))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert order == ["B", "a", "b", "é", None]
    want = mixing.targets([sizes[s] for s in order], [3, 1, 2, 3, 1], Fraction(3, 2), 2)
    for s, t in zip(order, want):
        assert abs(taken[s] - t) <= 40
        assert all(x.target == float(t) and x.source_size == sizes[s] for x in got if of[x.doc_id] == s)
    again = mixing.mix(df.repartition(7), block=16).collect()
    key = lambda x: (str(x.doc_id), x.size, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_by_a_plain_version(spark, monkeypatch):
    """taken of every row, from the rows in the order of the shards that Spark's hash gives."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    r = random.Random(9)
    rows = [(i if i % 7 else None, " ".join("w" * (1 + i % 3) for _ in range(r.choice([0, 1, 5, 40, 300]))), r.choice(["a", "a", "b", None, "tiny"]) if i else "tiny") for i in range(120)]
    rows = [(d, " ".join(t.split()[:2]) if s == "tiny" else t, s) for d, t, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row_no", F.monotonically_increasing_id())
    got = mixing.mix(df, keep=("row_no",)).collect()
    size = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    plain = df.select("*", size.cast("long").alias("size"), F.xxhash64(F.lit(17), "doc_id", size.cast("long"), F.xxhash64("text")).alias("h"), F.xxhash64("text").alias("mark")).collect()
    totals = collections.Counter()
    for x in plain:
        totals[x.source] += x.size
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([totals[s] for s in order], [3, 1, 2, 3], Fraction(3, 2), 2)
    units = {s: max(1, min(64, totals[s] // 16)) for s in order}
    assert len(set(units.values())) > 1
    seats = {}
    for u in set(units.values()):
        some = [s for s in order if units[s] == u]
        seats |= zip(some, mixing.sainte_lague(np.array([float(goal[order.index(s)]) for s in some]), round(sum(goal[order.index(s)] for s in some) / u)))
    want = collections.Counter()  # rows that are equal in all that counts may change places
    for s in order:
        unit = units[s]
        shards = -(-totals[s] // 500) or 1
        parts = [sorted((x for x in plain if x.source == s and x.h % shards == k), key=lambda x: (x.h, x.doc_id is not None, x.doc_id or 0, x.size, x.mark)) for k in range(shards)]
        held = [(k, p, sum(x.size for x in p)) for k, p in enumerate(parts) if p]
        quotas = mixing.sainte_lague(np.array([n for *_, n in held]), int(seats[s]))
        for (k, p, n), q in zip(held, quotas):
            blocks = -(-n // unit)
            q, at = min(int(q), 2 * blocks), 0
            first = spark.range(1).select(F.pmod(F.xxhash64(F.lit(17), F.lit(s).cast("string"), F.lit(k).cast("long")), F.lit(max(1, blocks)))).first()[0]
            times = [q // blocks + ((b - first) % blocks < q % blocks) for b in range(blocks)]
            for x in p:
                want[x.doc_id, s, x.mark, sum(times[w // unit] for w in range(at, at + x.size))] += 1
                at += x.size
    of = {x.row_no: x for x in plain}
    assert collections.Counter((x.doc_id, of[x.row_no].source, of[x.row_no].mark, x.taken) for x in got) == want and len({x.row_no for x in got}) == len(rows)
    assert all(x.copies == (round(x.taken / x.size) if x.size else 0) for x in got if x.size == 0 or 2 * x.taken % x.size)


# --- registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    from oracle import same

    same(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLES[name])
