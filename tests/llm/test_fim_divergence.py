import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalweave.llm import divergence, fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = ["", None, " ", "a", " \n\t", "<P> x y", "a <M>b", "é <\x1c> <S", "　 wide", "x" * 5000, "\x0b\x0c end  ", "A b c d e f g <", "同じ 文 です P> <S", "\x00 nul \x00"]


# --- 13


@pytest.mark.parametrize("piece", [3, 1 << 20])
def test_unit_ends(monkeypatch, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    r = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(r.choice("ab <P>\n\x0b\x1cé　") for _ in range(r.randrange(40))) for _ in range(2000)]
    for t in texts:
        assert fim.unit_ends(t).tolist() == [m.end() for m in UNIT.finditer(t)]


def plain_fim(doc, text):
    text = text or ""
    u = [m[0] for m in UNIT.finditer(text)]
    h = hashlib.sha256(b"42:" + str("" if doc is None else doc).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    r = random.Random(3)
    texts = ODD * 4 + ["".join(r.choice(["a", "Bb", " ", "<", "<S", "P>", "\n", "é"]) for _ in range(r.randrange(60))) for _ in range(200)]
    rows = [(i - 5, t) for i, t in enumerate(texts)] + [(None, "no id here"), (3, "again"), (3, "again"), (9, "long text " * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, `the.text` string").withColumns({"n": F.lit(1), "form": F.lit("clash"), "output": F.lit(0)})
    out = fim.fill_in_middle(frame, text="the.text").withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in out) == Counter((d, *plain_fim(d, t)) for d, t in rows)
    assert Counter((x.doc_id, x.restored) for x in out) == Counter((d, t or "") for d, t in rows)
    assert {x.form for x in out} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(frame.limit(0), text="the.text").count() == 0


# --- 12


def test_radix_order():
    r = np.random.default_rng(5)
    words, group = r.integers(0, 1 << 63, 3000).astype("u8") >> r.integers(0, 60, 3000).astype("u8"), r.integers(0, 5, 3000).astype("u4")
    assert divergence.radix_order([words, group]).tolist() == np.lexsort((words, group)).tolist()
    assert divergence.radix_order([np.zeros(0, "u8")]).tolist() == []


def test_counts_of_terms():
    r = random.Random(7)
    vocab = ["a", "B", "é", "abcdefgh", "ABCDEFGHi", "sixteen" + "x" * 9, "seventeen" + "y" * 8, "z" * 100, "z" * 99 + "Z", "日本語", "ß" * 9, "w" * 3000]
    texts = ["".join(r.choice(vocab) + r.choice([" ", "1", "\x7f", "\n@["]) for _ in range(r.randrange(40))) for _ in range(50)] + ["", None, "1 2", "END", "START"]
    group = np.array([r.randrange(3) for _ in texts])
    want = defaultdict(lambda: [0, 0])
    for g, t in zip(group, texts):
        for term, n in Counter(TERM.findall((t or "").translate(LOWER))).items():
            want[g, term][0] += n
            want[g, term][1] += 1
    found = {}
    for of, terms, n, rows in divergence.counted(pa.array(["skipped", *texts]).slice(1), group):
        for g, t, a, b in zip(of.tolist(), terms.cast(pa.string()).to_pylist(), n.tolist(), rows.tolist()):
            assert (g, t) not in found
            found[g, t] = [a, b]
    assert found == dict(want)


def plain_audit(rows, least, top):
    docs = [(t or "", lang or "", source or "") for t, lang, source in rows]
    words = [Counter(TERM.findall(t.translate(LOWER))) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        df = Counter(w for d, c in zip(docs, words) if d[1] == lang for w in c)
        kept = {w for w, n in df.items() if n >= least}
        counts = {s: Counter() for _, la, s in docs if la == lang}
        for d, c in zip(docs, words):
            if d[1] == lang:
                counts[d[2]].update({w: n for w, n in c.items() if w in kept})
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(sum(abs(p[s][w] - p[x][w]) for w in kept), x) for x in counts if x != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                for i, (value, item) in enumerate(sorted(found, key=lambda e: (-e[0], e[1].encode()))[:limit]):
                    out.append((lang, s, part, item, value, i + 1))
    return Counter(out)


@pytest.mark.parametrize("block, bucket", [(256, 100_000), (3, 40)])
def test_audit(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", bucket)
    r = random.Random(11)
    vocab = [f"{a}{b}" for a in ("the", "Of", "é", "quite", "extraordinarily", "zz") for b in ("", "a", "ing", "y" * 12, "ß")]
    rows = [(" ".join(r.choice(vocab[: r.randrange(1, 30)]) for _ in range(r.randrange(30))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", "", None, "é9", "s10"])) for _ in range(300)]
    rows += [(None, "en", "quiet"), ("1 2 3", "en", "digits"), ("rare words only", "xx", "one"), ("other rare words", "xx", "two"), ("same same", "en", "s1"), ("same same", "en", "s1"), ("word " * 400_000, "de", "s2")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("clash"), "rank": F.lit(0)})
    found = divergence.audit(frame, least=6, top=5).collect()
    assert Counter(tuple(x) for x in found) == plain_audit(rows, 6, 5)
    assert divergence.audit(frame.limit(0)).count() == 0
