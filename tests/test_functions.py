import datetime as dt
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from signalweave.functions import scoring, text, vectors
from signalweave.params import ENTITY_LABELS


def _one(spark, column, **values):
    names = ", ".join(f"{k} {'timestamp' if isinstance(v, dt.datetime) else 'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_normalised_text(spark):
    for raw in ["  GPT-5   Released  ", "a\tb\x1cc\x85d", "", None, "\n x \n"]:
        assert _one(spark, text.normalised("t"), t=raw) == " ".join((raw or "").lower().split())


def test_hashes(spark):
    at = dt.datetime(2026, 1, 2, 3, 4, 5)
    parts = ["src", "https://x/1", "a title", "2026-01-02T03:04:05+00:00"]
    want = hashlib.sha256("".join(p + "\x1f" for p in parts).encode()).hexdigest()
    assert _one(spark, text.dedup_key("s", "u", "t", "at"), s=" SRC ", u=" https://x/1 ", t="A  Title", at=at) == want
    same = text.content_hash("a", "b")
    assert _one(spark, same, a="GPT-5 Released", b=None) == _one(spark, same, a="  gpt-5   released  ", b="")


def test_iso_keeps_micros(spark):
    assert _one(spark, text.iso_utc("at"), at=dt.datetime(2026, 1, 2, 3, 4, 5, 60)) == "2026-01-02T03:04:05.000060+00:00"


def test_bad_times_are_null(spark):
    assert _one(spark, text.parsed_time("t"), t="soon") is None
    assert _one(spark, text.parsed_time("t"), t="2026-01-02T03:04:05Z") == dt.datetime(2026, 1, 2, 3, 4, 5)


def test_entity_labels(spark):
    assert _one(spark, text.entity_label("t", ENTITY_LABELS), t=" Tool ") == "Tool"
    assert _one(spark, text.entity_label("t", ENTITY_LABELS), t="alien") is None


def test_embedders_agree_with_a_plain_one(spark):
    texts = ["Hello hello world 42", "", None, "été naïve x1", "a b c d e f g"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (np.array(r.a), np.array(r.b)) for r in df.select("i", vectors.hashing_embedding("t", 32).alias("a"), vectors.hashing_embedding_sql("t", 32).alias("b")).collect()}
    for i, t in enumerate(texts):
        v = np.zeros(32)
        for token in re.findall("[a-z0-9]+", (t or "").lower()):
            h = hashlib.sha1(token.encode()).digest()
            v[int.from_bytes(h[:4], "big") % 32] += 1 if h[4] % 2 else -1
        v = v / np.linalg.norm(v) if v.any() else np.eye(32)[0]
        assert np.allclose(got[i][0], v) and np.allclose(got[i][1], v)


def test_priority_class_for_all_pairs(spark):
    df = spark.range(36).select((F.col("id") % 6).alias("relevance"), F.expr("id div 6").alias("strategic_potential")).withColumn("c", scoring.priority_class())
    for r in df.collect():
        a, s = r.relevance, r.strategic_potential
        want = "immediate_priority" if a >= 5 or (a >= 4 and s >= 3) else "operational_update" if a >= 3 else "horizon_signal" if s >= 4 else "archive"
        assert r.c == want


def test_contribution_by_hand(spark):
    df = spark.createDataFrame([(81, 2, 2, 3), (81, 1, 6, 3), (81, 3, 1, 3), (4, 3, 4, 3)], "total int, distinct_sources int, event_count int, degree int")
    got = [r.c for r in df.select(scoring.contribution("total").alias("c")).collect()]
    assert got[0] == np.float64(math.log(81 / 2) * (2 + 0.5 * math.log1p(3))) and round(got[0], 2) == 9.97
    assert got[1:] == [0.0, 0.0, 0.0]


def test_tokens_are_those_of_the_pattern():
    r = random.Random(1)
    texts = ["".join(r.choice("abZ09 é\n.İß日") for _ in range(r.randrange(30))).lower() for _ in range(500)] + ["", ""]
    words, row = vectors._tokens(texts)
    assert list(zip(words.to_pylist(), row.tolist())) == [(w, i) for i, t in enumerate(texts) for w in re.findall("[a-z0-9]+", t)]
    assert vectors._tokens([""])[0].to_pylist() == [] and vectors._tokens([])[1].tolist() == []


def test_pieces_hold_all_tokens_in_lists_of_bounded_size():
    texts = ["Ab1 cd, " * 40, None, "", "x" * 50, "é y", "K İz"]
    found = [(int(rows[i]), w) for rows, some in vectors._pieces(texts, 16) for i, t in enumerate(some) for w in vectors._tokens([t])[0].to_pylist()]
    whole, row = vectors._tokens([(t or "").lower() for t in texts])
    assert found == list(zip(row.tolist(), whole.to_pylist()))
    assert max(sum(map(len, some)) for _, some in vectors._pieces(texts[:1], 16)) < 16 + 4
