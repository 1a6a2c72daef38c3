"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over its bits.

Only Spark SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweave.llm.text import WORD

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named condition over the measurements; its bit is its place in RULES. Bits are never given anew."""

    name: str
    failed: str


#: The order fixes the bits: append only.
RULES = (
    Rule("too_short", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BIT["too_short"] | BIT["repeated_windows"]
#: Versions of what is rejected. A version never changes; a new one is added.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["word_length"] | BIT["symbols"] | BIT["duplicate_lines"],
}


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row: a lambda variable is bound once, an inlined column would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """How many words the repeated windows cover; hashes has a window's hash at each start."""

    def from_sorted(s: Column) -> Column:
        same = lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"])
        starts = F.filter(F.transform(s, lambda e, i: F.when(F.coalesce(same(e, i), F.lit(False)), e["p"])), lambda p: p.isNotNull())
        gaps = lambda q: F.transform(q, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - p, F.lit(WINDOW))))
        return let(F.sort_array(starts), lambda q: F.aggregate(gaps(q), F.lit(0).cast("long"), lambda a, x: a + x))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, from_sorted))


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep and the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text counts as empty; all measurements of an empty text are 0. n_lines: \\n-split lines that hold a word.
    n_dup_lines: those equal to an earlier one. n_repeat_words: words inside windows of 8 words that stand twice or
    more in the text; windows are compared by 64-bit hash. Repeated rows are measured each; other columns are ignored.
    """
    kept = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    names = [f"k_{i}" for i in range(len(keep))]
    held = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Each measurement stands on the text alone and binds what it needs with let(), so that it costs one pass wherever the optimizer puts it, in a filter too.
    words = F.filter(F.split("t", SPACES), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    windows = lambda w: F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return held.select(
        *[F.col(x).alias(c) for x, c in zip(names, keep)],
        F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words, lambda w: let(windows(w), _covered)).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """measured() and the column failed: bit i is set where rule i of RULES fails."""
    bits = [F.when(F.expr(rule.failed), F.lit(BIT[rule.name])).otherwise(F.lit(0)) for rule in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs, text, keep).withColumn("failed", total.cast("long"))


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a policy keeps a row of the ledger."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """One row for each rule of a policy: rejected by it, by it alone, and what the policy without it would keep. Counts of bits, without another look at a text."""
    mask = POLICIES[policy]
    used = [r for r in RULES if BIT[r.name] & mask]
    f = F.col("failed").bitwiseAND(F.lit(mask))
    sums = rows.agg(*[F.struct(F.lit(r.name).alias("rule"), F.count_if(f.bitwiseAND(F.lit(BIT[r.name])) != 0).alias("rejected"), F.count_if(f == BIT[r.name]).alias("only_by_it"), F.count_if(f.bitwiseAND(F.lit(mask & ~BIT[r.name])) == 0).alias("kept_without")).alias(r.name) for r in used])
    return sums.select(F.explode(F.array(*[r.name for r in used])).alias("x")).select("x.*")
