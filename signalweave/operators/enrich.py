"""Enrichment: model answers as text columns, their checks, the fallback by rules, and requests for an outside model."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from signalweave.functions.scoring import clamped, priority_class
from signalweave.functions.text import col, has_any, iso_utc, stripped
from signalweave.params import ACTION_WORDS, ENTITY_LABELS, HORIZONS, STACK_WORDS

FENCE = r"(?s)^\s*```[a-zA-Z]*\s*(.*?)\s*```\s*$"
SCORES = ("relevance", "novelty", "actionability", "strategic_potential", "hype")


@F.pandas_udf(StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object that starts anywhere in a text."""
    decoder = json.JSONDecoder()

    def one(t: str | None) -> str | None:
        at = (t or "").find("{")
        while at >= 0:
            try:
                value, end = decoder.raw_decode(t, at)
            except ValueError:
                at = t.find("{", at + 1)
                continue
            return t[at:end] if isinstance(value, dict) else None
        return None

    return texts.map(one)


def _held(answers: DataFrame, text: str) -> DataFrame:
    """answers with the JSON object of each as a variant j, null where there is none; a fence or prose may stand around it.

    Answers that are one object already pass through built-in functions; only the rest is scanned. Each step is a column of
    its own, so that it is worked out once.
    """
    out = answers.withColumn("bare_", stripped(F.regexp_replace(F.coalesce(col(text), F.lit("")), FENCE, "$1"))).withColumn("whole_", F.try_parse_json("bare_"))
    out = out.withColumn("direct_", F.coalesce(F.startswith("bare_", F.lit("{")) & F.schema_of_variant("whole_").startswith("OBJECT"), F.lit(False)))
    found = _first_object(F.when(~F.col("direct_"), F.col("bare_")))
    return out.withColumn("j", F.when(F.col("direct_"), F.col("whole_")).otherwise(F.try_parse_json(found))).drop("bare_", "whole_", "direct_")


def _at(path: str, of: str = "j") -> Column:
    """What stands at a path: null where nothing does, a variant null for a JSON null."""
    return F.try_variant_get(F.col(of), f"$.{path}", "variant")


def _kind(v: Column) -> Column:
    """BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, VOID, ARRAY<..> or OBJECT<..>."""
    return F.schema_of_variant(v)


def _said(v: Column) -> Column:
    return v.cast("string")


def _string(v: Column, default: str | None) -> tuple[Column, Column]:
    """Whether a field that must be a string is one, and its value; without a default it must be there."""
    good = F.coalesce(_kind(v) == "STRING", F.lit(default is not None))
    return good, F.coalesce(_said(v), F.lit(default)) if default is not None else _said(v)


def _integer(v: Column) -> Column:
    """Whole numbers, also as text, as a number with nothing after the point, or as true and false; else null."""
    kind, said = _kind(v), _said(v)
    whole = F.when(F.rlike(said, F.lit(r"^\s*[+-]?[0-9]{1,9}(\.0+)?\s*$")), F.try_to_number(F.regexp_replace(said, r"\s|\+|\.0+\s*$", ""), F.lit("S999999999")).cast("int"))
    number = F.rlike(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT|STRING)"))
    return F.when(kind == "BOOLEAN", F.when(said == "true", 1).otherwise(0)).when(number, whole)


def classified(answers: DataFrame, text: str = "text") -> DataFrame:
    """answers with ok, category, tags and the five scores.

    A score that is missing, no whole number or out of 0 to 5 fails the answer; whole numbers may come as text. A category
    that is there must be a string. Tags: a list gives its stripped elements that are not blank, a string is one tag as it
    stands, anything else none.
    """
    out = _held(answers, text).withColumns({s: _integer(_at(f"scores.{s}")) for s in SCORES})
    out = out.withColumns({s: F.when(F.col(s).between(0, 5), F.col(s)) for s in SCORES})
    tags = _at("tags")
    element = lambda v: F.when(_kind(v) == "VOID", "None").when(_kind(v) == "BOOLEAN", F.initcap(_said(v))).otherwise(_said(v))
    listed = F.filter(F.transform(F.try_variant_get("j", "$.tags", "array<variant>"), lambda t: stripped(element(t))), lambda t: t != "")
    none = F.array().cast("array<string>")
    coerced = F.when(_kind(tags) == "STRING", F.array(_said(tags))).when(F.startswith(_kind(tags), F.lit("ARRAY")), listed).otherwise(none)
    good, category = _string(_at("category"), "uncategorised")
    ok = F.col("j").isNotNull() & good
    for s in SCORES:
        ok = ok & F.col(s).isNotNull()
    return out.withColumns({"ok": F.coalesce(ok, F.lit(False)), "category": category, "tags": F.coalesce(coerced, none)}).drop("j")


def summarised(answers: DataFrame, text: str = "text") -> DataFrame:
    """answers with ok, summary and the three texts around it; all must be strings, and only the summary must be there."""
    out = _held(answers, text)
    fields = {"summary": _string(_at("summary"), None), **{f: _string(_at(f), "") for f in ("why_it_matters", "connection_to_user_work", "recommended_action")}}
    ok = F.col("j").isNotNull()
    for good, _ in fields.values():
        ok = ok & good
    return out.withColumns({"ok": F.coalesce(ok, F.lit(False))} | {f: v for f, (_, v) in fields.items()}).drop("j")


def weak(answers: DataFrame, text: str = "text") -> DataFrame:
    """answers with ok, is_weak_signal and horizon. The flag may come as a boolean, as 0 or 1, or as one of the usual words for them; it is false where it is missing. An unknown horizon is null, one that is no string fails the answer."""
    out = _held(answers, text)
    flag, horizon = _at("is_weak_signal"), _at("horizon")
    said = F.lower(_said(flag))
    told = F.when(F.rlike(_kind(flag), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")), F.when(F.rlike(said, F.lit(r"^1(\.0+)?$")), True).when(F.rlike(said, F.lit(r"^0(\.0+)?$")), False))
    told = F.when(_kind(flag).isin("STRING", "BOOLEAN"), F.when(said.isin("1", "on", "t", "true", "y", "yes"), True).when(said.isin("0", "off", "f", "false", "n", "no"), False)).otherwise(told)
    ok = F.col("j").isNotNull() & (flag.isNull() | told.isNotNull()) & F.coalesce(_kind(horizon).isin("STRING", "VOID"), F.lit(True))
    for f in ("rationale", "what_to_watch"):
        ok = ok & _string(_at(f), "")[0]
    near = F.lower(stripped(_said(horizon)))
    return out.withColumns({"ok": F.coalesce(ok, F.lit(False)), "is_weak_signal": F.coalesce(told, F.lit(False)), "horizon": F.when(near.isin(*HORIZONS), near)}).drop("j")


def graph_payload(answers: DataFrame, text: str = "text") -> DataFrame:
    """answers with ok, entities and relationships, names stripped; one unknown type, blank name or field that is no string fails the whole answer, which then has none."""
    out = _held(answers, text)
    field = lambda v, f: F.try_variant_get(v, f"$.{f}", "variant")
    full = lambda v, f: F.coalesce((_kind(field(v, f)) == "STRING") & (F.length(stripped(_said(field(v, f)))) > 0), F.lit(False))
    lists = {n: F.try_variant_get("j", f"$.{n}", "array<variant>") for n in ("entities", "relationships")}
    ok = F.col("j").isNotNull()
    for n in lists:
        ok = ok & F.coalesce(F.startswith(_kind(_at(n)), F.lit("ARRAY")), F.lit(True))
    ok = ok & F.coalesce(F.forall(lists["entities"], lambda e: full(e, "name") & full(e, "type") & _said(field(e, "type")).isin(*ENTITY_LABELS)), F.lit(True))
    ok = ok & F.coalesce(F.forall(lists["relationships"], lambda r: full(r, "subject") & full(r, "predicate") & full(r, "object")), F.lit(True))
    named = lambda fields: lambda v: F.struct(*[(_said(field(v, f)) if f == "type" else stripped(_said(field(v, f)))).alias(f) for f in fields])
    kinds = {"entities": ("name", "type"), "relationships": ("subject", "predicate", "object")}
    keep = {n: F.when(F.col("ok"), F.transform(v, named(kinds[n]))) for n, v in lists.items()}
    empty = {n: F.array().cast(f"array<struct<{','.join(f'{f}:string' for f in kinds[n])}>>") for n in kinds}
    return out.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumns({n: F.coalesce(keep[n], empty[n]) for n in kinds}).drop("j")


def by_rules(items: DataFrame) -> DataFrame:
    """The conservative enrichment of representative items: words of the stack give tags and relevance; it claims no weak signal and no graph."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    out = items.withColumn("t", text)
    # one call a word, not one lambda: a column that is read once is put in its place, and would be lowered anew for each word
    out = out.withColumn("tags", F.array_compact(F.array(*[F.when(F.contains(F.col("t"), F.lit(w)), w) for w in STACK_WORDS])))
    hit = lambda *words: has_any("t", words)
    category = F.when(hit("security", "advisory", "cve"), "security").when(F.col("source_type") == "github_releases", "tool_update").when(F.col("source_type") == "arxiv", "research").otherwise("uncategorised")
    scores = {
        "relevance": clamped(F.least(F.size("tags"), F.lit(4))),
        "novelty": F.lit(2),
        "actionability": F.when(has_any("t", ACTION_WORDS), 2).otherwise(1),
        "strategic_potential": F.lit(2),
        "hype": F.when(F.col("source_type").isin("github_releases", "arxiv"), 2).otherwise(3),
    }
    # fixed values
    texts = {
        "category": category,
        "summary": stripped(F.coalesce(F.nullif("summary", F.lit("")), "title")),
        "why_it_matters": F.lit("No LLM interpretation available (rule-based fallback)."),
        "connection_to_user_work": F.when(F.size("tags") > 0, "Mentions the user's stack/interests.").otherwise("No direct connection detected."),
        "recommended_action": F.lit("No action — awareness only (rule-based fallback)."),
        "is_weak_signal": F.lit(False),
    }
    return out.withColumns(scores).withColumns(texts).withColumns({"priority_class": priority_class(), "method": F.lit("fallback")}).drop("t")


def enriched(items: DataFrame, classify: DataFrame, summarise: DataFrame) -> DataFrame:
    """By model where both answers are good, else by rules. All three have event_id."""
    rules = by_rules(items)
    # good answers by explode, not by a filter: a filter on ok would be taken down to the texts, and parse them anew for each field
    good = lambda df, of, fields: df.select("event_id", F.explode(F.when(F.col("ok"), F.array(F.struct(*fields)))).alias(of))
    c = good(classified(classify), "c", ("category", "tags", *SCORES))
    s = good(summarised(summarise), "s", ("summary", "why_it_matters", "connection_to_user_work", "recommended_action"))
    out = rules.join(c, "event_id", "left").join(s, "event_id", "left")
    good = F.col("c").isNotNull() & F.col("s").isNotNull()
    pick = lambda side, f: F.when(good, F.col(f"{side}.{f}")).otherwise(F.col(f))
    out = out.withColumns({f: pick("c", f) for f in ("category", "tags", *SCORES)} | {f: pick("s", f) for f in ("summary", "why_it_matters", "connection_to_user_work", "recommended_action")} | {"method": F.when(good, "llm").otherwise("fallback")})
    return out.withColumn("priority_class", priority_class()).drop("c", "s")


def not_enriched(events: DataFrame, done: DataFrame) -> DataFrame:
    """Events without enrichment: each is enriched once."""
    return events.join(done.select("event_id"), "event_id", "left_anti")


def requests(items: DataFrame, instruction: str, context: str | None = None) -> DataFrame:
    """Rows (event_id, request): the facts of an item as text for an outside model."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in (("title", F.col("title")), ("source_name", F.col("source_name")), ("source_url", F.col("url")), ("published_at", F.coalesce(iso_utc("published_at"), F.lit("unknown"))), ("content", F.coalesce("summary", F.lit(""))))]
    if context is not None:
        lines.append(F.lit(f"user_context: {context}"))
    return items.select("event_id", F.concat_ws("\n", *lines, F.lit(""), F.lit(instruction)).alias("request"))
