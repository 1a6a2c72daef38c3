"""The periodic digest: period, theme, routed sections, counts and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.scoring import class_order, salience
from signalweave.functions.text import has_any, period_label, stripped
from signalweave.functions.vectors import dot
from signalweave.operators.events import DIGITS
from signalweave.operators.feeds import with_evidence
from signalweave.params import CLASSES, DEFAULTS, HEADINGS, QUADRANT, RESEARCH_WORDS, RISK_WORDS, SECTIONS, TOOL_WORDS, Params


def in_period(events: DataFrame, now: Column, days: int = DEFAULTS.digest_days, at: str = "published_at") -> DataFrame:
    """Events of the period and undated ones; if no dated event is in it, all events. The flag is one row, broadcast."""
    since = now - F.make_dt_interval(F.lit(days))
    some = events.agg(F.coalesce(F.max(F.col(at) >= since), F.lit(False)).alias("some"))
    return events.crossJoin(F.broadcast(some)).where(~F.col("some") | F.col(at).isNull() | (F.col(at) >= since)).drop("some")


def period_bounds(events: DataFrame, at: str = "published_at") -> DataFrame:
    return events.agg(F.min(at).alias("period_start"), F.max(at).alias("period_end"))


def tag_frequency(events: DataFrame, top: int = 12) -> DataFrame:
    """Rows (tag, n) of the most frequent lowered tags; ties go to the one that occurs first by (event, place)."""
    each = events.select("event_id", F.posexplode("tags").alias("pos", "tag")).select(F.lower("tag").alias("tag"), F.struct("event_id", "pos").alias("at"))
    found = each.groupBy("tag").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return found.orderBy(F.col("n").desc(), "first").limit(top)


def theme_text(events: DataFrame, context: str, top: int = 12) -> DataFrame:
    """One row: the context and the period's most frequent tags."""
    tags = tag_frequency(events, top).agg(F.array_sort(F.collect_list(F.struct(-F.col("n"), "first", "tag"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["tag"]), ", ")
    return tags.select(F.when(F.size("t") > 0, F.concat(F.lit(f"{context}\n\nThemes this period: "), joined)).otherwise(context).alias("theme"))


def theme_relevance(vectors: DataFrame, theme: DataFrame, item_events: DataFrame, limit: int = DEFAULTS.retrieve_limit) -> DataFrame:
    """Rows (event_id, theme_relevance): the best similarity of an event's items among the limit nearest to the theme, which is one row (vec), broadcast."""
    one = theme.select(F.col("vec").alias("theme_vec")).limit(1)
    near = vectors.crossJoin(F.broadcast(one)).select("item_id", F.round(dot("vec", "theme_vec"), DIGITS).alias("similarity")).orderBy(F.col("similarity").desc(), "item_id").limit(limit)
    return near.join(item_events, "item_id").groupBy("event_id").agg(F.max("similarity").alias("theme_relevance"))


def noise(p: Params = DEFAULTS) -> Column:
    return (F.col("priority_class") == "archive") | (F.col("hype") >= p.high_hype)


def sections(items: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows (section, pos, event_id) of the eight lists; items are events with class, scores, category, tags, source_type, recommended_action, score, convergence and theme_relevance.

    Weak signals are the converging ones of the quadrant, or all of it where none converges. Experiments come from the
    lists of must_know and tool_changes as they were cut. Lists are at most section_limit long.
    """
    words = F.lower(F.concat_ws(" ", F.coalesce("category", F.lit("")), F.array_join("tags", " ")))
    it = items.withColumns({"words": words, "body": ~noise(p), "blended": F.round(salience() + p.signal_weight * F.coalesce("score", F.lit(0.0)), 6), "salience": salience(), "score": F.round(F.coalesce("score", F.lit(0.0)), 6), "order": class_order(), "quadrant": F.col("priority_class").isin(*QUADRANT)})
    some = it.agg(F.coalesce(F.max(F.col("quadrant") & (F.coalesce("convergence", F.lit(0)) > 0)), F.lit(False)).alias("converging"))
    it = it.crossJoin(F.broadcast(some))
    b, t = F.col("body"), F.col("source_type")
    where = {
        "must_know": b & (F.col("priority_class") == CLASSES[0]),
        "should_read": b & (F.col("priority_class") == CLASSES[1]),
        "weak_signals": F.col("quadrant") & (~F.col("converging") | (F.coalesce("convergence", F.lit(0)) > 0)),
        "research_radar": b & ((t == "arxiv") | has_any("words", RESEARCH_WORDS)),
        "tool_changes": b & ((t == "github_releases") | has_any("words", TOOL_WORDS)),
        "risks": t.isin("github_advisories", "github_changes") | has_any("words", RISK_WORDS),
        "opportunities": b & (F.col("strategic_potential") >= 4) & (F.col("hype") <= 2),
    }
    routed = it.withColumn("section", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in where.items()]), lambda x: x.isNotNull())))
    weak = F.col("section") == "weak_signals"
    near = F.coalesce("theme_relevance", F.lit(-1.0)).desc()
    order = [F.when(weak, -F.col("score")).otherwise(F.col("order")), F.when(weak, -F.col("salience")).otherwise(-F.col("blended")), near, F.col("event_id")]
    place = F.row_number().over(W.partitionBy("section").orderBy(*order))
    cut = routed.withColumn("pos", place).where(F.col("pos") <= p.section_limit)
    pool = cut.where(F.col("section").isin("must_know", "tool_changes") & (F.length(stripped(F.coalesce("recommended_action", F.lit("")))) > 0))
    pool = pool.dropDuplicates(["event_id"]).withColumn("section", F.lit("suggested_experiments"))
    tried = pool.withColumn("pos", F.row_number().over(W.partitionBy("section").orderBy("order", F.col("blended").desc(), near, "event_id"))).where(F.col("pos") <= min(3, p.section_limit))
    return cut.select("section", "pos", "event_id").unionByName(tried.select("section", "pos", "event_id"))


def digest_counts(items: DataFrame, listed: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row: total_events, item_count, noise_count, n_<section> and the sorted referenced event_ids."""
    totals = items.agg(F.count("*").alias("total_events"), F.count_if(~noise(p)).alias("item_count"), F.count_if(noise(p)).alias("noise_count"))
    per = listed.agg(*[F.count_if(F.col("section") == s).alias(f"n_{s}") for s in SECTIONS], F.array_sort(F.collect_set("event_id")).alias("event_ids"))
    return totals.crossJoin(F.broadcast(per))


def bullets(rows: DataFrame) -> DataFrame:
    """rows of sections joined to their items, with the column line. The words and marks around the values are fixed values."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    link = F.concat(F.lit("["), F.coalesce(F.nullif("source_name", F.lit("")), F.lit("source")), F.lit("]("), text("source_url"), F.lit(")"))
    part = lambda c, label: F.when(F.length(stripped(text(c))) > 0, F.concat(F.lit(f" _{label}:_ "), F.col(c))).otherwise("")
    head = F.concat(F.lit("- **"), text("title"), F.lit("** — "), text("summary"))
    plain = F.concat(head, part("why_it_matters", "Why"), part("recommended_action", "Action"), F.lit(" ("), link, F.lit(", hype "), F.col("hype"), F.lit("/5 — 0=signal)"))
    said = F.when(F.length(text("why")) > 0, F.concat(F.lit(" _"), F.col("why"), F.lit("._"))).otherwise("")
    behind = F.when(F.size(F.coalesce("contributing_sources", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" Sources: "), F.array_join("contributing_sources", ", "), F.lit("."))).otherwise("")
    return rows.withColumn("line", F.when(F.col("section") == "weak_signals", F.concat(head, said, behind, F.lit(" ("), link, F.lit(")"))).otherwise(plain))


def markdown(lines: DataFrame, counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row (content_md): a heading for every section, whether it holds anything or not, and honest counts. The sentences are fixed values."""
    spark = lines.sparkSession
    heads = spark.createDataFrame([(s, i + 1, h) for i, (s, h) in enumerate(zip(SECTIONS, HEADINGS[1:]))], "section string, n int, heading string")
    listed = lines.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    parts = heads.join(listed, "section", "left").select("n", F.concat(F.lit("## "), F.col("heading"), F.lit("\n"), F.coalesce("body", F.lit("_Nothing this period._"))).alias("part"))
    middle = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("middle"))
    one = counts.crossJoin(bounds).crossJoin(middle)
    n = lambda c: F.col(c).cast("string")
    summary = F.concat(n("total_events"), F.lit(" development(s) this period: "), n("n_must_know"), F.lit(" need attention, "), n("n_should_read"), F.lit(" worth reading, "), n("n_weak_signals"), F.lit(" weak signal(s) on the horizon, and "), n("noise_count"), F.lit(" filtered as noise (archived / high-hype)."))
    last = F.concat(n("noise_count"), F.lit(" item(s) were archived or high-hype (hype-demoted) and excluded from the body."))
    return one.select(F.concat(F.lit("# Weekly digest — "), period_label("period_start", "period_end"), F.lit(f"\n\n## {HEADINGS[0]}\n"), summary, F.lit("\n\n"), F.col("middle"), F.lit(f"\n\n## {HEADINGS[9]}\n"), last, F.lit("\n")).alias("content_md"))


def composed(fallback: DataFrame, written: DataFrame) -> DataFrame:
    """The text of an outside writer where it is not blank, else the fallback. Both are one row (content_md)."""
    w = written.select(F.col("content_md").alias("written")).limit(1)
    good = F.length(stripped(F.coalesce("written", F.lit("")))) > 0
    return fallback.join(w, how="left").select(F.when(good, F.col("written")).otherwise(F.col("content_md")).alias("content_md"), F.when(good, "llm").otherwise("fallback").alias("method"))


def composition_request(lines: DataFrame, counts: DataFrame, bounds: DataFrame, context: str) -> DataFrame:
    """One row (request): the same facts as text for an outside writer."""
    listed = lines.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    heads = lines.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SECTIONS)], "section string, n int")
    parts = heads.join(listed, "section", "left").select("n", F.concat(F.upper("section"), F.coalesce(F.concat(F.lit(":\n"), F.col("body")), F.lit(": (none)"))).alias("part"))
    body = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n").alias("body"))
    one = body.crossJoin(counts).crossJoin(bounds)
    return one.select(F.concat(F.lit("period: "), period_label("period_start", "period_end"), F.lit(f"\nuser_context: {context}\n\n"), F.col("body"), F.lit("\n\nnoise_count: "), F.col("noise_count").cast("string"), F.lit("\ntotal_events_considered: "), F.col("total_events").cast("string")).alias("request"))


def flattened(events: DataFrame, signals: DataFrame, coverage: DataFrame, relevance: DataFrame | None = None) -> DataFrame:
    """Digest items: events with their signal, contributing sources and, where the theme was searched for, its relevance."""
    out = with_evidence(events.join(signals, "event_id", "left"), coverage)
    if relevance is None:
        return out.withColumn("theme_relevance", F.lit(None).cast("double"))
    return out.join(relevance.select("event_id", "theme_relevance"), "event_id", "left")


def digest_row(items: DataFrame, now: Column, searched: bool, written: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """One row of the digest table without its id: period, text, method, counts, the referenced events, and whether the graph or the theme had a part in it.

    items are a written table of flattened(); written is one row (content_md) by an outside writer.
    """
    listed = sections(items, p)
    counts, bounds = digest_counts(items, listed, p), period_bounds(items)
    text = markdown(bullets(listed.join(items, "event_id")).select("section", "pos", "line"), counts, bounds)
    text = text.withColumn("method", F.lit("fallback")) if written is None else composed(text, written)
    told = items.agg(F.coalesce(F.max(F.coalesce("convergence", F.lit(0)) > 0), F.lit(False)).alias("told"))
    one = text.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(bounds)).crossJoin(F.broadcast(told))
    return one.select("period_start", "period_end", "content_md", "method", "item_count", "noise_count", (F.lit(searched) | F.col("told")).alias("graphrag"), "event_ids", now.alias("created_at"))


def listed_digests(digests: DataFrame, limit: int = 20) -> DataFrame:
    """Digests without their text, newest first, ties by the larger id."""
    return digests.drop("content_md").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def digest_by_id(digests: DataFrame, digest_id: int) -> DataFrame:
    return digests.where(F.col("id") == digest_id)
