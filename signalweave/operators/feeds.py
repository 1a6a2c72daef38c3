"""Feedback states, ranked feeds and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.scoring import action_weight, blended, class_order, salience
from signalweave.functions.text import normalised, stripped
from signalweave.params import ACTIONS, DEFAULTS, HIDE, QUADRANT, Params


def checked_feedback(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows with the action stripped and lowered and a reason where it is refused: unknown action or event."""
    action = F.lower(stripped(F.coalesce("action", F.lit(""))))
    known = events.select(F.col("event_id").alias("known")).distinct()
    out = rows.withColumn("action", action).join(known, F.col("event_id") == F.col("known"), "left")
    return out.withColumn("reason", F.when(~F.col("action").isin(*ACTIONS), "unknown action").when(F.col("known").isNull(), "unknown event")).drop("known")


def feedback_state(log: DataFrame) -> DataFrame:
    """Rows (event_id, action, weight, hidden): the newest action of each event counts, ties by id."""
    last = log.groupBy("event_id").agg(F.max_by("action", F.struct("created_at", "id")).alias("action"))
    return last.withColumns({"weight": action_weight("action"), "hidden": F.col("action") == HIDE})


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; upserts of vectors and sources are a union and this."""
    row = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("k")).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def ranked(enriched: DataFrame, signals: DataFrame | None = None, states: DataFrame | None = None, limit: int | None = 100, include_hidden: bool = False, p: Params = DEFAULTS) -> DataFrame:
    """The feed: by class, then salience with signal and feedback, then event. Hidden events are left out unless asked for.

    Scores are rounded before they are compared, so that equal ones tie on every machine.
    """
    out = enriched
    if states is not None and not include_hidden:
        out = out.join(states.where("hidden").select("event_id"), "event_id", "left_anti")
    out = out.join(signals.select("event_id", "score"), "event_id", "left") if signals is not None else out.withColumn("score", F.lit(0.0))
    out = out.join(states.select("event_id", "weight"), "event_id", "left") if states is not None else out.withColumn("weight", F.lit(0.0))
    out = out.withColumns({"salience": salience(), "blended": F.round(blended(p), 6)})
    ordered = out.orderBy(class_order(), F.col("blended").desc(), "event_id")
    return ordered.limit(limit) if limit is not None else ordered


def weak_signals(enriched: DataFrame, signals: DataFrame, limit: int = 50) -> DataFrame:
    """The quadrant of low relevance, by graph score, salience and event. Hidden events stay in it."""
    out = enriched.where(F.col("priority_class").isin(*QUADRANT)).join(signals, "event_id", "left")
    out = out.withColumns({"score": F.round(F.coalesce("score", F.lit(0.0)), 6), "salience": salience()})
    return out.orderBy(F.col("score").desc(), F.col("salience").desc(), "event_id").limit(limit)


def with_evidence(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """rows with contributing_sources: the driver's if the signal fired, else the event's own."""
    out = rows.join(coverage.select("event_id", "sources"), "event_id", "left")
    own = F.coalesce("sources", F.array().cast("array<string>"))
    return out.withColumn("contributing_sources", F.when(F.coalesce(F.size("evidence_sources"), F.lit(0)) > 0, F.col("evidence_sources")).otherwise(own)).drop("sources")


def events_of_entity(relations: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """Events that mention an entity of that normalised name, of any type, as subject or object."""
    wanted = entities.where(normalised("name") == normalised(F.lit(name))).select("entity_id")
    ends = relations.select("event_id", F.explode(F.array("subject", "object")).alias("entity_id"))
    return ends.join(wanted, "entity_id", "left_semi").select("event_id").distinct()


def representatives(events: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (event_id, item_id): the representative item, or the event's first where that is missing."""
    held = items.groupBy("event_id").agg(F.min("item_id").alias("lowest"))
    known = items.select(F.col("item_id").alias("found"))
    out = events.select("event_id", "representative_item_id").join(held, "event_id", "left").join(known, F.col("representative_item_id") == F.col("found"), "left")
    return out.select("event_id", F.coalesce("found", "lowest").alias("item_id"))


def serialised(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The feed's shape: id as text, fallbacks for missing titles and sources, scores nested. rows have item_id."""
    i = items.select(F.col("item_id").alias("i_id"), F.col("title").alias("i_title"), F.col("source_name").alias("i_source"), F.col("published_at").alias("i_published"))
    out = rows.join(i, F.col("item_id") == F.col("i_id"), "left")
    return out.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("i_id").isNull(), "(untitled)").otherwise(F.col("i_title")).alias("title"),
        F.coalesce("i_source", F.lit("")).alias("source_name"),
        F.col("i_published").alias("published_at"),
        "priority_class",
        "category",
        "tags",
        F.struct("relevance", "novelty", "actionability", "strategic_potential", "hype").alias("scores"),
        "summary",
        "why_it_matters",
        "recommended_action",
        *[F.coalesce(F.col(c), d).alias(c) for c, d in (("source_url", F.lit("")), ("is_weak_signal", F.lit(False))) if c in rows.columns],
        *[F.col("horizon") for _ in "h" if "horizon" in rows.columns],
        *[F.coalesce(F.col(c), d).alias(n) for c, d, n in (("why", F.lit(""), "graph_why"), ("convergence", F.lit(0), "convergence")) if c in rows.columns],
    )


def star_velocity(snapshots: DataFrame, repo: str = "repo", stars: str = "stars", at: str = "captured_at", order: str = "id") -> DataFrame:
    """Rows (repo, captured_at, gained, stars, title): rises against the snapshot before; first ones and falls give nothing."""
    before = F.lag(stars).over(W.partitionBy(repo).orderBy(at, order))
    out = snapshots.withColumn("gained", F.col(stars) - before).where("gained > 0")
    return out.select(F.col(repo).alias("repo"), F.col(at).alias("captured_at"), F.col(order).alias("id"), "gained", F.col(stars).alias("stars"), F.concat(F.col(repo).cast("string"), F.lit(" gained "), F.col("gained"), F.lit(" stars (now "), F.col(stars), F.lit(")")).alias("title"))
