"""Priority class, salience, contributions and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalweave.functions.text import col
from signalweave.params import ACTIONS, CLASSES, DEFAULTS, Params


def priority_class(relevance: Column | str = "relevance", strategic: Column | str = "strategic_potential") -> Column:
    r, s = col(relevance), col(strategic)
    return F.when((r >= 5) | ((r >= 4) & (s >= 3)), CLASSES[0]).when(r >= 3, CLASSES[1]).when(s >= 4, CLASSES[2]).otherwise(CLASSES[3])


def class_order(c: Column | str = "priority_class") -> Column:
    """Place of a class; unknown ones last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in CLASSES]), col(c)), F.lit(0)), F.lit(len(CLASSES) + 1)).cast("int")


def salience() -> Column:
    return F.col("relevance") + F.col("novelty") + F.col("actionability") + F.col("strategic_potential") - F.col("hype")


def clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(5))


def idf(total: Column | str, events: Column | str) -> Column:
    return F.ln(col(total).cast("double") / col(events).cast("double"))


def contribution(total: Column | str, p: Params = DEFAULTS) -> Column:
    """A hub-dampened weight of an entity; 0 for few sources, single events and entities that are everywhere."""
    rare = idf(total, "event_count")
    full = rare * (p.convergence_weight * F.col("distinct_sources") + p.degree_weight * F.log1p(F.col("degree").cast("double")))
    gated = (F.col("distinct_sources") < p.min_sources) | (F.col("event_count") < 2) | F.coalesce(rare <= 0, F.lit(True))
    return F.when(gated, 0.0).otherwise(full)


def action_weight(action: Column | str) -> Column:
    out = F.lit(0.0)
    for name, weight in ACTIONS.items():
        out = F.when(col(action) == name, weight).otherwise(out)
    return out


def blended(p: Params = DEFAULTS) -> Column:
    """Salience with the graph signal and feedback; each missing one counts 0."""
    return salience() + p.signal_weight * F.coalesce(F.col("score"), F.lit(0.0)) + p.feedback_weight * F.coalesce(F.col("weight"), F.lit(0.0))
