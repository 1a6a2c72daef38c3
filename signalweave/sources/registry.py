"""The source registry as a table: checks, reads and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.text import blank
from signalweave.params import SOURCE_TYPES, TRUST_LEVELS
from signalweave.tables import staged

TEXT = ("name", "source_type", "url", "repo_owner", "repo_name", "arxiv_query", "github_topic", "github_ecosystem", "github_package", "github_label", "trust_level")


def _missing(c: str) -> Column:
    return F.coalesce(F.length(F.col(c)) == 0, F.lit(True))


def problems() -> Column:
    """What is wrong with an entry, in the order of the rules."""
    t = lambda name: F.coalesce(F.col("source_type") == name, F.lit(False))
    repo = _missing("repo_owner") | _missing("repo_name")
    rules = [
        (blank("name"), "name must not be blank"),
        (blank("url"), "url must not be blank"),
        (~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)), "unknown source_type"),
        (~F.coalesce(F.col("trust_level").isin(*TRUST_LEVELS), F.lit(False)), "unknown trust_level"),
        (t("github_releases") & repo, "github_releases needs repo_owner and repo_name"),
        (t("arxiv") & _missing("arxiv_query"), "arxiv needs arxiv_query"),
        (t("github_new_repos") & _missing("repo_owner") & _missing("github_topic"), "github_new_repos needs repo_owner or github_topic"),
        (t("github_star_velocity") & _missing("github_topic") & repo, "github_star_velocity needs github_topic or a repository"),
        (t("github_advisories") & _missing("github_package") & repo, "github_advisories needs github_package or a repository"),
        (t("github_changes") & repo, "github_changes needs repo_owner and repo_name"),
    ]
    return F.filter(F.array(*[F.when(c, text) for c, text in rules]), lambda x: x.isNotNull())


def checked(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid entries, and errors (pos, pointer, message) of the others; pos is an entry's place. Bad entries stop no other."""
    missing = {c: F.lit(None).cast("string") for c in TEXT if c not in entries.columns}
    found = entries.withColumns(missing).withColumn("problems", problems())
    pointer = F.concat(F.lit("entry #"), F.col("pos").cast("string"), F.when(~blank("name"), F.concat(F.lit(" ("), F.col("name"), F.lit(")"))).otherwise(""))
    errors = found.select("pos", pointer.alias("pointer"), F.explode("problems").alias("message"))
    return found.where(F.size("problems") == 0).select(*entries.columns), errors


def listed(sources: DataFrame, enabled: bool | None = None) -> DataFrame:
    return sources if enabled is None else sources.where(F.col("enabled") == enabled)


def upserted(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """stored with the rows of new put in or over it by name; the id of a known name stays and updated_at moves. New ids follow the largest. Write it to a new place, then switch."""
    fields = [c for c in new.columns if c != "name"]
    n = new.select(F.col("name").alias("n_name"), *[F.col(c).alias(f"n_{c}") for c in fields])
    both = stored.join(n, F.col("name") == F.col("n_name"), "full_outer")
    hit = F.col("n_name").isNotNull()
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # ranges of names are numbered apart; only one row a range comes together
    fresh = both.where("id IS NULL").select(F.col("n_name").alias("f_name")).distinct().repartitionByRange("f_name")
    fresh = staged(fresh.withColumn("part", F.spark_partition_id()), "new-names")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = fresh.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy("f_name"))
    ids = fresh.join(starts, "part").crossJoin(F.broadcast(top)).select("f_name", (F.col("top") + F.col("before") + place).alias("f_id"))
    out = both.join(ids, F.col("n_name") == F.col("f_name"), "left")
    cols = {"id": F.coalesce("id", "f_id"), "name": F.coalesce("name", "n_name"), "created_at": F.coalesce("created_at", now), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return out.select(*[cols.get(c, F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) if c in fields else F.col(c)).alias(c) for c in stored.columns])
