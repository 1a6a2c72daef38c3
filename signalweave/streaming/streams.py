"""Streaming forms: idempotent intake, windowed convergence, latest feedback, star velocity, event assignment."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalweave.functions.scoring import action_weight
from signalweave.operators.events import assign_new
from signalweave.params import ACTIONS, DEFAULTS, HIDE
from signalweave.tables import new_path, staged


def intake(items: DataFrame, delay: str = "30 days", at: str = "arrived_at", key: str = "dedup_key") -> DataFrame:
    """The first item of each key within the delay; later repeats within it are dropped, state older than it is forgotten."""
    return items.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_convergence(mentions: DataFrame, window: str = "30 days", slide: str = "1 day", delay: str = "1 day", at: str = "ts") -> DataFrame:
    """For each window and entity: mentions, distinct sources and events; append mode, a window once it is closed.

    Two aggregations in a row: how often each event and each source stands in a window of an entity, then how many there
    are of each kind. State is one row for each event and source of an open window, never a set of them. Mentions that
    come after their window has closed are left out. Complete mode takes the same rows from tables.
    """
    facts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("event", "event_id"), ("source", "source_name"))])).alias("f")
    rows = mentions.withWatermark(at, delay).select(at, "entity_id", facts)
    each = rows.groupBy(F.window(at, window, slide).alias("w"), "entity_id", "f").agg(F.count("*").alias("n"))
    told = lambda kind, c: F.sum(F.when(F.col("f.kind") == kind, c).otherwise(0))
    out = each.groupBy("w", "entity_id").agg(told("event", F.col("n")).alias("mentions"), told("source", F.col("f.value").isNotNull().cast("long")).alias("distinct_sources"), told("event", F.col("f.value").isNotNull().cast("long")).alias("event_count"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "entity_id", "mentions", "distinct_sources", "event_count")


def latest_feedback(log: DataFrame) -> DataFrame:
    """The newest action of each event so far; complete or update mode."""
    last = log.groupBy("event_id").agg(F.max_by("action", F.struct("created_at", "id")).alias("action"))
    return last.withColumns({"weight": action_weight("action"), "hidden": F.col("action") == HIDE})


def checked_feedback(log: DataFrame, events: DataFrame, wait: str = "10 days", keep: str = "400 days", delay: str = "1 day") -> DataFrame:
    """Rows (id, event_id, action, created_at, reason): a stream of feedback (id, event_id, action, created_at) met with a stream of events (event_id, at).

    Feedback may come before its event: it waits until the event's stream is so far beyond it, then goes out as a dead
    letter with a reason. Events are remembered for keep. Actions outside the closed list go out at once.
    """
    left = log.withWatermark("created_at", delay).alias("f")
    right = events.select(F.col("event_id").alias("known"), "at").withWatermark("at", delay)
    near = (F.col("f.event_id") == F.col("known")) & (F.col("at") >= F.expr(f"created_at - interval {keep}")) & (F.col("at") <= F.expr(f"created_at + interval {wait}"))
    reason = F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action").when(F.col("known").isNull(), "unknown event")
    return left.join(right, near, "left_outer").select("id", "event_id", "action", "created_at", reason.alias("reason"))


def _rises(step: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """A function of keyed state: snapshots wait until the watermark has passed the end of their step of time; then all that are ready are taken in order, and the last one's stars stay. A key has one timeout, at the first end that it waits for."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, before = state.get if state.exists else ([], [], [], None)
        held = [list(zip(*held))]
        for frame in rows:  # frame by frame: a key's rows are not put together
            at = frame["captured_at"].astype("datetime64[us]").astype("int64")
            held.append(list(zip(at.tolist(), frame["id"].tolist(), frame["stars"].tolist())))
        passed, ready, rest, out = state.getCurrentWatermarkMs(), [], [], []
        for r in itertools.chain(*held):
            (ready if (r[0] // (1000 * step) + 1) * step <= passed else rest).append(r)
        for at, i, stars in sorted(ready):
            if before is not None and stars > before:
                out.append((key[0], at, i, stars - before, stars))
            before = stars
        state.update((*([r[c] for r in rest] for c in range(3)), before))
        if rest:
            state.setTimeoutTimestamp((min(r[0] for r in rest) // (1000 * step) + 1) * step - 1)
        if out:
            frame = pd.DataFrame(out, columns=["repo", "captured_at", "id", "gained", "stars"])
            yield frame.assign(captured_at=frame["captured_at"].astype("int64").astype("datetime64[us]"))

    return run


def star_velocity(snapshots: DataFrame, delay: str = "1 day", step: str = "1 hour") -> DataFrame:
    """Rises of each repository's stars against the snapshot before it by time and id, whatever the order in which snapshots come within the delay; later ones are left out.

    A snapshot goes out once the watermark has passed the end of its step.
    """
    milliseconds = int(pd.Timedelta(step) / pd.Timedelta("1ms"))
    rows = snapshots.withWatermark("captured_at", delay).groupBy("repo")
    return rows.applyInPandasWithState(_rises(milliseconds), "repo long, captured_at timestamp, id long, gained long, stars long", "at array<long>, id array<long>, stars array<long>, last long", "append", GroupStateTimeout.EventTimeTimeout)


def assign_batches(spark: SparkSession, folder: str, threshold: float = DEFAULTS.threshold) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds event_id to items (id, at, content_hash, vec) and stores them under folder, one partition a batch.

    New items are compared with stored and new ones, stored ones keep their events; items of a batch must not be earlier
    than stored ones. A batch that is run again looks only at the batches before it and takes its own partition's place,
    so nothing is stored twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        schema = f"{kinds}, event_id long, batch long"
        batch = staged(batch, "batch")
        try:
            known = spark.read.schema(schema).parquet(folder).where(F.col("batch") < number)
        except AnalysisException:  # the first batch
            known = spark.createDataFrame([], schema)
        found = assign_new(batch, known, threshold)
        out = batch.join(found, "id").withColumn("batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(folder)

    return run


STORE = "spark.sql.streaming.stateStore.providerClass"


def drained(stream: DataFrame, name: str, mode: str = "append", arrivals: Sequence[Callable[[], None]] = (), each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over all there is, and once more after each arrival, with the RocksDB state store; returns what it wrote, as a table in the shared folder. Complete and update modes keep the last batch's rows. With each, batches go to it and nothing is returned."""
    spark: SparkSession = stream.sparkSession
    out, at = new_path(spark, name), new_path(spark, f"{name}-progress")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for arrival in (lambda: None, *arrivals):
            arrival()
            writer = stream.writeStream.option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True)
            if each is not None:
                query = writer.foreachBatch(each).start()
            elif mode == "append":
                query = writer.format("parquet").option("path", out).start()
            else:
                query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
            query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(out) if each is None else None
