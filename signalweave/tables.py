"""Tables of the model and written stages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: The system of record. All reads give these schemas; nothing is inferred.
SCHEMAS: dict[str, T.StructType] = {
    "source": _table(id=_L, name=_S, source_type=_S, url=_S, repo_owner=_S, repo_name=_S, arxiv_query=_S, enabled=_B, trust_level=_S, created_at=_TS, updated_at=_TS),
    "raw_item": _table(id=_L, source_id=_L, source_name=_S, source_type=_S, title=_S, url=_S, published_at=_TS, summary=_S, dedup_key=_S, content_hash=_S, event_id=_L, embedded=_B),
    "event": _table(id=_L, title=_S, representative_item_id=_L),
    "enriched_item": _table(event_id=_L, source_url=_S, category=_S, tags=T.ArrayType(_S), relevance=_I, novelty=_I, actionability=_I, strategic_potential=_I, hype=_I, summary=_S, why_it_matters=_S, connection_to_user_work=_S, recommended_action=_S, is_weak_signal=_B, horizon=_S, priority_class=_S, method=_S, projected=_B),
    "entity": _table(id=_L, name=_S, normalised_name=_S, type=_S),
    "relationship": _table(id=_L, subject_entity_id=_L, predicate=_S, object_entity_id=_L, ts=_TS, event_id=_L, raw_item_id=_L),
    "star_snapshot": _table(id=_L, repo_full_name=_S, stars=_L, captured_at=_TS),
    "feedback": _table(id=_L, event_id=_L, action=_S, created_at=_TS),
    "digest": _table(id=_L, period_start=_TS, period_end=_TS, content_md=_S, method=_S, item_count=_L, noise_count=_L, graphrag=_B, event_ids=T.ArrayType(_L), created_at=_TS),
    "item_vector": _table(item_id=_L, vec=T.ArrayType(_D), source=_S, published_at=_TS),
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def append(df: DataFrame, root: str, name: str) -> None:
    """Appends rows with the table's columns; keys are the caller's to guard (see intake.new_items)."""
    df.select(*SCHEMAS[name].fieldNames()).write.mode("append").parquet(f"{root}/{name}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """A folder below shared_dir() as tasks reach it without Spark: the file system and the path there."""
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+://|file:", folder) else (fs.LocalFileSystem(), folder)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


#: Rows of a task where few bytes a row grow to many in it.
TASK_ROWS = 500_000


def tasks_of(df: DataFrame) -> int:
    """As many tasks as hold TASK_ROWS rows of df each. Adaptive execution joins partitions by their bytes, so narrow rows that a join or an explode multiplies would be many in a task."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over tasks_of(df) tasks."""
    return df.repartition(tasks_of(df), *keys)


def dropped(df: DataFrame) -> None:
    """Deletes a table made by staged() that nothing needs any more."""
    if path := getattr(df, "staged_path", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
