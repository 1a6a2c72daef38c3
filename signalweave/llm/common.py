"""What the operators of this subpackage share: written stages, count sketches and blocked keys."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.tables import new_path

#: A count sketch has this many counters, whatever the size of the corpus (16 MB as 32-bit integers).
SKETCH_BITS = 22
#: It travels in this many ranges, so that adding up is spread over tasks.
SKETCH_RANGES = 64


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by staged() that nothing needs any more."""
    if path := getattr(df, "staged_path", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside give their shuffle files up when they end, not when the driver collects their garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs as a written table in which every row has a number of its own, and the name of that column. Rows are told apart by it where ids are repeated or null."""
    row = fresh(docs, "row_id")[0]
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def quoted(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about limit bytes of a text column each, so that intermediate arrays stay small."""
    if not batch.num_rows:
        return
    sizes = batch.column(column)
    ends = np.cumsum(np.nan_to_num(pc.binary_length(sizes).to_numpy(zero_copy_only=False), nan=0.0))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # workers stay; what they have freed should not


class Sketch:
    """Counts of 64-bit hashes by their low SKETCH_BITS bits: never less than the true count. Its size is fixed."""

    def __init__(self) -> None:
        self.counts = np.zeros(1 << SKETCH_BITS, "u4")

    def add(self, hashes: np.ndarray, weight: int | np.ndarray = 1) -> None:
        np.add.at(self.counts, (hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype("i8"), weight)

    def blobs(self) -> list[tuple[int, bytes]]:
        return [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(np.split(self.counts, SKETCH_RANGES))]


def sketch_total(blobs: DataFrame) -> np.ndarray:
    """Adds up rows (part int, blob binary) of many sketches range by range; the fixed-size total comes to the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(blob), "u4").astype("u8")
                totals[part] = totals[part] + counts if part in totals else counts
        for part, counts in totals.items():
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "blob": pa.array([zlib.compress(np.minimum(counts, 2**32 - 1).astype("u4").tobytes(), 1)], pa.binary())})

    rows = blobs.select("part", "blob").repartition(parts(blobs.sparkSession), "part").mapInArrow(added, "part int, blob binary").collect()
    out = np.zeros(1 << SKETCH_BITS, "u4")
    width = len(out) // SKETCH_RANGES
    for r in rows:
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(zlib.decompress(r.blob), "u4")
    return out
