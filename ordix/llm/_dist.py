"""Shared tables, bounded vectors and session settings of the llm operators."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch; slices by bytes are cut from these. A row may be larger than a batch.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Gives the executors this package, once an application: they needn't have it installed."""
    if spark.sparkContext.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="ordix-"), f"{top.name}.zip")  # served to executors for as long as the driver lives
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(spark.sparkContext.applicationId)


def prepare(spark: SparkSession) -> None:
    """The package on the executors, and Arrow batches small enough that very long texts don't fill a worker."""
    _ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """A column name made of `name` that df doesn't have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ordix-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Kept:
    """A table written to the shared folder: it cuts lineage and survives lost executors.

    Tables that back a returned DataFrame stay until clear(), as only the caller
    knows when it has been read.
    """

    held: dict[str, Kept] = {}

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/ordix-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)
        Kept.held[self.path] = self

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        Kept.held.pop(self.path, None)


def clear() -> None:
    """Drops every table that is still kept: DataFrames that the operators returned can't be read any more."""
    for x in list(Kept.held.values()):
        x.drop()


def release(spark: SparkSession) -> None:
    """Lets Spark clean the shuffles of what is written already; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized(total: int, least: int, most: int) -> int:
    """Keys of a chunk that a task sends, or of a bucket that one judges, of an exchange of `total` keys.

    A chunk sends each bucket one row of its keys. With both sizes in proportion
    to the root of the total, the number of rows grows like that of keys, not
    like its square; beyond `most` rows hold fewer keys, and never are there more
    rows than keys.
    """
    return min(max(least, 32 * math.isqrt(max(0, int(total)))), most)


def summed(vectors: DataFrame, length: int, op: np.ufunc = np.add) -> np.ndarray:
    """Adds (or joins by op, to which 0 is neutral) int64 vectors (one binary column `v` of `length` numbers) in two levels.

    Each task streams its vectors through one accumulator, so memory is one
    vector; the driver gets one.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for b in batches:
            for v in b.column(0):
                op(total, np.frombuffer(v.as_buffer(), np.int64), out=total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    n = max(1, math.isqrt(vectors.sparkSession.sparkContext.defaultParallelism * 16))
    rows = vectors.repartition(n).mapInArrow(add, "v binary").repartition(1).mapInArrow(add, "v binary").collect()
    out = np.zeros(length, np.int64)
    for r in rows:
        op(out, np.frombuffer(r.v, np.int64), out=out)
    return out
