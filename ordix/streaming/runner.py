"""Micro-batches over a versioned index: each batch writes what it changes, and no more.

A version is either a whole index (`whole=<batch id>`) or the changes of a batch,
a row per key that it touches (`v=<batch id>`). Version b is the last whole one at
or before b and the changes after it, of which the latest of a key wins. After
COMPACT changes the next one is made whole. A batch that is run again writes the
same folder anew, so a restart is harmless. Batch b + 1 sees batch b.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import OrderedIndex, last_wins

#: Changes that a reader joins with a whole index at most.
COMPACT = 16


class Snapshots:
    """Versions of an index under one path, on any file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str, key: str, payload: list[str], compact: int = COMPACT):
        self.spark, self.path, self.key, self.payload, self.compact = spark, path.rstrip("/"), key, payload, compact

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        return top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), top

    def _held(self, kind: str) -> list[int]:
        """Finished folders of a kind, ascending."""
        fs, top = self._fs()
        if not fs.exists(top):
            return []
        out = []
        for s in fs.listStatus(top):
            m = re.fullmatch(kind + r"=(-?\d+)", s.getPath().getName())
            if m and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                out.append(int(m[1]))
        return sorted(out)

    def versions(self) -> list[int]:
        """Finished versions, ascending; those before the first whole one can't be read and aren't listed."""
        whole = self._held("whole")
        return sorted({*whole, *(v for v in self._held("v") if v > whole[0])}) if whole else []

    def write(self, df: DataFrame, version: int) -> None:
        """A whole index as a version."""
        df.select(self.key, *self.payload).write.mode("overwrite").parquet(f"{self.path}/whole={version}")

    def change(self, batch: DataFrame, seq: str, version: int) -> None:
        """The last arrival of each key of a batch as a version; the first version, and every one after `compact` changes, is whole."""
        whole = [v for v in self._held("whole") if v < version]
        changes = [v for v in self._held("v") if whole and whole[-1] < v < version]
        if whole and len(changes) < self.compact:
            last = last_wins(batch, self.key, self.payload, seq)
            last.select(self.key, *(F.col(f"__v.{c}").alias(c) for c in self.payload)).write.mode("overwrite").parquet(f"{self.path}/v={version}")
            return
        old = self.before(version) or OrderedIndex(self.spark.createDataFrame([], batch.select(self.key, *self.payload).schema), self.key, self.payload)
        self.write(old.upsert(batch, seq), version)

    def before(self, version: int) -> OrderedIndex | None:
        """The index as the batch `version` finds it."""
        whole = [v for v in self._held("whole") if v < version]
        if not whole:
            return None
        base = self.spark.read.parquet(f"{self.path}/whole={whole[-1]}")
        changes = [v for v in self._held("v") if whole[-1] < v < version]
        if changes:
            each = [self.spark.read.schema(base.schema).parquet(f"{self.path}/v={v}").withColumn("__b", F.lit(v).cast("long")) for v in changes]
            late = last_wins(reduce(DataFrame.unionByName, each), self.key, self.payload, "__b")
            late = late.select(self.key, *(F.col(f"__v.{c}").alias(c) for c in self.payload))
            base = base.join(late.select(self.key), self.key, "left_anti").unionByName(late)
        return OrderedIndex(base, self.key, self.payload)

    def latest(self) -> OrderedIndex | None:
        held = self.versions()
        return self.before(held[-1] + 1) if held else None

    def prune(self, keep: int = 2) -> None:
        """Drops all but the last versions; the oldest that stays is made whole."""
        kept = self.versions()[-keep:]
        if not kept:
            return
        if kept[0] not in self._held("whole"):
            self.write(self.before(kept[0] + 1).df, kept[0])
        fs, _ = self._fs()
        for kind, most in (("v", kept[0]), ("whole", kept[0] - 1)):
            for v in self._held(kind):
                if v <= most:
                    fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={v}"), True)


def upsert_batch(snapshots: Snapshots, seq: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that makes version `batch id` of the index."""

    def run(batch: DataFrame, batch_id: int) -> None:
        snapshots.change(batch, seq, batch_id)

    return run


def run_upserts(stream: DataFrame, snapshots: Snapshots, seq: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream of (key, payload, seq) against the snapshots, over all that is there now."""
    return stream.writeStream.foreachBatch(upsert_batch(snapshots, seq)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_gets(stream: DataFrame, snapshots: Snapshots, on: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a stream of probes, each batch against the latest snapshot."""

    def run(batch: DataFrame, batch_id: int) -> None:
        index = snapshots.latest()
        if index is not None:
            sink(index.get(batch, on), batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Extension: requests per window of event time and key, with rows later than `late` left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
