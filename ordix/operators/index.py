"""An ordered index over a DataFrame: batched lookups, successors, ranges and upserts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fragments import bounds, cells, locate

#: An index of at most so many rows may be broadcast.
SMALL_ROWS = 100_000


class OrderedIndex:
    """Unique keys and their payload.

    key: name of the key column (any orderable type, no nulls); payload: other
    columns to keep. Probes are DataFrames with a key column and whatever else;
    all their columns and rows come back, in any order.
    """

    def __init__(self, df: DataFrame, key: str, payload: list[str], group: str | None = None):
        self.key, self.payload, self.group = key, payload, group
        keep = ([group] if group else []) + [key, *payload]
        self.df = df.select(*keep).where(F.col(key).isNotNull())

    # --- equality -------------------------------------------------------------

    def _named(self) -> DataFrame:
        return self.df.select(F.col(self.key).alias("__k"), F.lit(True).alias("__found"), *(F.col(c).alias(f"__{c}") for c in self.payload))

    def get(self, probes: DataFrame, on: str, compat_zero: bool = False) -> DataFrame:
        """Each probe with found and the payload; a miss has nulls, or zeros when compat_zero."""
        out = probes.join(self._named(), F.col(on) == F.col("__k"), "left")
        value = {c: F.coalesce(f"__{c}", F.lit(0)) if compat_zero else F.col(f"__{c}") for c in self.payload}
        return out.select(*probes.columns, F.coalesce("__found", F.lit(False)).alias("found"), *(v.alias(c) for c, v in value.items()))

    def semi(self, probes: DataFrame, on: str) -> DataFrame:
        return probes.join(self.df.select(F.col(self.key).alias("__k")), F.col(on) == F.col("__k"), "left_semi")

    def anti(self, probes: DataFrame, on: str) -> DataFrame:
        return probes.join(self.df.select(F.col(self.key).alias("__k")), F.col(on) == F.col("__k"), "left_anti")

    # --- order ----------------------------------------------------------------

    def succ(self, probes: DataFrame, on: str, fragments: int | None = None) -> DataFrame:
        """Each probe with the smallest index key strictly above it, as succ_<key> and succ_<payload>."""
        return self._neighbour(probes, on, True, fragments)

    def pred(self, probes: DataFrame, on: str, fragments: int | None = None) -> DataFrame:
        """Each probe with the largest index key strictly below it, as pred_<key> and pred_<payload>."""
        return self._neighbour(probes, on, False, fragments)

    def _neighbour(self, probes: DataFrame, on: str, up: bool, fragments: int | None) -> DataFrame:
        """Distinct probe keys and index rows meet in a window of each fragment.

        Probe keys are made distinct first, so that a key however often probed is
        one row in its window. Fragments cut index and probe keys together at
        quantiles, as many as their rows ask for; the answer of
        a probe past the last index key of its fragment is the first of the next
        fragment that isn't empty, found over one row per fragment. Windows run
        from the current row backwards in a reversed sort, which is linear.
        """
        name = "succ" if up else "pred"
        value = F.struct(F.col(self.key).alias("k"), *(F.col(c).alias(c) for c in self.payload))
        own = [self.group] if self.group else []
        keys = probes.where(F.col(on).isNotNull()).select(*own, F.col(on).alias("k")).distinct()
        index = self.df.select(*own, F.col(self.key).alias("k"), value.alias("v"))
        frag: Column = F.lit(0)
        if not self.group:
            frag, fragments = self._cut(index, keys, fragments)
        rows = index.withColumn("p", F.lit(False)).unionByName(keys.withColumn("v", F.lit(None).cast(index.schema["v"].dataType)).withColumn("p", F.lit(True))).withColumn("f", frag)
        # Probes come before the index row of the same key, so it isn't found: strict.
        order = [F.desc("k") if up else F.asc("k"), F.desc("p")]
        seen = F.last("v", ignorenulls=True).over(Window.partitionBy(*own, "f").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        answered = rows.withColumn("a", seen).where("p").drop("p", "v")
        if not self.group:
            edge = (F.min_by if up else F.max_by)("v", "k")
            first = index.withColumn("f", frag).groupBy("f").agg(edge.alias("e"))
            every = self.df.sparkSession.range(max(1, fragments)).select(F.col("id").cast("int").alias("f")).join(first, "f", "left")
            beyond = F.last("e", ignorenulls=True).over(Window.orderBy(F.desc("f") if up else F.asc("f")).rowsBetween(Window.unboundedPreceding, -1))
            answered = answered.join(F.broadcast(every.select("f", beyond.alias("e"))), "f", "left").withColumn("a", F.coalesce("a", "e")).drop("e")
        answered = answered.select(*(F.col(g).alias("__g") for g in own), F.col("k").alias("__k"), "a")
        same = F.col(on) == F.col("__k")
        out = probes.join(answered, same & F.col(self.group).eqNullSafe(F.col("__g")) if own else same, "left")
        return out.select(*probes.columns, F.col("a.k").alias(f"{name}_{self.key}"), *(F.col(f"a.{c}").alias(f"{name}_{c}") for c in self.payload))

    def _cut(self, index: DataFrame, keys: DataFrame, fragments: int | None) -> tuple[Column, int]:
        """The fragment of a key `k`, and how many fragments index and probe keys are cut in."""
        both = index.select("k").unionByName(keys.select("k"))
        if fragments is None:
            fragments = cells(both.count())
        return locate(F.col("k"), bounds(both, "k", fragments)), fragments

    def succ_small(self, probes: DataFrame, on: str) -> DataFrame:
        """succ for an index of at most SMALL_ROWS BIGINT keys: a binary search in a broadcast array."""
        rows = self.df.select(self.key).orderBy(self.key).limit(SMALL_ROWS + 1).collect()
        if len(rows) > SMALL_ROWS:
            return self.succ(probes, on).select(*probes.columns, f"succ_{self.key}")
        known = self.df.sparkSession.sparkContext.broadcast(np.array([r[0] for r in rows], np.int64))

        @F.pandas_udf("long")
        def above(k: pd.Series) -> pd.Series:
            have = known.value
            at = np.searchsorted(have, k.fillna(0).to_numpy(np.int64), side="right")
            ok = (at < len(have)) & k.notna().to_numpy()
            return pd.Series(np.where(ok, have[np.minimum(at, max(0, len(have) - 1))] if len(have) else 0, 0), dtype="Int64").where(pd.Series(ok))

        return probes.withColumn(f"succ_{self.key}", above(F.col(on)))

    def scan(self, low=None, high=None) -> DataFrame:
        """Rows with low <= key <= high, in key order; the bounds reach the source's filters."""
        df = self.df
        if low is not None:
            df = df.where(F.col(self.key) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(self.key) <= F.lit(high))
        return df.orderBy(self.key)

    def tail(self, n: int) -> DataFrame:
        """The n rows of the largest keys, largest first."""
        return self.df.orderBy(F.desc(self.key)).limit(n)

    def range(self, probes: DataFrame, on: str, n: int, width: int) -> DataFrame:
        """For each probe its first n index rows with probe <= key < probe + width, numbered from 1.

        Keys and distinct probe keys meet in cells of `width` keys, so a probe key
        sees the rows of two cells, once however often it is probed, and the joins
        are on equality. Probes without such a row, or of null, have no rows.
        """
        asked = probes.where(F.col(on).isNotNull()).select(F.col(on).alias("__on")).distinct()
        index = self._named().drop("__found").withColumn("__c", F.floor(F.col("__k") / width))
        seen = asked.withColumn("__c", F.explode(F.array(F.floor(F.col("__on") / width), F.floor(F.col("__on") / width) + 1)))
        met = seen.join(index, "__c").where((F.col("__k") >= F.col("__on")) & (F.col("__k") < F.col("__on") + width))
        at = F.row_number().over(Window.partitionBy("__on").orderBy("__k"))
        first = met.withColumn("place", at.cast("long")).where(F.col("place") <= n)
        return probes.join(first, F.col(on) == F.col("__on")).select(*probes.columns, "place", F.col("__k").alias(self.key), *(F.col(f"__{c}").alias(c) for c in self.payload))

    def rank(self, probes: DataFrame, on: str, fragments: int | None = None) -> DataFrame:
        """Each probe with the number of index keys not above it: counts inside its fragment and of all before."""
        keys = probes.where(F.col(on).isNotNull()).select(F.col(on).alias("k")).distinct().withColumn("p", F.lit(1))
        index = self.df.select(F.col(self.key).alias("k"), F.lit(0).alias("p"))
        frag, fragments = self._cut(index, keys, fragments)
        rows = index.unionByName(keys).withColumn("f", frag)
        inside = F.sum(1 - F.col("p")).over(Window.partitionBy("f").orderBy("k", "p").rowsBetween(Window.unboundedPreceding, 0))
        held = index.withColumn("f", frag).groupBy("f").count()
        every = self.df.sparkSession.range(fragments).select(F.col("id").cast("int").alias("f")).join(held, "f", "left")
        before = F.sum("count").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1))
        counted = rows.withColumn("inside", inside).where("p = 1").join(F.broadcast(every.select("f", before.alias("before"))), "f", "left")
        answer = counted.select(F.col("k").alias("__k"), (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))
        return probes.join(answer, F.col(on) == F.col("__k"), "left").drop("__k")

    # --- change ---------------------------------------------------------------

    def upsert(self, batch: DataFrame, seq: str) -> DataFrame:
        """The index after a batch of (key, payload, seq): the last arrival of a key wins.

        The batch is reduced to a row per key before it meets the index.
        """
        last = last_wins(batch, self.key, self.payload, seq)
        new = last.select(F.col(self.key).alias("__k"), F.col("__v"))
        both = self.df.join(new, F.col(self.key) == F.col("__k"), "full_outer")
        return both.select(F.coalesce(self.key, "__k").alias(self.key), *(F.when(F.col("__v").isNotNull(), F.col(f"__v.{c}")).otherwise(F.col(c)).alias(c) for c in self.payload))

    def upsert_counts(self, batch: DataFrame) -> DataFrame:
        """One row: distinct keys inserted and updated by the batch, and its rows."""
        keys = batch.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("__k")).agg(F.count("*").alias("n"))
        met = keys.join(self.df.select(F.col(self.key).alias("__i")), F.col("__k") == F.col("__i"), "left")
        return met.agg(F.count(F.when(F.col("__i").isNull(), 1)).alias("inserted"), F.count("__i").alias("updated"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"))

    def delete(self, keys: DataFrame, on: str) -> DataFrame:
        """The index without the given keys."""
        return self.df.join(keys.select(F.col(on).alias("__k")).distinct(), F.col(self.key) == F.col("__k"), "left_anti")


def last_wins(batch: DataFrame, key: str, payload: list[str], seq: str) -> DataFrame:
    """A row per key: struct __v of the payload that came last by seq. Partial aggregation; no window."""
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*payload), seq).alias("__v"))
