"""Batches of a request stream: slices, segments of a batch, and slots in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fragments

#: Requests in a batch.
BATCH = 100_000


def numbered(df: DataFrame, order: list[str], name: str = "seq", cells: int | None = None) -> DataFrame:
    """df with positions 0, 1, ... by `order`, columns of any orderable types.

    The rows are cut in as many cells as their number asks for, at sampled tuples
    of all columns of `order`; positions inside a cell come from a window of the
    cell, those before it from the cells' counts. Ties are numbered in any order.
    """
    rows = df.count()
    cells = cells or fragments.cells(rows)
    cell = fragments.locate_rows(order, fragments.row_bounds(df, order, rows, cells))
    held = df.groupBy(cell.alias("__c")).count()
    before = held.select("__c", (F.sum("count").over(Window.orderBy("__c")) - F.col("count")).alias("__b"))
    inside = F.row_number().over(Window.partitionBy("__c").orderBy(*order))
    return df.withColumn("__c", cell).withColumn("__r", inside).join(F.broadcast(before), "__c").withColumn(name, (F.col("__b") + F.col("__r") - 1).cast("long")).drop("__c", "__r", "__b")


def batch_slices(requests: DataFrame, seq: str = "seq", batch: int = BATCH, limit: int | None = None) -> DataFrame:
    """Requests with batch_id; with a limit, whole batches until at least so many requests."""
    out = requests.withColumn("batch_id", F.floor(F.col(seq) / batch).cast("long"))
    return out if limit is None else out.where(F.col(seq) < -(-limit // batch) * batch)


def prefix_end_index(routed: DataFrame) -> DataFrame:
    """Per part and seat: requests, and where the seat's segment of the part's buffer ends."""
    counts = routed.where("frag_id IS NOT NULL").groupBy("part", "seat").agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.partitionBy("part").orderBy("seat").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("end_idx", end.cast("long"))


def request_slots(routed: DataFrame, seq: str = "seq", cells: int | None = None) -> DataFrame:
    """Each request's slot in its part's buffer: its seat's start, then arrival order.

    Arrivals are cut in cells, so that a hot seat is many windows; starts come
    from the counts of each part, seat and cell.
    """
    own = routed.where("frag_id IS NOT NULL")
    if cells is None:
        cells = fragments.cells(own.count())
    cell = fragments.locate(F.col(seq), fragments.bounds(own, seq, cells))
    own = own.withColumn("__c", cell)
    counts = own.groupBy("part", "seat", "__c").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("seat", "__c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = counts.select("part", "seat", "__c", before.alias("__s"))
    at = F.row_number().over(Window.partitionBy("part", "seat", "__c").orderBy(seq)) - 1
    return own.withColumn("__r", at).join(starts, ["part", "seat", "__c"]).withColumn("slot", (F.col("__s") + F.col("__r")).cast("long")).drop("__s", "__r", "__c")


def equal_slices(df: DataFrame, n: int, slices: int, seq: str = "seq") -> DataFrame:
    """slice i holds positions [n*i/slices, n*(i+1)/slices), n rows in all."""
    return df.withColumn("slice", F.floor(((F.col(seq) + 1) * slices - 1) / F.lit(max(n, 1))).cast("long"))


def tasklet_slices(df: DataFrame, n: int, tasklets: int, seq: str = "seq") -> DataFrame:
    """n div tasklets rows to each tasklet, the rest to the last."""
    q = n // tasklets
    at = F.least(F.floor(F.col(seq) / q), F.lit(tasklets - 1)) if q else F.lit(tasklets - 1)
    return df.withColumn("tasklet", at.cast("long"))
