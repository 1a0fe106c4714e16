"""Load and transfer reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a rank: a transfer to a rank costs its largest part's bytes for each.
RANK = 64


def rank_xfer_cost(per_part: DataFrame, rank: int = RANK) -> DataFrame:
    """One row: bytes that a transfer by ranks costs, bytes asked for, and their share in percent. per_part: part, bytes."""
    ranks = per_part.groupBy(F.floor(F.col("part") / rank).alias("rank")).agg(F.max("bytes").alias("most"), F.sum("bytes").alias("asked"))
    out = ranks.agg(F.coalesce(F.sum(F.col("most") * rank), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.sum("asked"), F.lit(0)).cast("long").alias("effective_bytes"))
    return out.withColumn("efficiency", F.when(F.col("total_bytes") > 0, F.col("effective_bytes") * 100 / F.col("total_bytes")).otherwise(0.0))


def xfer_stats(log: DataFrame) -> DataFrame:
    """Per symbol and epoch, and per symbol (epoch -1): transfers, bytes, average and efficiency. log: symbol, epoch, total_bytes, effective_bytes."""
    sums = log.rollup("symbol", "epoch").agg(F.grouping_id().alias("g"), F.count("*").alias("count"), F.sum("total_bytes").alias("total"), F.sum("effective_bytes").alias("effective"))
    return sums.where("g < 3").select(
        "symbol",
        F.when(F.col("g") == 1, -1).otherwise(F.col("epoch")).cast("int").alias("epoch"),
        "count",
        "total",
        "effective",
        F.when(F.col("count") > 0, F.floor(F.col("total") / F.col("count"))).otherwise(0).cast("long").alias("average"),
        F.when(F.col("total") > 0, F.col("effective") * 100 / F.col("total")).otherwise(0.0).alias("efficiency"),
    )


def distribution(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Per batch and part its requests, its rows and those of its largest fragment, and per batch (part -1) their maxima. requests: batch_id, part, n; rows: part, n_rows of each fragment."""
    held = rows.groupBy("part").agg(F.sum("n_rows").alias("kv"), F.max("n_rows").alias("largest"))
    own = requests.groupBy("batch_id", "part").agg(F.sum("n").alias("queries")).join(F.broadcast(held), "part", "left")
    top = own.groupBy("batch_id").agg(*(F.max(c).alias(c) for c in ("queries", "kv", "largest"))).withColumn("part", F.lit(-1))
    return own.select("batch_id", "part", "queries", "kv", "largest").unionByName(top)


def load_matrix(per_fragment: DataFrame, parts: int, seats: int) -> DataFrame:
    """A row per part 0 .. parts - 1 and a column per seat (seat_0 ..): what the fragment there has, 0 for an empty seat. per_fragment: part, seat, n."""
    every = per_fragment.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    sums = per_fragment.groupBy("part").agg(*(F.sum(F.when(F.col("seat") == s, F.col("n"))).alias(f"seat_{s}") for s in range(seats)))
    return every.join(sums, "part", "left").select("part", *(F.coalesce(f"seat_{s}", F.lit(0)).cast("long").alias(f"seat_{s}") for s in range(seats)))


def max_load(per_part: DataFrame) -> DataFrame:
    return per_part.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_n"))


def skew(per_part: DataFrame) -> DataFrame:
    """Largest load over the mean load."""
    return per_part.agg((F.max("n") / F.avg("n")).alias("skew"))


def tail_share(per_part: DataFrame, share: float = 0.1) -> DataFrame:
    """Share of all requests that the hottest parts of the given share take."""
    w = Window.orderBy(F.desc("n"), "part")
    parts = per_part.withColumn("r", F.row_number().over(w)).withColumn("c", F.count("*").over(Window.partitionBy()))
    return parts.agg((F.sum(F.when(F.col("r") <= F.ceil(F.col("c") * share), F.col("n"))) / F.sum("n")).alias("share"))


def batch_report(spark: SparkSession, steps: list[tuple[str, Callable[[], int]]]) -> DataFrame:
    """A row per step and a total: keys, seconds and keys a second. Each step returns its keys."""
    rows = []
    for name, run in steps:
        began = time.perf_counter()
        n = run()
        rows.append((name, n, time.perf_counter() - began))
    out = spark.createDataFrame(rows, "step string, num_keys long, seconds double")
    total = out.agg(F.lit("total").alias("step"), F.sum("num_keys").alias("num_keys"), F.sum("seconds").alias("seconds"))
    return out.unionByName(total).withColumn("throughput", F.when(F.col("seconds") > 0, F.col("num_keys") / F.col("seconds")).otherwise(0.0))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").csv(path, header=True)
