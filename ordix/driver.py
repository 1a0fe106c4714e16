"""The batch driver: a request stream against an index, batch by batch, with a rebalance before each and a report after.

    python -m ordix.driver --index DIR --requests DIR --operation get --batch 100000 --moves 5 --out DIR
    python -m ordix.driver --generate DIR --requests-wanted 1000000 --theta 0.99 --ranges 2500
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys as K
from .operators import batching, fragments, metrics
from .operators.index import OrderedIndex
from .plans import maintenance
from .sources import workload

OPERATIONS = ("get", "succ", "insert")


@dataclass(frozen=True)
class Options:
    """operation: get, succ or insert. limit: whole batches until at least so many requests. moves: of a rebalance, 0 for none."""

    operation: str = "get"
    batch: int = batching.BATCH
    limit: int | None = None
    moves: int = 5
    parts: int = 64

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise ValueError(f"operation {self.operation!r} is none of {', '.join(OPERATIONS)}")


def run(index: OrderedIndex, requests: DataFrame, fmap: DataFrame, options: Options, sink: Callable[[DataFrame, int], object], on_map: Callable[[DataFrame, DataFrame, int], object] | None = None) -> DataFrame:
    """Runs every batch of requests (seq, key, and the payload for insert) and returns the report.

    The sink gets each batch's result, for insert the index after it, and decides
    where it goes; it should write it, as the seconds reported are those it takes.
    A DataFrame that it returns after an insert is the index that the next batch
    finds; without one the changes are computed anew for each batch.
    on_map sees loads and map of each batch. Report: batch_num, num_keys,
    max_queries (of a part), moves, seconds of counting, planning and execution,
    and throughput; a row per batch, and one of batch_num -1 for all.
    """
    spark = requests.sparkSession
    sliced = batching.batch_slices(requests, batch=options.batch, limit=options.limit)
    numbers = [r.batch_id for r in sliced.select("batch_id").distinct().orderBy("batch_id").collect()]
    rows = []
    for nth, b in enumerate(numbers):
        own = sliced.where(F.col("batch_id") == b).drop("batch_id")
        began = time.perf_counter()
        loads = spark.createDataFrame(fragments.requests_per_fragment(own, fmap).collect(), "frag_id int, part int, seat int, n long")
        counted = time.perf_counter()
        before, moved = fmap, 0
        if nth and options.moves:  # the first batch finds the map as it is
            # The map is a row per fragment: collected, so that plans don't grow from batch to batch.
            fmap = spark.createDataFrame(maintenance.rebalance(spark, fmap, loads, options.parts, options.moves).collect(), before.schema)
            moved = fmap.join(before, ["frag_id", "part", "seat"], "left_anti").count()
        planned = time.perf_counter()
        if on_map:
            on_map(loads, fmap, b)
        if options.operation == "insert":
            result = index.upsert(own, "seq")
        else:
            result = getattr(index, options.operation)(own.select("seq", "key"), "key")
        written = sink(result, b)
        if options.operation == "insert":
            index = OrderedIndex(written if isinstance(written, DataFrame) else result, index.key, index.payload)
        done = time.perf_counter()
        per_part = fragments.requests_per_part(loads.drop("part").join(fmap, "frag_id")).agg(F.sum("n"), F.max("n")).first()
        rows.append((b, per_part[0] or 0, per_part[1] or 0, moved, counted - began, planned - counted, done - planned))
    out = spark.createDataFrame(rows, "batch_num long, num_keys long, max_queries long, moves int, count_seconds double, plan_seconds double, execution_seconds double")
    total = out.agg(F.lit(-1).cast("long").alias("batch_num"), F.sum("num_keys").alias("num_keys"), F.max("max_queries").alias("max_queries"), F.sum("moves").cast("int").alias("moves"), *(F.sum(f"{c}_seconds").alias(f"{c}_seconds") for c in ("count", "plan", "execution")))
    seconds = F.col("count_seconds") + F.col("plan_seconds") + F.col("execution_seconds")
    return out.unionByName(total).withColumn("throughput", F.when(seconds > 0, F.col("num_keys") / seconds).otherwise(0.0))


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("--index", help="Parquet folder of key and value")
    a.add_argument("--requests", help="Parquet folder of seq and key (and value), or raw key files (*.bin)")
    a.add_argument("--out", help="folder of the results, a folder per batch; none: they are computed and thrown away")
    a.add_argument("--report", help="CSV folder of the report")
    a.add_argument("-o", "--operation", choices=OPERATIONS, default="get")
    a.add_argument("-b", "--batch", type=int, default=batching.BATCH)
    a.add_argument("-n", "--limit", type=int)
    a.add_argument("-m", "--moves", type=int, default=5)
    a.add_argument("--parts", type=int, default=64)
    a.add_argument("--trees", type=int, default=12)
    a.add_argument("-q", "--print-load", action="store_true", help="print the requests of each part and seat")
    a.add_argument("--generate", help="write a skewed workload of raw key files to this folder and end")
    a.add_argument("--requests-wanted", type=int, default=100_000_000)
    a.add_argument("-a", "--theta", type=float, default=0.99)
    a.add_argument("-e", "--ranges", type=int, default=2500)
    a.add_argument("-s", "--scramble", action="store_true")
    x = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if x.generate:
        workload.write_keys(workload.zipf_keys(spark, x.requests_wanted, x.ranges, x.theta, scrambled=x.scramble), "key", x.generate)
        return
    if not x.index or not x.requests:
        a.error("--index and --requests are needed")
    index = OrderedIndex(spark.read.parquet(x.index), "key", ["value"])
    requests = workload.read_keys(spark, x.requests) if x.requests.endswith(".bin") else spark.read.parquet(x.requests)
    if "value" not in requests.columns:
        requests = requests.withColumn("value", F.col("key")) if x.operation == "insert" else requests
    top = index.df.agg(F.max("key")).first()[0]
    fmap = fragments.equi_width(spark, x.parts, x.trees, int(top) if top is not None else K.KEY_MAX)

    def sink(df: DataFrame, b: int) -> DataFrame | None:
        if not x.out:
            df.write.format("noop").mode("overwrite").save()
            return None
        df.write.mode("overwrite").parquet(f"{x.out}/batch={b}")
        return spark.read.parquet(f"{x.out}/batch={b}")

    show = (lambda loads, _, b: metrics.load_matrix(loads, x.parts, fragments.SEATS).orderBy("part").show(x.parts, truncate=False)) if x.print_load else None
    report = run(index, requests, fmap, Options(x.operation, x.batch, x.limit, x.moves, x.parts), sink, show)
    if x.report:
        metrics.write_report(report, x.report)
    report.orderBy("batch_num").show(1000, truncate=False)


if __name__ == "__main__":
    main()
