"""Workloads: raw key files, bulk-load series and skewed key generators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K

#: Keys preloaded by default.
INIT_KEYS = 60_000_000
#: Bytes of a raw key file that one row of work reads.
SPLIT_BYTES = 64 << 20


# --- raw key files: little-endian uint64, no header ------------------------------


def _open(path: str):
    """A file of a Hadoop path, opened by Arrow; an error where Arrow has no such file system."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    system, at = fs.FileSystem.from_uri(f"{scheme}://{rest}" if scheme == "file" and not rest.startswith("//") else path)
    return system.open_input_file(at)


def read_keys(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, seq (from 0 in each file) and key DECIMAL(20,0) of raw key files.

    A short rest at the end of a file is left out. Files are read in splits of
    about split_bytes by Arrow's file systems; on others (of the first file's
    scheme) each file is one row and one task.
    """
    split = max(8, split_bytes // 8 * 8)
    schema = "file string, seq long, bits long"

    def keys(name: str, first: int, data: bytes) -> Iterator[pd.DataFrame]:
        k = np.frombuffer(data, "<u8", len(data) // 8)
        for at in range(0, len(k), 1 << 16):
            part = k[at : at + (1 << 16)]
            yield pd.DataFrame({"file": name, "seq": np.arange(first + at, first + at + len(part)), "bits": part.view(np.int64)})

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, at, n in zip(b["path"], b["at"], b["n"], strict=True):
                with _open(name) as f:
                    f.seek(int(at))
                    yield from keys(name, int(at) // 8, f.read(int(n)))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                yield from keys(name, 0, data)

    files = spark.read.format("binaryFile").load(path)
    known = files.select("path").first()
    try:
        if known:
            _open(known.path).close()
    except (OSError, ValueError):
        raw = files.select("path", "content").mapInPandas(whole, schema)
    else:
        # Names and lengths only: contents aren't read here.
        at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long")))
        splits = files.select("path", "length", at.alias("at")).select("path", "at", F.least(F.col("length") - F.col("at"), F.lit(split)).alias("n")).where("n >= 8")
        raw = splits.repartition(F.col("path"), F.col("at")).mapInPandas(ranges, schema)
    return raw.select("file", "seq", K.unsigned(F.col("bits")).alias("key"))


def write_keys(df: DataFrame, key: str, path: str) -> None:
    """Raw key files, one per partition, in a folder on a file system that executors mount at `path`."""
    import os

    os.makedirs(path, exist_ok=True)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        to = os.path.join(path, f"part-{TaskContext.get().partitionId():05d}.bin")
        n = 0
        with open(f"{to}.{TaskContext.get().attemptNumber()}", "wb") as out:
            for b in batches:
                out.write(b["k"].to_numpy(np.int64).tobytes())
                n += len(b)
        os.replace(out.name, to)
        yield pd.DataFrame({"n": [n]})

    df.select(K.signed(F.col(key)).alias("k")).mapInPandas(put, "n long").agg(F.sum("n")).collect()


# --- bulk load -----------------------------------------------------------------


def bulk_load(fmap: DataFrame, n: int, key_max: int = K.KEY_MAX) -> DataFrame:
    """frag_id, key, value (= key): multiples of key_max div n, dealt to the fragments that hold them."""
    step = key_max // n
    start = K.align_up(F.col("lb"), step)
    ub = F.col("ub").cast("decimal(20,0)")
    many = F.when(start <= ub, F.floor((K.wide(ub) - K.wide(start)) / K.wide(step)) + 1).otherwise(0).cast("long")
    own = fmap.select("frag_id", start.alias("start"), many.alias("many")).where("many > 0")
    rows = own.select("frag_id", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("i"))
    return rows.select("frag_id", (K.wide(F.col("start")) + K.wide(F.col("i")) * K.wide(step)).cast("decimal(20,0)").alias("key")).withColumn("value", F.col("key"))


# --- skew ----------------------------------------------------------------------


def zipf_constants(n: int, theta: float) -> dict[str, float]:
    """Constants of the inverse of the Zipf distribution over n ranks."""
    if theta == 1:
        raise ValueError("theta 1 has no inverse of this form")
    zeta = math.fsum(1 / i**theta for i in range(1, n + 1))
    zeta2 = 1 + 0.5**theta
    return {"zeta": zeta, "alpha": 1 / (1 - theta), "eta": (1 - (2 / n) ** (1 - theta)) / (1 - zeta2 / zeta), "two": zeta2}


def zipf_rank(u: Column, n: int, theta: float, base: int = 0) -> Column:
    """Rank 0 .. n - 1 of a number in (0, 1)."""
    c = zipf_constants(n, theta)
    far = F.least(F.floor(F.lit(float(n)) * F.pow(F.lit(c["eta"]) * u - F.lit(c["eta"]) + 1, F.lit(c["alpha"]))), F.lit(n - 1))
    return F.when(u * c["zeta"] < 1, F.lit(0)).when(u * c["zeta"] < c["two"], F.lit(1)).otherwise(F.lit(base) + far).cast("long")


def zipf_keys(spark: SparkSession, count: int, ranges: int, theta: float, seed: int = 0, scrambled: bool = False, key_max: int = K.KEY_MAX) -> DataFrame:
    """seq, which_range and key of `count` requests: a Zipf range, and a place in it."""
    rank = zipf_rank(K.unit(F.col("id"), seed), ranges, theta)
    width = key_max // ranges
    rows = spark.range(count).select(F.col("id").alias("seq"), (K.scramble(rank, 0, ranges) if scrambled else rank).alias("which_range"))
    inside = K.fnv_hash(F.col("seq") + F.lit(seed)) % F.lit(str(width)).cast("decimal(20,0)")
    return rows.withColumn("key", (K.wide(F.col("which_range")) * K.wide(width) + K.wide(inside)).cast("decimal(20,0)"))


def zipf_histogram(keys: DataFrame) -> DataFrame:
    """Requests of each range and their share in percent."""
    n = keys.groupBy("which_range").agg(F.count("*").alias("n"))
    total = keys.count()
    return n.select("which_range", "n", (F.col("n") * 100 / F.lit(total)).alias("percent"))
