"""Range fragments: bounds, the fragment map, routing and statistics.

A fragment map has one row per fragment, frag_id, lb, ub (inclusive), part and
seat, and tiles the key domain. It is metadata of a bounded size.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K

#: Seats of a part, as bits of one number.
SEATS = 20
#: Rows that one window task sorts, about, and how many such tasks there are at most: their bounds are literals of a plan.
CELL_ROWS, MOST_CELLS = 1_000_000, 10_000
#: Rows sampled for each bound of several columns.
SAMPLED = 20


def equi_width(spark: SparkSession, parts: int, trees: int, key_max: int = K.KEY_MAX) -> DataFrame:
    """parts * trees fragments of equal width over [0, key_max], `trees` neighbours to a part."""
    n = parts * trees
    nth = F.col("id") + 1
    kind = "long" if key_max < 2**63 else "decimal(20,0)"
    lb = F.when(F.col("id") == 0, F.lit(0).cast("decimal(20,0)")).otherwise(K.equi_width_ub(F.col("id"), n, key_max) + 1)
    return spark.range(n).select(
        F.col("id").cast("int").alias("frag_id"),
        lb.cast(kind).alias("lb"),
        K.equi_width_ub(nth, n, key_max).cast(kind).alias("ub"),
        F.floor(F.col("id") / trees).cast("int").alias("part"),
        (F.col("id") % trees).cast("int").alias("seat"),
    )


def bounds(df: DataFrame, key: str, n: int) -> list:
    """Keys that cut `key` into at most n fragments of about equal rows: n - 1 values on the driver, no more."""
    if n <= 1:
        return []
    got = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n).alias("b")).first().b
    return sorted(set(got or []))


def cells(rows: int) -> int:
    """How many cells so many rows are cut in."""
    return min(MOST_CELLS, max(1, -(-rows // CELL_ROWS)))


def row_bounds(df: DataFrame, order: list[str], rows: int, n: int) -> list[tuple]:
    """Tuples of the columns `order`, of any orderable types, that cut df's rows into about n equal cells.

    A sample of SAMPLED rows a cell comes to the driver. All columns are in the
    cut, so a value of the first that is on many rows is in several cells. Rows
    with a null in these columns sort first, as in a window.
    """
    if n <= 1:
        return []
    full = df.select(*order).dropna()
    got = full.sample(min(1.0, SAMPLED * n / max(1, rows)), 7).distinct().orderBy(*order).collect()
    return sorted({tuple(got[len(got) * k // n]) for k in range(1, n)}) if got else []


def locate_rows(order: list[str], cuts: list[tuple]) -> Column:
    """Number of cuts not above the row, by all columns of `order`; rows with a null are in the first cell."""
    if not cuts:
        return F.lit(0)
    names = [f"c{i}" for i in range(len(order))]
    key = F.struct(*(F.col(c).alias(x) for c, x in zip(order, names, strict=True)))
    null = F.greatest(*(F.col(c).isNull().cast("int") for c in order), F.lit(0)) == 1
    return F.when(null, 0).otherwise(locate(key, [F.struct(*(F.lit(v).alias(x) for v, x in zip(cut, names, strict=True))) for cut in cuts]))


def locate(key: Column, cuts: list) -> Column:
    """Number of cuts not above the key, in two levels so that 1000s of cuts cost tens of comparisons."""
    if not cuts:
        return F.lit(0)
    if any(isinstance(c, int) and c >= 2**63 for c in cuts):  # unsigned keys
        cuts = [F.lit(str(c)).cast("decimal(20,0)") for c in cuts]
    step = max(1, math.isqrt(len(cuts)))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*(F.lit(r[0]) for r in rows))
    row = F.array_size(F.filter(heads, lambda c: c <= key))
    table = F.array(*(F.array(*(F.lit(c) for c in r)) for r in rows))
    inside = F.array_size(F.filter(F.element_at(table, F.greatest(row, F.lit(1))), lambda c: c <= key))
    return F.when(row == 0, F.lit(0)).otherwise((row - 1) * step + inside).cast("int")


def equi_depth(df: DataFrame, key: str, parts: int, trees: int, key_max: int) -> DataFrame:
    """A fragment map whose fragments hold about equal rows of df."""
    spark = df.sparkSession
    cuts = bounds(df, key, parts * trees)
    lows = [0, *(c for c in cuts if c > 0)]
    rows = [(i, lo, (lows[i + 1] - 1) if i + 1 < len(lows) else key_max, i // trees, i % trees) for i, lo in enumerate(lows)]
    return spark.createDataFrame(rows, "frag_id int, lb long, ub long, part int, seat int")


def _collected(fmap: DataFrame) -> list:
    return fmap.select("frag_id", "ub").orderBy("ub").collect()


def placed(probes: DataFrame, fmap: DataFrame, key: str = "key", strict: bool = False) -> DataFrame:
    """probes with frag_id: the first fragment with ub >= key, or > key when strict; null past the last bound.

    The bounds are metadata on the driver; a row finds its place among them by
    two short scans, without a join.
    """
    rows = _collected(fmap)
    # cuts are the lowest keys that belong to the next fragment: ub + 1, or ub itself when strict
    cuts = [int(r.ub) if strict else int(r.ub) + 1 for r in rows]
    ids = F.array(*(F.lit(r.frag_id) for r in rows)) if rows else F.array().cast("array<int>")
    return probes.withColumn("frag_id", F.get(ids, locate(F.col(key), cuts)))


def route(probes: DataFrame, fmap: DataFrame, key: str = "key", strict: bool = False) -> DataFrame:
    """probes with frag_id, part and seat, by placed() and a join with the map by frag_id.

    A strict probe past the last bound has no fragment and stays, with nulls.
    """
    return placed(probes, fmap, key, strict).join(F.broadcast(fmap.select("frag_id", "part", "seat")), "frag_id", "left")


def place(ubs: list[int], key: int, strict: bool = False) -> int | None:
    """The same rule for one key on the driver."""
    i = bisect.bisect_right(ubs, key) if strict else bisect.bisect_left(ubs, key)
    return i if i < len(ubs) else None


def requests_per_fragment(probes: DataFrame, fmap: DataFrame | None = None, key: str = "key", strict: bool = False) -> DataFrame:
    """Requests of each fragment that has any; counted before the map is joined. Without a map, probes are routed already."""
    if fmap is None:
        return probes.where("frag_id IS NOT NULL").groupBy("frag_id", "part", "seat").agg(F.count("*").alias("n"))
    counts = placed(probes.select(key), fmap, key, strict).where("frag_id IS NOT NULL").groupBy("frag_id").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(fmap.select("frag_id", "part", "seat")), "frag_id").select("frag_id", "part", "seat", "n")


def requests_per_part(per_fragment: DataFrame, parts: int | None = None) -> DataFrame:
    """Requests of each part, from those of its fragments; with `parts`, of parts 0 .. parts - 1, empty ones too."""
    own = per_fragment.groupBy("part").agg(F.sum("n").alias("n"))
    return own if parts is None else _every(per_fragment.sparkSession, parts).join(own, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))


def _every(spark: SparkSession, parts: int) -> DataFrame:
    return spark.range(parts).select(F.col("id").cast("int").alias("part"))


def stats(index: DataFrame, fmap: DataFrame, key: str = "key") -> DataFrame:
    """Rows, least and largest key of every fragment; empty ones too."""
    held = placed(index.select(F.col(key).alias("key")), fmap).groupBy("frag_id").agg(F.count("*").alias("n_rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return fmap.join(held, "frag_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))


def hot_parts(per_part: DataFrame) -> DataFrame:
    """Parts by load, the heaviest first; ties by part. A window over one row per part."""
    return per_part.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "part")).cast("long"))


def seat_bitmap(fmap: DataFrame) -> DataFrame:
    """Used seats of each part as bits, and how many."""
    bits = fmap.groupBy("part").agg(F.expr("bit_or(shiftleft(1L, seat))").alias("used"))
    return bits.withColumn("n_used", F.bit_count("used").cast("long"))


def first_free_seat(fmap: DataFrame, seats: int = SEATS, parts: int | None = None) -> DataFrame:
    """The lowest seat of each part that no fragment has; null when all are taken. With `parts`, empty parts too."""
    used = fmap.groupBy("part").agg(F.collect_set("seat").alias("used"))
    if parts is not None:
        used = _every(fmap.sparkSession, parts).join(used, "part", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(0), F.lit(seats - 1)), lambda s: ~F.array_contains("used", s))
    return used.select("part", F.array_min(free).cast("int").alias("seat"))
