"""Connected components, in a task and across tasks.

Across tasks: alternating large-star and small-star steps over DataFrames. Each
step takes its minima with partial aggregation, writes them to the shared folder
and joins them back; both sides of that join are plain exchanges, so Spark's
adaptive skew join splits the rows of a large star's centre. Once the edges left
are few enough for one task, one task joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dist import Kept, prepare

#: Edges that a task joins at once before the first step.
CHUNK = 400_000
#: Edges that one task may finish: of at most two binary names each, about 100 MB.
FINISH = 1_000_000


def local(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each node's component; label: what is joined already."""
    p = np.arange(n) if label is None else label.copy()
    while len(a):
        ra, rb = p[a], p[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(q := p[p], p):
            p = q
    return p


def _fold(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars around the smallest node of each of its components."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        both = pa.concat_arrays([*t.column(0).chunks, *t.column(1).chunks])
        codes = both.dictionary_encode()
        names = codes.dictionary
        order = np.empty(len(names), np.int64)
        order[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        ix = order[codes.indices.to_numpy()]
        p = local(len(names), ix[: t.num_rows], ix[t.num_rows :])
        names = names.take(pc.sort_indices(names))
        child = np.flatnonzero(p != np.arange(len(p)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(child)), names.take(pa.array(p[child]))], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= chunk:
            yield star(held)
            held, n = [], 0
    if held:
        yield star(held)


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for each node of an edge; edges: two columns of one type.

    Edges with a null end and loops are left out. Without edges the result is empty.
    """
    prepare(edges.sparkSession)
    a, b = edges.columns
    kind = edges.schema[a].dataType.simpleString()
    own = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    kept, mark = Kept(own.mapInArrow(_fold, f"u {kind}, v {kind}").distinct()), None
    while True:
        e = kept.df
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        if now[0] <= FINISH:
            after = Kept(e.coalesce(1).mapInArrow(lambda batches: _fold(batches, FINISH + 1), f"u {kind}, v {kind}"))
            kept.drop()
            kept = after
            break
        # Large star: larger neighbours of a node go to the smallest of the node and its neighbours.
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        first = Kept(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = Kept(both.where("y > x").join(first.df, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: a node and its smaller neighbours go to the smallest of these.
        second = Kept(large.df.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.df.join(second.df, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(second.df.select("u", F.col("m").alias("v"))).distinct()
        after = Kept(small)
        for x in (kept, first, large, second):
            x.drop()
        kept = after
    e = kept.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
