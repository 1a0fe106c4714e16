"""From keys that similar sets must share to verified components of sets.

An item is a distinct set with a 128-bit name, a size and keys. Items that share
a key and whose sizes allow a link are put in one cluster; clusters are found by
stars, never by pairs. A task first joins the items that share a key among its
own, so that a key however frequent leaves each task as one row per run of sizes.
Only then are the sets of clusters of two or more items gathered, and linked by
signature trees inside bounded groups.

A cluster of more than TILE_TOKENS is dealt in slices that hold each set once,
and its hubs, a few sets, in every slice. Most sets of a family link with a hub,
so after that one component holds nearly all; only the sets outside the largest
component meet the other slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._dist import Kept, prepare, release, sized, summed
from .components import components, local
from .signature_tree import SMALL, link, link_groups

#: Rows of keys that a task gathers before it joins and sends them, at least and at most.
CHUNK = 300_000, 8_000_000
#: Rows of keys in a bucket of the exchange, about, at least and at most.
BUCKET_ROWS = 400_000, 8_000_000
#: Tokens of a cluster that one task links; larger clusters are dealt in slices of half as many.
TILE_TOKENS = 1_500_000
#: Sets of a larger cluster that are in all its slices.
HUBS = 8
#: Bytes of the texts of small groups that are linked together.
BATCH_BYTES = 400_000
#: Bytes of a cluster's texts that are made sets at once.
EXPAND_BYTES = 256 << 10
#: Tokens that a partition of clusters holds, about.
PART_TOKENS = 1_500_000
#: Words of the filter that says which items are in clusters, or ids are asked for: its size is bound, a full one only lets more rows by.
FILTER_WORDS = 1 << 17


@dataclass
class Items:
    """Items of a slice, and the keys of item `of`."""

    name: np.ndarray  # (n, 2) uint64
    size: np.ndarray
    key: np.ndarray
    of: np.ndarray


Batches = Iterator[pa.RecordBatch]
#: What a task makes of its rows: items with keys, or names and a way to the texts of chosen ones.
Emit = Callable[[Batches], Iterator[Items]]
Texts = Callable[[Batches], Iterator[tuple[np.ndarray, Callable[[np.ndarray], list[bytes]]]]]


def codes(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct name, and the distinct name of each row."""
    if not len(name):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((name[:, 1], name[:, 0]))
    new = np.ones(len(name), bool)
    new[1:] = (name[order][1:] != name[order][:-1]).any(axis=1)
    which = np.empty(len(name), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def binary(name: np.ndarray) -> pa.Array:
    """Names as 16 bytes each."""
    n = len(name)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(name, ">u8").tobytes())])


def short(name: np.ndarray) -> np.ndarray:
    """The 64 bits of names that travel with keys: equal ones at worst put two items in one cluster."""
    return (name[:, 0] ^ B.mix(name[:, 1])).view(np.int64)


def names(arr: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(arr.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)


def _chain(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, lo), and which row of it goes on with the run of sizes before it."""
    alike = not len(lo) or lo.min() == lo.max() == hi.min() == hi.max()
    order = np.argsort(key) if alike else np.lexsort((lo, key))
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if alike:
        return order, ~new
    l = lo[order]
    rank = np.cumsum(new) << 32
    top = np.maximum.accumulate(rank + hi[order]) - rank
    on = ~new
    on[1:] &= top[:-1] * 100 >= percent * l[1:]
    return order, on


_EXCHANGE = "bucket long, key binary, node binary, lo binary, hi binary, a binary, b binary"


def _rows(held: list[Items], buckets: int, percent: int) -> Iterator[tuple]:
    node = np.concatenate([short(x.name) for x in held])
    node, first, which = np.unique(node, return_index=True, return_inverse=True)
    base = np.cumsum([0, *(len(x.name) for x in held)])
    key = np.concatenate([x.key for x in held])
    item = which[np.concatenate([x.of + b for x, b in zip(held, base, strict=False)])]
    size = np.concatenate([x.size for x in held])[first].astype(np.int64)
    order, on = _chain(key, size[item], size[item], percent)
    key, item = key[order], item[order]
    p = local(len(node), item[np.flatnonzero(on)], item[np.flatnonzero(on) - 1])
    start = np.flatnonzero(~on)
    lo, hi = size[item[start]], size[item[np.append(start[1:], len(on)) - 1]]
    key, item = key[start], item[start]
    # Keys are ascending, so a bucket is a run of them; inside it their low bits do.
    ends = np.searchsorted(key, np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64))
    ends = np.concatenate(([0], ends, [len(key)]))
    child = np.flatnonzero(p != np.arange(len(p)))
    home = int(node[0]) % buckets if len(node) else 0
    for k in range(buckets):
        a, z = ends[k], ends[k + 1]
        c = child if k == home else child[:0]
        if z > a or len(c):
            own = item[a:z]
            yield (k, key[a:z].astype(np.uint32).tobytes(), node[own].tobytes(), lo[a:z].astype(np.uint32).tobytes(), hi[a:z].astype(np.uint32).tobytes(), node[c].tobytes(), node[p[c]].tobytes())


def clusters(source: DataFrame, emit: Emit, rows: int, percent: int) -> DataFrame:
    """node, root (short names) for every item that shares a key with another one of a size that may link.

    rows: about how many keys there are.
    """
    prepare(source.sparkSession)
    buckets, chunk = max(1, -(-rows // sized(rows, *BUCKET_ROWS))), sized(rows, *CHUNK)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = list(_rows(held, buckets, percent)) if n else []
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], [x.split()[0] for x in _EXCHANGE.split(", ")])

        for x in emit(batches):
            if len(x.key):
                held.append(x)
                n += len(x.key)
            if n >= chunk:
                yield from flush()
                held, n = [], 0
        yield from flush()

    def join(t: pa.Table) -> pa.Table:
        key, node, lo, hi, a, b = (np.frombuffer(b"".join(t.column(i + 1).to_pylist()), kind) for i, kind in enumerate((np.uint32, np.int64, np.uint32, np.uint32, np.int64, np.int64)))
        order, on = _chain(key, lo.astype(np.int64), hi.astype(np.int64), percent)
        node = node[order]
        at = np.flatnonzero(on)
        name, code = np.unique(np.concatenate([node[at], node[at - 1], a, b]), return_inverse=True)
        ends = np.cumsum([len(at), len(at), len(a)])
        p = local(len(name), np.concatenate([code[: ends[0]], code[ends[1] : ends[2]]]), np.concatenate([code[ends[0] : ends[1]], code[ends[2] :]]))
        child = np.flatnonzero(p != np.arange(len(p)))
        return pa.table({"a": name[child], "b": name[p[child]]})

    edges = source.mapInArrow(send, _EXCHANGE).groupBy("bucket").applyInArrow(join, "a long, b long")
    return components(edges)


def _probes(name: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(words * 64 - 1)
    return (name[:, 0] & bits), (name[:, 1] & bits)


def name_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of the nodes' names, of a fixed size."""
    words = FILTER_WORDS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for b in batches:
            for p in _probes(names(b.column(0)), words):
                np.bitwise_or.at(bits, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["v"])

    return summed(nodes.mapInArrow(fill, "v binary"), words, np.bitwise_or).view(np.uint64)


def lets_by(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which names may be in the filter; those that were put in always are."""
    held = np.ones(len(name), bool)
    for p in _probes(name, len(bits)):
        held &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return held


def links(source: DataFrame, texts: Texts, expand: Callable[[B.Texts], tuple[np.ndarray, np.ndarray]], found: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """node, root by verified links 100 * common >= percent * union among the items of each cluster.

    found: node, root of clusters(). sizes: node, short and size of each distinct
    item. texts gives the texts of items, which are smaller than their sets and
    travel in their place; expand makes the sets of texts. Items without a link
    are left out.
    """
    spark = source.sparkSession
    kept = Kept(found.withColumnRenamed("node", "short").join(sizes, "short").drop("short"))
    release(spark)
    # Written, as the other tables that are joined by a key of very many rows: Spark splits such a key between plain exchanges only.
    weight = Kept(kept.df.groupBy("root").agg(F.sum("size").alias("weight"), F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(HUBS))).alias("hubs")))
    tiles = F.when(F.col("weight") <= TILE_TOKENS, 0).otherwise(F.ceil(F.col("weight") / (TILE_TOKENS / 2))).cast("int")
    weighed = Kept(kept.df.join(weight.df.withColumn("tiles", tiles), "root").select("root", "node", "size", "tiles", F.when(F.col("tiles") > 0, F.array_contains("hubs", F.col("node"))).otherwise(False).alias("hub")))
    kept.drop()
    weight.drop()
    total, large = weighed.df.agg(F.sum("size"), F.max("tiles")).first()
    if not total:
        return components(_edges(weighed.df.limit(0).select("root", F.lit("").alias("group"), F.lit(0).alias("side"), "node", F.lit(b"").alias("item")), expand, percent, 0))
    bits = spark.sparkContext.broadcast(name_filter(weighed.df.select("node")))

    def send(batches: Batches) -> Batches:
        for name, take in texts(batches):
            first, _ = codes(name)
            first = first[lets_by(bits.value, name[first])]
            if len(first):
                yield pa.RecordBatch.from_arrays([binary(name[first]), pa.array(take(first), pa.binary())], ["node", "item"])

    def gathered(which: DataFrame) -> DataFrame:
        return source.mapInArrow(send, "node binary, item binary").join(which, "node").dropDuplicates(["node"])

    def group(*parts: Column) -> Column:
        return F.concat_ws(":", *(p.cast("string") for p in parts))

    tile = F.pmod(F.xxhash64("node"), F.greatest("tiles", F.lit(1))).cast("int")
    own = F.when(F.col("hub"), F.sequence(F.lit(0), F.greatest(F.col("tiles") - 1, F.lit(0)))).otherwise(F.array(tile))
    dealt = gathered(weighed.df).select("root", F.explode(own).alias("k"), "node", "item").select("root", F.col("k").cast("string").alias("group"), F.lit(0).alias("side"), "node", "item")
    edges = Kept(_edges(dealt, expand, percent, total))
    release(spark)
    out = components(edges.df)
    if large:
        # Sets of large clusters outside the largest component so far meet all its other sets.
        joined = Kept(out)
        label = weighed.df.where("tiles > 0").join(joined.df.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        held = label.groupBy("root", "label").agg(F.sum("size").alias("w"))
        top = Kept(held.groupBy("root").agg(F.max_by("label", F.struct("w", "label")).alias("top"), (F.sum("w") - F.max("w")).alias("rest")).where("rest > 0"))
        rests = F.ceil(F.col("rest") / (TILE_TOKENS / 2)).cast("int")
        open_ = Kept(label.join(top.df.withColumn("rests", rests), "root").select("root", "node", "size", "tiles", "rests", (F.col("label") != F.col("top")).alias("out")))
        r = F.pmod(F.xxhash64("node"), F.greatest("rests", F.lit(1))).cast("int")
        every, rest = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("tiles", "rests"))
        meets = F.when(~F.col("out"), F.transform(rest, lambda j: F.struct(group(tile, j).alias("group"), F.lit(0).alias("side")))).otherwise(
            F.concat(
                F.transform(every, lambda k: F.struct(group(k, r).alias("group"), F.lit(1).alias("side"))),
                F.transform(rest, lambda j: F.struct(group(F.lit("r"), F.least(j, r), F.greatest(j, r)).alias("group"), (r > j).cast("int").alias("side"))),
            )
        )
        dealt = gathered(open_.df).select("root", F.explode(meets).alias("g"), "node", "item").select("root", F.col("g.group").alias("group"), F.col("g.side").alias("side"), "node", "item")
        more = open_.df.agg(F.sum(F.col("size") * F.when(F.col("out"), F.col("tiles") + F.col("rests")).otherwise(F.col("rests")))).first()[0] or 0
        if more:
            edges2 = Kept(joined.df.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_edges(dealt, expand, percent, more)))
            out = components(edges2.df)
            edges2.drop()
        open_.drop()
        top.drop()
        if more:
            joined.drop()
    edges.drop()
    weighed.drop()
    release(spark)
    return out


def _edges(dealt: DataFrame, expand: Callable[[B.Texts], tuple[np.ndarray, np.ndarray]], percent: int, tokens: int) -> DataFrame:
    """Links (a, b) inside each (root, group) of root, group, side, node, item; about so many tokens in all."""

    def join(batches: Batches) -> Batches:
        held: list[pa.Table] = []  # the open group
        few: list[pa.Table] = []  # closed small groups, linked together
        size = 0

        def linked(tables: list[pa.Table]) -> Batches:
            t = pa.concat_tables(tables)
            sets = [expand(x) for _, x in B.slices(t.select([4]).cast(pa.schema([("item", pa.large_string())])).combine_chunks().to_batches(), "item", EXPAND_BYTES)]
            off = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(o) for _, o in sets]))))
            tokens = np.concatenate([k for k, _ in sets])
            side = t.column(2).to_numpy()
            p = link_groups(tokens, off, percent, B.ids(np.array([x.num_rows for x in tables])), side) if t.num_rows <= len(tables) * SMALL else link(tokens, off, percent, side)
            child = np.flatnonzero(p != np.arange(len(p)))
            node = t.column(3).combine_chunks()
            if t.num_rows > 1000:
                B.trim()
            if len(child):
                yield pa.RecordBatch.from_arrays([node.take(pa.array(child)), node.take(pa.array(p[child]))], ["a", "b"])

        def close() -> Batches:
            nonlocal held, few, size
            n = sum(x.num_rows for x in held)
            if n > SMALL:
                yield from linked([pa.concat_tables(held)])
            elif n > 1:
                few.append(pa.concat_tables(held))
                size += few[-1].column(4).nbytes
                if size >= BATCH_BYTES:
                    yield from linked(few)
                    few, size = [], 0
            held = []

        last = None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            at = 0
            for i, k in enumerate(keys):
                if k != last:
                    if i > at:
                        held.append(pa.Table.from_batches([b.slice(at, i - at)]))
                    if held:
                        yield from close()
                    at, last = i, k
            held.append(pa.Table.from_batches([b.slice(at)]))
        if held:
            yield from close()
        if few:
            yield from linked(few)
        B.trim()

    parts = max(dealt.sparkSession.sparkContext.defaultParallelism, -(-int(tokens) // PART_TOKENS))
    return dealt.repartition(parts, "root", "group").sortWithinPartitions("root", "group", "node").mapInArrow(join, "a binary, b binary")
