"""Packing: optimal length buckets, and token-budget batches inside each.

The histogram of lengths over the whole corpus is cut into buckets by dynamic
programming, so that padding every document to its bucket's length costs the
fewest tokens. Inside a bucket, batches of documents fill a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._dist import Kept

#: Buckets, tokens in a batch (padding included).
BUCKETS = 16
BUDGET = 65_536
#: Documents of a bucket that one task numbers, about.
SLAB_ROWS = 50_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper ends of at most `buckets` buckets over ascending lengths; the least padding in all.

    The cost of a bucket is Monge, so each layer's best cuts are monotone and
    are found by divide and conquer: buckets * n * log n.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths
    many = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    total = np.concatenate(([0], np.cumsum(lengths * counts, dtype=np.int64)))
    best = np.full(n + 1, np.iinfo(np.int64).max >> 1)
    best[1:] = lengths * many[1:] - total[1:]
    best[0] = 0
    cuts = []
    for _ in range(buckets - 1):
        now, cut = best.copy(), np.zeros(n + 1, np.int64)
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, a, z = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) >> 1
            i = np.arange(a, min(z, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (many[j] - many[i]) - (total[j] - total[i])
            k = int(np.argmin(cost))
            now[j], cut[j] = cost[k], i[k]
            stack += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), z)]
        now[0] = 0
        cuts.append(cut)
        best = now
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = int(cut[j])
    if j:
        out.append(lengths[j - 1])
    return np.array(sorted(out), np.int64)


def histogram(lengths: DataFrame, column: str = "n_tokens") -> tuple[np.ndarray, np.ndarray]:
    """Ascending lengths and how many documents have each, of all documents.

    A row per distinct length comes to the driver: D of them hold D * (D - 1) / 2
    tokens at least, so D is at most about the root of twice the corpus's tokens.
    """
    rows = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("n")).agg(F.count("*").alias("many")).toArrow().sort_by("n")
    return rows.column("n").to_numpy(), rows.column("many").to_numpy()


def pack(lengths: DataFrame, id_col: str = "doc_id", column: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, padding, slab, batch and place in it, for every document.

    A batch (bucket, slab, batch) holds budget // bucket_len documents, or one
    when a document alone is over the budget: nothing is cut or dropped. Null
    lengths count as 0. Documents are dealt into slabs by the hash of their id
    and row, about SLAB_ROWS of a bucket each, and numbered by id; each slab ends
    with one batch that may not be full. Repeated rows, and rows without an id,
    each get a place, in whichever slab.
    """
    # Read twice, so that lengths are not counted again; the row number is fixed by the written table.
    own = Kept(lengths.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(column), F.lit(0)).cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("row"))).df
    values, counts = histogram(own)
    ends = boundaries(values, counts, buckets)
    held = {int(e): int(c) for e, c in zip(ends, np.add.reduceat(counts, np.concatenate(([0], np.searchsorted(values, ends, "right")[:-1]))), strict=True)} if len(ends) else {}
    upper = F.lit([int(e) for e in ends] or [0])
    slabs = F.lit([max(1, -(-c // SLAB_ROWS)) for c in held.values()] or [1])
    bucket = F.array_size(F.filter(upper, lambda e: e < F.col("n_tokens")))
    dealt = own.withColumn("bucket", F.least(bucket, F.array_size(upper) - 1)).withColumn("bucket_len", F.element_at(upper, F.col("bucket") + 1)).withColumn("slab", F.pmod(F.xxhash64("doc_id", "n_tokens", "row"), F.element_at(slabs, F.col("bucket") + 1)).cast("int"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    at = F.row_number().over(Window.partitionBy("bucket", "slab").orderBy("doc_id", "n_tokens", "row")) - 1
    return dealt.withColumn("at", at.cast("long")).select(
        "doc_id",
        "n_tokens",
        "bucket",
        F.col("bucket_len").cast("long").alias("bucket_len"),
        (F.col("bucket_len") - F.col("n_tokens")).cast("long").alias("padding"),
        "slab",
        F.floor(F.col("at") / room).cast("long").alias("batch"),
        (F.col("at") % room).cast("long").alias("place"),
    )
