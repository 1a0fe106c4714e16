"""N-gram Jaccard join of documents by signature trees.

A document is the set of its distinct word shingles. Documents of equal sets are
one item. Shingles are ordered by the number of items that hold them, rarest
first, over the whole corpus. Two sets that reach the threshold t share a shingle
among the first n - ceil(t * n) + 1 of each in this order, so the shared ones
among those are the keys by which items meet: a passage that many documents hold
comes last and joins nothing. Items that meet form clusters, and inside a cluster
a dual traversal of signature trees prunes pairs of nodes by their maximum
possible overlap and verifies the rest exactly (see candidates and signature_tree).

Texts are kept in chunks. A chunk sends each of its shingles once to the bucket
of its hash and gets back how common it is, one bit for those of one item only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._dist import Kept, prepare, release, sized, unused
from .candidates import Items, binary, clusters, codes, links, names, short

#: Bytes of text in a chunk and shingles in a bucket, at least and at most: both grow with the
#: root of the corpus, so that a chunk's part of a bucket stays a run of keys. A chunk is one row,
#: so small ones spare the heap.
CHUNK_BYTES = 256 << 10, 32 << 20
BUCKET_KEYS = 1 << 19, 16 << 20


def _blob(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _column(b: pa.RecordBatch, name: str, i: int, kind: str = "") -> np.ndarray:
    data = b.column(b.schema.get_field_index(name))[i].as_py()
    return np.frombuffer(data or b"", kind)


def _name(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """128-bit name of each set."""
    parts = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        c = np.zeros(len(key) + 1, np.uint64)
        np.cumsum(B.mix(key ^ np.uint64(salt)), out=c[1:])
        parts.append(B.mix(c[off[1:]] - c[off[:-1]] + np.diff(off).astype(np.uint64)))
    return np.stack(parts, axis=1)


# --- chunks and how common their shingles are --------------------------------


def _chunked(docs: DataFrame, k: int, kind: str) -> DataFrame:
    """A row per chunk: ids, set sizes and names of its documents, and the texts of its distinct sets that aren't empty."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = sized(total // 8, *CHUNK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in B.chunks(batches, "text", most):
            key, off = B.shingles(B.lowered(t), k)
            name, size = _name(key, off), np.diff(off)
            first, _ = codes(name)
            first = np.sort(first[size[first] > 0])
            long = np.diff(t.off)[first]
            text = t.data[B.ranges(t.off[first], long)].tobytes()
            ids = part.column(0)
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            cells = (uuid.uuid4().bytes, _blob(size, "<i8"), _blob(name, ">u8"), _blob(first, "<i8"), text, _blob(np.concatenate(([0], np.cumsum(long))), "<i8"))
            own = np.sort(key[B.ranges(off[first], size[first])])
            distinct = int((own[1:] != own[:-1]).sum()) + 1 if len(own) else 0
            yield pa.RecordBatch.from_arrays([one, *(pa.array([x], pa.binary()) for x in cells), pa.array([distinct], pa.int64())], ["ids", "chunk", "sizes", "names", "own", "text", "off", "n"])

    return docs.mapInArrow(run, f"ids array<{kind}>, chunk binary, sizes binary, names binary, own binary, text binary, off binary, n long")


def _members(chunks: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name = names(b.column(2).slice(i, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), pa.array(_column(b, "sizes", i, "<i8")), binary(name), pa.array(short(name))], ["doc_id", "n_shingles", "node", "short"])

    return chunks.select("ids", "sizes", "names").mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, short long")


def _sets(b: pa.RecordBatch, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a chunk's distinct sets and their offsets."""
    return B.shingles(B.lowered(B.Texts(_column(b, "text", i, "u1"), _column(b, "off", i, "<i8"))), k)


def _split(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in ascending keys, and the end."""
    return np.concatenate(([0], np.searchsorted(key, np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)), [len(key)]))


_SENT = "bucket long, chunk binary, keys binary, many binary"


def _send(k: int, buckets: int):
    """Each distinct shingle of a chunk, low bits only, and in how many of its sets it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, count = np.unique(_sets(b, i, k)[0], return_counts=True)
                if not len(key):
                    continue
                ends = _split(key, buckets)
                low, count = key.astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
                held = np.flatnonzero(np.diff(ends))
                a, z = ends[held].tolist(), ends[held + 1].tolist()
                chunk = b.column(b.schema.get_field_index("chunk"))[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([chunk] * len(held), pa.binary()), pa.array([low[x:y].tobytes() for x, y in zip(a, z, strict=True)], pa.binary()), pa.array([_counts(count[x:y]) for x, y in zip(a, z, strict=True)], pa.binary())], ["bucket", "chunk", "keys", "many"])
        B.trim()

    return run


def _counts(count: np.ndarray) -> bytes:
    """A bit for each count over 1, and these counts."""
    many = count > 1
    return np.packbits(many).tobytes() + count[many].tobytes()


def _counted(blob: bytes, n: int) -> np.ndarray:
    many = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8)), count=n).astype(bool)
    out = np.ones(n, np.int64)
    out[many] = np.frombuffer(blob, np.uint8, offset=-(-n // 8))
    return out


def _judge(t: pa.Table) -> pa.Table:
    """How common each shingle sent is: 0 for those of one set, else steps of the logarithm of the number of sets, from 1 on."""
    B.trim()  # what the bucket before has left
    keys = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
    count = np.concatenate([_counted(x, len(k)) for x, k in zip(t.column("many").to_pylist(), keys, strict=True)])
    every = np.sort(np.concatenate(keys).astype(np.uint64) << np.uint64(32) | np.arange(len(count), dtype=np.uint64))
    order = (every & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.diff(every >> np.uint64(32), prepend=np.uint64(1 << 40)))
    sets = np.add.reduceat(count[order], start)
    step = np.where(sets > 1, np.minimum(255, 8 * np.log2(sets)), 0).astype(np.uint8)
    out = np.empty(len(count), np.uint8)
    out[order] = np.repeat(step, np.diff(np.append(start, len(count))))
    common = [np.packbits(x > 0).tobytes() + x[x > 0].tobytes() for x in np.split(out, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"bucket": t.column("bucket"), "chunk": t.column("chunk"), "common": pa.array(common, pa.binary())})


def rare_first(key: np.ndarray, off: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set, and the set of each key: of the first n - ceil(t * n) + 1 shingles, rarest first, those that other sets hold.

    common: how common each shingle is, 0 for those of this set only.
    """
    size = np.diff(off)
    need = size - (percent * size + 99) // 100 + 1
    left = need - B.sums(common == 0, off)
    open_ = np.flatnonzero(left > 0)
    at = B.ranges(off[open_], size[open_])
    of = np.repeat(open_, size[open_])
    at, of = at[common[at] > 0], of[common[at] > 0]
    order = np.lexsort((key[at], common[at], of))
    at, of = at[order], of[order]
    start = np.searchsorted(of, open_)
    place = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
    keep = place < left[of]
    return key[at[keep]], of[keep]


def _keyed(k: int, percent: int, buckets: int):
    """Names, sizes and keys of a chunk's sets that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, off = _sets(b, i, k)
                distinct, which = np.unique(key, return_inverse=True)
                ends = _split(distinct, buckets)
                common = np.zeros(len(distinct), np.uint8)
                for r in b.column(b.schema.get_field_index("hits"))[i].as_py() or ():
                    a, z = ends[r["bucket"]], ends[r["bucket"] + 1]
                    bits = np.unpackbits(np.frombuffer(r["common"], np.uint8, -(-(z - a) // 8)), count=z - a).astype(bool)
                    common[a:z][bits] = np.frombuffer(r["common"], np.uint8, offset=-(-(z - a) // 8))
                found, of = rare_first(key, off, common[which], percent)
                held, of = np.unique(of, return_inverse=True)
                if len(held):
                    name = names(b.column(b.schema.get_field_index("names")).slice(i, 1))[_column(b, "own", i, "<i8")[held]]
                    cells = _blob(name, ">u8"), _blob(np.diff(off)[held], "<i8"), _blob(found, "<u8"), _blob(of, "<i8")
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in cells), pa.array([len(found)], pa.int64())], ["names", "sizes", "keys", "of", "n"])
        B.trim()

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[Items]:
    for b in batches:
        for i in range(b.num_rows):
            yield Items(names(b.column(0).slice(i, 1)), *(_column(b, c, i, kind) for c, kind in (("sizes", "<i8"), ("keys", "<u8"), ("of", "<i8"))))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            text, off = (_column(b, c, i, kind) for c, kind in (("text", "u1"), ("off", "<i8")))
            yield names(b.column(b.schema.get_field_index("names")).slice(i, 1))[_column(b, "own", i, "<i8")], lambda at, text=text, off=off: [text[off[j] : off[j + 1]].tobytes() for j in at]


def components_of(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when 100 * common >= percent * union of their k-word shingle
    sets, of words split at white space with A-Z lower-cased; component_id is the smallest id of a document's component. With fewer
    than k words the whole sequence is the one shingle. A null, empty or wordless
    text has an empty set and is linked with nothing. Repeated rows each get a
    row. A null id counts for no minimum; a component of null ids has a null id.
    One text is one chunk at least, whole in memory. Other columns aren't read.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    chunks = Kept(_chunked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, kind))
    members = _members(chunks.df, kind)
    full = members.where("n_shingles > 0")
    sizes = full.groupBy("node", "short").agg(F.max("n_shingles").alias("size"))

    total = int(chunks.df.agg(F.sum("n")).first()[0] or 0)
    buckets = max(1, -(-total // sized(total, *BUCKET_KEYS)))
    common = Kept(chunks.df.select("chunk", "text", "off").mapInArrow(_send(k, buckets), _SENT).groupBy("bucket").applyInArrow(_judge, "bucket long, chunk binary, common binary"))
    release(spark)
    hits = common.df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "common")).alias("hits"))
    keyed = Kept(chunks.df.select("chunk", "names", "own", "text", "off").join(hits, "chunk").mapInArrow(_keyed(k, percent, buckets), "names binary, sizes binary, keys binary, of binary, n long"))
    common.drop()
    release(spark)
    found = Kept(clusters(keyed.df.select("names", "sizes", "keys", "of"), _items, int(keyed.df.agg(F.sum("n")).first()[0] or 0), percent))
    keyed.drop()
    release(spark)
    roots = Kept(links(chunks.df.select("names", "own", "text", "off"), _texts, lambda t: B.shingles(B.lowered(t), k), found.df, sizes, percent))
    found.drop()
    release(spark)
    # The smallest id of each set, then of each component: one row per distinct set.
    # Written, so that joins by a hot set or a hot component are between plain exchanges, which Spark can split.
    least = Kept(full.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots.df, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"))
    ids = Kept(least.df.groupBy("root").agg(F.min("least").alias("component_id")))
    by_set = Kept(least.df.join(ids.df, "root").select("node", "component_id"))
    for x in (roots, least, ids):
        x.drop()
    empty = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.join(by_set.df, "node").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def representatives(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without those whose component has a smaller id or text hash.

    Each row is judged by its id and text: rows that share an id with other texts
    stay or go on their own, and of rows that repeat id and text one stays.
    Documents without an id stay.
    """
    key = F.xxhash64(id_col, text_col)
    place = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), key.alias("key")))
    found = Kept(components_of(docs.select(place.alias("place"), F.col(text_col).alias("text")), k, percent, "place", "text"))
    own, sign, nth = (unused(docs, x) for x in ("gone", "key", "nth"))
    gone = Kept(found.df.where("doc_id != component_id").select(F.col("doc_id.id").alias(own), F.col("doc_id.key").alias(sign)).distinct()).df
    rest = docs.join(gone, (F.col(id_col) == F.col(own)) & (key == F.col(sign)), "left_anti")
    if found.df.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return rest
    row = F.row_number().over(Window.partitionBy(id_col, key).orderBy(F.xxhash64(*docs.columns)))
    return rest.withColumn(nth, row).where(F.col(id_col).isNull() | (F.col(nth) == 1)).drop(nth)
