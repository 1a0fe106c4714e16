import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ordix.llm import _bytes as B
from ordix.llm import packed_ids, packing, queries, token_counts

tokenizers = pytest.importorskip("public_tokenizers")
BYTES, PIECES = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def _noise(alphabet, n=4000):
    rng = random.Random(3)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_split_counts_equal_the_librarys():
    own = token_counts._lengths(PIECES)
    texts = _noise("ab é\n\t ▁<s>1　") + ["", " ", "  a  b ", "▁▁ a"]
    assert own.safe and own.count(texts) == own.encode(texts)


def test_split_ids_equal_the_librarys(monkeypatch):
    monkeypatch.setattr(packed_ids, "REMEMBERED", 300)
    own = packed_ids._Encoder(BYTES)
    pieces = ["a", "Word", " ", "  ", "\n", "\t", ".", ",", "it's", "x.", "é.", "×.", "÷,", "ß,", "\u3000", "\xa0", "\x85", "\x1c", "12.", "…", "“q”", "漢字", "\U0001f600", "ȿ.", "ɀ.", "''", "\r\n", "\u2009", "ª.", "w" * 90]
    rng = random.Random(4)
    texts = _noise("ab é\n\t <1\xa0\x1c\u3000.'s,") + ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(4000)] + ["a <|endoftext|>  <|endoftext|>b", "", " ", "a \n b  c"]
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        ids, off = own.ids(B.texts_of(pa.array(part)))
        for t, a, z in zip(part, off[:-1], off[1:], strict=True):
            assert ids[a:z].tolist() == own.model.encode(t, add_special_tokens=False).ids, t
    assert len(own.name) <= 300


@pytest.mark.parametrize("bits", [1, 3, 8, 9, 15, 16, 17, 20, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 9000).astype(np.uint32)
    s = packed_ids.Shard(packed_ids.write_shard(ids, np.array([0, 5, 5, 9000]), bits))
    assert (s.read(0, 9000) == ids).all() and (s.read(4090, 4100) == ids[4090:4100]).all()
    assert not len(s.document(1)) and (s.document(2) == ids[5:]).all()
    assert len(packed_ids.pack(ids, bits)) == -(-9000 * bits // 8)


def test_bad_shard():
    with pytest.raises(ValueError):
        packed_ids.Shard(b"something else")


def _written(spark, df, tmp_path, **kw):
    packed_ids.write(df, str(tmp_path / "ids"), BYTES, **kw)
    return packed_ids.read(spark, str(tmp_path / "ids")).collect()


def test_dataset(spark, docs, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(packed_ids, "PART_BYTES", 20_000)
    monkeypatch.setattr(packed_ids, "SHARD_IDS", 3_000)
    rows = {r.doc_id: r for r in _written(spark, docs, tmp_path)}
    own, at = packed_ids._encoder(BYTES), 0
    for i in sorted(texts):
        ids = [*own.model.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_dataset_messy(spark, messy, empty, tmp_path):
    rows = _written(spark, messy, tmp_path)
    assert len(rows) == 9 and min(rows, key=lambda r: r.start).doc_id is None
    ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
    assert _written(spark, empty, tmp_path / "e") == []


def test_hot_ids_have_parts(spark, tmp_path, monkeypatch):
    """Very many rows of one id, and of none, are dealt into parts; ids still ascend and every row has its place."""
    monkeypatch.setattr(packed_ids, "PART_BYTES", 2_000)
    rows = [(7 if i % 3 else (None if i % 2 else i), f"text {i} " * 5) for i in range(900)] + [(7, "same")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bounds, firsts, subs = packed_ids._bounds(df, "doc_id", "text")
    assert subs[0] > 3 and subs.max() > 8 and 7 in bounds and 8 in bounds
    got = sorted(_written(spark, df, tmp_path), key=lambda r: r.start)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(got)) and got[0].start == 0
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and all(r.doc_id is None for r in got[: len(got) - len(known)])
    assert spark.read.parquet(str(tmp_path / "ids")).groupBy("part").agg({"n_ids": "sum"}).where("`sum(n_ids)` > 3000").count() == 0


def test_counts_messy(messy, empty):
    rows = token_counts.counts(messy, PIECES).collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert [r.over_limit for r in rows if r.doc_id == 3] == [True]
    assert token_counts.counts(empty, PIECES).count() == 0


def test_counts_of_the_tables(spark, sf_dir, texts):
    own = token_counts._lengths(PIECES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.QUERIES["op10_token_counts"](spark, sf_dir).collect()}
    assert got == {i: (len(t.encode()), n) for (i, t), n in zip(texts.items(), own.encode(list(texts.values())), strict=True)}


# --- packing ------------------------------------------------------------------


def _padding(lengths, counts, ends):
    return sum(int(c) * (min(e for e in ends if e >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = int(rng.integers(1, 11)), int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(100, n, replace=False)), rng.integers(1, 20, n)
        ends = packing.boundaries(lengths, counts, k).tolist()
        best = min(_padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1].tolist(), m))
        assert len(ends) <= k and _padding(lengths, counts, ends) == best


def test_query_packs_the_whole_table(spark, sf_dir, texts):
    """The registered query: counts by the library, the least padding in all, every document in one place."""
    own = token_counts._lengths(PIECES)
    want = dict(zip(texts, own.encode(list(texts.values())), strict=True))
    out = queries.QUERIES["op8_packing"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in out} == want and len(out) == len(want)
    lengths, counts = np.unique(list(want.values()), return_counts=True)
    ends = packing.boundaries(lengths, counts, packing.BUCKETS)
    assert {r.bucket_len for r in out} == set(ends.tolist())
    assert sum(r.padding for r in out) == _padding(lengths, counts, ends.tolist())
    # Against the plain program over all pairs of cuts.
    best = np.full((packing.BUCKETS + 1, len(lengths) + 1), 1 << 60)
    best[0, 0] = 0
    many, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(lengths * counts)))
    for k in range(1, packing.BUCKETS + 1):
        for j in range(1, len(lengths) + 1):
            best[k, j] = (best[k - 1, :j] + lengths[j - 1] * (many[j] - many[:j]) - (total[j] - total[:j])).min()
    assert sum(r.padding for r in out) == best[1:, -1].min()
    places = {(r.bucket, r.slab, r.batch, r.place) for r in out}
    assert len(places) == len(out)


def test_rows_that_repeat_share_slabs(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLAB_ROWS", 50)
    rows = [(7, 10)] * 600 + [(None, 10)] * 300
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(3), budget=100).collect()
    assert len(out) == 900 and len({(r.slab, r.batch, r.place) for r in out}) == 900
    slabs = {}
    for r in out:
        slabs[r.slab] = slabs.get(r.slab, 0) + 1
    assert len(slabs) == 18 and max(slabs.values()) < 120


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLAB_ROWS", 50)
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 3, 10, 400, 5000])) for i in range(500)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=3, budget=1000).collect()
    assert sorted(r.doc_id for r in out) == list(range(500)) and all(r.padding >= 0 and r.n_tokens + r.padding == r.bucket_len for r in out)
    batches = {}
    for r in out:
        batches.setdefault((r.bucket, r.slab, r.batch), []).append(r)
    assert len({r.bucket for r in out}) == 3
    for b in batches.values():
        assert sorted(r.place for r in b) == list(range(len(b))) and (len(b) == 1 or sum(r.bucket_len for r in b) <= 1000)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_boundaries_are_exact_at_every_size(spark):
    """More distinct lengths than any switch allowed, and one huge document: no length is rounded."""
    lengths = np.append(np.arange(1, 20_001), 2_000_000)
    ends = packing.boundaries(lengths, np.ones(len(lengths), np.int64), 4)
    docs = spark.range(1, 20_001).selectExpr("id AS doc_id", "id AS n_tokens").union(spark.sql("SELECT 0L, 2000000L"))
    got = packing.pack(docs, buckets=4).selectExpr("bucket_len", "bucket_len - n_tokens = padding AS right", "padding").groupBy("bucket_len", "right").agg({"padding": "sum"}).collect()
    assert all(r.right for r in got) and sorted(r.bucket_len for r in got) == ends.tolist() and ends[-1] == 2_000_000
    assert sum(r["sum(padding)"] for r in got) == _padding(lengths, np.ones(len(lengths)), ends.tolist())
