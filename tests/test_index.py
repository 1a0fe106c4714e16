import bisect
import random

import pytest
from pyspark.sql import functions as F

from ordix.functions import keys as K
from ordix.operators import batching, fragments
from ordix.operators.index import OrderedIndex
from ordix.sources import workload
from ordix.streaming.runner import Snapshots, run_upserts, upsert_batch


def _index(spark, keys):
    return OrderedIndex(spark.createDataFrame([(k, k * 10) for k in keys], "k long, v long"), "k", ["v"])


def _probes(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "seq long, p long")


@pytest.mark.parametrize("seed", range(3))
def test_lookups_against_a_model(spark, seed):
    rng = random.Random(seed)
    keys = sorted(rng.sample(range(1000), rng.choice([1, 5, 120])))
    probes = [rng.randrange(-20, 1020) for _ in range(200)] + keys + [None]
    index, df = _index(spark, keys), _probes(spark, probes)
    for fragments_ in (1, 7):
        up = {r.seq: r.succ_k for r in index.succ(df, "p", fragments_).collect()}
        down = {r.seq: r.pred_k for r in index.pred(df, "p", fragments_).collect()}
        rank = {r.seq: r["rank"] for r in index.rank(df, "p", fragments_).collect()}
        assert len(up) == len(down) == len(probes)
        for i, p in enumerate(probes):
            if p is None:
                assert up[i] is None and down[i] is None and rank[i] is None
                continue
            at = bisect.bisect_right(keys, p)
            assert up[i] == (keys[at] if at < len(keys) else None)
            below = bisect.bisect_left(keys, p)
            assert down[i] == (keys[below - 1] if below else None)
            assert rank[i] == at
    small = {r.seq: r.succ_k for r in index.succ_small(df, "p").collect()}
    assert small == up
    got = {r.seq: (r.found, r.v) for r in index.get(df, "p").collect()}
    assert all(got[i] == ((True, p * 10) if p in keys else (False, None)) for i, p in enumerate(probes))


def test_empty_index(spark):
    index, df = _index(spark, [1]), _probes(spark, [0, 5])
    index = OrderedIndex(index.df.limit(0), "k", ["v"])
    assert [r.succ_k for r in index.succ(df, "p").collect()] == [None, None]
    assert [r.found for r in index.get(df, "p").collect()] == [False, False]
    assert index.succ_small(df, "p").where("succ_k IS NOT NULL").count() == 0


def test_successor_plan_has_no_nested_loop(spark):
    plan = _index(spark, range(100)).succ(_probes(spark, range(50)), "p", 8)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_upsert_keeps_the_last_arrival(spark):
    index = _index(spark, [1, 2, 3])
    batch = spark.createDataFrame([(2, 5, 1), (2, 7, 3), (2, 6, 2), (9, None, 1), (None, 4, 9)], "k long, v long, seq long")
    assert {r.k: r.v for r in index.upsert(batch, "seq").collect()} == {1: 10, 2: 7, 3: 30, 9: None}
    counts = index.upsert_counts(batch).first()
    assert (counts.inserted, counts.updated) == (1, 1)


def test_unsigned_keys(spark):
    values = [0, 5, 2**63 - 1, 2**63, 2**64 - 1]
    bits = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(b,) for b in bits], "b long")
    got = df.select(K.unsigned(F.col("b")).cast("string").alias("u"), K.ordered_bits(F.col("b")).alias("o")).orderBy("o").collect()
    assert [int(r.u) for r in got] == values
    assert [r.b for r in df.orderBy(K.ordered_bits(F.col("b"))).select(K.from_ordered_bits(K.ordered_bits(F.col("b"))).alias("b")).collect()] == bits


def test_routing_agrees_with_the_driver(spark):
    fmap = fragments.equi_width(spark, 4, 3, 999)
    rows = sorted(fmap.collect(), key=lambda r: r.ub)
    assert rows[0].lb == 0 and rows[-1].ub == 999 and all(a.ub + 1 == b.lb for a, b in zip(rows, rows[1:], strict=False))
    keys = list(range(0, 1000, 7)) + [r.ub for r in rows] + [r.lb for r in rows]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for strict in (False, True):
        got = {r.key: r.frag_id for r in fragments.route(df, fmap, strict=strict).collect()}
        assert got == {k: fragments.place([r.ub for r in rows], k, strict) for k in keys}


def test_routing_over_the_unsigned_domain(spark):
    fmap = fragments.equi_width(spark, 4, 2)
    rows = sorted(fmap.collect(), key=lambda r: r.ub)
    keys = [0, 1, 2**63 - 1, 2**63, 2**64 - 1] + [int(r.ub) for r in rows] + [int(r.lb) for r in rows]
    df = spark.createDataFrame([(str(k),) for k in keys], "k string").select(F.col("k").cast("decimal(20,0)").alias("key"))
    got = {int(r.key): r.frag_id for r in fragments.route(df, fmap).collect()}
    assert got == {k: next(r.frag_id for r in rows if k <= int(r.ub)) for k in keys}


def test_many_cuts(spark):
    cuts = list(range(5, 5000, 13))
    keys = [0, 4, 5, 6, 17, 18, 4990, 4991, 4992, 4993, 9999]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", fragments.locate(F.col("k"), cuts).alias("f")).collect()
    assert {r.k: r.f for r in got} == {k: bisect.bisect_right(cuts, k) for k in keys}


def test_raw_key_files(spark, tmp_path):
    values = [0, 1, 2**63, 2**64 - 1, 77]
    df = spark.createDataFrame([(str(v),) for v in values], "k string").select(F.col("k").cast("decimal(20,0)").alias("k"))
    workload.write_keys(df, "k", str(tmp_path / "keys"))
    assert sorted(int(r.key) for r in workload.read_keys(spark, str(tmp_path / "keys")).collect()) == sorted(values)


def test_raw_key_files_in_splits(spark, tmp_path):
    import numpy as np

    keys = np.arange(1000, dtype="<u8") * 3
    (tmp_path / "a.bin").write_bytes(keys.tobytes() + b"rest")
    (tmp_path / "b.bin").write_bytes(b"")
    for split in (64, 1000, 1 << 20):
        rows = workload.read_keys(spark, str(tmp_path), split).collect()
        assert sorted((r.seq, int(r.key)) for r in rows) == [(i, 3 * i) for i in range(1000)] and {r.file.rsplit("/", 1)[1] for r in rows} == {"a.bin"}


def test_parse_cell(spark):
    df = spark.createDataFrame([("3",), ("-1,2",), ("9,99",), ("x",), ("",)], "s string")
    got = [tuple(r.c) for r in df.select(K.parse_cell(F.col("s"), 5, 10).alias("c")).collect()]
    assert got == [(3, -1), (-1, 2), (4, 9), (-1, -1), (-1, -1)]


def test_numbered_and_slices(spark):
    df = spark.createDataFrame([(i * 3 % 101,) for i in range(101)], "k long")
    rows = {r.k: r.seq for r in batching.numbered(df, ["k"]).collect()}
    assert rows == {k: k for k in range(101)}
    sliced = batching.equal_slices(batching.numbered(df, ["k"]), 101, 7).groupBy("slice").count().collect()
    assert {r.slice: r["count"] for r in sliced} == {i: 101 * (i + 1) // 7 - 101 * i // 7 for i in range(7)}


def test_streamed_upserts_are_idempotent(spark, tmp_path):
    src, snap = str(tmp_path / "in"), Snapshots(spark, str(tmp_path / "snap"), "k", ["v"])
    schema = "k long, v long, seq long"
    for b, rows in enumerate([[(1, 1, 0), (2, 2, 1)], [(2, 5, 2), (3, 3, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        run_upserts(stream, snap, "seq", str(tmp_path / "ck")).awaitTermination()
        assert snap.versions()[-1] == b
    assert {r.k: r.v for r in snap.latest().df.collect()} == {1: 1, 2: 5, 3: 3}
    again = spark.createDataFrame([(2, 5, 2), (3, 3, 3)], schema)
    upsert_batch(snap, "seq")(again, 1)
    assert {r.k: r.v for r in snap.latest().df.collect()} == {1: 1, 2: 5, 3: 3}
    snap.prune(1)
    assert snap.versions() == [1]


def test_ranges_of_repeated_probes(spark):
    index = _index(spark, range(0, 40, 2))
    df = _probes(spark, [5, 5, None, 39, -3]).drop("seq")
    got = sorted((r.p, r.place, r.k, r.v) for r in index.range(df, "p", 3, 10).collect())
    assert got == sorted([(5, i + 1, k, 10 * k) for i, k in enumerate((6, 8, 10)) for _ in range(2)] + [(-3, i + 1, k, 10 * k) for i, k in enumerate((0, 2, 4))])


def test_small_successor_has_the_same_columns_at_every_size(spark, monkeypatch):
    from ordix.operators import index as module

    index, df = _index(spark, range(0, 100, 3)), _probes(spark, [1, 50, 99, None])
    small = index.succ_small(df, "p")
    monkeypatch.setattr(module, "SMALL_ROWS", 10)
    large = index.succ_small(df, "p")
    assert large.columns == small.columns and sorted(map(tuple, large.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)


def test_fragments_follow_probes_too(spark, monkeypatch):
    """A small index with many probes is cut by the probes' keys."""
    monkeypatch.setattr(fragments, "CELL_ROWS", 100)
    index, df = _index(spark, [500]), _probes(spark, list(range(1000)))
    got = {r.p: (r.succ_k, r.f) for r in index.succ(df, "p").withColumn("f", F.lit(0)).collect()}
    assert got == {p: (500 if p < 500 else None, 0) for p in range(1000)}
    _, n = index._cut(index.df.select("k"), df.select(F.col("p").alias("k")), None)
    assert n == 11
    assert {r.p: r["rank"] for r in index.rank(df, "p").collect()} == {p: int(p >= 500) for p in range(1000)}


def test_hot_first_column_is_cut_by_the_next(spark, monkeypatch):
    monkeypatch.setattr(fragments, "CELL_ROWS", 50)
    rows = [(7 if i % 10 else i, f"s{i:04d}") for i in range(900)] + [(None, "x"), (3, None)]
    df = spark.createDataFrame(rows, "a long, b string")
    cuts = fragments.row_bounds(df, ["a", "b"], len(rows), fragments.cells(len(rows)))
    assert sum(c[0] == 7 for c in cuts) > 10
    got = [(r.a, r.b) for r in sorted(batching.numbered(df, ["a", "b"]).collect(), key=lambda r: r.seq)]
    assert got == [(r.a, r.b) for r in df.orderBy("a", "b").collect()]


def test_slots_of_a_hot_seat(spark):
    routed = spark.createDataFrame([(i, 0 if i % 9 else 1, i % 3 if i % 9 == 0 else 2, 1) for i in range(300)], "seq long, part int, seat int, frag_id int")
    one, many = ({r.seq: r.slot for r in batching.request_slots(routed, cells=n).collect()} for n in (1, 7))
    assert one == many and sorted(one[i] for i in range(300) if i % 9) == list(range(300 - 34))


def test_streamed_gets_and_windows(spark, tmp_path):
    from ordix.streaming.runner import run_gets, windowed

    snap = Snapshots(spark, str(tmp_path / "snap"), "k", ["v"], compact=2)
    for b in range(5):
        upsert_batch(snap, "seq")(spark.createDataFrame([(b, b, 0), (9, b, 1)], "k long, v long, seq long"), b)
    assert snap.versions() == [0, 1, 2, 3, 4] and snap._held("whole") == [0, 3]
    assert {r.k: r.v for r in snap.latest().df.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 4}
    assert {r.k: r.v for r in snap.before(2).df.collect()} == {0: 0, 1: 1, 9: 1}
    snap.prune(2)
    assert snap.versions() == [3, 4] and snap.latest().df.count() == 6
    src, got = str(tmp_path / "probes"), []
    spark.createDataFrame([(9,), (50,)], "p long").write.parquet(src)
    run_gets(spark.readStream.schema("p long").parquet(src), snap, "p", lambda df, b: got.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert {r.p: (r.found, r.v) for r in got} == {9: (True, 4), 50: (False, None)}
    events = str(tmp_path / "events")
    rows = [("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 1), ("2024-01-01 01:05:00", 2)]
    spark.createDataFrame(rows, "t string, u int").select(F.col("t").cast("timestamp").alias("t"), "u").write.parquet(events)
    stream = windowed(spark.readStream.schema("t timestamp, u int").parquet(events), "t", "u", "1 hour", "10 minutes")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.u, r.n) for r in spark.table("windows").collect()) == [(1, 2), (2, 1)]


def test_units_are_spread_and_differ_by_seed(spark):
    rows = spark.range(20_000).select(K.unit(F.col("id")).alias("u"), K.unit(F.col("id"), 1).alias("w")).collect()
    u = sorted(r.u for r in rows)
    assert 0 < u[0] and u[-1] < 1 and len(set(u)) == len(u) and max(abs(x - (i + 0.5) / len(u)) for i, x in enumerate(u)) < 0.02
    assert sum(abs(r.u - r.w) < 1e-3 for r in rows) < 200
    far = spark.range(10**15, 10**15 + 5).select(K.unit(F.col("id"), 3).alias("u")).collect()
    assert all(0 < r.u < 1 for r in far)


def test_report_files(spark, tmp_path):
    from ordix.operators import metrics

    metrics.write_report(metrics.batch_report(spark, [("get", lambda: 5)]), str(tmp_path / "r"))
    rows = spark.read.csv(str(tmp_path / "r"), header=True).collect()
    assert sorted((r.step, r.num_keys) for r in rows) == [("get", "5"), ("total", "5")]


def test_batch_driver(spark, tmp_path):
    from ordix import driver

    keys = [(k, k * 2) for k in range(0, 600, 2)]
    fmap = fragments.equi_width(spark, 4, 3, 599)
    index = OrderedIndex(spark.createDataFrame(keys, "key long, value long"), "key", ["value"])
    rng = random.Random(2)
    rows = [(i, int(rng.random() ** 3 * 600), i) for i in range(4000)]
    requests = spark.createDataFrame(rows, "seq long, key long, value long")
    got, maps = [], []
    report = driver.run(index, requests.drop("value"), fmap, driver.Options("succ", batch=1500, moves=2, parts=4), lambda df, b: got.extend(df.collect()), lambda loads, m, b: maps.append({(r.part, r.seat) for r in m.collect()}))
    assert {r.seq: r.succ_key for r in got} == {i: (k // 2 * 2 + 2 if k < 598 else None) for i, k, _ in rows}
    assert [r.num_keys for r in report.orderBy("batch_num").collect()] == [4000, 1500, 1500, 1000]
    assert len(maps) == 3 and all(len(m) == 12 for m in maps) and maps[0] != maps[-1]
    at = {"df": None}
    driver.run(index, requests, fmap, driver.Options("insert", batch=500, limit=400, parts=4), lambda df, b: at.update(df=df))
    want = dict(keys) | {k: v for _, k, v in rows[:500]}
    assert {r.key: r.value for r in at["df"].collect()} == want
    with pytest.raises(ValueError):
        driver.Options("scan")
    spark.createDataFrame(keys, "key long, value long").write.parquet(str(tmp_path / "index"))
    requests.write.parquet(str(tmp_path / "requests"))
    driver.main(["--index", str(tmp_path / "index"), "--requests", str(tmp_path / "requests"), "-b", "3000", "--parts", "4", "--trees", "3", "--out", str(tmp_path / "out"), "--report", str(tmp_path / "report"), "-q"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000 and spark.read.csv(str(tmp_path / "report"), header=True).count() == 3
    driver.main(["--generate", str(tmp_path / "keys"), "--requests-wanted", "500", "--ranges", "20", "-s"])
    assert workload.read_keys(spark, str(tmp_path / "keys")).count() == 500
