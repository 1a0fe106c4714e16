import random

import pytest

from ordix.operators import fragments
from ordix.operators.index import OrderedIndex
from ordix.plans import maintenance as M

MAP = "frag_id int, lb long, ub long, part int, seat int"


def _map(spark, seed, parts=5, seats=20):
    rng = random.Random(seed)
    rows, at = [], 0
    for p in range(parts):
        for s in sorted(rng.sample(range(seats), rng.randrange(1, 19 if p == 0 else 12))):
            rows.append((len(rows), at, at + 9, p, s))
            at += 10
    return spark.createDataFrame(rows, MAP), rows


def _greedy_memory(rows, parts, soft=14, seats=20):
    used = {p: sorted(r[4] for r in rows if r[3] == p) for p in range(parts)}
    freeing = {p: set() for p in range(parts)}
    out = set()
    for i in range(parts):
        rem, j = len(used[i]) - soft, 0
        while rem > 0:
            n = max(0, min(rem, soft - len(used[j]), seats - len(used[j]) - len(freeing[j])))
            for _ in range(n):
                s = min(used[i])
                to = min(x for x in range(seats) if x not in used[j] and x not in freeing[j])
                out.add((i, s, j, to))
                used[i].remove(s)
                freeing[i].add(s)
                used[j] = sorted([*used[j], to])
            rem -= n
            j += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_memory_plan_against_the_sequential_rule(spark, seed):
    fmap, rows = _map(spark, seed)
    got = {tuple(r) for r in M.memory_plan(fmap, 5).collect()}
    assert got == _greedy_memory(rows, 5)
    after = M.apply_migration(fmap, M.memory_plan(fmap, 5))
    assert max(r["count"] for r in after.groupBy("part").count().collect()) <= 14
    assert after.select("part", "seat").distinct().count() == len(rows)


def _greedy_merge(n_rows, under):
    out, i = [], 0
    while i + 1 < len(n_rows):
        if n_rows[i] + n_rows[i + 1] < under:
            out.append((i, i + 1))
            i += 1
        i += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_plan_against_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(0, 100) for _ in range(30)]
    stats = spark.createDataFrame([(i, i * 10, i * 10 + 9, 0, i, n) for i, n in enumerate(sizes)], MAP + ", n_rows long")
    plan = M.merge_plan(stats, 100)
    assert sorted((r.src_id, r.dst_id) for r in plan.collect()) == _greedy_merge(sizes, 100)
    after = sorted(M.merge_apply(stats.select("frag_id", "lb", "ub", "part", "seat"), plan).collect(), key=lambda r: r.ub)
    assert after[0].lb == 0 and after[-1].ub == 299 and all(a.ub + 1 == b.lb for a, b in zip(after, after[1:], strict=False))


def test_merge_needs_less_than_the_threshold(spark):
    stats = spark.createDataFrame([(0, 0, 9, 0, 0, 50), (1, 10, 19, 0, 1, 50)], MAP + ", n_rows long")
    assert M.merge_plan(stats, 100).count() == 0 and M.merge_plan(stats, 101).count() == 1


def test_split_pieces_and_map(spark):
    fmap = spark.createDataFrame([(0, 0, 999, 0, 0), (1, 1000, 1999, 0, 2)], MAP)
    rows = spark.createDataFrame([(0, k) for k in range(0, 101)] + [(1, 1000 + k) for k in range(40)], "frag_id int, key long")
    stats = rows.groupBy("frag_id").count().withColumnRenamed("count", "n_rows")
    plan = M.split_plan(stats, over=40, target=20)
    assert [tuple(r) for r in plan.collect()] == [(0, 101, 6)]
    pieces = M.split_bounds(rows, plan)
    assert sorted((r.piece, r.n) for r in pieces.collect()) == [(i, 101 * (i + 1) // 6 - 101 * i // 6) for i in range(6)]
    after = sorted(M.apply_split(fmap, pieces).collect(), key=lambda r: r.ub)
    assert len(after) == 7 and after[0].lb == 0 and after[5].ub == 999 and after[-1].ub == 1999
    assert all(a.ub + 1 == b.lb for a, b in zip(after, after[1:], strict=False))
    assert len({(r.part, r.seat) for r in after}) == 7


@pytest.mark.parametrize("extra", [False, True])
def test_balance_moves_less_than_the_difference(spark, extra):
    fmap, rows = _map(spark, 3)
    rng = random.Random(8)
    loads = spark.createDataFrame([(r[0], rng.randrange(0, 2000) * (4 if r[3] == 1 else 1)) for r in rows], "frag_id int, n long")
    plan = M.balance_plan(loads, fmap, 3, extra=extra).collect()
    n = {(r[3], r[4]): x for r, x in zip(rows, [y.n for y in loads.orderBy("frag_id").collect()], strict=True)}
    total = {p: sum(v for (q, _), v in n.items() if q == p) for p in range(5)}
    assert plan and len({r.from_part for r in plan} | {r.to_part for r in plan}) == 2 * len(plan)
    for r in plan:
        assert n[r.from_part, r.from_seat] < total[r.from_part] - total[r.to_part] and (r.to_part, r.to_seat) not in n


def test_balance_skips_a_full_cold_part(spark):
    rows = [(0, 0, 9, 0, 0), (1, 10, 19, 0, 1)] + [(2 + s, 20 + s * 10, 29 + s * 10, 1, s) for s in range(14)] + [(16, 160, 169, 2, 0)]
    fmap = spark.createDataFrame(rows, MAP)
    loads = spark.createDataFrame([(0, 5000), (1, 1000), (16, 300)], "frag_id int, n long")
    assert [tuple(r) for r in M.balance_plan(loads, fmap, 5).collect()] == [(0, 1, 2, 1)]


def test_results_stay_the_same_after_a_rebalance(spark):
    fmap = fragments.equi_width(spark, 4, 3, 999)
    keys = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    index = OrderedIndex(keys.withColumn("v", keys.k + 1), "k", ["v"])
    probes = spark.range(0, 1000, 3).withColumnRenamed("id", "key")
    loads = fragments.requests_per_fragment(fragments.route(probes, fmap))
    moved = M.rebalance(spark, fmap, loads, 4, 2)
    a = {r.key: r.frag_id for r in fragments.route(probes, fmap).collect()}
    b = {r.key: r.frag_id for r in fragments.route(probes, moved).collect()}
    assert a == b and index.get(probes, "key").where("found").count() == len([k for k in range(0, 1000, 3) if k % 7 == 0])


def _greedy_merge_seats(rows, under, seats):
    used = {}
    for r in rows:
        used[r[3]] = used.get(r[3], 0) + 1
    out, i = [], 0
    while i + 1 < len(rows):
        a, b = rows[i], rows[i + 1]
        if a[5] + b[5] < under and (a[3] == b[3] or used[b[3]] < seats):
            if a[3] != b[3]:
                used[a[3]] -= 1
                used[b[3]] += 1
            out.append((a[0], b[0]))
            i += 1
        i += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_passes_over_full_parts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, i * 10, i * 10 + 9, rng.randrange(6), 0, rng.randrange(0, 80)) for i in range(40)]
    stats = spark.createDataFrame(rows, MAP + ", n_rows long")
    got = sorted((r.src_id, r.dst_id) for r in M.merge_plan(stats, 100, seats=7).collect())
    assert got == _greedy_merge_seats(rows, 100, 7) and got != _greedy_merge_seats(rows, 100, 99)


def test_balance_gives_to_empty_parts_first(spark):
    rows = [(0, 0, 9, 0, 0), (1, 10, 19, 0, 1), (2, 20, 29, 1, 0)]
    fmap = spark.createDataFrame(rows, MAP)
    loads = spark.createDataFrame([(0, 5000), (1, 1000), (2, 300)], "frag_id int, n long")
    assert [tuple(r) for r in M.balance_plan(loads, fmap, 5, parts=4).collect()] == [(0, 0, 3, 0)]
    freeing = spark.createDataFrame([(3, 0), (3, 2)], "part int, seat int")
    assert [tuple(r) for r in M.balance_plan(loads, fmap, 5, parts=4, freeing=freeing).collect()] == [(0, 0, 3, 1)]
    full = spark.createDataFrame([(3, s) for s in range(20)], "part int, seat int")
    assert [tuple(r) for r in M.balance_plan(loads, fmap, 5, parts=4, freeing=full).collect()] == [(0, 0, 2, 0)]


def test_empty_parts_are_reported(spark):
    fmap = spark.createDataFrame([(0, 0, 9, 1, 0), (1, 10, 19, 1, 1)], MAP)
    probes = spark.createDataFrame([(3,), (4,), (12,)], "key long")
    per = fragments.requests_per_fragment(probes, fmap)
    assert sorted(map(tuple, fragments.requests_per_part(per, 3).collect())) == [(0, 0), (1, 3), (2, 0)]
    assert sorted(map(tuple, fragments.first_free_seat(fmap, parts=3).collect())) == [(0, 0), (1, 2), (2, 0)]
