"""Registered queries and their SQL oracles, side by side.

Thresholds are scaled to the test tables and shared by both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import driver
from .functions import keys as K
from .operators import batching, fragments, metrics
from .operators.index import OrderedIndex, last_wins
from .plans import maintenance
from .sources import workload
from .streaming import runner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Parts and fragments a part of the routing map.
PARTS, TREES = 10, 3
N = PARTS * TREES


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, d, where: str | None = None) -> OrderedIndex:
    df = table(spark, d, "orders")
    return OrderedIndex(df.where(where) if where else df, "o_orderkey", ["o_totalprice"])


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


# --- lookups ------------------------------------------------------------------

_GET = "SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey IS NOT NULL AS found, o_totalprice FROM lineitem LEFT JOIN {} ON l_orderkey = o_orderkey"


@query("point_get", _GET.format("orders"))
def _(spark, d):
    return _orders(spark, d).get(_lines(spark, d), "l_orderkey")


@query("point_get_miss", _GET.format("(SELECT * FROM orders WHERE o_orderkey % 3 = 0)"))
def _(spark, d):
    return _orders(spark, d, "o_orderkey % 3 = 0").get(_lines(spark, d), "l_orderkey")


@query("point_get_zero", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey IS NOT NULL AS found, coalesce(o_totalprice, 0) AS o_totalprice FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) ON l_orderkey = o_orderkey")
def _(spark, d):
    return _orders(spark, d, "o_orderkey % 3 = 0").get(_lines(spark, d), "l_orderkey", compat_zero=True)


@query("get_dup_probes", "SELECT o_custkey, c_custkey IS NOT NULL AS found, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def _(spark, d):
    index = OrderedIndex(table(spark, d, "customer").where("c_custkey % 2 = 0"), "c_custkey", ["c_name"])
    return index.get(table(spark, d, "orders").select("o_custkey"), "o_custkey")


@query("get_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 = 0)")
def _(spark, d):
    return _orders(spark, d, "o_orderkey % 3 = 0").semi(_lines(spark, d), "l_orderkey")


@query("get_anti", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 = 0)")
def _(spark, d):
    return _orders(spark, d, "o_orderkey % 3 = 0").anti(_lines(spark, d), "l_orderkey")


# Thinned, and with a gap that empties whole fragments.
_SPARSE = "o_orderkey % 7 = 0 AND o_orderkey NOT BETWEEN 3000 AND 8999"
_SUCC = f"SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey AS succ_o_orderkey, o_totalprice AS succ_o_totalprice FROM lineitem ASOF LEFT JOIN (SELECT * FROM orders WHERE {_SPARSE}) ON l_orderkey < o_orderkey"


@query("succ_global", _SUCC)
def _(spark, d):
    return _orders(spark, d, _SPARSE).succ(_lines(spark, d), "l_orderkey")


@query("succ_small", f"SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey AS succ_o_orderkey FROM lineitem ASOF LEFT JOIN (SELECT * FROM orders WHERE {_SPARSE}) ON l_orderkey < o_orderkey")
def _(spark, d):
    return _orders(spark, d, _SPARSE).succ_small(_lines(spark, d), "l_orderkey")


@query("succ_exact_hit", f"SELECT p.o_orderkey AS k, i.o_orderkey AS succ_o_orderkey, i.o_totalprice AS succ_o_totalprice FROM (SELECT o_orderkey FROM orders WHERE {_SPARSE}) p ASOF LEFT JOIN (SELECT * FROM orders WHERE {_SPARSE}) i ON p.o_orderkey < i.o_orderkey")
def _(spark, d):
    index = _orders(spark, d, _SPARSE)
    return index.succ(index.df.select(F.col("o_orderkey").alias("k")), "k")


@query("succ_past_end", "SELECT p.k, i.o_orderkey AS succ_o_orderkey, i.o_totalprice AS succ_o_totalprice FROM (SELECT o_orderkey + (SELECT max(o_orderkey) // 2 FROM orders) AS k FROM orders) p ASOF LEFT JOIN orders i ON p.k < i.o_orderkey")
def _(spark, d):
    orders = table(spark, d, "orders")
    top = orders.agg(F.max("o_orderkey")).first()[0] or 0
    return _orders(spark, d).succ(orders.select((F.col("o_orderkey") + top // 2).alias("k")), "k")


@query("succ_window", "SELECT o_custkey, o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS succ_o_orderkey, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS succ_o_totalprice FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders")
    index = OrderedIndex(orders, "o_orderkey", ["o_totalprice"], group="o_custkey")
    return index.succ(orders.select("o_custkey", F.col("o_orderkey").alias("k")), "k")


@query("succ_by_group", "SELECT p.event_id AS k, p.user_id, n.event_id AS succ_event_id, n.event_type AS succ_event_type FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN events n ON p.user_id = n.user_id AND p.event_id < n.event_id")
def _(spark, d):
    events = table(spark, d, "events")
    index = OrderedIndex(events, "event_id", ["event_type"], group="user_id")
    return index.succ(events.where("event_type = 'purchase'").select(F.col("event_id").alias("k"), "user_id"), "k")


@query("pred_global", f"SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey AS pred_o_orderkey, o_totalprice AS pred_o_totalprice FROM lineitem ASOF LEFT JOIN (SELECT * FROM orders WHERE {_SPARSE}) ON l_orderkey > o_orderkey")
def _(spark, d):
    return _orders(spark, d, _SPARSE).pred(_lines(spark, d), "l_orderkey")


_RANGES = "SELECT s_suppkey * 13 AS k, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY s_suppkey ORDER BY o_orderkey) AS place FROM supplier JOIN orders ON o_orderkey >= s_suppkey * 13 AND o_orderkey < s_suppkey * 13 + 40"
# Every probe twice, once beside an odd and once beside an even number.
_TWICE = "SELECT l_suppkey * 13 AS k, l_linenumber % 2 AS odd FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem)"


def _suppliers(spark, d):
    return table(spark, d, "supplier").select((F.col("s_suppkey") * 13).alias("k"))


@query("range_scan", f"SELECT k, place, o_orderkey, o_totalprice FROM ({_RANGES}) WHERE place <= 10")
def _(spark, d):
    return _orders(spark, d).range(_suppliers(spark, d), "k", 10, 40)


@query("range_dup_probes", f"SELECT t.k, odd, place, o_orderkey, o_totalprice FROM ({_TWICE}) t JOIN ({_RANGES}) r ON r.k = t.k WHERE place <= 4")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    probes = lines.select((F.col("l_suppkey") * 13).alias("k"), (F.col("l_linenumber") % 2).alias("odd"))
    return _orders(spark, d).range(probes, "k", 4, 40)


@query("range_count", f"SELECT k, CAST(count(*) AS BIGINT) AS n FROM ({_RANGES}) GROUP BY k")
def _(spark, d):
    return _orders(spark, d).range(_suppliers(spark, d), "k", 40, 40).groupBy("k").agg(F.count("*").alias("n"))


@query("tail_scan", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def _(spark, d):
    return _orders(spark, d).tail(100)


@query("key_rank", "SELECT k, CAST((SELECT count(*) FROM orders WHERE o_orderkey <= k) AS BIGINT) AS rank FROM (SELECT c_custkey * 9 - 50 AS k FROM customer)")
def _(spark, d):
    probes = table(spark, d, "customer").select((F.col("c_custkey") * 9 - 50).alias("k"))
    return _orders(spark, d).rank(probes, "k")


@query("ordered_scan", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def _(spark, d):
    return batching.numbered(_orders(spark, d).scan(100, 5000), ["o_orderkey"])


# --- fragments and routing ------------------------------------------------------

_MAP = f"""top AS (SELECT max(o_orderkey) AS m FROM orders),
fmap AS (SELECT CAST(i AS INTEGER) AS frag_id, CASE WHEN i = 0 THEN 0 ELSE (m // {N}) * i + ((m % {N}) * i) // {N} + 1 END AS lb, (m // {N}) * (i + 1) + ((m % {N}) * (i + 1)) // {N} AS ub, CAST(i // {TREES} AS INTEGER) AS part, CAST(i % {TREES} AS INTEGER) AS seat FROM range({N}) t(i), top)"""


def _map(spark, d) -> DataFrame:
    return fragments.equi_width(spark, PARTS, TREES, table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0)


@query("equi_width_bounds", f"SELECT CAST(i AS INTEGER) AS frag_id, CAST(i // 12 AS INTEGER) AS part, CAST(i % 12 AS INTEGER) AS seat, CAST(CAST({K.KEY_MAX} AS HUGEINT) // 30000 * (i + 1) + (CAST({K.KEY_MAX} AS HUGEINT) % 30000 * (i + 1)) // 30000 AS VARCHAR) AS ub FROM range(30000) t(i)")
def _(spark, d):
    return fragments.equi_width(spark, 2500, 12).select("frag_id", "part", "seat", F.col("ub").cast("string").alias("ub"))


@query("bulk_load_series", f"""WITH m AS (SELECT CAST({K.KEY_MAX} AS HUGEINT) AS m),
f AS (SELECT i, CASE WHEN i = 0 THEN 0 ELSE m // {N} * i + (m % {N} * i) // {N} + 1 END AS lb, m // {N} * (i + 1) + (m % {N} * (i + 1)) // {N} AS ub FROM range({N}) t(i), m),
k AS (SELECT CAST(j AS HUGEINT) * (m // 20000) AS k FROM range(20001) t(j), m)
SELECT CAST(i AS INTEGER) AS frag_id, CAST(k AS VARCHAR) AS key, CAST(k AS VARCHAR) AS value FROM k, f WHERE k BETWEEN lb AND ub""")
def _(spark, d):
    return workload.bulk_load(fragments.equi_width(spark, PARTS, TREES), 20000).select("frag_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _routed(spark, d, strict=False) -> DataFrame:
    probes = _lines(spark, d).withColumnRenamed("l_orderkey", "key")
    return fragments.route(probes, _map(spark, d), strict=strict)


def _loads(spark, d) -> DataFrame:
    return fragments.requests_per_fragment(_lines(spark, d).withColumnRenamed("l_orderkey", "key"), _map(spark, d))


@query("route_get", f"WITH {_MAP} SELECT l_orderkey AS key, l_linenumber, l_partkey, frag_id, part, seat FROM lineitem JOIN fmap ON l_orderkey BETWEEN lb AND ub")
def _(spark, d):
    return _routed(spark, d)


@query("route_succ", f"WITH {_MAP} SELECT l_orderkey AS key, l_linenumber, l_partkey, frag_id, part, seat FROM lineitem LEFT JOIN fmap ON l_orderkey + 1 BETWEEN lb AND ub")
def _(spark, d):
    return _routed(spark, d, strict=True)


@query("route_equi_depth", "SELECT l_orderkey AS key, l_linenumber, l_partkey, true AS inside, true AS alone FROM lineitem")
def _(spark, d):
    """Every request lies in the fragment it is routed to, and in no other one."""
    orders = table(spark, d, "orders")
    fmap = fragments.equi_depth(orders, "o_orderkey", PARTS, TREES, 2**62)
    routed = fragments.route(_lines(spark, d).withColumnRenamed("l_orderkey", "key"), fmap)
    bounds = F.lit([r.lb for r in fmap.orderBy("lb").collect()])
    own = fmap.select("frag_id", "lb", "ub")
    placed = routed.join(F.broadcast(own), "frag_id", "left")
    return placed.select("key", "l_linenumber", "l_partkey", F.coalesce(F.col("key").between(F.col("lb"), F.col("ub")), F.lit(False)).alias("inside"), (F.array_size(F.filter(bounds, lambda b: (b > F.col("lb")) & (b <= F.col("key")))) == 0).alias("alone"))


_ROUTED = f"{_MAP}, routed AS (SELECT l_orderkey AS key, frag_id, part, seat FROM lineitem JOIN fmap ON l_orderkey BETWEEN lb AND ub), loads AS (SELECT frag_id, part, seat, CAST(count(*) AS BIGINT) AS n FROM routed GROUP BY ALL), parts AS (SELECT part, CAST(sum(n) AS BIGINT) AS n FROM loads GROUP BY part)"


@query("requests_per_fragment", f"WITH {_ROUTED} SELECT * FROM loads")
def _(spark, d):
    return _loads(spark, d)


@query("requests_per_part", f"WITH {_ROUTED} SELECT * FROM parts")
def _(spark, d):
    return fragments.requests_per_part(_loads(spark, d))


@query("max_part_load", f"WITH {_ROUTED} SELECT max(n) AS max_n FROM parts")
def _(spark, d):
    return metrics.max_load(fragments.requests_per_part(_loads(spark, d)))


@query("hot_parts", f"WITH {_ROUTED} SELECT part, n, row_number() OVER (ORDER BY n DESC, part) AS rank FROM parts")
def _(spark, d):
    return fragments.hot_parts(fragments.requests_per_part(_loads(spark, d)))


@query("frag_stats", f"WITH {_MAP} SELECT frag_id, lb, ub, part, seat, CAST(count(o_orderkey) AS BIGINT) AS n_rows, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM fmap LEFT JOIN (SELECT o_orderkey FROM orders WHERE {_SPARSE}) ON o_orderkey BETWEEN lb AND ub GROUP BY frag_id, lb, ub, part, seat")
def _(spark, d):
    return fragments.stats(_orders(spark, d, _SPARSE).df, _map(spark, d), "o_orderkey")


# --- batches ------------------------------------------------------------------

_UMAP = f"""utop AS (SELECT max(user_id) AS m FROM events),
umap AS (SELECT CAST(i AS INTEGER) AS frag_id, CASE WHEN i = 0 THEN 0 ELSE (m // {N}) * i + ((m % {N}) * i) // {N} + 1 END AS lb, (m // {N}) * (i + 1) + ((m % {N}) * (i + 1)) // {N} AS ub, CAST(i // {TREES} AS INTEGER) AS part, CAST(i % {TREES} AS INTEGER) AS seat FROM range({N}) t(i), utop),
req AS (SELECT event_id AS seq, user_id AS key, frag_id, part, seat FROM events JOIN umap ON user_id BETWEEN lb AND ub),
ends AS (SELECT part, seat, n, CAST(sum(n) OVER (PARTITION BY part ORDER BY seat) AS BIGINT) AS end_idx FROM (SELECT part, seat, CAST(count(*) AS BIGINT) AS n FROM req GROUP BY part, seat))"""


def _requests(spark, d) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))
    return fragments.route(events, fragments.equi_width(spark, PARTS, TREES, events.agg(F.max("key")).first()[0] or 0))


@query("prefix_end_index", f"WITH {_UMAP} SELECT * FROM ends")
def _(spark, d):
    return batching.prefix_end_index(_requests(spark, d))


@query("request_slots", f"WITH {_UMAP} SELECT seq, key, frag_id, part, seat, CAST(end_idx - n + row_number() OVER (PARTITION BY part, seat ORDER BY seq) - 1 AS BIGINT) AS slot FROM req JOIN ends USING (part, seat)")
def _(spark, d):
    return batching.request_slots(_requests(spark, d))


_SEQ = "WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, event_id, count(*) OVER () AS n FROM events)"


def _numbered(spark, d) -> tuple[DataFrame, int]:
    events = table(spark, d, "events").select("event_id")
    return batching.numbered(events, ["event_id"]), events.count()


@query("equal_slices", f"{_SEQ}, c AS (SELECT i, n * i // 24 AS lo, n * (i + 1) // 24 AS hi FROM range(24) t(i), (SELECT count(*) AS n FROM events)) SELECT seq, event_id, i AS slice FROM s JOIN c ON seq >= lo AND seq < hi")
def _(spark, d):
    rows, n = _numbered(spark, d)
    return batching.equal_slices(rows, n, 24)


@query("tasklet_slices", f"{_SEQ} SELECT seq, event_id, CAST(CASE WHEN n // 24 = 0 THEN 23 ELSE least(seq // (n // 24), 23) END AS BIGINT) AS tasklet FROM s")
def _(spark, d):
    rows, n = _numbered(spark, d)
    return batching.tasklet_slices(rows, n, 24)


@query("batch_slices", f"{_SEQ} SELECT seq, event_id, seq // 128 AS batch_id FROM s WHERE seq < 768")
def _(spark, d):
    return batching.batch_slices(_numbered(spark, d)[0], batch=128, limit=700)


# --- change -------------------------------------------------------------------

_HALF = "(SELECT max(event_id) // 2 FROM events)"


def _halves(spark, d) -> tuple[OrderedIndex, DataFrame]:
    events = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    half = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    # Users of odd ids are new to the second half.
    first = last_wins(events.where((F.col("event_id") < half) & (F.col("user_id") % 2 == 0)), "user_id", ["value", "event_type"], "event_id")
    return OrderedIndex(first.select("user_id", "__v.value", "__v.event_type"), "user_id", ["value", "event_type"]), events.where(F.col("event_id") >= half)


@query("upsert_last_wins", f"SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id >= {_HALF} OR user_id % 2 = 0 GROUP BY user_id")
def _(spark, d):
    index, batch = _halves(spark, d)
    return index.upsert(batch, "event_id")


@query("upsert_counts", f"WITH old AS (SELECT DISTINCT user_id FROM events WHERE event_id < {_HALF} AND user_id % 2 = 0), new AS (SELECT user_id, count(*) AS n FROM events WHERE event_id >= {_HALF} GROUP BY user_id) SELECT CAST(count(*) FILTER (old.user_id IS NULL) AS BIGINT) AS inserted, CAST(count(old.user_id) AS BIGINT) AS updated, CAST(sum(n) AS BIGINT) AS rows FROM new LEFT JOIN old USING (user_id)")
def _(spark, d):
    index, batch = _halves(spark, d)
    return index.upsert_counts(batch)


@query("delete_keys", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def _(spark, d):
    return _orders(spark, d).delete(table(spark, d, "lineitem").where("l_quantity > 25"), "l_orderkey")


@query("get_after_batches", "WITH e AS (SELECT *, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS b FROM events) SELECT p.event_id, p.user_id, count(o.event_id) > 0 AS found, arg_max(o.value, o.event_id) AS value FROM e p LEFT JOIN e o ON o.user_id = p.user_id AND o.b < p.b GROUP BY p.event_id, p.user_id")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    n = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    index = OrderedIndex(events.limit(0), "user_id", ["value"])
    out = None
    for b in range(4):
        batch = events.where(F.floor(F.col("event_id") * 4 / n) == b)
        got = index.get(batch.select("event_id", "user_id"), "user_id")
        out = got if out is None else out.unionByName(got)
        index = OrderedIndex(index.upsert(batch, "event_id"), "user_id", ["value"])
    return out


# --- split, merge, balance -----------------------------------------------------

_OVER, _TARGET = 400, 200
_BUCKETS = "SELECT CAST(user_id % 8 * (user_id % 8) % 11 AS INTEGER) AS frag_id, event_id AS key FROM events"


def _buckets(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 8 * (F.col("user_id") % 8) % 11).cast("int").alias("frag_id"), F.col("event_id").alias("key"))


def _bucket_plan(spark, d) -> DataFrame:
    return maintenance.split_plan(_buckets(spark, d).groupBy("frag_id").agg(F.count("*").alias("n_rows")), _OVER, _TARGET)


_SPLIT = f"WITH b AS ({_BUCKETS}), plan AS (SELECT frag_id, CAST(count(*) AS BIGINT) AS n_rows, CAST((count(*) + {_TARGET} - 1) // {_TARGET} AS BIGINT) AS pieces FROM b GROUP BY frag_id HAVING count(*) > {_OVER})"


@query("split_plan", f"{_SPLIT} SELECT * FROM plan")
def _(spark, d):
    return _bucket_plan(spark, d)


@query("split_bounds", f"{_SPLIT}, cuts AS (SELECT frag_id, i AS piece, n_rows * i // pieces AS lo, n_rows * (i + 1) // pieces AS hi FROM plan, LATERAL (SELECT unnest(range(pieces)) AS i)), r AS (SELECT frag_id, key, row_number() OVER (PARTITION BY frag_id ORDER BY key) - 1 AS r FROM b) SELECT cuts.frag_id, piece, CAST(count(*) AS BIGINT) AS n, max(key) AS ub FROM cuts JOIN r ON r.frag_id = cuts.frag_id AND r >= lo AND r < hi GROUP BY cuts.frag_id, piece")
def _(spark, d):
    return maintenance.split_bounds(_buckets(spark, d), _bucket_plan(spark, d))


# Squared keys over the whole table: the upper fragments hold few.
_UNEVEN = "SELECT o_orderkey * o_orderkey // (SELECT max(o_orderkey) FROM orders) AS o_orderkey FROM orders"
_STATS = f"{_MAP}, stats AS (SELECT frag_id, lb, ub, part, seat, CAST(count(o_orderkey) AS BIGINT) AS n_rows FROM fmap LEFT JOIN ({_UNEVEN}) ON o_orderkey BETWEEN lb AND ub GROUP BY frag_id, lb, ub, part, seat), lim AS (SELECT 2 * count(*) // {N} AS under FROM ({_UNEVEN})), cand AS (SELECT frag_id, part, seat, ub, n_rows, lead(frag_id) OVER (ORDER BY ub) AS right_id, lead(n_rows) OVER (ORDER BY ub) AS right_rows, row_number() OVER (ORDER BY ub) AS pos FROM stats)"


def _uneven(spark, d) -> tuple[DataFrame, int]:
    orders = table(spark, d, "orders")
    top = orders.agg(F.max("o_orderkey")).first()[0] or 1
    rows = orders.select(F.expr(f"o_orderkey * o_orderkey div {max(top, 1)}").alias("o_orderkey"))
    return fragments.stats(rows, _map(spark, d), "o_orderkey"), 2 * rows.count() // N


@query("merge_candidates", f"WITH {_STATS} SELECT cand.*, n_rows + right_rows AS pair_rows, coalesce(n_rows + right_rows < under, false) AS mergeable FROM cand, lim")
def _(spark, d):
    return maintenance.merge_candidates(*_uneven(spark, d))


# The oracle takes the greedy scan step by step.
_MERGE = f"{_STATS.replace('top AS', 'RECURSIVE top AS', 1)}, scan(pos, skip, src_id, dst_id, pair_rows) AS (SELECT CAST(0 AS BIGINT), false, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT) UNION ALL SELECT c.pos, NOT s.skip AND coalesce(c.n_rows + c.right_rows < under, false), c.frag_id, c.right_id, c.n_rows + c.right_rows FROM scan s JOIN cand c ON c.pos = s.pos + 1, lim), plan AS (SELECT src_id, dst_id, pair_rows FROM scan WHERE skip)"


@query("merge_plan", f"WITH {_MERGE} SELECT * FROM plan")
def _(spark, d):
    return maintenance.merge_plan(*_uneven(spark, d))


@query("merge_apply", f"WITH {_MERGE} SELECT f.frag_id, coalesce(g.lb, f.lb) AS lb, f.ub, f.part, f.seat FROM fmap f LEFT JOIN plan p ON p.dst_id = f.frag_id LEFT JOIN fmap g ON g.frag_id = p.src_id WHERE f.frag_id NOT IN (SELECT src_id FROM plan)")
def _(spark, d):
    stats, under = _uneven(spark, d)
    return maintenance.merge_apply(stats.select("frag_id", "lb", "ub", "part", "seat"), maintenance.merge_plan(stats, under))


# Squared keys make the low fragments hot.
_SKEWED = f"{_MAP}, own AS (SELECT part, seat, frag_id, CAST(count(key) AS BIGINT) AS n FROM fmap LEFT JOIN (SELECT l_orderkey * l_orderkey // m AS key FROM lineitem, top) ON key BETWEEN lb AND ub GROUP BY part, seat, frag_id)"
_MOVES = 4


def _skewed(spark, d) -> tuple[DataFrame, DataFrame]:
    fmap = _map(spark, d)
    top = fmap.agg(F.max("ub")).first()[0]
    probes = _lines(spark, d).select(F.expr(f"l_orderkey * l_orderkey div {max(top, 1)}").alias("key"))
    return fragments.requests_per_fragment(probes, fmap), fmap


_BALANCE = f"""WITH {_SKEWED}, per AS (SELECT part, CAST(sum(n) AS BIGINT) AS total, count(*) AS used FROM own GROUP BY part),
hot AS (SELECT part, total, used, row_number() OVER (ORDER BY total DESC, part) AS r FROM per), cold AS (SELECT part, total, row_number() OVER (ORDER BY total, part DESC) AS r FROM per),
pairs AS (SELECT hot.part AS h, cold.part AS c, hot.total - cold.total AS diff, used, r FROM hot JOIN cold USING (r) WHERE r <= {PARTS} // 2),
ok AS (SELECT *, bool_and(used > 1 AND diff >= MIN_DIFF) OVER (ORDER BY r) AS going FROM pairs)
SELECT h AS from_part, CAST(arg_min(seat, abs(2 * n - diff) * 100 + seat) AS INTEGER) AS from_seat, c AS to_part, {TREES} AS to_seat FROM ok JOIN own ON part = h WHERE going AND r <= {_MOVES} AND n < diff GROUP BY h, c"""


@query("balance_plan", _BALANCE.replace("MIN_DIFF", "40"))
def _(spark, d):
    return maintenance.balance_plan(*_skewed(spark, d), _MOVES, min_diff=40)


@query("balance_plan_extra", _BALANCE.replace("MIN_DIFF", "0"))
def _(spark, d):
    return maintenance.balance_plan(*_skewed(spark, d), _MOVES, extra=True)


@query("balance_plan_sql", _BALANCE.replace("MIN_DIFF", "40"))
def _(spark, d):
    return maintenance.balance_plan_sql(*_skewed(spark, d), _MOVES, min_diff=40)


# 120 fragments: two parts over the soft limit, every fifth seat of the rest free.
_CROWDED = "seats AS (SELECT CAST(i AS INTEGER) AS frag_id, i * 10 AS lb, i * 10 + 9 AS ub, CAST(CASE WHEN i < 18 THEN 0 WHEN i < 36 THEN 1 ELSE 2 + i % 8 END AS INTEGER) AS part FROM range(120) t(i) WHERE i < 36 OR i % 5 <> 0), crowded AS (SELECT frag_id, lb, ub, part, CAST(CASE WHEN part < 2 THEN frag_id % 18 ELSE (frag_id - 36) // 8 END AS INTEGER) AS seat FROM seats)"
_PLAN = f"{_CROWDED}, n AS (SELECT p, count(frag_id) AS n FROM range(10) t(p) LEFT JOIN crowded ON part = p GROUP BY p), going AS (SELECT part, seat, row_number() OVER (ORDER BY part, seat) AS r FROM (SELECT part, seat, row_number() OVER (PARTITION BY part ORDER BY seat) AS k, n FROM crowded JOIN n ON p = part) WHERE k <= n - 14), free AS (SELECT p, s, row_number() OVER (PARTITION BY p ORDER BY s) AS k FROM range(10) t(p), range(20) u(s) WHERE NOT EXISTS (SELECT 1 FROM crowded WHERE part = p AND seat = s)), coming AS (SELECT p, s, row_number() OVER (ORDER BY p, s) AS r FROM free JOIN n USING (p) WHERE k <= 14 - n), moves AS (SELECT part AS from_part, seat AS from_seat, CAST(p AS INTEGER) AS to_part, CAST(s AS INTEGER) AS to_seat FROM going JOIN coming USING (r))"


def _crowded(spark) -> DataFrame:
    i = F.col("id")
    part = F.when(i < 18, 0).when(i < 36, 1).otherwise(2 + i % 8).cast("int")
    rows = spark.range(120).where((i < 36) | (i % 5 != 0)).select(i.cast("int").alias("frag_id"), (i * 10).alias("lb"), (i * 10 + 9).alias("ub"), part.alias("part"))
    return rows.withColumn("seat", F.when(F.col("part") < 2, F.col("frag_id") % 18).otherwise(F.floor((F.col("frag_id") - 36) / 8)).cast("int"))


@query("memory_plan", f"WITH {_PLAN} SELECT * FROM moves")
def _(spark, d):
    return maintenance.memory_plan(_crowded(spark), 10)


@query("apply_migration", f"WITH {_PLAN} SELECT frag_id, lb, ub, coalesce(to_part, part) AS part, coalesce(to_seat, seat) AS seat FROM crowded LEFT JOIN moves ON from_part = part AND from_seat = seat")
def _(spark, d):
    fmap = _crowded(spark)
    return maintenance.apply_migration(fmap, maintenance.memory_plan(fmap, 10))


@query("first_free_seat", f"WITH {_CROWDED} SELECT part, CAST((SELECT min(s) FROM range(20) u(s) WHERE s NOT IN (SELECT seat FROM crowded c WHERE c.part = p.part)) AS INTEGER) AS seat FROM (SELECT DISTINCT part FROM crowded) p")
def _(spark, d):
    return fragments.first_free_seat(_crowded(spark))


@query("seat_bitmap", f"WITH {_CROWDED} SELECT part, bit_or(CAST(1 AS BIGINT) << seat) AS used, CAST(count(*) AS BIGINT) AS n_used FROM crowded GROUP BY part")
def _(spark, d):
    return fragments.seat_bitmap(_crowded(spark))


_STEPS = [(1, 0, 3, 4, 1), (2, 4, 1, 7, 2), (3, 7, 2, 1, 5), (4, 2, 2, 5, 0), (5, 5, 0, 6, 6), (6, 8, 1, 9, 1)]


@query("migration_chain", "SELECT * FROM (VALUES (0, 3, 1, 5), (2, 2, 6, 6), (8, 1, 9, 1)) t(from_part, from_seat, to_part, to_seat)")
def _(spark, d):
    return maintenance.resolve(spark.createDataFrame(_STEPS, "step int, from_part int, from_seat int, to_part int, to_seat int"))


# --- workload and scalar functions ----------------------------------------------

_FNV = f"CAST(list_reduce([CAST({K.FNV_BASIS} AS HUGEINT)] || list_transform(range(8), lambda i: CAST((x >> (i * 8)) & 255 AS HUGEINT)), lambda h, o: (xor(h, o) * {K.FNV_PRIME}) % 18446744073709551616) AS HUGEINT)"


@query("fnv_hash", f"SELECT x, CAST({_FNV} AS VARCHAR) AS h FROM (SELECT i * 1234567891011 AS x FROM range(5000) t(i))")
def _(spark, d):
    x = spark.range(5000).select((F.col("id") * 1234567891011).alias("x"))
    return x.select("x", K.fnv_hash(F.col("x")).cast("string").alias("h"))


@query("task_word", "SELECT task, operand, (operand << 32) | task AS word, task AS task_back, operand AS operand_back FROM (SELECT i % 13 AS task, i * 7 AS operand FROM range(1000) t(i))")
def _(spark, d):
    rows = spark.range(1000).select((F.col("id") % 13).alias("task"), (F.col("id") * 7).alias("operand")).withColumn("word", K.task_word(F.col("task"), F.col("operand")))
    return rows.withColumn("task_back", K.task_id(F.col("word"))).withColumn("operand_back", K.task_operand(F.col("word")))


_ZN, _ZC = 500, 20_000


def _zipf_sql(theta: float, seed: int = 0, count: int = _ZC) -> str:
    c = workload.zipf_constants(_ZN, theta)
    far = f"least(floor({float(_ZN)}::DOUBLE * pow({c['eta']!r}::DOUBLE * u - {c['eta']!r}::DOUBLE + 1, {c['alpha']!r}::DOUBLE)), {_ZN - 1})"
    units = f"SELECT i, (CAST({_FNV} // 4096 AS DOUBLE) + 0.5) / {float(1 << 52)}::DOUBLE AS u FROM (SELECT i, xor(i, {K.seed_bits(seed)}) AS x FROM range({count}) t(i))"
    return f"SELECT i AS seq, CAST(CASE WHEN u * {c['zeta']!r}::DOUBLE < 1 THEN 0 WHEN u * {c['zeta']!r}::DOUBLE < {c['two']!r}::DOUBLE THEN 1 ELSE {far} END AS BIGINT) AS which_range FROM ({units})"


@query("zipf_ranks", " UNION ALL ".join(f"SELECT {t!r}::DOUBLE AS theta, seq, which_range FROM ({_zipf_sql(t)})" for t in (0.2, 0.6, 0.99, 1.2)))
def _(spark, d):
    out = None
    for t in (0.2, 0.6, 0.99, 1.2):
        rows = spark.range(_ZC).select(F.lit(t).alias("theta"), F.col("id").alias("seq"), workload.zipf_rank(K.unit(F.col("id")), _ZN, t).alias("which_range"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("zipf_histogram", f"SELECT which_range, CAST(count(*) AS BIGINT) AS n, count(*) * 100 / {_ZC}::DOUBLE AS percent FROM ({_zipf_sql(0.99)}) GROUP BY which_range")
def _(spark, d):
    return workload.zipf_histogram(workload.zipf_keys(spark, _ZC, _ZN, 0.99))


_WIDTH = K.KEY_MAX // _ZN
_KEYED = f"CAST(CAST(which_range AS HUGEINT) * {_WIDTH} + {_FNV.replace('(x >>', '(seq >>')} % {_WIDTH} AS VARCHAR)"


@query("zipf_keys", f"SELECT seq, which_range, {_KEYED} AS key FROM ({_zipf_sql(0.6)})")
def _(spark, d):
    return workload.zipf_keys(spark, _ZC, _ZN, 0.6).withColumn("key", F.col("key").cast("string"))


@query("zipf_scrambled", f"SELECT seq, which_range, {_KEYED} AS key FROM (SELECT seq, CAST({_FNV.replace('(x >>', '(r >>')} % {_ZN} AS BIGINT) AS which_range FROM (SELECT seq, which_range AS r FROM ({_zipf_sql(0.99)})))")
def _(spark, d):
    return workload.zipf_keys(spark, _ZC, _ZN, 0.99, scrambled=True).withColumn("key", F.col("key").cast("string"))


@query("str_to_bool", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS b FROM documents")
def _(spark, d):
    word = F.element_at(F.array(F.lit("TRUE"), F.lit("1"), F.lit("False"), F.lit("0")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", K.str_to_bool(word).alias("b"))


@query("trim_ws", "SELECT doc_id, source AS t FROM documents")
def _(spark, d):
    padded = F.concat(F.lit(" \t\n"), F.col("source"), F.lit("\r\n  "))
    return table(spark, d, "documents").select("doc_id", K.trim_ws(padded).alias("t"))


@query("keys_intersect", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 = 0 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 25")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key")).intersect(table(spark, d, "lineitem").where("l_quantity > 25").select("l_orderkey"))


@query("keys_except", "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 25")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key")).exceptAll(table(spark, d, "lineitem").where("l_quantity > 25").select("l_orderkey")).distinct()


# --- reports ------------------------------------------------------------------

# Parts for the transfer report are users, 64 to a rank.
_BYTES = "SELECT user_id AS part, CAST(count(*) * 16 AS BIGINT) AS bytes FROM events GROUP BY user_id"


@query("rank_xfer_cost", f"SELECT CAST(sum(most * 64) AS BIGINT) AS total_bytes, CAST(sum(asked) AS BIGINT) AS effective_bytes, sum(asked) * 100 / CAST(sum(most * 64) AS DOUBLE) AS efficiency FROM (SELECT max(bytes) AS most, sum(bytes) AS asked FROM ({_BYTES}) GROUP BY part // 64)")
def _(spark, d):
    per_part = table(spark, d, "events").groupBy(F.col("user_id").alias("part")).agg((F.count("*") * 16).alias("bytes"))
    return metrics.rank_xfer_cost(per_part)


@query("xfer_stats_rollup", "WITH log AS (SELECT event_type AS symbol, CAST(event_id % 6 AS INTEGER) AS epoch, 64 * (event_id % 17 + 1) AS total_bytes, 48 * (event_id % 17 + 1) AS effective_bytes FROM events), g AS (SELECT symbol, epoch, count(*) AS c, sum(total_bytes) AS t, sum(effective_bytes) AS e FROM log GROUP BY symbol, epoch UNION ALL SELECT symbol, -1, count(*), sum(total_bytes), sum(effective_bytes) FROM log GROUP BY symbol) SELECT symbol, epoch, CAST(c AS BIGINT) AS count, CAST(t AS BIGINT) AS total, CAST(e AS BIGINT) AS effective, CAST(t // c AS BIGINT) AS average, CAST(e * 100 AS DOUBLE) / CAST(t AS DOUBLE) AS efficiency FROM g")
def _(spark, d):
    e = F.col("event_id")
    log = table(spark, d, "events").select(F.col("event_type").alias("symbol"), (e % 6).cast("int").alias("epoch"), (64 * (e % 17 + 1)).alias("total_bytes"), (48 * (e % 17 + 1)).alias("effective_bytes"))
    return metrics.xfer_stats(log)


@query("distribution_report", f"WITH {_UMAP}, trees AS (SELECT part, seat, CAST(count(DISTINCT key) AS BIGINT) AS n FROM req GROUP BY part, seat), rows AS (SELECT part, CAST(sum(n) AS BIGINT) AS kv, max(n) AS largest FROM trees GROUP BY part), own AS (SELECT seq // 2000 AS batch_id, part, CAST(count(*) AS BIGINT) AS queries, any_value(kv) AS kv, any_value(largest) AS largest FROM req JOIN rows USING (part) GROUP BY seq // 2000, part) SELECT * FROM own UNION ALL SELECT batch_id, -1, max(queries), max(kv), max(largest) FROM own GROUP BY batch_id")
def _(spark, d):
    routed = batching.batch_slices(_requests(spark, d), batch=2000)
    rows = routed.groupBy("part", "seat").agg(F.count_distinct("key").alias("n_rows"))
    return metrics.distribution(routed.groupBy("batch_id", "part").agg(F.count("*").alias("n")), rows)


# Moves by the oracle of balance_plan, applied to the loads.
@query("skew_before_after", f"WITH {_SKEWED}, moves AS ({_BALANCE.replace('MIN_DIFF', '40')}), moved AS (SELECT coalesce(to_part, part) AS part, n FROM own LEFT JOIN moves ON from_part = part AND from_seat = seat), a AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM own GROUP BY part), z AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM moved GROUP BY part) SELECT 'before' AS step, max(n) / avg(n) AS skew FROM a UNION ALL SELECT 'after', max(n) / avg(n) FROM z")
def _(spark, d):
    loads, fmap = _skewed(spark, d)
    moved = maintenance.apply_migration(fmap, maintenance.balance_plan(loads, fmap, _MOVES, min_diff=40, parts=PARTS))
    out = None
    for step, m in (("before", fmap), ("after", moved)):
        own = m.select("frag_id", "part").join(loads.select("frag_id", "n"), "frag_id", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))
        row = metrics.skew(fragments.requests_per_part(own)).select(F.lit(step).alias("step"), "skew")
        out = row if out is None else out.unionByName(row)
    return out


@query("load_matrix", f"WITH {_ROUTED} SELECT p.part, {', '.join(f'CAST(coalesce(sum(n) FILTER (seat = {s}), 0) AS BIGINT) AS seat_{s}' for s in range(TREES))} FROM (SELECT CAST(i AS INTEGER) AS part FROM range({PARTS}) t(i)) p LEFT JOIN loads USING (part) GROUP BY p.part")
def _(spark, d):
    return metrics.load_matrix(_loads(spark, d), PARTS, TREES)


@query("tail_share", f"WITH {_ROUTED}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC, part) AS r, count(*) OVER () AS c FROM parts) SELECT sum(n) FILTER (r <= ceil(c * 0.3)) / sum(n) AS share FROM r")
def _(spark, d):
    return metrics.tail_share(fragments.requests_per_part(_loads(spark, d)), 0.3)


@query("windowed_requests", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def _(spark, d):
    """The streaming operator over the whole table as a batch: no row is late."""
    events = table(spark, d, "events")
    return runner.windowed(events, "ts", "user_id", "1 hour", "1 day").select(F.col("window.start").alias("start"), "user_id", "n")


def _scratch(spark: SparkSession) -> str:
    """A folder of our own under the one that driver and executors share; a local one only where they are one process."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ordix-")
    return f"{base.rstrip('/')}/ordix-{uuid.uuid4().hex}"


@query("src_binary_keys", f"SELECT {_KEYED} AS key FROM ({_zipf_sql(0.6, count=5000)})")
def _(spark, d):
    to = _scratch(spark).removeprefix("file://")
    workload.write_keys(workload.zipf_keys(spark, 5000, _ZN, 0.6), "key", to)
    return workload.read_keys(spark, f"file://{to}").select(F.col("key").cast("string").alias("key"))


@query("batch_report")
def _(spark, d):
    index, probes = _orders(spark, d, _SPARSE), _lines(spark, d)
    return metrics.batch_report(spark, [("get", lambda: index.get(probes, "l_orderkey").count()), ("succ", lambda: index.succ(probes, "l_orderkey").count())])


@query("driver_get", "SELECT event_id AS seq, user_id AS key, true AS found, user_id * 2 AS value FROM events WHERE event_id < 600")
def _(spark, d):
    """The batch driver over the first whole batches, against an index of all users."""
    events = table(spark, d, "events")
    users = events.select(F.col("user_id").alias("key")).distinct().withColumn("value", F.col("key") * 2)
    requests = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))
    fmap = fragments.equi_width(spark, PARTS, TREES, users.agg(F.max("key")).first()[0] or 0)
    out = []
    driver.run(OrderedIndex(users, "key", ["value"]), requests, fmap, driver.Options("get", batch=200, limit=500, parts=PARTS), lambda df, _: out.append(df))
    return reduce(DataFrame.unionByName, out)
