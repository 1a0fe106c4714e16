"""Maintenance plans over the fragment map: split, merge, balance and migrate.

The inputs are metadata, a row per fragment or part. Plans that have a set form
are DataFrames; merging into full parts and balancing are greedy on the driver.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the planners.
SPLIT_OVER, SPLIT_TARGET, MERGE_UNDER, SOFT_LIMIT, SEATS, MIN_DIFF = 40_000, 20_000, 1_500, 14, 20, 400


def split_plan(stats: DataFrame, over: int = SPLIT_OVER, target: int = SPLIT_TARGET) -> DataFrame:
    """frag_id, n_rows, pieces of every fragment of more than `over` rows; pieces of about `target`."""
    return stats.where(F.col("n_rows") > over).select("frag_id", "n_rows", F.ceil(F.col("n_rows") / target).cast("long").alias("pieces"))


def split_bounds(rows: DataFrame, plan: DataFrame, key: str = "key") -> DataFrame:
    """Rows and upper bound of each piece: piece i has positions [n*i/m, n*(i+1)/m) of its fragment.

    rows: frag_id and key. ub is the piece's largest key; apply_split() keeps the
    fragment's own bound for the last piece.
    """
    at = F.row_number().over(Window.partitionBy("frag_id").orderBy(key)) - 1
    numbered = rows.join(F.broadcast(plan), "frag_id").withColumn("r", at)
    piece = F.floor(((F.col("r") + 1) * F.col("pieces") - 1) / F.col("n_rows")).cast("long")
    return numbered.withColumn("piece", piece).groupBy("frag_id", "piece").agg(F.count("*").alias("n"), F.max(key).alias("ub"))


def apply_split(fmap: DataFrame, pieces: DataFrame) -> DataFrame:
    """The map with split fragments replaced by their pieces, on the same part in its lowest free seats."""
    w = Window.partitionBy("frag_id").orderBy("piece")
    last = F.col("piece") == F.max("piece").over(Window.partitionBy("frag_id"))
    own = pieces.select("frag_id", "piece", F.col("ub").alias("pub")).join(fmap, "frag_id")
    cut = own.withColumn("nub", F.when(last, F.col("ub")).otherwise(F.col("pub"))).withColumn("nlb", F.coalesce(F.lag("nub").over(w) + 1, F.col("lb")))
    whole = fmap.join(pieces.select("frag_id").distinct(), "frag_id", "left_anti").withColumn("piece", F.lit(0).cast("long"))
    held = whole.select("part", "seat").unionByName(cut.where("piece = 0").select("part", "seat"))
    used = held.groupBy("part").agg(F.collect_set("seat").alias("used"))
    order = F.row_number().over(Window.partitionBy("part").orderBy("frag_id", "piece"))
    extra = cut.where("piece > 0").withColumn("r", order).join(used, "part")
    free = F.filter(F.sequence(F.lit(0), F.lit(4 * SEATS)), lambda s: ~F.array_contains("used", s))
    seated = extra.withColumn("seat", F.element_at(free, F.col("r")))
    cols = ["frag_id", "piece", F.col("nlb").alias("lb"), F.col("nub").alias("ub"), "part", "seat"]
    return whole.select("frag_id", "piece", "lb", "ub", "part", "seat").unionByName(cut.where("piece = 0").select(*cols)).unionByName(seated.select(*cols))


def merge_candidates(stats: DataFrame, under: int = MERGE_UNDER) -> DataFrame:
    """Each fragment with its right neighbour in key order, the pair's rows, and whether they may merge."""
    w = Window.orderBy("ub")
    pair = stats.select("frag_id", "part", "seat", "ub", "n_rows", F.lead("frag_id").over(w).alias("right_id"), F.lead("n_rows").over(w).alias("right_rows"), F.row_number().over(w).cast("long").alias("pos"))
    return pair.withColumn("pair_rows", F.col("n_rows") + F.col("right_rows")).withColumn("mergeable", F.coalesce(F.col("pair_rows") < under, F.lit(False)))


def merge_plan(stats: DataFrame, under: int = MERGE_UNDER, seats: int = SEATS) -> DataFrame:
    """src_id, dst_id, pair_rows: left into right, from the lowest key on; both are then passed over.

    A left fragment of another part needs a free seat there, which it takes and
    its own part gets back; without one the pair stays apart. So what a pair may
    do depends on all before it, and the plan is made on the driver over the
    pairs that are small enough, metadata of a row per fragment at most.
    """
    rows = merge_candidates(stats, under).join(stats.select(F.col("frag_id").alias("right_id"), F.col("part").alias("right_part")), "right_id", "left").where("mergeable").orderBy("pos").collect()
    used = {r.part: r.n for r in stats.groupBy("part").agg(F.count("*").alias("n")).collect()}
    plan, next_ = [], 0
    for r in rows:
        moves = r.part != r.right_part
        if r.pos < next_ or (moves and used[r.right_part] >= seats):
            continue
        if moves:
            used[r.right_part] += 1
            used[r.part] -= 1
        plan.append((r.frag_id, r.right_id, r.pair_rows))
        next_ = r.pos + 2
    return stats.sparkSession.createDataFrame(plan, "src_id int, dst_id int, pair_rows long")


def merge_apply(fmap: DataFrame, plan: DataFrame) -> DataFrame:
    """The map after a merge plan: a left fragment goes and its right one reaches down to its lower bound."""
    gone = fmap.join(plan, fmap["frag_id"] == plan["src_id"]).select("dst_id", F.col("lb").alias("down"))
    left = fmap.join(plan.select(F.col("src_id").alias("frag_id")), "frag_id", "left_anti")
    return left.join(gone, left["frag_id"] == gone["dst_id"], "left").withColumn("lb", F.coalesce("down", "lb")).drop("dst_id", "down")


def memory_plan(fmap: DataFrame, parts: int, soft: int = SOFT_LIMIT, seats: int = SEATS) -> DataFrame:
    """Moves that bring every part to at most `soft` fragments: its lowest seats go to the lowest free seats of the first parts with room."""
    spark = fmap.sparkSession
    used = fmap.groupBy("part").agg(F.count("*").alias("n"), F.collect_set("seat").alias("used"))
    every = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(used, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("used", F.array().cast("array<int>")).alias("used"))
    over = F.greatest(F.col("n") - soft, F.lit(0)).cast("int")
    going = every.select("part", F.explode(F.slice(F.array_sort("used"), F.lit(1), over)).alias("seat"))
    free = F.filter(F.sequence(F.lit(0), F.lit(seats - 1)), lambda s: ~F.array_contains("used", s))
    coming = every.select("part", F.explode(F.slice(free, F.lit(1), F.greatest(F.lit(soft) - F.col("n"), F.lit(0)).cast("int"))).alias("seat"))
    w = Window.orderBy("part", "seat")
    a = going.select(F.col("part").alias("from_part"), F.col("seat").alias("from_seat"), F.row_number().over(w).alias("r"))
    b = coming.select(F.col("part").alias("to_part"), F.col("seat").alias("to_seat"), F.row_number().over(w).alias("r"))
    return a.join(b, "r").drop("r")


def balance_plan(loads: DataFrame, fmap: DataFrame, moves: int, min_diff: int = MIN_DIFF, soft: int = SOFT_LIMIT, seats: int = SEATS, extra: bool = False, parts: int | None = None, freeing: DataFrame | None = None) -> DataFrame:
    """Moves from the hottest parts to the coldest, at most `moves`; each part is used once.

    loads: frag_id, n; fmap: frag_id, part, seat. The fragment that goes is the
    one whose double load is nearest to the difference, below it; ties go to the
    lowest seat, and parts of equal load are in order of part. A hot part without
    such a fragment gives nothing. parts: parts 0 .. parts - 1 take part, empty
    ones too; without it those that hold a fragment. freeing: part and seat of
    seats that a plan before has left and that can't be taken yet. extra: parts
    that can't give are passed over instead of ending the plan, and no least
    difference holds. Made on the driver, from a row per fragment.
    """
    spark = fmap.sparkSession
    rows = fmap.join(loads.select("frag_id", "n"), "frag_id", "left").select("part", "seat", F.coalesce("n", F.lit(0)).alias("n")).collect()
    own: dict[int, dict[int, int]] = {p: {} for p in range(parts or 0)}
    for r in rows:
        own.setdefault(r.part, {})[r.seat] = r.n
    left: dict[int, set[int]] = {p: set() for p in own}
    for r in freeing.collect() if freeing is not None else ():
        left.setdefault(r.part, set()).add(r.seat)
    total = {p: sum(held.values()) for p, held in own.items()}
    rank = {p: i for i, p in enumerate(sorted(total, key=lambda p: (-total[p], p)))}
    # Whether a part can give or take doesn't change, as each is used once.
    givers = list(filter(lambda p: len(own[p]) > 1, rank)) if extra else list(itertools.takewhile(lambda p: len(own[p]) > 1, rank))
    takers = [p for p in reversed(rank) if len(own[p]) < soft and len(own[p]) + len(left[p]) < seats]
    plan: list[tuple[int, int, int, int]] = []
    for giver in givers:
        if len(plan) == min(moves, len(takers)) or rank[giver] >= rank[taker := takers[len(plan)]]:
            break
        diff = total[giver] - total[taker]
        if diff < min_diff and not extra:
            break
        fit = min(((abs(2 * n - diff), seat) for seat, n in own[giver].items() if n < diff), default=None)
        if fit:
            plan.append((giver, fit[1], taker, min(set(range(seats)) - own[taker].keys() - left[taker])))
    return spark.createDataFrame(plan, "from_part int, from_seat int, to_part int, to_seat int")


def balance_plan_sql(loads: DataFrame, fmap: DataFrame, moves: int, min_diff: int = MIN_DIFF, seats: int = SEATS) -> DataFrame:
    """balance_plan() as joins, for the case in which no part is skipped: every hot part has a fragment that fits and no cold one is full."""
    own = fmap.join(loads.select("frag_id", "n"), "frag_id", "left").select("part", "seat", F.coalesce("n", F.lit(0)).alias("n"))
    per = own.groupBy("part").agg(F.sum("n").alias("total"), F.count("*").alias("used"), F.collect_set("seat").alias("held"))
    hot = per.select(F.col("part").alias("from_part"), F.col("total").alias("hot"), "used", F.row_number().over(Window.orderBy(F.desc("total"), "part")).alias("r"))
    cold = per.select(F.col("part").alias("to_part"), F.col("total").alias("cold"), "held", F.row_number().over(Window.orderBy("total", F.desc("part"))).alias("r"))
    n = F.count("*").over(Window.partitionBy())
    pairs = hot.join(cold, "r").withColumn("parts", n).where("2 * r <= parts").withColumn("diff", F.col("hot") - F.col("cold"))
    going_on = F.min(((F.col("used") > 1) & (F.col("diff") >= min_diff)).cast("int")).over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    kept = pairs.withColumn("ok", going_on).where((F.col("ok") == 1) & (F.col("r") <= moves))
    fits = kept.join(own.withColumnRenamed("part", "from_part"), "from_part").where("n < diff")
    best = fits.groupBy("from_part", "to_part", "held").agg(F.min_by("seat", F.struct(F.abs(2 * F.col("n") - F.col("diff")), F.col("seat"))).alias("from_seat"))
    free = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(seats - 1)), lambda s: ~F.array_contains("held", s)))
    return best.select("from_part", "from_seat", "to_part", free.cast("int").alias("to_seat"))


def resolve(moves: DataFrame) -> DataFrame:
    """Moves made one after another (step, from, to) as moves from the first origin to the last place.

    Plans hold a few moves a batch; the chains are followed by a recursive query.
    """
    view = "__moves"
    moves.createOrReplaceTempView(view)
    return moves.sparkSession.sql(f"""
        WITH RECURSIVE chain(o_part, o_seat, part, seat, step) AS (
          SELECT m.from_part, m.from_seat, m.to_part, m.to_seat, m.step FROM {view} m
          WHERE NOT EXISTS (SELECT 1 FROM {view} p WHERE p.to_part = m.from_part AND p.to_seat = m.from_seat AND p.step < m.step)
          UNION ALL
          SELECT c.o_part, c.o_seat, m.to_part, m.to_seat, m.step
          FROM chain c JOIN {view} m ON m.from_part = c.part AND m.from_seat = c.seat AND m.step > c.step)
        SELECT o_part AS from_part, o_seat AS from_seat, max_by(part, step) AS to_part, max_by(seat, step) AS to_seat FROM chain GROUP BY o_part, o_seat""")


def apply_migration(fmap: DataFrame, moves: DataFrame) -> DataFrame:
    """The map after the moves: only part and seat change, keys and rows stay where the bounds say."""
    to = moves.select(F.col("from_part").alias("part"), F.col("from_seat").alias("seat"), "to_part", "to_seat")
    return fmap.join(F.broadcast(to), ["part", "seat"], "left").select("frag_id", "lb", "ub", F.coalesce("to_part", "part").alias("part"), F.coalesce("to_seat", "seat").alias("seat"))


def rebalance(spark: SparkSession, fmap: DataFrame, loads: DataFrame, parts: int, moves: int) -> DataFrame:
    """Memory balance, then query balance, applied to the map; seats that the first leaves aren't taken by the second."""
    plan = memory_plan(fmap, parts)
    left = plan.select(F.col("from_part").alias("part"), F.col("from_seat").alias("seat"))
    fmap = apply_migration(fmap, plan)
    return apply_migration(fmap, balance_plan(loads, fmap, moves, parts=parts, freeing=left))
