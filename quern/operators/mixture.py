"""Data mixtures: supply, tiers, floors, apportionment, schedules."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.hashing import seed63
from quern.functions.text import billions

# Shares in percent, inventories in billions of tokens, repetition caps and floors.
BUDGET_B = 3000.0
MAIN_MIX = {"general_web": 40, "code": 18, "math_stem": 14, "reasoning": 6, "agentic": 4, "indic": 13, "long_context": 5}
INVENTORY = {"general_web": [1300, 2000, 1500], "code": [900, 60], "math_stem": [55, 15, 12, 60], "reasoning": [1.0, 3.0, 2.0], "agentic": [0.08, 1.5, 6.0], "indic": [64, 20, 60, 120, 130], "long_context": [40, 30]}
REPEAT_CAPS = {"general_web": 1.0, "code": 2.0, "math_stem": 3.0, "reasoning": 4.0, "agentic": 4.0, "indic": 3.0, "long_context": 2.0}
TIERS = [("verified_native", 84.0, 2.0), ("unverified", 60.0, 1.0), ("translated", 120.0, 1.0), ("synthetic", 130.0, 3.0)]
FLOORS = {"indic": 8, "agentic": 3, "reasoning": 3}
LANES = ["general_web", "code", "math", "reasoning", "agentic", "indic"]
STAGES = [
    ("seed", 10, 128, [0.55, 0.12, 0.10, 0.06, 0.05, 0.12], {"indic": 0.10, "agentic": 0.05, "reasoning": 0.05}),
    ("mid", 15, 128, [0.38, 0.20, 0.15, 0.10, 0.05, 0.12], {"indic": 0.10, "agentic": 0.05, "reasoning": 0.05}),
    ("anneal", 15, 128, [0.20, 0.20, 0.15, 0.15, 0.12, 0.18], {"indic": 0.12, "agentic": 0.08, "reasoning": 0.08}),
]

#: Ranges that are counted at once.
CELLS = 1024


def supply(lanes: DataFrame, inventory: DataFrame, budget: float = BUDGET_B) -> DataFrame:
    """lanes (lane, share, cap) and inventory (lane, tokens) to target, unique, repetition and a verdict."""
    have = inventory.groupBy("lane").agg(F.sum("tokens").alias("unique_b"))
    out = lanes.join(have, "lane", "left").withColumn("unique_b", F.coalesce("unique_b", F.lit(0.0))).withColumn("target_b", F.lit(budget) * F.col("share") / 100)
    rep = F.when(F.col("unique_b") > 0, F.col("target_b") / F.col("unique_b")).otherwise(float("inf"))
    out = out.withColumn("rep", rep)
    gap = F.col("target_b") - F.col("unique_b") * F.col("cap")
    times = lambda c: F.concat(F.lit("repeat x"), c)
    cap = F.regexp_replace(F.col("cap").cast("string"), r"\.0$", "")
    verdict = (
        F.when(F.col("rep") <= 1, "unique-covered")
        .when(F.col("rep") <= F.col("cap"), F.concat(times(F.format_number(F.bround("rep", 1), 1)), F.lit(" (<= x"), cap, F.lit(" ok)")))
        .otherwise(F.concat(times(cap), F.lit(" then SYNTHESISE "), billions(gap), F.lit(" ("), F.bround(gap / F.col("target_b") * 100, 0).cast("int").cast("string"), F.lit("% of lane)")))
    )
    return out.select("lane", "share", "target_b", F.bround("unique_b", 1).alias("unique_b"), F.bround("rep", 2).alias("rep"), verdict.alias("verdict"))


def tier_fill(tiers: DataFrame, target: float) -> DataFrame:
    """tiers (ord, tier, tokens, cap): each takes what is left of the target, up to its capped supply, in order."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    avail = tiers.withColumn("avail", F.col("tokens") * F.col("cap"))
    before = F.coalesce(F.sum("avail").over(w), F.lit(0.0))
    return avail.select("ord", "tier", "avail", F.greatest(F.lit(0.0), F.least(F.col("avail"), F.lit(target) - before)).alias("take"))


def first_rows(rows: DataFrame, k: int, order: list[tuple[str, bool]], small: int = 10_000) -> DataFrame:
    """The first k rows by numeric columns without nulls, (name, descending). Counts in CELLS ranges narrow down where the
    k-th row lies until few rows are left there; all before them are kept by a filter, and only those few are sorted."""
    inside, before, left = F.lit(True), F.lit(False), k
    for name, down in order:
        x = (-F.col(name) if down else F.col(name)).cast("double")
        while True:
            held = rows.where(inside)
            s = held.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n")).first()
            if s["n"] <= small or s["n"] <= left or s["lo"] == s["hi"]:
                break
            cell = F.least(F.lit(CELLS - 1), F.floor((x - s["lo"]) / (s["hi"] - s["lo"]) * CELLS))
            reach = 0
            for c, n in sorted(map(tuple, held.groupBy(cell.alias("cell")).count().collect())):
                if reach + n > left:
                    break
                reach += n
            before, inside, left = before | (inside & (cell < c)), inside & (cell == c), left - reach
        if s["n"] <= small or s["n"] <= left:
            break
    rest = rows.where(inside).orderBy(*(F.desc(n) if down else F.asc(n) for n, down in order)).limit(left)
    return rows.where(before).unionByName(rest)


def top_share(scored: DataFrame, keep: float, by: str = "score", tie: str = "id") -> DataFrame:
    """The best share of rows; ties keep the order of `tie`."""
    return first_rows(scored, int(scored.count() * keep), [(by, True), (tie, False)])


def mix(kept: DataFrame) -> DataFrame:
    """Percent of rows by lane."""
    n = kept.groupBy("lane").agg(F.count("*").alias("n"))
    return n.select("lane", (100 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


def floor_select(scored: DataFrame, keep: float, floors: dict[str, int]) -> DataFrame:
    """lane, pct with reserved slots for floors; the rest goes from the top without leaving out the protected lanes."""
    k = int(scored.count() * keep)
    spark = scored.sparkSession
    reserved = {lane: int(k * pct / 100) for lane, pct in floors.items()}
    rest = max(k - sum(reserved.values()), 0)
    top = first_rows(scored, rest, [("score", True), ("id", False)]).groupBy("lane").agg(F.count("*").alias("n"))
    held = spark.createDataFrame(list(reserved.items()), "lane string, r long")
    out = top.join(held, "lane", "full")
    return out.select("lane", ((F.coalesce("n", F.lit(0)) + F.coalesce("r", F.lit(0))) / k * 100).alias("pct"))


def largest_remainder(weights: DataFrame, total: int, by: list[str]) -> DataFrame:
    """weights (*by, lane, weight): whole numbers that add up to the total, larger fractions first, ties by lane."""
    raw = weights.withColumn("raw", F.col("weight") * total).withColumn("base", F.floor("raw").cast("long"))
    everything = Window.partitionBy(*by)
    rank = F.row_number().over(everything.orderBy(F.desc(F.col("raw") - F.col("base")), "lane"))
    return raw.withColumn("left", F.lit(total) - F.sum("base").over(everything)).withColumn("alloc", F.col("base") + (rank <= F.col("left")).cast("long")).select(*by, "lane", "weight", "alloc")


def stage_table(spark: SparkSession) -> DataFrame:
    """stage_ord, stage, lo, hi, seq_len, lane, weight, floor."""
    rows, at = [], 0
    for i, (name, steps, seq_len, weights, floors) in enumerate(STAGES):
        rows += [(i, name, at, at + steps, seq_len, lane, w, floors.get(lane)) for lane, w in zip(LANES, weights)]
        at += steps
    return spark.createDataFrame(rows, "stage_ord int, stage string, lo long, hi long, seq_len int, lane string, weight double, floor double")


def stage_at(steps: DataFrame, stages: DataFrame) -> DataFrame:
    """Each step's stage; steps past the end belong to the last. A few stages, so the range join is a broadcast of them."""
    bounds = stages.select("stage_ord", "stage", "lo", "hi").distinct()
    last = bounds.agg(F.max(F.struct("hi", "stage")).alias("m")).select(F.col("m.hi").alias("end"), F.col("m.stage").alias("last_stage"))
    out = steps.join(F.broadcast(bounds), (F.col("step") >= F.col("lo")) & (F.col("step") < F.col("hi")), "left").join(F.broadcast(last))
    return out.select("step", F.coalesce("stage", "last_stage").alias("stage"))


def lane_alloc(spark: SparkSession, steps: DataFrame, batch: int, seed: int) -> DataFrame:
    """step, lane, alloc: largest remainders raised to floors; the deficit is taken one by one from the largest lane above
    its floor, ties by a seeded hash. Six lanes a step fold inside one row, steps stay parallel."""
    stages = stage_table(spark)
    base = largest_remainder(stages, batch, ["stage"]).join(stages.select("stage", "lane", "floor"), ["stage", "lane"])
    base = base.withColumn("least", F.coalesce(F.ceil(F.col("floor") * batch), F.lit(0)).cast("long"))
    raised = base.withColumn("up", F.greatest("alloc", "least")).groupBy("stage").agg(
        F.array_sort(F.collect_list(F.struct("lane", "up", "least"))).alias("lanes"), F.sum(F.col("up") - F.col("alloc")).alias("deficit")
    )
    rows = stage_at(steps, stages).join(F.broadcast(raised), "stage")
    hashed = F.transform("lanes", lambda x: F.struct(x.lane.alias("lane"), x.up.alias("n"), x.least.alias("least"), seed63(F.concat_ws(":", F.lit(str(seed)), F.col("step").cast("string"), x.lane)).alias("h")))
    rows = rows.withColumn("lanes", hashed)
    fold = """
        aggregate(sequence(1, greatest(cast(deficit as int), 1)), lanes, (ls, i) ->
          if(i > deficit, ls, transform(ls, x -> if(
            x.lane = element_at(array_sort(filter(ls, y -> y.n > y.least), (p, q) -> case when p.n <> q.n then sign(q.n - p.n) else sign(q.h - p.h) end), 1).lane,
            named_struct('lane', x.lane, 'n', x.n - 1L, 'least', x.least, 'h', x.h), x))))"""
    fold = fold.replace("sign(q.n - p.n)", "cast(sign(q.n - p.n) as int)").replace("sign(q.h - p.h)", "if(q.h > p.h, 1, -1)").replace("element_at(", "try_element_at(")
    return rows.select("step", "stage", F.explode(F.expr(fold)).alias("x")).select("step", "stage", "x.lane", F.col("x.n").alias("alloc"))


def planned_shares(alloc: DataFrame, batch: int) -> DataFrame:
    n = alloc.select("step").distinct().agg((F.count("*") * batch).alias("total"))
    return alloc.groupBy("lane").agg(F.sum("alloc").alias("n")).join(F.broadcast(n)).select("lane", (F.col("n") / F.col("total")).alias("share"))


def feasibility(shares: DataFrame, available: DataFrame, sequences: int, seq_len: int = 128, max_repeat: float = 4.0) -> DataFrame:
    demand = F.floor(F.col("share") * sequences * seq_len).cast("long")
    out = shares.join(available, "lane", "left").select("lane", demand.alias("demand"), F.coalesce("tokens", F.lit(0)).cast("long").alias("available"))
    rep = F.coalesce(F.try_divide("demand", "available"), F.lit(float("inf")))
    return out.select("lane", "demand", "available", F.bround(rep, 2).alias("repeat"), (rep <= max_repeat).alias("feasible"))


def compliance(consumed: DataFrame, alloc: DataFrame, batch: int, tolerance: float = 0.03) -> DataFrame:
    """lane: actual share, planned share, within tolerance, floors met at every step."""
    floors = {lane: min(math.ceil(s[4].get(lane, 0) * batch) for s in STAGES) for lane in LANES}
    least = F.coalesce(*(F.when(F.col("lane") == lane, F.lit(n)) for lane, n in floors.items()), F.lit(0))
    joined = alloc.join(consumed.withColumnRenamed("alloc", "got"), ["step", "lane"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    sums = joined.groupBy("lane").agg(F.sum("got").alias("got"), F.sum("alloc").alias("want"), F.every(F.col("got") >= least).alias("floors_met"))
    total = sums.agg(F.sum("got").alias("all_got"), F.sum("want").alias("all_want"))
    a, p = F.col("got") / F.col("all_got"), F.col("want") / F.col("all_want")
    return sums.join(F.broadcast(total)).select("lane", a.alias("actual"), p.alias("planned"), (F.abs(a - p) <= tolerance).alias("within"), "floors_met")
