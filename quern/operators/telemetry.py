"""Training-series analytics: detectors, event scoring, smoothing and downsampling, each per series.

A series is (series, step, value). Built-in windows carry all but the recursions, which fold in one Arrow group per
series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def series(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.select(F.col(key).alias("series"), (F.row_number().over(order) - 1).cast("long").alias("step"), F.col(value).alias("value"))


def _before(n: int | None):
    return Window.partitionBy("series").orderBy("step").rowsBetween(-n if n else Window.unboundedPreceding, -1)


def alarm_sigma(s: DataFrame, window: int = 1000, sigma: float = 7.0) -> DataFrame:
    """Values over the trailing mean by sigma population deviations, once the window is full; the value itself is outside it."""
    w = _before(window)
    scored = s.select("*", F.avg("value").over(w).alias("m"), F.var_pop("value").over(w).alias("v"), F.count("value").over(w).alias("n"))
    return scored.where((F.col("n") == window) & (F.col("value") - F.col("m") > sigma * F.sqrt(F.greatest(F.col("v"), F.lit(1e-12))))).select("series", "step", "value")


def alarm_sigma_prefix(s: DataFrame, window: int = 1000, sigma: float = 7.0) -> DataFrame:
    """The same from running sums minus lagged ones: linear in rows whatever the window."""
    run = Window.partitionBy("series").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("series").orderBy("step")
    sums = s.select("*", F.coalesce(F.sum("value").over(run), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(F.col("value") * F.col("value")).over(run), F.lit(0.0)).alias("s2"))
    d = sums.select("series", "step", "value", (F.col("s1") - F.lag("s1", window).over(order)).alias("a"), (F.col("s2") - F.lag("s2", window).over(order)).alias("b"))
    mean = F.col("a") / window
    var = F.greatest(F.col("b") / window - mean * mean, F.lit(1e-12))
    return d.where(F.col("a").isNotNull() & (F.col("value") - mean > sigma * F.sqrt(var))).select("series", "step", "value")


def alarm_ratio(s: DataFrame, factor: float = 10.0) -> DataFrame:
    w = _before(None)
    return s.withColumn("m", F.max("value").over(w)).where((F.col("m") > 0) & (F.col("value") > factor * F.col("m"))).select("series", "step", "value")


def alarm_fixed(s: DataFrame, bound: float = 5.0) -> DataFrame:
    return s.where(F.col("value") > bound)


def alarm_not_finite(s: DataFrame) -> DataFrame:
    return s.where(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))


def _fold(s: DataFrame, f, schema: str) -> DataFrame:
    return s.groupBy("series").applyInPandas(lambda g: f(g.sort_values("step", kind="stable")), schema)


def alarm_ema(s: DataFrame, alpha: float = 0.97, z: float = 2.5, warmup: int = 100) -> DataFrame:
    """z over moving mean and variance; an alarm leaves both unchanged, and the variance uses the old mean."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found, mean, var = [], None, 0.0
        for i, x in enumerate(g["value"].tolist()):
            if mean is None:
                mean = x
                continue
            gap = x - mean
            if i >= warmup and gap > z * math.sqrt(max(var, 1e-12)):
                found.append(i)
                continue
            mean, var = alpha * mean + (1 - alpha) * x, alpha * var + (1 - alpha) * gap * gap
        return g.iloc[found][["series", "step", "value"]]

    return _fold(s, run, "series string, step long, value double")


def ema(s: DataFrame, alpha: float = 0.9) -> DataFrame:
    """Exponential smoothing, seeded with the first value."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out, at = [], None
        for x in g["value"].tolist():
            at = x if at is None else alpha * at + (1 - alpha) * x
            out.append(at)
        return g[["series", "step"]].assign(value=out)

    return _fold(s, run, "series string, step long, value double")


def _upper_median(values: Column) -> Column:
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(values) / 2).cast("int"))


def robust_z(s: DataFrame, window: int = 20, least: int = 8) -> DataFrame:
    """Distance from the trailing upper median in scaled median deviations; null before `least` values."""
    got = s.withColumn("xs", F.collect_list("value").over(_before(window)))
    got = got.withColumn("med", _upper_median(F.col("xs")))
    got = got.withColumn("mad", _upper_median(F.transform("xs", lambda x: F.abs(x - F.col("med")))))
    mad = F.when(F.col("mad") == 0, 1e-12).otherwise(F.col("mad"))
    return got.select("series", "step", "value", F.when(F.size("xs") >= least, (F.col("value") - F.col("med")) / (1.4826 * mad)).alias("z"))


def smooth(s: DataFrame, width: int = 9) -> DataFrame:
    """Centred upper median; the frame shrinks at both ends."""
    half = width // 2
    w = Window.partitionBy("series").orderBy("step").rowsBetween(-half, half)
    return s.select("series", "step", _upper_median(F.collect_list("value").over(w)).alias("value"))


def score_alarms(alarms: DataFrame, planted: DataFrame, tolerance: int = 4) -> DataFrame:
    """series, found, missed, false alarms. Steps fall in buckets of the tolerance, so the interval join is an equi-join of
    three neighbouring buckets instead of a product."""
    width = tolerance + 1
    a = alarms.select("series", F.col("step").alias("a")).withColumn("bucket", F.explode(F.array(*(F.floor(F.col("a") / width) + d for d in (-1, 0, 1)))))
    p = planted.select("series", F.col("step").alias("p")).withColumn("bucket", F.floor(F.col("p") / width))
    near = a.join(p, ["series", "bucket"]).where(F.abs(F.col("a") - F.col("p")) <= tolerance)
    hit = near.select("series", "p").distinct().groupBy("series").agg(F.count("*").alias("found"))
    good = near.select("series", "a").distinct().groupBy("series").agg(F.count("*").alias("good"))
    total = planted.groupBy("series").agg(F.count("*").alias("planted"))
    raised = alarms.groupBy("series").agg(F.count("*").alias("alarms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = total.join(raised, "series", "full").join(hit, "series", "left").join(good, "series", "left")
    return out.select("series", zero("found").alias("found"), (zero("planted") - zero("found")).alias("missed"), (zero("alarms") - zero("good")).alias("false_alarms"))


def lead_events(s: DataFrame, lead: str = "lead", follow: str = "follow", horizon: int = 10, z: float = 3.0) -> DataFrame:
    """For steps where `lead` passes z, the first step within the horizon where `follow` does."""
    w = Window.partitionBy("series").orderBy("step").rowsBetween(1, horizon)
    first = F.min(F.when(F.col(follow) >= z, F.col("step"))).over(w)
    return s.withColumn("next", first).where(F.col(lead) >= z).select("series", "step", "next", (F.col("next") - F.col("step")).alias("lag"))


def base_rate(s: DataFrame, follow: str = "follow", horizon: int = 10, z: float = 3.0) -> DataFrame:
    """How often any window of the horizon holds a follow event."""
    w = Window.partitionBy("series").orderBy("step").rowsBetween(1, horizon)
    return s.withColumn("any", F.max((F.col(follow) >= z).cast("int")).over(w)).where("any is not null").groupBy("series").agg(F.avg("any").alias("rate"))


def settle_step(s: DataFrame, bound: float) -> DataFrame:
    """First step from which the value stays under the bound; null if it never does."""
    last = s.groupBy("series").agg(F.max("step").alias("last"), F.max(F.when(~(F.col("value") < bound), F.col("step"))).alias("bad"), F.min("step").alias("first"))
    return last.select("series", F.when(F.col("bad").isNull(), F.col("first")).when(F.col("bad") < F.col("last"), F.col("bad") + 1).alias("settled"))


def first_after_peak(s: DataFrame, bound: float) -> DataFrame:
    """First step after the largest value (its first place) with a value at most the bound."""
    peak = s.groupBy("series").agg(F.min_by("step", F.struct(-F.col("value"), "step")).alias("peak"))
    return s.join(peak, "series").groupBy("series", "peak").agg(F.min(F.when((F.col("step") > F.col("peak")) & (F.col("value") <= bound), F.col("step"))).alias("after"))


# -- downsampling ----------------------------------------------------------------------------------------------------


def columns(s: DataFrame, width: int) -> DataFrame:
    """The pixel column of each step, as the rasteriser places it: half-even rounding."""
    n = F.max("step").over(Window.partitionBy("series")) + 1
    spot = F.bround(F.col("step") / F.greatest(n - 1, F.lit(1)) * (width - 1))
    return s.withColumn("column", spot.cast("long"))


def sample_mean(s: DataFrame, width: int) -> DataFrame:
    return columns(s, width).groupBy("series", "column").agg(((F.min("step") + F.max("step")) / 2).alias("x"), F.avg("value").alias("value"))


def _extremes(c: DataFrame):
    low = F.min(F.struct("value", "step"))["step"]
    high = F.max(F.struct(F.col("value"), -F.col("step")))
    return c.groupBy("series", "column").agg(F.min("step").alias("first"), F.max("step").alias("last"), low.alias("low"), (-high["col2"]).alias("high"))


def sample_minmax(s: DataFrame, width: int) -> DataFrame:
    """Steps of the smallest and largest value of every column, first place on ties."""
    return _extremes(columns(s, width)).select("series", "column", F.explode(F.array_distinct(F.array("low", "high"))).alias("step")).join(s, ["series", "step"])


def sample_m4(s: DataFrame, width: int) -> DataFrame:
    """First, last, smallest and largest of every column."""
    return _extremes(columns(s, width)).select("series", "column", F.explode(F.array_distinct(F.array("first", "low", "high", "last"))).alias("step")).join(s, ["series", "step"])


def sample_lttb(s: DataFrame, width: int) -> DataFrame:
    """Largest triangle with the last pick and the next bucket's mean, bucket by bucket."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = g["value"].to_numpy()
        n = len(y)
        if n <= width or width < 3:
            return g[["series", "step", "value"]]
        edges = np.linspace(1, n - 1, width - 1).astype(int)
        picks = [0]
        for k in range(width - 2):
            lo, hi = edges[k], max(edges[k + 1], edges[k] + 1)
            nxt = np.arange(hi, edges[k + 2] if k + 2 < len(edges) else n)
            cx, cy = (nxt.mean(), y[nxt].mean()) if len(nxt) else (n - 1, y[-1])
            px, py, i = picks[-1], y[picks[-1]], np.arange(lo, hi)
            picks.append(int(i[np.argmax(np.abs((px - cx) * (y[i] - py) - (px - i) * (cy - py)))]))
        return g.iloc[[*picks, n - 1]][["series", "step", "value"]]

    return _fold(s, run, "series string, step long, value double")


def raster(points: DataFrame, n: int, width: int, height: int, low: float, high: float) -> DataFrame:
    """Distinct (series, x, y) pixels of the polyline through points."""
    x = F.bround(F.col("step") / max(n - 1, 1) * (width - 1)).cast("long")
    y = F.bround((F.least(F.greatest(F.col("value"), F.lit(low)), F.lit(high)) - low) / (high - low) * (height - 1)).cast("long")
    order = Window.partitionBy("series").orderBy("step")
    seg = points.select("series", "step", x.alias("x0"), y.alias("y0")).select("*", F.lead("x0").over(order).alias("x1"), F.lead("y0").over(order).alias("y1")).where("x1 is not null")
    at = seg.select("*", F.explode(F.sequence("x0", "x1")).alias("x"))
    rise = (F.col("y1") - F.col("y0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1))
    a = F.when(F.col("x1") == F.col("x0"), F.col("y0").cast("double")).otherwise(F.col("y0") + rise * (F.col("x") - F.col("x0")))
    b = F.when(F.col("x1") == F.col("x0"), F.col("y1").cast("double")).otherwise(F.least(F.greatest(a + rise, F.least("y0", "y1")), F.greatest("y0", "y1")))
    cells = F.sequence(F.bround(F.least(a, b)).cast("long"), F.bround(F.greatest(a, b)).cast("long"))
    return at.select("series", "x", F.explode(cells).alias("y")).distinct()


def wrong_pixels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in one raster only."""
    return a.exceptAll(b).unionAll(b.exceptAll(a)).groupBy("series").agg(F.count("*").alias("wrong"))


def trace(spark: SparkSession, steps: int = 300_000, spikes: int = 40, seed: int = 15) -> tuple[DataFrame, DataFrame]:
    """A synthetic gradient-norm series with decaying spikes, and where they stand. Noise hashes the step, so every run
    and every partitioning gives the same rows."""
    gap = steps // (spikes + 1)
    unit = lambda k: F.pmod(F.xxhash64("step", F.lit(seed * 10 + k)), F.lit(1 << 30)) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(unit(1) + 1e-12)) * F.cos(2 * math.pi * unit(2))
    since = F.pmod(F.col("step"), F.lit(gap))
    spike = F.when((F.col("step") >= gap) & (F.col("step") < gap * (spikes + 1)), (4 + 4 * (F.floor(F.col("step") / gap) % 5) / 5) * F.exp(-since / 3.0)).otherwise(0.0)
    base = 0.6 + 0.6 * F.exp(-F.col("step") / 5000.0)
    s = spark.range(steps).select(F.lit("trace").alias("series"), F.col("id").alias("step")).withColumn("value", base + 0.08 * normal + spike)
    planted = spark.range(1, spikes + 1).select(F.lit("trace").alias("series"), (F.col("id") * gap).alias("step"))
    return s, planted
