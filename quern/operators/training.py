"""Measurements over training rows: routing health, worst losses, optimiser recursions, number formats, selection attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 6


def top_experts(scores: Column, k: int) -> Column:
    """Places of the k largest scores, ties to the smaller place."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x.i)


def router_stats(rows: DataFrame, k: int = 2) -> DataFrame:
    """rows (layer, scores, bias) to entropy, share of slots that the bias changed, share of tokens with another set, and
    the score mass of the sets chosen without and with the bias."""
    biased = F.zip_with("scores", "bias", lambda s, b: s + b)
    mass = lambda at: F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get("scores", i))
    r = rows.withColumns({"own": top_experts(F.col("scores"), k), "used": top_experts(biased, k)})
    r = r.withColumn("kept", F.size(F.array_intersect("own", "used")))
    entropy = F.aggregate("scores", F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return r.groupBy("layer").agg(
        F.avg(entropy).alias("entropy"), F.avg(1 - F.col("kept") / k).alias("intervention"), F.avg((F.col("kept") < k).cast("int")).alias("set_change"),
        F.avg(mass(F.col("own"))).alias("own_mass"), F.avg(mass(F.col("used"))).alias("used_mass"),
    )


def worst_losses(rows: DataFrame, n: int = 5) -> DataFrame:
    """rows (step, seq, pos, loss): the n largest of every step, ties to the larger sequence, then position."""
    w = Window.partitionBy("step").orderBy(F.desc("loss"), F.desc("seq"), F.desc("pos"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def adam(gradients: Column, start: float, rate: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> Column:
    """The weight after all gradients of one ordered array."""
    zero = F.struct(F.lit(float(start)).alias("w"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(0).alias("t"))

    def step(s, g):
        m, v, t = b1 * s.m + (1 - b1) * g, b2 * s.v + (1 - b2) * g * g, s.t + 1
        move = rate * (m / (1 - F.pow(F.lit(b1), t))) / (F.sqrt(v / (1 - F.pow(F.lit(b2), t))) + eps)
        return F.struct((s.w - move).alias("w"), m.alias("m"), v.alias("v"), t.alias("t"))

    return F.aggregate(gradients, zero, step, lambda s: s.w)


def float_pattern(x: Column, exponent_bits: int, mantissa_bits: int) -> Column:
    """Sign, exponent and mantissa bits of x in a small float format, round half to even, subnormals kept, overflow held at
    the largest exponent."""
    bias, top = 2 ** (exponent_bits - 1) - 1, 2**exponent_bits - 2
    size = F.abs(x)
    power = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1e-300)))), F.lit(1 - bias))
    units = F.bround(size / F.pow(F.lit(2.0), power - mantissa_bits)).cast("long")  # in units of the last place
    carried = units >= 2 ** (mantissa_bits + 1)
    power, units = F.when(carried, power + 1).otherwise(power), F.when(carried, F.shiftright(units, 1)).otherwise(units)
    normal = units >= 2**mantissa_bits
    exponent = F.when(normal, F.least(power + bias, F.lit(top))).otherwise(F.lit(0)).cast("long")
    mantissa = F.when(normal, units - 2**mantissa_bits).otherwise(units)
    bits = F.concat(F.when(x < 0, "1").otherwise("0"), F.lit(" "), F.lpad(F.bin(exponent), exponent_bits, "0"), F.lit(" "), F.lpad(F.bin(mantissa), mantissa_bits, "0"))
    return bits


def attempt_selection(trail: DataFrame, protected: list[str]) -> DataFrame:
    """trail (lane, k, decision) in draw order: a document is consumed if accepted, if its lane is protected, or as the
    sixth refusal in a row. Runs of refusals are counted from the last acceptance, so no loop over draws is needed."""
    order = Window.partitionBy("lane").orderBy("k")
    free = (F.col("decision") == "accept") | F.col("lane").isin(protected)
    runs = trail.withColumn("free", free).withColumn("run", F.sum(F.col("free").cast("int")).over(order))
    place = F.sum((~F.col("free")).cast("int")).over(Window.partitionBy("lane", "run").orderBy("k"))
    out = runs.withColumn("forced", ~F.col("free") & (place % MAX_ATTEMPTS == 0))
    return out.select("lane", "k", "decision", (F.col("free") | F.col("forced")).alias("consumed"), "forced", ((F.col("decision") == "defer") & ~F.col("free") & ~F.col("forced")).alias("deferred"))


def bigram_loss(tokens: DataFrame, vocabulary: int, add: float = 1.0) -> DataFrame:
    """tokens (seq, pos, token, loss) to seq and its mean loss over loss-bearing targets, 0 without any, under add-one
    bigrams of the same rows."""
    w = Window.partitionBy("seq").orderBy("pos")
    pairs = tokens.select("seq", "token", F.lead("token").over(w).alias("next"), F.lead("loss").over(w).alias("bears"))
    both = pairs.where("next is not null")
    c2 = both.groupBy("token", "next").agg(F.count("*").alias("c2"))
    c1 = c2.groupBy("token").agg(F.sum("c2").alias("c1"))
    scored = both.join(c2, ["token", "next"]).join(c1, "token").withColumn("nll", -F.ln((F.col("c2") + add) / (F.col("c1") + add * vocabulary)))
    return scored.groupBy("seq").agg(F.coalesce(F.avg(F.when(F.col("bears"), F.col("nll"))), F.lit(0.0)).alias("loss"))


def dispatch(rows: DataFrame, expert: str, token: str, block: int = 4096) -> DataFrame:
    """rows with `position`, their place in a counting sort by expert and token. Tokens are counted in blocks, so no task
    holds a whole expert: a block's start is a sum over the blocks before it, positions count within blocks."""
    placed = rows.withColumn("_block", F.floor(F.col(token) / block))
    counts = placed.groupBy(expert, "_block").agg(F.count("*").alias("_n"))
    experts = counts.groupBy(expert).agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(expert).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy(expert).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(expert, "_block", inner.alias("_inner")).join(experts.select(expert, before.alias("_first")), expert)
    rank = F.row_number().over(Window.partitionBy(expert, "_block").orderBy(token)) - 1
    return placed.join(starts, [expert, "_block"]).withColumn("position", (F.col("_first") + F.col("_inner") + rank).cast("long")).select(*rows.columns, "position")


def scaled_rate(base_rate: float, batch: Column, base_batch: float) -> Column:
    """The learning rate for a batch size, by the square root of its ratio to the base batch."""
    return F.lit(base_rate) * F.sqrt(batch / F.lit(base_batch))


def upper_median(values: Column) -> Column:
    """The upper median of the collected values of a group: of an even number, the larger of the middle two."""
    held = F.sort_array(F.collect_list(values))
    return F.get(held, F.floor(F.size(held) / 2).cast("int"))
