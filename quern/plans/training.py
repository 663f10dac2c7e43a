"""Queries over training rows, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import training as R
from quern.session import table


def router_stats(spark, sf):
    scores = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x).cast("double") + 0.01)
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("layer"), F.transform(scores, lambda x: x / F.aggregate(scores, F.lit(0.0), lambda a, y: a + y)).alias("scores"))
    rows = rows.withColumn("bias", F.array(F.lit(0.0), F.lit(0.1), F.lit(0.0), F.lit(-0.1)))
    return R.router_stats(rows).select("layer", *(F.round(c, 6).alias(c) for c in ("entropy", "intervention", "set_change", "own_mass", "used_mass")))


def worst_losses(spark, sf):
    rows = table(spark, sf, "events").select(F.pmod("user_id", F.lit(40)).alias("step"), F.col("user_id").alias("seq"), F.col("event_id").alias("pos"), F.round("value", 0).alias("loss"))
    return R.worst_losses(rows).select("step", "seq", "pos", "loss", F.col("rank").cast("long").alias("rank"))


def adam_by_hand(spark, sf):
    return spark.createDataFrame([([0.5, 0.4, 0.6, 0.45, 0.55],)], "g array<double>").select(F.round(R.adam(F.col("g"), 1.0), 12).alias("w"))


def float_patterns(spark, sf):
    made = spark.createDataFrame([(0.0,), (1.0,), (-1.5,), (0.1,), (3.14159,), (0.015625,), (240.0,)], "x double")
    return made.select("x", R.float_pattern(F.col("x"), 8, 23).alias("fp32"), R.float_pattern(F.col("x"), 8, 7).alias("bf16"), R.float_pattern(F.col("x"), 4, 3).alias("e4m3"))


def attempt_selection(spark, sf):
    trail = table(spark, sf, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("k"), F.when(F.col("value") > 150, "accept").when(F.col("value") > 80, "defer").otherwise("reject").alias("decision"))
    out = R.attempt_selection(trail, ["click"])
    return out.groupBy("lane").agg(F.count_if("consumed").alias("consumed"), F.count_if("forced").alias("forced"), F.count_if("deferred").alias("deferred"))


def bigram_loss(spark, sf):
    e = table(spark, sf, "events")
    tokens = e.select(F.col("user_id").alias("seq"), F.col("event_id").alias("pos"), F.col("event_type").alias("token"), (F.col("value") > 20).alias("loss"))
    return R.bigram_loss(tokens, 5).select("seq", F.round("loss", 9).alias("loss"))


def expert_dispatch(spark, sf):
    return R.dispatch(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id")


def sqrt_rates(spark, sf):
    sizes = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("batch"))
    return sizes.select("event_type", "batch", F.round(R.scaled_rate(3e-4, F.col("batch"), 256.0), 9).alias("rate"))


def layer_median(spark, sf):
    """Upper median over layers of each step's mean to its largest value; a step has a handful of layers."""
    e = table(spark, sf, "events")
    ratios = e.groupBy(F.pmod("user_id", F.lit(40)).alias("step"), F.col("event_type").alias("layer")).agg((F.avg("value") / F.max("value")).alias("ratio"))
    return ratios.groupBy("step").agg(F.round(R.upper_median(F.col("ratio")), 9).alias("median"), F.count("*").alias("layers"))


def tokens_per_kchar(spark, sf):
    """Words for each thousand characters, by language."""
    words, chars = F.regexp_count("text", F.lit(r"[^ \t\n]+")), F.length("text")
    d = table(spark, sf, "documents").groupBy("lang").agg(F.sum(words).alias("tokens"), F.sum(chars).alias("chars"))
    return d.select("lang", F.col("tokens").cast("long").alias("tokens"), F.round(1000 * F.col("tokens") / F.col("chars"), 6).alias("per_kchar"))


def value_percentiles(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(*(F.round(F.percentile("value", q), 6).alias(f"p{round(100 * q)}") for q in (0.1, 0.5, 0.9)))


def distinct_users(spark, sf):
    """A sketch's count of users beside the exact one."""
    near = F.abs(F.approx_count_distinct("user_id", 0.02) - F.count_distinct("user_id")) <= 0.1 * F.count_distinct("user_id")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), near.alias("sketch_is_near"))


_FRAMES = (expert_dispatch, sqrt_rates, layer_median, tokens_per_kchar, value_percentiles, distinct_users, router_stats, worst_losses, adam_by_hand, float_patterns, attempt_selection, bigram_loss)
QUERIES = {f.__name__: f for f in _FRAMES}
ORACLES = {
    "expert_dispatch": "select event_id, event_type, row_number() over (order by event_type, event_id) - 1 as position from events",
    "sqrt_rates": "select event_type, count(*) as batch, round(3e-4 * sqrt(count(*) / 256e0), 9) as rate from events group by event_type",
    "layer_median": """with r as (select user_id % 40 as step, event_type as layer, avg(value) / max(value) as ratio from events group by all),
k as (select *, row_number() over (partition by step order by ratio) as k, count(*) over (partition by step) as n from r) select step, round(ratio, 9) as median, n as layers from k where k = n // 2 + 1""",
    "tokens_per_kchar": r"""with d as (select lang, sum(len(regexp_extract_all(text, '[^ \t\n]+'))) as t, sum(length(text)) as c from documents group by lang)
select lang, cast(t as bigint) as tokens, round(1000 * t / c, 6) as per_kchar from d""",
    "value_percentiles": "select event_type, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90 from events group by event_type",
    "distinct_users": "select event_type, count(distinct user_id) as users, true as sketch_is_near from events group by event_type",
    "worst_losses": """with r as (select user_id % 40 as step, user_id as seq, event_id as pos, round(value, 0) as loss from events), k as (select *, row_number() over (partition by step order by loss desc, seq desc, pos desc) as rank from r) select * from k where rank <= 5""",
    "adam_by_hand": """with recursive g as (select * from (values (1, 0.5e0), (2, 0.4e0), (3, 0.6e0), (4, 0.45e0), (5, 0.55e0)) v(t, g)),
s as (select 0 as t, 1e0 as w, 0e0 as m, 0e0 as v union all select g.t, s.w - 1e-3 * ((9e-1 * s.m + (1 - 9e-1) * g) / (1 - pow(9e-1, g.t))) / (sqrt((999e-3 * s.v + (1 - 999e-3) * g * g) / (1 - pow(999e-3, g.t))) + 1e-8), 9e-1 * s.m + (1 - 9e-1) * g, 999e-3 * s.v + (1 - 999e-3) * g * g from s join g on g.t = s.t + 1)
select round(w, 12) as w from s where t = 5""",
    "attempt_selection": """with t as (select event_type as lane, event_id as k, case when value > 150 then 'accept' when value > 80 then 'defer' else 'reject' end as decision from events),
f as (select *, decision = 'accept' or lane = 'click' as free from t), r as (select *, sum(free::int) over (partition by lane order by k) as run from f),
p as (select *, sum((not free)::int) over (partition by lane, run order by k) as place from r), q as (select *, not free and place % 6 = 0 as forced from p)
select lane, count(*) filter (free or forced) as consumed, count(*) filter (forced) as forced, count(*) filter (decision = 'defer' and not free and not forced) as deferred from q group by lane""",
    "bigram_loss": """with p as (select user_id as seq, event_type as token, lead(event_type) over w as next, lead(value > 20) over w as bears from events window w as (partition by user_id order by event_id)), b as (select * from p where next is not null),
c as (select *, count(*) over (partition by token, next) as c2, count(*) over (partition by token) as c1 from b) select seq, round(coalesce(avg(case when bears then -ln((c2 + 1) / (c1 + 5)) end), 0), 9) as loss from c group by seq""",
    "float_patterns": "select * from (values (0e0, '0 00000000 00000000000000000000000', '0 00000000 0000000', '0 0000 000'), (1e0, '0 01111111 00000000000000000000000', '0 01111111 0000000', '0 0111 000'), (-1.5e0, '1 01111111 10000000000000000000000', '1 01111111 1000000', '1 0111 100'), (1e-1, '0 01111011 10011001100110011001101', '0 01111011 1001101', '0 0011 101'), (3.14159e0, '0 10000000 10010010000111111010000', '0 10000000 1001001', '0 1000 101'), (0.015625e0, '0 01111001 00000000000000000000000', '0 01111001 0000000', '0 0001 000'), (240e0, '0 10000110 11100000000000000000000', '0 10000110 1110000', '0 1110 111')) v(x, fp32, bf16, e4m3)",
}
