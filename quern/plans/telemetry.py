"""Queries over events as training series, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import telemetry as X
from quern.plans.dialect import both
from quern.session import prepare, table


def _series(spark, sf):
    return X.series(table(spark, sf, "events"))


def _two(spark, sf):
    """Per type: value's z and the next event's z as lead and follow."""
    s = X.robust_z(_series(spark, sf)).select("series", "step", F.coalesce("z", F.lit(0.0)).alias("lead"))
    return s.withColumn("follow", F.col("lead"))


def spike_sigma(spark, sf):
    return X.alarm_sigma(_series(spark, sf), 100, 2.0)


def spike_sigma_prefix(spark, sf):
    return X.alarm_sigma_prefix(_series(spark, sf), 100, 2.0)


def spike_ratio_max(spark, sf):
    return X.alarm_ratio(_series(spark, sf), 1.02)


def spike_fixed(spark, sf):
    return X.alarm_fixed(_series(spark, sf), 400.0)


def spike_not_finite(spark, sf):
    s = _series(spark, sf).withColumn("value", F.when(F.col("step") == 3, float("nan")).when(F.col("step") == 5, float("inf")).otherwise(F.col("value")))
    return X.alarm_not_finite(s).groupBy("series").agg(F.count("*").alias("n"))


def spike_ema(spark, sf):
    prepare(spark)
    return X.alarm_ema(_series(spark, sf), z=2.0)


def ema_smooth(spark, sf):
    prepare(spark)
    return X.ema(_series(spark, sf)).groupBy("series").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def robust_z(spark, sf):
    return X.robust_z(_series(spark, sf)).where("z is not null").select("series", "step", F.round("z", 6).alias("z"))


def smooth_median(spark, sf):
    return X.smooth(_series(spark, sf))


def alarm_score(spark, sf):
    s = _series(spark, sf)
    planted = s.where(F.pmod("step", F.lit(97)) == 50).select("series", "step")
    return X.score_alarms(X.alarm_fixed(s, 420.0), planted)


def lead_events(spark, sf):
    return X.lead_events(_two(spark, sf), z=2.0).select("series", "step", "next", "lag")


def base_rates(spark, sf):
    return X.base_rate(_two(spark, sf), z=2.0).select("series", F.round("rate", 9).alias("rate"))


def settle_step(spark, sf):
    return X.settle_step(_series(spark, sf), 300.0)


def first_after_peak(spark, sf):
    return X.first_after_peak(_series(spark, sf), 50.0)


def sample_mean(spark, sf):
    return X.sample_mean(_series(spark, sf), 100).select("series", "column", "x", F.round("value", 6).alias("value"))


def sample_minmax(spark, sf):
    return X.sample_minmax(_series(spark, sf), 100)


def sample_m4(spark, sf):
    return X.sample_m4(_series(spark, sf), 100)


def sample_lttb(spark, sf):
    prepare(spark)
    return X.sample_lttb(_series(spark, sf), 100)


def raster_errors(spark, sf):
    """Pixels that each sample draws wrong: M4 on the rasteriser's own columns draws none or few."""
    s, _ = X.trace(spark, 20_000, 10)
    shape = (20_000, 200, 100, 0.0, 10.0)
    full = X.raster(s, *shape)
    out = None
    for name, points in (("m4", X.sample_m4(s, 200)), ("minmax", X.sample_minmax(s, 200))):
        one = full.select("series").distinct().join(X.wrong_pixels(full, X.raster(points, *shape)), "series", "left").select(F.lit(name).alias("sample"), F.coalesce("wrong", F.lit(0)).alias("wrong"))
        out = one if out is None else out.unionByName(one)
    return out


def detector_sweep(spark, sf):
    """Found, missed and false alarms of every rule on the planted trace."""
    prepare(spark)
    s, planted = X.trace(spark, 30_000, 20)
    rules = [("sigma", X.alarm_sigma_prefix(s)), ("ema", X.alarm_ema(s)), ("ratio", X.alarm_ratio(s)), ("fixed", X.alarm_fixed(s))]
    out = None
    for name, alarms in rules:
        one = X.score_alarms(alarms, planted).withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_S = "s as (select event_type as series, cast(row_number() over (partition by event_type order by ts, event_id) - 1 as bigint) as step, value from events)"
_COL = "c as (select *, cast(round_even(step / greatest(max(step) over (partition by series), 1) * 99, 0) as bigint) as \"column\" from s)"
_EXT = "x as (select series, \"column\", min(step) as f, max(step) as l, arg_min(step, struct_pack(v := value, s := step)) as lo, arg_max(step, struct_pack(v := value, s := -step)) as hi from c group by 1, 2)"
_Z = f"""{_S}, a as (select *, list_sort(list(value) over (partition by series order by step rows between 20 preceding and 1 preceding)) as xs from s),
m as (select *, xs[len(xs) // 2 + 1] as med from a), d as (select *, list_sort(list_transform(xs, lambda x: abs(x - med))) as ds from m),
z as (select series, step, value, case when len(xs) >= 8 then (value - med) / (1.4826 * case when ds[len(ds) // 2 + 1] = 0 then 1e-12 else ds[len(ds) // 2 + 1] end) end as z from d)"""
_SIGMA = f"""with {_S}, w as (select *, avg(value) over t as m, var_pop(value) over t as v, count(*) over t as n from s window t as (partition by series order by step rows between 100 preceding and 1 preceding))
select series, step, value from w where n = 100 and value - m > 2.0 * sqrt(greatest(v, 1e-12))"""

_SQL = [
    both("expert_load", """
with slots as (select layer, expert from (select distinct event_type as layer from events) l cross join (select distinct user_id % 16 as expert from events) e),
load as (select event_type as layer, user_id % 16 as expert, count(*) as n from events where user_id % 7 <> 3 group by 1, 2),
dense as (select s.layer, s.expert, coalesce(l.n, 0) as n from slots s left join load l on s.layer = l.layer and s.expert = l.expert)
select layer, cast(sum(n) as bigint) as total, round((max(n) - avg(n)) / avg(n), 6) as max_vio, cast(sum(case when n = 0 then 1 else 0 end) as bigint) as dead from dense group by layer"""),
    both("expert_load_overall", """
with load as (select event_type as layer, user_id % 16 as expert, count(*) as n from events group by 1, 2),
per as (select layer, (max(n) - avg(n)) / avg(n) as vio, sum(case when n = 0 then 1 else 0 end) as dead from load group by layer)
select round(avg(vio), 6) as mean_vio, round(max(vio), 6) as worst_vio, cast(sum(dead) as bigint) as dead from per"""),
    both("balance_loss", """
with f as (select user_id % 16 as expert, count(*) / (select count(*) from events) as f, avg(value) / (select sum(m) from (select avg(value) as m from events group by user_id % 16) q) as p from events group by 1)
select round(0.01 * 16 * sum(f * p), 9) as aux from f"""),
    both("token_weighted_loss", """
with parts as (select event_type as micro, user_id % 4 as step, sum(value) as s, count(*) as n from events group by 1, 2),
steps as (select step, sum(s) / sum(n) as right_loss, avg(s / n) as mean_of_means from parts group by step)
select step, round(right_loss, 9) as right_loss, round(mean_of_means, 9) as mean_of_means, round(abs(mean_of_means - right_loss) / right_loss, 9) as gap from steps"""),
    both("loss_gap_worst", """
with parts as (select event_type as micro, user_id % 4 as step, sum(value) as s, count(*) as n from events group by 1, 2),
steps as (select step, abs(avg(s / n) - sum(s) / sum(n)) / (sum(s) / sum(n)) as gap from parts group by step)
select round(avg(gap), 9) as mean_gap, max_by(step, gap) as worst_step from steps"""),
    both("masked_loss", """
select event_type, round(sum(case when user_id % 3 <> 0 then value else 0 end) / nullif(sum(case when user_id % 3 <> 0 then 1 else 0 end), 0), 9) as masked_mean,
  round(sum(case when user_id % 3 <> 0 then value else 0 end) / count(*), 9) as wrong_denominator, round(exp(avg(value) / 500), 9) as perplexity, round(avg(value) / 500 - ln(50), 9) as excess from events group by event_type"""),
    both("position_bands", """
with p as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events)
select round(avg(value), 6) as all_mean, round(avg(case when pos < 16 then value end), 6) as head_mean, round(avg(case when pos >= 64 then value end), 6) as tail_mean,
  round(avg(case when pos % 8 = 0 then value end) / avg(case when pos % 8 <> 0 then value end), 6) as boundary_ratio from p"""),
    both("throughput", """
select event_type, round(sum(value) / sum(user_id + 1), 9) as tokens_per_second, round(count(*) / sum(user_id + 1), 9) as batches_per_second from events group by event_type"""),
    both("power_law", """
with p as (select user_id % 8 + 1 as width, avg(value) as lr from events group by 1)
select round(regr_slope(ln(lr), ln(width)), 9) as slope, round(regr_intercept(ln(lr), ln(width)), 9) as intercept, round(exp(regr_intercept(ln(lr), ln(width)) + regr_slope(ln(lr), ln(width)) * ln(16)), 6) as at_16 from p"""),
    both("grid_best", """
with cells as (select event_type as method, user_id % 10 as lr, avg(value) as loss from events group by 1, 2)
select method, min_by(lr, loss) as best_lr, round(min(loss), 9) as best_loss from cells group by method"""),
    both("parabola_vertex", """
with cells as (select event_type as method, user_id % 10 + 1 as k, avg(value) as loss from events group by 1, 2),
n as (select *, lag(loss) over (partition by method order by k) as a, lead(loss) over (partition by method order by k) as c, min(loss) over (partition by method) as best from cells)
select method, k, round(case when a is null or c is null or a - 2 * loss + c = 0 then k else k + 0.5 * (a - c) / (a - 2 * loss + c) end, 9) as vertex from n where loss = best"""),
    both("kernel_buckets", """
with b as (select case when event_type like '%cl%' then 'matmul' when event_type like '%v%' then 'attention' when event_type like '%p%' then 'norm' else 'other' end as bucket, value from events)
select bucket, count(*) as n, round(sum(value), 4) as total, round(100 * sum(value) / sum(sum(value)) over (), 6) as share from b group by bucket"""),
    both("loss_sigma", """
with l as (select user_id, avg(value) as loss from events group by user_id), s as (select stddev_pop(loss) as sd, avg(loss) as m from l)
select round(max(sd), 9) as sd, round(min(case when abs(loss - m) > 2 * sd then abs(loss - m) end), 9) as smallest_gap from l cross join s"""),
    both("last_twenty", """
with s as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) as i, count(*) over (partition by event_type) as n from events)
select event_type, round(avg(value), 9) as mean from s where i > n - 20 group by event_type"""),
    both("zero_memory", """
with parts as (select event_type as category, user_id % 8 as rank, sum(value) as bytes from events group by 1, 2)
select category, round(max(bytes), 4) as worst, round(sum(bytes), 4) as total, round(sum(bytes) / 1000, 6) as per_parameter from parts group by category"""),
    both("traffic_ledger", """
with v as (select 32 as w, * from (values ('all_reduce', 4096), ('reduce_scatter', 4096), ('all_gather', 4096), ('broadcast', 1000)) t(op, bytes))
select op, cast(bytes as bigint) as bytes, round(bytes * case when op = 'all_reduce' then 2e0 * (w - 1) / w else 1e0 * (w - 1) / w end, 6) as moved from v"""),
    both("zero_theory", """
select stage, w, round(case stage when 0 then 16e0 when 1 then 4 + 12e0 / w when 2 then 2 + 14e0 / w else 16e0 / w end, 9) as bytes_per_parameter, cast(ceil(1000003.0 / w) as bigint) as chunk,
  cast(ceil(1000003.0 / w) * w - 1000003 as bigint) as padding from (values (0), (1), (2), (3)) s(stage) cross join (values (2), (8), (32)) r(w)"""),
    both("zero_gradients", """
with g as (select case when event_type like 'c%' then 'head' when event_type like 'v%' then 'body' else 'embedding' end as part, cast(floor(value) as bigint) % 5 as g, user_id % 2 as frozen from events)
select part, round(avg(case when g = 0 then 1e0 else 0e0 end), 9) as zero_share, round(sqrt(sum(g * g)), 6) as norm, cast(sum(case when frozen = 1 then 2 else 16 end) as bigint) as bytes from g group by part"""),
    both("key_difference", """
with have as (select distinct 'layer.' || user_id as k from events where user_id % 3 <> 0), want as (select distinct 'layer.' || user_id as k from events where user_id % 4 <> 0)
select cast(sum(case when h.k is null then 1 else 0 end) as bigint) as missing, cast(sum(case when w.k is null then 1 else 0 end) as bigint) as unexpected, cast(sum(case when h.k is not null and w.k is not null then 1 else 0 end) as bigint) as matched
from have h full outer join want w on h.k = w.k"""),
    both("bias_correction", """
with t as (select distinct event_id % 2000 + 1 as t from events), r as (select t, (1 - power(0.9, t)) / sqrt(1 - power(0.999, t)) as r from t)
select round(max(r), 9) as peak, max_by(t, r) as peak_at, min(case when abs(r - 1) < 0.05 and t > 300 then t end) as near_one from r"""),
    both("schedules", """
with t as (select distinct event_id % 300 as t from events), s as (select t, case when t < 30 then (t + 1) / 30e0 else 1e-1 + 45e-2 * (1 + cos(pi() * (t - 30) / 270e0)) end as cosine,
  case when t < 30 then (t + 1) / 30e0 when t < 240 then 1e0 else 1 - 9e-1 * (t - 240) / 60e0 end as wsd from t) select t, round(cosine, 9) as cosine, round(wsd, 9) as wsd, round(sqrt(t / 300e0), 9) as scaled from s"""),
    both("flops_mfu", """
select n, l, 6 * n + 12 * l * 128 * 512 as flops, round((6 * n + 12 * l * 128 * 512) * 50000.0 / 21.5e12, 9) as mfu from (values (cast(21500000 as bigint), 12), (cast(85000000 as bigint), 22)) v(n, l)"""),
    both("moe_parameters", """
select e, k, e * 2 * 256 * 1024 + 256 * e as total, k * 2 * 256 * 1024 + 256 * e as active, round(cast(e * 2 * 256 * 1024 + 256 * e as double) / (k * 2 * 256 * 1024 + 256 * e), 9) as ratio from (values (8, 2), (64, 4)) v(e, k)"""),
    both("memory_bills", """
select context, context * 50257 * 2 as logit_bytes, 2 * 22 * context * 512 * 2 as kv_bytes from (values (cast(1024 as bigint)), (8192), (131072)) v(context)"""),
    both("first_two_moments", """
select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(min(value), 6) as low, round(max(value), 6) as high, round(corr(value, user_id), 6) as r from events group by event_type"""),
]

_FRAMES = (
    spike_sigma, spike_sigma_prefix, spike_ratio_max, spike_fixed, spike_not_finite, spike_ema, ema_smooth, robust_z, smooth_median, alarm_score, lead_events, base_rates,
    settle_step, first_after_peak, sample_mean, sample_minmax, sample_m4, sample_lttb, raster_errors, detector_sweep,
)
QUERIES = {f.__name__: f for f in _FRAMES} | {n: f for n, f, _ in _SQL}
ORACLES = {n: q for n, _, q in _SQL} | {
    "spike_sigma": _SIGMA,
    "spike_sigma_prefix": _SIGMA,
    "spike_ratio_max": f"with {_S}, w as (select *, max(value) over (partition by series order by step rows between unbounded preceding and 1 preceding) as m from s) select series, step, value from w where m > 0 and value > 1.02 * m",
    "spike_fixed": f"with {_S} select * from s where value > 400.0",
    "spike_not_finite": f"with {_S} select series, count(*) as n from s where step in (3, 5) group by series",
    "robust_z": f"with {_Z} select series, step, round(z, 6) as z from z where z is not null",
    "smooth_median": f"with {_S}, a as (select series, step, list_sort(list(value) over (partition by series order by step rows between 4 preceding and 4 following)) as xs from s) select series, step, xs[len(xs) // 2 + 1] as value from a",
    "alarm_score": f"""with {_S}, a as (select series, step from s where value > 420.0), p as (select series, step from s where step % 97 = 50)
select series, count(distinct p.step) filter (exists (select 1 from a where a.series = p.series and abs(a.step - p.step) <= 4)) as found,
  count(distinct p.step) filter (not exists (select 1 from a where a.series = p.series and abs(a.step - p.step) <= 4)) as missed,
  (select count(*) from a where a.series = p.series and not exists (select 1 from p as q where q.series = a.series and abs(a.step - q.step) <= 4)) as false_alarms from p group by series""",
    "lead_events": f"with {_Z}, n as (select series, step, coalesce(z, 0) as z, min(case when coalesce(z, 0) >= 2.0 then step end) over (partition by series order by step rows between 1 following and 10 following) as next from z) select series, step, next, next - step as lag from n where z >= 2.0",
    "base_rates": f"with {_Z}, n as (select series, max(cast(coalesce(z, 0) >= 2.0 as int)) over (partition by series order by step rows between 1 following and 10 following) as a from z) select series, round(avg(a), 9) as rate from n where a is not null group by series",
    "settle_step": f"with {_S}, m as (select series, max(step) as l, min(step) as f, max(case when not value < 300.0 then step end) as b from s group by series) select series, case when b is null then f when b < l then b + 1 end as settled from m",
    "first_after_peak": f"with {_S}, p as (select series, arg_min(step, struct_pack(v := -value, s := step)) as peak from s group by series) select s.series, peak, min(case when step > peak and value <= 50.0 then step end) as after from s join p on s.series = p.series group by s.series, peak",
    "sample_mean": f'with {_S}, {_COL} select series, "column", (min(step) + max(step)) / 2 as x, round(avg(value), 6) as value from c group by 1, 2',
    "sample_minmax": f'with {_S}, {_COL}, {_EXT} select x.series, x."column", s.step, s.value from (select distinct series, "column", unnest([lo, hi]) as step from x) x join s on s.series = x.series and s.step = x.step',
    "sample_m4": f'with {_S}, {_COL}, {_EXT} select x.series, x."column", s.step, s.value from (select distinct series, "column", unnest([f, lo, hi, l]) as step from x) x join s on s.series = x.series and s.step = x.step',
}
