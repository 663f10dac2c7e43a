"""Queries over mixtures and schedules, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import mixture as M
from quern.operators import shards as S
from quern.session import prepare, table

LANES7 = list(M.MAIN_MIX)


def _lanes(spark):
    return spark.createDataFrame([(k, float(v), M.REPEAT_CAPS[k]) for k, v in M.MAIN_MIX.items()], "lane string, share double, cap double")


def _inventory(spark):
    return spark.createDataFrame([(k, float(x)) for k, v in M.INVENTORY.items() for x in v], "lane string, tokens double")


def _scored(spark, sf):
    """events as candidate batches: lane by user, score from value."""
    lane = F.get(F.array(*map(F.lit, LANES7)), F.pmod("user_id", F.lit(7)).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), lane.alias("lane"), F.round(F.col("value"), 0).alias("score"))


def mixture_supply(spark, sf):
    return M.supply(_lanes(spark), _inventory(spark))


def tier_fill(spark, sf):
    tiers = spark.createDataFrame([(i, *t) for i, t in enumerate(M.TIERS)], "ord int, tier string, tokens double, cap double")
    return M.tier_fill(tiers, M.BUDGET_B * M.MAIN_MIX["indic"] / 100)


def top_share_mix(spark, sf):
    return M.mix(M.top_share(_scored(spark, sf), 0.5)).select("lane", F.round("pct", 9).alias("pct"))


def floor_select(spark, sf):
    return M.floor_select(_scored(spark, sf), 0.5, M.FLOORS).select("lane", F.round("pct", 9).alias("pct"))


def largest_remainder(spark, sf):
    return M.largest_remainder(M.stage_table(spark), 16, ["stage"]).select("stage", "lane", "alloc")


def stage_lookup(spark, sf):
    return M.stage_at(spark.range(45).select(F.col("id").alias("step")), M.stage_table(spark))


def _alloc(spark):
    return M.lane_alloc(spark, spark.range(40).select(F.col("id").alias("step")), 16, 6006)


def lane_allocation(spark, sf):
    return _alloc(spark)


def lane_allocation_law(spark, sf):
    """Every step adds up to the batch and meets every floor."""
    floors = M.stage_table(spark).select("stage", "lane", F.coalesce(F.ceil(F.col("floor") * 16), F.lit(0)).alias("least"))
    met = _alloc(spark).join(floors, ["stage", "lane"]).groupBy("step").agg(F.sum("alloc").alias("total"), F.every(F.col("alloc") >= F.col("least")).alias("met"))
    return met.groupBy("total", "met").agg(F.count("*").alias("steps"))


def planned_shares(spark, sf):
    return M.planned_shares(_alloc(spark), 16).select("lane", F.round("share", 9).alias("share"))


def feasibility(spark, sf):
    have = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("tokens"))
    lane = F.get(F.array(*map(F.lit, M.LANES)), F.pmod(F.regexp_extract("source", r"\d+", 0).cast("int"), F.lit(8)))
    have = have.withColumn("lane", lane).where("lane is not null").groupBy("lane").agg(F.sum("tokens").alias("tokens"))
    return M.feasibility(M.planned_shares(_alloc(spark), 16), have.where("lane <> 'agentic'"), 640)


def mixture_compliance(spark, sf):
    alloc = _alloc(spark).select("step", "lane", "alloc")
    return M.compliance(alloc.where("step <> 7 or lane <> 'code'"), alloc, 16).select("lane", F.round("actual", 9).alias("actual"), F.round("planned", 9).alias("planned"), "within", "floors_met")


def _lane_docs(spark, sf):
    return S.lane_documents(table(spark, sf, "documents"), M.LANES)


def corpus_stats(spark, sf):
    return _lane_docs(spark, sf).select("lane", "split").groupBy(F.expr("lane"), F.expr("split")).agg(F.count("*").alias("n"))


def corpus_grouping_sets(spark, sf):
    docs = _lane_docs(spark, sf)
    docs.createOrReplaceTempView("lane_docs")
    return spark.sql("select coalesce(lane, '*') as lane, coalesce(split, '*') as split, count(*) as n from lane_docs group by grouping sets ((lane), (split), ())")


def shard_manifests(spark, sf):
    prepare(spark)
    return S.shard_manifests(S.build_shards(_lane_docs(spark, sf))).drop("content_sha256")


def shard_verify(spark, sf):
    prepare(spark)
    shards = S.build_shards(_lane_docs(spark, sf))
    manifests = S.shard_manifests(shards)
    tampered = shards.withColumn("ids", F.when((F.col("place") == 0) & F.col("shard_id").startswith("code.train"), F.reverse("ids")).otherwise(F.col("ids")))
    good = S.verify_shards(shards, manifests).agg(F.every("ok").alias("untouched_ok"))
    bad = S.verify_shards(tampered, manifests).agg(F.count_if(~F.col("ok")).alias("tampered_found"))
    return good.join(bad)


def trainable_tokens(spark, sf):
    prepare(spark)
    shards = S.build_shards(_lane_docs(spark, sf))
    return shards.where("split = 'train' and not contaminated").groupBy("lane").agg(F.sum(F.size("ids")).alias("tokens"))


def loss_spans(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.struct(F.length("text").cast("int").alias("n"), (F.col("role") == "assistant").alias("loss")).alias("s"))
    segs = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x.s).alias("segments"))
    spans = segs.select("conv_id", F.explode(S.loss_spans(F.col("segments"), F.lit(0))).alias("x"))
    return spans.select("conv_id", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def pack_structured(spark, sf):
    return S.utilization(S.pack_structured(_lane_docs(spark, sf), 128), 128)


def pack_concat(spark, sf):
    prepare(spark)
    return S.utilization(S.pack_concat(_lane_docs(spark, sf), 128), 128)


def packing_audit(spark, sf):
    prepare(spark)
    packed = S.pack_concat(_lane_docs(spark, sf), 128)
    return S.audit_packing(packed, ["lane", "part", "seq"])


def attention_pairs(spark, sf):
    packed = S.pack_structured(_lane_docs(spark, sf), 64)
    return S.attention_pairs(packed, ["lane", "doc_id"]).groupBy("lane").agg(F.sum("allowed").alias("allowed"), F.count("*").alias("sequences"))


def attention_mask_check(spark, sf):
    """The mask made out equals the count of allowed pairs, on short sequences."""
    packed = S.pack_structured(_lane_docs(spark, sf), 16)
    made = S.attention_mask(packed, ["lane", "doc_id"]).groupBy("doc_id").agg(F.count("*").alias("made"))
    return made.join(S.attention_pairs(packed, ["lane", "doc_id"]), "doc_id").agg(F.every(F.col("made") == F.col("allowed")).alias("equal"), F.sum("made").alias("pairs"))


def selection_summary(spark, sf):
    return S.decision_summary(S.decide(_lane_docs(spark, sf).select("lane", "doc_id"), 6006))


def epoch_draws(spark, sf):
    docs = _lane_docs(spark, sf).select("lane", "doc_id")
    draws = docs.select("lane").distinct().join(spark.range(400).select(F.col("id").alias("k")))
    drawn = S.epoch_draws(docs, draws, 6006)
    return drawn.groupBy("lane").agg(F.count("*").alias("draws"), F.max("epoch").alias("last_epoch"), F.count_if(F.col("epoch") == 0).alias("first_epoch"))


def _entries(spark, sf):
    """All events, in a ledger for each type and 500 ids: a chain is one task's work and doesn't grow with the table."""
    ledger = F.concat_ws("/", "event_type", F.expr("event_id div 500").cast("string"))
    rows = table(spark, sf, "events").select(ledger.alias("ledger"), F.col("event_id").alias("seq"), F.concat(F.lit("v="), F.col("user_id").cast("string")).alias("payload"))
    return S.chain(rows)


def _day_entries(spark, sf):
    """All events, in a ledger for each type and day: a chain is one task's work and doesn't grow with the table."""
    ledger = F.concat_ws("/", "event_type", F.to_date("ts").cast("string"))
    return S.chain(table(spark, sf, "events").select(ledger.alias("ledger"), F.col("event_id").alias("seq"), F.concat(F.lit("v="), F.col("user_id").cast("string")).alias("payload")))


def ledger_verify(spark, sf):
    prepare(spark)
    e = _entries(spark, sf)
    tampered = e.withColumn("payload", F.when(F.col("ledger").startswith("click/") & (F.pmod("seq", F.lit(50)) == 1), "v=-1").otherwise(F.col("payload")))
    a = S.verify_chain(e).select("ledger", "entries", F.col("first_bad").isNull().alias("intact"))
    return a.join(S.verify_chain(tampered).select("ledger", F.col("first_bad").isNotNull().alias("tamper_found")), "ledger")


def replay_compare(spark, sf):
    prepare(spark)
    e = _entries(spark, sf).where("ledger like 'click/%'")
    again = S.truncate(_entries(spark, sf).where("ledger like 'click/%'"), 300)
    same = S.compare_runs(e.select("seq", "entry_hash"), again.select("seq", "entry_hash"), "seq", "entry_hash").agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("different"))
    fork = e.withColumn("entry_hash", F.when(F.col("seq") > 200, F.reverse("entry_hash")).otherwise(F.col("entry_hash")))
    return same.join(S.fork_differences(e, fork, "seq", "entry_hash").agg(F.count_if("differs").alias("forked")))


def firewall_scan(spark, sf):
    docs = _lane_docs(spark, sf)
    consumed = docs.where("split = 'train' or doc_id % 40 = 4").groupBy(F.pmod("doc_id", F.lit(10)).alias("step")).agg(F.collect_list("doc_id").alias("members"))
    return S.firewall(consumed, docs.where("split <> 'train'"))


def trail_join(spark, sf):
    docs = _lane_docs(spark, sf).select("lane", "doc_id").withColumn("step", F.pmod("doc_id", F.lit(40)))
    trail = S.decide(docs, 6006).withColumn("step", F.col("step"))
    return S.unexplained(docs.select("step", "doc_id"), trail.where("doc_id % 100 <> 7")).agg(F.count("*").alias("unexplained"))


def evidence_table(spark, sf):
    prepare(spark)
    docs = _lane_docs(spark, sf)
    shards = S.build_shards(docs)
    checks = [
        ("alloc_sums", _alloc(spark).groupBy("step").agg(F.sum("alloc").alias("n")).agg(F.every(F.col("n") == 16).alias("ok"))),
        ("ledger_intact", S.verify_chain(_day_entries(spark, sf)).agg(F.every(F.col("first_bad").isNull()).alias("ok"))),
        ("no_held_out_trained", shards.where("split = 'train' and not contaminated").join(docs.where("split <> 'train'").select(F.sha2("text", 256).alias("content")), "content", "left_semi").agg((F.count("*") == 0).alias("ok"))),
        ("shards_verify", S.verify_shards(shards, S.shard_manifests(shards)).agg(F.every("ok").alias("ok"))),
        ("tamper_is_seen", S.verify_chain(_day_entries(spark, sf).withColumn("payload", F.lit("x"))).agg(F.every(F.col("first_bad").isNotNull()).alias("ok"))),
    ]
    return S.evidence(checks)


_STAGE_VALUES = ", ".join(f"('{s[0]}', '{lane}', {w})" for s in M.STAGES for lane, w in zip(M.LANES, s[3]))
_LANE_CASE = "['" + "', '".join(LANES7) + "'][user_id % 7 + 1]"
_INV = ", ".join(f"('{k}', {float(x)})" for k, v in M.INVENTORY.items() for x in v)
_SHARES = ", ".join(f"('{k}', {float(v)}, {M.REPEAT_CAPS[k]})" for k, v in M.MAIN_MIX.items())
_TIERV = ", ".join(f"({i}, '{t}', {a}, {c})" for i, (t, a, c) in enumerate(M.TIERS))
_SCORED = f"c as (select event_id as id, {_LANE_CASE} as lane, round(value, 0) as score from events), k as (select cast(count(*) * 0.5 as bigint) as k from c)"
_FRAMES = (
    mixture_supply, tier_fill, top_share_mix, floor_select, largest_remainder, stage_lookup, lane_allocation, lane_allocation_law, planned_shares, feasibility, mixture_compliance,
    corpus_stats, corpus_grouping_sets, shard_manifests, shard_verify, trainable_tokens, loss_spans, pack_structured, pack_concat, packing_audit, attention_pairs,
    attention_mask_check, selection_summary, epoch_draws, ledger_verify, replay_compare, firewall_scan, trail_join, evidence_table,
)
QUERIES = {f.__name__: f for f in _FRAMES}
_LD = """ld as (select doc_id, text, case when doc_id % 8 = 0 then 'eval' when doc_id % 8 = 4 then 'validation' else 'train' end as split, source,
  ['general_web', 'code', 'math', 'reasoning', 'agentic', 'indic'][cast(('0x' || substr(md5(source), 1, 8))::bigint % 6 as int) + 1] as lane, len(regexp_extract_all(text, '\\S+')) as n from documents)"""
_SHARDS = f"""{_LD}, q as (select *, cast((row_number() over (partition by lane, split order by doc_id) - 1) // 8 as int) as chunk, (row_number() over (partition by lane, split order by doc_id) - 1) % 8 as place from ld),
u as (select *, row_number() over (partition by text order by lane, split, chunk, place) as copy from q),
s as (select *, lane || '.' || split || '.' || lpad(cast(chunk as varchar), 2, '0') as shard_id, split = 'train' and text in (select text from ld where split <> 'train') as leaks from u where copy = 1),
m as (select shard_id, lane, split, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens, bool_or(leaks) as contaminated from s group by all)"""
_SEED = "(('0x' || substr(sha256('6006:' || lane || ':' || doc_id), 1, 16))::ubigint & 9223372036854775807::ubigint)"
ORACLES = {
    "corpus_stats": f"with {_LD} select lane, split, count(*) as n from ld group by lane, split",
    "corpus_grouping_sets": f"with {_LD} select coalesce(lane, '*') as lane, coalesce(split, '*') as split, count(*) as n from ld group by grouping sets ((lane), (split), ())",
    "shard_manifests": f"with {_SHARDS} select *, split = 'train' and not contaminated as trainable from m",
    "trainable_tokens": f"with {_SHARDS} select lane, cast(sum(n_tokens) as bigint) as tokens from m where split = 'train' and not contaminated group by lane",
    "pack_structured": f"""with {_LD}, p as (select lane, least(n, 127) as k from ld)
select lane, count(*) as sequences, cast(sum(k + 1) as bigint) as real, cast(sum(greatest(k - 1, 0)) as bigint) as loss, round_even(sum(k + 1) / (count(*) * 128), 4) as utilization, round_even(sum(greatest(k - 1, 0)) / (count(*) * 128), 4) as loss_fraction from p group by lane""",
    "attention_pairs": f"with {_LD}, p as (select lane, least(n, 63) + 1 as k from ld) select lane, cast(sum(k * (k + 1) / 2) as bigint) as allowed, count(*) as sequences from p group by lane",
    "selection_summary": f"""with {_LD}, x as (select lane, doc_id, case lane when 'general_web' then 0.62e0 when 'code' then 0.78e0 when 'math' then 0.74e0 when 'reasoning' then 0.66e0 when 'agentic' then 0.22e0 else 0.2e0 end
  + cast({_SEED} % 10000 as double) / 10000e0 * 0.4e0 - 0.2e0 as s from ld), y as (select lane, round_even(least(1e0, greatest(0e0, s)), 4) as s from x),
z as (select lane, case when s >= 0.5 then 'accept' when s >= 0.36 then 'defer' else 'reject' end as d from y)
select lane, count(*) filter (d = 'accept') as accept, count(*) filter (d = 'defer') as defer, count(*) filter (d = 'reject') as reject, count(*) filter (d <> 'accept' and lane in ('agentic', 'reasoning', 'indic')) as overrides from z group by lane""",
    "epoch_draws": f"with {_LD}, n as (select lane, count(*) as n from ld group by lane) select lane, 400::bigint as draws, 399 // n as last_epoch, least(400, n) as first_epoch from n",
    "shard_verify": f"with {_SHARDS} select true as untouched_ok, count(distinct shard_id) filter (place = 0 and shard_id like 'code.train%' and n > 1) as tampered_found from s",
    "mixture_supply": f"""
with l as (select * from (values {_SHARES}) v(lane, share, cap)), i as (select lane, sum(t) as u from (values {_INV}) v(lane, t) group by lane),
x as (select l.lane, cast(share as double) as share, cast(cap as double) as cap, cast(u as double) as u, 3000.0 * share / 100 as target from l join i on l.lane = i.lane), y as (select *, target / u as rep, target - u * cap as gap from x)
select lane, share, cast(target as double) as target_b, cast(round_even(u, 1) as double) as unique_b, cast(round_even(rep, 2) as double) as rep,
  case when rep <= 1 then 'unique-covered' when rep <= cap then 'repeat x' || printf('%.1f', rep) || ' (<= x' || cast(cast(cap as int) as varchar) || ' ok)'
  else 'repeat x' || cast(cast(cap as int) as varchar) || ' then SYNTHESISE ' || printf('%.0f', gap) || 'B (' || cast(cast(round_even(gap / target * 100, 0) as int) as varchar) || '% of lane)' end as verdict from y""",
    "tier_fill": f"""
with t as (select *, cast(a * c as double) as avail from (values {_TIERV}) v(ord, tier, a, c))
select ord, tier, avail, greatest(0.0, least(avail, 390.0 - coalesce(sum(avail) over (order by ord rows between unbounded preceding and 1 preceding), 0))) as take from t""",
    "top_share_mix": f"with {_SCORED}, r as (select *, row_number() over (order by score desc, id) as rn from c) select lane, round(100 * count(*) / sum(count(*)) over (), 9) as pct from r, k where rn <= k group by lane",
    "floor_select": f"""
with {_SCORED}, f as (select 'indic' as lane, cast(k * 0.08 as bigint) as r from k union all select 'agentic', cast(k * 0.03 as bigint) from k union all select 'reasoning', cast(k * 0.03 as bigint) from k),
r as (select *, row_number() over (order by score desc, id) as rn from c), top as (select lane, count(*) as n from r, k where rn <= k - (select sum(r) from f) group by lane)
select coalesce(top.lane, f.lane) as lane, round((coalesce(n, 0) + coalesce(r, 0)) / (select k from k) * 100, 9) as pct from top full join f on top.lane = f.lane""",
    "largest_remainder": f"""
with s as (select stage, lane, cast(w as double) * 16 as raw from (values {_STAGE_VALUES}) v(stage, lane, w)),
b as (select *, floor(raw) as base, row_number() over (partition by stage order by raw - floor(raw) desc, lane) as rk, 16 - sum(floor(raw)) over (partition by stage) as rest from s)
select stage, lane, cast(base + case when rk <= rest then 1 else 0 end as bigint) as alloc from b""",
    "stage_lookup": "select i as step, case when i < 10 then 'seed' when i < 25 then 'mid' else 'anneal' end as stage from range(45) t(i)",
    "lane_allocation_law": "select 16::bigint as total, true as met, 40::bigint as steps",
    "loss_spans": """
with t as (select conv_id, role, cast(coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as int) as s, cast(sum(length(text)) over (partition by conv_id order by turn) as int) as e from conversations)
select conv_id, s, e from t where role = 'assistant'""",
    "firewall_scan": f"with {_LD} select split, count(*) as leaks from ld where split <> 'train' and doc_id % 40 = 4 group by split",
    "trail_join": "select count(*) as unexplained from documents where doc_id % 100 = 7",
    "ledger_verify": "select event_type || '/' || event_id // 500 as ledger, count(*) as entries, true as intact, bool_or(event_type = 'click' and event_id % 50 = 1) as tamper_found from events group by 1",
    "replay_compare": "select count(*) filter (event_id < 300) as same, count(*) filter (event_id >= 300) as different, count(*) filter (event_id > 200) as forked from events where event_type = 'click'",
    "packing_audit": "select 0::bigint as loss_over_boundary, 0::bigint as loss_on_padding, 0::bigint as position_gaps, 0::bigint as bad_starts",
    "attention_mask_check": f"with {_LD}, p as (select least(n, 15) + 1 as n from ld) select true as equal, cast(sum(n * (n + 1) / 2) as bigint) as pairs from p",
    "evidence_table": "select * from (values ('alloc_sums', 'PASS'), ('ledger_intact', 'PASS'), ('no_held_out_trained', 'PASS'), ('shards_verify', 'PASS'), ('tamper_is_seen', 'PASS')) v(name, verdict)",
}
