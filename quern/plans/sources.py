"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import shards as S
from quern.operators import vectors as V
from quern.sources import readers as R
from quern.sources import sinks as K
from quern.session import new_path, prepare, table
from quern.streaming import streams as X

LOG = ["[base] done: val 1.1881 · 63,240 tok/s · 5,243.0 MiB peak", "noise", "[rev-2] done: val 1.2 · 13,977 tok/s · 1,069.5 MiB peak", "[x] step 3"]


def html_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(R.strip_noise(F.col("html"))).alias("digest"), F.length(R.strip_noise(F.col("html"))).cast("long").alias("n"))


def html_markdown(spark, sf):
    prepare(spark)
    made = table(spark, sf, "pages").select("page_id", R.tidy_markdown(R.markdown_udf("https://x.org/wiki/", "https://x.org")(F.col("html"))).alias("md"))
    return made.select("page_id", T.count_matches(F.col("md"), r"(?m)^#+ ").alias("headings"), T.count_matches(F.col("md"), r"(?m)^- ").alias("bullets"), T.count_matches(F.col("md"), r"\]\(").alias("links"))


def url_absolute(spark, sf):
    links = spark.createDataFrame([("//a.b/c",), ("./Page",), ("/root",), ("https://x",), ("",)], "link string")
    return links.select("link", R.absolute_url(F.col("link"), "https://x.org/wiki/", "https://x.org").alias("url"))


def run_log(spark, sf):
    return R.parse_run_log(spark.createDataFrame([(x,) for x in LOG], "line string"))


def capped_source(spark, sf):
    return R.capped_fetch(table(spark, sf, "documents"), "text", "doc_id", 20000, part="lang").groupBy("lang").agg(F.count("*").alias("n"))


def byte_splits(spark, sf):
    return R.overflow_split(table(spark, sf, "documents"), "text", "doc_id", 50000, 20000, "lang").groupBy("lang", "split").agg(F.count("*").alias("n"))


def generated_rings(spark, sf):
    return R.rings(spark).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), 6).alias("radius"))


def generated_moons(spark, sf):
    return R.moons(spark).groupBy(F.pmod("id", F.lit(2)).alias("moon"), "label").agg(F.count("*").alias("n"))


def generated_pairs(spark, sf):
    return R.grammar_pairs(spark).groupBy("input", "target").agg(F.count("*").alias("n"))


def neighbour_on_rings(spark, sf):
    p = R.rings(spark).select("id", F.array("x", "y").alias("v"), "label")
    near = V.nearest(p.select("id", "v"), p.select("id", "v"))
    y = p.select("id", "label")
    met = near.join(y, "id").join(y.select(F.col("id").alias("neighbour"), F.col("label").alias("guess")), "neighbour")
    return met.agg(F.count_if(F.col("label") == F.col("guess")).alias("right"), F.count("*").alias("n"))


def sink_round_trip(spark, sf):
    """Shards, ledger and vocabulary written and read again."""
    prepare(spark)
    from quern.operators.mixture import LANES

    shards = S.build_shards(S.lane_documents(table(spark, sf, "documents"), LANES))
    manifests = S.shard_manifests(shards)
    path = new_path(spark, "sinks")
    K.write_shards(shards, manifests, path)
    back = spark.read.parquet(f"{path}/shards")
    name = F.concat_ws("/", "event_type", F.to_date("ts").cast("string"))
    entries = S.chain(table(spark, sf, "events").select(name.alias("ledger"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload")))
    K.write_ledger(entries, f"{path}/ledger")
    ledger = spark.read.schema("seq long, entry_hash string, ledger string, payload string, prev_hash string").json(f"{path}/ledger")
    ok = S.verify_chain(ledger).agg(F.sum("entries").alias("entries"), F.every(F.col("first_bad").isNull()).alias("intact"))
    same = S.verify_shards(back, manifests).agg(F.every("ok").alias("shards_ok"))
    return ok.join(same).join(K.index(manifests).select("shards"))


def _stream(spark, sf):
    spark.conf.set("spark.sql.streaming.schemaInference", "false")
    return X.events(spark, f"{sf}/events.parque[t]"), new_path(spark, "stream")


def _finished(spark, stream, path, mode):
    X.run_idempotent(stream, f"{path}/out", f"{path}/check", mode)
    return spark.read.parquet(f"{path}/out").drop("batch")


def stream_tumbling(spark, sf):
    stream, path = _stream(spark, sf)
    out = _finished(spark, X.tumbling(stream), path, "complete")
    return out.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, sf):
    stream, path = _stream(spark, sf)
    out = _finished(spark, X.sessions(stream), path, "complete")
    return out.select("user_id", "start", "n").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


def stream_dedup(spark, sf):
    stream, path = _stream(spark, sf)
    out = _finished(spark, X.deduplicated(stream, ["user_id", "event_type"], "100 days"), path, "append")
    return out.agg(F.count("*").alias("n"))


def stream_ema(spark, sf):
    prepare(spark)
    stream, path = _stream(spark, sf)
    out = _finished(spark, X.ema_alarms(stream, z=2.0), path, "append")
    return out.select("event_type", "event_id")


_FRAMES = (
    html_clean, html_markdown, url_absolute, run_log, capped_source, byte_splits, generated_rings, generated_moons, generated_pairs, neighbour_on_rings, sink_round_trip,
    stream_tumbling, stream_sessions, stream_dedup, stream_ema,
)
QUERIES = {f.__name__: f for f in _FRAMES}
_NOISE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?is)<(meta|link)\b[^>]*>', '', 'g')"""
ORACLES = {
    "html_clean": f"select page_id, md5({_NOISE}) as digest, length({_NOISE}) as n from pages",
    "url_absolute": "select * from (values ('//a.b/c', 'https://a.b/c'), ('./Page', 'https://x.org/wiki/Page'), ('/root', 'https://x.org/root'), ('https://x', 'https://x'), ('', '')) v(link, url)",
    "run_log": "select * from (values ('base', 1.1881e0, 63240e0, 5243e0), ('rev-2', 1.2e0, 13977e0, 1069.5e0)) v(tag, val, tokens_per_second, peak_mib)",
    "capped_source": """with d as (select lang, coalesce(sum(strlen(text)) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as b from documents where length(text) >= 200) select lang, count(*) as n from d where b < 20000 group by lang""",
    "byte_splits": """with d as (select lang, coalesce(sum(strlen(text)) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as b from documents) select lang, case when b < 50000 then 'train' else 'eval' end as split, count(*) as n from d where b < 70000 group by 1, 2""",
    "stream_tumbling": "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_sessions": """with g as (select user_id, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)) select user_id, cast(sum(fresh) as bigint) as sessions, count(*) as n from g group by user_id""",
    "stream_dedup": "select count(distinct (user_id, event_type)) as n from events",
}
