"""Host-level quality rules (operator 8).

Each document is measured whole; rule failures are summed per host (`source`); host rates are shrunk with a beta prior
fitted to all hosts by the method of moments; a host whose shrunk rate passes a bound takes its documents with it.

Defined cases: null text has no words and fails; a null host is a host of its own; empty tables give empty results;
very long texts are measured whole; repeated rows are measured one by one; other columns pass through untouched, whatever
their names. A document fails by itself if it fails the base rules or has more than MAX_SYMBOL_PERCENT symbols.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import worker
from quern.session import materialise, prepare, salted_left_join, table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_HOST_RATE = 0.5

_WHITE = bytes([0x20, *range(0x09, 0x0E)])
_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text. Words are runs of other characters than
    ASCII white space, which is what bytes.split() finds."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeats += i + 3 - max(i, end)
                    end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def _measured(batches):
    worker.begin(__name__)
    for b in batches:
        rows = [measure(t) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * 5
        arrays = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(c, pa.int64()) for c in cols]
        names = [b.schema.field(i).name for i in range(b.num_columns - 1)] + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def measures(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, host and the five measures."""
    src = docs.select(*keys, F.col("source").alias("host"), F.col("text").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(_measured, f"{kinds}, {_MEASURES}")


def flag(m: DataFrame) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    junk = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")
    return m.withColumn("base_failed", base).withColumn("failed", base | junk)


def host_rates(flagged: DataFrame) -> DataFrame:
    """host_key, documents, failures and the shrunk rate. Partial sums leave each task, so a hot host costs one row a task.

    The prior: mean and variance of host rates, hosts weighing the same, give alpha + beta = mean (1 - mean) / variance - 1,
    held between 2 and 1000; with no spread it is 1000, with one host or none at all 2."""
    hosts = flagged.groupBy(F.coalesce("host", F.lit("\u0000")).alias("host_key")).agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("fails"))
    prior = hosts.agg(F.avg(F.col("fails") / F.col("docs")).alias("mean"), F.var_pop(F.col("fails") / F.col("docs")).alias("var"), F.count("*").alias("n"))
    strength = F.when(F.col("n") < 2, 2.0).when(F.col("var") <= 0, 1000.0).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1)))
    prior = prior.select("mean", strength.alias("strength"))
    return hosts.join(F.broadcast(prior)).select(
        "host_key", "docs", "fails", ((F.col("fails") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))).alias("host_rate")
    )


def judge(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, host, measures, base_failed, failed, host_rate and kept of every document.

    A document is kept if it fails no rule itself and its host's shrunk failure rate is at most MAX_HOST_RATE."""
    flagged = flag(materialise(measures(docs, keys), "quality"))
    rates = host_rates(flagged).select("host_key", "host_rate")
    joined = salted_left_join(flagged.withColumn("host_key", F.coalesce("host", F.lit("\u0000"))), rates, "host_key", keys[0])
    return joined.withColumn("kept", ~F.col("failed") & (F.col("host_rate") <= MAX_HOST_RATE)).drop("host_key")


def _sound(batches):
    worker.begin(__name__)
    for b in batches:
        rows = [measure(t) for t in b.column("text").to_pylist()]
        yield b.filter(pa.array([not failed(*r) for r in rows], pa.bool_()))


def failed(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int) -> bool:
    """The rules of flag() on one row."""
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words or 100 * n_symbols > MAX_SYMBOL_PERCENT * word_chars


def keep_sound(docs: DataFrame) -> DataFrame:
    """The rows that judge() keeps, with all their columns. Rejected hosts are written first, so that Spark knows their
    size and sends them to all tasks only when they are few; texts then stay where they were read."""
    key = "host"
    while key in docs.columns:
        key += "_"
    rates = host_rates(flag(measures(docs, [])))
    rejected = materialise(rates.where(F.col("host_rate") > MAX_HOST_RATE).select(F.col("host_key").alias(key)), "rejected-hosts")
    sound = docs.mapInArrow(_sound, docs.schema).withColumn(key, F.coalesce("source", F.lit("\u0000")))
    return sound.join(rejected, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and the verdict of the rules and its host."""
    out = judge(table(prepare(spark), sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


QUERIES = {"op8_host_rules": op8_host_rules}
ORACLES = {
    "op8_host_rules": r"""
with d as (
  select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents
), g as (select doc_id, i, count(*) over (partition by doc_id, g) as n from (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as g from d where len(w) >= 3)),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by doc_id),
m as (
  select d.doc_id, host, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(r.n_repeat_words, 0) as n_repeat_words from d left join r on r.doc_id = d.doc_id
), f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 100 * n_symbols > 10 * word_chars as junk from m),
h as (select host, count(*) as docs, sum(cast(base_failed or junk as int)) as fails from f group by host),
p as (select avg(fails / docs) as mean, var_pop(fails / docs) as var, count(*) as n from h),
s as (select mean, case when n < 2 then 2.0 when var <= 0 then 1000.0 else least(1000.0, greatest(2.0, mean * (1 - mean) / var - 1)) end as strength from p),
k as (select host, (fails + mean * strength) / (docs + strength) as rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or junk) and rate <= 0.5 as kept, round(rate, 9) as host_rate from f join k using (host)"""
}
