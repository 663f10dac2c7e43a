"""Queries over tokenizers, vocabularies and vectors, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import hashing, scripts, text as T
from quern.operators import tokenize as K
from quern.operators import vectors as V
from quern.plans.dialect import both
from quern.session import materialise, prepare, spread, table

MERGES = 300
DIMS = 64  # coordinates of an embedding


def _counts(spark, sf):
    """Every distinct word of each language, counted once: merge loops and fertility see the same words."""
    prepare(spark)
    return materialise(K.word_counts(spread(table(spark, sf, "documents"))), "word-counts")


def _vocabulary(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(T.nonspace_runs(F.col("text"))).alias("token")).distinct()
    extra = spark.createDataFrame([("நிறுவனங்களுக்கும்",), ("நிறுவனங்களுக்கிடையே",), ("привет",), ("aпб",), ("12.5",), ("▁the",), ("हिन्दी",)], "token string")
    return words.unionByName(extra).distinct().withColumn("token_id", F.xxhash64("token"))


def pair_counts(spark, sf):
    return K.pair_counts(K.word_counts(table(spark, sf, "documents")))


def alphabet(spark, sf):
    return K.alphabet(K.word_counts(table(spark, sf, "documents"), pieces=T.nonspace_runs))


def top_words(spark, sf):
    return K.word_counts(table(spark, sf, "documents"), pieces=T.nonspace_runs, keep=50)


def bpe_fertility(spark, sf):
    counts = _counts(spark, sf)
    return K.parity(K.fertility(counts, K.train_bpe(counts, MERGES)))


def bpe_parity_fertility(spark, sf):
    counts = _counts(spark, sf)
    return K.parity(K.fertility(counts, K.train_parity(counts, MERGES, ("en", 50))))


def bpe_disjoint_fertility(spark, sf):
    counts = _counts(spark, sf)
    return K.parity(K.fertility(counts, K.train_disjoint(counts, {"en": 100, "de": 100, "fr": 100, "es": 100})))


def bpe_reclaimed_fertility(spark, sf):
    counts = _counts(spark, sf)
    return K.parity(K.fertility(counts, K.reclaim_words(counts, K.train_bpe(counts, 100), rounds=5, per_round=20)))


def bpe_water_fill(spark, sf):
    return spark.createDataFrame(sorted(K.water_fill(_counts(spark, sf), 600).items()), "lang string, budget long")


def bpe_grid(spark, sf):
    return spark.createDataFrame(K.grid(_counts(spark, sf), [{}, {"de": 3}, {"fr": 3}], 100))


def bpe_bytes_fertility(spark, sf):
    counts = _counts(spark, sf)
    raw = counts.select("lang", F.decode(F.encode("word", "UTF-8"), "ISO-8859-1").alias("word"), "freq")
    return K.fertility(raw, K.train_bytes(counts, MERGES))


def vocabulary_sweep(spark, sf):
    """Merges learnt from nine tenths of the documents, fertility on all words of the other tenth."""
    prepare(spark)
    docs = spread(table(spark, sf, "documents"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))
    learnt, other = (materialise(K.word_counts(docs.where(w)), "word-counts") for w in (~held, held))
    return K.sweep(learnt, [100, 200, 300], held_out=other)


def bpe_round_trip(spark, sf):
    prepare(spark)
    probes = spark.createDataFrame([(-1, "https://x.org/हिन्दी?q=1"), (-2, "1,234,567.89"), (-3, "([{<>}])"), (-4, "| a | b |\n|---|---|")], "doc_id long, text string")
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(probes)
    return K.round_trip(docs, [("t", "h"), ("th", "e"), ("▁", "a")]).agg(F.count("*").alias("texts"), F.count_if("ok").alias("kept"))


def script_census(spark, sf):
    return V.census(_vocabulary(spark, sf))


def script_truncation(spark, sf):
    return V.truncated(_vocabulary(spark, sf), (8, 16, 32))


def script_collisions(spark, sf):
    return V.collisions(_vocabulary(spark, sf), 8)


def indic_collision_share(spark, sf):
    return V.indic_share(V.collisions(_vocabulary(spark, sf), 32))


def code_separation(spark, sf):
    """Cosines of related and unrelated tokens for each byte code."""
    vocabulary = _vocabulary(spark, sf)
    related = materialise(V.prefix_pairs(vocabulary), "related")
    other = materialise(V.unrelated_pairs(vocabulary, related.count()), "unrelated")
    used = related.unionByName(other).select(F.explode(F.array("a", "b")).alias("token_id")).distinct()
    tokens = materialise(vocabulary.join(used, "token_id", "left_semi"), "tokens")
    out = None
    for kind in ("onehot", "fourier", "random", "relative"):
        codes = V.byte_codes(tokens, kind, 16)
        a, b = (V.code_cosine(codes, p).agg(F.avg("cosine").alias(n)) for p, n in ((related, "related"), (other, "unrelated")))
        one = a.join(b).select(F.lit(kind).alias("code"), F.round("related", 6).alias("related"), F.round("unrelated", 6).alias("unrelated"), F.round(F.col("related") - F.col("unrelated"), 6).alias("gap"))
        out = one if out is None else out.unionByName(one)
    return out


def cluster_separation(spark, sf):
    tokens = _vocabulary(spark, sf)
    keyed = tokens.select("token_id", "token", scripts.byte_prefix(F.col("token"), 10).alias("cluster"))
    pair = keyed.groupBy("cluster").agg(F.min("token_id").alias("a"), F.max("token_id").alias("b")).where("a <> b")
    used = tokens.join(pair.select(F.explode(F.array("a", "b")).alias("token_id")).distinct(), "token_id", "left_semi")
    return V.separation(V.code_cosine(V.byte_codes(used, "onehot", 32), pair.select("a", "b")), pair).select(F.round("least", 6).alias("least"), F.round("median", 6).alias("median"), "colliding")


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def nearest_neighbour(spark, sf):
    p = _points(spark, sf).select("id", "v")
    return V.nearest(p.where("id % 100 = 0"), p).select("id", "neighbour", F.round("distance", 5).alias("distance"))


def neighbour_accuracy(spark, sf):
    p = _points(spark, sf)
    near = V.nearest(p.where("id % 100 = 0").select("id", "v"), p.select("id", "v"))
    y = p.select("id", "label")
    both_ = near.join(y, "id").join(y.select(F.col("id").alias("neighbour"), F.col("label").alias("guess")), "neighbour")
    return both_.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("guess")).cast("int")), 9).alias("accuracy"))


def cosine_to_first(spark, sf):
    p = _points(spark, sf)
    first = p.where("id = 0").select(F.col("v").alias("w"))
    return p.join(F.broadcast(first)).select("id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


def covariance(spark, sf):
    return V.covariance(_points(spark, sf), DIMS).select("i", "j", F.round("cov", 9).alias("cov"))


def principal_axes(spark, sf):
    p = _points(spark, sf)
    return V.project(p, V.principal_axes(V.covariance(p, DIMS), DIMS)).agg(F.round(F.var_pop("pc0"), 6).alias("v0"), F.round(F.var_pop("pc1"), 6).alias("v1"), F.round(F.abs(F.corr("pc0", "pc1")), 4).alias("r"))


def id_hashes(spark, sf):
    prepare(spark)
    ids = F.transform(F.sequence(F.lit(0), F.pmod("doc_id", F.lit(7))), lambda i: (i * 1000 + F.col("doc_id")).cast("int"))
    payload = F.concat(F.lit('{"b": "'), F.col("lang"), F.lit('", "a": '), F.col("doc_id").cast("string"), F.lit("}"))
    return table(spark, sf, "documents").select("doc_id", hashing.ids_sha256(ids).alias("ids_sha256"), hashing.canonical_sha256(payload).alias("canonical"), hashing.seed63(F.col("lang")).alias("seed"), hashing.md5_uint32(F.col("lang")).alias("h32"))


def corpus_hash(spark, sf):
    prepare(spark)
    return hashing.corpus_sha256(table(spark, sf, "documents"), "text", "doc_id")


_SQL = [
    both("unigram_entropy", """
with t as (select doc_id, count(*) as c from documents group by doc_id), w as (select user_id as tok, count(*) as n from events group by user_id), p as (select n / sum(n) over () as p from w)
select round(-sum(p * ln(p)), 9) as entropy, round(exp(-sum(p * ln(p))), 6) as perplexity, round(ln(count(*)), 9) as uniform from p"""),
    both("coverage_after_cap", """
with w as (select user_id as tok, count(*) as n from events group by user_id), r as (select *, row_number() over (order by n desc, tok) as rk from w)
select round(sum(case when rk <= 50 then n else 0 end) / sum(n), 9) as covered, cast(sum(n) as bigint) as total from r"""),
    both("softmax_gradient", """
with z as (select label, avg(vec_id) / 100 as logit from embeddings group by label), e as (select label, exp(logit - max(logit) over ()) as e, logit from z), p as (select label, e / sum(e) over () as p from e)
select label, round(p, 9) as p, round(-ln(p), 9) as loss, round(p - case when label = 3 then 1 else 0 end, 9) as gradient from p"""),
    both("accuracy_gap", """
with p as (select vec_id, label % 2 as y, case when vec_id % 3 = 0 then 1 - label % 2 else label % 2 end as guess, vec_id % 5 = 0 as test from embeddings)
select round(avg(case when not test then cast(guess = y as int) end), 9) as train, round(avg(case when test then cast(guess = y as int) end), 9) as held_out,
  round(avg(case when not test then cast(guess = y as int) end) - avg(case when test then cast(guess = y as int) end), 9) as gap from p"""),
]
_FRAMES = (
    pair_counts, alphabet, top_words, bpe_fertility, bpe_parity_fertility, bpe_disjoint_fertility, bpe_reclaimed_fertility, bpe_water_fill, bpe_grid, bpe_bytes_fertility, vocabulary_sweep,
    bpe_round_trip, script_census, script_truncation, script_collisions, indic_collision_share, code_separation, cluster_separation, nearest_neighbour, neighbour_accuracy,
    cosine_to_first, covariance, principal_axes, id_hashes, corpus_hash,
)
QUERIES = {f.__name__: f for f in _FRAMES} | {n: f for n, f, _ in _SQL}
_VOCAB = """v as (select distinct token from (select unnest(regexp_extract_all(text, '\\S+')) as token from documents union all
  select unnest(['நிறுவனங்களுக்கும்', 'நிறுவனங்களுக்கிடையே', 'привет', 'aпб', '12.5', '▁the', 'हिन्दी'])))"""
_SCRIPT = """s as (select token, case when length(t) = 0 then 'Symbol' when regexp_matches(t, '^[ -ɏ]+$') then 'Latin' when regexp_matches(t, '^[Ѐ-ӿ]+$') then 'Cyrillic'
  when regexp_matches(t, '^[ऀ-ॿ]+$') then 'Devanagari' when regexp_matches(t, '^[஀-௿]+$') then 'Tamil' when len(regexp_extract_all(t, '[Ѐ-ӿ]')) * 2 > length(t) then 'Cyrillic' else 'Latin' end as script
  from (select token, regexp_replace(token, '[\\p{P}\\p{N}\\p{Z}\\p{C}▁]', '', 'g') as t from v))"""
_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
_NN = f"with d as (select a.vec_id as id, b.vec_id as neighbour, {_D2} as d from embeddings a, embeddings b where a.vec_id % {{0}} = 0 and a.vec_id <> b.vec_id), n as (select id, arg_min(neighbour, struct_pack(d := d, n := neighbour)) as neighbour, min(d) as d from d group by id)"
ORACLES = {n: q for n, _, q in _SQL} | {
    "pair_counts": """
with p as (select lang, unnest(regexp_extract_all(replace(text, ' ', '▁'), '▁?[^▁]+|▁')) as word from documents), w as (select lang, word, count(*) as freq, string_split(word, '') as c from p group by lang, word),
x as (select lang, freq, c, unnest(range(1, len(c))) as i from w where len(c) > 1) select lang, c[i] as "left", c[i + 1] as "right", cast(sum(freq) as bigint) as n from x group by all""",
    "alphabet": "select distinct unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) as \"char\" from documents",
    "top_words": """with w as (select lang, unnest(regexp_extract_all(text, '\\S+')) as word from documents), n as (select lang, word, count(*) as freq from w group by all),
r as (select *, row_number() over (partition by lang order by freq desc, word) as k from n) select lang, word, freq from r where k <= 50""",
    "bpe_round_trip": "select count(*) + 4 as texts, count(*) + 4 as kept from documents",
    "script_census": f"with {_VOCAB}, {_SCRIPT} select script, count(*) as tokens, round_even(avg(strlen(token)), 2) as mean_bytes, cast(max(strlen(token)) as bigint) as max_bytes from s group by script",
    "nearest_neighbour": _NN.format(100) + " select id, neighbour, round(d, 5) as distance from n",
    "neighbour_accuracy": _NN.format(100) + " select count(*) as n, round(avg(cast(x.label = y.label as int)), 9) as accuracy from n join embeddings x on x.vec_id = n.id join embeddings y on y.vec_id = n.neighbour",
    "cosine_to_first": "select a.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a, embeddings b where b.vec_id = 0",
    "covariance": "select cast(i as int) as i, cast(j as int) as j, round(covar_pop(embedding[i + 1]::double, embedding[j + 1]::double), 9) as cov from embeddings, range(64) a(i), range(64) b(j) group by i, j",
    "corpus_hash": "select sha256(string_agg(text, chr(10) order by doc_id)) as sha256, count(*) as n from documents",
}
