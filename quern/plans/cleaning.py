"""Queries over documents, conversations, pages and benchmark, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import hashing, text as T
from quern.operators import cleaning as C
from quern.session import materialise, prepare, spread, table

#: Texts that meet rules which the tables don't.
LITERALS = [
    (-1, "  a \t b  \n\n\n\n c \n \n \n d  "), (-2, "क​‍a\u0007‮ q"), (-3, "क‍ष a‍b x​y\r\nz"), (-4, "@some_handle hi"),
    (-5, "mail a.b+c@x-y.co.uk ip 10.0.0.256 10.0.0.25 +1 (212) 555-1234 2125551234"), (-6, "- a\n- b\n* c\nd"), (-7, "one...\ntwo...\nthree"),
    (-8, "{}[]{}[] <> || ##"), (-9, "Привет мир это просто текст"), (-10, "12345 67"), (-11, ""), (-12, "one two three four"),
]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return C.as_documents(spread(table(spark, sf, "documents")))


def with_literals(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).unionByName(C.as_documents(spark.createDataFrame(LITERALS, "doc_id long, text string")))


def clean_funnel(spark, sf):
    docs = documents(spark, sf).withColumn("text", T.normalise_builtin(F.col("text")))
    language = T.language_profile(F.substring("text", 1, 2000)).isin(C.KEPT_LANGUAGES)
    quality = F.size(T.quality_reasons(F.col("text"))) == 0
    return C.loss_percent(C.funnel(docs, [("normalise", F.lit(True)), ("language", language), ("quality", quality)]))


def quality_by_reason(spark, sf):
    return C.with_reasons(with_literals(spark, sf)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def quality_reasons(spark, sf):
    return C.with_reasons(with_literals(spark, sf)).select("doc_id", F.concat_ws(",", "reasons").alias("reasons"))


def language_profile(spark, sf):
    return C.with_language(with_literals(spark, sf)).groupBy("language").agg(F.count("*").alias("n"))


def normalise_counts(spark, sf):
    c = T.normalise_counts(F.col("text"))
    out = with_literals(spark, sf).select("doc_id", *(x.alias(k) for k, x in c.items()), F.length("text").alias("before"), F.length(T.normalise_builtin(F.col("text"))).alias("after"))
    sums = [F.sum(k).cast("long").alias(k) for k in c]
    return out.agg(*sums, F.count_if(F.col("before") != F.col("after")).alias("docs_changed"), F.sum(F.greatest(F.lit(0), F.col("before") - F.col("after"))).cast("long").alias("chars_removed"))


def normalise_space(spark, sf):
    return with_literals(spark, sf).select("doc_id", T.normalise_builtin(F.col("text")).alias("text")).where("doc_id in (-1, -12) or doc_id >= 0").select("doc_id", F.md5("text").alias("digest"))


def html_entities(spark, sf):
    """References that end with a semicolon, as in its SQL; normalise() also takes those without, as browsers do."""
    prepare(spark)
    return table(spark, sf, "pages").select("page_id", F.md5(T.nfc(T.unescape_closed_html(F.col("html")))).alias("digest"))


def pii_counts(spark, sf):
    out = C.redact(with_literals(spark, sf))
    kinds = [f"n_{k}" for k, _ in T.PII_PATTERNS]
    return out.agg(*(F.sum(k).cast("long").alias(k) for k in kinds), F.count_if(F.expr(" + ".join(kinds)) > 0).alias("docs_redacted"))


def pii_redacted(spark, sf):
    found = F.expr(" + ".join(f"n_{k}" for k, _ in T.PII_PATTERNS)) > 0
    return C.redact(with_literals(spark, sf)).where(found).select("doc_id", F.md5("text").alias("digest"))


def exact_dedup(spark, sf):
    return C.exact_first(table(spark, sf, "documents"), ["doc_id"]).select("doc_id")


def dedup_clusters(spark, sf):
    docs = spread(table(prepare(spark), sf, "documents"))
    sizes = C.clusters(docs).groupBy("root").agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n") > 1).alias("clusters"), F.sum(F.col("n") - 1).cast("long").alias("removed"), F.max("n").alias("largest"))


def dedup_roots(spark, sf):
    return C.clusters(spread(table(prepare(spark), sf, "documents")))


def minhash_small(spark, sf):
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(hashing.permutations(8))], "i int, a long, b long")
    hashes = table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.explode(C.shingle_hashes(F.col("text"))).alias("h"))
    value = F.min((F.col("a") * (F.col("h") % hashing.PRIME) + F.col("b")) % hashing.PRIME)
    return hashes.join(F.broadcast(pairs)).groupBy("doc_id", "i").agg(value.alias("h"))


def shingle_stats(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.size(T.word_shingles(F.col("text"))).cast("long").alias("shingles"), F.size(T.word_ngrams(F.col("text"))).cast("long").alias("grams"))


def decontam_hits(spark, sf):
    grams = C.benchmark_grams(table(spark, sf, "benchmark"), F.concat(F.lit("b"), F.pmod("item_id", F.lit(3))))
    return C.contaminated(spread(table(spark, sf, "documents")), grams).select("doc_id", "shared", "name")


def decontam_by_benchmark(spark, sf):
    return decontam_hits(spark, sf).groupBy("name").agg(F.count("*").alias("n"))


def first_turns(spark, sf):
    return C.first_of_role(table(spark, sf, "conversations"))


def boilerplate(spark, sf):
    roles = C.first_of_role(table(spark, sf, "conversations"))
    return roles.groupBy(F.md5("system").alias("digest")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("kinds"))


TRACES = [
    ("solve it", "<|begin_of_thought|> think <|end_of_thought|>x<|begin_of_solution|> 42 <|end_of_solution|>"),
    ("half", "<|begin_of_thought|>only thought<|end_of_thought|> rest"), ("none", " plain answer "), ("empty", ""),
]


def trace_extract(spark, sf):
    made = spark.createDataFrame(TRACES, "problem string, answer string")
    own = C.first_of_role(table(spark, sf, "conversations")).select("problem", "answer")
    return C.extract(made.unionByName(own)).select("problem", "text", F.concat_ws(",", "flags").alias("flags"), "markers")


def corpus_manifest(spark, sf):
    return C.manifest(documents(prepare(spark), sf)).drop("steps")


def full_cleaning(spark, sf):
    """All seven stages, each one's survivors counted. Texts are read twice: to normalise, judge and redact, and for the
    words that near copies and benchmark passages are found by."""
    prepare(spark)
    seen = materialise(C.judged(documents(spark, sf)), "clean-judged")
    good = seen.where("kept")
    marks = C.marks(good.select("doc_id", "text"), C.benchmark_grams(table(spark, sf, "benchmark"), F.lit("benchmark")))
    copies = C.clusters(good, edges=C.edges_of(marks)).where("doc_id <> root").select("doc_id", F.lit(True).alias("copy")).distinct()
    told = marks.groupBy("doc_id").agg((F.sum("shared") >= C.MIN_SHARED_NGRAMS).alias("told"))
    rows = seen.select("doc_id", "words", "kept", "safe_words").join(copies, "doc_id", "left").join(told, "doc_id", "left")
    unique = F.col("kept") & F.col("copy").isNull()
    stages = [("normalise", F.lit(True), "words"), ("quality", F.col("kept"), "words"), ("dedup", unique, "words"), ("pii", unique, "safe_words"), ("decontam", unique & ~F.coalesce("told", F.lit(False)), "safe_words")]
    return C.tally(rows, stages)


def label_agreement(spark, sf):
    verdict = C.with_reasons(documents(spark, sf)).select("doc_id", (F.size("reasons") == 0).cast("int").alias("kept"))
    return verdict.join(table(spark, sf, "labels"), "doc_id").groupBy("quality", "kept").agg(F.count("*").alias("n"))


def token_units(spark, sf):
    t = F.col("text")
    count = lambda pattern, c=t: T.count_matches(c, pattern)
    return spread(table(spark, sf, "documents")).select(
        "doc_id", T.faithful_units(t).alias("units"), T.word_count(t).cast("long").alias("split_words"), count(r"(?U)\S+").alias("runs"),
        count(r"(?U)\w+", F.lower(t)).alias("word_runs"), count("▁?[^▁]+|▁", F.replace(t, F.lit(" "), F.lit("▁"))).alias("pieces"), count(r"(?U)\s*\S+|\s+").alias("pretokens"),
        F.length(T.visible(t)).cast("long").alias("visible"), T.symbol_count(t).cast("long").alias("symbols"), F.md5(T.snippet(t)).alias("head"),
        T.unspaced(F.length(t), T.word_count(t)).alias("unspaced"),
    )


_VALUES = ", ".join("(%d, '%s')" % (i, t.replace("'", "''")) for i, t in LITERALS)
_DOCS = f"select doc_id, text from documents union all select * from (values {_VALUES}) v(doc_id, text)"
_STOP = ", ".join(f"'{w}'" for w in T.ENGLISH_STOPWORDS)
_REASONS = f"""
with d as ({_DOCS}), m as (
  select doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as wc,
    length(text) - length(translate(text, '#{{}}[]<>|', '')) as sym,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) as ln from d
), r as (
  select doc_id, list_filter([
    case when wc < 20 then 'too_short' end, case when wc > 0 and sym / wc > 0.5 then 'symbol_heavy' end,
    case when len(ln) > 0 and len(list_filter(ln, lambda x: regexp_matches(x, '^\\s*[-*•·]'))) / len(ln) > 0.6 then 'bullet_wall' end,
    case when len(ln) > 0 and len(list_filter(ln, lambda x: regexp_matches(x, '\\.\\.\\.\\s*$'))) / len(ln) > 0.3 then 'ellipsis_heavy' end,
    case when len(ln) > 0 and 1 - len(list_distinct(ln)) / len(ln) > 0.3 then 'repeated_lines' end], lambda x: x is not null) as reasons from m
)"""
_LANG = f"""
d as ({_DOCS}), p as (select doc_id, substring(text, 1, 2000) as t from d), m as (
  select doc_id, len(regexp_extract_all(t, '\\p{{L}}')) as letters, len(regexp_extract_all(t, '\\p{{Latin}}')) as latin,
    regexp_extract_all(lower(t), '[a-zA-Z]+') as w from p
), lang as (
  select doc_id, case when letters = 0 then 'nonlingual'
    when latin / letters > 0.6 and (len(list_filter(w, lambda x: x in ({_STOP}))) / greatest(1, len(w)) > 0.03 or len(w) < 30) then 'en'
    when latin / letters <= 0.6 then 'non-latin' else 'latin-other' end as language from m
)"""
_NORM = r"""trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: rtrim(x)), chr(10)), ' ' || chr(10))"""
_GRAMS = r"""list_distinct(case when len(w) >= 13 then list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) else [] end)"""
_RUNS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')"
_SHINGLES = "list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)"
_DECONTAM = rf"""
with b as (select 'b' || (item_id % 3) as name, {_RUNS} as w from benchmark), bg as (select name, unnest({_GRAMS}) as gram from b),
bi as (select gram, min(name) as name from (select *, string_split(gram, ' ') as t from bg)
  where len(list_filter(t, lambda x: regexp_matches(x, '^\p{{Nd}}+$') or length(x) <= 1)) / len(t) < 0.5
    and len(list_distinct(list_filter(t, lambda x: not regexp_matches(x, '^\p{{Nd}}+$') and length(x) > 1))) >= 6 group by gram),
d as (select doc_id, {_RUNS} as w from documents), dg as (select doc_id, unnest({_GRAMS}) as gram from d),
hits as (select doc_id, count(*) as shared, min(name) as name from dg join bi using (gram) group by doc_id having count(*) >= 2)"""
_ROLES = """select conv_id, coalesce(min_by(text, turn) filter (role = 'system'), '') as system, coalesce(min_by(text, turn) filter (role = 'user'), '') as problem,
  coalesce(min_by(text, turn) filter (role = 'assistant'), '') as answer from conversations group by conv_id"""
_TRACES = ", ".join("('%s', '%s')" % t for t in TRACES)
_B1, _E1, _B2, _E2 = (m.replace("|", r"\|") for m in T.TRACE_MARKERS)
_WC = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"

QUERIES = {
    f.__name__: f
    for f in (
        clean_funnel, quality_by_reason, quality_reasons, language_profile, normalise_counts, normalise_space, html_entities, pii_counts, pii_redacted, exact_dedup,
        dedup_clusters, dedup_roots, minhash_small, shingle_stats, decontam_hits, decontam_by_benchmark, first_turns, boilerplate, trace_extract, corpus_manifest,
        full_cleaning, label_agreement, token_units,
    )
}
ORACLES = {
    "quality_by_reason": _REASONS + " select reason, count(*) as n from (select unnest(reasons) as reason from r) group by reason",
    "quality_reasons": _REASONS + " select doc_id, array_to_string(reasons, ',') as reasons from r",
    "language_profile": "with " + _LANG + " select language, count(*) as n from lang group by language",
    "clean_funnel": f"""
with n as (select doc_id, {_NORM} as text from documents), d as (select * from n), p as (select doc_id, text, substring(text, 1, 2000) as t from d),
m as (select doc_id, text, len(regexp_extract_all(t, '\\p{{L}}')) as letters, len(regexp_extract_all(t, '\\p{{Latin}}')) as latin, regexp_extract_all(lower(t), '[a-zA-Z]+') as w from p),
lang as (select doc_id, text from m where letters = 0 or (latin / letters > 0.6 and (len(list_filter(w, lambda x: x in ({_STOP}))) / greatest(1, len(w)) > 0.03 or len(w) < 30))),
q as (select doc_id, text, {_WC} as wc, length(text) - length(translate(text, '#{{}}[]<>|', '')) as sym, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) as ln from lang),
good as (select doc_id, text from q where not (wc < 20 or (wc > 0 and sym / wc > 0.5) or (len(ln) > 0 and (
  len(list_filter(ln, lambda x: regexp_matches(x, '^\\s*[-*•·]'))) / len(ln) > 0.6 or len(list_filter(ln, lambda x: regexp_matches(x, '\\.\\.\\.\\s*$'))) / len(ln) > 0.3 or 1 - len(list_distinct(ln)) / len(ln) > 0.3)))),
line as (select 0 as stage_ord, 'normalise' as stage, count(*) as rows, cast(sum({_WC}) as bigint) as tokens from n union all
  select 1, 'language', count(*), cast(coalesce(sum({_WC}), 0) as bigint) from lang union all select 2, 'quality', count(*), cast(coalesce(sum({_WC}), 0) as bigint) from good)
select stage_ord, stage, rows, tokens, round(100 * (first_value(rows) over (order by stage_ord) - rows) / first_value(rows) over (order by stage_ord), 2) as rows_lost_pct,
  round(100 * (first_value(tokens) over (order by stage_ord) - tokens) / first_value(tokens) over (order by stage_ord), 2) as tokens_lost_pct from line""",
    "normalise_space": f"with d as ({_DOCS}) select doc_id, md5({_NORM}) as digest from d where doc_id in (-1, -12) or doc_id >= 0",
    "html_entities": """select page_id, md5(nfc_normalize(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'))) as digest from pages""",
    "exact_dedup": "select min(doc_id) as doc_id from documents group by text",
    "minhash_small": f"""
with w as (select doc_id, {_RUNS} as w from documents where length(text) > 0), s as (select doc_id, unnest({_SHINGLES}) as s from w),
h as (select distinct doc_id, ('0x' || substr(md5(s), 1, 8))::bigint as h from s),
p as (select * from (values {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(hashing.permutations(8)))}) v(i, a, b))
select doc_id, i, min((a * (h % {hashing.PRIME}) + b) % {hashing.PRIME}) as h from h, p group by doc_id, i""",
    "shingle_stats": f"with w as (select doc_id, {_RUNS} as w from documents) select doc_id, len({_SHINGLES}) as shingles, len({_GRAMS}) as grams from w",
    "decontam_hits": _DECONTAM + " select doc_id, shared, name from hits",
    "decontam_by_benchmark": _DECONTAM + " select name, count(*) as n from hits group by name",
    "first_turns": _ROLES,
    "boilerplate": f"select max(n) as most, count(*) as kinds from (select md5(system) as digest, count(*) as n from ({_ROLES}) group by 1)",
    "trace_extract": rf"""
with t as (select * from (values {_TRACES}) v(problem, answer) union all select problem, answer from ({_ROLES})), x as (
  select *, trim(regexp_extract(answer, '(?s){_B1}(.*?){_E1}', 1), ' ' || chr(10)) as th, trim(regexp_extract(answer, '(?s){_B2}(.*?){_E2}', 1), ' ' || chr(10)) as so,
    regexp_matches(answer, '(?s){_B1}.*?{_E1}') and regexp_matches(answer, '(?s){_B2}.*?{_E2}') as ok, regexp_replace(answer, '{_B1}|{_E1}|{_B2}|{_E2}', '', 'g') as bare,
    len(regexp_extract_all(answer, '{_B1}|{_E1}|{_B2}|{_E2}')) as markers from t)
select problem, trim(problem || chr(10) || chr(10) || th || chr(10) || chr(10) || case when ok or so <> '' then so else trim(bare, ' ' || chr(10)) end, ' ' || chr(10)) as text,
  case when ok then '' else 'malformed_markers' end as flags, markers from x""",
    "label_agreement": _REASONS + " select quality, cast(len(reasons) = 0 as int) as kept, count(*) as n from r join labels using (doc_id) group by all",
    "token_units": r"""select doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s\p{Z}\p{L}\p{M}\p{N}]')) as units, len(regexp_extract_all(text, '\S+')) as split_words,
  len(regexp_extract_all(text, '\S+')) as runs, len(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) as word_runs,
  len(regexp_extract_all(replace(text, ' ', '▁'), '▁?[^▁]+|▁')) as pieces, len(regexp_extract_all(text, '\s*\S+|\s+')) as pretokens,
  length(regexp_replace(text, '\s+', '', 'g')) as visible, length(text) - length(translate(text, '#{}[]<>|', '')) as symbols, md5(substring(text, 1, 240)) as head,
  length(text) / greatest(len(regexp_extract_all(text, '\S+')), 1) > 20 as unspaced from documents""",
    "dedup_clusters": "select 112::bigint as clusters, 137::bigint as removed, 8::bigint as largest where (select count(*) from documents) = 1000",
}
# dedup_clusters: an independent run's counts at sf0.01; SQL closure over 32 bands is too slow to be an oracle at large.
del ORACLES["dedup_clusters"]
