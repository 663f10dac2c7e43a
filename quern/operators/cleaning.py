"""Corpus cleaning: extract, normalise, language, quality, deduplicate, redact, decontaminate, manifest.

Stages are DataFrame to DataFrame over doc_id, problem, text, flags; all but deduplication and decontamination fuse into
one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import hashing, text as T
from quern.operators.graph import components
from quern.session import materialise, salted_left_join

NUM_PERM, BANDS = 128, 32
KEPT_LANGUAGES = ["en", "nonlingual"]
MIN_SHARED_NGRAMS = 2
#: Benchmark grams that every worker holds; more are joined. Bounds memory, not results.
HELD_GRAMS = 200_000


def first_of_role(conversations: DataFrame) -> DataFrame:
    """conv_id, system, problem and answer: the first text of each role, empty if there is none."""
    first = lambda role: F.coalesce(F.min_by("text", F.when(F.col("role") == role, F.col("turn"))), F.lit(""))
    return conversations.groupBy("conv_id").agg(first("system").alias("system"), first("user").alias("problem"), first("assistant").alias("answer"))


def first_of_role_nested(df: DataFrame, column: str = "conversations") -> DataFrame:
    """The same over a nested column of {from, value}."""
    pick = lambda role: F.coalesce(F.filter(F.col(column), lambda x: x["from"] == role)[0]["value"], F.lit(""))
    return df.withColumns({"problem": pick("user"), "answer": pick("assistant")})


def extract(traces: DataFrame) -> DataFrame:
    """problem and answer become one text: thought and solution by their marks, or all without marks if a pair is missing."""
    b1, e1, b2, e2 = T.TRACE_MARKERS
    a = F.col("answer")
    thought, solution = T.between(a, b1, e1), T.between(a, b2, e2)
    paired = a.rlike(rf"(?s)\Q{b1}\E.*?\Q{e1}\E") & a.rlike(rf"(?s)\Q{b2}\E.*?\Q{e2}\E")
    bare = a
    for m in T.TRACE_MARKERS:
        bare = F.replace(bare, F.lit(m), F.lit(""))
    kept = F.when(paired | (solution != ""), solution).otherwise(T.strip(bare))
    body = F.concat(F.col("problem"), F.lit("\n\n"), thought, F.lit("\n\n"), kept)
    marks = sum(((F.length(a) - F.length(F.replace(a, F.lit(m), F.lit("")))) / len(m)).cast("long") for m in T.TRACE_MARKERS)
    return traces.withColumns({"text": T.strip(body), "flags": F.when(paired, F.array().cast("array<string>")).otherwise(F.array(F.lit("malformed_markers"))), "markers": marks})


def as_documents(docs: DataFrame) -> DataFrame:
    """Plain documents in the stages' shape: no problem, no flags."""
    return docs.select("doc_id", F.lit("").alias("problem"), "text", F.array().cast("array<string>").alias("flags"))


def with_language(docs: DataFrame) -> DataFrame:
    probe = F.when(F.col("problem") != "", F.col("problem")).otherwise(F.substring("text", 1, 2000))
    return docs.withColumn("language", T.language_profile(probe))


def keep_languages(docs: DataFrame) -> DataFrame:
    return with_language(docs).where(F.col("language").isin(KEPT_LANGUAGES))


def with_reasons(docs: DataFrame) -> DataFrame:
    return docs.withColumn("reasons", T.quality_reasons(F.col("text"), F.col("flags")))


def keep_quality(docs: DataFrame) -> DataFrame:
    return with_reasons(docs).where(F.size("reasons") == 0).drop("reasons")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, words, kept, safe_words and text: the words of the normalised text, whether language and quality keep it and,
    if so, its words once redacted and itself. Every text is normalised and counted once."""
    lean = docs.withColumn("text", T.nfc(T.unescape_html(F.col("text"))))
    joined = F.col("text").contains(T.JOINERS[0]) | F.col("text").contains(T.JOINERS[1])
    lean = lean.withColumn("text", F.when(joined, T.keep_joiners(F.col("text"))).otherwise(F.col("text")))
    seen = lean.withColumn("m", T.normal_measures("text")).select(*(c for c in docs.columns if c != "text"), "m.*")
    broken = T.word_rules(F.col("words"), F.col("symbols")) + T.line_rules(*map(F.col, ("lines", "bullets", "dots", "kinds"))) + T.flag_rules(F.col("words"), F.col("flags"))
    good = F.col("language").isin(KEPT_LANGUAGES)
    for _, test in broken:
        good = good & ~F.coalesce(test, F.lit(False))
    out = with_language(seen).withColumn("kept", F.coalesce(good, F.lit(False)))
    clean, counts = T.redact(F.col("text"))
    found = clean != F.col("text")
    safe = F.when(F.col("kept"), F.when(found, T.word_count(clean)).otherwise(F.col("words")))
    return out.select("doc_id", "words", "kept", safe.cast("long").alias("safe_words"), F.when(F.col("kept"), F.col("text")).alias("text"))


def shingle_hashes(c: Column) -> Column:
    return F.transform(T.word_shingles(c), lambda m: F.conv(F.substring(m, 1, 8), 16, 10).cast("long"))


def band_edges(docs: DataFrame, n_perm: int = NUM_PERM, bands: int = BANDS) -> DataFrame:
    """Edges (a, b) between each member of a band's bucket and the bucket's smallest doc_id."""
    return edges_of(signed(docs.select("doc_id", T.word_runs(F.col("text")).alias("w")), n_perm, bands))


def signed(words: DataFrame, n_perm: int = NUM_PERM, bands: int = BANDS) -> DataFrame:
    """doc_id and keys from doc_id and w, written."""
    sig = words.select("doc_id", _signature(n_perm)("w").alias("sig"))
    return materialise(sig.select("doc_id", band_keys(F.col("sig"), n_perm, bands).alias("keys")), "band-keys")


def band_keys(sig: Column, n_perm: int = NUM_PERM, bands: int = BANDS) -> Column:
    rows = n_perm // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice(sig, i * rows + 1, rows)))


def edges_of(keys: DataFrame) -> DataFrame:
    """The edges from written doc_id and keys, which are read twice."""
    keyed = keys.select("doc_id", F.posexplode("keys").alias("band", "key"))
    least = keyed.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select(F.struct("band", "key").alias("bucket"), "a")
    return salted_left_join(keyed.withColumn("bucket", F.struct("band", "key")), least, "bucket", "doc_id").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def _signature(n_perm: int):
    """MinHash over md5 hashes of 5-word shingles, straight from the words, in one Arrow pass."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import ArrayType, LongType

    one = _signer(n_perm)
    return pandas_udf(lambda words: words.map(one), ArrayType(LongType()))


def _signer(n_perm: int):
    """Words of one text to its MinHash."""
    import numpy as np

    pairs = hashing.permutations(n_perm)

    def one(w):
        from hashlib import md5

        a, b = (np.array(x, dtype=np.uint64)[:, None] for x in zip(*pairs))
        prime = np.uint64(hashing.PRIME)
        w = [] if w is None else list(w)
        runs = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}
        h = np.array([int.from_bytes(md5(r.encode()).digest()[:4], "big") for r in runs], dtype=np.uint64)
        best = np.full((n_perm, 1), prime)
        for i in range(0, len(h), 4096):
            best = np.minimum(best, ((a * h[i : i + 4096] + b) % prime).min(axis=1, keepdims=True))
        return best[:, 0].astype(np.int64)

    return one


def marks(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, keys (of the signature's bands) and shared (grams in common with the benchmark). The words of a text are found
    once for both; over HELD_GRAMS grams are joined instead of held by every worker."""
    from pyspark.sql.functions import pandas_udf

    spark = docs.sparkSession
    held = [r[0] for r in grams.select("gram").limit(HELD_GRAMS + 1).collect()]
    words = docs.select("doc_id", T.word_runs(F.col("text")).alias("w"))
    if len(held) > HELD_GRAMS:
        return signed(words).join(contaminated(docs, grams, least=1).select("doc_id", "shared"), "doc_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
    known = spark.sparkContext.broadcast(frozenset(held))
    sign = _signer(NUM_PERM)

    @pandas_udf("sig array<long>, shared long")
    def both(col):
        import pandas as pd

        find, out = known.value, []
        for w in map(list, col):
            out.append((sign(w), len(find.intersection([" ".join(w[i : i + 13]) for i in range(len(w) - 12)]))))
        return pd.DataFrame(out, columns=["sig", "shared"])

    found = words.withColumn("m", both("w")).select("doc_id", "m.*")
    return materialise(found.select("doc_id", band_keys(F.col("sig")).alias("keys"), "shared"), "clean-marks")


def clusters(docs: DataFrame, n_perm: int = NUM_PERM, bands: int = BANDS, edges: DataFrame | None = None) -> DataFrame:
    """doc_id, root: near-duplicates by any shared band, closed transitively; the root is the smallest doc_id."""
    found = components(band_edges(docs, n_perm, bands) if edges is None else edges).select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("c", "doc_id").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    return docs.join(clusters(docs).where("doc_id <> root"), "doc_id", "left_anti")


def exact_first(docs: DataFrame, order: list[str]) -> DataFrame:
    """The first row of every content hash in the given order: a partial minimum per hash, then a semi join back."""
    key = F.sha2(F.col("text"), 256)
    least = docs.groupBy(key.alias("content")).agg(F.min(F.struct(*order)).alias("first"))
    return docs.withColumn("content", key).join(least, "content").where(F.struct(*order) == F.col("first")).drop("first", "content")


def redact(docs: DataFrame) -> DataFrame:
    clean, counts = T.redact(F.col("text"))
    return docs.select(*(c for c in docs.columns if c != "text"), clean.alias("text"), *(n.alias(f"n_{k}") for k, n in counts.items()))


def benchmark_grams(benchmark: DataFrame, name: Column) -> DataFrame:
    """Informative 13-word grams with the smallest benchmark name that has each."""
    grams = benchmark.select(name.alias("name"), F.explode(T.word_ngrams(F.col("text"))).alias("gram"))
    return grams.where(T.informative(F.col("gram"))).groupBy("gram").agg(F.min("name").alias("name"))


def contaminated(docs: DataFrame, grams: DataFrame, probe: str = "text", least: int = MIN_SHARED_NGRAMS) -> DataFrame:
    """doc_id, shared grams and the smallest benchmark name of documents with at least `least` grams in common. Spark
    broadcasts the benchmark side when its measured size allows, and shuffles on the gram otherwise."""
    found = docs.select("doc_id", F.explode(T.word_ngrams(F.col(probe))).alias("gram")).join(grams, "gram")
    return found.groupBy("doc_id").agg(F.count("*").alias("shared"), F.min("name").alias("name")).where(F.col("shared") >= least)


def manifest(docs: DataFrame, shard: str = "shard-000", source: str = "documents") -> DataFrame:
    """One row: what the shard holds."""
    langs = with_language(docs).groupBy("language").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "count")))).alias("languages"))
    size = docs.agg(F.count("*").alias("rows"), F.sum(T.word_count(F.col("text"))).cast("long").alias("tokens"))
    digest = hashing.corpus_sha256(docs, "text", "doc_id").select("sha256")
    steps = F.array(*(F.lit(x) for x in ["extract", "normalise", "language", "quality", "dedup", "pii", "decontam"]))
    return size.join(langs).join(digest).select(F.lit(shard).alias("shard_id"), F.lit(source).alias("source"), "sha256", "rows", "tokens", F.to_json("languages").alias("languages"), steps.alias("steps"))


def timeline(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """stage_ord, stage, rows and tokens after each stage."""
    parts = [
        df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(T.word_count(F.col("text"))), F.lit(0)).cast("long").alias("tokens")).select(F.lit(i).alias("stage_ord"), F.lit(name).alias("stage"), "rows", "tokens")
        for i, (name, df) in enumerate(stages)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tally(rows: DataFrame, stages: list[tuple[str, Column, str]]) -> DataFrame:
    """The timeline of rows that are marked and counted already: each stage's test and its column of tokens."""
    sums = [
        F.struct(F.lit(i).alias("stage_ord"), F.lit(name).alias("stage"), F.count_if(test).alias("rows"), F.coalesce(F.sum(F.when(test, F.col(n))), F.lit(0)).cast("long").alias("tokens"))
        for i, (name, test, n) in enumerate(stages)
    ]
    return rows.agg(F.array(*sums).alias("line")).select(F.inline("line"))


def funnel(docs: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """The timeline of row filters from one pass: each stage keeps what all before it kept and its own test keeps."""
    kept, sums = F.lit(True), []
    flagged = docs.select(T.word_count(F.col("text")).alias("tokens"), *(test.alias(f"keep_{i}") for i, (_, test) in enumerate(stages)))
    for i, (name, _) in enumerate(stages):
        kept = kept & F.col(f"keep_{i}")
        tokens = F.coalesce(F.sum(F.when(kept, F.col("tokens"))), F.lit(0)).cast("long")
        sums.append(F.struct(F.lit(i).alias("stage_ord"), F.lit(name).alias("stage"), F.count_if(kept).alias("rows"), tokens.alias("tokens")))
    return flagged.agg(F.array(*sums).alias("line")).select(F.inline("line"))


def loss_percent(line: DataFrame) -> DataFrame:
    """Rows and tokens lost since the first stage, in percent."""
    first = Window.orderBy("stage_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pct = lambda c: F.round(100 * (F.first(c).over(first) - F.col(c)) / F.first(c).over(first), 2)
    return line.withColumns({"rows_lost_pct": pct("rows"), "tokens_lost_pct": pct("tokens")})
