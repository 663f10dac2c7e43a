"""Queries see every row of their tables, not a prefix of ids or the most frequent words."""

import itertools

import pytest
from pyspark.sql import functions as F

from quern.plans import catalog, cleaning, mixture, sources, tokens
from quern.session import table


@pytest.fixture(scope="module")
def far(spark, sf, tmp_path_factory):
    """The smallest tables with ids beyond any fixed prefix."""
    path = tmp_path_factory.mktemp("far")
    for name, key in (("documents", "doc_id"), ("events", "event_id")):
        table(spark, sf, name).withColumn(key, F.col(key) + 100_000).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_tokenizer_counts_every_word(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(5000))
    spark.createDataFrame([(0, text, "en"), (1, "w1 w2", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["lang"]: r for r in catalog.queries()["bpe_bytes_fertility"](spark, str(tmp_path)).collect()}
    assert got["en"]["words"] == 5000 and got["de"]["words"] == 2
    assert tokens._counts(spark, str(tmp_path)).count() == 5002


def test_packing_audit_reads_all_documents(spark, far, monkeypatch):
    monkeypatch.setattr(mixture.S, "audit_packing", lambda packed, keys: packed.agg(F.count("*").alias("n")))
    whole = mixture.S.pack_concat(mixture._lane_docs(spark, far), 128).count()
    assert mixture.packing_audit(spark, far).first()["n"] == whole > 0


def test_ledgers_hold_all_events(spark, far):
    n = table(spark, far, "events").count()
    assert mixture._day_entries(spark, far).count() == n
    verdicts = {r["name"]: r["verdict"] for r in mixture.evidence_table(spark, far).collect()}
    assert verdicts["ledger_intact"] == verdicts["tamper_is_seen"] == "PASS"
    got = sources.sink_round_trip(spark, far).collect()
    assert [(r["entries"], r["intact"], r["shards_ok"]) for r in got] == [(n, True, True)]


def test_code_separation_pairs_come_from_the_whole_vocabulary(spark, tmp_path, monkeypatch):
    letters = ["".join(x) for x in itertools.product("abcdefghij", repeat=3)]
    text = " ".join(f"{p}z{end}" for p in letters for end in ("xx", "yyy"))
    spark.createDataFrame([(0, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    plain = tokens.V.code_cosine
    monkeypatch.setattr(tokens.V, "code_cosine", lambda codes, pairs: seen.append(sorted(map(tuple, pairs.collect()))) or plain(codes, pairs))
    rows = tokens.code_separation(spark, str(tmp_path)).collect()
    words = {r["token_id"]: r["token"] for r in tokens._vocabulary(spark, str(tmp_path)).collect()}
    related, other = seen[0], seen[1]
    assert len(related) == len(other) == 400 and seen[2:4] == [related, other]
    assert all(words[a][:4] == words[b][:4] for a, b in related) and all(words[a][:2] != words[b][:2] for a, b in other)
    assert len(rows) == 4 and all(r["related"] is not None and r["unrelated"] is not None for r in rows)


def test_redacted_documents_of_every_kind(spark, tmp_path):
    texts = ["mail a.b@example.org", "host 10.1.2.3 up", "call 212 555 1234", "ask @somebody_x now", "nothing here"]
    spark.createDataFrame([(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in cleaning.pii_redacted(spark, str(tmp_path)).collect() if r["doc_id"] >= 1000) == [1000, 1001, 1002, 1003]


def test_entities_without_a_semicolon_stay(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from quern.functions import text as T

    texts = ["a &amp</title> &am", "&amp;amp &amp;amp; &quot;&copy;&middot; &ampx; &&amp", "e\u0301 &amp;copy; &copy &notit;", "", None]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(catalog.oracles()["html_entities"]).fetchall()
    assert sorted(map(tuple, catalog.queries()["html_entities"](spark, str(tmp_path)).collect())) == sorted(want)
    more = spark.createDataFrame([("&lt;b&gt; &#233;&#xE9; &CounterClockwiseContourIntegral; &nosuch; &lt",)], "t string")
    assert more.select(T.unescape_closed_html("t"), T.unescape_html("t")).first()[:] == ("<b> éé ∳ &nosuch; &lt", "<b> éé ∳ &nosuch; <")


ODD = [
    "  a \t b  \n\n\n\n c \n \n \n d  ", "क‍ष a‍b x​y\r\nz ‌", "- a\n- b\n* c\nd &bull; e", "one...\ntwo... \nthree", "{}[]{}[] <> || ##", "same\nsame\nsame\nother", "",
    "á &lt;b&gt; &amp", "\x1c x \x85 y  \n 　...", "\n".join(["long line of many words here"] * 9), None, "• " + "w " * 30, "w " * 25 + "212 555 1234 @some_name a@b.org", "Привет мир " * 20,
]


def test_full_cleaning_equals_its_stages_and_reads_no_text_again(spark, sf, tmp_path, monkeypatch):
    from quern.operators import cleaning as C

    own = spark.createDataFrame([(i - 100, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    table(spark, sf, "documents").select("doc_id", "text").unionByName(own).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cleaning.full_cleaning(spark, str(tmp_path))
    assert "text:string" not in got._jdf.queryExecution().executedPlan().toString()
    docs = cleaning.documents(spark, str(tmp_path)).withColumn("text", cleaning.T.normalise(F.col("text"))).cache()
    good = C.keep_quality(C.keep_languages(docs)).drop("language").cache()
    unique = C.deduplicate(good).cache()
    safe = C.redact(unique).select(*unique.columns)
    clean = safe.join(C.contaminated(unique, C.benchmark_grams(table(spark, sf, "benchmark"), F.lit("b"))).select("doc_id"), "doc_id", "left_anti")
    want = C.timeline([("normalise", docs), ("quality", good), ("dedup", unique), ("pii", safe), ("decontam", clean)])
    assert got.orderBy("stage_ord").collect() == want.orderBy("stage_ord").collect()
    monkeypatch.setattr(C, "HELD_GRAMS", 3)
    assert cleaning.full_cleaning(spark, str(tmp_path)).orderBy("stage_ord").collect() == want.orderBy("stage_ord").collect()


def test_measures_equal_the_column_functions(spark):
    from quern.functions import text as T

    every = ["a".join(chr(c) for c in range(i, i + 4096) if not 0xD800 <= c < 0xE000 and chr(c) not in T.JOINERS) for i in range(0, 0x110000, 4096)]
    df = spark.createDataFrame([(t,) for t in ODD + every], "t string").withColumn("t", T.keep_joiners(F.col("t"))).withColumn("m", T.normal_measures("t"))
    plain = T.normalise_builtin(F.col("t"))
    df = df.select("t", "m.*", plain.alias("plain")).withColumns({"n": T.word_count(F.col("plain")), "s": T.symbol_count(F.col("plain")), "ln": F.size(T.lines(F.col("plain")))})
    rows = [r for r in df.collect() if r["t"] is not None]
    for r in rows:
        assert (r["text"], r["words"], r["symbols"], r["lines"]) == (r["plain"], r["n"], r["s"], r["ln"]), ascii([x for x in zip(r["text"], r["plain"]) if x[0] != x[1]][:1])
