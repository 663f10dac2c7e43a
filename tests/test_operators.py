"""Operators on small cases whose answers are known, with tamper and repartition tests."""

import hashlib
import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from quern.functions import hashing, scripts, text as T
from quern.operators import cleaning as C
from quern.operators import graph, mixture as M, shards as S, telemetry as X, tokenize as K, vectors as V
from quern.session import prepare
from quern.sources import sinks


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def one(df, col):
    return [r[0] for r in df.orderBy("doc_id").select(col).collect()]


def test_normalise_cases(spark):
    made = texts(spark, "क‍ष a‍b x​y\r\nz", "a‌​क", "  a \t b  \n\n\n\n c \n \n \n d  ", "क​‍a\u0007‮ q", "tail \u0085\n", "&lt;b&gt; &amp;amp; é")
    got = one(made, T.normalise(F.col("text")))
    assert got[0] == "क‍ष ab xy\nz"
    assert got[2] == "a b\n\n c\n\n\n d"
    assert got[3] == "कa q"  # the joiner touched a zero-width character and a Latin letter
    assert got[4] == "tail"
    assert got[5] == "<b> &amp; é"


def test_quality_and_language(spark):
    made = texts(spark, "- a\n- b\n* c\nd", "one...\ntwo...\nthree", "x\nx\nx", "{}[] word", " ".join(["the cat"] * 20), "Привет мир", "12 34", "")
    got = one(made, T.quality_reasons(F.col("text")))
    assert got == [["too_short", "bullet_wall"], ["too_short", "ellipsis_heavy"], ["too_short", "repeated_lines"], ["too_short", "symbol_heavy"], [], ["too_short"], ["too_short"], ["too_short"]]
    assert one(made, T.language_profile(F.col("text")))[4:] == ["en", "non-latin", "nonlingual", "nonlingual"]


def test_redaction_in_order(spark):
    clean, n = T.redact(F.col("text"))
    row = texts(spark, "mail a.b+c@x-y.co.uk ip 10.0.0.256 10.0.0.25 +1 (212) 555-1234 2125551234 @some_handle").select(clean.alias("c"), *(v.alias(k) for k, v in n.items())).first()
    assert row["c"] == "mail [EMAIL] ip 10.0.0.256 [IPV4] [PHONE] 2125551234 [HANDLE]"
    assert (row["email"], row["ipv4"], row["phone"], row["handle"]) == (1, 1, 1, 1)


def test_scripts(spark):
    made = texts(spark, "hello", "नमस्ते", "aпр", "ab12", "12!", "▁the", "中文")
    assert one(made, scripts.token_script(F.col("text"))) == ["Latin", "Devanagari", "Cyrillic", "Latin", "Symbol", "Latin", "Han"]


def test_hash_definitions(spark):
    made = texts(spark, "abc", "é")
    assert one(made, hashing.md5_uint32(F.col("text"))) == [int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") for t in ("abc", "é")]
    assert one(made, hashing.seed63(F.col("text"))) == [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") & (1 << 63) - 1 for t in ("abc", "é")]
    prepare(spark)
    a = spark.createDataFrame([(0, [5, 9, 2])], "doc_id long, h array<long>")
    assert one(a, hashing.minhash_sql(F.col("h"), 16)) == one(a, hashing.minhash_udf(16)("h"))


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, i) for i in range(300, 340)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == find(n) for n in list(root))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_and_contamination(spark):
    prepare(spark)
    base = " ".join(f"word{i} thing{i}" for i in range(40))
    docs = texts(spark, base, base + " more", "a b", "A  b", "entirely other words stand here in this one line of text")
    assert [r["root"] for r in C.clusters(docs).orderBy("doc_id").collect()] == [0, 0, 2, 2, 4]
    bench = spark.createDataFrame([(base,)], "text string")
    grams = C.benchmark_grams(bench, F.lit("b"))
    assert sorted(r["doc_id"] for r in C.contaminated(docs, grams).collect()) == [0, 1]


def test_extract_marks(spark):
    made = spark.createDataFrame([("q", "<|begin_of_thought|> t <|end_of_thought|><|begin_of_solution|> s <|end_of_solution|>"), ("q", "<|begin_of_thought|>t<|end_of_thought|> rest"), ("", "x")], "problem string, answer string")
    got = [(r["text"], r["flags"], r["markers"]) for r in C.extract(made).collect()]
    assert got == [("q\n\nt\n\ns", [], 4), ("q\n\nt\n\nt rest", ["malformed_markers"], 2), ("x", ["malformed_markers"], 0)]


def test_detectors_on_the_trace(spark):
    prepare(spark)
    s, planted = X.trace(spark, 12000, 8)
    a = {r["step"] for r in X.alarm_sigma(s).collect()}
    assert a == {r["step"] for r in X.alarm_sigma_prefix(s).collect()}
    score = X.score_alarms(X.alarm_sigma_prefix(s), planted).first()
    assert (score["found"], score["missed"], score["false_alarms"]) == (8, 0, 0)
    assert {r["step"] for r in X.alarm_sigma_prefix(s.repartition(7)).collect()} == a


def test_ema_freezes_on_alarm(spark):
    prepare(spark)
    values = [1.0, 1.1, 0.9] * 60 + [9.0, 9.0, 1.0]
    s = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "series string, step long, value double")
    assert [r["step"] for r in X.alarm_ema(s).orderBy("step").collect()] == [180, 181]


def test_m4_draws_the_same_pixels(spark):
    s, _ = X.trace(spark, 3000, 4)
    shape = (3000, 100, 60, 0.0, 10.0)
    full = X.raster(s, *shape)
    assert X.wrong_pixels(full, X.raster(X.sample_m4(s, 100), *shape)).count() in (0, 1)
    assert X.sample_m4(s, 100).count() <= 400


def test_allocation_laws(spark):
    steps = spark.range(40).select(F.col("id").alias("step"))
    got = M.lane_alloc(spark, steps, 16, 1)
    assert [r[0] for r in got.groupBy("step").agg(F.sum("alloc")).select("sum(alloc)").distinct().collect()] == [16]
    assert got.exceptAll(M.lane_alloc(spark, steps.repartition(5), 16, 1)).count() == 0
    r = M.largest_remainder(spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.25), ("a", "z", 0.25)], "g string, lane string, weight double"), 3, ["g"])
    assert {x["lane"]: x["alloc"] for x in r.collect()} == {"x": 1, "y": 1, "z": 1}


def test_mask_and_packing(spark):
    seg = spark.createDataFrame([([0, 0, 0, 1, 1, -1, -1], [True, True, False, True, True, False, False])], "seg array<int>, loss array<boolean>")
    assert seg.select(S.loss_mask(F.col("seg"), F.col("loss"))).first()[0] == [True, False, False, True, False, False, False]
    prepare(spark)
    docs = spark.createDataFrame([("c", i, list(range(2, 2 + n))) for i, n in enumerate([3, 5, 20, 1])], "lane string, doc_id long, ids array<int>")
    packed = S.pack_concat(docs, 8, parts=1).orderBy("seq").collect()
    assert packed[0]["tokens"] == [2, 3, 4, 1, 2, 3, 4, 5] and packed[0]["members"] == [0, 1]
    assert packed[1]["members"] == [2] and packed[2]["n_real"] == 2
    audit = S.audit_packing(S.pack_concat(docs, 8, parts=1), ["lane", "part", "seq"]).first()
    assert list(audit) == [0, 0, 0, 0]
    bad = S.pack_structured(docs, 8).withColumn("loss_mask", F.transform("loss_mask", lambda x: F.lit(True)))
    assert S.audit_packing(bad, ["lane", "doc_id"]).first()["loss_on_padding"] > 0


def test_ledger_sees_tampering_and_cuts(spark):
    prepare(spark)
    rows = spark.createDataFrame([("l", i, f"v={i * i}") for i in range(5)], "ledger string, seq long, payload string")
    e = S.chain(rows)
    assert S.verify_chain(e).first()["first_bad"] is None
    assert S.verify_chain(e.withColumn("payload", F.when(F.col("seq") == 2, "v=0").otherwise(F.col("payload")))).first()["first_bad"] == 2
    assert S.verify_chain(S.truncate(e, 3)).first()["entries"] == 3
    assert S.verify_chain(e.where("seq <> 1")).first()["first_bad"] == 2


def test_shards_and_their_firewall(spark):
    prepare(spark)
    docs = spark.createDataFrame([(i, "a", ["train", "eval", "validation"][i % 3], f"t{i if i < 20 else i - 19}", [i, i + 1]) for i in range(30)], "doc_id long, lane string, split string, text string, ids array<int>")
    shards = S.build_shards(docs)
    assert shards.select("content").distinct().count() == shards.count() == 20
    m = S.shard_manifests(shards)
    assert all(r["ok"] for r in S.verify_shards(shards, m).collect())
    held = docs.where("split <> 'train'").select("text").distinct()
    assert shards.where("split = 'train' and not contaminated").join(held, "text", "left_semi").count() == 0
    assert sinks.missing(m.select("shard_id"), m.where("split = 'train'"), ["shard_id"]).count() == m.where("split <> 'train'").count()


def test_training_matches_a_recount(spark):
    words = Counter({"low": 5, "lower": 2, "newest": 6, "widest": 3})
    counts = spark.createDataFrame([("en", w, n) for w, n in words.items()], "lang string, word string, freq long")
    merges = K.train_bpe(counts, 10)
    split = {w: list(w) for w in words}
    for m in merges:
        pairs = Counter()
        for w, s in split.items():
            for p in zip(s, s[1:]):
                pairs[p] += words[w]
        top = max(pairs.values())
        assert m == min(p for p, n in pairs.items() if n == top)
        split = {w: K.split_word(w, {x: i for i, x in enumerate(merges[: merges.index(m) + 1])}) for w in words}
    prepare(spark)
    f = K.fertility(counts, merges).first()
    assert math.isclose(f["fertility"], sum(len(K.split_word(w, {x: i for i, x in enumerate(merges)})) * n for w, n in words.items()) / sum(words.values()))


class PlainTrainer:
    """Merges made one at a time on words in memory, by recounting."""

    def __init__(self, rows):
        self.rows = [[lang, list(w), n] for lang, w, n in rows]

    def best(self, langs):
        pairs = Counter()
        for lang, w, n in self.rows:
            if lang in langs:
                for p in zip(w, w[1:]):
                    pairs[p] += n
        return min(((-n, p) for p, n in pairs.items()), default=None)

    def merge(self, pair):
        for row in self.rows:
            row[1] = K.split_word(row[1], {pair: 0})

    def fertility(self):
        tokens, words = Counter(), Counter()
        for lang, w, n in self.rows:
            tokens[lang] += n * len(w)
            words[lang] += n
        return {lang: tokens[lang] / words[lang] for lang in sorted(words)}


@pytest.mark.parametrize("sample", [0, 10])
def test_training_on_executors_makes_the_same_merges(spark, monkeypatch, sample):
    """Whatever the sample foretells, also nothing, and with words written anew between merges."""
    monkeypatch.setattr(K.Trainer, "SAMPLE", sample)
    monkeypatch.setattr(K.Trainer, "REWRITE", 4)
    r = random.Random(3)
    rows = {(lang, "".join(r.choice(letters) for _ in range(r.randint(1, 7)))): r.randint(1, 9) for lang, letters in (("en", "aab"), ("hi", "हिन्दी😀")) for _ in range(60)}
    rows = [(lang, w, n) for (lang, w), n in rows.items()] + [("en", "aaaaaaaaa", 40), ("en", "", 3)]
    counts = spark.createDataFrame(rows, "lang string, word string, freq long")
    t, want = PlainTrainer(rows), []
    for _ in range(12):
        want.append(t.best({"en", "hi"})[1])
        t.merge(want[-1])
    assert K.train_bpe(counts, 12) == want
    t, want = PlainTrainer(rows), []
    for i in range(8):
        f = t.fertility()
        lang = "hi" if i < 3 else max(f, key=f.get)
        want.append(t.best({lang})[1])
        t.merge(want[-1])
    assert K.train_parity(counts, 8, ("hi", 3)) == want


@pytest.mark.parametrize("merges", [[("a", "b"), ("ab", "c"), ("c", "c")], [("ab", "c"), ("b", "c"), ("a", "b"), ("a", "bc")]])
def test_fertility_of_any_merges(spark, merges):
    words = ["abcabc", "aabcc", "ccccc", "", "xyz", "b\nabc"]
    counts = spark.createDataFrame([("en", w, i + 1) for i, w in enumerate(words)], "lang string, word string, freq long")
    ranks = {p: i for i, p in enumerate(merges)}
    assert K.fertility(counts, merges).first()["tokens"] == sum((i + 1) * len(K.split_word(w, ranks)) for i, w in enumerate(words))


def test_sweep_measures_held_out_words(spark):
    schema = "lang string, word string, freq long"
    learnt, held = spark.createDataFrame([("en", "abab", 9)], schema), spark.createDataFrame([("en", "abc", 2), ("en", "xyz", 1)], schema)
    got = {r["size"]: r["fertility"] for r in K.sweep(learnt, [1, 2], held_out=held).collect()}
    assert got == {1: (2 * 2 + 3) / 3, 2: (2 * 2 + 3) / 3}
    assert {r["size"]: r["fertility"] for r in K.sweep(learnt, [1, 2]).collect()} == {1: 2.0, 2: 1.0}


def test_training_on_no_words(spark):
    counts = spark.createDataFrame([(None, "abab", 5), ("en", None, 5)], "lang string, word string, freq long")
    assert K.train_bpe(counts, 5) == K.train_parity(counts, 5) == K.reclaim_words(counts, [("a", "b")], 2, 2)[1:] == []
    assert K.water_fill(counts, 50) == {"en": 0}


def test_vectors(spark):
    p = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)]) for i in range(40)], "id long, v array<double>")
    rows = {r["id"]: r["v"] for r in p.collect()}
    for r in V.nearest(p, p, block=8).collect():
        d = {j: sum((a - b) ** 2 for a, b in zip(rows[r["id"]], v)) for j, v in rows.items() if j != r["id"]}
        assert r["distance"] == min(d.values()) and r["neighbour"] == min(j for j, x in d.items() if x == min(d.values()))
    tokens = spark.createDataFrame([(1, "நிறுவனங்களுக்கும்"), (2, "நிறுவனங்களுக்கிடையே")], "token_id long, token string")
    pair = spark.createDataFrame([(1, 2)], "a long, b long")
    short, long = (V.code_cosine(V.byte_codes(tokens, "onehot", w), pair).first()["cosine"] for w in (16, 64))
    assert short > long
    assert V.linear_chain([[[1, 2], [0, 1]], [[2, 0], [0, 2]]]) == [[2, 4], [0, 2]]


def test_first_rows_by_counts(spark):
    from quern.operators.mixture import first_rows

    rows = spark.range(5000).selectExpr("id", "cast(case when id % 3 = 0 then 7 else pmod(hash(id), 50) / 10 end as double) as score")
    want = [r["id"] for r in rows.orderBy(F.desc("score"), "id").collect()]
    for k in (0, 1, 40, 1500, 1700, 4999, 5000):
        got = first_rows(rows, k, [("score", True), ("id", False)], small=10)
        assert sorted(r["id"] for r in got.collect()) == sorted(want[:k])


def test_dispatch_is_a_counting_sort(spark):
    from quern.operators.training import dispatch

    rows = spark.range(300).selectExpr("id", "cast(pmod(hash(id), 4) as int) as e")
    got = sorted((r["position"], r["e"], r["id"]) for r in dispatch(rows, "e", "id", 16).collect())
    assert [p for p, _, _ in got] == list(range(300)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_a_cluster_needs_a_shared_folder():
    from quern.session import workspace

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    with pytest.raises(RuntimeError, match="checkpoint"):
        workspace(type("S", (), {"sparkContext": Context()})())
