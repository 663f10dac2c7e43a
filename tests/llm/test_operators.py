"""The ten operators against brute force, exact round trips, held-out accuracy and edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.session import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, host string, score double"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, columns whose names operators use themselves."""
    texts = [None, "", " \n\t ", "one two three", "A b\u00a0c  d\r\n\u2003e 中文 😀 <|endoftext|> don't", "Word " * 30000, "same text here for all of us now", "same text here for all of us now"]
    return spark.createDataFrame([(i, t, "en", None if i % 2 else "h", 0, "x", 1.0) for i, t in enumerate(texts)] + [(6, texts[6], "en", "h", 0, "x", 1.0)], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def sf_of(spark, tmp_path_factory):
    """Writes frames as the tables of a folder."""

    def write(**frames):
        path = tmp_path_factory.mktemp("sf")
        for name, df in frames.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write


# -- 1 decontamination -----------------------------------------------------------------------------------------------


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, c in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (p != c)))
        row = now
    return min(row)


def test_myers_equals_dynamic_programming():
    from quern.llm.decontam import myers

    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 120)))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert myers(masks, len(p), t, len(p))[0] == min(distance(p, t), len(p) + 1)


def test_pigeonhole_equals_brute_force():
    from quern.llm.decontam import ERROR_SHARE, Matcher, normal

    rng = random.Random(2)
    letters = "abcdefgh "
    items = [(i, normal("".join(rng.choice(letters) for _ in range(rng.randint(60, 120))))) for i in range(6)]
    m = Matcher(tuple(items))
    for _ in range(60):
        i, item = rng.choice(items)
        chars = list(item)
        for _ in range(rng.randint(0, len(item) // 7)):
            k = rng.randrange(len(chars))
            chars[k] = rng.choice(["", "x", chars[k] + "y"])
        text = normal("lead " + "".join(chars) + " " + "".join(rng.choice(letters) for _ in range(40)))
        want = {j for j, t in items if distance(t, text) <= len(t) // ERROR_SHARE}
        assert {j for j, _, _ in m.find(text)} == want


def test_decontamination_cases(spark, odd, none):
    from quern.llm.decontam import drop_leaks, leaks
    from quern.session import prepare

    prepare(spark)
    bench = spark.createDataFrame([(1, "same text here"), (2, None), (3, ""), (4, "same text here"), (5, "two")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in rows(leaks(odd, bench)))
    assert got == sorted([(3, 5)] + [(d, i) for d in (6, 6, 7) for i in (1, 4)])
    assert leaks(none, bench).count() == 0 and leaks(odd, bench.limit(0)).count() == 0
    assert drop_leaks(odd, bench).columns == odd.columns and drop_leaks(odd, bench).count() == 5


def test_planted_leaks(spark, sf):
    from quern.llm.decontam import op1_pigeonhole

    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    exact = docs.join(bench.withColumnRenamed("text", "item"), F.contains("text", "item")).select("doc_id", "item_id")
    found = op1_pigeonhole(spark, sf)
    assert exact.join(found, ["doc_id", "item_id"], "left_anti").count() == 0


# -- 2 url filter ----------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark, sf_of):
    from quern.llm.urls import RULES, op2_url_trees

    urls = ["HTTP://WWW.Example.COM/en/7a?q=1", "http://x.com/en/8#f", "https://a.net/de/", "https://www.example.net/de/81", "x://org/es/", "x://borg/es/", None, "no scheme/com/en/", "a://b.com?x://c.com/en/", "", "http://x.com/en/8#f"]
    sf = sf_of(pages=spark.createDataFrame([(i, u, "", "com") for i, u in enumerate(urls)], "page_id long, url string, html string, suffix string"))
    got = {r["page_id"]: r for r in rows(op2_url_trees(spark, sf))}

    def brute(u):
        if not u or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fits, key=len, default=None)

    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == brute(u)
        if got[i]["rule"]:
            assert got[i]["verdict"] == dict(RULES)[got[i]["rule"]]
        assert got[i]["verdict"] in ("allow", "block")
    assert got[1]["verdict"] == got[10]["verdict"]
    empty = sf_of(pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert op2_url_trees(spark, empty).count() == 0


def test_boosted_trees_learn():
    from quern.llm.urls import Boosted

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    m = Boosted().fit(x[:1500], y[:1500])
    assert ((m.probability(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9


# -- 3 chat ----------------------------------------------------------------------------------------------------------


def test_escapes_round_trip():
    from quern.llm.chat import escape, unescape

    for n in range(1, 6):
        for t in map("".join, itertools.product("<\\|a", repeat=n)):
            assert unescape(escape(t)) == t and "<|" not in escape(t)


def test_chat_equals_brute_force(spark, sf_of):
    from quern.llm.chat import END, PROBE, SEP, START, op3_chat_tokens

    made = [(1, 0, "user", None), (1, 1, "assistant", "hi <| there"), (1, 2, None, ""), (2, 1, "assistant", "b|"), (2, 0, "assistant", "a<"), (3, 0, "system", "x" * 50000), (4, 0, "assis\ntant", "<|im_end|>")]
    sf = sf_of(conversations=spark.createDataFrame([(*m, "z") for m in made], "conv_id long, turn long, role string, text string, ids string"))
    got = {r["conv_id"]: r for r in rows(op3_chat_tokens(spark, sf))}
    made += [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    for c in {m[0] for m in made}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((m for m in made if m[0] == c), key=lambda m: m[1])]
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len({START, SEP, END}) == 3
    empty = sf_of(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert op3_chat_tokens(spark, empty).count() == 1


# -- 4 and 5 codecs --------------------------------------------------------------------------------------------------


def ranks(name):
    import public_tokenizers
    import tiktoken

    from quern.llm.bpe import read_ranks

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(name)), special_tokens={})


def test_codec_equals_tiktoken(spark, odd, none, docs):
    from quern.llm.bpe import VOCABULARY, encode_documents
    from quern.session import prepare

    prepare(spark)
    enc = ranks(VOCABULARY)
    both = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i + 100, t) for i, t in docs], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in rows(both)}
    for r in rows(encode_documents(both, tokens=True)):
        t = texts[r["doc_id"]]
        ids = enc.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert encode_documents(none).count() == 0


def test_cuts_never_split_a_match():
    import public_tokenizers

    from quern.llm import pieces
    from quern.llm.bpe import VOCABULARY, Codec

    enc = ranks(VOCABULARY)
    codec = Codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choice([" ", "a", "B", "1", "'", "s", "\n", "\t", "\u00a0", "\u2003", "é", "中", "\x1c", "\x85", ",", "😀"]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert all(list(a) == enc.encode_ordinary(t) for t, a in zip(texts, codec.encode_all(texts)))
    long = "ab cd  " * 500_000
    assert len(long) > pieces.GROUP and list(codec.encode_all([long])[0]) == enc.encode_ordinary(long)


def test_grammar_round_trip():
    from quern.llm.grammar import END_ID, Shard, compress, pack

    rng = np.random.default_rng(4)
    made = [np.append(rng.integers(3, 9, rng.integers(0, 400)), END_ID).astype("<u4") for _ in range(50)]
    made.append(np.array([2, 2, 5, 5, 5, 5, 2], dtype="<u4"))
    shard = Shard(pack([None, *range(1, 51)], made, 60000))
    assert shard.doc_ids == [None, *range(1, 51)]
    assert all(np.array_equal(shard.ids(k), m) for k, m in enumerate(made))
    assert len(shard.symbols) < 0.6 * shard.n_ids and len(shard.rules)
    assert all(n == sum(shard.size[list(r)]) for r, n in zip(shard.rules, shard.lengths))
    assert len(compress(np.empty(0, dtype="<u4"), 10)[0]) == 0


def test_grammar_folds_runs_of_one_id():
    from quern.llm.grammar import END_ID, Shard, overlapping, pack

    made = [np.array([9, *[5] * n, 8, END_ID], dtype="<u4") for n in (1000, 1001, 7, 0, 1)]
    shard = Shard(pack(list(range(5)), made, 60000))
    assert all(np.array_equal(shard.ids(k), m) for k, m in enumerate(made))
    assert len(shard.symbols) < 100 and [5, 5] in shard.rules.tolist()
    seq = np.array([5, 5, 5, 5, 1, 7, 7, 7, 2, 2])
    assert overlapping(seq[:-1], seq[1:]).tolist() == [1, 6]


def repair_by_hand(ids, end_id, least):
    """Re-Pair of one pair at a time, by definition: symbols and number of rules."""
    seq, top, rules = list(ids), 1_000_000, 0
    while True:
        counts, last = {}, {}
        for i, p in enumerate(zip(seq, seq[1:])):
            if end_id not in p and last.get(p) != i - 1:
                counts[p] = counts.get(p, 0) + 1
                last[p] = i
        best = max(counts, key=counts.get, default=None)
        if best is None or counts[best] < least:
            return seq, rules
        out, i = [], 0
        while i < len(seq):
            if tuple(seq[i : i + 2]) == best:
                out.append(top)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq, top, rules = out, top + 1, rules + 1


def test_grammar_is_as_small_as_one_pair_at_a_time(docs):
    from quern.llm.grammar import END_ID, LEAST_COUNT, Encoder, VOCABULARY, compress
    import public_tokenizers

    enc = Encoder(public_tokenizers.path(VOCABULARY))
    ids = np.concatenate([np.append(e, np.uint32(END_ID)) for e in enc.encode_all([t for _, t in docs][:40])])[:12000]
    want, n = repair_by_hand(ids.tolist(), END_ID, LEAST_COUNT)
    symbols, rules, _ = compress(ids, enc.base)
    assert len(symbols) + 3 * len(rules) <= 1.02 * (len(want) + 3 * n)
    pairs = {}
    for p in zip(symbols.tolist(), symbols.tolist()[1:]):
        pairs[p] = pairs.get(p, 0) + (END_ID not in p and p[0] != p[1])
    assert max(pairs.values()) < LEAST_COUNT


def test_shards_equal_the_library(spark, sf_of, odd, none, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quern.llm.grammar import END_ID, VOCABULARY, op5_repair_shards

    tok = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    all_ = odd.where("doc_id < 6").unionByName(spark.createDataFrame([(i + 100, t, None, None, 0, None, None) for i, t in docs], DOC))
    texts = {r["doc_id"]: r["text"] or "" for r in rows(all_)}
    at = 0
    got = {r["doc_id"]: r for r in rows(op5_repair_shards(spark, sf_of(documents=all_)))}
    for d in sorted(texts):
        ids = np.array([*tok.encode(texts[d], add_special_tokens=False).ids, END_ID], dtype="<u4")
        assert got[d] == {"doc_id": d, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        at += len(ids)
    assert op5_repair_shards(spark, sf_of(documents=odd)).count() == 9
    assert op5_repair_shards(spark, sf_of(documents=none)).count() == 0


def test_grammar_of_many_symbols_and_crowded_tables(monkeypatch):
    """Codes of 64 bits; pairs that share a slot; runs, and ends beside what is replaced."""
    from quern.llm import grammar

    rng = np.random.default_rng(4)
    wide = np.tile(np.concatenate([np.arange(3, 70_003), [grammar.END_ID]]), 5)
    for bits, ids, base in [(20, wide, 70_010), *[(bits, np.where(x == 1, grammar.END_ID, x + 3), 40) for bits in (3, 20) for n in (2, 4, 30) for x in [rng.integers(0, n, 3000)]]]:
        monkeypatch.setattr(grammar, "SLOT_BITS", bits)
        symbols, rules, _ = grammar.compress(ids.astype(np.uint32), base)
        assert grammar.Shard(grammar.pack([7], [ids.astype(np.uint32)], base)).ids(0).tolist() == ids.tolist()
        flat = symbols.tolist()
        counts = {}
        for p in zip(flat, flat[1:]):
            counts[p] = counts.get(p, 0) + (grammar.END_ID not in p and p[0] != p[1])
        assert max(counts.values()) < grammar.LEAST_COUNT and grammar.END_ID not in rules
    assert len(rules)


def test_pretokens_equal_the_library(monkeypatch):
    """Odd neighbours, added tokens and windows that end anywhere."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quern.llm import grammar, pretokens

    path = public_tokenizers.path(grammar.VOCABULARY)
    tok, enc, rng = Tokenizer.from_file(path), grammar.Encoder(path), random.Random(3)
    parts = ["a", "Zq", "the", "word", "\u00e9", "\u00d7", "\u00f7", "\u00d1", "\u0153", "e\u0301", "7", "42", "'", "'s", "'ll", "don't", "\u2019", "...", "$", "<|", "|>", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\t", "\r\n"]
    parts += ["\x0b", "\x0c", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u205f", "\u3000", "\ufeff", "\u200b", "\u4e2d", "\u0441\u043b\u043e\u0432\u043e", "\u0939\u093f", "\U0001f600", "\u0663", "\u00bd", "\u00aa", "\x00"]
    for window, together in ((8, 3), (16, 20), (50, 2000), (1 << 22, 2000)):
        monkeypatch.setattr(pretokens, "WINDOW", window)
        monkeypatch.setattr(grammar, "TOGETHER", together)
        for _ in range(12):
            some = rng.sample(parts, rng.randint(3, len(parts)))
            texts = [None, "", *["".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(40)]]
            assert [x.tolist() for x in enc.encode_all(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_once_whatever_stands_beside_them():
    import public_tokenizers

    from quern.llm import grammar

    learnt = []

    class Noted(grammar.Encoder):
        def _learn(self, pieces):
            learnt.extend(pieces)
            return super()._learn(pieces)

    Noted(public_tokenizers.path(grammar.VOCABULARY)).encode_all([f"x {word}{mark}" for word in ["one", "two", "three", "four"] for mark in [".", ",", "$$$", ":", "\nx"]])
    assert len(learnt) == len(set(learnt)) <= 4 + 6  # words; x, marks and the line end


# -- 6 near-duplicates -----------------------------------------------------------------------------------------------


def shingle_set(text):
    w = tuple(WORDS.findall((text or "").translate(LOWER)))
    return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())


def brute_components(texts, percent=85):
    sets, root = {d: shingle_set(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_near_duplicates_equal_brute_force(spark, sf_of, docs):
    from quern.llm.neardup import op6_circulant_minhash

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(150)]
    texts = dict(docs)
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts[1000 + k] = " ".join(w)
    texts |= {2000: None, 2001: "", 2002: "A b C", 2003: "a B c", 2004: " \n"}
    made = spark.createDataFrame([(d, t, "k", 1) for d, t in texts.items()], "doc_id long, text string, key string, n long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(op6_circulant_minhash(spark, sf_of(documents=made)))}
    assert got == brute_components(texts)


def test_near_duplicate_cases(spark, sf_of, odd, none):
    from quern.llm.neardup import one_of_each, op6_circulant_minhash

    got = rows(op6_circulant_minhash(spark, sf_of(documents=odd)))
    assert len(got) == 9 and {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert sorted(r["doc_id"] for r in rows(one_of_each(odd))) == [0, 1, 2, 3, 4, 5, 6, 6]
    assert op6_circulant_minhash(spark, sf_of(documents=none)).count() == 0


def test_stage_drops_copies_from_four_fifths(spark):
    from quern.llm.neardup import PERCENT, band_count, one_of_each

    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(5000)]
    texts = {}
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(200)]
        texts[10 * g] = " ".join(base)
        for k in range(1, 5):
            w = list(base)
            for at in rng.sample(range(len(w)), k + 2):
                w[at] = rng.choice(vocab)
            texts[10 * g + k] = " ".join(w)
    sets = {d: shingle_set(t) for d, t in texts.items()}

    def kept(percent):
        root = {d: d for d in sets}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in itertools.combinations(sorted(sets), 2):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
        return [d for d in sorted(sets) if find(d) == d]

    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert kept(80) != kept(85)
    assert sorted(r["doc_id"] for r in rows(one_of_each(made))) == kept(80)
    assert sorted(r["doc_id"] for r in rows(one_of_each(made, PERCENT))) == kept(85)
    assert band_count(85) == 26 and band_count(80) > 26


def test_bounds_of_bands_and_prints():
    from quern.llm.neardup import MISSED, PRINT_BITS, band_count, most_differ

    for percent in (50, 80, 85, 95):
        p = (1 - percent / 100) / 2
        tail = lambda m: sum(math.comb(PRINT_BITS, k) * p**k * (1 - p) ** (PRINT_BITS - k) for k in range(m + 1, PRINT_BITS // 2))  # noqa: B023, E731
        assert tail(most_differ(percent)) < MISSED / 3 <= tail(most_differ(percent) - 1)
        for width in (5, 12):
            assert (1 - (percent / 100) ** width) ** band_count(percent, width) <= MISSED / 3


def test_signatures_of_sets_larger_than_the_permutation():
    from quern.llm.neardup import signature

    made = np.random.default_rng(3).integers(0, 2**63, 6_000_000, dtype=np.int64).view(np.uint64) * np.uint64(2)
    a, b, c = (np.unique(made[i : i + 3_000_000]) for i in (0, 3_000_000, 300_000))
    same = [(signature(a, 512) == signature(x, 512)).mean() for x in (a, b, c)]
    assert same[0] == 1 and same[1] < 0.01 and abs(same[2] - 27 / 33) < 0.07


def test_crowded_buckets_are_reopened(spark):
    """One base with ever more edits: many members, few links; with every bucket reopened and with none the links are the same."""
    from quern.llm import neardup
    from quern.session import prepare

    prepare(spark)
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(40)]
    base = [rng.choice(vocab) for _ in range(150)]
    texts = {}
    for k in range(120):
        w = list(base)
        for at in rng.sample(range(150), k // 12):
            w[at] = rng.choice(vocab)
        texts[k] = " ".join(w)
    want = {d: c for d, (_, c) in brute_components(texts).items()}
    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(set(want.values())) > 5
    for crowd in (2, neardup.CROWD):
        assert {r["doc_id"]: r["component_id"] for r in rows(neardup.link(made, neardup.PERCENT, crowd))} == want


# -- 7 language model ------------------------------------------------------------------------------------------------


def brute_scores(texts, mu):
    """held_out, n_tokens, n_known, N, base_score and score by the formulas, without an automaton."""
    toks = {d: [*WORDS.findall((t or "").translate(LOWER)), 0] for d, t in texts.items()}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 10]
    c = {}
    for d in train:
        ws = [1, *toks[d]]
        for i in range(1, len(ws)):
            for k in range(1, min(3, i + 1) + 1):
                g = tuple(ws[i - k + 1 : i + 1])
                c[g] = c.get(g, 0) + 1
    one = {g: x for g, x in c.items() if len(g) == 1}
    n, z = sum(one.values()), sum(one.values()) + 0.1 * (len(one) + 1)
    c[(1,)] = c.get((0,), 0)

    def p(w, context):
        if not context:
            return (c.get((w,), 0) + 0.1) / z
        m = mu[len(context) - 1]
        seen = c.get(context, 0)
        return (c.get((*context, w), 0) + m * p(w, context[1:])) / (seen + m)

    out = {}
    for d, ws in toks.items():
        ws = [1, *ws]
        score = sum(math.log10(p(ws[i], tuple(ws[max(0, i - 2) : i]))) for i in range(1, len(ws)))
        out[d] = (d not in train, len(ws) - 1, sum((w,) in one for w in ws[1:]), n, sum(math.log10(p(w, ())) for w in ws[1:]), score)
    return out


def test_scores_equal_brute_force(spark, sf_of, docs, monkeypatch):
    from quern.llm import lm

    texts = dict(docs[:80]) | {900: None, 901: "", 902: "Never seen words", 903: "a b " * 6000, 904: "a b c d"}
    made = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, block long")
    want = brute_scores(texts, lm.MU)
    for block_bytes in (lm.BLOCK_BYTES, 20_000):
        got = rows(lm.score_documents(made, block_bytes=block_bytes)) if block_bytes != lm.BLOCK_BYTES else rows(lm.op7_backoff_automaton(spark, sf_of(documents=made)))
        assert len(got) == len(texts)
        for r in got:
            exact, close = list(want[r["doc_id"]][:4]), want[r["doc_id"]][4:]
            assert [r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]] == exact
            assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip((r["base_score"], r["score"]), close))


def automaton_of(train, asked):
    from quern.llm.lm import Automaton, Grams

    grams = Grams([*train, *asked])
    counts = grams.own_counts([False] * len(train) + [True] * len(asked))
    return grams, Automaton(grams, counts, int(counts[0].sum()), int((counts[0] > 0).sum()))


def test_state_weights_add_up():
    """Out of every state, the weights of all known tokens and one unseen one add up to one, arcs and failures together."""
    known = ["a", "b", "c", "unseen"]
    train = ["a b a c", "b a b", "a b c"]
    for before in ("", "a", "a b", "b b", "c unseen", "unseen a"):
        size = len(before.split())
        grams, model = automaton_of(train, [f"{before} {w}" for w in known] + [before])
        texts = range(len(train), len(train) + len(known))
        last = [model.walk(grams.starts[[i]] + 1, np.array([n]), np.array([model.start]), np.array([0]))[0] for n in (size, size + 1) for i in texts]
        ends = model.scores(grams)[-1] - (last[0] if size else 0.0)
        assert abs(sum(10 ** (b - a) for a, b in zip(last, last[len(known) :])) + 10**ends - 1) < 1e-9


def test_walk_carries_its_state():
    """Arc by arc: what the walk adds for a token depends on the state in which the token before left it."""
    grams, model = automaton_of(["a b c", "x b d"], ["a b c", "x b c", "q b c"])
    got = model.scores(grams)[2:]
    assert got[0] > got[1] > got[2]
    pair_states = set(model.target[model.by_pair[model.by_pair >= 0]].tolist())
    assert all(s > model.tokens and model.fail[s] in range(1, model.tokens + 1) for s in pair_states)
    assert all(model.fail[s] == 0 for s in range(model.tokens + 1))


def test_stretches_score_like_whole_texts(monkeypatch):
    from quern.llm import lm

    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 2, 50, 333)]
    grams, model = automaton_of(texts[:4], texts)
    whole = model.scores(grams)
    for stretch in (2, 3, 10):
        monkeypatch.setattr(lm, "STRETCH", stretch)
        assert np.allclose(model.scores(grams), whole, rtol=1e-12)


def test_messages_round_trip():
    from quern.llm.lm import _narrow, _packed, _unpacked, _wide

    for keys in ([7], [0, 1, 2**63, 2**64 - 1], list(range(5, 90, 3))):
        keys = np.array(keys, dtype=np.uint64)
        assert np.array_equal(_wide(_narrow(keys, 0), len(keys), 0), keys)
    for n in ([], [0, 3], [2**32 - 1], [2**32, 5 * 2**40]):
        assert _unpacked(_packed(np.array(n, dtype=np.int64)), len(n)).tolist() == n


def test_language_model_cases(spark, sf_of, odd, none):
    from quern.llm.lm import op7_backoff_automaton

    assert op7_backoff_automaton(spark, sf_of(documents=odd)).count() == 9
    assert op7_backoff_automaton(spark, sf_of(documents=none)).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_word_hashes_tell_words_apart():
    from quern.llm import words

    texts = ["", " ", "a B\tc\x0bd", "aB", "é É", None, "x" * (1 << 20) + " y", "p q " * 300_000, thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))]
    hashes = words.word_hashes(texts)
    for t, h in zip(texts, hashes):
        w = WORDS.findall((t or "").translate(LOWER))
        assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
    assert hashes[-1][0] != hashes[-2][0]


def test_words_that_defeat_polynomial_hashes(spark, sf_of):
    """A Thue-Morse word and its complement agree under every polynomial hash modulo a power of two."""
    from quern.llm.bpe import VOCABULARY, op4_bpe_codec
    from quern.llm.grammar import op5_repair_shards
    from quern.llm.lm import op7_backoff_automaton
    from quern.llm.neardup import op6_circulant_minhash

    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    texts = {0: one, 1: other, 2: " ".join([one] * 6), 3: " ".join([one, other] * 3), 4: f"{other} {other}", 5: other}
    sf = sf_of(documents=spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1))
    enc = ranks(VOCABULARY)
    for r in rows(op4_bpe_codec(spark, sf)):
        assert r["ids_sha256"] == hashlib.sha256(np.array(enc.encode_ordinary(texts[r["doc_id"]]), dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    crc = {r["doc_id"]: r["ids_crc32"] for r in rows(op5_repair_shards(spark, sf))}
    assert crc[0] != crc[1] and crc[1] == crc[5]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(op6_circulant_minhash(spark, sf))}
    assert got == brute_components(texts)
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 10]
    seen = {w for d in train for w in texts[d].split()}
    for r in rows(op7_backoff_automaton(spark, sf)):
        assert r["n_known"] == sum(w in seen for w in texts[r["doc_id"]].split()) + 1


# -- 8 quality -------------------------------------------------------------------------------------------------------


def brute_measures(t):
    t = t or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)} if len(windows) < 4000 else None
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), inside if inside is None else len(inside)


def test_measures_equal_brute_force(docs):
    from quern.llm.quality import measure

    for t in [t for _, t in docs if len(t) < 6000] + [None, "", " ", "a b c a b c a", "a a a a", "x\n\nx\n x\n", "é# ü|\u00a0z"]:
        assert measure(t) == brute_measures(t)


def test_quality_cases(spark, sf_of, odd, none):
    from quern.llm.quality import judge, keep_sound, op8_host_rules

    good = " ".join(f"word{i}" for i in range(60))
    bad = [(i, "short", "en", "bad.host", 0, "x", 1.0) for i in range(20, 60)]
    fine = [(i, f"{good} {i}", "en", "good.host", 0, "x", 1.0) for i in range(60, 100)] + [(100, good, "en", "bad.host", 0, "x", 1.0)]
    made = odd.unionByName(spark.createDataFrame(bad + fine, DOC))
    got = {r["doc_id"]: r for r in rows(op8_host_rules(spark, sf_of(documents=made)))}
    assert all(got[i]["kept"] for i in range(60, 100)) and not any(got[i]["kept"] for i in range(20, 60))
    assert not got[100]["base_failed"] and not got[100]["kept"] and got[100]["host_rate"] > 0.5
    assert sorted(r["doc_id"] for r in rows(keep_sound(made))) == sorted(r["doc_id"] for r in rows(judge(made, ["doc_id"])) if r["kept"])
    assert op8_host_rules(spark, sf_of(documents=none)).count() == 0


def test_quality_keeps_clashing_columns(spark):
    from quern.llm.quality import keep_sound

    good = " ".join(f"word{i}" for i in range(60))
    made = spark.createDataFrame([(1, good, "h", "a", "b", "c", 2), (2, good, None, None, "e", "f", 3)], "doc_id long, text string, source string, host string, host_ string, __host string, n_words long")
    assert sorted(map(tuple, keep_sound(made).collect())) == sorted(map(tuple, made.collect()))


# -- 9 sharding ------------------------------------------------------------------------------------------------------


def test_sharding_law(spark, sf_of, odd, none):
    from quern.llm.sharding import N_SHARDS, initial_map, op9_virtual_slots, rebalance, slot_bytes, slotted

    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.lit(1).alias("shard"))
    got = rows(op9_virtual_slots(spark, sf_of(documents=many)))
    size, slots = {}, {}
    for r in got:
        assert r["size"] == r["doc_id"] % 50 + 17 and r["text_crc32"] == zlib.crc32(b"x" * (r["doc_id"] % 50 + 1))
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(size) == set(range(N_SHARDS)) and max(size.values()) - min(size.values()) <= 150
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shared = many.withColumn("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id"))).withColumn("text", F.concat(F.hash(F.col("text"), F.rand(3)).cast("string"), "text"))
    load = {}
    for r in rows(op9_virtual_slots(spark, sf_of(documents=shared))):
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) < 1.05 * sum(load.values()) / N_SHARDS
    sizes = slot_bytes(slotted(many, 64), 64)
    one = rebalance(initial_map(spark, 4, 64), sizes, 4).cache()
    more = rebalance(one, sizes, 5)
    moved = [r["b"] for r in rows(one.select("virtual_slot", F.col("shard").alias("a")).join(more.select("virtual_slot", F.col("shard").alias("b")), "virtual_slot")) if r["a"] != r["b"]]
    assert 64 // 5 - 4 <= len(moved) <= 2 * 64 // 5 and moved.count(4) >= 0.7 * len(moved)
    assert more.select("version").first()[0] == 2
    assert op9_virtual_slots(spark, sf_of(documents=odd)).count() == 9
    assert op9_virtual_slots(spark, sf_of(documents=none)).count() == 0


# -- 10 toxicity -----------------------------------------------------------------------------------------------------


def test_block_max_search_is_exact():
    from quern.llm.toxicity import BlockMaxIndex

    rng = random.Random(6)

    def unit(terms):
        w = np.array([rng.random() for _ in terms])
        return np.array(sorted(terms), dtype=np.int64), w / math.sqrt((w * w).sum())

    made = [unit(rng.sample(range(20 * (k % 3), 20 * (k % 3) + 20), rng.randint(1, 6))) for k in range(700)]
    made += made[:50] + [(np.empty(0, dtype=np.int64), np.empty(0))] * 3
    index = BlockMaxIndex(made, 60)
    for (terms, weights), got in zip(made[::13], index.search(made[::13], 10)):
        d = dict(zip(terms.tolist(), weights.tolist()))
        full = sorted((-round(sum(d.get(t, 0.0) * w for t, w in zip(v.tolist(), x.tolist())), 12), i) for i, (v, x) in enumerate(made))
        assert [i for i, _ in got] == [i for s, i in full[:10] if s < 0] and all(abs(a + b) < 1e-9 for (_, a), (b, _) in zip(got, full))
    assert index.search(made[-1:], 10) == [[]] and BlockMaxIndex([], 60).search(made[:1], 5) == [[]]


def test_scores_equal_a_full_scan(spark, sf):
    """The operator's scores against TF-IDF, neighbours and votes worked out again by definition, on whole tables."""
    from quern.llm import toxicity as T

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    train = {r["doc_id"]: r["toxic"] for r in rows(labels) if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts}
    assert 10 < len(train) < T.TRAIN_ROWS
    model = T.fit(docs, labels)
    assert model.ids == sorted(train) and {0, 1} == set(model.labels)
    words = {d: re.findall(r"[^\W_]+", (t or "").lower()) for d, t in texts.items()}
    assert {w for d in train for w in words[d]} <= set(model.vocabulary.place)
    stars = {t for t in model.vocabulary.place if t.endswith("*")}
    bag = {d: {} for d in texts}
    for d, ws in words.items():
        for w in ws:
            for t in [w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) > n)]:
                if t in model.vocabulary.place:
                    bag[d][t] = bag[d].get(t, 0) + 1
    df, rows_, up = {}, {}, {}
    for d, b in bag.items():
        for t in b:
            df[t] = df.get(t, 0) + 1
            if d in train:
                rows_[t], up[t] = rows_.get(t, 0) + 1, up.get(t, 0) + train[d]
    n, toxic = len(train), sum(train.values())

    def weight(t):
        a, b = up[t], rows_[t] - up[t]
        c, d = toxic - a, n - toxic - b
        chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) if (a + b) * (c + d) * (a + c) * (b + d) else 0.0
        phi = math.sqrt(max(0.0, chi - 2 * math.log(n * 2000)) / n)
        assert phi > 0 or t not in stars
        return (math.log((1 + len(texts)) / (1 + df[t])) + 1) * (T.FLOOR + phi)

    weights = {t: weight(t) for t in model.vocabulary.place}

    def unit(b):
        v = {t: (1 + math.log(c)) * weights[t] for t, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {d: unit(bag[d]) for d in texts}
    got = {r["doc_id"]: r["score"] for r in rows(T.op10_toxic_neighbours(spark, sf))}
    for d, v in vectors.items():
        near = sorted(((-sum(x * vectors[e].get(t, 0.0) for t, x in v.items()), e) for e in train if e != d))[: T.NEIGHBOURS]
        near = [(-s, e) for s, e in near if s < 0]
        one = near[0][0] if near else 1.0
        want = (toxic / n * one + sum(s * train[e] for s, e in near)) / (one + sum(s for s, _ in near))
        assert abs(got[d] - want) < 1e-6


def test_held_out_accuracy(spark):
    from quern.llm.toxicity import op10_toxic_neighbours

    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in rows(table(spark, sf, "labels"))}
    got = [r for r in rows(op10_toxic_neighbours(spark, sf)) if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    print("held-out accuracy", sum(r["predicted"] == truth[r["doc_id"]] for r in got) / len(got), "of", len(got))
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) / len(got) > 0.93


def test_toxicity_cases(spark, sf_of, odd, none):
    from quern.llm.toxicity import fit, keep_clean, op10_toxic_neighbours

    clean = [(i, f"plain words number {i} here", "en", "h", 0, "x", 1.0) for i in range(100, 160)]
    nasty = [(i, f"you “grubbly” thing {i}", "en", "h", 0, "x", 1.0) for i in range(160, 200)]
    made = odd.unionByName(spark.createDataFrame(clean + nasty + [(500, "grubbly", "en", "h", 0, "x", 1.0)], DOC))
    labels = spark.createDataFrame([(i, 1, int(i >= 160)) for i in range(100, 200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(op10_toxic_neighbours(spark, sf_of(documents=made, labels=labels)))}
    assert got[500]["predicted"] == 1 and got[500]["evidence"] and not any(got[i]["predicted"] for i in range(6))
    kept = keep_clean(made, fit(made, labels))
    assert kept.columns == made.columns and {r["doc_id"] for r in rows(kept)} == {*range(8), *range(100, 160)}
    for d, lab in ((none, labels), (made, labels.limit(0))):
        assert op10_toxic_neighbours(spark, sf_of(documents=d, labels=lab)).where("predicted = 1").count() == 0


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages(spark, sf):
    import corpus_pipeline
    from quern.llm.decontam import blocks, matcher
    from quern.llm.quality import failed, measure
    from quern.llm.toxicity import fit

    docs = table(spark, sf, "documents")
    model = fit(docs, table(spark, sf, "labels"))
    left = {r["doc_id"]: r["text"] for r in rows(docs) if model.score_texts([r["doc_id"]], [r["text"]])[0][0] < 0.5}
    left = {d: t for d, t in left.items() if not failed(*measure(t))}
    left = {d: left[d] for d, (_, c) in brute_components(left, 80).items() if d == c}
    m = [matcher(b) for b in blocks(table(spark, sf, "benchmark"))]
    left = {d: t for d, t in left.items() if not any(x.find(t) for x in m)}
    got = rows(corpus_pipeline.run(spark, sf))
    assert sorted(r["doc_id"] for r in got) == sorted(left)
    assert all(r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest() for r in got)


def test_pipeline_cases(spark, sf_of, odd, none):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    for d in (odd, none):
        assert corpus_pipeline.run(spark, sf_of(documents=d, labels=labels, benchmark=bench)).count() == 0


def test_registry_names():
    from quern.llm import registry

    names = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries())
    assert names == list(range(1, 11))
