"""Subword tokenizers over word tables: training, encoding, fertility and round trips.

Spark counts words (lang, word, freq) and keeps them; merge loops see only a table of pairs, whose number the vocabulary
bounds, and encoding maps distinct pre-tokens once and joins counts back."""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from quern.functions import text as T
from quern.session import discard, materialise, prepare

Pair = tuple[str, str]
Merges = list[Pair]
Triple = tuple[int, int, int]
Changes = list[tuple[str, Pair | None, int]]


def word_counts(docs: DataFrame, lang: str = "lang", pieces=T.metaspace_pieces, keep: int | None = None) -> DataFrame:
    """lang, word, freq; `keep` bounds the distinct words a language brings to the merge loop, most frequent first."""
    counts = docs.select(F.col(lang).alias("lang"), F.explode(pieces(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("freq"))
    if keep is None:
        return counts
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("freq"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")


def pair_counts(counts: DataFrame) -> DataFrame:
    """lang, left, right, n: adjacent characters weighted by word frequency."""
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    pairs = counts.select("lang", "freq", chars.alias("c")).where(F.size("c") > 1)
    pairs = pairs.select("lang", "freq", "c", F.explode(F.sequence(F.lit(0), F.size("c") - 2)).alias("i"))
    return pairs.groupBy("lang", F.get("c", F.col("i")).alias("left"), F.get("c", F.col("i") + 1).alias("right")).agg(F.sum("freq").alias("n"))


def alphabet(counts: DataFrame) -> DataFrame:
    """All characters of all languages."""
    return counts.select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("char")).distinct()


class PairTable:
    """Weighted counts of adjacent tokens, tokens and words, by language: all that the choice of a merge needs. Its size is
    bounded by the vocabulary's pairs, not by the words."""

    def __init__(self):
        self.counts: dict[str | None, Counter] = defaultdict(Counter)  # None: all languages together
        self.tokens: Counter = Counter()
        self.total: Counter = Counter()

    def copy(self) -> PairTable:
        out = PairTable()
        out.counts = defaultdict(Counter, {lang: Counter(c) for lang, c in self.counts.items()})
        out.tokens, out.total = Counter(self.tokens), Counter(self.total)
        return out

    def add(self, changes: Changes, scale: dict[str, float] | None = None) -> None:
        for lang, pair, n in changes:
            n = n * scale[lang] if scale else n
            if pair is None:
                self.tokens[lang] += n
                continue
            for c in (self.counts[lang], self.counts[None]):
                c[pair] += n
                if c[pair] == 0:
                    del c[pair]

    def best(self, lang: str | None = None) -> tuple[int, Pair] | None:
        """The most frequent pair of a language, or of all together; ties to the smaller pair."""
        c = self.counts[lang]
        top = max(c.values(), default=0)
        return (top, min(p for p, n in c.items() if n == top)) if top > 0 else None

    def fertility(self) -> dict[str, float]:
        return {lang: self.tokens[lang] / max(self.total[lang], 1) for lang in sorted(self.total)}


def _pack(langs: list[str], size: int = 400_000):
    """lang, word, freq as blocks of so many symbols: code points with -1 after each word, and a language and a weight a word."""
    code = {x: i for i, x in enumerate(langs)}

    def block(words, lang, freq):
        flat = np.frombuffer("\n".join(words).encode("utf-32-le"), np.int32).copy() if words else np.zeros(0, np.int32)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        sym = np.append(flat, -1).astype(np.int32)
        sym[ends] = -1
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sym, np.array(lang, np.int32), np.array(freq, np.int64))], ["sym", "lang", "freq"])

    def run(batches):
        words, lang, freq, n = [], [], [], 0
        for b in batches:
            new = b.column("word").to_pylist()
            words += new
            lang += [code[x] for x in b.column("lang").to_pylist()]
            freq += b.column("freq").to_pylist()
            n += sum(map(len, new))
            if n >= size:
                yield block(words, lang, freq)
                words, lang, freq, n = [], [], [], 0
        if words:
            yield block(words, lang, freq)

    return run


def _blocks(batches):
    """sym, and lang and freq of each word."""
    for b in batches:
        for sym, lang, freq in zip(*(b.column(n).to_pylist() for n in ("sym", "lang", "freq"))):
            yield np.frombuffer(sym, np.int32), np.frombuffer(lang, np.int32).astype(np.int64), np.frombuffer(freq, np.int64)


def _owners(sym: np.ndarray) -> np.ndarray:
    """The word that each place belongs to."""
    return np.concatenate([[0], np.cumsum(sym == -1)[:-1]]).astype(np.int32)


def _replace(sym: np.ndarray, a: int, b: int, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """a b becomes c from left to right: the new array, the places merged at, and which places stay (None: all)."""
    p = np.flatnonzero(sym[1:] == b)
    p = p[sym[p] == a]
    if a == b and len(p) > 1:  # within a run of one symbol every other place
        starts = np.flatnonzero(np.concatenate([[True], np.diff(p) != 1]))
        p = p[(np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))) % 2 == 0]
    if not len(p):
        return sym, p, None
    keep = np.ones(len(sym), bool)
    keep[p + 1] = False
    out = sym[keep]
    out[p - np.arange(len(p))] = c
    return out, p, keep


def _replaced(sym: np.ndarray, merges: list[Triple]) -> np.ndarray:
    for x in merges:
        sym = _replace(sym, *x)[0]
    return sym


def _merge(sym: np.ndarray, word: np.ndarray, a: int, b: int, c: int):
    """_replace with the words that places belong to: the new arrays, the words merged in (once per place), and the changed
    pairs as places of the old and of the new array."""
    out, p, keep = _replace(sym, a, b, c)
    if keep is None:
        return sym, word, p, p, p
    q = p - np.arange(len(p))
    old, new = np.unique(np.concatenate([p - 1, p, p + 1])), np.unique(np.concatenate([q - 1, q]))
    return out, word[keep], word[p], old[old >= 0], new[new >= 0]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    n = np.add.reduceat(n, first)
    return keys[first][n != 0], n[n != 0]


def _keys(sym, word, at, lang, freq):
    """Pairs at the given places as one integer each, with their weights; pairs across words are left out."""
    at = at[at < len(sym) - 1]
    at = at[(sym[at] >= 0) & (sym[at + 1] >= 0)]
    w = word[at]
    return lang[w] << 42 | sym[at].astype(np.int64) << 21 | sym[at + 1], freq[w]


def _trace(sym, word, lang, freq, merges: list[Triple], pairs: bool = True):
    """Apply merges one by one; yields the arrays and, as keys and sums, the changed pair counts and (key: language) tokens."""
    for a, b, c in merges:
        out, places, hit, old, new = _merge(sym, word, a, b, c)
        k, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if pairs and len(hit):
            (k0, n0), (k1, n1) = _keys(sym, word, old, lang, freq), _keys(out, places, new, lang, freq)
            k, n = _summed(np.concatenate([k0, k1]), np.concatenate([-n0, n1]))
        sym, word = out, places
        yield sym, word, k, n, *_summed(lang[hit], -freq[hit])


def _advance(merges: list[Triple]):
    def run(batches):
        for sym, lang, freq in _blocks(batches):
            sym = _replaced(sym, merges)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sym, lang.astype(np.int32), freq)], ["sym", "lang", "freq"])

    return run


def _open(merges: list[Triple], names: dict[int, str], which: int, most: int):
    """The most frequent words of a language in each block that are still several tokens."""

    def run(batches):
        for sym, lang, freq in _blocks(batches):
            sym = _replaced(sym, merges)
            ends = np.flatnonzero(sym == -1)
            starts = np.append(0, ends[:-1] + 1)
            at = np.flatnonzero((lang == which) & (ends - starts > 1))
            if len(at) > most:  # all that tie with the last
                at = at[freq[at] >= np.partition(freq[at], len(at) - most)[len(at) - most]]
            tokens = [[names[i] if i >= 0x110000 else chr(i) for i in sym[starts[w] : ends[w]].tolist()] for w in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(freq[at]), pa.array(["".join(t) for t in tokens], pa.string()), pa.array(tokens, pa.list_(pa.string()))], ["freq", "word", "tokens"])

    return run


def _measure(done: list[Triple], merges: list[Triple], pairs: bool, first: bool):
    """step, lang (its number), pair (left and right as one integer, or -1 for tokens, -2 for words), n."""

    def run(batches):
        for sym, lang, freq in _blocks(batches):
            sym = _replaced(sym, done)
            word = _owners(sym)
            rows = []
            if first:
                real = word[sym >= 0]
                rows += [(-1, *_summed(*_keys(sym, word, np.arange(len(sym)), lang, freq)), 0), (-1, *_summed(lang[real], freq[real]), -1), (-1, *_summed(lang, freq), -2)]
            for i, (_, _, k, n, tk, tn) in enumerate(_trace(sym, word, lang, freq, merges, pairs)):
                rows += [(i, k, n, 0), (i, tk, tn, -1)]
            if rows:
                which = np.concatenate([k if kind else k >> 42 for _, k, _, kind in rows])
                pair = np.concatenate([np.full(len(k), kind) if kind else k & ((1 << 42) - 1) for _, k, _, kind in rows])
                step = np.repeat(np.array([x[0] for x in rows], np.int32), [len(x[1]) for x in rows])
                n = np.concatenate([x[2] for x in rows])
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(which.astype(np.int32)), pa.array(pair.astype(np.int64)), pa.array(n)], ["step", "lang", "pair", "n"])

    return run


class Trainer:
    """Merges over words that stay on the executors, exactly as if they were made one at a time.

    The driver holds the pair table, a sample of the most frequent words (SAMPLE of them) and the merges. The sample foretells
    the next merges; one pass over all words measures what each of them changes, and the driver makes them as long as each is
    the choice that the exact table gives. At the first that is not, the rest is foretold anew, from exact counts. So the
    sample decides how many passes there are, never which merges are made. Word states are written out every REWRITE merges."""

    SAMPLE, REWRITE, AHEAD = 20_000, 16, 64

    def __init__(self, counts: DataFrame, weights: dict[str, int] | None = None):
        prepare(counts.sparkSession, 10_000)
        weight = F.lit(1)
        for lang, n in (weights or {}).items():
            weight = F.when(F.col("lang") == lang, n).otherwise(weight)
        words = counts.where("lang is not null and word is not null").select("lang", "word", (F.col("freq") * weight).cast("long").alias("freq"))
        self.langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
        self.schema = "sym binary, lang binary, freq binary"
        self.words = materialise(words.mapInArrow(_pack(self.langs), self.schema), "words")
        self.ids: dict[str, int] = {}
        self.pending: list[Triple] = []  # made since the words were written
        self.ahead: deque[tuple[Pair, Changes]] = deque()
        self.limit = self.AHEAD
        self.table = PairTable()
        start = self._pass([], first=True)[-1]
        self.table.add([x for x in start if x[1] != ()])
        for lang, pair, n in start:
            if pair == ():
                self.table.total[lang] += n
        self._sample(words)

    def _sample(self, words: DataFrame) -> None:
        top = words.where(F.length("word") <= 64).orderBy(F.desc("freq"), "lang", "word").limit(self.SAMPLE).collect()
        code = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([code[r["lang"]] for r in top], np.int64)
        self.freq = np.array([r["freq"] for r in top], np.int64)
        self.sym = np.array([x for r in top for x in [*map(ord, r["word"]), -1]], np.int32)
        self.word = _owners(self.sym) if top else self.sym
        seen = Counter()
        for r in top:
            seen[r["lang"]] += r["freq"]
        self.scale = {x: self.table.total[x] / max(seen[x], 1) for x in self.langs}

    def _id(self, token: str) -> int:
        """A character's code point, else a number given when the token was first made."""
        return ord(token) if len(token) == 1 else self.ids.setdefault(token, 0x110000 + len(self.ids))

    def _triple(self, pair: Pair) -> Triple:
        return self._id(pair[0]), self._id(pair[1]), self._id(pair[0] + pair[1])

    def _named(self, keys, sums) -> Changes:
        names = {i: t for t, i in self.ids.items()}
        name = lambda i: names[i] if i >= 0x110000 else chr(i)
        return [(self.langs[k >> 42], (name(k >> 21 & 0x1FFFFF), name(k & 0x1FFFFF)), n) for k, n in zip(keys.tolist(), sums.tolist())]

    def _pass(self, merges: list[Pair], pairs: bool = True, first: bool = False) -> dict[int, Changes]:
        """One pass over all words: what each merge changes, summed before anything reaches the driver."""
        triples = [self._triple(p) for p in merges]
        if len(self.pending) >= self.REWRITE:
            old, self.words = self.words, materialise(self.words.mapInArrow(_advance(self.pending), self.schema), "words")
            discard(old)
            self.pending = []
        found = self.words.mapInArrow(_measure(list(self.pending), triples, pairs, first), "step int, lang int, pair long, n long")
        out: dict[int, Changes] = defaultdict(list)
        for r in found.groupBy("step", "lang", "pair").agg(F.sum("n").alias("n")).where("n <> 0").collect():
            if r["pair"] < 0:
                out[r["step"]].append((self.langs[r["lang"]], None if r["pair"] == -1 else (), r["n"]))
            else:
                out[r["step"]] += self._named(np.array([r["lang"] << 42 | r["pair"]]), np.array([r["n"]]))
        return out

    def _foretell(self, choose, done: int, most: int) -> list[Pair]:
        guess, sym, word, out = self.table.copy(), self.sym, self.word, []
        while len(out) < most and (pair := choose(guess, done + len(out))):
            sym, word, k, n, tk, tn = next(_trace(sym, word, self.lang, self.freq, [self._triple(pair)]))
            changes = [x for x in self._named(k, n) if x[1] != pair] + [(self.langs[i], None, x) for i, x in zip(tk.tolist(), tn.tolist())]
            guess.add(changes, self.scale)
            for c in guess.counts.values():
                c.pop(pair, None)
            out.append(pair)
        return out

    def _made(self, pair: Pair, changes: Changes) -> None:
        self.table.add(changes)
        t = self._triple(pair)
        self.sym, self.word, *_ = _merge(self.sym, self.word, *t)
        self.pending.append(t)

    def run(self, n: int, choose) -> Merges:
        """At most n merges; choose(table, number made) gives the next pair or None."""
        merges: Merges = []
        while len(merges) < n and (pair := choose(self.table, len(merges))):
            if not self.ahead or self.ahead[0][0] != pair:
                if merges:
                    self.limit = min(max(2 * self.since, 8), 4 * self.AHEAD)
                plan = self._foretell(choose, len(merges), min(self.limit, n - len(merges)))
                found = self._pass(plan)
                self.ahead, self.since = deque((p, found.get(i, [])) for i, p in enumerate(plan)), 0
            self._made(*self.ahead.popleft())
            self.since += 1
            merges.append(pair)
        self.ahead.clear()
        return merges

    def apply(self, merges: Merges) -> None:
        """Make given merges; pair counts are not kept after this, tokens are."""
        for i in range(0, len(merges), 256):
            part = merges[i : i + 256]
            found = self._pass(part, pairs=False)
            for j, p in enumerate(part):
                self._made(p, found.get(j, []))

    def open_words(self, lang: str, most: int) -> list[list[str]]:
        """The most frequent words of a language that are still several tokens, as their tokens."""
        names = {i: t for t, i in self.ids.items()}
        found = self.words.mapInArrow(_open(list(self.pending), names, self.langs.index(lang), most), "freq long, word string, tokens array<string>")
        return [r["tokens"] for r in found.orderBy(F.desc("freq"), "word").limit(most).collect()]

    def close(self) -> None:
        discard(self.words)


def _most_frequent(least: int):
    def choose(table: PairTable, _: int) -> Pair | None:
        top = table.best()
        return top[1] if top and top[0] >= least else None

    return choose


def train_bpe(counts: DataFrame, n_merges: int, weights: dict[str, int] | None = None, least: int = 2) -> Merges:
    """Joint merges over all languages, a language's counts times its weight."""
    t = Trainer(counts, weights)
    merges = t.run(n_merges, _most_frequent(least))
    t.close()
    return merges


def train_parity(counts: DataFrame, n_merges: int, cap: tuple[str, int] | None = None) -> Merges:
    """Each merge is the top pair of the language with the worst fertility and applies to all; cap gives one language its
    first merges."""

    def choose(table: PairTable, done: int) -> Pair | None:
        if cap and done < cap[1]:
            order = [cap[0]]
        else:
            order = [lang for _, lang in sorted((-f, lang) for lang, f in table.fertility().items())]
        return next((b[1] for lang in order if (b := table.best(lang)) and b[0] >= 2), None)

    t = Trainer(counts)
    merges = t.run(n_merges, choose)
    t.close()
    return merges


def train_disjoint(counts: DataFrame, budgets: dict[str, int]) -> Merges:
    """Merges trained apart for each language, united in order; the first place of a merge holds."""
    seen: dict[Pair, None] = {}
    for lang, n in sorted(budgets.items()):
        for m in train_bpe(counts.where(F.col("lang") == lang), n):
            seen.setdefault(m)
    return list(seen)


def water_fill(counts: DataFrame, budget: int, chunk: int = 150) -> dict[str, int]:
    """Vocabulary shares: each chunk goes to the language whose tokens it lowers most per word."""
    langs = sorted(r["lang"] for r in counts.where("lang is not null").select("lang").distinct().collect())
    trainers = {lang: Trainer(counts.where(F.col("lang") == lang)) for lang in langs}
    given = dict.fromkeys(trainers, 0)

    def gain(lang: str) -> float:
        table = trainers[lang].table
        top = table.best()
        return top[0] / max(table.total[lang], 1) if top else 0.0

    while budget > 0 and trainers:
        lang = max(sorted(trainers), key=gain)
        if gain(lang) <= 0:
            break
        n = min(chunk, budget)
        trainers[lang].run(n, _most_frequent(1))
        given[lang] += n
        budget -= n
    for t in trainers.values():
        t.close()
    return given


def reclaim_words(counts: DataFrame, merges: Merges, rounds: int = 80, per_round: int = 120) -> Merges:
    """Round by round, the worst language's most frequent words that are still several tokens become one."""
    t, out = Trainer(counts), list(merges)
    known = set(merges)
    t.apply(merges)
    for _ in range(rounds):
        fertility = t.table.fertility()
        worst = max(fertility, key=fertility.get, default=None)
        open_ = t.open_words(worst, per_round) if worst is not None else []
        if not open_:
            break
        made: Merges = []
        for w in open_:
            for p in made:
                w[:] = split_word(w, {p: 0})
            while len(w) > 1:
                pair = (w[0], w[1])
                made.append(pair)
                w[:] = split_word(w, {pair: 0})
        out += [p for p in dict.fromkeys(made) if p not in known]
        known.update(made)
        t.apply(made)
    t.close()
    return out


def split_word(word: str | list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Lowest rank first, all its places from left to right."""
    w = list(word)
    while len(w) > 1:
        best = min(((ranks[p], p) for p in zip(w, w[1:]) if p in ranks), default=None)
        if best is None:
            break
        (a, b), out, k = best[1], [], 0
        while k < len(w):
            hit = k + 1 < len(w) and w[k] == a and w[k + 1] == b
            out.append(a + b if hit else w[k])
            k += 2 if hit else 1
        w = out
    return w


def encoder(merges: Merges):
    """An Arrow UDF: pieces of a word, distinct words remembered."""
    ranks = {p: i for i, p in enumerate(merges)}

    @pandas_udf(ArrayType(StringType()))
    def encode(words):
        known = lru_cache(maxsize=100_000)(lambda w: split_word(w, ranks))
        return words.map(lambda w: None if w is None else known(w))

    return encode


def train_bytes(counts: DataFrame, n_merges: int) -> Merges:
    """Byte-level merges: words as Latin-1 views of their UTF-8 bytes."""
    raw = counts.select("lang", F.decode(F.encode("word", "UTF-8"), "ISO-8859-1").alias("word"), "freq")
    return train_bpe(raw, n_merges)


def fertility(counts: DataFrame, merges: Merges) -> DataFrame:
    """lang, tokens, words, fertility from distinct words. Where each merge joins characters or tokens of earlier merges and no
    two make the same token, making the merges in order is the same as lowest rank first (a pair can't come back after its
    turn), and whole blocks of words are merged at once."""
    place = {a + b: i for i, (a, b) in enumerate(merges)}
    if len(place) < len(merges) or any(len(t) > 1 and place.get(t, i) >= i for i, pair in enumerate(merges) for t in pair):
        enc = counts.withColumn("n", F.size(encoder(merges)("word")))
        sums = enc.groupBy("lang").agg(F.sum(F.col("n") * F.col("freq")).alias("tokens"), F.sum("freq").alias("words"))
    else:
        sums = counts.mapInArrow(_token_sums(merges), "lang string, tokens long, words long").groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    return sums.withColumn("fertility", F.col("tokens") / F.col("words"))


def _token_sums(merges: Merges):
    made = {a + b: 0x110000 + i for i, (a, b) in enumerate(merges)}
    triples = [tuple(made[t] if len(t) > 1 else ord(t) for t in (a, b, a + b)) for a, b in merges]

    def run(batches):
        for b in batches:
            langs = sorted(set(b.column("lang").to_pylist()), key=lambda x: (x is not None, x))
            words = pa.RecordBatch.from_arrays([b.column("lang"), b.column("word").fill_null(""), b.column("freq")], ["lang", "word", "freq"])
            for sym, lang, freq in _blocks(_pack(langs)([words])):
                total, tokens = np.zeros(len(langs), np.int64), np.zeros(len(langs), np.int64)
                sym = _replaced(sym, triples)
                word = _owners(sym)
                np.add.at(total, lang, freq)
                np.add.at(tokens, lang[word[sym >= 0]], freq[word[sym >= 0]])
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(tokens), pa.array(total)], ["lang", "tokens", "words"])

    return run


def parity(f: DataFrame, reference: str = "en") -> DataFrame:
    """Premium over one language, spread, score and penalty over all."""
    one = f.agg(F.max(F.when(F.col("lang") == reference, F.col("fertility"))).alias("ref"), (F.max("fertility") - F.min("fertility")).alias("spread"), F.avg(F.when(F.col("lang") != reference, F.col("fertility"))).alias("mean_others"))
    return f.join(F.broadcast(one)).select(
        "lang", "fertility", (F.col("fertility") / F.col("ref")).alias("premium"), "spread", F.when(F.col("spread") > 0, 1000 / F.col("spread")).otherwise(float("inf")).alias("score"),
        F.exp(F.greatest(F.lit(0.0), F.col("fertility") / 1.2 - 1)).alias("penalty"), "mean_others",
    )


def round_trip(docs: DataFrame, merges: Merges) -> DataFrame:
    """doc_id, ok: visible text survives pieces and joining them again, under NFKC."""
    pieces = F.transform(T.metaspace_pieces(T.nfkc(F.col("text"))), lambda p: p)
    exploded = docs.select("doc_id", F.posexplode(pieces).alias("i", "word"))
    coded = exploded.withColumn("back", F.array_join(encoder(merges)("word"), ""))
    back = coded.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "back"))), lambda x: x.back), "").alias("back"))
    got = docs.select("doc_id", T.visible(T.nfkc(F.col("text"))).alias("want")).join(back, "doc_id", "left")
    return got.select("doc_id", (F.col("want") == T.visible(F.replace(F.coalesce("back", F.lit("")), F.lit("▁"), F.lit(" ")))).alias("ok"))


def sweep(counts: DataFrame, sizes: list[int], reference: str = "en", done: DataFrame | None = None, held_out: DataFrame | None = None) -> DataFrame:
    """Fertility at several vocabulary sizes, on held-out words where given: one training to the largest, prefixes of its
    merges for the others. Sizes that `done` already has are skipped."""
    skip = {r["size"] for r in done.select("size").distinct().collect()} if done is not None else set()
    merges = train_bpe(counts, max(sizes))
    out = None
    for n in sizes:
        if n in skip:
            continue
        one = parity(fertility(counts if held_out is None else held_out, merges[:n]), reference).select(F.lit(n).alias("size"), "lang", "fertility", "premium", "mean_others")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else done.limit(0)


def grid(counts: DataFrame, weights: list[dict[str, int]], n_merges: int) -> pd.DataFrame:
    """Joint merges for each weighting; spread and score, feasible and best first."""
    rows = []
    for i, w in enumerate(weights):
        t = Trainer(counts, w)
        t.run(n_merges, _most_frequent(2))
        f = t.table.fertility()
        t.close()
        spread = max(f.values()) - min(f.values()) if f else math.inf
        rows.append((i, spread, 1000 / spread if spread else math.inf))
    return pd.DataFrame(rows, columns=["cell", "spread", "score"]).sort_values(["spread", "cell"])
