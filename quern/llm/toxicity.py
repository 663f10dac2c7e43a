"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index (operator 10).

A bounded sample of labelled rows (TRAIN_ROWS rows and TRAIN_BYTES bytes of text, none of over a sixteenth of that, by hash
of doc_id; documented parameters) gives the examples, clean and toxic ones. Terms are all words of all examples, lower-cased, and those word beginnings of 4 to
7 letters that the labels depend on. A term weighs (1 + ln tf) * idf * (FLOOR + relevance): idf counts all documents of
the corpus, and relevance is the phi coefficient of term and label, 0 unless the chi-square statistic passes a bound that
grows with the number of examples. So no word is left out, and words that tell the labels apart weigh most.

The index cuts postings into blocks of BLOCK examples and keeps each block's largest weight by term. Examples that
share their most frequent word and label are neighbours in it, so blocks differ by language. A search bounds every block, scores the
best few, and then those blocks that can still reach the k-th best; its result equals a full scan's. Votes weigh by cosine;
a prior worth one neighbour (the share of toxic examples) calibrates the score.

Defined cases: null or empty texts and texts of unknown words get the prior; equal cosines go to the smaller example; a
document is never its own evidence; repeated doc_ids give one example (its smallest words) and are each scored; without
labels the score is 0; an empty table gives an empty result; very long texts are scored whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from weakref import WeakSet

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import worker
from quern.session import materialise, prepare, table

TRAIN_ROWS, TRAIN_BYTES = 4000, 1 << 26
FLOOR = 0.01
NEIGHBOURS = 25
BLOCK = 64
#: Blocks that a search scores before it has a bound.
FIRST_BLOCKS = 4
#: Texts searched for at once.
TOGETHER = 128
#: Examples that a term written out has at least, and more than sums of double precision err by.
FREQUENT, SLACK = 128, 1e-12
HELD_OUT_MOD = 5
#: Words whose terms a worker remembers; bounds memory, not results.
REMEMBERED = 150_000
_WORD = re.compile(r"[^\W_]+")
_BEGINNINGS = (4, 5, 6, 7)
#: ASCII bytes other than letters and digits become blanks.
_MARKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD == 0


def runs_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of other characters than ASCII white space and marks: words, or several with other marks between."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def beginnings(word: str) -> list[str]:
    """Beginnings of a word, marked with a star."""
    return [word[:n] + "*" for n in _BEGINNINGS if len(word) > n]


_vocabularies: WeakSet = WeakSet()
worker.remembers(__name__, lambda: [v.forget() for v in _vocabularies])


class Vocabulary:
    """Terms and their places; a word's terms are the word and its beginnings, as far as they are terms."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.first: dict[bytes, int] = {}
        self.more: dict[bytes, tuple[int, ...]] = {}

    def forget(self) -> None:
        self.first.clear()
        self.more.clear()

    def _learn(self, run: bytes) -> int:
        text = run.decode("utf-8", "surrogatepass")
        place = self.place
        found = [place[t] for w in ([text] if run.isalnum() else _WORD.findall(text)) for t in (w, *beginnings(w)) if t in place]
        if len(found) > 1:
            self.more[run] = tuple(found[1:])
        self.first[run] = found[0] if found else -1
        return self.first[run]

    def counts(self, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term places, rising, and how often the counted runs have them."""
        if len(self.first) > REMEMBERED:
            self.forget()
        first, more, learn = self.first, self.more, self._learn
        places = [first[w] if w in first else learn(w) for w in words]
        n = list(words.values())
        for w, k in [(w, k) for w, k in words.items() if w in more]:
            places += more[w]
            n += [k] * len(more[w])
        at, held = np.array(places, dtype=np.int64), np.array(n, dtype=np.int64)
        order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
        at, held = at[order], held[order]
        edge = np.flatnonzero(np.diff(at, prepend=-1))
        return (at, held) if len(edge) == len(at) else (at[edge], np.add.reduceat(held, edge))

    def __getstate__(self):
        return {"place": self.place, "first": {}, "more": {}}

    def __setstate__(self, state):
        self.__dict__ |= state
        _vocabularies.add(self)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Postings by term, in blocks of BLOCK examples. vectors: (term places, weights) of each example, places rising. Postings
    of terms that more than FREQUENT examples have are written out, block by block, with each block's largest weight;
    those of other terms are so few that a search adds them up at once and takes each block's largest sum."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, labels: list[int] | None = None):
        self.n, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        common = np.bincount(np.concatenate([np.empty(0, dtype=np.int64), *(t for t, _ in vectors)]), minlength=n_terms)
        lead = [(-common[t].max(), t[common[t].argmax()]) if len(t) else (0, -1) for t, _ in vectors]
        self.order = np.array(sorted(range(self.n), key=lambda i: (*lead[i], labels[i] if labels else 0, len(vectors[i][0]), i)), dtype=np.int64)
        terms = np.concatenate([np.empty(0, dtype=np.int64), *(vectors[i][0] for i in self.order)])
        weights = np.concatenate([np.empty(0), *(vectors[i][1] for i in self.order)])
        by_term = np.argsort(terms, kind="stable")
        at = np.repeat(np.arange(self.n), np.array([len(vectors[i][0]) for i in self.order], dtype=np.int64))[by_term]
        weights, terms = weights[by_term], terms[by_term]
        frequent = np.flatnonzero(common > FREQUENT)
        self.row_of = np.full(n_terms, -1, dtype=np.int64)
        self.row_of[frequent] = np.arange(len(frequent))
        often = self.row_of[terms] >= 0
        self.tiles = np.zeros((self.blocks, len(frequent), BLOCK))
        self.tiles[at[often] // BLOCK, self.row_of[terms[often]], at[often] % BLOCK] = weights[often]
        self.maxima = np.ascontiguousarray(self.tiles.max(axis=2).T) if len(frequent) else np.zeros((0, self.blocks))
        self.at, self.weights = at[~often], weights[~often]
        self.cuts = np.searchsorted(terms[~often], np.arange(n_terms + 1))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[int, float]]]:
        """Of each query the k examples of largest cosine above 0, ties (to twelve places) to the smaller place."""
        n, size = len(queries), self.blocks * BLOCK
        frequent = np.zeros((n, len(self.maxima)))
        rare = np.zeros((n, size))
        for i, (terms, weights) in enumerate(queries):
            row = self.row_of[terms]
            often = row >= 0
            frequent[i, row[often]] = weights[often]
            few, held = terms[~often], weights[~often]
            sizes = self.cuts[few + 1] - self.cuts[few]
            postings = ranges(self.cuts[few], sizes)
            rare[i] = np.bincount(self.at[postings], self.weights[postings] * np.repeat(held, sizes), minlength=size)
        rare = rare.reshape(n, self.blocks, BLOCK)
        bound = frequent @ self.maxima + rare.max(axis=2) + SLACK
        scores = np.full((n, self.blocks, BLOCK), -1.0)

        def visit(chosen: np.ndarray) -> np.ndarray:
            """Scores the chosen blocks of each query; the k-th best score of each."""
            for b in range(self.blocks):
                who = np.flatnonzero(chosen[:, b])
                if len(who):
                    scores[who, b] = rare[who, b] + frequent[who] @ self.tiles[b]
            flat = scores.reshape(n, size)
            return np.partition(flat, size - k, axis=1)[:, size - k : size - k + 1] - SLACK if size >= k else np.full((n, 1), -1.0)

        first = np.zeros((n, self.blocks), dtype=bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        least = visit(first)
        least = visit(~first & (bound > 2 * SLACK) & (bound >= least))
        out = []
        for s, m in zip(scores.reshape(n, size), least[:, 0]):
            some = np.flatnonzero((s > SLACK) & (s >= m))
            best = sorted(zip((-np.round(s[some], 12)).tolist(), self.order[some].tolist()))[:k]
            out.append([(i, -x) for x, i in best])
        return out


class Model:
    """Everything that scoring needs; its size is bounded by TRAIN_ROWS and TRAIN_BYTES.
    examples: (doc_id, label, text's term places and counts); weight: of each term, idf and relevance."""

    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray, examples: list[tuple]):
        self.vocabulary, self.weight = vocabulary, weight
        self.ids, self.labels = [e[0] for e in examples], [e[1] for e in examples]
        self.prior = sum(self.labels) / len(examples) if examples else 0.0
        self.index = BlockMaxIndex([self.vector(e[2], e[3]) for e in examples], len(weight), self.labels)

    def vector(self, places: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector: term places, rising, and weights."""
        raw = (1 + np.log(n)) * self.weight[places]
        norm = math.sqrt(float((raw * raw).sum()))
        return (places, raw / norm) if norm else (places[:0], raw[:0])

    def score(self, doc_ids: list, counted: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[int, float]]]]:
        """The score and the three nearest examples of each text, given as term places and counts."""
        out = []
        for i in range(0, len(counted), TOGETHER):
            found = self.index.search([self.vector(*c) for c in counted[i : i + TOGETHER]], NEIGHBOURS + 1)
            for doc_id, near in zip(doc_ids[i : i + TOGETHER], found):
                near = [(j, s) for j, s in near if self.ids[j] != doc_id][:NEIGHBOURS]
                one = near[0][1] if near else 1.0
                up, all_ = self.prior * one + sum(s * self.labels[j] for j, s in near), one + sum(s for _, s in near)
                out.append((min(1.0, max(0.0, up / all_)), [(self.ids[j], s) for j, s in near[:3]]))
        return out

    def score_texts(self, doc_ids: list, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        return self.score(doc_ids, [self.vocabulary.counts(Counter(runs_of(t))) for t in texts])

    def __getstate__(self):
        return self.__dict__ | {"vocabulary": None}  # tasks that need it get it apart


def _bags(batches):
    for b in batches:
        found = [sorted(Counter(words_of(t)).items()) for t in b.column("text").to_pylist()]
        cols = [pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *cols], names=["doc_id", "toxic", "words", "counts"])


def _counted(shared):
    def run(batches):
        worker.begin(__name__)
        vocabulary = shared.value
        for b in batches:
            found = [vocabulary.counts(Counter(runs_of(t))) for t in b.column("text").to_pylist()]
            cols = [pa.array([x[i].astype("<i4").tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "places", "counts"])

    return run


def numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<i4").astype(np.int64) for x in column.to_pylist()]


def _document_frequency(n_terms: int, words=None):
    """Arrow mapper: in how many documents each term is, from places or, with the vocabulary, from texts."""

    def run(batches):
        worker.begin(__name__)
        df = np.zeros(n_terms, dtype=np.int64)
        docs = 0
        for b in batches:
            docs += b.num_rows
            found = numbers(b.column(0)) if words is None else [words.value.counts(Counter(runs_of(t)))[0] for t in b.column(0).to_pylist()]
            df += np.bincount(np.concatenate([np.empty(0, dtype=np.int64), *found]), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], docs))], names=["place", "df"])

    return run


def relevance(n: np.ndarray, up: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """Phi coefficient of each term (in n of the rows, up of them toxic) with the label, as far as chi-square passes a bound."""
    a, b = up.astype(float), (n - up).astype(float)
    c, d = toxic - a, rows - toxic - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    chi = np.divide(rows * (a * d - b * c) ** 2, below, out=np.zeros(len(a)), where=below > 0)
    return np.sqrt(np.maximum(0.0, chi - 2 * math.log(max(rows, 1) * 100 / 0.05)) / max(rows, 1))


def features(docs: DataFrame, shared) -> DataFrame:
    """doc_id, and the places and counts of every document's terms as little-endian 32-bit numbers. shared: the vocabulary."""
    return docs.select("doc_id", "text").mapInArrow(_counted(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, places binary, counts binary")


class Sample:
    """Labelled texts as counted words: ids, labels, and of text i the words codes[cuts[i]:cuts[i + 1]] with their counts."""

    def __init__(self, bags: pa.Table):
        text = [bags.column(c).combine_chunks() for c in ("words", "counts")]
        words = text[0].flatten().dictionary_encode()
        ids, sizes = bags.column("doc_id").to_pylist(), np.diff(text[0].offsets.to_numpy())
        codes, counts = words.indices.to_numpy(), text[1].flatten().to_numpy()
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        self.words: list[str] = words.dictionary.to_pylist()
        one: dict = {}
        for i, d in enumerate(ids):
            if d in one:  # the smallest words of a repeated doc_id
                key = lambda j: sorted(zip((self.words[c] for c in codes[cuts[j] : cuts[j + 1]]), counts[cuts[j] : cuts[j + 1]].tolist()))
                i = min(i, one[d], key=key)
            one[d] = i
        rows = [one[d] for d in sorted(one)]
        labels = bags.column("toxic").to_pylist()
        self.ids, self.labels = sorted(one), np.array([labels[i] for i in rows], dtype=np.int64)
        self.codes = np.concatenate([np.empty(0, dtype=codes.dtype), *(codes[cuts[i] : cuts[i + 1]] for i in rows)])
        self.counts = np.concatenate([np.empty(0, dtype=counts.dtype), *(counts[cuts[i] : cuts[i + 1]] for i in rows)])
        self.cuts = np.concatenate([[0], np.cumsum(sizes[rows])]).astype(np.int64) if rows else np.zeros(1, dtype=np.int64)

    def terms(self) -> tuple[Vocabulary, np.ndarray]:
        """All words of the texts and the beginnings that matter, and their relevance."""
        rows, toxic = len(self.ids), int(self.labels.sum())
        row = np.repeat(np.arange(rows), np.diff(self.cuts))
        held: list[str] = []
        phis: list[np.ndarray] = []

        def add(terms: list[str], of_code: np.ndarray, matter: bool) -> None:
            """Terms with the relevance of the rows that have them; of_code: a word's term, -1 if it has none."""
            term = of_code[self.codes]
            pairs = np.unique(term[term >= 0] * max(rows, 1) + row[term >= 0])
            n = np.bincount(pairs // max(rows, 1), minlength=len(terms))
            up = np.bincount(pairs // max(rows, 1), self.labels[pairs % max(rows, 1)], minlength=len(terms))
            phi = relevance(n, up, rows, toxic)
            kept = np.flatnonzero((n > 0) & ((phi > 0) | (not matter)))
            held.extend(terms[i] for i in kept.tolist())
            phis.append(phi[kept])

        add(self.words, np.arange(len(self.words)), False)
        for size in _BEGINNINGS:
            place: dict[str, int] = {}
            of_code = np.array([place.setdefault(w[:size] + "*", len(place)) if len(w) > size else -1 for w in self.words], dtype=np.int64)
            add(list(place), of_code, True)
        return Vocabulary(held), np.concatenate(phis)

    def counted(self, i: int) -> dict[bytes, int]:
        span = slice(self.cuts[i], self.cuts[i + 1])
        return {self.words[c].encode(): n for c, n in zip(self.codes[span].tolist(), self.counts[span].tolist())}


def sampled(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Sample:
    """The sample of labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("size")
    sizes = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(size).where(F.col("size") <= train_bytes // 16)
    used = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sizes.withColumn("used", used).where(F.col("used") <= train_bytes).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return Sample(rows.select("doc_id", "toxic", "text").mapInArrow(_bags, f"doc_id {kind}, toxic int, words array<string>, counts array<int>").toArrow())


def fitted(sample: Sample, vocabulary: Vocabulary, phi: np.ndarray, frequencies: DataFrame) -> Model:
    """The model; frequencies: what _document_frequency() makes of all documents."""
    found = frequencies.groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(phi) + 1)
    df[found.column("place").to_numpy()] = found.column("df").to_numpy()  # place -1, the last one, holds the documents
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * (FLOOR + phi)
    model = Model(vocabulary, weight, [(d, y, *vocabulary.counts(sample.counted(i))) for i, (d, y) in enumerate(zip(sample.ids, sample.labels.tolist()))])
    vocabulary.forget()
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that aren't held out."""
    sample = sampled(docs, labels)
    vocabulary, phi = sample.terms()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    model = fitted(sample, vocabulary, phi, docs.select("text").mapInArrow(_document_frequency(len(phi), shared), "place int, df long"))
    shared.unpersist()
    return model


def _scored(shared):
    def run(batches):
        worker.begin(__name__)
        model = shared.value
        for b in batches:
            got = model.score(b.column("doc_id").to_pylist(), list(zip(numbers(b.column("places")), numbers(b.column("counts")))))
            evidence = pa.array([[{"doc_id": i, "cosine": c} for i, c in e] for _, e in got], pa.list_(pa.struct([("doc_id", b.schema.field("doc_id").type), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([round(s, 9) for s, _ in got], pa.float64()), evidence], names=["doc_id", "score", "evidence"])

    return run


def _clean(shared, words):
    def run(batches):
        worker.begin(__name__)
        model, vocabulary = shared.value, words.value
        for b in batches:
            got = model.score(b.column("doc_id").to_pylist(), [vocabulary.counts(Counter(runs_of(t))) for t in b.column("text").to_pylist()])
            yield b.filter(pa.array([round(s, 9) < 0.5 for s, _ in got], pa.bool_()))

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and the three nearest examples of every document. Terms are counted once and written down, for the
    document frequencies and for the scores."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = sampled(docs, labels)
    vocabulary, phi = sample.terms()
    broadcast = docs.sparkSession.sparkContext.broadcast
    counted = materialise(features(docs, broadcast(vocabulary)), "features")
    shared = broadcast(fitted(sample, vocabulary, phi, counted.select("places").mapInArrow(_document_frequency(len(phi)), "place int, df long")))
    return counted.mapInArrow(_scored(shared), f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind},cosine:double>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that score under one half, with all their columns."""
    shared, words = map(docs.sparkSession.sparkContext.broadcast, (model, model.vocabulary))
    worker.trim()
    return docs.mapInArrow(_clean(shared, words), docs.schema)


def op10_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's score."""
    out = score(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


QUERIES = {"op10_toxic_neighbours": op10_toxic_neighbours}
ORACLES: dict[str, str] = {}
