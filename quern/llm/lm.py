"""Language-model scores from a weighted backoff automaton of order three (operator 7).

States are contexts: the root, every token that training has (and the start), every pair of tokens that it has. For each
n-gram of training, an arc leads from the state of its first tokens by its last one to the state of its last two; it
carries log10 of the smoothed probability. A state's failure arc leads to the state without the oldest token and carries
log10 of what smoothing leaves for tokens without an arc. Smoothing is Dirichlet's, order by order:
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), p(w | v) = (c(v, w) + MU[0] p(w)) / (c(v) + MU[0]) and
p(w | u, v) = (c(u, v, w) + MU[1] p(w | v)) / (c(u, v) + MU[1]); a failure arc weighs MU / (c + MU), so weights out of a state
sum to one. All n-grams of all training documents count; nothing is pruned.

A text is read once from left to right: from the carried state, failure arcs are followed until an arc for the token is
there; weights add up on the way. Texts of a block are read side by side, one token of each at a time; a text of more
than STRETCH tokens is cut into stretches, each of which reads the two tokens before it first, as they settle its state.

The automaton grows with the corpus and is never in one place. Documents are written down in blocks of about BLOCK_BYTES;
each block sends its distinct n-grams with its own counts, cut by hash into buckets (as many as blocks, so a bucket's size
doesn't grow); a bucket adds up the blocks' counts and sends each block back what the others have beside its own; the
block then holds the states and arcs that its texts can reach, and reads them. A block, or a text that is larger, is the largest thing in
memory; hot n-grams cost one entry a block. Counts have 64 bits. N-grams are told apart by 64-bit hashes of keyed word
hashes, separately for each order: any two of n agree with a chance of n * n / 2**65.

Defined cases: null text is empty, an empty text is one end token; a null doc_id counts as the text '' in the fold;
repeated rows count and are scored each; without training rows c, N and V are 0; an empty table gives an empty result;
very long texts are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import worker
from quern.llm.words import forget, mix, word_hashes
from quern.session import materialise, prepare, table

FOLDS = 10
#: What smoothing adds to the counts after one token and after two.
MU = (200.0, 50.0)
#: Bytes of text in a block; tokens in a stretch (two at least).
BLOCK_BYTES = 12 << 20
STRETCH = 4096
_END = np.uint64(0x1B873593CC9E2D51)
_START = np.uint64(0x85EBCA6BC2B2AE35)
_STEP = np.uint64(0x9FB21C651E98DF25)


worker.remembers(__name__, forget)


class Grams:
    """Tokens, pairs and triples of a block's texts. Positions are those of the texts' tokens, each text led by a start."""

    def __init__(self, texts: list[str | None]):
        words = word_hashes(texts)
        sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), dtype=np.uint64)
        flat[self.starts] = _START
        flat[self.starts + sizes - 1] = _END
        inner = np.ones(len(flat), dtype=bool)
        inner[self.starts] = inner[self.starts + sizes - 1] = False
        flat[inner] = np.concatenate([np.empty(0, dtype=np.uint64), *words])
        self.sizes = sizes
        hashes, token = np.unique(flat, return_inverse=True)
        n = len(hashes)
        self.end, self.start = np.searchsorted(hashes, np.array([_END, _START])).tolist()
        self.token = token
        pairs = token[:-1] * n + token[1:]
        pairs[self.starts[1:] - 1] = -1  # an end and the next text's start
        codes, pair = np.unique(pairs, return_inverse=True)
        if codes[0] < 0:
            codes, pair = codes[1:], pair - 1
        self.pair = np.concatenate([[-1], pair])
        self.pair_before, self.pair_last = codes // n, codes % n
        triples = self.pair[:-1] * n + token[1:]
        triples[(self.pair[:-1] < 0) | (self.pair[1:] < 0)] = -1
        codes, at, triple = np.unique(triples, return_index=True, return_inverse=True)
        if codes[0] < 0:
            codes, at, triple = codes[1:], at[1:], triple - 1
        self.triple = np.concatenate([[-1], triple])
        self.triple_before, triple_last = codes // n, codes % n
        self.triple_short = self.pair[at + 1]
        pair_keys = mix(hashes[self.pair_before] * _STEP + hashes[self.pair_last])
        self.keys = [hashes, pair_keys, mix(pair_keys[self.triple_before] * _STEP + hashes[triple_last])]
        self.order = [np.argsort(k) for k in self.keys]

    def own_counts(self, held: list[bool]) -> list[np.ndarray]:
        """How often the block's training texts have each token (the start apart), pair and triple."""
        train = np.repeat(~np.array(held, dtype=bool), self.sizes)
        train[self.starts] = False
        out = []
        for at, k in zip((self.token, self.pair, self.triple), self.keys):
            out.append(np.bincount(at[train & (at >= 0)], minlength=len(k)))
        return out


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed whole numbers of 32 or 64 bits."""
    width = 4 if not len(numbers) or numbers.max() < 1 << 32 else 8
    return bytes([width]) + pa.compress(numbers.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[1:], decompressed_size=n * raw[0], codec="zstd", asbytes=True), dtype=f"<u{raw[0]}").astype(np.int64)


def _narrow(keys: np.ndarray, base: int) -> bytes:
    """Rising keys from base on, as steps: five bytes of each, and what is above them compressed."""
    steps = np.diff(keys, prepend=np.uint64(base))
    low = np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return low + _packed((steps >> np.uint64(40)).astype(np.int64))


def _wide(raw: bytes, n: int, base: int) -> np.ndarray:
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :5] = np.frombuffer(raw, dtype=np.uint8, count=5 * n).reshape(-1, 5)
    steps = steps.view(np.uint64).ravel() + (_unpacked(raw[5 * n :], n).astype(np.uint64) << np.uint64(40))
    steps[0] += np.uint64(base)
    return np.cumsum(steps, dtype=np.uint64)


def _blocked(block_bytes: int):
    """Arrow mapper that gathers rows into blocks, one row each."""

    def run(batches):
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [[], [], []], 0
        kinds = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([h], pa.list_(k)) for h, k in zip(held, kinds))], names=["block", "doc_ids", "held", "texts"])

        for b in batches:
            kinds = [b.schema.field(c).type for c in ("doc_id", "held_out", "text")]
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                for h, x in zip(held, row):
                    h.append(x)
                size += len(row[2] or "") + 16
                if size >= block_bytes:
                    yield out()
                    block, held, size = block + 1, [[], [], []], 0
        if held[0]:
            yield out()

    return run


def _sent(bits: int):
    def run(batches):
        worker.begin(__name__)
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for b in batches:
            for block, held, texts in zip(*(b.column(c).to_pylist() for c in ("block", "held", "texts"))):
                grams = Grams(texts)
                rows = []
                for kind, (keys, own, order) in enumerate(zip(grams.keys, grams.own_counts(held), grams.order)):
                    keys, own = keys[order], own[order]
                    cuts = [*np.searchsorted(keys, edges).tolist(), len(keys)]
                    rows += [(block, k, kind, hi - lo, _narrow(keys[lo:hi], int(edges[k])), _packed(own[lo:hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                for i in range(0, len(rows), 64):
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64]), kinds)], names=["block", "bucket", "kind", "size", "keys", "own"])

    return run


def _added(bits: int):
    def run(t: pa.Table) -> pa.Table:
        """All blocks' counts of one bucket: what each block lacks, and the bucket's share of N and V."""
        block, bucket, kind, size, raw, mine = (t.column(c).to_pylist() for c in ("block", "bucket", "kind", "size", "keys", "own"))
        out, n, v = [], 0, 0
        for order in range(3):
            rows = [i for i, k in enumerate(kind) if k == order]
            if not rows:
                continue
            keys = [_wide(raw[i], size[i], bucket[i] << (64 - bits)) for i in rows]
            own = [_unpacked(mine[i], size[i]) for i in rows]
            distinct = np.unique(np.concatenate(keys))
            places = [np.searchsorted(distinct, k) for k in keys]
            total = np.zeros(len(distinct), dtype=np.int64)
            for p, o in zip(places, own):
                total[p] += o
            if order == 0:
                n, v = int(total.sum()), int((total > 0).sum())
            out += [(block[i], bucket[i], order, size[i], _packed(total[p] - o)) for i, p, o in zip(rows, places, own)]
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        sums = [pa.array([x] + [0] * (len(out) - 1), pa.int64()) for x in (n, v)]
        return pa.table([*(pa.array(c, k) for c, k in zip(cols, kinds)), *sums], names=["block", "bucket", "kind", "size", "lacks", "n", "v"])

    return run


class Automaton:
    """The states and arcs that one block's texts can reach. State 0 is the root, 1 + t the context of token t, and
    1 + tokens + p that of pair p. Arcs are numbered tokens first, then pairs, then triples; counts: of each of them in training."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], n: int, v: int, mu: tuple[float, float] = MU):
        one, two, three = (c.astype(np.float64) for c in counts)
        self.tokens = len(one)
        p1 = (one + 0.1) / (n + 0.1 * (v + 1))
        after = one.copy()
        after[grams.start] = one[grams.end]  # each training text leaves the start once and has one end
        p2 = (two + mu[0] * p1[grams.pair_last]) / (after[grams.pair_before] + mu[0])
        p3 = (three + mu[1] * p2[grams.triple_short]) / (two[grams.triple_before] + mu[1])
        self.weight = np.log10(np.concatenate([p1, p2, p3]))
        of_pair = 1 + self.tokens + np.arange(len(two))
        self.target = np.concatenate([np.where(one > 0, 1 + np.arange(self.tokens), 0), of_pair, of_pair[grams.triple_short]])
        self.fail = np.concatenate([np.zeros(1 + self.tokens, dtype=np.int64), 1 + grams.pair_last])
        self.fail_weight = np.concatenate([[0.0], np.log10(mu[0] / (after + mu[0])), np.log10(mu[1] / (two + mu[1]))])
        # The arc that leaves the root, a token's state and a pair's state at each position, -1 where there is none.
        has = lambda at, c, first: np.where((at >= 0) & (c > 0)[at], first + at, -1) if len(c) else np.full(len(at), -1)
        self.by_token, self.by_pair, self.by_triple = grams.token, has(grams.pair, two, self.tokens), has(grams.triple, three, self.tokens + len(two))
        self.start = 1 + grams.start

    def walk(self, begins: np.ndarray, sizes: np.ndarray, state: np.ndarray, silent: np.ndarray) -> np.ndarray:
        """Summed weights of stretches of tokens, each read from left to right from its own state; longest stretches first.
        The first `silent` tokens of a stretch only move the state."""
        total, state = np.zeros(len(begins)), state.copy()
        alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
        for t, n in enumerate(alive.tolist()):
            at, s, weight = begins[:n] + t, state[:n], np.zeros(n)
            arc = np.where(s > self.tokens, self.by_triple[at], -1)
            lost = np.flatnonzero((arc < 0) & (s > self.tokens))
            weight[lost] += self.fail_weight[s[lost]]
            s[lost] = self.fail[s[lost]]
            left = np.flatnonzero((arc < 0) & (s > 0))
            arc[left] = self.by_pair[at[left]]
            lost = left[arc[left] < 0]
            weight[lost] += self.fail_weight[s[lost]]
            s[lost] = self.fail[s[lost]]
            left = np.flatnonzero(arc < 0)
            arc[left] = self.by_token[at[left]]
            weight += self.weight[arc]
            state[:n] = self.target[arc]
            total[:n] += np.where(silent[:n] <= t, weight, 0.0) if t < 2 else weight
        return total

    def scores(self, grams: Grams) -> np.ndarray:
        """Of every text, in order."""
        cuts = [(i, a, min(STRETCH, n - a)) for i, n in enumerate((grams.sizes - 1).tolist()) for a in range(0, n, STRETCH)]
        cuts.sort(key=lambda c: -(c[2] + 2 * (c[1] > 0)))
        text, first, size = (np.array(c, dtype=np.int64) for c in zip(*cuts))
        silent = np.where(first > 0, 2, 0)
        found = self.walk(grams.starts[text] + 1 + first - silent, size + silent, np.where(first > 0, 0, self.start), silent)
        return np.bincount(text, found, minlength=len(grams.sizes))


def _traversed(n: int, v: int, mu: tuple[float, float]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        worker.begin(__name__)
        held, texts = left.column("held")[0].as_py(), left.column("texts")[0].as_py()
        grams = Grams(texts)
        counts = grams.own_counts(held)
        kind, bucket, size, lacks = (right.column(c).to_pylist() for c in ("kind", "bucket", "size", "lacks"))
        for order in range(3):
            rows = sorted((i for i, k in enumerate(kind) if k == order), key=bucket.__getitem__)
            counts[order][grams.order[order]] += np.concatenate([np.empty(0, dtype=np.int64), *(_unpacked(lacks[i], size[i]) for i in rows)])
        model = Automaton(grams, counts, n, v, mu)
        scored = np.ones(len(grams.token), dtype=bool)
        scored[grams.starts] = False
        firsts = grams.starts - np.arange(len(grams.starts))
        token = grams.token[scored]
        return pa.table(
            {
                "doc_id": pa.array(left.column("doc_ids")[0].as_py(), left.schema.field("doc_ids").type.value_type), "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(grams.sizes - 1, pa.int64()), "n_known": pa.array(np.add.reduceat((counts[0] > 0)[token].astype(np.int64), firsts), pa.int64()),
                "train_tokens": pa.array(np.full(len(held), n), pa.int64()),
                "base_score": pa.array(np.add.reduceat(model.weight[token], firsts), pa.float64()), "score": pa.array(model.scores(grams), pa.float64()),
            }
        )

    return run


def score_documents(docs: DataFrame, folds: int = FOLDS, mu: tuple[float, float] = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    blocks = materialise(read.mapInArrow(_blocked(block_bytes), f"block long, doc_ids array<{kind}>, held array<boolean>, texts array<string>"), "blocks")
    bits = max(6, blocks.count().bit_length())
    sent = blocks.mapInArrow(_sent(bits), "block long, bucket int, kind int, size long, keys binary, own binary")
    added = materialise(sent.groupBy("bucket").applyInArrow(_added(bits), "block long, bucket int, kind int, size long, lacks binary, n long, v long"), "automaton")
    sums = added.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    parts = added.select("block", "bucket", "kind", "size", "lacks")
    return blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(_traversed(sums["n"] or 0, sums["v"] or 0, mu), schema)


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's score."""
    return score_documents(table(prepare(spark), sf_dir, "documents"))


QUERIES = {"op7_backoff_automaton": op7_backoff_automaton}
ORACLES: dict[str, str] = {}
