"""Token ids in binary shards, compressed by a Re-Pair grammar (operator 5).

Documents are range-partitioned by doc_id, encoded with the tokenizers library, ended with END_ID and gathered into
shards of about SHARD_IDS ids (whole documents). In each shard frequent pairs of ids become nonterminals, again and
again: a round counts all pairs and replaces, the most frequent first, those that are at least a SCHEDULE-th as frequent as
the most frequent one and share no symbol in a way that could overlap. (One pair a round is the same with SCHEDULE 1 and
far slower; the grammars differ by under a percent.) Only places whose pair may still be frequent are looked at. A pair of
equal ids counts at alternate places of its run. Pairs never contain the end id, so no rule crosses a document. It ends when
no pair occurs LEAST_COUNT times, which is when a rule takes as much room as it saves: both symbols and the expansion length
of a rule take about three symbols.

A shard file is: the magic `QRNG`, version, then counts (documents, ids, rules, symbols, base) and the arrays doc_id, null
flags, ids per document, first symbol per document, rules (left, right), expansion length per rule, symbols. Symbols are
written as 16-bit halves and packed planes of the bits above. A document is decoded alone from its first symbol, by
expansion lengths. Files travel as one binary value a row of a Parquet table, so that any store Spark writes to will do and
its commit protocol covers lost executors.

Defined cases: null text is empty (the end id alone); null doc_ids come first; equal doc_ids go by a hash of the text;
very long documents make a shard of their own; an empty table gives no file and an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import worker
from quern.llm.pieces import _PLAIN
from quern.llm.pretokens import PretokenCoder, spans
from quern.session import new_path, prepare, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SHARD_IDS = 1 << 21
#: Pieces in each of the two generations that a worker remembers; bounds memory, not results.
REMEMBERED = 600_000
#: New pieces that are encoded as one text.
TOGETHER = 2000
LEAST_COUNT = 4
SCHEDULE = 64
#: Size of the tables by which pairs are found again (a power of two); bounds memory, not results.
SLOT_BITS = 20
MAGIC, VERSION = b"QRNG", 2
_HEAD = struct.Struct("<4sIQQQQQ")
_LED = re.compile(f" ?{_PLAIN}")


class Encoder:
    """The tokenizers library, each distinct piece that isn't remembered encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if self.tokenizer.normalizer is not None or any(a.single_word or a.lstrip or a.rstrip for a in added.values()):
            raise ValueError("texts can't be cut for a tokenizer that changes them or looks beyond its added tokens")
        self.base = self.tokenizer.get_vocab_size()
        # A byte-level token has a character for each byte; an added one stands for its own text.
        self.size = np.zeros(self.base, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)
        for i, a in added.items():
            self.size[i] = len(a.content.encode())
        self.added = [a.content for a in added.values()]
        self.encode = PretokenCoder(self._learn, REMEMBERED, self.added).encode

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text."""
        return self.encode(pa.array(texts, pa.large_string()))

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of new pieces. Texts may be cut where a piece begins with a space and a character that isn't white space, and
        before and after a line end that such a character follows. So pieces are encoded as one text, a few thousand at a
        time, after a line end if they have no space, and their ids told apart by the bytes they stand for."""
        out: list[bytes] = [b""] * len(pieces)
        texts = [p.decode() for p in pieces]
        joined, alone = [], []
        for k, t in enumerate(texts):
            (joined if _LED.match(t) else alone).append(k)
        for i in range(0, len(joined), TOGETHER):
            ks = joined[i : i + TOGETHER]
            text = "".join([texts[k] if texts[k][0] == " " else "\n" + texts[k] for k in ks])
            if any(a in text for a in self.added):
                alone += ks
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            sizes = np.array([len(pieces[k]) for k in ks])
            ends = np.cumsum(sizes + [pieces[k][0] != 0x20 for k in ks])
            reach = np.concatenate([[0], np.cumsum(self.size[ids])])
            first, last = np.searchsorted(reach, ends - sizes), np.searchsorted(reach, ends)
            if not (np.array_equal(reach[first], ends - sizes) and np.array_equal(reach[last], ends)):
                raise ValueError("a token spans two pieces")
            raw = ids.tobytes()
            for k, lo, hi in zip(ks, (4 * first).tolist(), (4 * last).tolist()):
                out[k] = raw[lo:hi]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)):
            out[k] = np.array(e.ids, dtype="<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


worker.remembers(__name__, encoder.cache_clear)


def odd_ones(places: np.ndarray) -> np.ndarray:
    """Every second one of each run of neighbouring places: where an equal pair would overlap the one before."""
    first = np.ones(len(places), dtype=bool)
    first[1:] = np.diff(places) != 1
    starts = np.flatnonzero(first)
    offset = np.arange(len(places)) - np.repeat(starts, np.diff(np.append(starts, len(places))))
    return np.flatnonzero(offset % 2 == 1)


def overlapping(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Every second place of each run of equal neighbours, where the pair would overlap the one before."""
    same = np.flatnonzero(a == b)
    return same[odd_ones(same)]


def apart(lefts: list[int], rights: list[int]) -> list[int]:
    """Places of pairs, the first ones first, none of which begins with a symbol that another ends with."""
    begins: set[int] = set()
    ends: set[int] = set()
    out = []
    for k, (x, y) in enumerate(zip(lefts, rights)):
        if x not in ends and y not in begins:
            begins.add(x)
            ends.add(y)
            out.append(k)
    return out


def slots(codes: np.ndarray) -> np.ndarray:
    """Places of pairs in tables of 1 << SLOT_BITS."""
    odd = 0x9E3779B1 if codes.dtype == np.uint32 else 0x9E3779B97F4A7C15
    return codes * codes.dtype.type(odd) >> codes.dtype.type(8 * codes.itemsize - SLOT_BITS)


def compress(ids: np.ndarray, base: int, end_id: int = END_ID, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (left, right) and expansion lengths of one shard's ids.

    Symbols are numbered without gaps meanwhile. A pair gets no new place once its symbols exist, so what occurs less than
    `least` times stays so: only places that may still count are looked at (live). Two pairs of a round that share a slot
    would be taken for each other, so the rarer one waits."""
    present = np.zeros(base, dtype=bool)
    present[ids] = True
    used = np.flatnonzero(present)
    number = np.cumsum(present, dtype=np.int64) - 1
    seq = number.astype(np.uint32)[ids]
    end = int(number[end_id]) if end_id < base and present[end_id] else -1
    rules: list[np.ndarray] = []
    top = len(used)
    live = np.ones(len(seq), dtype=bool)
    live[len(seq) - 1 :] = False
    stops = np.flatnonzero(seq == end)
    live[stops] = False
    live[stops[stops > 0] - 1] = False
    slot, kept = np.zeros(1 << SLOT_BITS, dtype=np.int64), np.empty(1 << SLOT_BITS, dtype=bool)
    while True:
        half, kind = (16, np.uint32) if top < 1 << 16 else (32, np.uint64)
        at = np.flatnonzero(live)
        pairs_at = seq[at].astype(kind)
        second = seq[at + 1]
        equal = np.flatnonzero(pairs_at == second)
        pairs_at <<= kind(half)
        pairs_at |= second
        if len(equal):  # every second place of a run of equal symbols doesn't count
            again = np.zeros(len(at), dtype=bool)
            again[equal[odd_ones(at[equal])]] = True
            codes = np.sort(pairs_at[~again])
        else:
            again = None
            codes = np.sort(pairs_at)
        if not len(codes):
            break
        edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        counts = np.diff(edge, append=len(codes))
        most = counts.max()
        if most < least:
            break
        often = np.flatnonzero(counts >= least)
        pairs, counts = codes[edge[often]], counts[often]
        kept[:] = False
        kept[slots(pairs)] = True
        often = np.flatnonzero(counts >= most // SCHEDULE)
        pairs = pairs[often][np.argsort(-counts[often], kind="stable")]
        pairs = pairs[np.sort(np.unique(slots(pairs), return_index=True)[1])]
        lefts, rights = (pairs >> kind(half)).astype(np.int64), (pairs & kind((1 << half) - 1)).astype(np.int64)
        chosen = apart(lefts.tolist(), rights.tolist())
        pairs = pairs[chosen]
        rules.append(np.stack([lefts[chosen], rights[chosen]], axis=1))
        slot[slots(pairs)] = np.arange(len(pairs))
        slots_at = slots(pairs_at)
        alive = kept[slots_at]
        alive[equal] = True
        live[at[~alive]] = False
        if again is not None:
            alive[again] = False
        near = np.flatnonzero(alive)
        name = np.minimum(slot[slots_at[near]], len(pairs) - 1)
        hit = np.flatnonzero(pairs[name] == pairs_at[near])
        near, name = at[near[hit]], name[hit]
        seq[near] = (top + name).astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[near + 1] = False
        seq, live = seq[keep], live[keep]
        new = near - np.arange(len(near))
        before = new[new > 0] - 1
        live[new] = True
        live[before] = seq[before] != end
        live[new] &= seq[np.minimum(new + 1, len(seq) - 1)] != end
        live[-1] = False
        top += len(pairs)
    back = np.concatenate([used, base + np.arange(top - len(used))]).astype("<u4")
    made = back[np.concatenate([np.empty((0, 2), dtype=np.int64), *rules])]
    sizes = np.ones(base + len(made), dtype=np.int64)
    done = base
    for r in rules:  # both symbols of a rule are older than its round
        sizes[done : done + len(r)] = sizes[made[done - base : done - base + len(r)]].sum(axis=1)
        done += len(r)
    return back[seq] if top else seq, made, sizes[base:].astype("<u4")


def planes(symbols: np.ndarray, top: int) -> bytes:
    """Numbers below top: their lower 16 bits, then a packed plane for each bit above."""
    high = [np.packbits((symbols >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(16, max(top - 1, 0).bit_length())]
    return b"".join([symbols.astype("<u2").tobytes(), *high])


def pack(doc_ids: list[int | None], encoded: list[np.ndarray], base: int) -> bytes:
    """One shard file; encoded: ids of each document, the end id included."""
    counts = np.array([len(e) for e in encoded], dtype="<i8")
    symbols, rules, lengths = compress(np.concatenate(encoded), base)
    top = base + len(rules)
    sizes = np.ones(top, dtype=np.int64)
    sizes[base:] = lengths
    reach = np.concatenate([[0], np.cumsum(sizes[symbols])])
    starts = np.searchsorted(reach, np.concatenate([[0], np.cumsum(counts)])).astype("<i8")
    head = _HEAD.pack(MAGIC, VERSION, len(doc_ids), int(counts.sum()), len(rules), len(symbols), base)
    ids = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype="u1")
    return b"".join([head, *(x.tobytes() for x in (ids, nulls, counts, starts)), planes(rules.ravel(), top), lengths.tobytes(), planes(symbols, top)])


class Shard:
    """A shard file read again."""

    def __init__(self, raw: bytes):
        magic, version, n_docs, self.n_ids, n_rules, n_symbols, self.base = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        def numbers(n: int) -> np.ndarray:
            out = take("<u2", n).astype(np.uint32)
            for k in range(16, max(self.base + n_rules - 1, 0).bit_length()):
                out |= np.unpackbits(take("u1", -(-n // 8)), count=n).astype(np.uint32) << np.uint32(k)
            return out

        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), nulls.tolist())]
        self.counts, self.starts = take("<i8", n_docs), take("<i8", n_docs + 1)
        self.rules, self.lengths = numbers(2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.symbols = numbers(n_symbols)
        size = np.ones(self.base + n_rules, dtype=np.int64)
        size[self.base :] = self.lengths
        self.size = size
        self.first = np.arange(self.base + n_rules, dtype=np.int64)
        self.first[self.base :] = self.base + np.concatenate([[0], np.cumsum(self.lengths[:-1], dtype=np.int64)]) if n_rules else []
        self.flat = np.empty(self.base + int(self.lengths.sum()), dtype="<u4")
        self.flat[: self.base] = np.arange(self.base)
        # Rules whose symbols come before them all are expanded at once.
        latest = np.maximum.accumulate(self.rules.max(axis=1)) if n_rules else np.empty(0, dtype=np.int64)
        done = 0
        while done < n_rules:
            until = max(done + 1, int(np.searchsorted(latest, self.base + done)))
            parts = self.rules[done:until].ravel()
            lo = self.first[self.base + done]
            self.flat[lo : lo + size[parts].sum()] = self.flat[spans(self.first[parts], size[parts])]
            done = until

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own symbols alone."""
        symbols = self.symbols[self.starts[k] : self.starts[k + 1]]
        sizes = self.size[symbols]
        return self.flat[spans(self.first[symbols], sizes)]


def _written(path):
    def run(batches):
        import public_tokenizers
        from pyspark import TaskContext

        worker.begin(__name__)
        enc = encoder(path or public_tokenizers.path(VOCABULARY))
        part, end = TaskContext.get().partitionId(), np.array([END_ID], dtype="<u4")
        names, done, held, before, number = [], [], 0, 0, 0

        def out():
            nonlocal names, done, held, before, number
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([pack(names, done, enc.base)], pa.binary())],
                names=["part", "number", "before", "n_ids", "file"],
            )
            names, done, before, held, number = [], [], before + held, 0, number + 1
            return row

        for b in batches:
            for d, e in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                names.append(d)
                done.append(np.concatenate([e, end]))
                held += len(e) + 1
                if held >= SHARD_IDS:
                    yield out()
        if names:
            yield out()

    return run


def write_shards(docs: DataFrame, to: str, path: str | None = None) -> None:
    """Shard files of all documents in ascending doc_id order: (part, number) orders the files."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(_written(path), "part int, number int, before long, n_ids long, file binary").write.option("compression", "zstd").parquet(to)


def _read(batches):
    for b in batches:
        for raw, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
            s = Shard(raw)
            crcs = [zlib.crc32(s.ids(k).tobytes()) for k in range(len(s.doc_ids))]
            starts = start + np.concatenate([[0], np.cumsum(s.counts[:-1])]) if len(s.counts) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(s.counts, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files. Parts are as many as the write's
    partitions, a setting, so their offsets go to all tasks."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = files.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("before")).alias("start"), "file")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written and read back."""
    path = new_path(prepare(spark), "shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)


QUERIES = {"op5_repair_shards": op5_repair_shards}
ORACLES: dict[str, str] = {}
