"""Benchmark decontamination by pigeonhole edit matching (operator 1).

Texts and test items are lower-cased and their white space is made single spaces. An item of L characters may occur with
e = L // ERROR_SHARE edits (insertions, deletions, replacements). It is split into e + 1 pieces, so an occurrence with
at most e edits holds one piece unchanged. An Aho-Corasick automaton finds all exact piece hits; each is verified with
Myers' bit-parallel distance up a tree of ever larger runs of pieces (a run of j pieces may hold j - 1 edits, and by the
same pigeonhole one half of a matching run matches), so that chance hits end after a few characters and none is lost.

Test items are a stated query set, sent to all tasks in blocks of at most BLOCK_CHARS characters.

Defined cases: null or empty texts match nothing; null, empty or blank items are left out; items under SHORT characters
must occur unchanged between non-word characters; repeated items and rows each give their own result rows; very long
texts are scanned whole; empty tables give empty results; other columns pass through or are not read.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm import worker
from quern.session import prepare, table

ERROR_SHARE = 10
SHORT = 40
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of text, and where the first such stretch ends; stops early at 0.
    Distances over `most` come back as most + 1."""
    ones = (1 << m) - 1
    high = 1 << (m - 1)
    pv, mv, score, best, at = ones, 0, m, most + 1, -1
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (ones & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | (ones & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, i + 1
            if not best:
                break
    return best, at


class Item:
    """One test item: its pieces and the runs of pieces above them."""

    def __init__(self, item_id, text: str):
        self.item_id, self.text = item_id, text
        self.budget = 0 if len(text) < SHORT else len(text) // ERROR_SHARE
        n = self.budget + 1
        self.cuts = [len(text) * i // n for i in range(n + 1)]
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.masks: dict[tuple[int, int], dict[str, int]] = {}
        self._split(0, n, [])

    def _split(self, a: int, b: int, above: list[tuple[int, int]]) -> None:
        if b - a == 1:
            self.runs[a] = above[::-1]
            return
        mid = (a + b) // 2
        self._split(a, mid, [*above, (a, b)])
        self._split(mid, b, [*above, (a, b)])

    def mask(self, run: tuple[int, int]) -> dict[str, int]:
        if run not in self.masks:
            bits: dict[str, int] = {}
            for i, c in enumerate(self.text[self.cuts[run[0]] : self.cuts[run[1]]]):
                bits[c] = bits.get(c, 0) | 1 << i
            self.masks[run] = bits
        return self.masks[run]

    def verify(self, text: str, piece: int, at: int, failed: set) -> tuple[int, int] | None:
        """Distance and end of the occurrence around a hit of `piece` at `at`, if the whole item is within budget."""
        best, end = 0, at + len(self.text)
        for run in self.runs[piece]:
            most = run[1] - run[0] - 1
            start = at - (self.cuts[piece] - self.cuts[run[0]])
            key = (run, start)
            if key in failed:
                return None
            size = self.cuts[run[1]] - self.cuts[run[0]]
            lo = max(0, start - most)
            best, stop = myers(self.mask(run), size, text[lo : start + size + most], most)
            if best > most:
                failed.add(key)
                return None
            end = lo + stop
        return best, end


class Matcher:
    def __init__(self, items: tuple[tuple[int, str], ...]):
        import ahocorasick

        self.items = [Item(i, t) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for p, (a, b) in enumerate(zip(item.cuts, item.cuts[1:])):
                pieces.setdefault(item.text[a:b], []).append((k, p))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of the best occurrence of every item that occurs."""
        text = normal(raw)
        if not text or not self.items:
            return []
        found: dict[int, tuple[int, int]] = {}
        failed: dict[int, set] = {}
        for last, (size, where) in self.automaton.iter(text):
            at = last - size + 1
            for k, p in where:
                item = self.items[k]
                if k in found and (found[k][0] == 0 or abs(at - item.cuts[p] + len(item.text) - found[k][1]) <= item.budget):
                    continue
                if not item.budget:
                    end = at + size
                    if len(item.text) < SHORT and (text[at - 1 : at].isalnum() or text[end : end + 1].isalnum()):
                        continue
                    hit = (0, end)
                else:
                    hit = item.verify(text, p, at, failed.setdefault(k, set()))
                if hit and (k not in found or hit < found[k]):
                    found[k] = hit
        return sorted((self.items[k].item_id, d, e) for k, (d, e) in found.items())


@lru_cache(maxsize=4)
def matcher(items: tuple[tuple[int, str], ...]) -> Matcher:
    return Matcher(items)


worker.remembers(__name__, matcher.cache_clear)


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> list[tuple[tuple[int, str], ...]]:
    """Normalised test items in blocks of bounded size, by item_id and text."""
    out, size = [[]], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = normal(r["text"])
        if text:
            if size + len(text) > most and out[-1]:
                out.append([])
                size = 0
            out[-1].append((r["item_id"], text))
            size += len(text)
    return [tuple(b) for b in out]


def _matched(items):
    def run(batches):
        worker.begin(__name__)
        m = matcher(items)
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for hit in m.find(t)]
            cols = list(zip(*rows)) or [()] * 4
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "distance", "end_char"])

    return run


def _clean(items):
    def run(batches):
        worker.begin(__name__)
        m = matcher(items)
        for b in batches:
            yield b.filter(pa.array([not m.find(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance and end_char of every test item that a document holds."""
    src = docs.select("doc_id", "text")
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, end_char long"
    parts = [src.mapInArrow(_matched(items), schema) for items in blocks(benchmark)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any test item, with all their columns."""
    for items in blocks(benchmark):
        docs = docs.mapInArrow(_clean(items), docs.schema)
    return docs


def op1_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item in every whole document, within its edit budget."""
    prepare(spark)
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_pigeonhole": op1_pigeonhole}
ORACLES: dict[str, str] = {}
