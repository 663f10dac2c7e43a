"""Near-duplicates by circulant MinHash (operator 6).

A document's set is its distinct 5-word shingles, hashed to 64 bits; shorter texts are one shingle, empty ones none.
Two permutations give the whole signature. The first, a mixing of all 64 bits, places a shingle in one of 2**20 blocks and
at a point within it; the second permutes the blocks. Coordinate k shifts the blocks circularly by k: it is the shingle of
the set that comes first by (second permutation of its block + k, point). So all coordinates of a shingle are one
contiguous stretch of the second permutation, and two sets agree in a coordinate as often as their Jaccard similarity
says, however large they are. Equal sets become one class first. Bands of coordinates give buckets of classes, and links
are confirmed on full sets. The bound is a percentage of Jaccard similarity: PERCENT for the query, STAGE_PERCENT for
one_of_each; bands and prints are sized from it.

Buckets are not multiplied out. First each member is compared with its bucket's most central member, and confirmed links
are closed into components. A bucket whose members are one component is done. In the others, every pair of members of
different components is compared once (in the first band that it shares), if it passes two tests: the shingles of each
that occur anywhere else must be enough for the bound (exact; it also covers set sizes), and it must agree in all but
most_differ() of PRINT_BITS bits, one a coordinate. Buckets in which more than CROWD such members are left are opened again
with bands of NARROW_ROWS coordinates instead, in which nearly all that meet are linked; there the most central members are
compared with all others, more of them each round, until each bucket is one component or used up. So any two
members of a bucket are compared unless they are already known to be connected. A linked pair shares no band or fails a
print with a chance under MISSED in all.

Defined cases: null or empty texts have empty sets, link with nothing and are kept; rows that share a doc_id are one
document (their first set by fingerprint) and get the same verdict; null doc_ids aren't linked and are kept; an empty table
gives an empty result; very long texts give whole sets; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import worker
from quern.llm.words import forget, mix, word_hashes
from quern.operators.graph import components
from quern.session import discard, materialise, new_path, prepare, salted_left_join, table

SHINGLE = 5
#: Least similarity that links: in the query, and in stages that keep one document of each component.
PERCENT, STAGE_PERCENT = 85, 80
#: Coordinates of a band, and of a band of a reopened bucket.
ROWS, NARROW_ROWS = 5, 12
#: Members of a bucket that are compared with each other; beyond, it is reopened.
CROWD = 2048
#: In reopened buckets: members compared with all others in the first round, and how that grows by round.
HUBS, HUB_GROWTH = 1, 8
PRINT_BITS = 1024
#: Chance of losing a pair at the bound: a third by bands, a third by narrow bands, a third by the print.
MISSED = 1e-6
BLOCK_BITS = 20
_STEP = np.uint64(0x9FB21C651E98DF25)


def band_count(percent: int, width: int = ROWS) -> int:
    """Bands of so many coordinates by which a pair at the bound shares one."""
    return math.ceil(math.log(MISSED / 3) / math.log1p(-((percent / 100) ** width)))


def most_differ(percent: int) -> int:
    """Bits in which prints of a pair at the bound may differ: a bit does with half the chance that a coordinate does."""
    p, n, left, m = (1 - percent / 100) / 2, PRINT_BITS, 1.0, -1
    term = (1 - p) ** n
    while left >= MISSED / 3:
        m += 1
        left -= term
        term *= (n - m) / (m + 1) * p / (1 - p)
    return m


@lru_cache(maxsize=1)
def _second() -> tuple[np.ndarray, np.ndarray]:
    """The permutation of the blocks, long enough for every shift, and its inverse."""
    order = np.random.Generator(np.random.PCG64(20240607)).permutation(1 << BLOCK_BITS).astype(np.uint32)
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.arange(len(order))
    return np.concatenate([order, order[: 1 << 13]]), where


worker.remembers(__name__, _second.cache_clear)
worker.remembers(__name__, forget)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document; mix() is the first permutation."""
    n = len(words)
    if not n:
        return words
    width = min(n, SHINGLE)
    h = words[: n - width + 1].copy()
    for j in range(1, width):
        h = h * _STEP + words[j : n - width + 1 + j]
    return np.unique(mix(h + np.uint64(width)))


def signature(found: np.ndarray, k: int) -> np.ndarray:
    """k coordinates of one sorted set: the shingles that come first."""
    order, where = _second()
    block = (found >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)
    first = np.ones(len(block), dtype=bool)
    first[1:] = block[1:] != block[:-1]
    lead, held = found[first], block[first]
    windows = np.lib.stride_tricks.sliding_window_view(order, k)
    least = windows[held[:512]].min(axis=0)
    for i in range(512, len(held), 512):
        np.minimum(least, windows[held[i : i + 512]].min(axis=0), out=least)
    return lead[np.searchsorted(held, (where[least] - np.arange(k)) % (1 << BLOCK_BITS))]


def band_keys(sig: np.ndarray, bands: int, width: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(width << 32)
    for c in sig[: bands * width].reshape(bands, width).T:
        h = mix(h * _STEP + c)
    return h


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    return tuple(int(h.sum(dtype=np.uint64).view(np.int64)) for h in (found, mix(found ^ _STEP)))


def bit_print(sig: np.ndarray) -> np.ndarray:
    """A random bit of every coordinate, in 64-bit words."""
    return np.packbits((mix(sig + np.arange(len(sig), dtype=np.uint64) * _STEP) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _sketched(bands: int):
    def run(batches):
        worker.begin(__name__)
        for b in batches:
            rows = []
            for words in word_hashes(b.column("text").to_pylist()):
                found = shingles(words)
                keys = band_keys(signature(found, bands * ROWS), bands, ROWS).view(np.int64) if len(found) else []
                rows.append((len(found), *fingerprint(found), keys))
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_shingles", "print_a", "print_b", "bands"])

    return run


def _sets(batches):
    worker.begin(__name__)
    for b in batches:
        found = [shingles(w) for w in word_hashes(b.column("text").to_pylist())]
        prints = [[int(p[i]) for p in map(fingerprint, found)] for i in (0, 1)]
        cols = [b.column("doc_id"), *(pa.array(p, pa.int64()) for p in prints), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "print_a", "print_b", "shingles"])


def _of_sets(width: int, bands: int):
    """Arrow mapper over (doc_id, shingles): the print, and band keys of that width."""

    def run(batches):
        worker.begin(__name__)
        for b in batches:
            sigs = [signature(np.array(s, dtype=np.int64).view(np.uint64), max(PRINT_BITS, bands * width)) for s in b.column("shingles").to_pylist()]
            cols = [pa.array([bit_print(s[:PRINT_BITS]) for s in sigs], pa.list_(pa.int64())), pa.array([band_keys(s, bands, width).view(np.int64) for s in sigs], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc", "bits", "bands"])

    return run


def sketch(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and its band keys."""
    src = docs.select("doc_id", "text")
    return src.mapInArrow(_sketched(bands), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_shingles long, print_a long, print_b long, bands array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets. The first join brings hubs to narrow
    pairs, so a hot hub's rows are a few bytes each and Spark splits them; the second is by the other member."""
    hubs = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    joined = hubs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return joined.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def link(docs: DataFrame, percent: int, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; sets of that similarity are linked."""
    spark = docs.sparkSession
    seen = materialise(sketch(docs, band_count(percent)), "sketch")
    sized = seen.where("n_shingles > 0 and doc_id is not null")
    key = F.struct("print_a", "print_b", "n_shingles")
    one = sized.select("doc_id", key.alias("k"))
    many = one.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("k", "rep")
    members = materialise(salted_left_join(one, many, "k", "doc_id", 8).select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    reps = members.where("doc_id = rep").select("doc_id")
    first = sized.join(reps, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("print_a", "print_b", "n_shingles", "bands")).alias("s"))
    first = materialise(first.select(F.col("doc_id").alias("doc"), F.col("s.n_shingles").alias("n"), "s.bands"), "reps")
    buckets = materialise(_crowded(first), "crowded")
    known = materialise(first.join(buckets, "doc", "left_semi"), "members")
    edges_path = new_path(spark, "edges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark.createDataFrame([], f"a {kind}, b {kind}").write.parquet(edges_path)
    if not known.isEmpty():
        _Linking(docs, known, edges_path, percent, crowd).run(buckets)
    found = components(spark.read.parquet(edges_path))
    linked = salted_left_join(members.withColumnRenamed("rep", "node"), found, "node", "doc_id", 8)
    linked = linked.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    return seen.select("doc_id", "n_shingles").join(linked, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _crowded(banded: DataFrame) -> DataFrame:
    """(key, doc, held) of every bucket with two members or more; banded: doc and bands."""
    rows = banded.select("doc", F.explode("bands").alias("key"))
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "key")


def _central(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("doc").agg(F.sum("held").alias("central"))


class _Linking:
    """Compares members of buckets; confirmed links go to edges_path."""

    def __init__(self, docs: DataFrame, known: DataFrame, edges_path: str, percent: int, crowd: int):
        self.spark, self.edges_path, self.percent, self.crowd = docs.sparkSession, edges_path, percent, crowd
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        texts = docs.select("doc_id", "text").join(known.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
        made = texts.mapInArrow(_sets, f"doc_id {self.kind}, print_a long, print_b long, shingles array<long>")
        self.sets = materialise(made.groupBy("doc_id").agg(F.min(F.struct("print_a", "print_b", "shingles")).alias("s")).select("doc_id", "s.shingles"), "sets")
        # A shingle that no other member has is in no intersection: what is left bounds every Jaccard value, exactly.
        alone = self.sets.select("doc_id", F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc")).where("c = 1")
        alone = alone.groupBy("doc").agg(F.count("*").alias("alone"))
        able = known.drop("bands").join(alone, "doc", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
        self.able = materialise(able.where(100 * F.col("common") >= percent * F.col("n")), "able")
        self.bands = known.select("doc", "bands")

    def enough(self, n: str, common: str) -> Column:
        """Whether both members' common shingles allow the bound."""
        most = F.least("common", common)
        return 100 * most >= self.percent * (F.col("n") + F.col(n) - most)

    def alike(self, bits: str) -> Column:
        differ = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get(bits, F.lit(i)))) for i in range(PRINT_BITS // 64)), F.lit(0))
        return differ <= most_differ(self.percent)

    def link(self, pairs: DataFrame) -> bool:
        """Confirms pairs (a, b); whether any was."""
        pairs = materialise(pairs.distinct(), "pairs")
        links = materialise(confirmed(pairs, self.sets, self.percent), "links")
        any_ = not links.isEmpty()
        if any_:
            links.write.mode("append").parquet(self.edges_path)
        discard(pairs)
        discard(links)
        return any_

    def still_open(self, rows: DataFrame) -> DataFrame:
        """Those rows (key, doc, component, used) whose bucket has two components and two members that were no hubs."""
        joined = components(self.spark.read.parquet(self.edges_path)).withColumnRenamed("node", "doc").withColumnRenamed("component", "now")
        rows = rows.join(joined, "doc", "left").withColumn("component", F.coalesce("now", "doc")).drop("now")
        spans = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if(~F.col("used")).alias("fresh"), F.count("*").alias("open"))
        return rows.drop("open").join(spans.where("lo <> hi and fresh > 1").select("key", "open"), "key")

    def opened(self, buckets: DataFrame) -> DataFrame:
        """Buckets' able members with what hubs are chosen by."""
        rows = buckets.join(self.able, "doc").join(_central(buckets), "doc")
        return materialise(rows.select("*", F.col("doc").alias("component"), F.lit(False).alias("used")), "open")

    def hub_round(self, rows: DataFrame, hubs: int, bits: bool) -> DataFrame:
        """Compares every member with its bucket's hubs (at most so many, the most central of as many hash slots)."""
        order = F.struct("central", F.xxhash64("doc").alias("h"), "doc", "n", "common", "component", *["bits"] * bits)
        lead = rows.where("not used").withColumn("slot", F.pmod(F.xxhash64("doc", F.lit(hubs)), F.lit(hubs))).groupBy("key", "slot").agg(F.max(order).alias("h"))
        lead = materialise(lead.select(F.col("key").alias("hub_key"), *(F.col(f"h.{c}").alias(f"hub_{c}") for c in ["doc", "n", "common", "component", *["bits"] * bits])), "hubs")
        near = (F.col("component") != F.col("hub_component")) & self.enough("hub_n", "hub_common")
        near = near & self.alike("hub_bits") if bits else near
        pairs = rows.join(lead, (F.col("key") == F.col("hub_key")) & near)
        self.link(pairs.select(F.col("doc").alias("a"), F.col("hub_doc").alias("b")))
        marked = rows.join(lead.select(F.col("hub_key").alias("key"), F.col("hub_doc").alias("doc"), F.lit(True).alias("now")), ["key", "doc"], "left")
        left = materialise(self.still_open(marked.withColumn("used", F.col("used") | F.coalesce("now", F.lit(False))).drop("now")), "open")
        discard(rows)
        discard(lead)
        return left

    def run(self, buckets: DataFrame) -> None:
        left = self.hub_round(self.opened(buckets), 1, False)
        if left.isEmpty():
            return
        few = left.where(F.col("open") <= self.crowd)
        prints = materialise(self.sets.join(few.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_of_sets(1, 0), f"doc {self.kind}, bits array<long>, bands array<long>"), "prints")
        wide = few.select("key", "doc", "n", "common", "component").join(prints.select("doc", "bits").join(self.bands, "doc"), "doc")
        other = wide.select("key", *(F.col(c).alias(f"other_{c}") for c in ("doc", "n", "common", "component", "bits", "bands")))
        first = F.get(F.array_intersect("bands", "other_bands"), F.lit(0)) == F.col("key")
        once = (F.col("doc") < F.col("other_doc")) & (F.col("component") != F.col("other_component")) & self.enough("other_n", "other_common") & self.alike("other_bits") & first
        held = [F.col(c) for c in ("doc", "other_doc")]
        self.link(wide.join(other.withColumnRenamed("key", "other_key"), (F.col("key") == F.col("other_key")) & once).select(held[0].alias("a"), held[1].alias("b")))
        full = materialise(left.where(F.col("open") > self.crowd).select(F.col("doc").alias("doc_id")).distinct(), "reopened")
        if not full.isEmpty():
            self.reopen(full)
        discard(left)

    def reopen(self, members: DataFrame) -> None:
        """Members of crowded buckets meet in narrow bands, until each bucket is one component or used up."""
        bands = band_count(self.percent, NARROW_ROWS)
        made = materialise(self.sets.join(members, "doc_id", "left_semi").mapInArrow(_of_sets(NARROW_ROWS, bands), f"doc {self.kind}, bits array<long>, bands array<long>"), "narrow")
        buckets = materialise(_crowded(made), "crowded").join(made.select("doc", "bits"), "doc")
        rows, hubs = self.opened(buckets), HUBS
        while not rows.isEmpty():
            rows = self.hub_round(rows, hubs, True)
            hubs *= HUB_GROWTH


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    out = link(table(prepare(spark), sf_dir, "documents"), PERCENT)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of the smallest doc_id of every component, with all their columns."""
    gone = link(docs, percent).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


QUERIES = {"op6_circulant_minhash": op6_circulant_minhash}
ORACLES = {
    "op6_circulant_minhash": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
links as (select a as x, b as y from e union all select b, a from e),
reach as (select doc_id as d, doc_id as c from documents union select links.y, reach.c from reach join links on links.x = reach.d),
least as (select d, min(c) as c from reach group by d)
select doc_id, coalesce(n.n, 0) as n_shingles, least.c as component_id, doc_id = least.c as kept from documents left join n using (doc_id) join least on least.d = doc_id"""
}
