"""Token shards, packing, masks, selection, ledgers and their audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import ids_sha256, md5_uint32, seed63
from quern.functions.text import words

# Fixed values of selection.
ALIGNMENT = {"general_web": 0.62, "code": 0.78, "math": 0.74, "reasoning": 0.66, "agentic": 0.22, "indic": 0.20}
ACCEPT, DEFER = 0.50, 0.36
GENESIS = "0" * 64
EOS, PAD = 1, 0
STRUCTURED_LANES = ["agentic", "reasoning"]
DOCS_PER_SHARD = 8


def lane_documents(docs: DataFrame, lanes: list[str]) -> DataFrame:
    """Documents as lane, split and token ids: split by doc_id modulo 8 (0 eval, 4 validation), lane by source."""
    split = F.when(F.pmod("doc_id", F.lit(8)) == 0, "eval").when(F.pmod("doc_id", F.lit(8)) == 4, "validation").otherwise("train")
    lane = F.get(F.array(*map(F.lit, lanes)), F.pmod(md5_uint32(F.col("source")), F.lit(len(lanes))).cast("int"))
    ids = F.transform(words(F.col("text")), lambda w: (F.crc32(w.cast("binary")) % 50000 + 2).cast("int"))
    return docs.select("doc_id", lane.alias("lane"), split.alias("split"), "text", ids.alias("ids"))


def loss_spans(segments: Column, n_tokens: Column) -> Column:
    """[start, end) of loss-bearing segments, by a running start; all tokens where there are no segments."""
    spans = F.aggregate(
        segments,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc.at + x.n).alias("at"),
            F.when(x.loss, F.concat(acc.out, F.array(F.struct(acc.at.alias("s"), (acc.at + x.n).alias("e"))))).otherwise(acc.out).alias("out"),
        ),
        lambda acc: acc.out,
    )
    return F.when(segments.isNull(), F.array(F.struct(F.lit(0).alias("s"), n_tokens.cast("int").alias("e")))).otherwise(spans)


def build_shards(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lane, split, text, ids) with shard_id, place, start and a contamination flag.

    Rows are chunked by eight in (lane, split), then later copies of a text go (first in lane, split, chunk, place), then a
    training shard that holds a held-out text is not trainable."""
    order = Window.partitionBy("lane", "split").orderBy("doc_id")
    placed = docs.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / DOCS_PER_SHARD).cast("int")).withColumn("place", F.pmod(F.row_number().over(order) - 1, F.lit(DOCS_PER_SHARD)))
    placed = placed.withColumn("content", F.sha2("text", 256))
    rank = F.struct("lane", "split", "chunk", "place")
    firsts = placed.groupBy("content").agg(F.min(rank).alias("first"))
    unique = placed.join(firsts, "content").where(rank == F.col("first")).drop("first")
    unique = unique.withColumn("shard_id", F.concat_ws(".", "lane", "split", F.lpad(F.col("chunk").cast("string"), 2, "0")))
    held = placed.where("split <> 'train'").select("content", F.lit(True).alias("held")).distinct()
    flagged = unique.join(held, "content", "left").withColumn("leaks", F.coalesce("held", F.lit(False)) & (F.col("split") == "train"))
    shard = Window.partitionBy("shard_id")
    start = F.coalesce(F.sum(F.size("ids")).over(shard.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return flagged.withColumns({"start": start.cast("long"), "contaminated": F.max("leaks").over(shard)}).drop("held", "leaks", "chunk")


def shard_manifests(shards: DataFrame) -> DataFrame:
    """One row per shard: counts, hashes, whether it can be trained on."""
    tokens = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x.ids))
    out = shards.groupBy("shard_id", "lane", "split").agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.max("contaminated").alias("contaminated"), tokens.alias("tokens"))
    return out.select("shard_id", "lane", "split", "n_docs", "n_tokens", "contaminated", ((F.col("split") == "train") & ~F.col("contaminated")).alias("trainable"), ids_sha256("tokens").alias("content_sha256"))


def verify_shards(shards: DataFrame, manifests: DataFrame) -> DataFrame:
    """shard_id, ok: content hashed again against the manifest."""
    now = shard_manifests(shards).select("shard_id", F.col("content_sha256").alias("now"))
    return manifests.select("shard_id", "content_sha256").join(now, "shard_id", "full").select("shard_id", F.coalesce(F.col("now") == F.col("content_sha256"), F.lit(False)).alias("ok"))


def pack_structured(docs: DataFrame, seq_len: int) -> DataFrame:
    """One document a sequence: cut to seq_len - 1, closed by an end without loss, padded."""
    ids = F.slice("ids", 1, seq_len - 1)
    n = F.size(ids)
    pad = lambda fill: F.array_repeat(F.lit(fill), (F.lit(seq_len) - n - 1))
    tokens = F.concat(ids, F.array(F.lit(EOS)), pad(PAD))
    seg = F.concat(F.array_repeat(F.lit(0), n + 1), pad(-1))
    pos = F.concat(F.sequence(F.lit(0), n), pad(0))
    loss = F.concat(F.array_repeat(F.lit(True), n), F.array(F.lit(False)), pad(False))
    return docs.select("lane", "doc_id", tokens.alias("tokens"), seg.alias("seg"), pos.alias("pos"), loss.alias("loss_token"), (n + 1).alias("n_real")).withColumn("loss_mask", loss_mask(F.col("seg"), F.col("loss_token")))


def loss_mask(seg: Column, loss: Column) -> Column:
    """A position trains on its successor if both stand in one segment and the successor bears loss; the last never does."""
    n = F.size(seg)
    step = lambda i: (F.get(seg, i) >= 0) & (F.get(seg, i) == F.get(seg, i + 1)) & F.get(loss, i + 1)
    return F.concat(F.transform(F.sequence(F.lit(0), n - 2), step), F.array(F.lit(False)))


def pack_concat(docs: DataFrame, seq_len: int, order: str = "doc_id", parts: int = 64) -> DataFrame:
    """Documents of a lane one after another: the one that crosses is cut and its rest dropped, an end with loss follows a
    whole one if there is room. The fold runs per (lane, part), parts by a hash of the document, so a hot lane is spread."""

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        rows, toks, loss, seg, pos, members, at = [], [], [], [], [], [], 0

        def flush():
            nonlocal toks, loss, seg, pos, members, at
            n, gap = len(toks), seq_len - len(toks)
            s, lt = np.array(seg + [-1] * gap), np.array(loss + [False] * gap)
            mask = np.append((s[:-1] == s[1:]) & (s[:-1] >= 0) & lt[1:], False)
            rows.append((*key, len(rows), toks + [PAD] * gap, s.tolist(), pos + [0] * gap, mask.tolist(), n, members))
            toks, loss, seg, pos, members, at = [], [], [], [], [], 0

        for doc, ids in zip(g[order], g["ids"]):
            ids = list(ids)
            take = ids[: seq_len - len(toks)]
            toks, loss, seg, pos = toks + take, loss + [True] * len(take), seg + [at] * len(take), pos + list(range(len(take)))
            members.append(int(doc))
            if len(take) == len(ids) and len(toks) < seq_len:
                toks, loss, seg, pos = [*toks, EOS], [*loss, True], [*seg, at], [*pos, len(take)]
            at += 1
            if len(toks) >= seq_len:
                flush()
        if toks:
            flush()
        return pd.DataFrame(rows, columns=["lane", "part", "seq", "tokens", "seg", "pos", "loss_mask", "n_real", "members"])

    keyed = docs.withColumn("part", F.pmod(F.xxhash64(order), F.lit(parts)).cast("int"))
    schema = "lane string, part int, seq int, tokens array<int>, seg array<int>, pos array<int>, loss_mask array<boolean>, n_real int, members array<long>"
    return keyed.select("lane", "part", order, "ids").groupBy("lane", "part").applyInPandas(lambda k, g: run(k, g.sort_values(order)), schema)


def utilization(packed: DataFrame, seq_len: int) -> DataFrame:
    loss = F.size(F.filter("loss_mask", lambda x: x))
    sums = packed.groupBy("lane").agg(F.count("*").alias("sequences"), F.sum("n_real").alias("real"), F.sum(loss).alias("loss"))
    return sums.select("lane", "sequences", "real", "loss", F.bround(F.col("real") / (F.col("sequences") * seq_len), 4).alias("utilization"), F.bround(F.col("loss") / (F.col("sequences") * seq_len), 4).alias("loss_fraction"))


def positions(packed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, token, seg, pos, loss: a row per position."""
    both = packed.select(*keys, F.posexplode(F.arrays_zip("tokens", "seg", "pos", "loss_mask")).alias("at", "x"))
    return both.select(*keys, "at", F.col("x.tokens").alias("token"), F.col("x.seg").alias("seg"), F.col("x.pos").alias("pos"), F.col("x.loss_mask").alias("loss"))


def attention_pairs(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Allowed (query, key) pairs a sequence: causal, one segment, no padding. A segment of n tokens allows n (n + 1) / 2, so
    pairs are counted without being made."""
    n = positions(packed, keys).where("seg >= 0").groupBy(*keys, "seg").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2).cast("long").alias("allowed"))


def attention_mask(packed: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs themselves (at most seq_len squared a sequence, a fixed bound)."""
    p = positions(packed, keys).where("seg >= 0").select(*keys, "seg", "at")
    return p.withColumnRenamed("at", "i").join(p.withColumnRenamed("at", "j"), [*keys, "seg"]).where("j <= i").select(*keys, "i", "j")


def audit_packing(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Violations by kind: loss over a boundary, loss on padding, positions out of step."""
    w = Window.partitionBy(*keys).orderBy("at")
    p = positions(packed, keys).select("*", F.lead("seg").over(w).alias("next"), F.lag("seg").over(w).alias("prev"), F.lag("pos").over(w).alias("prev_pos"))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return p.agg(
        count(F.col("loss") & (F.col("next") != F.col("seg"))).alias("loss_over_boundary"),
        count(F.col("loss") & ((F.col("seg") < 0) | (F.col("next") < 0))).alias("loss_on_padding"),
        count((F.col("seg") >= 0) & (F.col("seg") == F.col("prev")) & (F.col("pos") != F.col("prev_pos") + 1)).alias("position_gaps"),
        count((F.col("seg") >= 0) & (F.col("prev").isNull() | (F.col("seg") != F.col("prev"))) & (F.col("pos") != 0)).alias("bad_starts"),
    )


def decide(candidates: DataFrame, seed: int) -> DataFrame:
    """lane and doc_id with score, decision and whether a protected lane overrides it."""
    base = F.coalesce(*(F.when(F.col("lane") == k, F.lit(v)) for k, v in ALIGNMENT.items()), F.lit(0.5))
    noise = F.pmod(seed63(F.concat_ws(":", F.lit(str(seed)), "lane", F.col("doc_id").cast("string"))), F.lit(10000)) / 10000.0 * 0.4 - 0.2
    scored = candidates.withColumn("score", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + noise)), 4))
    scored = scored.withColumn("decision", F.when(F.col("score") >= ACCEPT, "accept").when(F.col("score") >= DEFER, "defer").otherwise("reject"))
    return scored.withColumn("override", F.col("lane").isin(*STRUCTURED_LANES, "indic") & (F.col("decision") != "accept"))


def decision_summary(trail: DataFrame) -> DataFrame:
    counts = {d: F.count_if(F.col("decision") == d) for d in ("accept", "defer", "reject")}
    return trail.groupBy("lane").agg(*(c.alias(d) for d, c in counts.items()), F.count_if("override").alias("overrides"))


def epoch_draws(docs: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """draws (lane, k) to documents: the k-th draw is at k mod n of the permutation of epoch k div n, an order by seeded hash."""
    n = docs.groupBy("lane").agg(F.count("*").alias("n"))
    asked = draws.join(n, "lane").select("lane", "k", F.floor(F.col("k") / F.col("n")).alias("epoch"), F.pmod("k", "n").alias("pos"))
    perms = docs.join(asked.select("lane", "epoch").distinct(), "lane")
    h = seed63(F.concat_ws(":", F.lit(str(seed)), "lane", F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    perms = perms.withColumn("pos", (F.row_number().over(Window.partitionBy("lane", "epoch").orderBy(h, "doc_id")) - 1).cast("long"))
    return asked.join(perms.select("lane", "epoch", "pos", "doc_id"), ["lane", "epoch", "pos"]).select("lane", "k", "epoch", "pos", "doc_id")


# -- ledgers ---------------------------------------------------------------------------------------------------------


def chain(records: DataFrame) -> DataFrame:
    """records (ledger, seq, payload) with prev_hash and entry_hash: each hash covers its predecessor's. A chain has one
    order, so the fold is one group per ledger; ledgers run side by side."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        g, at, prevs, hashes = g.sort_values("seq"), GENESIS, [], []
        for p in g["payload"]:
            prevs.append(at)
            at = hashlib.sha256((at + "|" + p).encode()).hexdigest()
            hashes.append(at)
        return g[["ledger", "seq", "payload"]].assign(prev_hash=prevs, entry_hash=hashes)

    return records.select("ledger", "seq", "payload").groupBy("ledger").applyInPandas(run, "ledger string, seq long, payload string, prev_hash string, entry_hash string")


def verify_chain(entries: DataFrame) -> DataFrame:
    """ledger, entries, first_bad: a plain window, since each entry carries what it claims."""
    w = Window.partitionBy("ledger").orderBy("seq")
    own = F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256)
    ok = (F.col("entry_hash") == own) & (F.col("prev_hash") == F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS)))
    return entries.withColumn("ok", ok).groupBy("ledger").agg(F.count("*").alias("entries"), F.min(F.when(~F.col("ok"), F.col("seq"))).alias("first_bad"))


def truncate(entries: DataFrame, offset: int) -> DataFrame:
    """What a resume keeps."""
    return entries.where(F.col("seq") < offset)


def compare_runs(a: DataFrame, b: DataFrame, on: str, digest: str) -> DataFrame:
    """step, same: null-safe equality over a full join; a missing side differs."""
    joined = a.select(on, F.col(digest).alias("x")).join(b.select(on, F.col(digest).alias("y")), on, "full")
    return joined.select(on, F.col("x").eqNullSafe(F.col("y")).alias("same"))


def fork_differences(base: DataFrame, fork: DataFrame, on: str, digest: str) -> DataFrame:
    """Steps of the fork that the base also has with another digest."""
    joined = fork.select(on, F.col(digest).alias("x")).join(base.select(on, F.col(digest).alias("y")), on, "left")
    return joined.select(on, (F.col("y").isNotNull() & (F.col("x") != F.col("y"))).alias("differs"))


def firewall(consumed: DataFrame, held_out: DataFrame) -> DataFrame:
    """Consumed rows (step, members array) that hold held-out doc_ids, by split."""
    return consumed.select("step", F.explode("members").alias("doc_id")).join(held_out.select("doc_id", "split"), "doc_id").groupBy("split").agg(F.count("*").alias("leaks"))


def unexplained(consumed: DataFrame, trail: DataFrame) -> DataFrame:
    """Consumed (step, doc_id) without a decision: must be empty."""
    return consumed.join(trail.select("step", "doc_id").distinct(), ["step", "doc_id"], "left_anti")


def evidence(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """name, verdict: a check passes if its frame's one boolean is true."""
    rows = [df.select(F.lit(name).alias("name"), F.when(F.col(df.columns[0]), "PASS").otherwise("FAIL").alias("verdict")) for name, df in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
