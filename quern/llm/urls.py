"""URL filter: explicit host and path rules, else gradient-boosted trees on lexical features (operator 2).

The labelled URLs are those on which a rule decides; the trees learn from a bounded sample of them (TRAIN_ROWS, by
hash of the url) and judge all others. Suffix statistics (block share by last host label) cover every labelled URL.

Defined cases: a null url, or one without `://`, has empty host and path and is judged by its (zero) features; equal
urls get equal verdicts; with no labelled URL, or labels of one kind only, the trees return that share (allow if there
is none); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import prepare, salted_left_join, table

#: (rule, verdict): host suffix, then path prefix.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
TRAIN_ROWS = 20_000
FEATURES = ["length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "params", "query_length", "hyphens", "suffix_rate"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no `://`."""
    u = F.coalesce(F.col(url), F.lit(""))
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, cut, 1), _UPPER, _LOWER), F.regexp_extract(u, cut, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def lexical(url: str | None, host: str, path: str) -> list[float]:
    u = url or ""
    counts = Counter(u)
    n = max(len(u), 1)
    query = u.partition("#")[0].partition("?")[2]
    return [
        float(len(u)), float(len(host)), float(len(path)), float(sum(1 for p in path.split("/") if p)), float(host.count(".") + 1 if host else 0),
        sum(c in "0123456789" for c in u) / n, -sum(c / n * math.log2(c / n) for c in counts.values()) if u else 0.0,
        float(sum(1 for p in query.split("&") if p)), float(len(query)), float(host.count("-")),
    ]


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on binned features (at most 64 bins each)."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        if len(y) == 0 or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.0
            self.start = 8.0 * (2 * share - 1)
            return self
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            self._grow(tree, bins, edges, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._one(tree, x)
        return self

    def _grow(self, tree, bins, edges, g, h, rows, depth) -> int:
        """Appends a node (feature, edge, left, right, value) and returns its place. Ties go to the first feature and edge."""
        at = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree.append((-1, 0.0, -1, -1, self.rate * total_g / (total_h + 1.0)))
        best = (1e-9, -1, -1)
        if depth and len(rows) >= 2 * self.least:
            for f, e in enumerate(edges):
                if len(e) == 0:
                    continue
                b = bins[rows, f]
                cg, ch, cn = (np.bincount(b, w, len(e) + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                gain[(cn < self.least) | (len(rows) - cn < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            left = bins[rows, f] <= k
            a = self._grow(tree, bins, edges, g, h, rows[left], depth - 1)
            b = self._grow(tree, bins, edges, g, h, rows[~left], depth - 1)
            tree[at] = (f, float(edges[f][k]), a, b, 0.0)
        return at

    @staticmethod
    def _one(tree, x: np.ndarray) -> np.ndarray:
        feature, edge, left, right, value = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return value[at]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= edge[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.start)
        for tree in self.trees:
            s += self._one(tree, x)
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _features_of(b: pa.RecordBatch) -> np.ndarray:
    rows = [lexical(u, h, p) + [r] for u, h, p, r in zip(*(b.column(c).to_pylist() for c in ("url", "host", "path", "suffix_rate")))]
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))


def _judged(model: Boosted):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("page_id", "host", "path", "rule", "rule_verdict")), pa.array(model.probability(_features_of(b)), pa.float64())],
                names=["page_id", "host", "path", "rule", "rule_verdict", "p_block"],
            )

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every page."""
    host, path = url_parts()
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("rule_verdict", verdict).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
    blocked = (F.col("rule_verdict") == "block").cast("double")
    rates = parts.where("rule_verdict is not null").groupBy("suffix").agg(((F.sum(blocked) + 1) / (F.count("*") + 2)).alias("suffix_rate"))
    full = salted_left_join(parts, rates, "suffix", "page_id").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(0.5)))
    sample = full.where("rule_verdict is not null").orderBy(F.xxhash64("url"), "page_id").limit(train_rows)
    table_ = sample.select("url", "host", "path", "suffix_rate", "rule_verdict").toArrow().to_batches()
    x = np.concatenate([_features_of(b) for b in table_]) if table_ else np.empty((0, len(FEATURES)))
    y = np.array([float(v == "block") for b in table_ for v in b.column("rule_verdict").to_pylist()])
    model = Boosted().fit(x, y)
    kind = pages.schema["page_id"].dataType.simpleString()
    out = full.select("page_id", "url", "host", "path", "rule", "rule_verdict", "suffix_rate").mapInArrow(
        _judged(model), f"page_id {kind}, host string, path string, rule string, rule_verdict string, p_block double"
    )
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "p_block")


def op2_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    return judge_urls(table(prepare(spark), sf_dir, "pages"))


QUERIES = {"op2_url_trees": op2_url_trees}
ORACLES: dict[str, str] = {}
