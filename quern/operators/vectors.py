"""Vectors: cosine, nearest neighbours, covariance and principal axes, byte codes and their separation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scripts import INDIC, byte_prefix, token_script


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, points: DataFrame, block: int = 512) -> DataFrame:
    """id, neighbour, distance: the closest other point by squared distance, ties to the smaller id. Queries are a stated set;
    they are packed into blocks and every point meets a block once, so rows made are points times blocks, not pairs."""
    packed = queries.select(F.floor(F.col("id") / block).alias("b"), F.struct(F.col("id").alias("qid"), F.col("v").alias("qv")).alias("q")).groupBy("b").agg(F.collect_list("q").alias("qs"))
    met = points.join(F.broadcast(packed)).select(F.explode(F.transform("qs", lambda q: F.struct(q.qid.alias("qid"), squared_distance(q.qv, F.col("v")).alias("d"), F.col("id").alias("nid")))).alias("x"))
    return met.where("x.qid <> x.nid").groupBy("x.qid").agg(F.min(F.struct("x.d", "x.nid")).alias("m")).select(F.col("qid").alias("id"), F.col("m.nid").alias("neighbour"), F.col("m.d").alias("distance"))


def covariance(points: DataFrame, dims: int) -> DataFrame:
    """i, j, cov (population) of all pairs of coordinates: pairs with i <= j are summed before the shuffle, then mirrored."""
    left = points.select("v", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("i"))
    pairs = left.select("i", F.explode(F.sequence("i", F.lit(dims - 1))).alias("j"), "v")
    x = lambda i: F.get("v", F.col(i)).cast("double")
    half = pairs.select("i", "j", x("i").alias("x"), x("j").alias("y")).groupBy("i", "j").agg(F.covar_pop("x", "y").alias("cov"))
    cells = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(F.explode(cells).alias("c"), "cov").select("c.i", "c.j", "cov")


def principal_axes(cov: DataFrame, dims: int, axes: int = 2, rounds: int = 100) -> list[list[float]]:
    """Power iteration with deflation from a fixed start, over a matrix of dims x dims numbers."""
    m = [[0.0] * dims for _ in range(dims)]
    for r in cov.collect():
        m[r["i"]][r["j"]] = r["cov"]
    out = []
    for _ in range(axes):
        v = [1.0 / (1 + i) for i in range(dims)]
        for _ in range(rounds):
            w = [sum(a * b for a, b in zip(row, v)) for row in m]
            n = math.sqrt(sum(x * x for x in w)) or 1.0
            v = [x / n for x in w]
        value = sum(v[i] * m[i][j] * v[j] for i in range(dims) for j in range(dims))
        out.append(v)
        m = [[m[i][j] - value * v[i] * v[j] for j in range(dims)] for i in range(dims)]
    return out


def project(points: DataFrame, axes: list[list[float]]) -> DataFrame:
    lit = lambda v: F.array(*map(F.lit, v))
    return points.select("id", *(dot(F.col("v"), lit(a)).alias(f"pc{k}") for k, a in enumerate(axes)))


def linear_chain(matrices: list[list[list[float]]]) -> list[list[float]]:
    """The one matrix that a chain of linear maps equals."""
    out = matrices[0]
    for m in matrices[1:]:
        out = [[sum(a * b for a, b in zip(row, col)) for col in zip(*out)] for row in m]
    return out


# -- byte codes ------------------------------------------------------------------------------------------------------


def position_basis(kind: str, position: Column, width: int) -> Column:
    """One position's vector: onehot, fourier (sine and cosine pairs), random (normals from a hash) or relative (fading)."""
    ks = F.sequence(F.lit(0), F.lit(width - 1))
    unit = lambda k, salt: (F.pmod(F.xxhash64(position, k, F.lit(salt)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    forms = {
        "onehot": lambda k: (position == k).cast("double"),
        "fourier": lambda k: F.when(k % 2 == 0, F.sin(position / F.pow(F.lit(10000.0), k / width))).otherwise(F.cos(position / F.pow(F.lit(10000.0), (k - 1) / width))),
        "random": lambda k: F.sqrt(-2 * F.log(unit(k, 1))) * F.cos(2 * math.pi * unit(k, 2)) / math.sqrt(width),
        "relative": lambda k: F.exp(-F.abs(position - k * 2) / 4.0),
    }
    return F.transform(ks, forms[kind])


def byte_codes(tokens: DataFrame, kind: str = "onehot", width: int = 32) -> DataFrame:
    """token_id, cell, x: sparse codes, each byte's row gathers its positions' vectors, scaled by 1 / sqrt(length)."""
    raw = F.encode("token", "UTF-8")
    n = F.octet_length("token")
    at = tokens.where(n > 0).select("token_id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("p"), raw.alias("raw"))
    if kind == "onehot":
        at = at.where(F.col("p") < width)
    byte = F.conv(F.hex(F.substring("raw", F.col("p") + 1, F.lit(1))), 16, 10).cast("int")
    cells = at.select("token_id", "n", byte.alias("byte"), F.posexplode(position_basis(kind, F.col("p"), width)).alias("k", "x")).where("x <> 0")
    return cells.groupBy("token_id", (F.col("byte") * width + F.col("k")).alias("cell")).agg(F.sum(F.col("x") / F.sqrt("n")).alias("x"))


def code_cosine(codes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the cosine of their sparse codes."""
    n = codes.groupBy("token_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    a = codes.select(F.col("token_id").alias("a"), "cell", F.col("x").alias("xa"))
    b = codes.select(F.col("token_id").alias("b"), "cell", F.col("x").alias("xb"))
    dots = pairs.join(a, "a").join(b, ["b", "cell"]).groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("d"))
    out = pairs.join(dots, ["a", "b"], "left").join(n.select(F.col("token_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("token_id").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.coalesce("d", F.lit(0.0)) / (F.col("na") * F.col("nb"))).alias("cosine"))


def census(tokens: DataFrame) -> DataFrame:
    """script, tokens, mean and longest bytes."""
    n = F.octet_length("token")
    return tokens.withColumn("script", token_script(F.col("token"))).groupBy("script").agg(F.count("*").alias("tokens"), F.bround(F.avg(n), 2).alias("mean_bytes"), F.max(n).cast("long").alias("max_bytes"))


def truncated(tokens: DataFrame, windows: tuple[int, ...] = (32, 48, 64)) -> DataFrame:
    """window, script, cut: tokens longer than each window."""
    each = tokens.withColumn("script", token_script(F.col("token"))).select("script", F.octet_length("token").alias("n"), F.explode(F.array(*map(F.lit, windows))).alias("window"))
    return each.groupBy("window", "script").agg(F.count_if(F.col("n") > F.col("window")).alias("cut"), F.bround(100 * F.avg((F.col("n") > F.col("window")).cast("int")), 2).alias("pct"))


def collisions(tokens: DataFrame, window: int) -> DataFrame:
    """script, clusters, collided: tokens with the same first bytes; a cluster counts for its most common script, ties by name."""
    keyed = tokens.select(byte_prefix(F.col("token"), window).alias("prefix"), token_script(F.col("token")).alias("script"))
    per = keyed.groupBy("prefix", "script").agg(F.count("*").alias("n"))
    cluster = per.groupBy("prefix").agg(F.sum("n").alias("n"), F.min(F.struct(-F.col("n"), "script"))["script"].alias("script")).where("n > 1")
    return cluster.groupBy("script").agg(F.count("*").alias("clusters"), F.sum("n").alias("collided"))


def indic_share(found: DataFrame) -> DataFrame:
    part = F.sum(F.when(F.col("script").isin(INDIC), F.col("collided")).otherwise(0))
    return found.agg(F.bround(100 * F.coalesce(part, F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("collided"), F.lit(0))), 1).alias("indic_pct"))


def prefix_pairs(tokens: DataFrame, least: int = 4, n: int = 400) -> DataFrame:
    """Up to n pairs (a, b): the first two tokens by hash of every shared beginning of `least` letters."""
    from pyspark.sql import Window

    fertile = tokens.where((F.length("token") >= least + 2) & ~F.col("token").rlike(r"\p{C}"))
    w = Window.partitionBy("p").orderBy(F.xxhash64("token"), "token_id")
    ranked = fertile.select("token_id", "token", F.substring("token", 1, least).alias("p")).withColumn("r", F.row_number().over(w)).where("r <= 2")
    return ranked.groupBy("p").agg(F.min_by("token_id", "r").alias("a"), F.max_by("token_id", "r").alias("b")).where("a <> b").orderBy(F.xxhash64("p")).limit(n).select("a", "b")


def unrelated_pairs(tokens: DataFrame, n: int = 400) -> DataFrame:
    """Up to n pairs (a, b) of tokens of over three letters whose first two differ: the k-th of one order by hash with the
    k-th of another; orders are read four times as far, for those pairs that begin alike."""
    from pyspark.sql import Window

    flat = tokens.where(F.length("token") > 3)

    def side(seed: int, name: str) -> DataFrame:
        first = flat.select(F.col("token_id").alias(name), F.substring("token", 1, 2).alias(f"p{name}"), F.xxhash64("token", F.lit(seed)).alias("h")).orderBy("h", name).limit(4 * n)
        return first.withColumn("k", F.row_number().over(Window.orderBy("h", name))).drop("h")

    return side(1, "a").join(side(2, "b"), "k").where("pa <> pb").orderBy("k").limit(n).select("a", "b")


def separation(cosines: DataFrame, clusters: DataFrame) -> DataFrame:
    """Over clusters (cluster, a, b): least separation, upper median of separations, clusters still colliding."""
    worst = cosines.join(clusters, ["a", "b"]).groupBy("cluster").agg(F.max("cosine").alias("c"))
    ordered = F.sort_array(F.collect_list(1 - F.col("c")))
    return worst.agg(F.min(1 - F.col("c")).alias("least"), F.get(ordered, F.floor(F.count("*") / 2).cast("int")).alias("median"), F.count_if(F.col("c") > 1 - 1e-6).alias("colliding"))
