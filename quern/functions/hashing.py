"""Hashes with fixed definitions, for provenance, seeds and signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType

# Fixed values of the signature: prime, seed and the generator's constants.
PRIME = (1 << 31) - 1
SEED = 0x5EED
MULTIPLIER, INCREMENT, MASK = 1103515245, 12345, 0x7FFFFFFF


def md5_uint32(c: Column) -> Column:
    """The first four bytes of md5, big-endian."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def seed63(c: Column) -> Column:
    """The first eight bytes of sha256 without the sign bit."""
    first = F.conv(F.substring(F.sha2(c, 256), 1, 1), 16, 10).cast("int").bitwiseAND(7)
    digits = F.concat(F.hex(first.cast("long")), F.substring(F.sha2(c, 256), 2, 15))
    return F.conv(digits, 16, 10).cast("long")


def permutations(n: int) -> list[tuple[int, int]]:
    """n pairs (a, b) of a seeded linear congruential generator."""
    drawn, x = [], SEED
    for _ in range(2 * n):
        x = (MULTIPLIER * x + INCREMENT) & MASK
        drawn.append(x)
    return [(1 + a % (PRIME - 1), b % PRIME) for a, b in zip(drawn[:n], drawn[n:])]


def minhash_sql(shingle_hashes: Column, n: int) -> Column:
    """Signature in built-in functions: exact, slow for many permutations."""
    pairs = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in permutations(n)))
    return F.transform(pairs, lambda p: F.coalesce(F.array_min(F.transform(shingle_hashes, lambda h: (p.a * (h % PRIME) + p.b) % PRIME)), F.lit(PRIME)))


def minhash_udf(n: int):
    """The same signature over arrays of uint32 hashes, vectorised."""
    pairs = permutations(n)

    @pandas_udf(ArrayType(LongType()))
    def signature(hashes):
        a, b = (np.array(x, dtype=np.uint64)[:, None] for x in zip(*pairs))

        def one(h):
            if h is None or not len(h):
                return np.full(n, PRIME, dtype=np.int64)
            h = np.asarray(h, dtype=np.uint64) % np.uint64(PRIME)
            best = np.full((n, 1), PRIME, dtype=np.uint64)
            for i in range(0, len(h), 4096):
                best = np.minimum(best, ((a * h[i : i + 4096] + b) % np.uint64(PRIME)).min(axis=1, keepdims=True))
            return best[:, 0].astype(np.int64)

        return hashes.map(one)

    return signature


@pandas_udf(StringType())
def canonical_sha256(payload):
    """sha256 of JSON with sorted keys, no spaces, ASCII escapes."""
    import hashlib
    import json

    return payload.map(lambda x: None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest())


@pandas_udf(StringType())
def ids_sha256(ids):
    """sha256 of little-endian unsigned 32-bit ids."""
    import hashlib

    return ids.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, dtype="<u4").tobytes()).hexdigest())


def corpus_sha256(df, text: str, order: str):
    """sha256 of all texts joined by newlines in order. One digest has one order, so one task streams the sorted rows."""

    def run(batches):
        import hashlib

        h, n = hashlib.sha256(), 0
        for b in batches:
            for t in b["t"]:
                h.update((b"\n" if n else b"") + (t or "").encode())
                n += 1
        yield pd.DataFrame({"sha256": [h.hexdigest()], "n": [n]})

    return df.select(F.col(order).alias("o"), F.col(text).alias("t")).orderBy("o", "t").coalesce(1).mapInPandas(run, "sha256 string, n long")
