"""Word hashes: a keyed 64-bit BLAKE2b hash of each distinct word, one array per text.

Words are runs of other bytes than ASCII white space, A-Z lower-cased. A worker remembers the hashes of words it has
met; the table is emptied when full, which bounds memory, not results. The hash is a keyed cryptographic one, so no
family of texts (periodic words, Thue-Morse words) collides by structure: two given words agree with a chance of 2**-64,
any two of n distinct words with n * n / 2**65 (3e-6 for ten million).
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Words that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 256
_KEY = b"quern word hash 1"


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Table(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")
        if len(word) <= LONGEST:
            self[word] = h
        return h


_table = _Table()


def forget() -> None:
    _table.clear()


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """One array of word hashes per text, in order."""
    out = []
    for t in texts:
        if len(_table) > REMEMBERED:
            _table.clear()
        # bytes.lower() changes A-Z alone, bytes.split() cuts at ASCII white space alone
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        out.append(np.fromiter(map(_table.__getitem__, words), dtype=np.uint64, count=len(words)))
    return out
