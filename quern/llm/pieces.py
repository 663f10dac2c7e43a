"""Encoding of whole texts piece by piece, each distinct piece once as long as it is remembered.

A text is cut before every space that a character follows which can't begin white space. No match of the byte-level
pattern spans such a cut: only its first character may be a space, and matches of white space stop before the last space
of a run. So pieces can be encoded alone. Pieces are looked up by their own text, so equal ids mean equal pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Characters of text encoded at once, pieces learnt at once, and the longest piece that is remembered.
GROUP, LEARNT, LONGEST = 1 << 21, 20_000, 256
#: Not ASCII white space, separators or controls, and no other character that any library counts as white space.
_PLAIN = "[^\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u206f\\u3000\\ufeff]"
_CUT = re.compile(f"(?= {_PLAIN})")
_UNSAFE = re.compile(f" (?!{_PLAIN})")


def cut(text: str) -> list[str]:
    """The pieces of a text, in order."""
    if _UNSAFE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + r for r in rest]]


class PieceCoder:
    """learn: texts of new pieces to their ids, little-endian unsigned 32-bit. Two generations of remembered pieces: a full
    young one becomes the old one, and what is met again returns. Bounds memory, not results."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], remembered: int):
        self.learn, self.remembered = learn, remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        cuts = [cut(t) for t in texts]
        known, old = self.young, self.old
        long: dict[str, bytes] = {}
        new = []
        for p in set().union(*cuts).difference(known):
            ids = old.get(p)
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        for i in range(0, len(new), LEARNT):
            part = new[i : i + LEARNT]
            for p, ids in zip(part, self.learn(part)):
                (known if len(p) <= LONGEST else long)[p] = ids
        get = known.__getitem__ if not long else {**known, **long}.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), dtype="<u4") for c in cuts]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for t in texts:
            if size > GROUP:
                out += self._group(group)
                group, size = [], 0
            group.append(t or "")
            size += len(t or "")
        return out + self._group(group)
