"""Ids of whole texts by way of their distinct pieces, cut and looked up a window at a time in C (numpy and Arrow).

Texts are cut where every match of the byte-level pattern ends, as far as the bytes beside the place tell:

- between ASCII or Latin-1 letters, ASCII digits and other printable ASCII characters, if the kinds differ, and before a
  tab or line end that follows one of them; but not between an apostrophe and a letter, which may be one match;
- before a space, tab or line end that a character follows which can't be white space: matches of white space stop before
  the last of a run. Such a tab or line end is a match of its own, a space may belong to the next.

Beside all other characters there is no cut, so pieces of other scripts are longer, and right as well. A place is a cut
whatever stands further away, so pieces can be encoded alone. They are looked up by their own bytes, so equal ids mean equal
pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bytes of text cut at once (more where there is no cut), pieces learnt at once, and the longest piece that is remembered.
WINDOW, LEARNT, LONGEST = 1 << 22, 20_000, 256
#: Kinds of bytes. OTHER: of a character that is no white space, but may be a letter, digit or mark; UNSURE: the rest.
UNSURE, LETTER, DIGIT, SIGN, OTHER, SPACE, BREAK = range(7)
_KINDS = np.array(
    [
        SPACE if b == 0x20 else BREAK if b in b"\t\n\r" else UNSURE if b < 0x20 or b == 0x7F else OTHER if b > 0x7F else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN
        for b in range(256)
    ],
    dtype=np.uint8,
)
#: Like _PLAIN of quern.llm.pieces: bytes after a first byte that make a character which some library counts as white space.
_BLANKS = {0xC2: (b"[\x80-\xa0]", 1), 0xE1: (b"\x9a\x80|\xa0\x8e", 2), 0xE2: (b"\x80.|\x81[\x80-\xaf]", 2), 0xE3: (b"\x80\x80", 2), 0xEF: (b"\xbb\xbf", 2)}
_BLANK = {lead: (np.array([bool(re.fullmatch(pattern, bytes(p), re.S)) for p in (((i,) if n == 1 else (i >> 8, i & 255)) for i in range(256**n))]), n) for lead, (pattern, n) in _BLANKS.items()}


def kinds(text: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 (UNSURE stands at the first byte of a character)."""
    out = _KINDS[text]
    last = len(text) - 1
    latin = np.flatnonzero(text == 0xC3)
    following = text[np.minimum(latin + 1, last)]
    latin = latin[(following != 0x97) & (following != 0xB7)]
    out[latin] = LETTER
    out[np.minimum(latin + 1, last)] = LETTER
    for lead, (blank, n) in _BLANK.items():
        at = np.flatnonzero(text == lead)
        if len(at):
            code = text[np.minimum(at + 1, last)].astype(np.int64)
            if n == 2:
                code = code << 8 | text[np.minimum(at + 2, last)]
            out[at[blank[code]]] = UNSURE
    return out


def cuts(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a piece may begin at each byte. ends: where texts end, so that nothing follows the byte before."""
    kind = kinds(text)
    follows = np.zeros(len(text), dtype=bool)
    follows[:-1] = kind[1:] - np.uint8(LETTER) <= OTHER - LETTER
    follows[ends[ends > 0] - 1] = False
    out = (kind >= SPACE) & follows
    alone = np.flatnonzero(out & (kind == BREAK))
    known = kind - np.uint8(LETTER) <= SIGN - LETTER
    change = known[:-1] & (kind[1:] != kind[:-1]) & (known[1:] | (kind[1:] == BREAK))
    quotes = np.flatnonzero(text[:-1] == 0x27)
    change[quotes[kind[quotes + 1] == LETTER]] = False
    out[1:] |= change
    out[alone + 1] = True
    return out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class PretokenCoder:
    """learn: new pieces (UTF-8) to their ids, little-endian unsigned 32-bit. added: texts that the library takes out before
    it cuts; each is a piece of its own, and nothing follows what stands before it. Two generations of remembered pieces: a
    full young one becomes the old one, and what is met again returns. Bounds memory, not results."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], remembered: int, added: list[str]):
        self.learn, self.remembered = learn, remembered
        self.added = re.compile(b"|".join(re.escape(a.encode()) for a in sorted(added, key=len, reverse=True))) if added else None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        out = list(map(known.get, pieces))
        new = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            ids = old.get(pieces[k])
            if ids is None:
                new.append(k)
            else:
                out[k] = known[pieces[k]] = ids
        for i in range(0, len(new), LEARNT):
            part = new[i : i + LEARNT]
            for k, ids in zip(part, self.learn([pieces[k] for k in part])):
                out[k] = ids
                if len(pieces[k]) <= LONGEST:
                    known[pieces[k]] = ids
        return out

    def _window(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of a window, and how many each piece has."""
        offsets = np.append(starts, len(text)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
        _, offsets, data = pieces.dictionary.buffers()
        raw, ends = data.to_pybytes(), np.frombuffer(offsets, dtype=np.int32)[: len(pieces.dictionary) + 1].tolist()
        found = self._ids([raw[a:b] for a, b in zip(ends, ends[1:])])
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        which = pieces.indices.to_numpy()
        each = sizes[which]
        return flat[spans((np.cumsum(sizes) - sizes)[which], each)], each

    def _added(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of added texts inside single texts."""
        if self.added is None or not self.added.search(text):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        found = [(lo + m.start(), lo + m.end()) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()) for m in self.added.finditer(text[lo:hi])]
        return tuple(np.array(found, dtype=np.int64).reshape(-1, 2).T)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each whole text of an Arrow array; null is empty."""
        wide = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = wide.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, dtype=np.int64)
        text = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, dtype=np.uint8)
        ends = ends[1:] - ends[0]
        firsts, lasts = self._added(text, ends)
        parts = np.unique(np.concatenate([ends, firsts, lasts]))  # where nothing follows
        ids, before, reach = [], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
        lo, length = 0, WINDOW
        while lo < len(text):
            hi = min(lo + length, len(text))
            stops = parts[np.searchsorted(parts, lo, "right") : np.searchsorted(parts, hi, "right")] - lo
            place = cuts(text[lo:hi], stops)
            inside = slice(np.searchsorted(lasts, lo, "right"), np.searchsorted(firsts, hi))
            for a, b in zip(firsts[inside].tolist(), lasts[inside].tolist()):
                place[max(a - lo, 0) : b - lo] = False
            place[stops[stops < hi - lo]] = True
            place[0] = True
            starts = np.flatnonzero(place)
            if hi < len(text):  # the last piece may go on; a cut is told by three more bytes
                kept = starts[: np.searchsorted(starts, hi - lo - 3)]
                if len(kept) < 2:
                    length *= 2
                    continue
                hi, starts = lo + int(kept[-1]), kept[:-1]
            found, sizes = self._window(text[lo:hi], starts)
            ids.append(found)
            reach.append(lo + np.append(starts[1:], hi - lo))
            before.append(before[-1][-1] + np.cumsum(sizes))
            lo, length = hi, WINDOW
        flat = np.concatenate(ids) if ids else np.empty(0, dtype="<u4")
        upto = np.concatenate(before)[np.searchsorted(np.concatenate(reach), ends)]
        return np.split(flat, upto[:-1]) if len(ends) else []

