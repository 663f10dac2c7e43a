"""What a Python worker remembers between tasks. Workers serve one operator after another; what an operator has remembered
(vocabularies, hashes of words, encoded pieces) is dropped when another one begins, and its memory given back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_clears: dict[str, list[Callable[[], None]]] = {}
_now = ""


def remembers(operator: str, clear: Callable[[], None]) -> None:
    """clear() drops something that the operator remembers in this process."""
    _clears.setdefault(operator, []).append(clear)


def trim() -> None:
    """Gives memory that is free back to the system."""
    gc.collect()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's
    if give:
        give(0)


def begin(operator: str) -> None:
    """A task of this operator begins in this process."""
    global _now
    if _now != operator:
        for clear in _clears.get(_now, []):
            clear()
        trim()
        _now = operator
