"""The one memory of a Python worker. Workers live on from task to task and from operator to operator; what an operator remembers
between tasks (encoded words, their scores) is dropped when another operator, or another model, comes to the worker."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_held: list[tuple[Hashable, object]] = []


def held(key: Hashable, make: Callable[[], T]) -> T:
    """What this worker remembers for the key; made afresh, with all else forgotten, if it last worked for another."""
    if not _held or _held[0][0] != key:
        _held.clear()
        _held.append((key, make()))
    return _held[0][1]
