"""What a worker process keeps between its tasks. The module is imported there, so its memory is not sent along with tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_KEPT: dict[Hashable, Any] = {}


def once(key: Hashable, make: Callable[[], Any]) -> Any:
    """make()'s result, made the first time a key is asked for in this process."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]
