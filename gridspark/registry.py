"""A registry of pluggable parts under dotted keys."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, MutableMapping


class Registry(MutableMapping):
    def __init__(self) -> None:
        self._own: dict = {}

    def __getitem__(self, key: str):
        head, _, rest = key.partition(".")
        found = self._own[head]
        return found[rest] if rest else found

    def __setitem__(self, key: str, value) -> None:
        head, _, rest = key.partition(".")
        if rest:
            self._own.setdefault(head, Registry())[rest] = value
            return
        if head in self._own:
            warnings.warn(f"{head} is registered anew", stacklevel=3)
        self._own[head] = value

    def __delitem__(self, key: str) -> None:
        raise ValueError("registered parts cannot be deleted")

    def __iter__(self) -> Iterator[str]:
        return iter(self._own)

    def __len__(self) -> int:
        return len(self._own)


registry = Registry()


def register(key: str) -> Callable:
    """Decorator that puts a class or function into the registry."""

    def put(part):
        registry[key] = part
        return part

    return put
