"""Column expressions written down before there is a session: names, calls and operators are recorded and carried out on demand."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from typing import Any


class Later:
    """Stands for what ``make`` will give."""

    def __init__(self, make: Callable[[], Any]):
        self._make = make

    def __getattr__(self, name: str) -> Later:
        return Later(lambda: getattr(self._make(), name))

    def __getitem__(self, key: Any) -> Later:
        return Later(lambda: self._make()[now(key)])

    def __call__(self, *args: Any, **named: Any) -> Later:
        return Later(lambda: self._make()(*map(now, args), **{k: now(v) for k, v in named.items()}))

    def __invert__(self) -> Later:
        return Later(lambda: ~self._make())


def _both(op: Callable, swapped: bool) -> Callable:
    return lambda self, other: Later(lambda: op(now(other), self._make()) if swapped else op(self._make(), now(other)))


for _name in ("add", "sub", "mul", "truediv", "mod", "and_", "or_"):
    _plain = _name.rstrip("_")
    setattr(Later, f"__{_plain}__", _both(getattr(operator, _name), False))
    setattr(Later, f"__r{_plain}__", _both(getattr(operator, _name), True))
for _name in ("gt", "ge", "lt", "le", "eq", "ne"):
    setattr(Later, f"__{_name}__", _both(getattr(operator, _name), False))


def later(module: Any) -> Later:
    return Later(lambda: module)


def now(x: Any) -> Any:
    """The value of what was recorded, in containers and in what functions return too."""
    if isinstance(x, Later):
        return x._make()
    if isinstance(x, (list, tuple)):
        return type(x)(map(now, x))
    if callable(x) and not isinstance(x, type):
        return functools.wraps(x)(lambda *a: now(x(*a)))
    return x
