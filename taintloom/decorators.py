"""The decorators that sources carry, and the checks of tiers that they allow at run time.

Every name of the registry is a decorator here, bare or with arguments. A decorator records itself on the
function; the one nearest to the function has the last word on its tier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintloom.functions.domains import DECORATOR_TAINTS, GROUP, TIER

__all__ = [*GROUP, "TierViolation", "marks", "require", "set_violation_handler", "split_by_tier", "stamp", "tier_of"]

MARKS, STAMP = "__trust_marks__", "__trust_tier__"


class TierViolation(RuntimeError):
    """A value of a lower tier than was asked for."""


def marks(f: Callable) -> dict[str, dict[str, object]]:
    """Decorators of a function with their arguments, the nearest first."""
    return dict(getattr(f, MARKS, {}))


def _decorator(name: str) -> Callable:
    def mark(f: Callable, values: dict[str, object]) -> Callable:
        setattr(f, MARKS, marks(f) | {name: values})
        if name in DECORATOR_TAINTS and not hasattr(f, STAMP):
            setattr(f, STAMP, TIER[DECORATOR_TAINTS[name][1]])
        return f

    def decorate(*args: object, **kwargs: object) -> Callable:
        if len(args) == 1 and not kwargs and callable(args[0]):
            return mark(args[0], {})
        return lambda f: mark(f, {str(i): a for i, a in enumerate(args)} | kwargs)

    decorate.__name__ = decorate.__qualname__ = name
    return decorate


globals().update({name: _decorator(name) for name in GROUP})

_handler: Callable[[TierViolation], None] | None = None


def set_violation_handler(handler: Callable[[TierViolation], None] | None) -> None:
    """What happens on a violation: None raises it."""
    global _handler
    _handler = handler


def stamp(value: object, tier: int) -> object:
    """Record the tier of an object; a stamp that is there stays."""
    if not hasattr(value, STAMP):
        setattr(value, STAMP, tier)
    return value


def tier_of(value: object) -> int:
    return getattr(value, STAMP, 4)


def require(value: object, tier: int) -> object:
    """The value, if its tier is as trusted as asked for."""
    if tier_of(value) > tier:
        violation = TierViolation(f"tier {tier_of(value)} where {tier} is needed")
        if _handler is None:
            raise violation
        _handler(violation)
    return value


def split_by_tier(df: DataFrame, tier: str | Column, needed: int) -> tuple[DataFrame, DataFrame]:
    """The same check for tables: rows that may pass, and rows for quarantine; a null tier is the lowest."""
    t = F.coalesce(F.col(tier) if isinstance(tier, str) else tier, F.lit(4))
    return df.filter(t <= needed), df.filter(t > needed)
