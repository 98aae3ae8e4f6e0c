"""Small helpers for building Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lit_array(values: Iterable) -> Column:
    return F.array(*[F.lit(value) for value in values])


def let(value, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names
    it. Keeps plans small where nested CASE expressions would copy their input."""
    return F.get(F.transform(F.array(as_col(value)), body), F.lit(0))


def flag(condition: Column, name) -> Column:
    """The flag's name where the condition holds, else NULL (also where it is NULL)."""
    return F.when(condition, F.lit(name) if isinstance(name, str) else name)


def first_reason(*reasons: tuple[Column, str], default: Column | str | None = None) -> Column:
    """Ordered CASE: the first reason whose condition holds."""
    chain = None
    for condition, reason in reasons:
        value = F.lit(reason) if isinstance(reason, str) else reason
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if default is None:
        return chain
    return chain.otherwise(F.lit(default) if isinstance(default, str) else default)


def is_true(value) -> Column:
    return F.coalesce(as_col(value), F.lit(False))


def is_false(value) -> Column:
    return F.coalesce(~as_col(value), F.lit(False))


def equals(value, literal) -> Column:
    """Equality that is False, never NULL, on NULL."""
    return as_col(value).eqNullSafe(F.lit(literal))
