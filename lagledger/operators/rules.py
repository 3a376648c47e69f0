"""Rule lists: a row is never dropped, it carries the names of the rules it fails."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(*rules: tuple[Column, str]) -> Column:
    """Ordered, distinct names of the conditions that hold (NULL counts as not held)."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules])))


def passes(reason_list: str | Column) -> Column:
    return F.size(F.col(reason_list) if isinstance(reason_list, str) else reason_list) == 0


def add_reasons(first: Column, *others: Column) -> Column:
    return F.array_distinct(F.concat(first, *others))


def must(condition: Column, value: Column, message: str) -> Column:
    """The value, or a failed query with ``message`` where the condition does not hold."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(
        F.raise_error(F.lit(message)).cast("string")
    )


def one_of(value: Column, allowed: Iterable[str]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))
