"""Helpers for nested columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` evaluated once a row.

    A column that is used inside a lambda is otherwise merged into it by the optimiser and evaluated for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
