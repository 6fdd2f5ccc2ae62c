"""Small row sets inside a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def row_array(names: Sequence[str], *rows: Sequence[object]) -> Column:
    """Array of equally named structs, for ``inline``; plain values become literals."""

    def struct(values: Sequence[object]) -> Column:
        return F.struct(*[
            (value if isinstance(value, Column) else F.lit(value)).alias(name)
            for name, value in zip(names, values, strict=True)
        ])

    return F.array(*[struct(values) for values in rows])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside the lambda of an array function is otherwise computed again for every
    element, because adjacent projections are merged.
    """
    return F.transform(F.array(value), body)[0]
