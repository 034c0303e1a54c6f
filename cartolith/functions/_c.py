"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(value) -> Column:
    """A column from a name, a column or a plain number."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def long(value) -> Column:
    return c(value).cast("bigint")


def strict_int(value) -> Column:
    return c(value).cast("int")


def first_code(*rules) -> Column:
    """The code of the first rule that holds, in the given order, else null.

    A rule whose test is null counts as not holding, so callers state null handling.
    """
    chain = None
    for test, code in rules:
        code = code if isinstance(code, Column) else F.lit(code)
        chain = F.when(test, code) if chain is None else chain.when(test, code)
    return chain


def all_codes(*rules) -> Column:
    """Every code whose rule holds, in the given order, as an array."""
    return F.array_compact(
        F.array(*[F.when(t, k if isinstance(k, Column) else F.lit(k)) for t, k in rules])
    )


def finite(value) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    v = c(value).cast("double")
    return F.coalesce(
        ~F.isnan(v) & (v != F.lit(float("inf"))) & (v != F.lit(float("-inf"))), F.lit(False)
    )


def lookup(mapping: dict[str, object], key: Column) -> Column:
    """Value of a fixed dictionary, null for an unknown or null key."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it.

    Keeps expressions small: a plain Column is repeated in the plan at every use, and a
    filter pushed below a projection repeats it again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value) -> Column:
    """``value`` worked out once per row, as a generator of one row.

    Filters and fields taken from the new column later stay behind it; from a plain column Spark copies the whole
    expression into each of them. One such column a select.
    """
    return F.explode(F.array(c(value)))
