"""Small building blocks for composing column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    Plain Python composition repeats a sub-expression at every use, which for
    a span list means running the regexes several times per row.  A one-element
    ``transform`` binds it to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_if(value: Column, predicate: Callable[[Column], Column]) -> Column:
    """An array holding ``value`` if the predicate is true, else empty.

    ``explode(keep_if(render(text), changed))`` filters on an expensive column
    without the optimizer pushing (and so repeating) it below the projection.
    """
    return F.filter(F.array(value), predicate)


def empty_array(element_ddl: str) -> Column:
    return F.array().cast(f"array<{element_ddl}>")
