"""Element-wise maths where a value outside a function's domain is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def double(c: Column) -> Column:
    return c * 2


# Functions by name.
ELEMENTWISE = {
    "exp": F.exp,
    "sqrt": sqrt,
    "sign": F.signum,
    "abs": F.abs,
    "log": ln,
    "sin": F.sin,
    "tanh": F.tanh,
    "double": double,
}


def signed_zero(c: Column, digits: int) -> Column:
    """Rounded value without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
