"""Numbers found in texts. A run of digits can be longer than any numeric type, so it is compared as text."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def plain(digits: Column) -> Column:
    """The digits without leading zeros."""
    return F.regexp_replace(digits, r"^0+(?=[0-9])", "")


def number(digits: Column, kind: str = "bigint") -> Column:
    """The value, or null where the type cannot hold it."""
    return digits.try_cast(kind)


def order(digits: Column) -> Column:
    """Sorts like the values: shorter is smaller, then digit by digit."""
    p = plain(digits)
    return F.struct(F.length(p).alias("length"), p.alias("digits"))


def successor(digits: Column) -> Column:
    """The digits of the next number."""
    p = plain(digits)
    nines = F.length(F.regexp_extract(p, r"(9*)$", 1))
    rest = F.length(p) - nines
    raised = (F.substring(p, rest, F.lit(1)).cast("int") + 1).cast("string")
    return F.concat(F.when(rest == 0, F.lit("1")).otherwise(F.concat(F.substring(p, F.lit(1), rest - 1), raised)), F.repeat(F.lit("0"), nines))
