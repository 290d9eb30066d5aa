"""Numbers as the SQL statements round and print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: str | Column, digits: int) -> Column:
    """A double rounded half away from zero after scaling, like SQL engines that keep to doubles.

    F.round goes by the shortest decimal form instead: 28.5 / 400 to four digits is 0.0713 there, 0.0712 here.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * float(10**digits), 0) / float(10**digits)


def json_number(x: Column) -> Column:
    """A double as a value for to_json that is written without an exponent from 1e-12 on; others are written as they are."""
    plain = x.cast("decimal(18,12)")
    small = (F.abs(x) < 1e-3) & (x != 0) & (plain.cast("double") == x)
    return F.when(small, plain.cast("variant")).otherwise(x.cast("variant"))
