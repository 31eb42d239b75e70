"""Numbers that do not depend on how an engine prints them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """x to `digits` decimals; ties go to the even neighbour. Always a double."""
    scale = F.lit(float(10**digits))
    return F.rint(x.cast("double") * scale) / scale


def present(x: Column) -> Column:
    """x unless it is null or 0: a metric of 0 counts as not measured."""
    return F.when(x != 0, x)


def micros(time: Column | str) -> Column:
    """Microseconds since 1970 of a time with or without zone (then of the session's)."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))
