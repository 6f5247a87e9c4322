"""Number expressions: parsing, closeness, normalising, percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchsieve.functions.text import strip

# Decimal notation that needs no more checks, and with single
# underscores between digits and any white space around.
PLAIN = r"^[ \t\n\r]*[+-]?(?:[0-9]{1,200}\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,2})?[ \t\n\r]*$"
DIGITS = r"[0-9]+(?:_[0-9]+)*"
DECIMAL = rf"^[+-]?(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?$"


def _finite(number: Column) -> Column:
    return F.when(F.abs(number) < float("inf"), number)


def parse_number(df: DataFrame, name: str) -> Column:
    """Read a column as finite double; anything else is null.

    Text in plain notation is cast at once. Other text is stripped, checked and
    cast without underscores.
    """
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return _finite(column.cast("double"))
    text = strip(column)
    rare = F.when(
        text.rlike(DECIMAL),
        _finite(F.replace(text, F.lit("_"), F.lit("")).try_cast("double")),
    )
    return F.when(column.rlike(PLAIN), column.try_cast("double")).otherwise(rare)


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero, on the binary value scaled by a power of ten.

    Rounding the shortest decimal text of the value would lift 81.725, whose
    binary value is below the half, to 81.73.
    """
    scale = float(10**digits)
    return F.round(value * scale, 0) / scale


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b))


def lower_is_better(value: Column, low: Column, high: Column) -> Column:
    """1 at ``low`` and 0 at ``high``; 1 everywhere when the two are close."""
    return F.when(is_close(low, high), F.lit(1.0)).otherwise(
        F.lit(1.0) - F.try_divide(value - low, high - low)
    )


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent; null when ``old`` is zero."""
    return F.try_divide(new - old, old) * F.lit(100.0)


def floored_percent_change(new: Column, old: Column, floor: float) -> Column:
    return (new - old) / F.greatest(old, F.lit(floor)) * F.lit(100.0)
