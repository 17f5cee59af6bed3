"""Byte quantities such as ``2Gi`` or ``2.2Ti`` as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal suffixes and their powers of ten, binary suffixes and their powers of two.
POWERS_OF_TEN = {"n": -9, "u": -6, "m": -3, "": 0, "k": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18}
POWERS_OF_TWO = {"Ki": 10, "Mi": 20, "Gi": 30, "Ti": 40, "Pi": 50, "Ei": 60}
_SHAPE = r"^([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)(?:[eE]([+-]?\d+)|([numkMGTPE]|[KMGTPE]i)?)$"


def quantity(text: Column) -> Column:
    """Quantity text as ``decimal(38,9)``; null if it is none."""
    number, power, unit = (F.regexp_extract(text, _SHAPE, i) for i in (1, 2, 3))
    tens = F.create_map(*[F.lit(str(x)) for pair in POWERS_OF_TEN.items() for x in pair])
    twos = F.create_map(*[F.lit(x) for k, v in POWERS_OF_TWO.items() for x in (k, 2**v)])
    # a power of ten is exact as text, a power of two as a whole number
    exponent = F.when(power != "", power).otherwise(F.try_element_at(tens, unit))
    two = F.try_element_at(twos, unit).cast("decimal(19,0)")
    value = number.try_cast("decimal(28,9)")
    # whole and fraction apart, as one product would need more digits than a decimal has
    whole, rest = F.floor(value), (value - F.floor(value)).cast("decimal(9,9)")
    binary = F.try_add(F.try_multiply(whole, two).try_cast("decimal(38,9)"), (rest * two).cast("decimal(38,9)"))
    scaled = F.coalesce(F.concat(number, F.lit("e"), exponent).try_cast("decimal(38,9)"), binary.try_cast("decimal(38,9)"))
    return F.when(text.rlike(_SHAPE), scaled)
