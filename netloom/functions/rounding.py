"""Decimal rounding on the exact value of a double, ties to even.

``round`` and ``format_string`` round the shortest decimal text of a double
half-up, which differs for one value in a hundred when bytes are shown in
thousands. ``format_number`` with a pattern rounds the exact binary value, half
to even, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed_text(x: Column, digits: int) -> Column:
    """Text with exactly ``digits`` places and no grouping."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def exact_round(x: Column, digits: int) -> Column:
    """Nearest decimal with ``digits`` places, as a double."""
    return fixed_text(x, digits).cast("double")
