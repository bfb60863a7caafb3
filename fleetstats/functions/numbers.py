"""Numbers as report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The unit ladders of byte counts and byte rates, and their base.
BASE = 1024
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")
RATE_UNITS = ("B/s", "KB/s", "MB/s")


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _unsigned_fixed(size: Column, digits: int) -> Column:
    """Fixed decimals of a value not below zero.

    ``format_number`` rounds the exact binary value, but sends ties to the even neighbour.  A tie
    exists only where ``x * 2**(digits + 1)`` is an odd integer; those values are moved off the tie.
    """
    tie = F.pmod(size * float(2 ** (digits + 1)), F.lit(2.0)) == 1.0
    off_tie = size + F.when(tie, F.lit(0.1 * 10.0**-digits)).otherwise(F.lit(0.0))
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", off_tie, F.lit(pattern))


def to_fixed(x: str | Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, ties away from zero."""
    value = _column(x).cast("double")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, _unsigned_fixed(F.abs(value), digits))


def _with_unit(value: Column, units: tuple[str, ...]) -> Column:
    """The largest unit the value reaches; no decimals in the first unit, one in the others.

    One formatted division serves all units, which keeps the generated method small enough to be
    compiled when a report formats several columns.
    """
    power = F.lit(len(units) - 1)
    for p in range(len(units) - 1, 1, -1):
        power = F.when(value < float(BASE**p), F.lit(p - 1)).otherwise(power)
    unit = F.element_at(F.array(*[F.lit(f" {u}") for u in units]), power + 1)
    scaled = value / F.pow(F.lit(float(BASE)), power)
    return F.when(
        value < BASE, F.concat(_unsigned_fixed(value, 0), F.lit(f" {units[0]}"))
    ).otherwise(F.concat(_unsigned_fixed(scaled, 1), unit))


def fmt_bytes(b: str | Column) -> Column:
    """Byte count: ``0 B``, ``512 B``, ``1.5 KB``, up to TB."""
    return _with_unit(_column(b).cast("double"), BYTE_UNITS)


def fmt_rate(bytes_per_second: str | Column) -> Column:
    """Byte rate up to MB/s; anything not above zero is ``0 B/s``."""
    value = _column(bytes_per_second).cast("double")
    return _with_unit(F.when(value > 0, value).when(value.isNotNull(), 0.0), RATE_UNITS)


def mem_text(used: str | Column, total: str | Column) -> Column:
    return F.concat(fmt_bytes(used), F.lit(" / "), fmt_bytes(total))
