"""Boxes, rounding and colours as column expressions. Boxes are half-open: x0 <= x < x1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(a: str, b: str) -> Column:
    """Pixels that the boxes a.* and b.* share; a and b are prefixes such as "a.". """
    w = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    h = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def half_even(x: Column) -> Column:
    """Rounding to an integer, halves to the even one."""
    return F.bround(x.cast("double"), 0).cast("long")


def _units(x: Column, n: int) -> Column:
    """How many units of n decimals a number of 0 or more is, by its exact binary value, halves to the even number. It is compared with the midpoint without
    error: x is split into two halves of 26 bits, whose products with 2 * 10 ** n are exact."""
    twice = F.lit(float(2 * 10**n))
    k = F.floor(x * F.lit(float(10**n)))
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    above, low = high * twice - (2 * k + 1).cast("double"), -((x - high) * twice)
    return F.when(above > low, k + 1).when(above < low, k).otherwise(k + k % 2)


def _signed(x: Column, n: int, form) -> Column:
    return F.when(F.signum(x) < 0, F.concat(F.lit("-"), form(_units(-x, n)))).otherwise(form(_units(x, n)))


def decimals(x: Column, n: int) -> Column:
    """x rounded to n decimals as text, as Python formats it: by what the double is, halves to the even digit."""
    text = lambda u: F.concat((u / 10**n).cast("long").cast("string"), F.lit("."), F.lpad((u % 10**n).cast("string"), n, "0"))
    return _signed(x.cast("double"), n, text)


def round_n(x: Column, n: int) -> Column:
    """Python's round(x, n); F.round and F.bround round what the double is written as, not what it is."""
    x = x.cast("double")
    return F.when(F.signum(x) < 0, -(_units(-x, n) / F.lit(float(10**n)))).otherwise(_units(x, n) / F.lit(float(10**n)))


def shortest(x: Column, n: int) -> Column:
    """round_n as Python writes it: no zeros at the end but one after the point."""
    return F.regexp_replace(decimals(x, n), r"(\.\d+?)0+$", "$1")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def from_hex(colour: Column) -> Column:
    """An array of r, g, b."""
    return F.array(*[F.conv(F.substring(colour, k, 2), 16, 10).cast("int") for k in (2, 4, 6)])

