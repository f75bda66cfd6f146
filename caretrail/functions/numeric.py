"""Numeric scalars: bins, z-scores, nearest-rank percentiles, packed codes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

HOUR_US = 3_600_000_000


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def bin_share(x: Column, name: str) -> Column:
    """A value on its scale from 0 to 1, clamped; null if missing."""
    _, low, high, log = C.NUMERIC_BINS[name]
    v = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    a, b = (math.log1p(low), math.log1p(high)) if log else (low, high)
    share = ((F.log1p(v) if log else v) - a) / (b - a if b > a else 1.0)
    return F.when(finite(x), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def bin_id(x: Column, name: str) -> Column:
    """1 to the number of bins; 0 if missing."""
    n = C.NUMERIC_BINS[name][0]
    share = bin_share(x, name)
    return F.when(share.isNull(), 0).otherwise(F.least(F.greatest(F.lit(1), F.floor(share * (n - 1)).cast("int") + 1), F.lit(n)))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return F.least(F.greatest((x - mean) / F.when(std <= 0, 1.0).otherwise(std), F.lit(-8.0)), F.lit(8.0))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at the rank q * (n - 1), halves to even; 0 of nothing. values: an
    array of numbers without nulls."""
    at = F.bround(F.lit(q) * (F.size(values) - 1)).cast("int")
    return F.when(F.size(values) > 0, F.get(F.sort_array(values), at)).otherwise(F.lit(0).cast("double"))


def step(x: Column, limits: tuple[float, ...]) -> Column:
    """How many of the limits x has reached."""
    return sum((F.when(x >= v, 1).otherwise(0) for v in limits), F.lit(0))


def pack(codes: Column, base: int) -> Column:
    """Codes of one stack as a number, the first the least digit."""
    return F.aggregate(F.reverse(codes), F.lit(0).cast("long"), lambda a, x: a * base + x)


def unpack(packed: Column, base: int, n: int) -> Column:
    """The digits of a packed number that fits a long, by whole-number division."""
    digit = lambda i: F.call_function("div", packed, F.lit(base**i)) % base if base**i < 1 << 63 else F.lit(0).cast("long")
    return F.array(*[digit(i).cast("long") for i in range(n)])


def hash_lane(text: Column, buckets: int) -> Column:
    return F.crc32(F.encode(text, "UTF-8")) % buckets + 1


def number_text(x: Column) -> Column:
    """A number to three decimals, without zeros and a point at its end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x), "0+$", ""), r"\.$", "")


def gap_input(hours: Column, most: float = 672.0) -> Column:
    """A gap in hours as a model's input: clipped, on a log scale."""
    return F.log1p(F.least(F.greatest(hours, F.lit(0.0)), F.lit(most)))


def age_input(years: Column, most: float = 100.0) -> Column:
    """An age as a model's input, 0 to 1; 0 if missing."""
    return F.when(finite(years), F.least(F.greatest(years, F.lit(0.0)), F.lit(most)) / most).otherwise(0.0)


def level_id(base: int, level: Column, stride: int, code: Column) -> Column:
    """The token id of a code of one level of a stack."""
    return F.lit(base) + level * stride + code


def level_code(token: Column, base: int, stride: int) -> tuple[Column, Column]:
    """The level and the code of such a token id."""
    return F.call_function("div", token - base, F.lit(stride)), (token - base) % stride
