"""Values to colours, in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import quantiles


def robust_limits(frame: DataFrame, low: float = 0.02, high: float = 0.98) -> tuple[float, float]:
    """The quantiles of the values between which colours run."""
    return tuple(quantiles(frame, F.col("value"), [low, high]) or (None, None))


def colour_bin(value: Column, low: float, high: float, colours: int) -> Column:
    """The place, from 1, of a value in a colour map, clamped to its ends."""
    place = F.floor((value - low) / (high - low) * colours) + 1
    return F.greatest(F.lit(1), F.least(F.lit(colours), place)).cast("int")


def map_to_colours(value: Column, colours: list[str], low: float, high: float, threshold: tuple[float, float] = (0, 0), zero: str = "#00000000") -> Column:
    """The colour of a value; values within the threshold interval, or 0, get ``zero``."""
    table = F.array(*[F.lit(c) for c in colours])
    hidden = (value == 0) | ((value > threshold[0]) & (value < threshold[1]))
    return F.when(hidden, F.lit(zero)).otherwise(table[colour_bin(value, low, high, len(colours)) - 1])
