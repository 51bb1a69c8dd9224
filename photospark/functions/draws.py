"""Pseudo-random draws that follow from a key and that any SQL engine can repeat.

A draw is the first 52 bits of the MD5 of ``stream:seed:key...`` as text, so
draws of different streams, seeds and keys are independent of each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 52
#: Bits of a draw that number the cells in which rows are ranked by draw.
CELL_BITS = 16


def draw(stream: str, seed: int, *key: Column) -> Column:
    """Whole number in [0, 2**52) of a stream, a seed and a key."""
    text = F.concat_ws(":", F.lit(stream), F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def uniform(stream: str, seed: int, *key: Column) -> Column:
    """Number in (0, 1): the middle of the cell of a draw."""
    return (draw(stream, seed, *key) + 0.5) / float(1 << DRAW_BITS)


def normal(stream: str, seed: int, *key: Column) -> Column:
    """Standard normal number from two independent uniform ones."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(f"{stream}-radius", seed, *key)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(f"{stream}-angle", seed, *key))


def cell(value: Column) -> Column:
    """Cell number of a draw, rising with it; the rows of a table spread evenly over the cells."""
    return F.shiftright(value, DRAW_BITS - CELL_BITS)
