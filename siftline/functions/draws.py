"""Random draws that are functions of their arguments, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 48


def draw(*parts: Column) -> Column:
    """Whole number below 2**48 from the MD5 of the parts as text, joined by bars; a null part is empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def unit_draw(*parts: Column) -> Column:
    """Number from 0 up to, not including, 1."""
    return draw(*parts) / float(1 << DRAW_BITS)
