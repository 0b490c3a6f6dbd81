"""Revenue gating and capping.

``least`` in Spark skips NULL arguments, so ``least(NULL, cap)`` is ``cap``; the
report needs NULL there (SURVEY T1), hence the explicit guards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def revenue_gate(micros: Column, flag: Column, bound: int | Column) -> Column:
    """``micros`` when ``flag`` holds and ``-bound < micros < bound``, else NULL."""
    return F.when(flag & (micros > -bound) & (micros < bound), micros)


def capped(micros: Column, cap_micros: int | Column) -> Column:
    """``min(micros, cap)``; NULL stays NULL. No lower cap."""
    return F.when(micros.isNotNull(), F.least(micros, F.lit(cap_micros)))


def squared_capped(micros: Column, cap_micros: int | Column) -> Column:
    """``min(micros / 1e6, cap / 1e6) ** 2`` in dollars squared; NULL stays NULL."""
    dollars = micros.cast("double") / MICROS
    return F.when(micros.isNotNull(), F.pow(F.least(dollars, F.lit(cap_micros / MICROS)), 2))


def to_dollars(micros: Column) -> Column:
    return micros.cast("double") / MICROS
