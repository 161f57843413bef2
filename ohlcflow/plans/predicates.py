"""Scan predicates.

A predicate names the indicators it needs and the condition it checks on
the latest bar.  Conditions compare with the screener's strictness:
``>=`` for price, volume, relative volume and ADR; ``>`` for gap and trend.
A NULL (warm-up) value fails the predicate.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import indicators as I


@dataclass(frozen=True)
class Predicate:
    name: str
    indicators: tuple = ()
    build: Callable[[], Column] = field(default=lambda: F.lit(True), compare=False, repr=False)

    @property
    def condition(self) -> Column:
        return self.build()


def min_price(x: float) -> Predicate:
    return Predicate(f"min_price({x})", (), lambda: F.col("close") >= F.lit(float(x)))


def min_volume(x: float) -> Predicate:
    return Predicate(f"min_volume({x})", (), lambda: F.col("volume") >= F.lit(x))


def min_rvol(x: float, period: int = 20) -> Predicate:
    return Predicate(f"min_rvol({x},{period})", (I.rvol(period),),
                     lambda: F.col(f"rvol_{period}") >= F.lit(float(x)))


def min_adr(x: float, period: int = 20) -> Predicate:
    return Predicate(f"min_adr({x},{period})", (I.adr(period),),
                     lambda: F.col(f"adr_{period}") >= F.lit(float(x)))


def gap_up(pct: float) -> Predicate:
    factor = 1.0 + float(pct) / 100.0
    return Predicate(f"gap_up({pct})", (I.prev_high(),),
                     lambda: F.col("open") > F.col("prev_high") * F.lit(factor))


TREND_CHECKS = {
    "close_gt_sma_50": lambda: F.col("close") > F.col("sma_50"),
    "sma_50_gt_sma_150": lambda: F.col("sma_50") > F.col("sma_150"),
    "sma_150_gt_sma_200": lambda: F.col("sma_150") > F.col("sma_200"),
    "sma_200_rising": lambda: F.col("sma_200") > F.col("sma_200_1m_ago"),
    "above_low_252": lambda: F.col("close") > F.col("low_252") * F.lit(1.25),
    "near_high_252": lambda: F.col("close") > F.col("high_252") * F.lit(0.75),
}


def trend_template() -> Predicate:
    return Predicate("trend_template", tuple(I.trend_suite()),
                     lambda: reduce(lambda a, b: a & b, [f() for f in TREND_CHECKS.values()]))


def all_of(preds) -> Predicate:
    """conjunction; the empty conjunction is TRUE."""
    preds = list(preds)
    inds = tuple(i for p in preds for i in p.indicators)
    return Predicate(" & ".join(p.name for p in preds) or "true", inds,
                     lambda: reduce(lambda a, b: a & b, [p.condition for p in preds], F.lit(True)))


def required_indicators(preds) -> list:
    return I.dedupe(i for p in preds for i in p.indicators)
