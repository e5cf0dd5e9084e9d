"""Conditions over the intervals of a series, so that trees and rules can test series.

A modal condition asks whether some interval (or every one) of a series has a feature that
passes a test. As it is a formula like any other, branches, rules, ensembles and lists built
on it are applied by the same compiled columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import windows
from .conditions import DUALS, OPERATORS, SIGNS, Formula, number


@dataclass(frozen=True)
class ModalCondition(Formula):
    """⟨some⟩ or [every] interval of a length in [shortest, longest]: fun(variable) op threshold.

    With ``relation`` the intervals are those that stand in that relation to the whole series.
    NaN passes no test; a series without such an interval satisfies only the universal form,
    and a null one neither.
    """

    variable: str
    fun: str
    op: str
    threshold: float
    shortest: int = 1
    longest: int | None = None
    universal: bool = False
    relation: str | None = None

    def __post_init__(self):
        if self.op not in OPERATORS or self.shortest < 1 or (self.longest is not None and self.longest < self.shortest):
            raise ValueError(f"no modal condition: {self}")

    @property
    def dual(self) -> ModalCondition:
        return ModalCondition(self.variable, self.fun, DUALS[self.op], self.threshold, self.shortest, self.longest, not self.universal, self.relation)

    def worlds(self) -> Column:
        size, longest = F.size(f"`{self.variable}`"), self.longest
        if self.relation is None and self.fun == "mean" and self.op in ("<", "<=", ">", ">="):
            # a longer interval is cut into two, of which one has a mean as high, and one as low
            longest = min(longest or 2**30, 2 * self.shortest - 1)
        found = windows.filter_intervals(windows.all_intervals(size, longest), lambda w: windows.interval_length(w) >= self.shortest)
        whole = F.struct(F.lit(1).alias("x"), (size + 1).alias("y"))
        return windows.related(found, whole, self.relation) if self.relation else found

    def column(self, single: bool = False) -> Column:
        series = F.col(f"`{self.variable}`")
        if self.relation is None and self.fun in ("minimum", "maximum") and self.op in ("<", "<=", ">", ">="):
            # the shortest intervals decide, whatever the longest are
            make = windows.every_interval if self.universal else windows.some_interval
            return F.coalesce(F.when(series.isNotNull(), make(series, self.fun, self.op, self.threshold, self.shortest)), F.lit(False))
        make = windows.all_intervals_hold if self.universal else windows.exists_interval
        return F.coalesce(F.when(series.isNotNull(), make(series, self.worlds(), self.fun, self.op, self.threshold)), F.lit(False))

    def render(self, digits=None, show=None) -> str:
        inner = f"{self.fun}[{self.variable}] {SIGNS[self.op]} {show(self.threshold) if show else number(self.threshold, digits)}"
        return f"[{self.relation or 'G'}]({inner})" if self.universal else f"⟨{self.relation or 'G'}⟩({inner})"
