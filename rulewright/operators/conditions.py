"""Conditions on table columns, and formulas over them, compiled to Spark columns.

A comparison with NaN or null holds for no operator, so every atom is guarded: an atom and
its dual are both false on NaN. Applying a model is different, see ``models``: there a row
that does not satisfy the atom takes the other branch, whatever the reason.
"""

from __future__ import annotations

import functools
import operator
import random
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable] = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
DUALS = {"<": ">=", ">=": "<", "<=": ">", ">": "<=", "==": "!=", "!=": "=="}
SIGNS = {"<=": "≤", ">=": "≥", "!=": "≠", "==": "=", "<": "<", ">": ">"}
_SPELLED = {"≤": "<=", "≥": ">=", "≠": "!=", "=": "==", "⪯": "<=", "⪰": ">="} | {k: k for k in OPERATORS}


def number(x: float, digits: int | None = None) -> str:
    """A threshold as text, rounded to ``digits`` decimals if they are given."""
    return f"{x:.{digits}f}" if digits is not None else repr(float(x))


@dataclass(frozen=True)
class MetaCondition:
    """A feature and a test operator without a threshold."""

    feature: str
    op: str

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown test operator {self.op!r}")

    @property
    def dual(self) -> MetaCondition:
        return MetaCondition(self.feature, DUALS[self.op])

    def __str__(self) -> str:
        return f"{self.feature} {SIGNS[self.op]} ⍰"


class Formula:
    """Anything that compiles to a boolean column."""

    def column(self, single: bool = False) -> Column:
        """True where the formula is certain to hold; ``single`` compares as 32-bit floats."""
        raise NotImplementedError

    @property
    def dual(self) -> Formula:
        return Not(self)

    def atoms(self) -> list[Formula]:
        return [self]

    def render(self, digits: int | None = None, show: Callable[[float], str] | None = None) -> str:
        raise NotImplementedError

    def __str__(self) -> str:
        return self.render()

    def __and__(self, other: Formula) -> Formula:
        return conjunction([self, other])

    def __or__(self, other: Formula) -> Formula:
        return Or((self, other))

    def __invert__(self) -> Formula:
        return self.dual


def _value(feature: str, single: bool) -> Column:
    return F.col(f"`{feature}`").cast("float" if single else "double")


def _literal(x: float, single: bool) -> Column:
    return F.lit(float(x)).cast("float") if single else F.lit(float(x))


@dataclass(frozen=True)
class ScalarCondition(Formula):
    """feature op threshold."""

    feature: str
    op: str
    threshold: float

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown test operator {self.op!r}")

    @property
    def meta(self) -> MetaCondition:
        return MetaCondition(self.feature, self.op)

    @property
    def dual(self) -> ScalarCondition:
        return ScalarCondition(self.feature, DUALS[self.op], self.threshold)

    def column(self, single: bool = False) -> Column:
        x = _value(self.feature, single)
        return ~F.isnan(x) & OPERATORS[self.op](x, _literal(self.threshold, single))

    def render(self, digits=None, show=None) -> str:
        return f"{self.feature} {SIGNS[self.op]} {show(self.threshold) if show else number(self.threshold, digits)}"


@dataclass(frozen=True)
class RangeCondition(Formula):
    """Both bounds of one feature; an infinite bound does not bind. It has no dual atom."""

    feature: str
    low: float = float("-inf")
    high: float = float("inf")
    low_closed: bool = True
    high_closed: bool = True

    @property
    def empty(self) -> bool:
        return self.low > self.high or (self.low == self.high and not (self.low_closed and self.high_closed))

    def column(self, single: bool = False) -> Column:
        x = _value(self.feature, single)
        out = ~F.isnan(x)
        if self.low != float("-inf"):
            out &= (operator.ge if self.low_closed else operator.gt)(x, _literal(self.low, single))
        if self.high != float("inf"):
            out &= (operator.le if self.high_closed else operator.lt)(x, _literal(self.high, single))
        return out

    def render(self, digits=None, show=None) -> str:
        show = show or (lambda x: number(x, digits))
        return f"{self.feature} ∈ {'[' if self.low_closed else '('}{show(self.low)},{show(self.high)}{']' if self.high_closed else ')'}"


@dataclass(frozen=True)
class ObliqueCondition(Formula):
    """dot(features - center, direction) op 0."""

    features: tuple[str, ...]
    center: tuple[float, ...]
    direction: tuple[float, ...]
    op: str = ">="

    def __post_init__(self):
        if not len(self.features) == len(self.center) == len(self.direction) or self.op not in OPERATORS:
            raise ValueError("an oblique condition needs one center and direction for each feature, and a known operator")

    @property
    def dual(self) -> ObliqueCondition:
        return ObliqueCondition(self.features, self.center, self.direction, DUALS[self.op])

    def column(self, single: bool = False) -> Column:
        terms = [(_value(f, single) - _literal(b, single)) * _literal(u, single) for f, b, u in zip(self.features, self.center, self.direction, strict=True)]
        total = functools.reduce(operator.add, terms)
        return ~F.isnan(total) & OPERATORS[self.op](total, F.lit(0.0))

    def render(self, digits=None, show=None) -> str:
        show = show or (lambda x: number(x, digits))
        return " + ".join(f"({f} - {show(b)})*{show(u)}" for f, b, u in zip(self.features, self.center, self.direction, strict=True)) + f" {SIGNS[self.op]} 0"


@dataclass(frozen=True)
class Truth(Formula):
    """Always true, or always false."""

    value: bool = True

    @property
    def dual(self) -> Truth:
        return Truth(not self.value)

    def column(self, single: bool = False) -> Column:
        return F.lit(self.value)

    def atoms(self):
        return []

    def render(self, digits=None, show=None) -> str:
        return "⊤" if self.value else "⊥"


@dataclass(frozen=True)
class Named(Formula):
    """A boolean column as an atom."""

    name: str

    def column(self, single: bool = False) -> Column:
        return F.coalesce(F.col(f"`{self.name}`").cast("boolean"), F.lit(False))

    def render(self, digits=None, show=None) -> str:
        return self.name


@dataclass(frozen=True)
class Not(Formula):
    part: Formula

    @property
    def dual(self) -> Formula:
        return self.part

    def column(self, single: bool = False) -> Column:
        return ~F.coalesce(self.part.column(single), F.lit(False))

    def atoms(self):
        return self.part.atoms()

    def render(self, digits=None, show=None) -> str:
        return f"¬({self.part.render(digits, show)})"


@dataclass(frozen=True)
class And(Formula):
    parts: tuple[Formula, ...]

    def column(self, single: bool = False) -> Column:
        return functools.reduce(operator.and_, (p.column(single) for p in self.parts), F.lit(True))

    def atoms(self):
        return [a for p in self.parts for a in p.atoms()]

    def render(self, digits=None, show=None) -> str:
        return " ∧ ".join(f"({p.render(digits, show)})" for p in self.parts) or "⊤"


@dataclass(frozen=True)
class Or(Formula):
    parts: tuple[Formula, ...]

    def column(self, single: bool = False) -> Column:
        return functools.reduce(operator.or_, (F.coalesce(p.column(single), F.lit(False)) for p in self.parts), F.lit(False))

    def atoms(self):
        return [a for p in self.parts for a in p.atoms()]

    def render(self, digits=None, show=None) -> str:
        return " ∨ ".join(f"({p.render(digits, show)})" for p in self.parts) or "⊥"


def conjunction(parts: Iterable[Formula]) -> Formula:
    """The parts as one flat conjunction, nested ones opened and tautologies left out."""
    flat: list[Formula] = []
    for p in parts:
        if isinstance(p, And):
            flat += p.parts
        elif p != Truth(True):
            flat.append(p)
    if Truth(False) in flat:
        return Truth(False)
    return flat[0] if len(flat) == 1 else And(tuple(flat)) if flat else Truth(True)


def parse_condition(text: str) -> ScalarCondition:
    """``feature op threshold``: a word, an operator that is known, a number; nothing is evaluated."""
    feature, _, rest = text.strip().partition(" ")
    rest = rest.lstrip()
    sign = next((x for x in sorted(_SPELLED, key=len, reverse=True) if rest.startswith(x)), None)
    if not feature or sign is None:
        raise ValueError(f"no condition: {text!r}")
    try:
        return ScalarCondition(feature, _SPELLED[sign], float(rest[len(sign) :]))
    except ValueError as e:
        raise ValueError(f"no threshold: {rest[len(sign):].strip()!r}") from e


_LEX = re.compile(r"\s*(?:([()∧∨¬→⊤⊥&|!~])|(→|->)|([^\s()∧∨¬→⊤⊥&|!~]+))")
_SAME = {"&": "∧", "|": "∨", "!": "¬", "~": "¬", "->": "→"}


def parse_formula(text: str, atom: Callable[[str], Formula] | None = None) -> Formula:
    """A propositional formula: ¬ binds closest, then ∧, ∨ and →; words in a row are one atom."""
    atom = atom or (lambda s: parse_condition(s) if any(x in s for x in ("<", ">", "=", "≤", "≥", "≠")) else Named(s))
    tokens: list[str] = []
    words: list[str] = []
    at = 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        at = m.end()
        sign = m[1] or m[2]
        if sign:
            if words:
                tokens.append(" ".join(words))
                words = []
            tokens.append(_SAME.get(sign, sign))
        else:
            words.append(m[3])
    if words:
        tokens.append(" ".join(words))
    place = 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take() -> str:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def unary() -> Formula:
        if peek() is None:
            raise ValueError("a formula ends too early")
        t = take()
        if t == "¬":
            return unary().dual
        if t == "(":
            inner = implication()
            if peek() != ")":
                raise ValueError("a bracket is not closed")
            take()
            return inner
        if t in ("⊤", "⊥"):
            return Truth(t == "⊤")
        if t in (")", "∧", "∨", "→"):
            raise ValueError(f"unexpected {t!r}")
        return atom(t)

    def chain(sign: str, part: Callable[[], Formula], join: Callable) -> Formula:
        parts = [part()]
        while peek() == sign:
            take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else join(parts)

    def implication() -> Formula:
        left = chain("∨", lambda: chain("∧", unary, conjunction), lambda p: Or(tuple(p)))
        if peek() == "→":
            take()
            return Or((left.dual, implication()))
        return left

    out = implication()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r}")
    return out


def normalize(f: Formula, flip_atoms: bool = True, rotate: bool = False) -> Formula:
    """Negation normal form; negated atoms become their duals, commutative parts are sorted if asked."""
    if isinstance(f, Not):
        p = f.part
        if isinstance(p, Not):
            return normalize(p.part, flip_atoms, rotate)
        if isinstance(p, And):
            return normalize(Or(tuple(Not(x) for x in p.parts)), flip_atoms, rotate)
        if isinstance(p, Or):
            return normalize(conjunction(Not(x) for x in p.parts), flip_atoms, rotate)
        if isinstance(p, Truth):
            return p.dual
        return p.dual if flip_atoms and isinstance(p, (ScalarCondition, ObliqueCondition)) else f
    if isinstance(f, (And, Or)):
        parts = [normalize(p, flip_atoms, rotate) for p in f.parts]
        if rotate:
            parts.sort(key=str)
        return conjunction(parts) if isinstance(f, And) else Or(tuple(parts))
    return f


def simplify(f: Formula, ranges: bool = True) -> Formula:
    """Collapses the bounds of each feature in a conjunction; a contradiction becomes ⊥.

    With ``ranges`` two bounds become one range condition, else at most one atom for each side.
    Features keep the order of their first atom.
    """
    if isinstance(f, Or):
        parts = [simplify(p, ranges) for p in f.parts]
        parts = [p for p in parts if p != Truth(False)]
        return Truth(True) if Truth(True) in parts else Or(tuple(dict.fromkeys(parts))) if len(parts) != 1 else parts[0]
    if not isinstance(f, And):
        return f
    bounds: dict[str, RangeCondition] = {}
    rest: list[Formula] = []
    order: list[str] = []
    for p in f.parts:
        if isinstance(p, ScalarCondition) and p.op in ("<", "<=", ">", ">="):
            closed = p.op.endswith("=")
            p = RangeCondition(p.feature, high=p.threshold, high_closed=closed) if p.op[0] == "<" else RangeCondition(p.feature, low=p.threshold, low_closed=closed)
        if not isinstance(p, RangeCondition):
            if p not in rest:
                rest.append(p)
            continue
        old = bounds.get(p.feature)
        if old is None:
            bounds[p.feature] = p
            order.append(p.feature)
            continue
        low, low_closed = max((old.low, not old.low_closed), (p.low, not p.low_closed))
        high, high_closed = min((old.high, old.high_closed), (p.high, p.high_closed))
        bounds[p.feature] = RangeCondition(p.feature, low, high, not low_closed, high_closed)
    if any(b.empty for b in bounds.values()):
        return Truth(False)
    out: list[Formula] = []
    for name in order:
        b = bounds[name]
        sides = []
        if b.low != float("-inf"):
            sides.append(ScalarCondition(name, ">=" if b.low_closed else ">", b.low))
        if b.high != float("inf"):
            sides.append(ScalarCondition(name, "<=" if b.high_closed else "<", b.high))
        out += [b] if ranges and len(sides) == 2 else sides
    return conjunction(out + rest)


def group_by_feature(conditions: Iterable[MetaCondition], features: list[str], missing: str = "error") -> list[tuple[str, list[MetaCondition]]]:
    """Metaconditions grouped in the order of ``features``; others raise, or are left out ("ignore")."""
    groups: dict[str, list[MetaCondition]] = {f: [] for f in features}
    for c in conditions:
        if c.feature in groups:
            groups[c.feature].append(c)
        elif missing == "error":
            raise KeyError(f"{c.feature} is not among the features")
    return list(groups.items())


@dataclass(frozen=True)
class Alphabet:
    """Thresholds for each of several metaconditions."""

    grades: tuple[tuple[MetaCondition, tuple[float, ...]], ...] = field(default=())

    def atoms(self) -> list[ScalarCondition]:
        return [ScalarCondition(m.feature, m.op, t) for m, ts in self.grades for t in ts]

    def __len__(self) -> int:
        return sum(len(ts) for _, ts in self.grades)

    def __contains__(self, c: ScalarCondition) -> bool:
        return any(m == c.meta and c.threshold in ts for m, ts in self.grades)

    def random_atom(self, seed: int) -> ScalarCondition:
        return random.Random(seed).choice(self.atoms())

    def table(self, spark: SparkSession) -> DataFrame:
        """feature, op, threshold of every atom."""
        return spark.createDataFrame([(a.feature, a.op, a.threshold) for a in self.atoms()], "feature string, op string, threshold double")


def check(df: DataFrame, formula: Formula, name: str = "holds") -> DataFrame:
    """``df`` with a column that tells where the formula holds; never null."""
    return df.withColumn(name, F.coalesce(formula.column(), F.lit(False)))


def select_rows(df: DataFrame, formula: Formula) -> DataFrame:
    return df.where(formula.column())


def drop_nan_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NaN in any of ``columns``."""
    return df.where(~functools.reduce(operator.or_, (F.isnan(F.col(c).cast("double")) for c in columns), F.lit(False)))


def nan_share(df: DataFrame, columns: list[str]) -> float:
    """Share of the rows with a NaN, to warn about before they are dropped."""
    bad = functools.reduce(operator.or_, (F.isnan(F.col(c).cast("double")) for c in columns), F.lit(False))
    return df.agg(F.avg(bad.cast("double"))).first()[0] or 0.0


def equals_any(column: str, values: Iterable, labels: Mapping | None = None) -> Column:
    """Row filter by equality with one of several values."""
    return F.col(column).isin(*values)


def trim_series(df: DataFrame, label: str, series: str, order: str, min_length: int, min_samples: int | None = None) -> DataFrame:
    """Rows whose series is long enough, cut to ``min_length``; per class at most ``min_samples`` rows."""
    from pyspark.sql import Window

    out = df.where(F.size(series) >= min_length).withColumn(series, F.slice(series, 1, min_length))
    if min_samples is not None:
        rank = F.row_number().over(Window.partitionBy(label).orderBy(order))
        out = out.withColumn("_rank", rank).where(F.col("_rank") <= min_samples).drop("_rank")
    return out
