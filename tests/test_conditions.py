import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulewright.operators import conditions as c
from rulewright.operators.conditions import And, ObliqueCondition, RangeCondition, ScalarCondition, Truth

NAN = float("nan")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 1.0, 2.0), (2, 4.9, NAN), (3, None, 5.0), (4, 7.0, -1.0)], "id int, a double, b double").persist()


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("op,want", [("<", [1]), ("<=", [1, 2]), (">", [4]), (">=", [2, 4]), ("==", [2]), ("!=", [1, 4])])
def test_operators_and_null(rows, op, want):
    assert ids(c.select_rows(rows, ScalarCondition("a", op, 4.9))) == want


def test_nan_satisfies_neither_an_atom_nor_its_dual(rows):
    atom = ScalarCondition("b", ">=", 0.0)
    assert ids(c.select_rows(rows, atom)) == [1, 3]
    assert ids(c.select_rows(rows, atom.dual)) == [4]
    assert [r["holds"] for r in c.check(rows, atom).orderBy("id").collect()] == [True, False, True, False]


def test_ranges_and_oblique(rows):
    assert ids(c.select_rows(rows, RangeCondition("a", 1.0, 7.0, False, True))) == [2, 4]
    assert RangeCondition("a", 2.0, 1.0).empty and RangeCondition("a", 1.0, 1.0, True, False).empty
    o = ObliqueCondition(("a", "b"), (0.0, 0.0), (1.0, 1.0), ">=")
    assert ids(c.select_rows(rows, o)) == [1, 4] and ids(c.select_rows(rows, o.dual)) == []
    with pytest.raises(ValueError):
        ObliqueCondition(("a",), (1.0, 2.0), (1.0,))


@given(st.sampled_from(["a", "x_1", "max[V2]"]), st.sampled_from(list(c.OPERATORS)), st.floats(-1e6, 1e6, allow_nan=False))
def test_parse_render_round_trip(feature, op, threshold):
    atom = ScalarCondition(feature, op, threshold)
    assert c.parse_condition(str(atom)) == atom


@pytest.mark.parametrize("text", ["a", "a ? 1", "a < x", "", "a < 1 b"])
def test_bad_conditions(text):
    with pytest.raises(ValueError):
        c.parse_condition(text)


def test_formula_parser():
    f = c.parse_formula("p∧q∨r")
    assert str(f) == "((p) ∧ (q)) ∨ (r)"
    assert str(c.parse_formula("¬(p ∧ q) → a < 3")) == "((p) ∧ (q)) ∨ (a < 3.0)"
    for bad in ("p ∧", "(p", "p)", "∧ p", "p q ∧ )"):
        with pytest.raises(ValueError):
            c.parse_formula(bad)


def test_normal_form():
    f = c.Not(And((ScalarCondition("a", "<", 1.0), c.Named("p"))))
    n = c.normalize(f)
    assert str(n) == "(a ≥ 1.0) ∨ (¬(p))"
    assert c.normalize(c.Not(c.Not(c.Named("p")))) == c.Named("p")
    assert str(c.normalize(c.conjunction([c.Named("z"), c.Named("b")]), rotate=True)) == "(b) ∧ (z)"


@settings(max_examples=60)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["<", "<=", ">", ">="]), st.integers(0, 5)), min_size=1, max_size=6), st.booleans())
def test_simplify_keeps_meaning(atoms, ranges):
    f = c.conjunction(ScalarCondition(n, op, float(t)) for n, op, t in atoms)
    g = c.simplify(f, ranges)

    def holds(x, row):
        if isinstance(x, Truth):
            return x.value
        if isinstance(x, And):
            return all(holds(p, row) for p in x.parts)
        if isinstance(x, RangeCondition):
            v = row[x.feature]
            return (x.low <= v if x.low_closed else x.low < v) and (v <= x.high if x.high_closed else v < x.high)
        return c.OPERATORS[x.op](row[x.feature], x.threshold)

    values = [i / 2 for i in range(-1, 12)]
    assert all(holds(f, {"a": a, "b": b}) == holds(g, {"a": a, "b": b}) for a in values for b in values)
    assert len(g.atoms()) <= len(atoms)


def test_groups_and_alphabet(spark):
    m = c.MetaCondition("a", "<")
    assert c.group_by_feature([m, m.dual], ["b", "a"]) == [("b", []), ("a", [m, m.dual])]
    with pytest.raises(KeyError):
        c.group_by_feature([m], ["b"])
    a = c.Alphabet(((m, (1.0, 2.0)), (c.MetaCondition("b", ">="), (3.0,))))
    assert len(a) == 3 and ScalarCondition("a", "<", 2.0) in a and ScalarCondition("a", ">", 2.0) not in a
    assert a.random_atom(3) in a.atoms() and a.table(spark).count() == 3


def test_nan_rows_and_trim(spark, rows):
    assert ids(c.drop_nan_rows(rows, ["a", "b"])) == [1, 3, 4]
    assert math.isclose(c.nan_share(rows, ["b"]), 0.25)
    s = spark.createDataFrame([(1, "x", [1.0] * 5), (2, "x", [1.0] * 3), (3, "x", [2.0] * 4), (4, "y", [3.0] * 4)], "id int, label string, s array<double>")
    out = c.trim_series(s, "label", "s", "id", 4, 1)
    assert ids(out) == [1, 4] and all(len(r["s"]) == 4 for r in out.collect())


def test_modal_conditions(spark):
    from rulewright.operators.modal import ModalCondition

    df = spark.createDataFrame([(1, [0.0, 5.0, 0.0]), (2, [1.0, 1.0]), (3, [NAN, 9.0]), (4, []), (5, None)], "id int, s array<double>")
    some = ModalCondition("s", "maximum", ">=", 4.0, 1, 1)
    assert ids(c.select_rows(df, some)) == [1, 3]
    assert ids(c.select_rows(df, some.dual)) == [2, 4]  # NaN passes neither test
    assert str(some) == "⟨G⟩(maximum[s] ≥ 4.0)" and some.dual.dual == some
    assert ids(c.select_rows(df, ModalCondition("s", "mean", "<", 1.0, 2, 2, relation="B"))) == []
    with pytest.raises(ValueError):
        ModalCondition("s", "mean", "<", 1.0, 3, 2)
