"""Backward class restrictions against an enumeration of all sets of partial tuples."""

import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.functions.vocab import TYPE
from graphloom.operators import relations as L
from graphloom.sources.mapping import graph_of

PROPERTIES = ("<urn:p:a>", "<urn:p:b>", "<urn:p:c>")
SUM = L.Restriction("<urn:Sum>", PROPERTIES, L.INTEGER_RELATIONS["sum"])


def term(x):
    return f'"{x}"^^<http://www.w3.org/2001/XMLSchema#integer>'


def completed(t):
    """Full tuples of a = b + c that follow from a partial one, None if it contradicts the relation."""
    a, b, c = t
    if None not in t:
        return [t] if a == b + c else None
    if sum(x is None for x in t) > 1:
        return []
    return [(b + c, b, c) if a is None else (a, a - c, c) if b is None else (a, b, a - b)]


def expected(values):
    """Alternatives (sets of partial tuples) of one instance, each as its sorted members."""
    combos = itertools.product(*([None, *v] for v in values))
    full = sorted({t for x in combos for t in completed(x) or []})
    partial = {}
    for t in full:
        kept = [m for m in itertools.product((0, 1), repeat=3) if completed(tuple(x if k else None for x, k in zip(t, m))) == [t]]
        partial[t] = [m for m in kept if not any(o != m and all(x <= y for x, y in zip(o, m)) for o in kept)]
    pairs = [(t, m) for t in full for m in partial[t]]
    wanted = {(i, v) for i, vs in enumerate(values) for v in vs}
    covers = lambda chosen: wanted <= {(i, v) for t, _ in chosen for i, v in enumerate(t)}
    out = []
    for n in range(1, len(wanted) + 1):
        for chosen in itertools.combinations(pairs, n):
            if covers(chosen) and not any(covers([y for y in chosen if y != x]) for x in chosen):
                held = {(i, v) for t, m in chosen for i, v in enumerate(t) if m[i]}
                if not wanted <= held:
                    out.append(tuple(sorted(held)))
    return sorted(out)


CASES = {
    "two": ([5], [2], []),
    "one": ([5], [], []),
    "none": ([], [], []),
    "all": ([5], [2], [3]),
    "firsts": ([5], [2, 4], []),
    "totals": ([5, 9], [2], []),
    "triangle": ([5], [2], [4]),
    "open": ([1, 2], [1], [0]),
    "zero": ([0], [0], []),
}


def claim(spark, cases):
    rows = [(f"<urn:{k}>", TYPE, "<urn:Sum>") for k in cases]
    return graph_of(spark, rows + [(f"<urn:{k}>", p, term(v)) for k, vs in cases.items() for p, v in zip(PROPERTIES, vs) for v in v])


def test_alternatives_equal_an_enumeration(spark):
    cases = {k: v for k, v in CASES.items() if k != "one"}
    found = L.backward_restriction(claim(spark, cases), SUM)
    got = {}
    for r in found.groupBy("s", "alternative").agg(F.collect_set(F.struct("p", "o")).alias("x")).collect():
        arcs = {tuple(x) for x in r.x}
        assert (TYPE, "<urn:Sum>") in arcs
        got.setdefault(r.s[5:-1], []).append(tuple(sorted((PROPERTIES.index(p), int(o.split('"')[1])) for p, o in arcs if p != TYPE)))
    want = {k: expected(v) for k, v in cases.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert {k: len(v) for k, v in want.items()}["triangle"] > 6 and not want["none"]


def test_values_that_nothing_derives_have_no_alternative(spark):
    assert L.backward_restriction(claim(spark, {"one": ([5], [], [])}), SUM).isEmpty()
    less = L.Restriction("<urn:Sum>", PROPERTIES[:2], L.INTEGER_RELATIONS["lt"])
    assert L.backward_restriction(claim(spark, {"less": ([1], [2], [])}), less).isEmpty()
    assert L.backward_restriction(claim(spark, {}), SUM).isEmpty()


def test_a_contradiction_leaves_what_is_false(spark):
    """One tuple at most, but the values need three."""
    one = L.Restriction("<urn:Sum>", PROPERTIES, L.INTEGER_RELATIONS["sum"], 1)
    g = claim(spark, {k: CASES[k] for k in ("two", "triangle")})
    assert [tuple(r) for r in L.backward_restriction(g, one).collect()] == [("_:a", "", L.FALSE, "_:b")]
    assert L.backward_restriction(claim(spark, {"two": CASES["two"]}), one).count() == 6


def test_signs_are_not_derived_from_a_magnitude(spark):
    """|b| = a: a follows from b, b from nothing but itself; 0 follows both ways."""
    size = L.Restriction("<urn:Sum>", PROPERTIES[:2], L.INTEGER_RELATIONS["abs"])
    rows = L.backward_restriction(claim(spark, {"x": ([], [-3], []), "y": ([3], [-3], []), "z": ([0], [], [])}), size).where(F.col("p") != TYPE)
    assert sorted((r.s, r.p, r.o) for r in rows.collect()) == [("<urn:y>", PROPERTIES[1], term(-3)), ("<urn:z>", PROPERTIES[1], term(0))]


@pytest.mark.parametrize("n", [40])
def test_options_stay_factors(spark, n):
    """An instance with n totals has 3 to the power of n products, but n rows of options."""
    g = claim(spark, {"big": (list(range(100, 100 + n)), [7], [])})
    options, values, wrong = L.backward_options(g, SUM)
    assert options.count() == n and values.count() == n + 1 and wrong.isEmpty()
    assert {len(r.masks) for r in options.collect()} == {3}
