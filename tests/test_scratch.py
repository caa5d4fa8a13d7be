"""Tables and shuffle files that operators write along the way, and what is left of them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import canon, scratch, trees
from graphloom.operators import chaining as C
from graphloom.operators import rules as R
from graphloom.operators.claims import components_entailed
from graphloom.operators.query import pattern
from graphloom.sources.mapping import graph_of

TREE = [("<s>", "<p>", f"_:a{i}") for i in range(9)] + [(f"_:a{i}", "<q>", f"_:b{i}") for i in range(9)] + [(f"_:b{i}", "<q>", f'"{i}"') for i in range(9)]
OTHER = [(s.replace("_:", "_:x"), p, '"8"' if o == '"7"' else o.replace("_:", "_:x")) for s, p, o in TREE]


def written(spark) -> set[str]:
    folder = Path(scratch.shared_folder(spark))
    return {f.name for f in folder.iterdir()} if folder.exists() else set()


def reads(frame) -> set[str]:
    return {f.split("/")[-2] for f in frame.inputFiles()}


def shuffles(spark) -> int:
    return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()


def test_settled_tables_leave_no_shuffle_files(spark):
    spark.sparkContext._jvm.System.gc()
    before = shuffles(spark)
    scratch.settle(spark.range(100).groupBy(F.col("id") % 7).count())
    assert shuffles(spark) <= before


def test_tidy_keeps_what_is_read(spark):
    @scratch.tidy
    def inner():
        first = scratch.settle(spark.range(3))
        return scratch.settle(first.union(first)), {"also": [scratch.settle(spark.range(1))]}

    @scratch.tidy
    def outer():
        pair, more = inner()
        return pair.where("id > 0")

    before = written(spark)
    frame = outer()
    assert written(spark) - before == reads(frame) and len(reads(frame)) == 1
    assert frame.count() == 4


@pytest.mark.parametrize(
    "what",
    [
        lambda spark: trees.statements(graph_of(spark, TREE)),
        lambda spark: trees.subject_depths(graph_of(spark, TREE)),
        lambda spark: trees.tree_difference(graph_of(spark, TREE), graph_of(spark, OTHER)),
    ],
    ids=["statements", "subject_depths", "tree_difference"],
)
def test_only_tables_of_the_result_are_left_and_slices_change_nothing(spark, monkeypatch, what):
    before = written(spark)
    whole = what(spark)
    assert written(spark) - before == reads(whole)
    rows = sorted(map(str, whole.collect()))
    assert rows
    monkeypatch.setattr(scratch, "SLICE_BYTES", 1000)
    before = written(spark)
    cut = what(spark)
    assert written(spark) - before == reads(cut)
    assert sorted(map(str, cut.collect())) == rows


def test_folding_moves_no_triples_and_takes_tables_back(spark, monkeypatch):
    """Bindings are folded within an alternative's row, alternatives within their claim, graphs of any size; goals without options drop their claim."""
    rule = R.Rule("paid", pattern("?o <urn:by> ?c . ?c <urn:paid> ?z"), pattern("?o <urn:to> ?c . ?o <urn:to> ?who . ?o <urn:to> ?else"))
    rows = [("k", 0, "<o>", "<urn:to>", "<c>"), ("k", 1, "<o>", "<urn:to>", "<any>"), ("l", 0, "<p>", "<urn:to>", "<c>"), ("m", 0, "<q>", "<urn:to>", "<c>"), ("m", 1, "<q>", "<urn:from>", "<c>")]
    goals = spark.createDataFrame(rows, "claim string, goal int, s string, p string, o string")
    plain = C.backward_apply(rule, goals, fold=False)
    old = canon.duplicates_folded(canon.duplicates_folded(C._antecedents(C.alternatives(goals, C.unifiers(goals, rule.consequent)), rule), ["claim", "alternative"], "at").drop("at").distinct(), ["claim"], "alternative")
    want = sorted(map(tuple, old.collect()))
    monkeypatch.setattr(C, "_antecedents", None)
    before = written(spark)
    got = C.backward_apply(rule, goals)
    assert written(spark) - before == reads(got)
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < plain.count() and {r[0] for r in want} == {"k", "l"}
    # alternatives too large for a row's certificate
    monkeypatch.setattr(canon, "SMALL", 3)
    monkeypatch.setattr(scratch, "SLICE_BYTES", 1000)
    again = C.backward_apply(rule, goals)
    assert sorted(map(tuple, again.collect())) == want


def test_claims_leave_no_tables_but_those_of_the_result(spark):
    graph = graph_of(spark, [("<a>", "<p>", "<b>"), ("<b>", "<q>", "<c>")])
    claims = graph_of(spark, [("_:a", "<p>", "_:b"), ("_:b", "<q>", "<c>"), ("_:d", "<p>", "_:e"), ("_:e", "<q>", "<d>"), ("_:f", "<p>", "_:g"), ("_:g", "<q>", "<c>")])
    before = written(spark)
    found = components_entailed(graph, claims)
    assert written(spark) - before == reads(found)
    assert {r.component: r.entailed for r in found.collect()} == {"_:a": True, "_:d": False, "_:f": True}


def test_closures_send_counted_patterns_only(spark, monkeypatch):
    """What is sent to all tasks is told by counts of matches, not by the size of files."""
    graph = [("<c>", R.SUBCLASS, "<d>"), ("<d>", R.SUBCLASS, "<e>"), *((f"<x{i}>", R.TYPE, "<c>") for i in range(20))]
    rules = [r for r in R.RDFS_RULES if r.name in ("r9", "r11")]
    monkeypatch.setattr(R, "FEW", 3)
    known = R._counted(scratch.settle(graph_of(spark, graph)), rules)
    assert known.few == {("?", R.SUBCLASS, "?")}
    plan = rules[0].forward(known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1 and "Hint=(strategy=broadcast)" in plan.replace("leftHint", "Hint").replace("rightHint", "Hint")
    before = written(spark)
    some = R.closure(graph_of(spark, graph), rules)
    assert written(spark) - before == reads(some)
    monkeypatch.setattr(R, "FEW", -1)
    none = R._counted(scratch.settle(graph_of(spark, graph)), rules)
    assert "Broadcast" not in rules[0].forward(none)._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, some.collect()))
    assert sorted(map(tuple, R.closure(graph_of(spark, graph), rules).collect())) == got and len(got) == 23 + 40
