"""Nested statements, differences, certificates, claims, backward steps and orders against results by hand or brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import canon
from graphloom.operators import chaining as C
from graphloom.operators import entail as E
from graphloom.operators import orders as O
from graphloom.operators import relations as L
from graphloom.operators import rules as R
from graphloom.operators import trees
from graphloom.operators import canon, claims
from graphloom.operators.canon import certificates, duplicates_folded
from graphloom.operators.claims import components_entailed
from graphloom.operators.numbers import numbered, ranked
from graphloom.operators.query import pattern
from graphloom.sources.mapping import graph_of
from graphloom.sources.text import largest_blank_number, renumbered

TREE = [("<s>", "<p>", "_:a"), ("_:a", "<q>", "_:b"), ("_:a", "<r>", "<x>"), ("_:b", "<q>", '"1"'), ("<s>", "<z>", "<y>"), ("_:c", "<p>", "_:d"), ("_:d", "<p>", "_:c"), ("_:e", "<p>", "<y>"), ("<y>", "<p>", "_:u")]


def test_statements(spark):
    got = {r.subject: r.text for r in trees.statements(graph_of(spark, TREE + TREE[:2])).collect()}
    assert got == {"<s>": '(<s> <p> (_:a <q> (_:b <q> "1") ; <r> <x>) ; <z> <y>)', "_:c": "(_:c <p> (_:d <p> _:c))", "_:e": "(_:e <p> <y>)", "<y>": "(<y> <p> _:u)"}
    lines = {r.subject: r.text for r in trees.statements(graph_of(spark, TREE), "\n").collect()}
    assert lines["<s>"] == '\n(<s> <p> \n  (_:a <q> \n    (_:b <q> "1")\n    ; <r> <x>)\n  ; <z> <y>)'
    assert trees.statements(graph_of(spark, TREE).where("false")).collect() == []


def test_deep_nesting(spark):
    n = 60
    chain = [("<s>", "<p>", "_:n0"), *((f"_:n{i}", "<p>", f"_:n{i + 1}") for i in range(n)), (f"_:n{n}", "<p>", "<end>")]
    g = graph_of(spark, chain)
    text = "(<s> <p> " + "".join(f"(_:n{i} <p> " for i in range(n + 1)) + "<end>" + ")" * (n + 2)
    assert [r.text for r in trees.statements(g).collect()] == [text]
    assert {r.term: (r.root, r.depth) for r in trees.depths(trees.forest(g)).collect()} == {"<s>": ("<s>", 0)} | {f"_:n{i}": ("<s>", i + 1) for i in range(n + 1)}


def difference(spark, a, b):
    return {tuple(r) for r in trees.tree_difference(graph_of(spark, a), graph_of(spark, b)).collect()}


def test_statements_by_level_are_those_of_the_walk(spark, monkeypatch):
    """Few levels need no walk; nested statements, shared and circling ones and repeated properties come out alike."""
    arcs = TREE + [("_:c1", "<p>", "_:c2"), ("_:c2", "<p>", "_:c1"), ("<h>", "<p>", "_:k1"), ("<h>", "<p>", "_:k2"), ("_:k2", "<a>", '"x"'), ("_:k2", "<p>", "_:k3"), ("_:k3", "<p>", '"y"'), ("_:k1", "<p>", "_:gone"), ("<h>", "<o>", "_:k0")]
    g = graph_of(spark, arcs)
    walked = {line: sorted(tuple(r) for r in trees._walked(g, line).collect()) for line in (None, "\n")}
    monkeypatch.setattr(trees, "toured", None)
    for line, want in walked.items():
        assert sorted(tuple(r) for r in trees.statements(g, line).collect()) == want
    depths = sorted(tuple(r) for r in trees.depths(trees.forest(g)).collect())
    assert sorted(tuple(r) for r in trees.subject_depths(g.union(g)).collect()) == depths and max(r[2] for r in depths) > 1


def test_tree_difference(spark):
    other = [("<s>", "<p>", "_:A"), ("_:A", "<q>", "_:B"), ("_:A", "<r>", "<x>"), ("_:B", "<q>", '"2"'), ("<s>", "<z>", "<y>"), ("_:C", "<p>", "_:D"), ("_:D", "<p>", "_:C"), ("_:E", "<p>", "<w>"), ("<n>", "<p>", "_:u")]
    assert difference(spark, TREE, other) == {("<n>", "", None, "<n>"), ("<y>", "", "<y>", None), ("_:e", "<p>", "<y>", "<w>"), ("<s>", "<p> <q> <q>", '"1"', '"2"')}
    renamed = [tuple(t.replace("_:", "_:zz") for t in x) for x in TREE]
    assert difference(spark, TREE, renamed) == set()


def test_differences_of_repeated_and_unlike_objects(spark):
    """Equal nested statements are set off by number; a nested one meets a plain object, and what is left over stands alone."""
    a = [("<s>", "<p>", f"_:a{i}") for i in range(3)] + [(f"_:a{i}", "<k>", '"same"') for i in range(3)] + [("<s>", "<q>", "_:q"), ("_:q", "<k>", "<x>"), ("<s>", "<r>", "<1>")]
    b = [("<s>", "<p>", "_:b0"), ("_:b0", "<k>", '"same"'), ("<s>", "<q>", "<plain>"), ("<s>", "<r>", "<1>"), ("<s>", "<r>", "<2>")]
    got = difference(spark, a, b)
    assert {(r, p, x if not x or x[0] != "_" else "blank", y) for r, p, x, y in got} == {("<s>", "<p>", "blank", None), ("<s>", "<q>", "blank", "<plain>"), ("<s>", "<r>", None, "<2>")}
    assert len(got) == 4


def isomorphic(a, b):
    names = [sorted({t for x in g for t in x if t.startswith("_:")}) for g in (a, b)]
    if len(a) != len(b) or len(names[0]) != len(names[1]):
        return False
    return any({tuple(dict(zip(names[0], q)).get(t, t) for t in x) for x in a} == b for q in itertools.permutations(names[1]))


def test_certificates(spark):
    rng = random.Random(4)
    arcs = lambda e, both=False: {(f"_:{x}", "<p>", f"_:{y}") for x, y in e} | ({(f"_:{y}", "<p>", f"_:{x}") for x, y in e} if both else set())
    prism, k33 = ("ab", "bc", "ca", "de", "ef", "fd", "ad", "be", "cf"), [x + y for x in "abc" for y in "def"]
    gs = [arcs(("ab", "bc", "cd", "de", "ef", "fa")), arcs(("ab", "bc", "ca", "de", "ef", "fd")), arcs(prism), arcs(prism, True), arcs(k33, True), arcs(k33), arcs(("ab", "bc")), arcs(("ab", "ac"))]
    gs += [{("<s>", "<p>", f"_:x{i}") for i in range(n)} for n in (5, 6)] + [{("<s>", "<p>", "<o>")}, {("<s>", "<p>", "<o>"), ("<s>", "<p>", "<q>")}]
    for _ in range(25):
        n = rng.randint(2, 5)
        node = lambda n=n: f"_:{rng.choice('abcde'[:n])}"
        gs.append({(node(), rng.choice(["<p>", "<q>", "_:a"]), rng.choice([node(), "<k>"])) for _ in range(rng.randint(1, 6))})
        names = dict(zip("abcde", rng.sample("vwxyz", 5)))
        gs.append({tuple("_:" + names[t[2]] if t.startswith("_:") else t for t in x) for x in gs[-1]})
    rows = [(str(i), *x) for i, g in enumerate(gs) for x in g]
    found = {int(r.g): r.certificate for r in certificates(spark.createDataFrame(rows, "g string, s string, p string, o string")).collect()}
    for i, j in itertools.combinations(range(len(gs)), 2):
        assert (found[i] == found[j]) == isomorphic(gs[i], gs[j]), (gs[i], gs[j])


def test_small_certificates_take_no_rounds_and_agree_with_those_of_large_graphs(spark, monkeypatch):
    rng = random.Random(5)
    quads = []
    for g in range(60):
        nodes = [f"_:n{i}" for i in range(rng.choice((2, 3, 4)))] + ["<x>"]
        arcs = {(rng.choice(nodes), rng.choice(("<p>", "_:n0")), rng.choice(nodes)) for _ in range(rng.choice((1, 2, 3, 5)))}
        names = dict(zip(nodes[:-1], rng.sample([f"_:m{i}" for i in range(9)], len(nodes) - 1)))
        quads += [(f"a{g}", *x) for x in arcs] + [(f"b{g}", *(names.get(t, t) for t in x)) for x in arcs]
    # two rings of three are no ring of six
    quads += [(f"r{k}", f"_:{i}", "<p>", f"_:{i - i % k + (i + 1) % k}") for k in (3, 6) for i in range(6)]
    df = spark.createDataFrame(quads, "g string, s string, p string, o string")

    def groups():
        found = {}
        for r in certificates(df).collect():
            found.setdefault(r.certificate, []).append(r.g)
        return sorted(sorted(x) for x in found.values())

    monkeypatch.setattr(canon, "SMALL", 0)
    large = groups()
    monkeypatch.setattr(canon, "SMALL", 64)
    monkeypatch.setattr(canon, "_units", None)
    small = groups()
    assert small == large and ["r3"] in small and all(any(f"a{g}" in x and f"b{g}" in x for x in small) for g in range(60))


def test_components_of_claims(spark):
    rng = random.Random(7)
    terms, properties = ["<a>", "<b>", "<c>", "_:g"], ["<p>", "<q>", "<r>"]
    graph = {(rng.choice(terms), rng.choice(properties), rng.choice([*terms, '"1"'])) for _ in range(14)}
    claims = []
    for i in range(60):
        names = [f"_:c{i:02}{j}" for j in range(rng.randint(1, 4))]
        arcs = set()
        for j in range(1, len(names)):
            ends = [names[j], names[rng.randrange(j)]]
            rng.shuffle(ends)
            arcs.add((ends[0], rng.choice(properties), ends[1]))
        for _ in range(rng.randint(0 if arcs else 1, 2)):
            arcs.add((rng.choice(names), rng.choice(properties), rng.choice(terms[:3])) if rng.random() < 0.6 else (rng.choice(terms[:3]), rng.choice(properties), rng.choice(names)))
        if i < 4:  # circles, loops, properties
            arcs.add((names[-1], properties[i % 3], names[0]) if i < 3 else (names[0], names[-1], "<a>"))
        claims.append(arcs)

    def holds(arcs):
        names = sorted({t for x in arcs for t in x if t.startswith("_:c")})
        return any({tuple(dict(zip(names, v)).get(t, t) for t in x) for x in arcs} <= graph for v in itertools.product({t for x in graph for t in x}, repeat=len(names)))

    got = {r.component: r.entailed for r in components_entailed(graph_of(spark, sorted(graph)), graph_of(spark, [x for a in claims for x in a])).collect()}
    want = {min(t for x in a for t in x if t.startswith("_:c")): holds(a) for a in claims}
    assert got == want and 5 < sum(want.values()) < 55
    assert E.simple_entails(graph_of(spark, sorted(graph)), graph_of(spark, [x for a in claims if holds(a) for x in a]))


KIND = "claim string, goal int, s string, p string, o string"
HEADS = pattern("?o <s> ?c . ?o <s> ?w . ?o <s> ?e")


def test_backward_alternatives_fold(spark):
    rule = R.Rule("r", pattern("?o <by> ?c . ?c <paid> ?z"), HEADS)
    goals = spark.createDataFrame([("1", 0, "<o1>", "<s>", "<c>"), ("2", 0, "<o2>", "<s>", "<c>"), ("2", 1, "<o2>", "<s>", "<any>")], KIND)
    count = lambda df: {r.claim: (r.a, r.n) for r in df.groupBy("claim").agg(F.countDistinct("alternative").alias("a"), F.count("*").alias("n")).collect()}
    assert count(C.backward_apply(rule, goals)) == {"1": (2, 4), "2": (4, 14)}
    assert count(C.backward_apply(rule, goals, fold=False)) == {"1": (3, 6), "2": (9, 36)}
    needed = graph_of(spark, [("<o>", "<by>", "<c>"), ("<c>", "<paid>", "_:x")])
    assert C.check_backward(rule, [needed], graph_of(spark, [("<o>", "<s>", "<c>")]))
    assert not C.check_backward(rule, [needed], graph_of(spark, [("<o>", "<s>", "<d>")]))


def test_backward_options_are_pruned_before_they_multiply(spark):
    heads = [*HEADS, ("?q", "<s>", "?c")]
    goals = spark.createDataFrame([("k", i, f"<o{i}>", "<s>", "<c>") for i in range(10)], KIND)
    options = C.unifiers(goals, heads)
    assert [int(r.n) for r in C.alternative_counts(options).collect()] == [4**10]
    kept = C.solvable(C.modified(options, heads, lambda b: b if "q" in b.columns else b.where("o = '<o3>' and false")), goals)
    assert kept.count() == 10 and C.alternatives(goals, kept).count() == 1
    assert C.solvable(C.modified(options, heads, lambda b: b.where("o <> '<o3>'") if "o" in b.columns else b.where("false")), goals).isEmpty()


def test_products(spark):
    rows = [(7, 2, None), (6, 2, None), (6, None, 3), (7, 2, 3), (6, 2, 3), (0, 0, None), (5, 0, None), (0, 0, 5), (None, 2, 3), (-6, None, 4), (-8, None, 4)]
    terms = spark.createDataFrame(rows, "a long, b long, c long").select(*(F.when(F.col(c).isNotNull(), T.integer(c)).alias(c) for c in "abc"))
    done = L.INTEGER_RELATIONS["prod"].complete(terms, ["a", "b", "c"])
    got = {tuple(int(x) if x else None for x in r[:3]): (r[3], r[4]) for r in done.select(*(F.when(F.col(c).isNotNull(), T.lexical(c)) for c in "abc"), "consistent", F.transform(F.get("tuples", F.lit(0)), T.lexical)).collect()}
    fails = (False, None)
    full = lambda *x: (True, [str(v) for v in x])
    assert got == dict(zip(rows, [fails, full(6, 2, 3), full(6, 2, 3), fails, full(6, 2, 3), (True, None), fails, full(0, 0, 5), full(6, 2, 3), fails, full(-8, -2, 4)]))


def test_axioms_used(spark):
    axioms = R.RULESETS["rdf"].axioms
    graphs = {"a": graph_of(spark, [axioms[2], ("<x>", "<p>", "<y>")]), "b": graph_of(spark, [("<x>", "<p>", "<y>")])}
    proof = lambda *steps: E.Proof(graphs, [R.RULESETS["rdf"]], ["a", "b"], list(steps), "b")
    assert proof().axioms_used() == []
    assert proof(E.Step("r1", ["b"], "b")).axioms_used() == []
    assert proof(E.Step("r1", ["a"], "b")).axioms_used() == [axioms[2]]
    assert proof().explain() is None
    empty = E.Proof(graphs | {"none": graphs["a"].where("false")}, [], [], [], "none")
    assert empty.explain() is None


def test_maxima(spark):
    rng = random.Random(1)
    points = [tuple(rng.randint(0, 40) for _ in range(4)) for _ in range(600)]
    for columns, names in ((1, "x"), (2, "xy"), (3, "xyz"), (4, "xyzw")):
        rows = {p[:columns] for p in points}
        over = lambda a, b: a != b and all(x >= y for x, y in zip(a, b))
        df = spark.createDataFrame([*points, (None, None, None, None)], "x int, y int, z int, w int").repartition(5)
        assert {tuple(r) for r in O.maxima(df, list(names)).collect()} == {a for a in rows if not any(over(b, a) for b in rows)}
        assert {tuple(r) for r in O.maxima(df, list(names), least=True).collect()} == {a for a in rows if not any(over(a, b) for b in rows)}
    assert O.maxima(df.where("x < 0"), ["x", "y"]).collect() == O.maxima(df.where("x < 0"), ["x", "y", "z"]).collect() == []
    plan = O.maxima(df, ["x", "y"])._jdf.queryExecution().toString() + O.maxima(df, ["x", "y", "z"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(TypeError):
        O.maxima(df.withColumn("t", F.lit("a")), ["x", "y", "t"])


def test_maxima_of_many_that_none_dominates(spark):
    many = spark.range(200_000).select(F.col("id").alias("x"), (-F.col("id")).alias("y"))
    assert O.maxima(many, ["x", "y"]).count() == 200_000


def test_most_complete_and_maximal_sets(spark):
    rng = random.Random(2)
    rows = {(k, *(rng.choice([None, "a", "b"]) for _ in range(3))) for k in (1, 2, None) for _ in range(15)}
    more = lambda a, b: a != b and a[0] == b[0] and all(x is None or x == y for x, y in zip(a[1:], b[1:]))
    got = O.most_complete(spark.createDataFrame(list(rows), "k int, a string, b string, c string"), ["k"], ["a", "b", "c"])
    assert {tuple(r) for r in got.collect()} == {a for a in rows if not any(more(a, b) for b in rows)}
    sets = [sorted(rng.sample(range(9), rng.randint(0, 5))) for _ in range(60)]
    want = {tuple(a) for a in sets if a and not any(set(a) < set(b) for b in sets)}
    assert sorted(tuple(r.x) for r in O.maximal_sets(spark.createDataFrame([(x,) for x in [*sets, None]], "x array<int>"), "x").collect()) == sorted(want)
    hot = spark.range(1000).select(F.lit("i").alias("s"), F.expr("array(named_struct('a', string(id), 'b', string(null)), named_struct('a', string(null), 'b', string(id)))").alias("x")).select("s", F.inline("x"))
    assert O.most_complete(hot, ["s"], ["a", "b"]).count() == 2000


def test_numbers(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.lit(None)).alias("k")).repartition(7)
    assert all(r.v == r.number for r in numbered(df, ["v"]).collect())
    by = {}
    for r in ranked(df, ["k"], ["v"]).collect():
        by.setdefault(r.k, []).append((r["rank"], r.v))
    assert set(by) == {"hot", None} and all([i for i, _ in sorted(x)] == list(range(len(x))) and sorted(v for _, v in x) == [v for _, v in sorted(x)] for x in by.values())
    assert numbered(df.where("v < 0"), ["v"]).collect() == []
    g = graph_of(spark, [("_:b", "<p>", "_:7"), ("_:a", "<p>", "_:b"), ("_:3", "<p>", "<x>")])
    assert {tuple(r) for r in renumbered(g).collect()} == {("_:4", "<p>", "_:2"), ("_:3", "<p>", "_:4"), ("_:1", "<p>", "<x>")}
    assert largest_blank_number(g) == 7
    assert {tuple(r) for r in renumbered(g, ~F.col("term").rlike("[0-9]")).collect()} == {("_:9", "<p>", "_:7"), ("_:8", "<p>", "_:9"), ("_:3", "<p>", "<x>")}


def test_folding_sends_no_table_through_the_driver(spark, tmp_path):
    blank = F.concat(F.lit("_:b"), "id", F.lit("-"), "n")
    rows = spark.range(300).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    rows.select("id", "n", blank.alias("s"), F.lit("<p>").alias("p"), F.lit("<o>").alias("o")).write.parquet(f"{tmp_path}/g")
    done = duplicates_folded(spark.read.parquet(f"{tmp_path}/g"), ["id"], "n")
    assert "BroadcastHashJoin" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.count() == 300 and done.where("n > 0").isEmpty()


def test_folding_keeps_the_first(spark):
    rows = [("k", 0, "<a>", "<p>", "_:x"), ("k", 1, "<a>", "<p>", "_:y"), ("k", 2, "<b>", "<p>", "_:y"), ("l", 5, "<a>", "<p>", "_:y")]
    got = duplicates_folded(spark.createDataFrame(rows, "k string, n int, s string, p string, o string"), ["k"], "n")
    assert {(r.k, r.n) for r in got.collect()} == {("k", 0), ("k", 2), ("l", 5)}


def test_only_claims_of_one_outline_get_certificates(spark, monkeypatch):
    seen = []
    real = claims.certificates
    monkeypatch.setattr(claims, "certificates", lambda quads: seen.extend(r.g for r in quads.select("g").distinct().collect()) or real(quads))
    graph = [("<a>", "<p>", "<b>"), ("<a>", "<q>", "<c>")]
    asked = [("_:a", "<p>", "<b>"), ("_:b", "<p>", "<c>"), ("_:c", "<p>", "<b>"), ("_:d", "<p>", "_:e"), ("_:e", "<q>", "<c>"), ("_:f", "<q>", "_:f")]
    got = {r.component: r.entailed for r in components_entailed(graph_of(spark, graph), graph_of(spark, asked)).collect()}
    assert got == {"_:a": True, "_:b": False, "_:c": True, "_:d": False, "_:f": False}
    assert sorted(seen) == ["_:a", "_:c"]


def test_graphs_unlike_all_others_of_their_key_are_kept_without_certificates(spark, monkeypatch):
    def none(quads):
        raise AssertionError("no certificate is needed")

    monkeypatch.setattr(canon, "certificates", none)
    rows = [("k", 0, "_:a", "<p>", "<b>"), ("k", 1, "_:a", "<p>", "<c>"), ("k", 2, "_:a", "<p>", "_:a"), ("k", 2, "_:b", "<p>", "_:c"), ("l", 0, "_:a", "<p>", "<b>")]
    df = spark.createDataFrame(rows, "k string, n int, s string, p string, o string")
    assert sorted(map(tuple, duplicates_folded(df, ["k"], "n").select("k", "n", "s", "p", "o").collect())) == sorted(rows)


def test_large_and_small_pairs_are_met_alike(spark, monkeypatch):
    """Rows of a pair meet in one row or by numbers, with the same result; arcs are written once, without what they hold."""
    a = [("<s>", "<p>", f"_:a{i}") for i in range(6)] + [(f"_:a{i}", "<q>", f'"{i % 3}"') for i in range(6)] + [(f"_:a{i}", "<r>", f"_:b{i}") for i in range(6)] + [(f"_:b{i}", "<v>", f'"{i}"') for i in range(6)]
    b = [("<s>", "<p>", f"_:c{i}") for i in range(5)] + [(f"_:c{i}", "<q>", f'"{i % 3}"') for i in range(5)] + [(f"_:c{i}", "<r>", f"_:d{i}") for i in range(5)] + [(f"_:d{i}", "<v>", f'"{i + i % 2}"') for i in range(5)]
    arcs, nodes = trees.digested(graph_of(spark, a), graph_of(spark, b))
    assert arcs.columns == ["side", "s", "p", "o"] and nodes.count() == 13 + 11
    small = difference(spark, a, b)
    assert ("<s>", "<p> <r> <v>", '"1"', '"2"') in small and any(left and right is None for _, _, left, right in small)
    monkeypatch.setattr(trees, "TOGETHER", 0)
    assert difference(spark, a, b) == small
