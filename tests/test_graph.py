"""Behaviour of terms, patterns, modifiers, rules and entailment on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import uri as U
from graphloom.functions.vocab import INTEGER, NIL, TYPE
from graphloom.operators import entail as E
from graphloom.operators import graph as G
from graphloom.operators import modifiers as M
from graphloom.operators import query as Q
from graphloom.operators import rules as R
from graphloom.sources.mapping import graph_of
from graphloom.sources.text import read_triples, write_triples

I = f'"^^<{INTEGER}>'


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def ints(spark, *values, names="abcd"):
    data = [tuple(None if v is None else f'"{v}{I}' for v in row) for row in values]
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names[: len(values[0])]))


@pytest.mark.parametrize("lexical, value", [("+000456", 456), ("-0987", -987), ("11x2", None), (" 321", None), ("321 ", None), ("321\n", None)])
def test_integer_lexical_forms(spark, lexical, value):
    got = spark.createDataFrame([(f'"{lexical}{I}',)], "x string").select(T.as_integer("x")).first()[0]
    assert (None if got is None else int(got)) == value


def test_term_parts(spark):
    df = spark.createDataFrame([('"a\\"b\\nc\\\\n"@EN',), ('"x"^^<urn:t>',), ("<urn:i>",), ("_:b",), (None,)], "x string")
    got = [tuple(r) for r in df.select(T.lexical("x"), T.language("x"), T.datatype("x"), T.is_iri("x"), T.is_blank("x"), T.name_of("x")).collect()]
    assert got == [('a"b\nc\\n', "en", "", False, False, ""), ("x", "", "urn:t", False, False, ""), ("", None, None, True, False, "urn:i"), ("", None, None, False, True, ""), ("", None, None, False, False, "")]
    text = spark.createDataFrame([('q"\\\n\r x',)], "t string")
    assert text.select(T.lexical(T.plain("t"))).first()[0] == 'q"\\\n\r x'


@pytest.mark.parametrize("n, d", [(7, 2), (7, -2), (-7, 2), (-7, -2), (6, 3), (-6, 3), (0, 5)])
def test_divmod_floors(spark, n, d):
    got = M.INTEGER["divmod"].apply(ints(spark, (n, d), names="nd"), "q", "r", "n", "d").select(T.as_integer("q"), T.as_integer("r")).first()
    assert tuple(map(int, got)) == divmod(n, d)


def test_divisor_zero_and_wrong_kinds_drop_rows(spark):
    assert M.INTEGER["divmod"].apply(ints(spark, (1, 0), names="nd"), "q", "r", "n", "d").isEmpty()
    df = spark.createDataFrame([('"1"', f'"2{I}'), ("<urn:x>", f'"2{I}')], "b string, c string")
    assert M.INTEGER["sum"].apply(df, "a", "b", "c").isEmpty()


def test_sum_binds_any_one(spark):
    for names, expect in (("bc", {"a": 33}), ("ac", {"b": 22}), ("ab", {"c": 11})):
        value = {"a": 33, "b": 22, "c": 11}
        out = M.INTEGER["sum"].apply(ints(spark, tuple(value[n] for n in names), names=names), "a", "b", "c").first()
        assert {k: out[k] for k in expect} == {k: f'"{v}{I}' for k, v in expect.items()}


@pytest.mark.parametrize("b, e, want", [(3, 40, 3**40), (2, 0, 1), (0, 0, 1), (-1, 3, -1), (3, 100, None), (2, -1, None), (1, -1, None)])
def test_power_is_exact(spark, b, e, want):
    got = M.INTEGER["power"].apply(ints(spark, (b, e), names="bc"), "a", "b", "c").select(T.as_integer("a")).collect()
    assert [int(r[0]) for r in got] == ([] if want is None else [want])


def test_modifier_needs_a_usage(spark):
    with pytest.raises(ValueError):
        M.INTEGER["abs"].apply(ints(spark, (1,), names="a"), "a", "b")
    assert M.find_order({"a"}, [M.Step(M.INTEGER["abs"], ("a", "b"))]) is None


def brute(triples, patterns):
    names, out = Q.names(patterns), []
    for combo in itertools.product(triples, repeat=len(patterns)):
        bound = {}
        if all(bound.setdefault(Q.column_name(t), v) == v if Q.variable(t) else t == v for p, x in zip(patterns, combo) for t, v in zip(p, x)):
            out.append(tuple(bound[n] for n in names))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_patterns_match_brute_force(spark, seed):
    rng = random.Random(seed)
    triples = sorted({tuple(rng.choice("abc") for _ in range(3)) for _ in range(10)})
    patterns = [tuple(rng.choice(["?x", "?y", "?z", "a", "b"]) for _ in range(3)) for _ in range(3)]
    got = Q.match(graph_of(spark, triples), patterns)
    names = Q.names(patterns)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == brute(triples, patterns)


def test_empty_query_and_empty_graph(spark):
    assert Q.match(graph_of(spark, []), []).count() == 1
    assert Q.match(graph_of(spark, []), Q.pattern("?a ?b ?c")).isEmpty()


FAMILY = [("<r:a>", "<r:son>", "<r:b>"), ("<r:a>", "<r:son>", "<r:c>"), ("<r:b>", "<r:son>", "<r:d>"), ("<r:c>", "<r:daughter>", "<r:e>")]


def test_sibling_rule_with_filter(spark):
    rule = R.Rule("sib", Q.pattern("?a <r:son> ?b . ?a <r:son> ?c"), Q.pattern("?b <r:brother> ?c"), R.where(Q.different("b", "c")))
    assert rows(rule.forward(graph_of(spark, FAMILY))) == [("<r:b>", "<r:brother>", "<r:c>"), ("<r:c>", "<r:brother>", "<r:b>")]
    assert rule.check(graph_of(spark, FAMILY), graph_of(spark, [("<r:b>", "<r:brother>", "<r:c>")]))
    assert not rule.check(graph_of(spark, FAMILY), graph_of(spark, [("<r:b>", "<r:brother>", "<r:b>")]))


def test_unbound_template_variables(spark):
    b = Q.match(graph_of(spark, FAMILY), Q.pattern("?a <r:daughter> ?b"))
    assert Q.construct(b, Q.pattern("?a <r:x> ?n")).isEmpty() and Q.unbound(b, Q.pattern("?a <r:x> ?n")) == ["n"]
    assert rows(Q.construct_blank(b, Q.pattern("?a <r:x> ?n")))[0][2].startswith("_:sk")


def test_same_literal_shares_its_blank(spark):
    g = graph_of(spark, [("<a>", "<p>", '"l"'), ("<b>", "<p>", '"l"')])
    out = rows(R.find_rule("rdf:lg").forward(g))
    assert len(out) == 3 and len({o for s, p, o in out if p == "<p>"}) == 1


def test_closure_is_idempotent_and_ends_on_cycles(spark):
    chain = [(f"<c{i}>", R.SUBCLASS, f"<c{i + 1}>") for i in range(5)] + [("<c5>", R.SUBCLASS, "<c3>"), ("<x>", TYPE, "<c0>")]
    g = R.rdfs_closure(graph_of(spark, chain))
    assert {o for s, p, o in rows(g) if s == "<x>"} == {f"<c{i}>" for i in range(6)}
    assert G.equivalent(g, R.rdfs_closure(g))


def test_closure_says_when_rounds_run_out(spark):
    chain = graph_of(spark, [(f"<c{i}>", R.SUBCLASS, f"<c{i + 1}>") for i in range(9)])
    with pytest.raises(RuntimeError):
        R.closure(chain, [R.find_rule("rdfs:r11")], rounds=1)


def test_closure_under_all_rules(spark):
    one, member = R.iri("rdf:_1"), R.iri("rdfs:member")
    got = set(rows(R.rdfs_all_closure(graph_of(spark, [("<x>", one, "<y>"), ("<d>", TYPE, R.iri("rdfs:Datatype"))]))))
    assert {("<x>", member, "<y>"), ("<d>", R.SUBCLASS, R.iri("rdfs:Literal")), ("<x>", TYPE, R.iri("rdfs:Resource")), (one, TYPE, R.iri("rdf:Property"))} <= got


def test_merge_keeps_blanks_apart_and_rename_is_isomorphic(spark):
    g = graph_of(spark, [("_:a", "<p>", "_:b"), ("_:b", "<p>", "_:c"), ("_:a", "<q>", '"1"')])
    to = spark.createDataFrame([("_:a", "_:x"), ("_:b", "_:y"), ("_:c", "_:z")], "term string, to string")
    assert E.isomorphic(g, G.rename(g, to))
    assert G.merge(g, g).count() == 6
    other = graph_of(spark, [("_:a", "<p>", "_:b"), ("_:c", "<p>", "_:b"), ("_:a", "<q>", '"1"')])
    assert not E.isomorphic(g, other)


def test_isomorphism_has_no_size_limit(spark):
    def named(stem, last):
        return graph_of(spark, [x for i in range(300) for x in ((f"_:{stem}{i}", "<p>", f'"{i}"'), (f"_:{stem}{i}", "<q>", f"_:{stem}{(i + 1) % last}"))])

    assert E.isomorphic(named("a", 300), named("b", 300))
    assert not E.isomorphic(named("a", 300), named("b", 299))
    alike = lambda stem: graph_of(spark, [(f"_:{stem}{i}", "<p>", '"same"') for i in range(500)])
    assert E.isomorphic(alike("a"), alike("b"))


def test_isomorphism_of_tied_nodes(spark):
    rings = lambda stem, *sizes: graph_of(spark, [(f"_:{stem}{k}-{i}", "<p>", f"_:{stem}{k}-{(i + 1) % n}") for k, n in enumerate(sizes) for i in range(n)])
    assert E.isomorphic(rings("a", 3, 4, 3), rings("b", 4, 3, 3))
    assert not E.isomorphic(rings("a", 6), rings("b", 3, 3))


def test_entailment_has_no_size_limit(spark):
    g = graph_of(spark, [(f"<n{i}>", "<p>", f'"{i}"') for i in range(300)])
    assert E.simple_entails(g, g.union(graph_of(spark, [("_:x", "<p>", '"7"'), ("_:y", "<p>", "_:z")])))
    assert not E.simple_entails(g, g.union(graph_of(spark, [("_:x", "<p>", '"7"'), ("_:x", "<p>", '"8"')])))


def test_entailment(spark):
    g = graph_of(spark, FAMILY)
    assert E.simple_entails(g, graph_of(spark, [("_:x", "<r:son>", "_:y"), ("_:y", "<r:son>", "<r:d>")]))
    assert not E.simple_entails(g, graph_of(spark, [("_:x", "<r:son>", "_:y"), ("_:y", "<r:son>", "<r:e>")]))
    assert E.subgraph_entails(g, graph_of(spark, FAMILY[:2])) and len(list(E.subgraphs(g))) == 14


def test_proof(spark):
    step = R.Rule("grand", Q.pattern("?a <r:son> ?b . ?b <r:son> ?c"), Q.pattern("?a <r:grandson> ?c"))
    graphs = {"in": graph_of(spark, FAMILY), "out": graph_of(spark, [("<r:a>", "<r:grandson>", "<r:d>")])}
    proof = lambda rule, given: E.Proof(graphs, [], given, [E.Step(rule, ["in"], "out")], "out", [step])
    assert proof("grand", ["in"]).explain() is None
    assert "not present" in proof("other", ["in"]).explain()
    assert "not axiom" in proof("grand", []).explain()
    assert E.Proof(graphs, [], ["in"], [], "out").explain() == "Result not demonstrated"


def test_restrictions(spark):
    one = f"<{R.iri('rdf:_1')[1:-1]}>"
    sums = graph_of(spark, [("_:i", TYPE, "<urn:Abs>"), ("_:i", one, f'"-1{I}'), ("_:i", one.replace("_1", "_2"), f'"1{I}')])
    assert rows(E.restrict(sums, "<urn:Abs>", M.INTEGER["abs"])) == [("_:a", E.FALSE, "_:b")]
    part = graph_of(spark, [("_:i", TYPE, "<urn:Abs>"), ("_:i", one, f'"1{I}')])
    assert E.restrict(part, "<urn:Abs>", M.INTEGER["abs"]).isEmpty()


def test_restrictions_send_no_table_through_the_driver(spark, tmp_path):
    member = lambda i: f"<{R.iri(f'rdf:_{i}')[1:-1]}>"
    node = F.concat(F.lit("_:n"), "id")
    arc = lambda p, o: F.struct(node.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    about = [arc(TYPE, F.lit("<urn:Sum>")), arc(member(2), T.integer("id")), arc(member(3), T.integer(F.col("id") + 1))]
    spark.range(500).select(F.inline(F.array(*about))).write.parquet(f"{tmp_path}/g")
    done = E.restrict(spark.read.parquet(f"{tmp_path}/g"), "<urn:Sum>", M.INTEGER["sum"])
    assert "BroadcastHashJoin" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.count() == 500 and done.where(F.col("s") == "_:n7").first().o.startswith('"15"')


def test_a_false_graph_sends_no_table_through_the_driver(spark, tmp_path):
    node, members = F.concat(F.lit("_:n"), "id"), [f"<{R.iri(f'rdf:_{i}')[1:-1]}>" for i in (1, 2)]
    about = [(TYPE, F.lit("<urn:Neg>")), (members[0], T.integer("id")), (members[1], T.integer(F.when(F.col("id") == 7, 1).otherwise(-F.col("id"))))]
    arcs = F.array(*(F.struct(node.alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in about))
    spark.range(500).select(F.inline(arcs)).write.parquet(f"{tmp_path}/g")
    done = E.restrict(spark.read.parquet(f"{tmp_path}/g"), "<urn:Neg>", M.INTEGER["neg"])
    assert "BroadcastHashJoin" not in done._jdf.queryExecution().executedPlan().toString()
    assert rows(done) == [("_:a", E.FALSE, "_:b")]


def test_lists(spark):
    made = G.make_lists(spark.createDataFrame([(1, list("abcdefghijk")), (2, ["z"])], "k int, x array<string>"), "k", "x")
    heads = spark.createDataFrame([("_:l-1-0",), ("_:l-2-0",), (NIL,)], "head string")
    got = {}
    for r in G.list_items(made, heads).orderBy("position").collect():
        got.setdefault(r["head"], []).append(r["item"])
    assert got == {"_:l-1-0": list("abcdefghijk"), "_:l-2-0": ["z"]}


def test_lists_of_any_length_and_circular_ones(spark):
    made = G.make_lists(spark.createDataFrame([(1, [str(i) for i in range(3000)])], "k int, x array<string>"), "k", "x")
    ring = [(f"_:c{i}", p, o) for i in range(3) for p, o in ((G.FIRST, f"r{i}"), (G.REST, f"_:c{(i + 1) % 3}"))]
    got = G.list_items(made.union(graph_of(spark, ring)), spark.createDataFrame([("_:l-1-0",), ("_:c1",)], "head string"))
    assert rows(got.where("head = '_:l-1-0'").select("position", "item")) == [(i, str(i)) for i in range(3000)]
    assert rows(got.where("head = '_:c1'").select("position", "item")) == [(0, "r1"), (1, "r2"), (2, "r0")]


def test_text_round_trip(spark, tmp_path):
    g = graph_of(spark, [("<urn:e:a>", TYPE, "<urn:e:C>"), ("<urn:e:a>", "<urn:e:p>", '"x ; , . \\"q\\""'), ("<urn:e:a>", "<urn:e:p>", f'"1{I}'), ("_:b1", "<urn:e:p>", '"l"@en')])
    write_triples(g, str(tmp_path / "g"), {"e": "urn:e:"})
    assert rows(read_triples(spark, str(tmp_path / "g"))) == rows(g)
    (tmp_path / "t.txt").write_text('@prefix e: <urn:e:> .\n# note\ne:a a e:C ; e:p e:x , "2"^^xsd:integer .\ne:a = e:b .\n')
    assert len(rows(read_triples(spark, str(tmp_path / "t.txt")))) == 4


@pytest.mark.parametrize("ref, full", [("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("/g", "http://a/g"), ("../g", "http://a/b/g"), ("../../g", "http://a/g"), ("g/", "http://a/b/c/g/"), ("#s", "http://a/b/c/d;p?q#s"), ("g;x=1/../y", "http://a/b/c/y"), ("..", "http://a/b/"), ("http:g", "http:g")])
def test_resolve(spark, ref, full):
    assert spark.range(1).select(U.resolve(F.lit("http://a/b/c/d;p?q"), F.lit(ref))).first()[0] == full


def test_list_items_run_the_graph_s_plan_once(spark):
    rows = spark.range(3).select("id", F.array(F.lit("<a>"), F.lit("<b>"), F.lit("<c>")).alias("x"))
    made = G.make_lists(rows, "id", "x")
    done = G.list_items(made, rows.select(F.concat(F.lit("_:l-"), "id", F.lit("-0")).alias("head")))
    assert "Range (" not in done._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.head, r.position, r.item) for r in done.collect()) == [(f"_:l-{k}-0", i, f"<{c}>") for k in range(3) for i, c in enumerate("abc")]


def test_the_whole_closure_runs_each_seeding_rule_twice_on_all_triples(spark, monkeypatch):
    calls = []
    real = R.Rule.forward
    monkeypatch.setattr(R.Rule, "forward", lambda self, graph: calls.append(self.name) or real(self, graph))
    graph = [("<c>", "<http://www.w3.org/2000/01/rdf-schema#subClassOf>", "<d>"), ("<x>", TYPE, "<c>")]
    done = {tuple(r) for r in R.rdfs_all_closure(graph_of(spark, graph)).collect()}
    assert ("<x>", TYPE, "<d>") in done and ("<d>", TYPE, "<http://www.w3.org/2000/01/rdf-schema#Resource>") in done
    # once as a seed, once in the first round of all rules
    assert calls.count("r7") == calls.count("r9") == calls.count("r3") == 2
