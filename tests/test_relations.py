"""Relations, long numbers, escapes, text reading and circles of blank nodes against results worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import uri as U
from graphloom.operators import entail as E
from graphloom.operators import modifiers as M
from graphloom.operators import orders as O
from graphloom.operators import relations as L
from graphloom.sources.mapping import graph_of
from graphloom.sources.text import read_triples


def numbers(spark, *rows):
    kind = ", ".join(f"v{i} string" for i in range(len(rows[0])))
    g = spark.createDataFrame(rows, kind)
    return g.select(*(F.when(F.col(c).isNotNull(), T.integer(c)).alias(c) for c in g.columns))


def test_long_quotients_and_overflow(spark):
    pairs = [(10**34 + 7, 3), (-(10**34) - 7, 3), (10**37 + 1, -7), (10**37, 10**20 + 1), (5, 0), (-1, 10**18)]
    rows = numbers(spark, *((str(n), str(d)) for n, d in pairs))
    got = M.INTEGER["divmod"].apply(rows, "q", "r", "v0", "v1").select(*(T.as_integer(c).alias(c) for c in ("v0", "v1", "q", "r"))).collect()
    want = {(n, d): divmod(n, d) for n, d in pairs if d}
    assert {(int(r.v0), int(r.v1)): (int(r.q), int(r.r)) for r in got} == want
    top = numbers(spark, (str(10**38 - 1), "1"), ("2", "3"))
    assert M.INTEGER["sum"].apply(top, "a", "v0", "v1").count() == 1
    assert M.total(top, "a", "v0", "v1").count() == 1


def test_relations_merge_with_given_values(spark):
    done = L.INTEGER_RELATIONS["abs"].complete(numbers(spark, ("4", None), ("-4", None), (None, "-4"), ("4", "-4"), ("4", "5"), (None, None)), ["v0", "v1"])
    text = lambda r: (r.consistent, sorted(tuple(int(x.split('"')[1]) for x in t) for t in r.tuples or []))
    found = {(r.v0 and r.v0.split('"')[1], r.v1 and r.v1.split('"')[1]): text(r) for r in done.collect()}
    assert found == {
        ("4", None): (True, [(4, -4), (4, 4)]),
        ("-4", None): (False, []),
        (None, "-4"): (True, [(4, -4)]),
        ("4", "-4"): (True, [(4, -4)]),
        ("4", "5"): (False, []),
        (None, None): (True, []),
    }


def test_escapes(spark):
    row = spark.range(1).select(T.lexical(F.lit(r'"a\tbé\U0001F600\\n\'\""')).alias("x"), T.lexical(T.plain(F.lit('t\t"\\n'))).alias("y")).first()
    assert (row.x, row.y) == ("a\tbé😀\\n'\"", 't\t"\\n')


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text('@prefix u: <urn:> .\n# note\nu:a u:b u:c . u:d u:e u:f , "x;." ; u:g u:h .\n')
    got = {tuple(r) for r in read_triples(spark, str(tmp_path)).collect()}
    assert got == {("<urn:a>", "<urn:b>", "<urn:c>"), ("<urn:d>", "<urn:e>", "<urn:f>"), ("<urn:d>", "<urn:e>", '"x;."'), ("<urn:d>", "<urn:g>", "<urn:h>")}
    for bad in ("<urn:a> <urn:b> <urn:c> ;\n", "<urn:a> <urn:b> [ ] .\n", "@base <urn:x> .\n"):
        folder = tmp_path / f"bad{len(bad)}"
        folder.mkdir()
        (folder / "a.txt").write_text(bad)
        with pytest.raises(Exception, match="not whole statements"):
            read_triples(spark, str(folder)).collect()


def test_circles_of_blanks_start_once(spark):
    g = graph_of(spark, [("_:a", "<p>", "_:b"), ("_:b", "<p>", "_:a"), ("_:b", "<p>", "_:c"), ("_:c", "<p>", "<x>"), ("<s>", "<p>", "_:t"), ("_:t", "<p>", "<y>")])
    assert {r.term for r in E.top_level(g).collect()} == {"_:a", "<s>"}
    assert {r.o for r in E.nested(g).where("inside").collect()} == {"_:b", "_:c", "_:t"}


def test_maxima(spark):
    rows = [(i * 7 % 50, i * 13 % 60) for i in range(200)]
    want = {a for a in rows if not any(b != a and b[0] >= a[0] and b[1] >= a[1] for b in rows)}
    assert {tuple(r) for r in E.maxima(spark.createDataFrame(rows, "x int, y int").repartition(5), ["x", "y"]).collect()} == want
    with pytest.raises(TypeError):
        E.maxima(spark.createDataFrame([("a", 1)], "x string, y int"), ["x", "y"])


def test_relative_references(spark):
    cases = {("http://h/a/b", "http://h/a/c"): "c", ("http://h/a/b", "http://h/a/"): "./", ("http://h/a/b/", "http://h/a/c"): "../c", ("http://h/a", "ftp://h/a"): "ftp://h/a", ("http://h/a/b", "http://h/a/c:d"): "./c:d"}
    got = spark.createDataFrame(list(cases), "b string, f string").select("b", "f", U.relativise("b", "f").alias("r")).collect()
    assert {(r.b, r.f): r.r for r in got} == cases


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_parsed_once_a_row(spark):
    """A filter on what was computed does not compute it again, and none is moved below a distinct."""
    rows = spark.createDataFrame([('"3"^^<http://www.w3.org/2001/XMLSchema#integer>', None)], "a string, b string").distinct()
    done = L.INTEGER_RELATIONS["abs"].complete(rows, ["a", "b"]).where("consistent")
    assert _optimized(done).count("regexp_extract") == 2
    steps = [M.Step(M.INTEGER["sum"], ("c", "a", "b")), M.Step(M.INTEGER["gt"], ("c", "a"))]
    plan = _optimized(M.compose(*steps)(rows))
    assert plan.count("regexp_extract") == 4
    assert plan.index("regexp_extract") < plan.index("Aggregate")


def test_most_complete_takes_one_shuffle(spark):
    rows = spark.createDataFrame([(k, a, b) for k in (1, None) for a, b in ((1, None), (1, 2), (None, None), (None, 3), (None, 3))], "k int, a int, b int")
    done = O.most_complete(rows, ["k"], ["a", "b"])
    assert sorted(map(tuple, done.collect()), key=str) == sorted([(k, a, b) for k in (1, None) for a, b in ((1, 2), (None, 3))], key=str)
    assert done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_sets_are_moved_under_short_ids(spark):
    """Ids are numbers, not digests as long as the sets; sets of one item are no one's larger set."""
    sets = spark.createDataFrame([([1, 2],), ([2, 1, 2],), ([2],), ([3],), ([1, 2, 4],), ([4, 5],), ([],)], "x array<int>")
    done = O.maximal_sets(sets, "x")
    assert sorted(r.x for r in done.collect()) == [[1, 2, 4], [3], [4, 5]]
    ids = re.findall(r"_id#\d+(L?)", _optimized(done))
    assert ids and all(x == "L" for x in ids)


def test_a_seeded_closure_applies_no_rule_to_all_triples_again(spark, monkeypatch):
    """Rules are run over the whole graph once; then they look only at what has been added since."""
    from graphloom.operators import rules as R

    whole, forward = [], R.Rule.forward
    monkeypatch.setattr(R.Rule, "forward", lambda self, graph: (whole.append(self.name), forward(self, graph))[1])
    sub, dom, cls = ("<http://www.w3.org/2000/01/rdf-schema#" + x + ">" for x in ("subPropertyOf", "domain", "subClassOf"))
    g = graph_of(spark, [("<p>", sub, "<q>"), ("<q>", sub, sub), ("<q>", dom, "<A>"), ("<A>", cls, "<B>"), ("<B>", cls, "<C>"), ("<x>", "<p>", "<y>"), ("<y>", "<q>", "<z>")])
    seeded = {tuple(r) for r in R.rdfs_closure(g).collect()}
    assert sorted(whole) == ["r2", "r3", "r7", "r9"]
    six = [R.find_rule(f"rdfs:{r}") for r in ("r2", "r3", "r5", "r7", "r9", "r11")]
    assert seeded == {tuple(r) for r in R.closure(g, six).collect()} and ("<x>", sub, "<z>") in seeded
