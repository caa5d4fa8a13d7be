"""Parts of date-times, hosts, language tags, labels of named graphs."""

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import uri as U
from graphloom.operators import entail as E
from graphloom.operators import named as N


def test_date_times_are_taken_apart_and_shown(spark):
    cases = {
        "2024-02-29T23:59:59Z": ((2024, 2, 29, 23, 59, 59, 0, 0), "2024-02-29T23:59:59Z"),
        "2024-02-29T00:00:00.5-03:30": ((2024, 2, 29, 0, 0, 0, 500, -210), "2024-02-29T00:00:00.500-03:30"),
        "1900-01-01T01:02:03.045+14:00": ((1900, 1, 1, 1, 2, 3, 45, 840), "1900-01-01T01:02:03.045+14:00"),
        "0099-12-31T01:02:03": ((99, 12, 31, 1, 2, 3, 0, 0), "0099-12-31T01:02:03Z"),
        "12024-12-31T01:02:03": ((12024, 12, 31, 1, 2, 3, 0, 0), "12024-12-31T01:02:03Z"),
        "2023-02-29T00:00:00Z": (None, None),
        "2023-02-28T24:00:00Z": (None, None),
        "2023-02-28": (None, None),
        "": (None, None),
        None: (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", U.accessors("x").alias("a")).select("x", "a", U.show_date_time("a").alias("t"))
    assert {r.x: (r.a and tuple(r.a), r.t) for r in rows.collect()} == cases


def test_days_of_the_calendar(spark):
    cases = {(2024, 2, 29): True, (2023, 2, 29): False, (1900, 2, 29): False, (2000, 2, 29): True, (2023, 13, 1): False, (2023, 0, 1): False, (2023, 4, 31): False, (2023, 4, 0): False, (2023, 4, None): False}
    rows = spark.createDataFrame(list(cases), "y int, m int, d int")
    assert {(r.y, r.m, r.d): r.ok for r in rows.withColumn("ok", U.valid_date("y", "m", "d")).collect()} == cases


def test_hosts(spark):
    cases = {"http://a.b/": True, "http://u:p@a.b:80/x": True, "http://1.2.3.4/": True, "http://[::1]:8080/": True, "http://a..b/": False, "http://a.b:x/": False, "http://-a.b/": False, "urn:x": False}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").withColumn("ok", F.coalesce(U.has_host("x"), F.lit(False)))
    assert {r.x: r.ok for r in rows.collect()} == cases


def test_language_tags(spark):
    cases = {'"a"@en': True, '"a"@en-gb': True, '"a"@enx': False, '"a"': False, "<urn:en>": False}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").withColumn("ok", T.language_matches("x", "EN"))
    assert {r.x: r.ok for r in rows.collect()} == cases


def quads(spark, *rows):
    return spark.createDataFrame(list(rows), "g string, s string, p string, o string")


def test_labels_of_graphs_that_are_mentioned(spark):
    """A mentions B and B mentions A; nothing mentions C."""
    q = quads(spark, (None, "<x>", "<p>", "<A>"), ("<A>", "<a>", "<p>", "<B>"), ("<B>", "<b>", "<p>", "<A>"), ("<C>", "<c>", "<p>", "<A>"))
    assert {r.term for r in N.reachable_labels(q).collect()} == {"<x>", "<p>", "<A>", "<a>", "<B>", "<b>"}
    assert {r.term for r in N.all_labels(q).collect()} == {"<x>", "<p>", "<A>", "<a>", "<B>", "<b>", "<C>", "<c>"}
    assert N.reachable_labels(q.where("g is not null")).isEmpty()


def test_one_formula_against_another(spark):
    chain = quads(spark, ("<A>", "_:a", "<p>", "_:b"), ("<A>", "_:b", "<p>", "_:c"), ("<B>", "<x>", "<p>", "<y>"))
    again = quads(spark, ("<A>", "_:1", "<p>", "_:2"), ("<A>", "_:3", "<p>", "_:1"))
    star = quads(spark, ("<A>", "_:a", "<p>", "_:b"), ("<A>", "_:a", "<p>", "_:c"))
    assert N.equal_formulae(chain, again, "<A>") and not N.equal_formulae(chain, star, "<A>")
    assert not N.equal_formulae(chain, again, "<B>") and N.equal_formulae(chain, again, "<C>")


def test_runs(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("b", 1)], "k string, v int")
    assert [(r.k, r["values"]) for r in E.collect_runs(rows, "k", "v", 2).collect()] == [("a", [1, 2])]
