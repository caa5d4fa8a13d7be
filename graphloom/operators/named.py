"""Named graphs: frames (g, s, p, o) in which ``g`` names the graph that a triple is in, NULL for the outer one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canon import certificates
from .entail import isomorphic
from .graph import SPO
from .scratch import settle


def formula(quads: DataFrame, name: str) -> DataFrame:
    """The triples of one named graph; none if there is no such graph."""
    return quads.where(F.col("g") == name).select(*SPO)


def outer(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("g").isNull()).select(*SPO)


def with_formula(quads: DataFrame, name: str, graph: DataFrame) -> DataFrame:
    """``quads`` with ``graph`` as the named graph ``name``, in place of one so named."""
    return quads.where(~F.coalesce(F.col("g") == name, F.lit(False))).select("g", *SPO).union(graph.select(F.lit(name).alias("g"), *SPO).distinct())


def formula_names(quads: DataFrame) -> DataFrame:
    return quads.where("g is not null").select(F.col("g").alias("term")).distinct()


def all_labels(quads: DataFrame) -> DataFrame:
    """Distinct terms of the outer graph and of all named ones, with the names themselves."""
    return quads.select(F.explode(F.array("g", *SPO)).alias("term")).where("term is not null").distinct()


def reachable_labels(quads: DataFrame) -> DataFrame:
    """Distinct terms of the outer graph and of the named graphs that it mentions, those that these mention, and so on.

    A round of joins for each step of mentions; a graph is read in the round in which it is first mentioned, so circles of
    mentions end.
    """
    named = settle(quads.where("g is not null").select("g", F.explode(F.array(*SPO)).alias("term")).distinct())
    names = named.select(F.col("g").alias("term")).distinct()
    found = new = settle(outer(quads).select(F.explode(F.array(*SPO)).alias("term")).distinct())
    while True:
        inner = new.join(names, "term", "left_semi").withColumnRenamed("term", "g")
        new = settle(named.join(inner, "g", "left_semi").select("term").distinct().join(found, "term", "left_anti"))
        if new.isEmpty():
            return found
        found = settle(found.union(new))


def same_formulae(a: DataFrame, b: DataFrame) -> DataFrame:
    """(g, same) of every name of either side: whether its graphs are equal up to the names of blank nodes and variables.

    A missing graph is empty. All names are compared together, by ``canon.certificates``.
    """
    side = lambda q, s: q.where("g is not null").select(F.to_json(F.struct(F.lit(s).alias("side"), "g")).alias("key"), "g", *SPO)
    both = settle(side(a, 0).union(side(b, 1)))
    marks = certificates(both.select(F.col("key").alias("g"), *SPO)).withColumnRenamed("g", "key")
    keys = both.select("key", "g").distinct().join(marks, "key")
    # a name has one certificate a side, and so one or two rows
    each = keys.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("certificate").alias("kinds"))
    return each.select("g", ((F.col("n") == 2) & (F.col("kinds") == 1)).alias("same"))


def equal_formulae(a: DataFrame, b: DataFrame, name: str) -> bool:
    """The named graphs of both sides are equal up to the names of blank nodes and variables, of any size."""
    return isomorphic(formula(a, name), formula(b, name))
