"""Graphs as frames (s, p, o) used as sets: selection, labels, set operations, renaming, lists."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.vocab import FIRST, NIL, REST
from .scratch import settle

SPO = ["s", "p", "o"]


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def extract(graph: DataFrame, condition: Column) -> DataFrame:
    return graph.where(condition)


def objects(graph: DataFrame, s: str, p: str) -> DataFrame:
    """Values of a property of a subject, a bag."""
    return graph.where((F.col("s") == s) & (F.col("p") == p)).select("o")


def integer_objects(graph: DataFrame, p: str) -> DataFrame:
    """(s, value) of the integer values of a property; other values are dropped."""
    return graph.where(F.col("p") == p).select("s", T.as_integer("o").alias("value")).where("value is not null")


def subjects(graph: DataFrame, p: str, o: str) -> DataFrame:
    return graph.where((F.col("p") == p) & (F.col("o") == o)).select("s")


def labels(graph: DataFrame, positions: Iterable[str] = SPO) -> DataFrame:
    """Distinct terms (column ``term``) at the given positions; nodes are those at s and o."""
    return graph.select(F.explode(F.array(*positions)).alias("term")).distinct()


def nodes(graph: DataFrame) -> DataFrame:
    return labels(graph, ("s", "o"))


def has_label(term: str) -> Column:
    return any_of(F.col(c) == term for c in SPO)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union as sets; blank nodes of one name are one."""
    return a.select(*SPO).union(b.select(*SPO)).distinct()


def delete(a: DataFrame, b: DataFrame) -> DataFrame:
    # both sides grow with the tables: neither goes through the driver, as small files might have it
    other = b.select(*(F.col(c).alias(f"_{c}") for c in SPO)).hint("merge")
    return a.select(*SPO).distinct().join(other, all_of(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SPO), "left_anti")


def contained(a: DataFrame, b: DataFrame) -> bool:
    """Every triple of a is in b."""
    return a.join(b, SPO, "left_anti").isEmpty()


def equivalent(a: DataFrame, b: DataFrame) -> bool:
    return contained(a, b) and contained(b, a)


def rename(graph: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace terms by ``mapping(term, to)`` at every position; terms without entry stay."""
    for c in SPO:
        m = mapping.select(F.col("term").alias(c), F.col("to"))
        graph = graph.join(m, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return graph.select(*SPO)


def merge(a: DataFrame, b: DataFrame, suffix: str = "m") -> DataFrame:
    """Union in which blanks and variables of b that a has too become new ones."""
    local = lambda g: labels(g).where(T.is_blank("term") | T.is_variable("term"))
    clash = local(b).join(local(a), "term", "left_semi").select("term", F.concat("term", F.lit(suffix)).alias("to"))
    return add(a, rename(b, clash))


def list_items(graph: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, position, item) of the rdf lists that start at ``heads(head)``.

    Cells are linked by pointer jumping: after k rounds each cell knows the one 2**k places on, so a list of n cells
    takes log2(n) joins, whatever n is. A circular list ends where it would meet a cell again.
    """
    # the graph's own plan is run once, and no round's plan holds those before it twice
    links = settle(graph.where(F.col("p").isin(FIRST, REST)))
    cells = links.where(F.col("p") == FIRST).select(F.col("s").alias("cell"), F.col("o").alias("item"))
    jump = settle(links.where((F.col("p") == REST) & (F.col("o") != NIL)).select(F.col("s").alias("cell"), F.col("o").alias("next")).distinct())
    found = settle(heads.select("head", F.col("head").alias("cell"), F.lit(0).cast("long").alias("position")).distinct())
    step, n = 1, found.count()
    while not jump.isEmpty():
        far = found.join(jump.hint("merge"), "cell").select("head", F.col("next").alias("cell"), (F.col("position") + step).alias("position"))
        # each cell at its first position: once a round finds no new cell there is none further on
        found = settle(found.union(far).groupBy("head", "cell").agg(F.min("position").alias("position")))
        before, n = n, found.count()
        if n == before:
            break
        further = jump.select(F.col("cell").alias("next"), F.col("next").alias("far")).hint("merge")
        jump = settle(jump.join(further, "next").select("cell", F.col("far").alias("next")).distinct())
        step *= 2
    return found.join(cells, "cell").select("head", "position", "item")


def make_lists(rows: DataFrame, key: str, items: str, stem: str = "l") -> DataFrame:
    """first/rest chains of the array column ``items``; the cell of position i of list k is ``_:stem-k-i``."""
    cell = lambda i: F.concat(F.lit(f"_:{stem}-"), F.col(key).cast("string"), F.lit("-"), i.cast("string"))
    each = rows.select(key, F.posexplode(items).alias("i", "item"), F.size(items).alias("n"))
    first = each.select(cell(F.col("i")).alias("s"), F.lit(FIRST).alias("p"), F.col("item").alias("o"))
    after = F.when(F.col("i") + 1 < F.col("n"), cell(F.col("i") + 1)).otherwise(NIL)
    return first.union(each.select(cell(F.col("i")).alias("s"), F.lit(REST).alias("p"), after.alias("o")))


def by_subject(graph: DataFrame) -> DataFrame:
    """s, p and the sorted objects: the tree that a writer of grouped statements walks."""
    return graph.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("o"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples of one side only, with ``side`` '<' or '>'."""
    left = delete(a, b).withColumn("side", F.lit("<"))
    return left.union(delete(b, a).withColumn("side", F.lit(">")))
