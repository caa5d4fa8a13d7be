"""Claims with blank nodes against a graph: all parts of a claim at once, by semi-joins from the leaves to a root.

The triples of a claim that hang together by blank nodes are a component, and hold if some binding of these nodes makes them
triples of the graph. A component whose blank nodes form a tree is decided without ever combining the bindings of two of them:
values spread from a root, the node with the most selective triple, one step of the tree in a round, and are then kept from
the leaves upwards where every child has a value that goes with them. Rounds follow the deepest tree, not their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .canon import _parts, certificates, twins
from .graph import SPO
from .query import entails
from .scratch import settle, tidy


@tidy
def components(claimed: DataFrame) -> DataFrame:
    """(component, s, p, o) of the claimed triples with blank nodes; a component is named by the least of its blank nodes."""
    local = [T.is_blank(c) for c in SPO]
    arcs = settle(claimed.select(*SPO).distinct().where(reduce(lambda x, y: x | y, local)))
    nodes = arcs.select(F.explode(F.array(*SPO)).alias("term")).where(T.is_blank("term")).distinct().select(F.lit("").alias("unit"), "term")
    ends = [arcs.where(T.is_blank(x) & T.is_blank(y) & (F.col(x) != F.col(y))).select(F.lit("").alias("unit"), F.col(x).alias("term"), F.col(y).alias("other")) for x in SPO for y in SPO if x != y]
    part = _parts(settle(reduce(DataFrame.union, ends).distinct()), settle(nodes)).select("term", F.col("part").alias("component"))
    one = reduce(lambda x, y: F.coalesce(x, y), (F.when(T.is_blank(c), F.col(c)) for c in SPO))
    return settle(arcs.withColumn("term", one).join(part, "term").select("component", *SPO))


def _checked(rows: DataFrame, value: str, node: str, unary: DataFrame, graph: DataFrame) -> DataFrame:
    """``rows`` whose value, put in for the node, makes each triple that has no other blank node one of the graph."""
    tests = unary.select("component", F.col("node").alias(node), *(F.col(c).alias(f"_t{c}") for c in SPO))
    sizes = tests.groupBy("component", node).agg(F.count("*").alias("_tests"))
    values = rows.select("component", node, value).distinct()
    put = [F.when(F.col(f"_t{c}") == F.col(node), F.col(value)).otherwise(F.col(f"_t{c}")).alias(c) for c in SPO]
    met = values.join(tests, ["component", node]).select("component", node, value, *put).join(graph, SPO, "left_semi")
    met = met.groupBy("component", node, value).agg(F.count("*").alias("_met"))
    done = rows.join(sizes, ["component", node], "left").join(met, ["component", node, value], "left")
    return done.where(F.coalesce("_tests", F.lit(0)) == F.coalesce("_met", F.lit(0))).select(*rows.columns)


@tidy
def _trees(arcs: DataFrame, graph: DataFrame) -> DataFrame:
    """(component) of those ``arcs(component, s, p, o)`` that hold; the blank nodes of each form a tree, and none is a property."""
    two = T.is_blank("s") & T.is_blank("o") & (F.col("s") != F.col("o"))
    node = F.when(T.is_blank("s"), F.col("s")).otherwise(F.col("o"))
    unary = settle(arcs.where(~two).select("component", node.alias("node"), *SPO))
    links = arcs.where(two)
    links = settle(links.select("component", F.col("s").alias("near"), F.col("o").alias("far"), "p", F.lit(True).alias("ahead")).union(links.select("component", "o", "s", "p", F.lit(False))))
    # where a root's values come from: the triple with the fewest matches, or any of its properties
    counts = []
    for end, c in (("s", "o"), ("o", "s")):
        asked = unary.where(T.is_blank(end) & ~T.is_blank(c)).select("component", "node", "p", F.col(c).alias("known"))
        sizes = graph.join(asked.select("p", F.col("known").alias(c)).distinct(), ["p", c], "left_semi").groupBy("p", F.col(c).alias("known")).agg(F.count("*").alias("n"))
        counts.append(asked.join(sizes, ["p", "known"], "left").select("component", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "node", F.lit(end).alias("end"), "p", "known"))
    sizes = graph.groupBy("p").agg(F.count("*").alias("n"))
    loose = unary.where(T.is_blank("s") & T.is_blank("o")).select("component", "node", F.lit("s").alias("end"), "p").union(links.select("component", F.col("near"), F.when(F.col("ahead"), "s").otherwise("o"), "p"))
    counts.append(loose.join(sizes, "p", "left").select("component", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "node", "end", "p", F.lit(None).cast("string").alias("known")))
    root = reduce(DataFrame.union, counts).groupBy("component").agg(F.min(F.struct("n", "node", "end", "p", "known")).alias("r")).select("component", "r.node", "r.end", "r.p", "r.known")
    root = settle(root)
    start = []
    for end, c in (("s", "o"), ("o", "s")):
        own = root.where(F.col("end") == end)
        start.append(own.where("known is not null").select("component", "node", "p", F.col("known").alias(c)).join(graph, ["p", c]).select("component", "node", F.col(end).alias("value")))
        start.append(own.where("known is null").select("component", "node", "p").join(graph, "p").select("component", "node", F.col(end).alias("value")))
    values = settle(_checked(reduce(DataFrame.union, start).distinct(), "value", "node", unary, graph))
    levels = [(values, None)]
    seen = root.select("component", "node")
    current = seen
    while True:
        steps = links.join(current.withColumnRenamed("node", "near"), ["component", "near"]).join(seen.select("component", F.col("node").alias("far")), ["component", "far"], "left_anti")
        steps = settle(steps)
        if steps.isEmpty():
            break
        # one of the properties between two nodes finds the values, and the others test them
        first = steps.groupBy("component", "near", "far").agg(F.min(F.struct("p", "ahead")).alias("f"), F.count("*").alias("_links"))
        first = first.select("component", "near", "far", "f.p", "f.ahead", "_links")
        from_ = values.select("component", F.col("node").alias("near"), F.col("value").alias("from"))
        moves = from_.join(first, ["component", "near"])
        ahead = moves.where("ahead").join(graph.select(F.col("s").alias("from"), "p", F.col("o").alias("to")), ["from", "p"])
        back = moves.where("not ahead").join(graph.select(F.col("o").alias("from"), "p", F.col("s").alias("to")), ["from", "p"])
        pairs = ahead.unionByName(back).select("component", "near", "from", "far", "to", "_links").distinct()
        several = pairs.where("_links > 1").join(steps.select("component", "near", "far", "p", "ahead"), ["component", "near", "far"])
        several = several.select("component", "near", "from", "far", "to", "_links", F.when(F.col("ahead"), F.col("from")).otherwise(F.col("to")).alias("s"), "p", F.when(F.col("ahead"), F.col("to")).otherwise(F.col("from")).alias("o"))
        several = several.join(graph, SPO, "left_semi").groupBy("component", "near", "from", "far", "to", "_links").agg(F.count("*").alias("_met")).where("_met = _links").drop("_met")
        pairs = pairs.where("_links = 1").unionByName(several).drop("_links")
        pairs = settle(_checked(pairs, "to", "far", unary, graph))
        values = pairs.select("component", F.col("far").alias("node"), F.col("to").alias("value")).distinct()
        levels.append((values, pairs))
        current = settle(steps.select("component", F.col("far").alias("node")).distinct())
        children = settle(steps.groupBy("component", F.col("near").alias("node")).agg(F.countDistinct("far").alias("children")))
        levels[-2] = (*levels[-2], children)
        seen = seen.union(current)
    alive = levels[-1][0]
    for (own, _, children), (_, pairs) in zip(reversed(levels[:-1]), (x[:2] for x in reversed(levels[1:]))):
        held = pairs.join(alive.select("component", F.col("node").alias("far"), F.col("value").alias("to")), ["component", "far", "to"], "left_semi")
        held = held.groupBy("component", F.col("near").alias("node"), F.col("from").alias("value")).agg(F.countDistinct("far").alias("held"))
        own = own.join(children, ["component", "node"], "left").join(held, ["component", "node", "value"], "left")
        alive = settle(own.where(F.coalesce("children", F.lit(0)) == F.coalesce("held", F.lit(0))).select("component", "node", "value"))
    return alive.select("component").distinct()


#: A graph is cut down to the properties that claims name, if they are at most so many. Fixed value.
PROPERTIES = 1000


def _of_properties(graph: DataFrame, arcs: DataFrame) -> DataFrame:
    """The triples of ``graph``, perhaps repeated, with the properties of ``arcs``; with more than ``PROPERTIES`` of these, all triples."""
    named = [r.p for r in arcs.select("p").distinct().limit(PROPERTIES + 1).collect()]
    return graph.select(*SPO) if len(named) > PROPERTIES else graph.select(*SPO).where(F.col("p").isin(named))


@tidy
def components_entailed(graph: DataFrame, claimed: DataFrame) -> DataFrame:
    """(component, entailed) of the claimed triples with blank nodes: whether some binding makes all of its triples the graph's.

    Components equal up to the names of blank nodes are decided once. The rare component whose blank nodes go round in a
    circle, or stand for a property, is a query of its own, one job after the other, with a join for each of its triples.
    """
    arcs = components(claimed)
    # components of an outline of their own are decided as they are
    marks = certificates(arcs.join(twins(arcs, ["component"], []).hint("merge"), "component", "left_semi").withColumnRenamed("component", "g"))
    marks = settle(marks.withColumnRenamed("g", "component"))
    chosen = marks.groupBy("certificate").agg(F.min("component").alias("chosen"))
    spare = settle(marks.join(chosen.hint("merge"), "certificate").where("component <> chosen").select("component", "chosen"))
    if not spare.isEmpty():
        arcs = settle(arcs.join(spare.select("component").hint("merge"), "component", "left_anti"))
    nodes = arcs.select("component", F.explode(F.array("s", "o")).alias("node")).where(T.is_blank("node")).groupBy("component").agg(F.countDistinct("node").alias("nodes"))
    pair = F.when(T.is_blank("s") & T.is_blank("o") & (F.col("s") != F.col("o")), F.struct(F.least("s", "o"), F.greatest("s", "o")))
    shape = arcs.groupBy("component").agg(F.countDistinct(pair).alias("pairs"), F.max(T.is_blank("p")).alias("odd")).join(nodes, "component", "left")
    tree = settle(shape.select("component", (~F.col("odd") & (F.col("pairs") == F.col("nodes") - 1)).alias("tree")))
    own = arcs if (others := tree.where("not tree")).isEmpty() else settle(arcs.join(tree.where("tree"), "component", "left_semi"))
    holds = _trees(own, settle(_of_properties(graph, own)))
    rest: dict[str, list[tuple[str, str, str]]] = {}
    for r in arcs.join(others, "component", "left_semi").toLocalIterator():
        rest.setdefault(r.component, []).append((r.s, r.p, r.o))
    if rest:
        graph = settle(graph.select(*SPO).distinct())
    if found := [(c,) for c, triples in rest.items() if entails(graph, triples)]:
        holds = holds.union(graph.sparkSession.createDataFrame(found, "component string"))
    decided = tree.select("component").join(holds.withColumn("entailed", F.lit(True)).hint("merge"), "component", "left").select("component", F.coalesce("entailed", F.lit(False)).alias("entailed"))
    decided = settle(decided)
    return decided.union(spare.join(decided.withColumnRenamed("component", "chosen").hint("merge"), "chosen").select("component", "entailed"))
