"""Entailment, isomorphism, proofs, partitions and class restrictions."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.vocab import RDF, TYPE
from .graph import SPO, add, contained, delete, equivalent, rename
from .modifiers import Modifier
from .orders import maxima  # noqa: F401  part of this module's interface
from .rules import Rule, Ruleset
from .scratch import drop, settle, settle_in_slices, slices_of, tidy


def rows_of(graph: DataFrame, most: int) -> list[tuple[str, str, str]]:
    """The triples of a graph of at most ``most``; larger ones are refused, as the work on them is exponential."""
    rows = [tuple(r) for r in graph.select(*SPO).distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} triples")
    return rows


def simple_entails(graph: DataFrame, claimed: DataFrame) -> bool:
    """The claimed graph's blank nodes can be bound so that all its triples are in ``graph``.

    Triples without blank nodes are looked up; the others are decided by ``claims.components_entailed``, all components
    that hang together by blank nodes at once.
    """
    from .claims import components_entailed

    claimed = claimed.select(*SPO).distinct()
    local = reduce(lambda x, y: x | y, (T.is_blank(c) for c in SPO))
    if not contained(claimed.where(~local), graph):
        return False
    return claimed.where(local).isEmpty() or components_entailed(graph, claimed).where("not entailed").isEmpty()


def subgraph_entails(graph: DataFrame, claimed: DataFrame) -> bool:
    """Every claimed triple is in ``graph``, blank nodes by name."""
    return contained(claimed, graph)


def subgraphs(graph: DataFrame, most: int = 12):
    """All non-empty proper subsets of a graph of at most ``most`` triples, small ones first."""
    rows = rows_of(graph, most)
    return [list(c) for n in range(1, len(rows)) for c in itertools.combinations(rows, n)]


# Isomorphism


def _local(c: str) -> Column:
    return T.is_blank(c) | T.is_variable(c)


def colours(graph: DataFrame, rounds: int) -> DataFrame:
    """(term, colour): constants keep their own colour, blank nodes get one from their triples, refined ``rounds`` times.

    A round is a join per end and one sum with map-side combining; node degrees never meet in a task.
    """
    blank = lambda c: T.is_blank(c) | T.is_variable(c)
    terms = graph.select(F.explode(F.array(*SPO)).alias("term")).distinct()
    found = terms.select("term", F.when(blank("term"), F.lit(1).cast("long")).otherwise(F.xxhash64("term")).alias("colour"))
    for _ in range(rounds):
        known = graph
        for c in SPO:
            known = known.join(found.select(F.col("term").alias(c), F.col("colour").alias(f"c{c}")), c)
        sides = [known.select(F.col(c).alias("term"), F.xxhash64(F.lit(c), "cs", "cp", "co").alias("h")) for c in SPO]
        sums = reduce(DataFrame.union, sides).groupBy("term").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
        # each round reads the last three times: without a cut the plan would grow as 3**rounds
        found = settle(found.join(sums, "term").select("term", F.when(blank("term"), F.xxhash64("colour", "h")).otherwise(F.col("colour")).alias("colour")))
    return found


def _recolour(graph: DataFrame, found: DataFrame) -> DataFrame:
    """One more round for ``found(side, term, colour)``, the blank nodes and variables of ``graph(side, s, p, o)``."""
    known = graph
    for c in SPO:
        known = known.join(found.select("side", F.col("term").alias(c), F.col("colour").alias(f"c{c}")), ["side", c], "left")
        known = known.withColumn(f"c{c}", F.coalesce(f"c{c}", F.xxhash64(c)))
    none = F.lit(None).cast("long")
    ends = [known.where(_local(c)).select("side", F.col(c).alias("term"), none.alias("colour"), F.xxhash64(F.lit(c), "cs", "cp", "co").alias("h")) for c in SPO]
    sums = reduce(DataFrame.union, ends, found.select("side", "term", "colour", none.alias("h"))).groupBy("side", "term")
    sums = sums.agg(F.max("colour").alias("colour"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
    return settle(sums.select("side", "term", F.xxhash64("colour", "h").alias("colour")))


def _stable(graph: DataFrame, found: DataFrame) -> tuple[DataFrame, bool, bool]:
    """Colours refined until no class splits, whether each has as many nodes on both sides, and whether any has several."""
    before = 0
    while True:
        sizes = found.groupBy("colour").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
        r = sizes.agg(F.count("*").alias("n"), F.bool_and(F.col("a") == F.col("b")).alias("even"), F.bool_or(F.col("a") > 1).alias("tied")).first()
        if not r.even or not r.tied or r.n == before:
            return found, bool(r.even), bool(r.tied)
        before, found = r.n, _recolour(graph, found)


def _tied(found: DataFrame) -> DataFrame:
    return found.join(found.groupBy("side", "colour").agg(F.count("*").alias("n")).where("n > 1"), ["side", "colour"])


def _recoloured(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """``found`` with the colours of ``chosen(side, term, to)``."""
    return found.join(chosen, ["side", "term"], "left").select("side", "term", F.coalesce("to", "colour").alias("colour"))


def _split(graph: DataFrame, found: DataFrame) -> DataFrame:
    """A new colour for one node of every component of tied nodes; components alike in colours are paired off in order."""
    tied = settle(_tied(found).select("side", "term", "colour"))
    ends = [graph.where(_local(x) & _local(y)).select("side", F.col(x).alias("term"), F.col(y).alias("other")) for x, y in itertools.permutations(SPO, 2)]
    links = reduce(DataFrame.union, ends).where("term <> other").join(tied.select("side", "term"), ["side", "term"], "left_semi")
    links = settle(links.join(tied.select("side", F.col("term").alias("other")), ["side", "other"], "left_semi").distinct())
    part = tied.select("side", "term", F.col("term").alias("part"))
    while True:
        near = links.join(part.select("side", F.col("term").alias("other"), "part"), ["side", "other"]).groupBy("side", "term").agg(F.min("part").alias("near"))
        least = part.join(near, ["side", "term"], "left").select("side", "term", F.least("part", "near").alias("to"), F.col("part").alias("was"))
        jump = part.select("side", F.col("term").alias("to"), "part")
        now = settle(least.join(jump, ["side", "to"]).select("side", "term", "part", "was"))
        part = now.select("side", "term", "part")
        if now.where("part <> was").isEmpty():
            break
    parts = tied.join(part, ["side", "term"]).groupBy("side", "part")
    parts = parts.agg(F.sum(F.xxhash64("colour").cast("decimal(38,0)")).alias("kind"), F.min(F.struct("colour", "term")).alias("first"))
    order = F.row_number().over(Window.partitionBy("side", "kind").orderBy("part"))
    return _recoloured(found, parts.select("side", F.col("first.term").alias("term"), F.xxhash64("first.colour", "kind", order).alias("to")))


def _same(graph: DataFrame, found: DataFrame) -> bool:
    """With one node of each colour a side, these are all the same triples."""
    one = found.where("side = 0").select("term", "colour").join(found.where("side = 1").select(F.col("term").alias("to"), "colour"), "colour")
    return equivalent(rename(graph.where("side = 0"), one.select("term", "to")), graph.where("side = 1").select(*SPO))


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Equal up to the names of blank nodes and variables, for graphs of any size.

    Ground triples are compared as sets. The other nodes of both graphs are coloured together until no class splits;
    nodes alone in their colour are mapped by it and the mapped triples compared. Of tied nodes, one of each component
    is singled out at once on both sides, as often as it takes. Where that pairing does not lead to a mapping, all
    partners of one node of the smallest class are tried in turn, depth first. All of it is done on Spark.
    """
    local = reduce(lambda x, y: x | y, map(_local, SPO))
    if not equivalent(a.where(~local), b.where(~local)):
        return False
    both = [g.where(local).select(F.lit(i).alias("side"), *SPO).distinct() for i, g in enumerate((a, b))]
    graph = settle(both[0].union(both[1]))
    sizes = {r.side: r.n for r in graph.groupBy("side").agg(F.count("*").alias("n")).collect()}
    if not sizes or sizes.get(0) != sizes.get(1):
        return not sizes
    nodes = graph.select("side", F.explode(F.array(*SPO)).alias("term")).where(_local("term")).distinct()
    root = found, even, tied = _stable(graph, settle(nodes.withColumn("colour", F.lit(1).cast("long"))))
    while even and tied:
        found, even, tied = _stable(graph, settle(_split(graph, found)))
    if even and _same(graph, found):
        return True
    if not root[1] or not root[2]:
        return False
    todo = [root[0]]
    while todo:
        found, even, tied = _stable(graph, settle(todo.pop()))
        if not even or not tied and not _same(graph, found):
            continue
        if not tied:
            return True
        members = _tied(found)
        colour = members.orderBy("n", "colour").first().colour
        members = members.where(F.col("colour") == colour)
        first = members.where("side = 0").agg(F.min("term")).first()[0]
        for r in members.where("side = 1").select("term").orderBy(F.desc("term")).toLocalIterator():
            chosen = (F.col("side") == 0) & (F.col("term") == first) | (F.col("side") == 1) & (F.col("term") == r.term)
            todo.append(found.withColumn("colour", F.when(chosen, F.xxhash64("colour")).otherwise(F.col("colour"))))
    return False


# Proofs


@dataclass
class Step:
    rule: str
    antecedents: list[str]
    consequent: str


@dataclass
class Proof:
    """Named graphs, the rule sets in use, what is given, the steps and the goal."""

    graphs: dict[str, DataFrame]
    context: list[Ruleset]
    given: list[str]
    steps: list[Step]
    goal: str
    extra: list[Rule] = field(default_factory=list)
    #: a step's consequent is all that its rule deduces, or what it would need is an antecedent; else it may be a part
    exact: bool = False

    def axioms_used(self) -> list[tuple[str, str, str]]:
        """The axioms of the rule sets that are in what the steps cite; as many as there are axioms at most."""
        axioms = list(dict.fromkeys(t for rs in self.context for t in rs.axioms))
        cited = list(dict.fromkeys(a for s in self.steps for a in s.antecedents))
        if not axioms or not cited:
            return []
        graphs = reduce(add, (self.graphs[a] for a in cited))
        known = graphs.sparkSession.createDataFrame(axioms, "s string, p string, o string")
        found = {tuple(r) for r in known.join(graphs, SPO, "left_semi").select(*SPO).collect()}
        return [t for t in axioms if t in found]

    def show(self) -> str:
        """The proof as text: what is given, each step with its rule and what it rests on, and the goal."""
        lines = [f"Given: {', '.join(self.given)}", f"Axioms: {len(self.axioms_used())}"]
        lines += [f"Step {i}: {s.consequent} by {s.rule} from {', '.join(s.antecedents)}" for i, s in enumerate(self.steps, 1)]
        return "\n".join([*lines, f"Goal: {self.goal}"])

    def _backward(self, rule: Rule, step: Step) -> bool:
        from .chaining import check_backward

        return check_backward(rule, [self.graphs[a] for a in step.antecedents], self.graphs[step.consequent])

    def explain(self) -> str | None:
        """None for a valid proof, or what is wrong with its first bad step."""
        known = list(self.given)
        for s in self.steps:
            rule = next((r for rs in self.context for r in rs.rules if r.name == s.rule), None) or next((r for r in self.extra if r.name == s.rule), None)
            if rule is None:
                return f"Invalid step: rule {s.rule} not present"
            if any(a not in known for a in s.antecedents):
                return "Invalid step: antecedent not axiom or previous result"
            graph = reduce(add, (self.graphs[a] for a in s.antecedents))
            axioms = [t for rs in self.context for t in rs.axioms]
            if axioms:
                graph = add(graph, graph.sparkSession.createDataFrame(axioms, "s string, p string, o string"))
            consequent = self.graphs[s.consequent]
            if not (rule.check_whole(graph, consequent) or self._backward(rule, s) if self.exact else rule.check(graph, consequent)):
                return "Invalid step: rule does not deduce consequence from antecedents"
            known.append(s.consequent)
        # the empty graph is true without proof
        return None if self.graphs[self.goal].isEmpty() or any(k == self.goal or isomorphic(self.graphs[k], self.graphs[self.goal]) for k in known) else "Result not demonstrated"


# Partitions


def references(graph: DataFrame) -> DataFrame:
    """(term, n): how often each subject is another triple's object."""
    subjects = graph.select(F.col("s").alias("term")).distinct()
    counts = graph.groupBy(F.col("o").alias("term")).agg(F.count("*").alias("n"))
    return subjects.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def top_level(graph: DataFrame) -> DataFrame:
    """Subjects that start a statement of their own: all but blank nodes that are referred to just once.

    Of blank nodes that refer to each other in a circle, and so would all be inside another, the least starts one.
    """
    counted = references(graph)
    inner = T.is_blank("term") & (F.col("n") == 1)
    once = counted.where(inner).select("term")
    up = graph.select(F.col("o").alias("term"), F.col("s").alias("up")).join(once, "term", "left_semi")
    return counted.where(~inner).select("term").union(_least_of_circles(up))


@tidy
def inner_nodes(links: DataFrame, subjects: DataFrame, slices: int = 1, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """(term, up, p): the blank nodes that are nested in the triple ``up p term``, as ``top_level`` decides.

    ``links(s, p, o)`` are the triples with a blank object, ``subjects(s)`` the blank subjects, both perhaps repeated; triples of
    other objects decide nothing, and are neither counted nor moved. ``slices`` of more than one read both as often.
    ``spent`` are written tables that are dropped once both are read.
    """
    # one grouping tells whether a node has one place, and whether it is a subject
    ends = links.select(F.col("o").alias("term"), F.struct("s", "p").alias("at"), F.lit(False).alias("subject"))
    ends = ends.union(subjects.select("s", F.lit(None).cast(ends.schema["at"].dataType), F.lit(True)))
    once = lambda part: part(ends, "term").groupBy("term").agg(F.min("at").alias("at"), F.max("at").alias("other"), F.max("subject").alias("subject")).where("subject and at = other")
    inner = settle_in_slices(slices, lambda part: once(part).select("term", F.col("at.s").alias("up"), F.col("at.p").alias("p")))
    drop(*spent)
    least = _least_of_circles(inner)
    return inner if least.isEmpty() else settle(inner.join(least.hint("merge"), "term", "left_anti"))


@tidy
def _least_of_circles(up: DataFrame) -> DataFrame:
    """(term): the least node of each circle of ``up(term, up)``, in which each node has one place that refers to it."""
    # ancestors by pointer jumping, with the least of those passed
    above = up.select(F.col("term").alias("up"))
    jump = settle_in_slices(slices_of(up), lambda part: part(up, "up").join(part(above, "up").hint("merge"), "up", "left_semi").select("term", "up", F.col("up").alias("low")))
    step, n = 1, jump.count()
    while n and step < 2 * n:
        far = jump.select(F.col("term").alias("up"), F.col("up").alias("far"), F.col("low").alias("far_low"))
        last, jump = jump, settle(jump.join(far.hint("merge"), "up").select("term", F.col("far").alias("up"), F.least("low", "far_low").alias("low")))
        drop(last)
        step, n = 2 * step, jump.count()
    # in a circle, a node is its own ancestor
    return jump.where("term = low").select("term")


def nested(graph: DataFrame) -> DataFrame:
    """(s, p, o, inside): each triple with whether its object is a statement nested in it, as ``top_level`` decides."""
    links = graph.where(T.is_blank("o"))
    inner = inner_nodes(links, graph.where(T.is_blank("s")).select("s").distinct()).select(F.col("term").alias("o"), F.lit(True).alias("nested"))
    rows = links.join(inner.hint("merge"), "o", "left").select("s", "p", "o", F.col("nested").isNotNull().alias("inside"))
    return rows.union(graph.where(~T.is_blank("o")).select("s", "p", "o", F.lit(False)))


def collect_runs(rows: DataFrame, key: str, value: str, least: int = 1) -> DataFrame:
    """(key, values): each key's distinct values sorted, of keys with ``least`` of them at least."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values")).where(F.size("values") >= least)


# Class restrictions

#: The property of the triple that states an inconsistency.
FALSE = "<urn:false>"


def restrict(graph: DataFrame, of_class: str, relation: Modifier, properties: list[str] | None = None) -> DataFrame:
    """What a relation between the property values of a class's instances lets deduce, as new triples.

    An instance's values of ``properties`` (rdf:_1, rdf:_2, ... by default, result first) are completed by the usage
    of ``relation`` that fits what is there. If any full tuple breaks the relation, the graph is inconsistent and the
    result is the one triple that is false. Instances with too few values give nothing.
    """
    properties = properties or [f"<{RDF}_{i + 1}>" for i in range(relation.size)]
    names = [f"v{i}" for i in range(relation.size)]
    rows = graph.where((F.col("p") == TYPE) & (F.col("o") == of_class)).select("s").distinct()
    # values are as many as instances: left to Spark, which sizes them by their files, each would be sent whole to the driver
    for v, p in zip(names, properties):
        rows = rows.join(graph.where(F.col("p") == p).select("s", F.col("o").alias(v)).hint("merge"), "s", "left")
    rows = settle(rows)
    full = reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in names))
    broken = rows.where(full & ~relation.holds(*names)).limit(1)
    found = None
    for usage in relation.usages:
        missing = [names[i] for i in usage.binds]
        here = [v for v in names if v not in missing]
        fits = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in here] + [F.col(v).isNull() for v in missing])
        done = relation.apply(rows.where(fits).drop(*missing), *names)
        for v, p in zip(names, properties):
            if v in missing:
                part = done.select("s", F.lit(p).alias("p"), F.col(v).alias("o"))
                found = part if found is None else found.union(part)
    false = broken.select(F.lit("_:a").alias("s"), F.lit(FALSE).alias("p"), F.lit("_:b").alias("o"))
    if found is None:
        return false
    # one row at most: whether anything is broken
    bad = F.broadcast(false.select(F.lit(True).alias("bad")))
    return delete(found, graph).join(bad, F.lit(True), "left_anti").union(false)
