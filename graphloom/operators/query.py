"""Graph patterns as joins, binding filters, and construction of triples from bindings.

A pattern is a list of (s, p, o) of terms; a binding is a row with one column per variable, NULL where unbound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.vocab import iri

Pattern = list[tuple[str, str, str]]


def pattern(text: str) -> Pattern:
    """Triples written as ``?x rdf:type ?y . ?y <urn:p> ?z``, without blanks inside terms."""
    return [tuple(iri(t) for t in part.split()) for part in text.split(" . ") if part.strip()]


def variable(term: str) -> bool:
    return term.startswith("?")


def blank(term: str) -> bool:
    return term.startswith("_:")


def column_name(term: str) -> str:
    return term.removeprefix("?") if variable(term) else "b_" + term.removeprefix("_:")


def names(patterns: Pattern, is_open=variable) -> list[str]:
    return list(dict.fromkeys(column_name(t) for triple in patterns for t in triple if is_open(t)))


def branch(graph: DataFrame, triple: tuple[str, str, str], is_open=variable) -> DataFrame:
    """The part of a lifted graph that holds a constant property's triples; the graph itself where it has no parts."""
    branches = getattr(graph, "branches", None)
    if branches is None or is_open(triple[1]):
        return graph
    # a property that it lacks leaves any branch empty
    return branches.get(triple[1], next(iter(branches.values())))


def match_one(graph: DataFrame, triple: tuple[str, str, str], is_open=variable) -> DataFrame:
    """Bindings of one pattern; a variable that stands twice must match equal terms."""
    graph = branch(graph, triple, is_open)
    seen: dict[str, str] = {}
    for c, t in zip("spo", triple):
        if not is_open(t):
            graph = graph.where(F.col(c) == t)
        elif column_name(t) in seen:
            graph = graph.where(F.col(c) == F.col(seen[column_name(t)]))
        else:
            seen[column_name(t)] = c
    return graph.select(*(F.col(c).alias(v) for v, c in seen.items()))


def order_of(patterns: Pattern, is_open=variable) -> list[int]:
    """Most constants first, then always one that shares a variable with those before, if there is one."""
    left, out, bound = list(range(len(patterns))), [], set()
    while left:
        key = lambda i: (not bound or bool(bound & set(names([patterns[i]], is_open))), sum(not is_open(x) for x in patterns[i]))
        best = max(left, key=key)
        left.remove(best)
        out.append(best)
        bound |= set(names([patterns[best]], is_open))
    return out


def ordered(patterns: Pattern, is_open=variable) -> Pattern:
    return [patterns[i] for i in order_of(patterns, is_open)]


def match(graph: DataFrame, patterns: Pattern, is_open=variable, fresh: tuple[int, DataFrame] | None = None) -> DataFrame:
    """All bindings of the patterns together: natural joins on shared variables, a bag of rows.

    A pattern without variables only tests that its triple is there; no patterns give one empty binding.
    Patterns that share no variable are independent, and their bindings are combined each with each.
    ``fresh`` has one pattern, by its number, matched in another graph. Of a graph with ``few``, those patterns (variables
    as ``?``) are sent to all tasks, and nothing else is, whatever the size of its files.
    """
    result, small, counted = None, False, "few" in vars(graph)
    for i in order_of(patterns, is_open):
        t, source = patterns[i], fresh[1] if fresh and fresh[0] == i else graph
        part = match_one(source, t, is_open)
        if not part.columns:
            part = branch(source, t, is_open).where(reduce(lambda a, b: a & b, (F.col(c) == x for c, x in zip("spo", t)))).limit(1).select()
        few = tuple("?" if is_open(x) else x for x in t) in vars(source).get("few", ())
        if result is None:
            result, small = part, few
        else:
            shared = [c for c in part.columns if c in result.columns]
            if counted and part.columns:
                part = F.broadcast(part) if few else part
                result = F.broadcast(result) if small and not few else result if few or not shared else result.hint("merge")
            result = result.join(part, shared) if shared else result.crossJoin(part)
            small = False
    return graph.sparkSession.range(1).select() if result is None else result


def instance_match(graph: DataFrame, patterns: Pattern) -> DataFrame:
    """Bindings of the blank nodes of the patterns."""
    return match(graph, patterns, blank)


def entails(graph: DataFrame, patterns: Pattern) -> bool:
    """Simple entailment: some binding of the blank nodes makes every pattern a triple of the graph."""
    return not patterns or not instance_match(graph, patterns).limit(1).isEmpty()


def instance_entails(graph: DataFrame, patterns: Pattern) -> bool:
    """Instance entailment: some binding of the blank nodes makes the patterns the whole graph, neither more nor less."""
    size = graph.select("s", "p", "o").distinct().count()
    if not patterns:
        return size == 0
    bindings = instance_match(graph, patterns)
    end = lambda t: F.col(column_name(t)) if blank(t) else F.lit(t)
    made = F.array_distinct(F.array(*(F.struct(*(end(t).alias(c) for c, t in zip("spo", x))) for x in patterns)))
    # each made triple is in the graph, so as many as it has are all of it
    return not bindings.where(F.size(made) == size).limit(1).isEmpty()


# Filters of bindings: a variable that is not bound makes a test false.


def test(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, map(test, conditions), F.lit(False))


def both(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, map(test, conditions), F.lit(True))


def same(a: str, b: str) -> Column:
    return test(F.col(a) == F.col(b))


def different(a: str, b: str) -> Column:
    return test(F.col(a) != F.col(b))


#: name -> test of one variable
FILTERS = {
    "iri": T.is_iri,
    "blank": T.is_blank,
    "literal": T.is_literal,
    "untyped": T.is_untyped,
    "typed": T.is_typed,
    "xml": T.is_xml,
    "member": T.is_member,
}


def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Bindings joined row by row on ``on``; where both bind a variable the left wins."""
    shared = [c for c in b.columns if c in a.columns and c not in on]
    right = b.select(*on, *(F.col(c).alias(f"_{c}") for c in shared), *(c for c in b.columns if c not in a.columns))
    out = a.join(right, on)
    for c in shared:
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out


def sub_binding(a: DataFrame, variables: list[str]) -> DataFrame:
    """Bindings cut down to some variables, as a set."""
    return a.select(*(v for v in variables if v in a.columns)).distinct()


def make_bindings(spark, rows: list[dict[str, str]]) -> DataFrame:
    """Bindings from plain ones: one row each, NULL where a variable is not bound."""
    columns = list(dict.fromkeys(v for r in rows for v in r))
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))


# Construction


def fill(term: str, columns: list[str]) -> Column:
    if not variable(term):
        return F.lit(term)
    return F.col(column_name(term)) if column_name(term) in columns else F.lit(None).cast("string")


def construct(bindings: DataFrame, template: Pattern) -> DataFrame:
    """Triples of the template for each binding that binds all of its variables, as a set."""
    needed = names(template)
    for v in needed:
        if v not in bindings.columns:
            return bindings.sparkSession.createDataFrame([], "s string, p string, o string")
    triples = F.array(*(F.struct(*(fill(t, bindings.columns).alias(c) for c, t in zip("spo", x))) for x in template))
    return bindings.where(reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in needed), F.lit(True))).select(F.inline(triples)).distinct()


def unbound(bindings: DataFrame, template: Pattern) -> list[str]:
    """Variables of the template that no binding can bind."""
    return [v for v in names(template) if v not in bindings.columns]


def construct_blank(bindings: DataFrame, template: Pattern, rule: str = "new") -> DataFrame:
    """As ``construct``, but unbound variables become blank nodes, new for each distinct binding."""
    own = sorted(bindings.columns)
    for v in names(template):
        node = T.skolem(f"{rule}|{v}", *(F.coalesce(c, F.lit("")) for c in own))
        bindings = bindings.withColumn(v, F.coalesce(F.col(v), node) if v in own else node)
    return construct(bindings, template)


def backward(goals: Pattern, heads: Pattern, spark) -> DataFrame:
    """(goal, head, variable, term): how each head unifies with each goal triple; a row without variable where nothing is bound.

    Alternatives of a rule are the products over goals; this table is their factorised form.
    """
    rows = []
    for i, g in enumerate(goals):
        for j, h in enumerate(heads):
            bound: dict[str, str] = {}
            if all((bound.setdefault(b, a) == a) if variable(b) else a == b for a, b in zip(g, h)):
                rows += [(i, j, column_name(v), t) for v, t in bound.items()] or [(i, j, None, None)]
    return spark.createDataFrame(rows, "goal int, head int, variable string, term string")


def keep_alternatives(bindings: DataFrame, condition: Column, key: str = "alternative") -> DataFrame:
    """Rows of alternatives all of whose rows pass."""
    ok = bindings.groupBy(key).agg(F.bool_and(test(condition)).alias("ok")).where("ok").select(key)
    return bindings.join(ok, key, "left_semi")
