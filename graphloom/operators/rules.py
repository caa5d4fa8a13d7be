"""Horn rules: forward application, allocation of nodes, the built-in rule sets, closure to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.vocab import ALLOCATED, SUBCLASS, SUBPROPERTY, TYPE, iri
from .graph import SPO, add, delete
from .query import Pattern, backward, construct, construct_blank, match, pattern, variable
from .scratch import drop, settle, tidy

Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rule:
    """Antecedent patterns, consequent patterns, and what happens to the bindings between them."""

    name: str
    antecedent: Pattern
    consequent: Pattern
    change: Change | None = None

    def forward(self, graph: DataFrame) -> DataFrame:
        """The consequents for every match, as a set; the graph's own triples are not among them unless deduced."""
        bindings = match(graph, self.antecedent)
        return construct(self.change(bindings) if self.change else bindings, self.consequent)

    def forward_new(self, known: DataFrame, new: DataFrame) -> DataFrame:
        """The consequents of matches in which some antecedent is among ``new``, which ``known`` holds too."""
        found = None
        for i in range(len(self.antecedent)):
            bindings = match(known, self.antecedent, fresh=(i, new))
            part = construct(self.change(bindings) if self.change else bindings, self.consequent)
            found = part if found is None else found.union(part)
        return self.forward(known) if found is None else found

    def backward(self, goals: Pattern, spark: SparkSession) -> DataFrame:
        """How the consequents unify with each goal triple; see ``query.backward``."""
        return backward(goals, self.consequent, spark)

    def check(self, graph: DataFrame, claimed: DataFrame) -> bool:
        """The claimed triples are among the rule's consequents, up to the names of blank nodes."""
        from .entail import simple_entails

        return simple_entails(self.forward(graph), claimed)

    def check_whole(self, graph: DataFrame, claimed: DataFrame) -> bool:
        """The claimed triples are all of the rule's consequents, up to the names of blank nodes."""
        from .entail import isomorphic

        return isomorphic(self.forward(graph), claimed)

    def support(self, bindings: DataFrame) -> DataFrame:
        """What must hold for bindings of the consequent: antecedents, with new blanks for variables left open."""
        return construct_blank(bindings, self.antecedent, self.name)


def allocate(node: str, *keys: str, rule: str = "alloc") -> Change:
    """Binds ``node`` to a blank node of its own for each distinct value of ``keys``."""
    return lambda b: b.withColumn(node, T.skolem(rule, *keys))


def where(condition) -> Change:
    """Keeps bindings that pass a Column, or what a function without arguments makes of it when the plan is built."""
    return lambda b: b.where(F.coalesce(condition() if callable(condition) else condition, F.lit(False)))


def _resource(v: str):
    return T.is_iri(v) | T.is_blank(v)


def _rule(name: str, antecedent: str, consequent: str, *changes: Change) -> Rule:
    def change(b: DataFrame) -> DataFrame:
        for c in changes:
            b = c(b)
        return b

    return Rule(name, pattern(antecedent), pattern(consequent), change if changes else None)


@dataclass(frozen=True)
class DatatypeRule(Rule):
    """A rule on literals of declared datatypes: these meet by the datatype, which each literal names itself.

    As patterns alone, the declarations and the triples would share no variable and be paired each with each.
    """

    def forward(self, graph: DataFrame) -> DataFrame:
        declared = graph.where((F.col("p") == TYPE) & (F.col("o") == iri("rdfs:Datatype"))).select(F.col("s").alias("d")).distinct()
        kind = F.concat(F.lit("<"), T.datatype("o"), F.lit(">")).alias("d")
        literals = graph.where(T.is_typed("o")).select("s", "p", "o", kind).join(declared, "d")
        if self.name == "r2":
            return literals.select("s", "p", T.canonical("o").alias("o")).where("o is not null").distinct()
        named = literals.where(F.col("p") == ALLOCATED).select(F.col("s").alias("b"), "d")
        used = graph.select(F.col("o").alias("b")).distinct()
        return named.join(used.hint("merge"), "b", "left_semi").select(F.col("b").alias("s"), F.lit(TYPE).alias("p"), F.col("d").alias("o")).distinct()

    def forward_new(self, known: DataFrame, new: DataFrame) -> DataFrame:
        return self.forward(known)


#: The entailment rules of RDF.
RDF_RULES = [
    _rule("lg", "?x ?a ?l", "?x ?a ?b . ?b rdf:_allocatedTo ?l", where(lambda: T.is_literal("l")), allocate("b", "l", rule="rdf:lg")),
    _rule("gl", "?x ?a ?l . ?b rdf:_allocatedTo ?l", "?x ?a ?b"),
    _rule("r1", "?x ?a ?y", "?a rdf:type rdf:Property"),
    _rule("r2", "?x ?a ?b . ?b rdf:_allocatedTo ?l", "?b rdf:type rdf:XMLLiteral", where(lambda: T.is_xml("l"))),
    _rule("cp1", "?x ?c ?y", "?c rdf:type rdf:Property", where(lambda: T.is_member("c"))),
    _rule("cp2", "?c ?p ?y", "?c rdf:type rdf:Property", where(lambda: T.is_member("c"))),
    _rule("cp3", "?x ?p ?c", "?c rdf:type rdf:Property", where(lambda: T.is_member("c"))),
]
#: The entailment rules of RDF Schema.
RDFS_RULES = [
    _rule("r1", "?x ?a ?b . ?b rdf:_allocatedTo ?l", "?b rdf:type rdfs:Literal", where(lambda: T.is_untyped("l"))),
    _rule("r2", "?x ?a ?y . ?a rdfs:domain ?z", "?x rdf:type ?z"),
    _rule("r3", "?u ?a ?v . ?a rdfs:range ?z", "?v rdf:type ?z", where(lambda: _resource("v"))),
    _rule("r4a", "?x ?a ?y", "?x rdf:type rdfs:Resource"),
    _rule("r4b", "?x ?a ?u", "?u rdf:type rdfs:Resource", where(lambda: _resource("u"))),
    _rule("r5", "?a rdfs:subPropertyOf ?b . ?b rdfs:subPropertyOf ?c", "?a rdfs:subPropertyOf ?c"),
    _rule("r6", "?x rdf:type rdf:Property", "?x rdfs:subPropertyOf ?x"),
    _rule("r7", "?x ?a ?y . ?a rdfs:subPropertyOf ?b", "?x ?b ?y"),
    _rule("r8", "?x rdf:type rdfs:Class", "?x rdfs:subClassOf rdfs:Resource"),
    _rule("r9", "?x rdfs:subClassOf ?y . ?a rdf:type ?x", "?a rdf:type ?y"),
    _rule("r10", "?x rdf:type rdfs:Class", "?x rdfs:subClassOf ?x"),
    _rule("r11", "?x rdfs:subClassOf ?y . ?y rdfs:subClassOf ?z", "?x rdfs:subClassOf ?z"),
    _rule("r12", "?x rdf:type rdfs:ContainerMembershipProperty", "?x rdfs:subPropertyOf rdfs:member"),
    _rule("r13", "?x rdf:type rdfs:Datatype", "?x rdfs:subClassOf rdfs:Literal"),
    *(
        _rule(f"cp{i}{j}", a, c, where(lambda: T.is_member("c")))
        for i, c in ((1, "?c rdf:type rdfs:ContainerMembershipProperty"), (2, "?c rdfs:domain rdfs:Resource"), (3, "?c rdfs:range rdfs:Resource"))
        for j, a in ((1, "?x ?c ?y"), (2, "?c ?p ?y"), (3, "?x ?p ?c"))
    ),
]
#: Extensional rules, in no rule set unless asked for.
EXTENSIONAL_RULES = [
    _rule("ext1", "?x rdfs:domain ?y . ?y rdfs:subClassOf ?z", "?x rdfs:domain ?z"),
    _rule("ext2", "?x rdfs:range ?y . ?y rdfs:subClassOf ?z", "?x rdfs:range ?z"),
    _rule("ext3", "?x rdfs:domain ?y . ?z rdfs:subPropertyOf ?x", "?z rdfs:domain ?y"),
    _rule("ext4", "?x rdfs:range ?y . ?z rdfs:subPropertyOf ?x", "?z rdfs:range ?y"),
    _rule("ext5", "rdf:type rdfs:subPropertyOf ?z . ?z rdfs:domain ?y", "rdfs:Resource rdfs:subClassOf ?y"),
    _rule("ext6", "rdfs:subClassOf rdfs:subPropertyOf ?z . ?z rdfs:domain ?y", "rdfs:Class rdfs:subClassOf ?y"),
    _rule("ext7", "rdfs:subPropertyOf rdfs:subPropertyOf ?z . ?z rdfs:domain ?y", "rdfs:Property rdfs:subClassOf ?y"),
    _rule("ext8", "rdfs:subClassOf rdfs:subPropertyOf ?z . ?z rdfs:range ?y", "rdfs:Class rdfs:subClassOf ?y"),
    _rule("ext9", "rdfs:subPropertyOf rdfs:subPropertyOf ?z . ?z rdfs:range ?y", "rdfs:Property rdfs:subClassOf ?y"),
]
#: Datatype rules.
DATATYPE_RULES = [
    DatatypeRule("r1", pattern("?d rdf:type rdfs:Datatype . ?a ?p ?b . ?b rdf:_allocatedTo ?l"), pattern("?b rdf:type ?d")),
    DatatypeRule("r2", pattern("?d rdf:type rdfs:Datatype . ?a ?p ?s"), pattern("?a ?p ?t")),
]
STRING_RULES = [
    _rule("ls", "?a ?p ?s", "?a ?p ?t", lambda b: b.withColumn("t", T.plain_to_typed("s"))),
    _rule("sl", "?a ?p ?s", "?a ?p ?t", lambda b: b.withColumn("t", T.typed_to_plain("s"))),
]


def _axioms(lines: str) -> list[tuple[str, str, str]]:
    return [tuple(iri(t) for t in line.split()) for line in lines.strip().splitlines()]


#: Axiomatic triples.
RDF_AXIOMS = _axioms("\n".join(f"rdf:{x} rdf:type rdf:Property" for x in "type subject predicate object first rest value".split()) + "\nrdf:nil rdf:type rdf:List")
RDFS_AXIOMS = _axioms(
    """
rdf:type rdfs:domain rdfs:Resource
rdf:type rdfs:range rdfs:Class
rdfs:domain rdfs:domain rdf:Property
rdfs:domain rdfs:range rdfs:Class
rdfs:range rdfs:domain rdf:Property
rdfs:range rdfs:range rdfs:Class
rdfs:subPropertyOf rdfs:domain rdf:Property
rdfs:subPropertyOf rdfs:range rdf:Property
rdfs:subClassOf rdfs:domain rdfs:Class
rdfs:subClassOf rdfs:range rdfs:Class
rdf:subject rdfs:domain rdf:Statement
rdf:subject rdfs:range rdfs:Resource
rdf:predicate rdfs:domain rdf:Statement
rdf:predicate rdfs:range rdfs:Resource
rdf:object rdfs:domain rdf:Statement
rdf:object rdfs:range rdfs:Resource
rdfs:member rdfs:domain rdfs:Resource
rdfs:member rdfs:range rdfs:Resource
rdf:first rdfs:domain rdf:List
rdf:first rdfs:range rdfs:Resource
rdf:rest rdfs:domain rdf:List
rdf:rest rdfs:range rdf:List
rdfs:seeAlso rdfs:domain rdfs:Resource
rdfs:seeAlso rdfs:range rdfs:Resource
rdfs:isDefinedBy rdfs:domain rdfs:Resource
rdfs:isDefinedBy rdfs:range rdfs:Resource
rdfs:isDefinedBy rdfs:subPropertyOf rdfs:seeAlso
rdfs:comment rdfs:domain rdfs:Resource
rdfs:comment rdfs:range rdfs:Literal
rdfs:label rdfs:domain rdfs:Resource
rdfs:label rdfs:range rdfs:Literal
rdf:value rdfs:domain rdfs:Resource
rdf:value rdfs:range rdfs:Resource
rdf:Alt rdfs:subClassOf rdfs:Container
rdf:Bag rdfs:subClassOf rdfs:Container
rdf:Seq rdfs:subClassOf rdfs:Container
rdfs:ContainerMembershipProperty rdfs:subClassOf rdf:Property
rdf:XMLLiteral rdf:type rdfs:Datatype
rdf:XMLLiteral rdfs:subClassOf rdfs:Literal
rdfs:Datatype rdfs:subClassOf rdfs:Class
"""
)


@dataclass
class Ruleset:
    namespace: str
    rules: list[Rule]
    axioms: list[tuple[str, str, str]] = field(default_factory=list)

    def rule(self, name: str) -> Rule | None:
        """The first rule of that name."""
        return next((r for r in self.rules if r.name == name), None)


RULESETS = {
    "rdf": Ruleset("rdf", RDF_RULES, RDF_AXIOMS),
    "rdfs": Ruleset("rdfs", RDFS_RULES, RDFS_AXIOMS),
    "rdfd": Ruleset("rdfd", DATATYPE_RULES),
    "xsd_integer": Ruleset("xsd_integer", [], _axioms("xsd:integer rdf:type rdfs:Datatype")),
    "xsd_string": Ruleset("xsd_string", STRING_RULES, _axioms("xsd:string rdf:type rdfs:Datatype")),
    "extensional": Ruleset("extensional", EXTENSIONAL_RULES),
}


def find_rule(name: str, rulesets=RULESETS) -> Rule | None:
    """``set:rule`` in the rule sets, first match."""
    ns, _, local = name.partition(":")
    return rulesets[ns].rule(local) if ns in rulesets else None


@tidy
def transitive(pairs: DataFrame, limit: int = 64) -> DataFrame:
    """Transitive closure of (s, o) by path doubling: log2 of the longest path in rounds; cycles end."""
    known = settle(pairs.select("s", "o").distinct())
    n = known.count()
    for _ in range(limit):
        step = known.select(F.col("s").alias("o"), F.col("o").alias("far"))
        known = settle(known.union(known.join(step, "o").select("s", F.col("far").alias("o"))).distinct())
        now = known.count()
        if now == n:
            break
        n = now
    return known


@tidy
def closure(graph: DataFrame, rules: list[Rule], rounds: int = 50) -> DataFrame:
    """The graph and all that the rules deduce from it, to a fixpoint; rules that allocate nodes may have none.

    After the first round, a rule looks only at matches that hold a triple of the round before.

    Raises RuntimeError where ``rounds`` rounds do not reach it.
    """
    return _to_fixpoint(settle(graph.select(*SPO).distinct()), rules, {}, rounds)


#: Matches of a pattern that are sent to all tasks at most. Fixed value.
FEW = 50_000


def _counted(graph: DataFrame, rules: list[Rule]) -> DataFrame:
    """``graph``, with the patterns of ``rules`` that match few of its triples in its attribute ``few``.

    Left to Spark, which sizes a written table by its files, many repeated terms in small files would be sent to every executor.
    """
    asked = sorted({tuple("?" if variable(x) else x for x in t) for r in rules for t in r.antecedent} - {("?", "?", "?")})
    fits = [reduce(lambda a, b: a & b, (F.col(c) == x for c, x in zip("spo", t) if x != "?")) for t in asked]
    counts = graph.agg(F.count("*"), *(F.count_if(fit) for fit in fits)).first()
    graph.few = {t for t, n in zip([("?", "?", "?"), *asked], counts) if n <= FEW}
    return graph


def _to_fixpoint(known: DataFrame, rules: list[Rule], since: dict[str, DataFrame], rounds: int = 50) -> DataFrame:
    """``closure`` of the written set ``known``; ``since`` has, for rules applied before, what may be new to them."""
    new, since = None, {name: _counted(recent, rules) for name, recent in since.items()}
    for _ in range(rounds):
        found = None
        known = _counted(known, rules)
        if new is not None:
            new = _counted(new, rules)
        for r in rules:
            recent = since.get(r.name) if new is None else new
            part = r.forward(known) if recent is None else r.forward_new(known, recent)
            found = part if found is None else found.union(part)
        before, new = new, settle(delete(found, known))
        if before is not None:
            drop(before)
        if new.isEmpty():
            return known
        last, known = known, settle(known.union(new))
        drop(last)
    raise RuntimeError(f"no fixpoint in {rounds} rounds")


def _deduced(graph: DataFrame, rules: list[Rule]) -> DataFrame:
    graph = _counted(graph, rules)
    return settle(reduce(DataFrame.union, (r.forward(graph) for r in rules)).select(*SPO))


@tidy
def _seeded(graph: DataFrame, first: list[Rule], then: list[Rule]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Each of r2, r3, r5, r7, r9 and r11 once, in the order that leaves fewest rounds to a closure: schema first, then data.

    ``graph`` is a written set. ``first`` are applied once before all of these, ``then`` once before the classes. Also returns, for each
    of the six, what has been added since it was applied: all other matches are in the graph.
    """
    by = {r.name: r for r in RDFS_RULES}
    g = settle(add(graph, _deduced(graph, first))) if first else graph
    sub = transitive(g.where(F.col("p") == SUBPROPERTY))
    g = settle(add(g, sub.select("s", F.lit(SUBPROPERTY).alias("p"), "o")))
    more = [_deduced(g, [by["r7"]])]
    g = settle(add(g, more[-1]))
    more.append(_deduced(g, [by["r2"], by["r3"]]))
    g = settle(add(g, more[-1]))
    if then:
        more.append(_deduced(g, then))
        g = settle(add(g, more[-1]))
    classes = transitive(g.where(F.col("p") == SUBCLASS)).select("s", F.lit(SUBCLASS).alias("p"), "o")
    more += [classes, _deduced(g.union(classes), [by["r9"]])]
    since = lambda i: reduce(DataFrame.union, more[i:])
    known = settle(reduce(DataFrame.union, (g, *more[-2:])).distinct())
    return known, {"r5": since(0), "r7": since(0), "r2": since(1), "r3": since(1), "r11": more[-1], "r9": more[-1]}


@tidy
def rdfs_closure(graph: DataFrame) -> DataFrame:
    """Closure under r2, r3, r5, r7, r9 and r11: schema first, each data rule once, then to the end.

    ``rdfs_all_closure`` has the other rules and the axioms.
    """
    by = {r.name: r for r in RDFS_RULES}
    known, since = _seeded(settle(graph.select(*SPO).distinct()), [], [])
    return _to_fixpoint(known, [by[k] for k in ("r2", "r3", "r5", "r7", "r9", "r11")], since)


@tidy
def rdfs_all_closure(graph: DataFrame) -> DataFrame:
    """The closure under every rule of RDFS and its axioms, with those of RDF that RDFS rests on (r1, its container rules, its axioms).

    Rules that name properties, members and resources are applied once along the way, so that few rounds of all rules are left.
    """
    axioms = graph.sparkSession.createDataFrame(RDF_AXIOMS + RDFS_AXIOMS, "s string, p string, o string")
    rdf = [r for r in RDF_RULES if r.name not in ("lg", "gl", "r2")]
    named = lambda *names: [r for r in RDFS_RULES if r.name in names]
    first = rdf + [r for r in RDFS_RULES if r.name.startswith("cp")] + named("r12")
    known, since = _seeded(settle(add(graph, axioms)), first, named("r1", "r4a", "r4b", "r6", "r8", "r10", "r13"))
    return _to_fixpoint(known, rdf + RDFS_RULES, since)


def types_of(graph: DataFrame) -> DataFrame:
    return graph.where(F.col("p") == TYPE).select("s", "o")
