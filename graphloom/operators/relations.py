"""Datatype relations over partly known tuples, and the class restrictions that rest on them.

A relation computes unknown members of a tuple from known ones in every direction it can, and tells tuples that
contradict it. A class restriction applies one to property values of a class's instances.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.vocab import FIRST, NIL, RDF, RDFD, REST, TYPE, XSD, XSD_INTEGER_NS, XSD_STRING_NS
from .columns import computed
from .graph import delete, list_items
from .modifiers import NUMBER, absolute, div_floor, exact_quotient, mod_floor, negative, power, text_value
from .orders import most_complete
from .scratch import settle

#: The property of the triple that states an inconsistency.
FALSE = f"<{RDFD}false>"

Function = tuple[Callable[..., Column], tuple[int, ...]]


@dataclass(frozen=True)
class Relation:
    """``functions`` holds, for each member, what computes it and from which members; ``valid`` tests single members."""

    name: str
    size: int
    functions: tuple[tuple[Function, ...], ...]
    test: Callable[..., Column] | None = None
    valid: tuple[Callable[[Column], Column] | None, ...] = ()
    kind: str = NUMBER
    #: of all members, null where unknown: whether those known rule out any full tuple
    broken: Callable[..., Column] | None = None
    values: Callable[[str], Column] = T.as_integer
    back: Callable[[Column], Column] = T.integer

    def complete(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` with consistent boolean and tuples (arrays of terms): all full tuples that the known members lead to.

        A member that is NULL is unknown. No tuples, where consistent, means that too little is known; several are
        alternatives. A term that has no value of the relation's datatype makes its row inconsistent.
        """
        known = [F.col(c).isNotNull() for c in columns]
        # values in columns of their own: written into every expression below, they would be computed each time
        given, own = rows.columns, [f"_value{i}" for i in range(self.size)]
        rows = computed(rows, {v: self.values(c).cast(self.kind) for v, c in zip(own, columns)})
        value = [F.col(v) for v in own]
        none = F.array().cast(f"array<{self.kind}>")
        bad = reduce(lambda a, b: a | b, (k & v.isNull() for k, v in zip(known, value)))
        found = []
        for i in range(self.size):
            parts = []
            for f, needs in self.functions[i] if i < len(self.functions) else ():
                present = reduce(lambda a, b: a & b, (value[n].isNotNull() for n in needs))
                parts.append(F.when(present, F.array(f(*(value[n] for n in needs)).cast(self.kind))).otherwise(none))
            found.append(F.filter(F.concat(*parts), lambda x: x.isNotNull()) if parts else none)
        rows = computed(rows, {f"_found{i}": x for i, x in enumerate(found)})
        tuples = F.array(none)
        for i in range(self.size):
            found = F.col(f"_found{i}")
            valid = self.valid[i] if i < len(self.valid) and self.valid[i] else None
            if valid is not None:
                bad = bad | F.exists(found, _not(valid)) | (value[i].isNotNull() & ~valid(value[i]))
            bad = bad | (value[i].isNotNull() & (F.size(found) > 0) & ~F.array_contains(found, value[i]))
            choices = F.when(value[i].isNotNull(), F.array(value[i])).otherwise(F.array_distinct(found))
            tuples = _product(tuples, choices)
        if self.broken is not None:
            bad = bad | F.coalesce(self.broken(*value), F.lit(False))
        if self.test is not None:
            bad = bad | F.exists(tuples, lambda t: ~self.test(*(F.get(t, F.lit(i)) for i in range(self.size))))
        # likewise: a filter on one would have all of this done twice
        done = computed(rows, {"_bad": F.coalesce(bad, F.lit(True)), "_tuples": tuples}).select(*given, (~F.col("_bad")).alias("consistent"), "_tuples")
        terms = F.transform("_tuples", lambda t: F.transform(t, lambda v: self.back(v)))
        return done.select(*given, "consistent", F.when(F.col("consistent"), terms).alias("tuples"))


def _not(valid: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: ~valid(x)


def _product(tuples: Column, choices: Column) -> Column:
    """Each tuple with each choice at its end."""
    return F.flatten(F.transform(tuples, lambda t: F.transform(choices, lambda v: F.concat(t, F.array(v)))))


def _two(test) -> Callable[..., Column]:
    return lambda a, b: test(a, b)


def _integer(name: str, size: int, *functions: tuple[Function, ...], test=None, valid=(), broken=None) -> Relation:
    return Relation(name, size, functions, test, valid, broken=broken)


def _no_factor(a: Column, b: Column, c: Column) -> Column:
    """a = b * c can't hold, as one factor is known and does not divide a."""
    fails = lambda x: F.when(x == 0, a != 0).otherwise(mod_floor(a, x) != 0)
    return (b.isNotNull() & fails(b)) | (c.isNotNull() & fails(c))


def _not_negative(x: Column) -> Column:
    return x >= 0


#: The relations of whole numbers, in which ``sum a b c`` is a = b + c. A product's factors are exact; quotients of divmod are rounded down.
INTEGER_RELATIONS = {
    r.name: r
    for r in (
        _integer("abs", 2, ((absolute, (1,)),), ((lambda a: a, (0,)), (negative, (0,))), valid=(_not_negative,)),
        _integer("neg", 2, ((negative, (1,)),), ((negative, (0,)),)),
        _integer("sum", 3, ((F.try_add, (1, 2)),), ((F.try_subtract, (0, 2)),), ((F.try_subtract, (0, 1)),)),
        _integer("diff", 3, ((F.try_subtract, (1, 2)),), ((F.try_add, (0, 2)),), ((F.try_subtract, (1, 0)),)),
        _integer("prod", 3, ((F.try_multiply, (1, 2)),), ((exact_quotient, (0, 2)),), ((exact_quotient, (0, 1)),), broken=_no_factor),
        _integer("divmod", 4, ((div_floor, (2, 3)),), ((mod_floor, (2, 3)),), (), ()),
        _integer("power", 3, ((power, (1, 2)),), (), (), valid=(None, None, _not_negative)),
        *(Relation(name, 2, (), _two(test)) for name, test in (("eq", lambda a, b: a == b), ("ne", lambda a, b: a != b), ("lt", lambda a, b: a < b), ("le", lambda a, b: a <= b), ("gt", lambda a, b: a > b), ("ge", lambda a, b: a >= b))),
    )
}
STRING_RELATIONS = {name: Relation(name, 2, (), _two(test), (), "string", None, text_value, T.string) for name, test in (("eq", lambda a, b: a == b), ("ne", lambda a, b: a != b))}


def relation_of(name: str) -> Relation | None:
    """The relation that an IRI term names, None if there is none."""
    for prefix, found in ((XSD_INTEGER_NS, INTEGER_RELATIONS), (XSD_STRING_NS, STRING_RELATIONS)):
        if name.startswith(f"<{prefix}"):
            return found.get(name[len(prefix) + 1 : -1])
    return None


# Class restrictions


@dataclass(frozen=True)
class Restriction:
    """Instances of ``of_class`` hold ``relation`` between the values of ``properties``, for ``most`` tuples at most."""

    of_class: str
    properties: tuple[str, ...]
    relation: Relation
    most: int | None = None


def built_in_classes() -> list[Restriction]:
    """A class for each relation: its members are rdf:_1 and so on, one tuple an instance."""
    names = {"divmod": "DivMod"}
    members = lambda r: tuple(f"<{RDF}_{i + 1}>" for i in range(r.size))
    return [Restriction(f"<{prefix}{names.get(r.name, r.name.title())}>", members(r), r, 1) for prefix, relations in ((XSD_INTEGER_NS, INTEGER_RELATIONS), (XSD_STRING_NS, STRING_RELATIONS)) for r in relations.values()]


def built_in_restrictions() -> list[tuple[str, str, str]]:
    """The triples that define the built-in classes."""
    out: list[tuple[str, str, str]] = []
    for k in built_in_classes():
        prefix = XSD_STRING_NS if k.of_class.startswith(f"<{XSD_STRING_NS}") else XSD_INTEGER_NS
        c, cells = k.of_class, [f"_:{prefix.rsplit('/', 1)[-1].strip('#')}-{k.relation.name}-{i}" for i in range(k.relation.size)]
        out += [(c, TYPE, f"<{RDFD}GeneralRestriction>"), (c, f"<{RDFD}onProperties>", cells[0]), (c, f"<{RDFD}constraint>", f"<{prefix}{k.relation.name}>"), (c, f"<{RDFD}maxCardinality>", f'"{k.most}"^^<{XSD}nonNegativeInteger>')]
        for i, cell in enumerate(cells):
            out += [(cell, FIRST, k.properties[i]), (cell, REST, cells[i + 1] if i + 1 < len(cells) else NIL)]
    return out


def find_restrictions(graph: DataFrame) -> DataFrame:
    """(class, constraint, properties array, most) of the restrictions that a graph defines; limits below 1 are none."""
    of = lambda name, c: graph.where(F.col("p") == f"<{RDFD}{name}>").select(F.col("s").alias("class"), F.col("o").alias(c)).distinct()
    classes = graph.where((F.col("p") == TYPE) & (F.col("o") == f"<{RDFD}GeneralRestriction>")).select(F.col("s").alias("class")).distinct()
    found = classes.join(of("onProperties", "head"), "class").join(of("constraint", "constraint"), "class")
    items = list_items(graph, found.select("head").distinct())
    lists = items.groupBy("head").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "item"))), lambda x: x["item"]).alias("properties"))
    number = F.regexp_extract("limit", r'\A"([0-9]+)"', 1).try_cast("int")
    limits = of("maxCardinality", "limit").select("class", number.alias("n")).where("n > 0").groupBy("class").agg(F.min("n").alias("most"))
    return found.join(lists, "head").join(limits, "class", "left").select("class", "constraint", "properties", "most")


def restrictions_of(graph: DataFrame) -> list[Restriction]:
    """The restrictions of a schema graph whose constraint is a known relation; a schema has few, so they come to the driver."""
    rows = find_restrictions(graph).collect()
    return [Restriction(r["class"], tuple(r.properties), relation, r.most) for r in rows if (relation := relation_of(r.constraint)) is not None]


def _combinations(graph: DataFrame, restriction: Restriction) -> tuple[DataFrame, DataFrame, list[str]]:
    """(values, combinations, columns): each instance's values of each property, and every choice of them, any left open."""
    columns = [f"v{i}" for i in range(len(restriction.properties))]
    # both are read for every property, and the graph's own plan may be long
    rows = settle(graph.where((F.col("p") == TYPE) & (F.col("o") == restriction.of_class)).select("s").distinct())
    places = F.array_compact(F.array(*(F.when(F.col("p") == p, F.lit(i)) for i, p in enumerate(restriction.properties))))
    given = graph.where(F.col("p").isin(*restriction.properties)).select("s", "o", F.explode(places).alias("i")).distinct()
    given = given.join(rows.hint("merge"), "s", "left_semi")
    values = settle(given.select("s", "i", F.coalesce(T.canonical("o"), F.col("o")).alias("v")).distinct())
    combined = rows
    for i, c in enumerate(columns):
        # each instance's values and one that is open, so that combinations are rows of joins
        choices = values.where(F.col("i") == i).select("s", F.col("v").alias(c)).union(rows.select("s", F.lit(None).cast("string")))
        combined = combined.join(choices.hint("merge"), "s")
    return values, combined, columns


def _where_one(done: DataFrame, columns: list[str]) -> DataFrame:
    """Each combination's one full tuple, where just one follows, else the combination."""
    one = F.size("tuples") == 1
    return done.select("s", *(F.when(one, F.get(F.get("tuples", F.lit(0)), F.lit(i))).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)))


def candidates(graph: DataFrame, restriction: Restriction) -> tuple[DataFrame, DataFrame, list[str]]:
    """(values, tuples, columns): each instance's values of each property, and what every combination of them leads to.

    A combination leaves any properties open. One that contradicts the relation drops out; where just one full tuple
    follows it is that tuple, else it stays as it is. Of each instance's tuples those that hold less than another go.
    """
    values, combined, columns = _combinations(graph, restriction)
    done = restriction.relation.complete(combined, columns).where("consistent")
    return values, settle(most_complete(_where_one(done, columns), ["s"], columns)), columns


def inconsistent(values: DataFrame, best: DataFrame, columns: list[str], most: int | None) -> DataFrame:
    """Instances (s) with a value that no consistent tuple holds, or with more tuples than ``most``."""
    held = best.select("s", F.posexplode(F.array(*columns)).alias("i", "v")).where("v is not null")
    open_ = values.join(held.hint("merge"), ["s", "i", "v"], "left_anti").select("s")
    if most is not None:
        open_ = open_.union(best.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > most).select("s"))
    return open_.distinct()


def apply_restriction(graph: DataFrame, restriction: Restriction) -> DataFrame:
    """New triples that a restriction lets deduce for all instances; if any contradicts it, the one triple that is false."""
    values, best, columns = candidates(graph, restriction)
    bad = inconsistent(values, best, columns, restriction.most).limit(1).select(F.lit("_:a").alias("s"), F.lit(FALSE).alias("p"), F.lit("_:b").alias("o"))
    full = best.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))
    arcs = full.select("s", F.inline(F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).alias("o")) for c, p in zip(columns, restriction.properties)))))
    # one row at most: whether anything is inconsistent
    any_ = F.broadcast(bad.select(F.lit(True).alias("bad")))
    given = graph.where(F.col("p").isin(*restriction.properties))
    return delete(arcs, given).join(any_, F.lit(True), "left_anti").union(bad)


# Restrictions backward


def _derivations(tuples: DataFrame, relation: Relation) -> DataFrame:
    """(s, t, masks): of each full tuple t the least sets of members from which it alone follows, as bit masks.

    A tuple is tried with each of its members left out, 2 to the number of members times.
    """
    size = relation.size
    columns = [f"v{i}" for i in range(size)]
    tried = tuples.select("s", "t", F.explode(F.sequence(F.lit(0), F.lit(2**size - 1))).alias("mask"))
    part = tried.select("s", "t", "mask", *(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.get("t", F.lit(i))).alias(c) for i, c in enumerate(columns)))
    found = relation.complete(part, columns).where(F.col("consistent") & (F.size("tuples") == 1) & (F.get("tuples", F.lit(0)) == F.col("t")))
    masks = found.groupBy("s", "t").agg(F.sort_array(F.collect_set("mask")).alias("masks"))
    least = F.filter("masks", lambda m: ~F.exists("masks", lambda x: (x != m) & (x.bitwiseAND(m) == x)))
    return masks.select("s", "t", least.alias("masks"))


def _covers(holds: DataFrame, lone: DataFrame) -> DataFrame:
    """(s, chosen): every least choice of tuples that holds all values but those that the tuples ``lone`` hold.

    Instances grow all of their choices at once, a round of joins for each tuple of the longest: the first value that is
    still open is held by one of its tuples in turn. A choice of which some tuple has no value of its own goes at once, since
    no longer one could be least. Each round is a written table. A choice is one row: it is as long as the values of an
    instance that more than one tuple holds, and their number is what alternatives are exponential in.
    """
    rest = holds.join(holds.join(lone, ["s", "t"], "left_semi").select("s", "i", "v").distinct(), ["s", "i", "v"], "left_anti")
    holds = settle(rest.groupBy("s", "t").agg(F.sort_array(F.collect_set(F.struct("i", "v"))).alias("c")))
    each = settle(holds.select("s", "t", "c", F.inline("c")))
    kind = holds.select(F.array(F.struct("t", "c")).alias("x")).schema["x"].dataType
    state = settle(each.groupBy("s").agg(F.sort_array(F.collect_set(F.struct("i", "v"))).alias("open")).select("s", F.array().cast(kind).alias("chosen"), "open"))
    done = None
    while True:
        full = state.where(F.size("open") == 0).select("s", F.transform("chosen", lambda x: x["t"]).alias("chosen"))
        done = full if done is None else done.union(full)
        state = state.where(F.size("open") > 0).select("s", "chosen", "open", F.get("open", F.lit(0)).alias("next"))
        if state.isEmpty():
            return done
        state = state.select("s", "chosen", "open", F.col("next.i").alias("i"), F.col("next.v").alias("v")).join(each, ["s", "i", "v"])
        state = state.select("s", F.array_sort(F.concat("chosen", F.array(F.struct("t", "c")))).alias("chosen"), F.array_except("open", "c").alias("open"))
        others = lambda x: F.flatten(F.transform(F.filter("chosen", lambda y: y["t"] != x["t"]), lambda y: y["c"]))
        state = settle(state.where(F.forall("chosen", lambda x: F.size(F.array_except(x["c"], others(x))) > 0)).distinct())


def backward_options(graph: DataFrame, restriction: Restriction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(options, values, inconsistent): what proves the values that a claimed ``graph`` gives the instances of a class.

    ``options(s, cover, t, masks)``: for each instance and each least choice of full tuples that hold all of its values
    (``cover``, a name), the tuples t and the least sets of their members (bit masks) from which each follows. Any one mask
    of every tuple of one cover is an alternative; they are not multiplied out here, so rows grow with the tuples, but for
    values that several tuples hold (see ``_covers``). Tuples that alone hold a value are in every cover. Instances with a value that
    no full tuple holds have no rows, nor do those without values. ``values(s, i, v)`` is what is to be proved,
    ``inconsistent(s)`` are instances whose values contradict the restriction.
    """
    values, combined, columns = _combinations(graph, restriction)
    values = settle(values)
    done = settle(restriction.relation.complete(combined, columns).where("consistent"))
    best = settle(most_complete(_where_one(done, columns), ["s"], columns))
    wrong = inconsistent(values, best, columns, restriction.most)
    found = settle(_derivations(done.select("s", F.explode("tuples").alias("t")).distinct(), restriction.relation))
    members = found.select("s", "t", F.posexplode("t").alias("i", "v"))
    holds = settle(members.join(values, ["s", "i", "v"]))
    # provable: no value is without a tuple
    lost = values.join(holds, ["s", "i", "v"], "left_anti").select("s").distinct()
    holds = settle(holds.join(lost, "s", "left_anti"))
    lone = settle(holds.groupBy("s", "i", "v").agg(F.count("*").alias("n"), F.min("t").alias("t")).where("n = 1").select("s", "t").distinct())
    covers = _covers(holds, lone).select("s", "chosen", F.sha2(F.to_json("chosen"), 256).alias("cover"))
    covers = settle(covers.union(lone.join(covers, "s", "left_anti").select("s", F.array().cast("array<array<string>>"), F.lit("")).distinct()))
    chosen = covers.select("s", "cover", F.explode("chosen").alias("t")).union(covers.join(lone, "s").select("s", "cover", "t"))
    return settle(chosen.join(found, ["s", "t"]).select("s", "cover", "t", "masks")), values, settle(wrong)


def backward_restriction(graph: DataFrame, restriction: Restriction) -> DataFrame:
    """(s, alternative, p, o): for each instance of the claim, every least set of triples from which its values follow.

    All of one instance's alternatives are alternatives; a claim of several instances needs one of each. An alternative holds
    the instance's type. One that gives all the values themselves is left out, as is an instance that nothing proves: it
    has no rows. If the values of any instance contradict the restriction there is just the one triple that is false.
    Alternatives are products of ``backward_options``; each is a row of its own until it is written as triples.
    """
    options, values, wrong = backward_options(graph, restriction)
    wanted = values.groupBy("s").agg(F.count("*").alias("_n"))
    # of each tuple the members that are values themselves, as a mask
    named = options.select("s", "t").distinct().select("s", "t", F.posexplode("t").alias("i", "v")).join(values, ["s", "i", "v"])
    given = named.groupBy("s", "t").agg(F.sum(F.expr("shiftleft(1, i)")).cast("int").alias("given"))
    whole = options.join(given, ["s", "t"]).groupBy("s", "cover").agg(F.array_sort(F.collect_list(F.struct("t", "given", "masks"))).alias("x"))
    # alternatives of a cover are numbered, and the number's digits, in as many bases as there are tuples, say which masks
    bases = F.aggregate("x", F.array(F.lit(1).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) * F.size(x["masks"]))))
    whole = whole.withColumn("bases", bases).select("s", "cover", "x", "bases", F.explode(F.expr("sequence(0L, element_at(bases, -1) - 1)")).alias("k"))
    digit = lambda x, j: F.get(x["masks"], (F.floor(F.col("k") / F.get("bases", j)) % F.size(x["masks"])).cast("int"))
    picked = whole.select("s", F.transform("x", lambda x, j: F.struct(x["t"].alias("t"), x["given"].alias("given"), digit(x, j).alias("mask"))).alias("x"))
    bits = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(1 << i).alias("bit"), F.lit(p).alias("p")) for i, p in enumerate(restriction.properties)))
    arcs = lambda x, mask: F.transform(F.filter(bits, lambda b: b["bit"].bitwiseAND(mask) > 0), lambda b: F.struct(b["p"].alias("p"), F.get(x["t"], b["i"]).alias("o")))
    restated = F.array_distinct(F.flatten(F.transform("x", lambda x: arcs(x, x["given"].bitwiseAND(x["mask"])))))
    needed = F.array_distinct(F.flatten(F.transform("x", lambda x: arcs(x, x["mask"]))))
    name = F.sha2(F.to_json(F.transform("x", lambda x: F.struct(x["t"], x["mask"]))), 256)
    rows = picked.join(wanted, "s").where(F.size(restated) < F.col("_n")).select("s", name.alias("alternative"), needed.alias("needed"))
    own = F.array(F.struct(F.lit(TYPE).alias("p"), F.lit(restriction.of_class).alias("o")))
    rows = rows.select("s", "alternative", F.inline(F.concat(own, "needed")))
    bad = wrong.limit(1).select(F.lit("_:a").alias("s"), F.lit("").alias("alternative"), F.lit(FALSE).alias("p"), F.lit("_:b").alias("o"))
    # one row at most: whether anything is inconsistent
    any_ = F.broadcast(bad.select(F.lit(True).alias("bad")))
    return rows.join(any_, F.lit(True), "left_anti").union(bad)


def restriction_graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(built_in_restrictions(), "s string, p string, o string")
