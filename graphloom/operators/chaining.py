"""Backward chaining over frames of goals: how rule heads unify with them, alternatives, and what each needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .canon import SMALL, certificates, duplicates_folded, firsts_kept, rows_folded
from .columns import computed
from .graph import SPO
from .numbers import numbered
from .query import Pattern, column_name, names, variable
from .rules import Change, Rule
from .scratch import drop, settle, tidy

BINDING = "map<string,string>"


def unifiers(goals: DataFrame, heads: Pattern) -> DataFrame:
    """(claim, goal, head, binding) for ``goals(claim, goal, s, p, o)``: each head that a goal triple matches, with its variables.

    One branch a head, each a filter of the goals, so that nothing is paired out.
    """
    parts = []
    for j, head in enumerate(heads):
        seen: dict[str, str] = {}
        fits: list[Column] = []
        for c, t in zip("spo", head):
            if not variable(t):
                fits.append(F.col(c) == t)
            elif column_name(t) in seen:
                fits.append(F.col(c) == F.col(seen[column_name(t)]))
            else:
                seen[column_name(t)] = c
        binding = F.create_map(*(x for v, c in seen.items() for x in (F.lit(v), F.col(c)))) if seen else F.create_map().cast(BINDING)
        parts.append(goals.where(reduce(lambda a, b: a & b, fits, F.lit(True))).select("claim", "goal", F.lit(j).alias("head"), binding.alias("binding")))
    return reduce(DataFrame.union, parts)


def modified(options: DataFrame, heads: Pattern, change: Change) -> DataFrame:
    """``options(claim, goal, head, binding)``, as ``unifiers`` makes them, each replaced by what ``change`` makes of its binding: none, one or more.

    A change takes and gives bindings in columns, as that of a rule does: a modifier binds or tests variables, and may leave
    some out. Options stay one list for each goal; what an alternative of them all becomes is the product of what they become.
    """
    parts = []
    for j, head in enumerate(heads):
        own = [F.col("binding")[v].alias(v) for v in names([head])]
        given = options.where(F.col("head") == j).select(*(F.col(c).alias(f"_{c}") for c in ("claim", "goal", "head")), *own)
        done = change(given)
        bound = [c for c in done.columns if c not in ("_claim", "_goal", "_head")]
        entries = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in bound)), lambda e: e["value"].isNotNull())) if bound else F.create_map().cast(BINDING)
        parts.append(done.select(*(F.col(f"_{c}").alias(c) for c in ("claim", "goal", "head")), entries.cast(BINDING).alias("binding")))
    return reduce(DataFrame.union, parts)


def solvable(options: DataFrame, goals: DataFrame) -> DataFrame:
    """The options of claims each of whose goals still has one, without a goal's repeated bindings."""
    entries = F.array_sort(F.map_entries("binding"))
    once = options.groupBy("claim", "goal", entries.alias("entries")).agg(F.min("head").alias("head"))
    left = once.groupBy("claim").agg(F.countDistinct("goal").alias("left")).join(goals.groupBy("claim").agg(F.countDistinct("goal").alias("goals")), "claim")
    whole = left.where("left = goals").select("claim")
    return once.join(whole, "claim", "left_semi").select("claim", "goal", "head", F.map_from_entries("entries").alias("binding"))


def alternative_counts(options: DataFrame) -> DataFrame:
    """(claim, n): how many alternatives there are, without making any; null beyond 38 digits."""
    sizes = options.groupBy("claim", "goal").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    product = F.aggregate(F.collect_list("n"), F.lit(1).cast("decimal(38,0)"), lambda x, n: F.try_multiply(x, n).try_cast("decimal(38,0)"))
    return sizes.groupBy("claim").agg(product.alias("n"))


def alternatives(goals: DataFrame, found: DataFrame) -> DataFrame:
    """(claim, alternative, bindings): for each claim, one head for each of its goals, in every combination.

    Any one alternative is enough for its claim, and needs all of its bindings. A claim with a goal that nothing
    unifies with has none. A claim's row holds each goal's options once; an alternative is a number whose digits, in the
    numbers of options as bases, choose one of each, so that its row holds its own bindings only.
    """
    options = found.groupBy("claim", "goal").agg(F.sort_array(F.collect_list(F.struct("head", F.map_entries("binding").alias("binding")))).alias("options"))
    whole = goals.groupBy("claim").agg(F.countDistinct("goal").alias("goals"))
    listed = options.groupBy("claim").agg(F.sort_array(F.collect_list(F.struct("goal", "options"))).alias("each")).join(whole, "claim").where(F.size("each") == F.col("goals"))
    # the first goal's digit counts most
    below = lambda i: F.aggregate(F.slice("each", i + 2, F.size("each")), F.lit(1).cast("long"), lambda n, g: n * F.size(g["options"]))
    listed = listed.withColumn("_strides", F.transform("each", lambda g, i: below(i)))
    total = F.element_at("_strides", 1) * F.size(F.element_at("each", 1)["options"])
    rows = listed.select("claim", "each", "_strides", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("_number"))
    pick = F.transform("each", lambda g, i: F.get(g["options"], (F.floor(F.col("_number") / F.get("_strides", i)) % F.size(g["options"])).cast("int"))["binding"])
    return rows.select("claim", F.col("_number").cast("int").alias("alternative"), F.array_distinct(pick).alias("bindings"))


def changed(rows: DataFrame, condition: Column) -> DataFrame:
    """Alternatives all of whose bindings pass a test of ``b``, the name under which it finds each binding's map."""
    each = rows.select("*", F.posexplode("bindings").alias("at", "entries")).withColumn("b", F.map_from_entries("entries"))
    ok = each.groupBy("claim", "alternative").agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("ok")).where("ok")
    return rows.join(ok.select("claim", "alternative"), ["claim", "alternative"], "left_semi")


def _graphs(rule: Rule) -> Column:
    """For each of ``bindings`` the antecedents that it needs, a set: an array of arrays of triples."""

    def graph(entries: Column) -> Column:
        key = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")

        def fill(t: str) -> Column:
            if not variable(t):
                return F.lit(t)
            return F.coalesce(F.try_element_at(F.map_from_entries(entries), F.lit(column_name(t))), T.skolem(f"{rule.name}|{column_name(t)}", key))

        return F.array_distinct(F.array(*(F.struct(*(fill(t).alias(c) for c, t in zip("spo", x))) for x in rule.antecedent)))

    return F.transform("bindings", graph)


def _antecedents(rows: DataFrame, rule: Rule) -> DataFrame:
    """(claim, alternative, at, s, p, o): the antecedents that each binding of each alternative needs, each once."""
    # a binding is one row, so that its antecedents are a set without a shuffle
    each = rows.select("claim", "alternative", F.posexplode(_graphs(rule)).alias("at", "graph"))
    return each.select("claim", "alternative", "at", F.inline("graph"))


def support(rows: DataFrame, rule: Rule) -> DataFrame:
    """(claim, alternative, s, p, o): the antecedents that each alternative needs, merged, as a set.

    Variables that the heads leave open become blank nodes, new for each binding.
    """
    return _antecedents(rows, rule).drop("at").distinct()


@tidy
def folded_support(rows: DataFrame, rule: Rule) -> DataFrame:
    """``support`` without what differs in the names of blank nodes only.

    Of the antecedents that an alternative's bindings need, those equal up to such names are needed once; and of a claim's
    alternatives that then need the same, the first stays. Both are told by ``canon.certificates``, for all claims together.
    """
    if len(rule.antecedent) > SMALL:
        each = settle(_antecedents(rows, rule))
        once = settle(duplicates_folded(each, ["claim", "alternative"], "at").drop("at").distinct())
        drop(each)
        return duplicates_folded(once, ["claim"], "alternative")
    # an alternative is a row: the graphs of its bindings are told within it
    graphs = computed(rows.select("claim", "alternative", "bindings"), {"_graphs": _graphs(rule)})
    each = settle(firsts_kept(graphs, "_graphs").select("claim", "alternative", F.array_distinct(F.flatten("_graphs")).alias("graph")))
    return rows_folded(each, ["claim"], "alternative").select("claim", "alternative", F.inline("graph"))


def backward_apply(rule: Rule, goals: DataFrame, condition: Column | None = None, fold: bool = True) -> DataFrame:
    """What must hold for each claim of ``goals(claim, goal, s, p, o)``, by alternative; ``condition`` filters as in ``changed``.

    The rule's own change is made to each goal's options first, and claims that it leaves without one are dropped.
    ``fold`` folds what is the same up to the names of blank nodes.
    """
    options = unifiers(goals, rule.consequent)
    if rule.change:
        options = solvable(modified(options, rule.consequent, rule.change), goals)
    rows = alternatives(goals, options)
    rows = rows if condition is None else changed(rows, condition)
    return folded_support(rows, rule) if fold else support(rows, rule)


def check_backward(rule: Rule, antecedents: list[DataFrame], claimed: DataFrame) -> bool:
    """Some alternative of what the claimed graph needs by the rule is one of ``antecedents``, up to the names of blank nodes."""
    triples = numbered(claimed.select(*SPO).distinct(), list(SPO), "goal")
    needed = backward_apply(rule, triples.select(F.lit("claim").alias("claim"), "goal", *SPO))
    quads = needed.select(F.concat(F.lit("n"), F.col("alternative").cast("string")).alias("g"), *SPO)
    for i, a in enumerate(antecedents):
        quads = quads.union(a.select(F.lit(f"a{i}"), *SPO))
    marks = certificates(quads)
    mine = marks.where(F.col("g").startswith("n")).select("certificate")
    return not mine.join(marks.where(F.col("g").startswith("a")), "certificate", "left_semi").isEmpty()


def open_variables(rule: Rule) -> list[str]:
    """Variables of the antecedents that the consequents don't bind."""
    return [v for v in names(rule.antecedent) if v not in names(rule.consequent)]
