"""Certificates of many small graphs at once: two graphs get the same one if they differ in the names of blank nodes only.

Colours of blank nodes and variables are refined for all graphs in one set of joins. A graph without tied nodes is told by
its coloured triples. Of tied ones, the parts that hang together by tied nodes alone stand for themselves, as everything
else about them is in their colours: each becomes a graph of its own, once for each node of its smallest class, with that
node singled out, and its certificate is the least of theirs.
"""

from __future__ import annotations

import itertools
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .graph import SPO
from .scratch import drop, freed, settle, settle_in_slices, slices_of, tidy


def _local(c: str) -> Column:
    return T.is_blank(c) | T.is_variable(c)


def _coloured(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``arcs(unit, s, p, o)`` with the colours cs, cp, co: of their own for blank nodes and variables, by the term for others."""
    known = arcs
    for c in SPO:
        known = known.join(nodes.select("unit", F.col("term").alias(c), F.col("colour").alias(f"c{c}")), ["unit", c], "left")
        known = known.withColumn(f"c{c}", F.coalesce(f"c{c}", F.xxhash64(c)))
    return known


@tidy
def _refined(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The colours of ``nodes(unit, term, colour)`` refined until no class of any unit splits."""
    def classes(n: DataFrame) -> int:
        with freed(n.sparkSession):
            return n.select("unit", "colour").distinct().count()

    before, first = classes(nodes), nodes
    total = nodes.count()
    none = F.lit(None).cast("long")
    while before < total:
        known = _coloured(arcs, nodes)
        ends = [known.where(_local(c)).select("unit", F.col(c).alias("term"), none.alias("colour"), F.xxhash64(F.lit(c), "cs", "cp", "co").alias("h")) for c in SPO]
        sums = reduce(DataFrame.union, ends, nodes.select("unit", "term", "colour", none.alias("h"))).groupBy("unit", "term")
        sums = sums.agg(F.max("colour").alias("colour"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
        last, nodes = nodes, settle(sums.select("unit", "term", F.xxhash64("colour", "h").alias("colour")))
        if last is not first:
            drop(last)
        now = classes(nodes)
        if now == before:
            break
        before = now
    return nodes


@tidy
def _parts(links: DataFrame, tied: DataFrame) -> DataFrame:
    """(unit, term, part) of tied nodes: those that hang together by ``links(unit, term, other)`` have one part."""
    part, last = tied.select("unit", "term", F.col("term").alias("part")), tied.limit(0)
    while True:
        near = links.join(part.select("unit", F.col("term").alias("other"), "part"), ["unit", "other"]).groupBy("unit", "term").agg(F.min("part").alias("near"))
        least = part.join(near, ["unit", "term"], "left").select("unit", "term", F.least("part", "near").alias("to"), F.col("part").alias("was"))
        jump = part.select("unit", F.col("term").alias("to"), "part")
        now = settle(least.join(jump, ["unit", "to"]).select("unit", "term", "part", "was"))
        part = now.select("unit", "term", "part")
        drop(last)
        last = now
        if now.where("part <> was").isEmpty():
            return part


@tidy
def _units(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(unit, certificate) for ``arcs(unit, s, p, o)`` whose blank nodes and variables have colours in ``nodes``."""
    nodes = _refined(arcs, nodes)
    seeds = [F.sum(F.xxhash64(F.lit(i), "cs", "cp", "co").cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)]
    whole = settle(_coloured(arcs, nodes).groupBy("unit").agg(*seeds, F.count("*").alias("n")))
    sizes = nodes.groupBy("unit", "colour").agg(F.count("*").alias("k")).where("k > 1")
    tied = settle(nodes.join(sizes, ["unit", "colour"]))
    mark = lambda *parts: F.sha2(F.concat_ws("|", *parts), 256)
    if tied.isEmpty():
        return whole.select("unit", mark("h1", "h2", "n").alias("certificate"))
    # of each triple between tied nodes, whatever is not tied is held fast by its colour
    held = _coloured(arcs, nodes)
    for c in SPO:
        own = tied.select("unit", F.col("term").alias(c), F.lit(True).alias(f"t{c}"))
        held = held.join(own, ["unit", c], "left").withColumn(f"t{c}", F.col(f"t{c}").isNotNull())
    several = reduce(lambda x, y: x | y, (F.col(f"t{x}") & F.col(f"t{y}") & (F.col(x) != F.col(y)) for x, y in itertools.combinations(SPO, 2)))
    held = settle(held.where(several).select("unit", *(F.when(F.col(f"t{c}"), F.col(c)).otherwise(F.concat(F.lit("="), f"c{c}")).alias(c) for c in SPO)))
    ends = [held.where(_local(x) & _local(y)).select("unit", F.col(x).alias("term"), F.col(y).alias("other")) for x, y in itertools.permutations(SPO, 2)]
    part = _parts(settle(reduce(DataFrame.union, ends).where("term <> other").distinct()), tied)
    placed = settle(tied.join(part, ["unit", "term"]).select("unit", "part", "term", "colour", "k"))
    alone = placed.groupBy("unit", "part").agg(F.count("*").alias("m"), F.min(F.struct("k", "colour")).alias("first"))
    lone = alone.where("m = 1").select("unit", "part", F.col("first.colour").cast("string").alias("certificate"))
    # one branch for each node of the part's smallest class
    chosen = placed.join(alone.where("m > 1"), ["unit", "part"]).where(F.col("colour") == F.col("first.colour"))
    chosen = settle(chosen.select("unit", "part", F.col("term").alias("chosen"), F.md5(F.concat_ws("|", "unit", "part", "term").cast("binary")).alias("branch")))
    inner = None
    if not chosen.isEmpty():
        near = reduce(lambda x, y: F.coalesce(x, y), (F.when(_local(c), F.col(c)) for c in SPO))
        found = held.withColumn("term", near).join(part, ["unit", "term"]).drop("term").join(chosen, ["unit", "part"]).select(F.col("branch").alias("unit"), *SPO)
        own = placed.join(chosen, ["unit", "part"])
        own = own.select(F.col("branch").alias("unit"), "term", F.when(F.col("term") == F.col("chosen"), F.xxhash64("colour", F.lit("chosen"))).otherwise(F.col("colour")).alias("colour"))
        inner = _units(settle(found), settle(own))
        inner = chosen.join(inner.withColumnRenamed("unit", "branch"), "branch").groupBy("unit", "part").agg(F.min("certificate").alias("certificate"))
    every = lone if inner is None else lone.union(inner)
    below = every.groupBy("unit").agg(*(F.sum(F.xxhash64(F.lit(i), "certificate").cast("decimal(38,0)")).alias(f"p{i}") for i in (1, 2)), F.count("*").alias("parts"))
    both = whole.join(below, "unit", "left").na.fill(0, ["parts"])
    return settle(both.select("unit", mark("h1", "h2", "n", F.coalesce(F.col("p1").cast("string"), F.lit("")), F.coalesce(F.col("p2").cast("string"), F.lit("")), "parts").alias("certificate")))


#: Graphs of up to so many triples are one row each. Fixed value.
SMALL = 64


def _small_certificate():
    """A function from a graph's triples to its certificate, by the steps of ``_units``; colours are ranks, so nothing collides."""
    import hashlib
    from collections import Counter, defaultdict

    def ranked(keys: dict) -> dict:
        places = {k: i for i, k in enumerate(sorted(set(keys.values())))}
        return {t: places[k] for t, k in keys.items()}

    def unit(triples: list, first: dict):
        colour = ranked({t: (c,) for t, c in first.items()})
        while True:
            # terms that aren't nodes stand for themselves, and none is mistaken for a colour
            arcs = [tuple((0, "", colour[t]) if t in colour else (1, t, 0) for t in x) for x in triples]
            near = defaultdict(list)
            for x, seen in zip(triples, arcs):
                for i, t in enumerate(x):
                    if t in colour:
                        near[t].append((i, seen))
            finer = ranked({t: (c, tuple(sorted(near[t]))) for t, c in colour.items()})
            if len(set(finer.values())) == len(set(colour.values())):
                break
            colour = finer
        whole = (sorted(arcs), sorted((colour[t], first[t]) for t in first))
        sizes = Counter(colour.values())
        tied = {t for t, c in colour.items() if sizes[c] > 1}
        held = [x for x in triples if len({t for t in x if t in tied}) > 1]
        part = {t: t for t in tied}

        def find(t):
            while part[t] != t:
                part[t] = t = part[part[t]]
            return t

        for x in held:
            ends = [t for t in x if t in tied]
            for t in ends[1:]:
                part[find(t)] = find(ends[0])
        members, inside = defaultdict(list), defaultdict(list)
        for t in tied:
            members[find(t)].append(t)
        for x in held:
            own = tuple(t if t in tied else f"={colour[t]}" if t in colour else f"+{t}" for t in x)
            inside[find(next(t for t in x if t in tied))].append(own)
        below = []
        for root, nodes in members.items():
            if len(nodes) == 1:
                below.append(repr(colour[root]))
                continue
            least = min((sizes[colour[t]], colour[t]) for t in nodes)[1]
            chosen = [t for t in nodes if colour[t] == least]
            below.append(min(unit(inside[root], {t: 2 * colour[t] + (t == c) for t in nodes}) for c in chosen))
        return hashlib.sha256(repr((whole, sorted(below))).encode("utf-8", "surrogatepass")).hexdigest()

    def certificate(graphs: pd.Series) -> pd.Series:
        out = []
        for graph in graphs:
            triples = [tuple(x) for x in graph]
            out.append(unit(triples, {t: 0 for x in triples for t in x if t.startswith(("_:", "?"))}))
        return pd.Series(out, dtype=object)

    return certificate


@tidy
def certificates(quads: DataFrame) -> DataFrame:
    """(g, certificate) of every named graph of ``quads(g, s, p, o)``: equal for graphs equal up to the names of blank nodes and variables.

    Graphs are sets of triples. One of ``SMALL`` triples at most is a row, and is told within it; equal graphs are of one size.
    The others are told together: the number of jobs follows the deepest tie of any of them, not their number. A part of m tied
    nodes costs m times the size of its smallest class, so this is for many small graphs; ``entail.isomorphic`` compares two
    large ones. Colours of the larger ones are hashes of 64 bits, sums of them of 128.
    """
    arcs = settle(quads.where("g is not null").select(F.col("g").alias("unit"), *SPO).distinct())
    large = settle(arcs.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("unit"))
    # of no size that could go through the driver, on either side
    rows = arcs.join(large.hint("merge"), "unit", "left_anti").groupBy("unit").agg(F.collect_list(F.array(*SPO)).alias("triples"))
    small = rows.select(F.col("unit").alias("g"), F.pandas_udf(_small_certificate(), "string")("triples").alias("certificate"))
    if large.isEmpty():
        return small
    arcs = settle(arcs.join(large.hint("merge"), "unit", "left_semi"))
    nodes = arcs.select("unit", F.explode(F.array(*SPO)).alias("term")).where(_local("term")).distinct()
    return small.union(_units(arcs, settle(nodes.withColumn("colour", F.lit(1).cast("long")))).select("unit", "certificate"))


def outlines(rows: DataFrame, graph: list[str]) -> DataFrame:
    """(graph, _n, _x, _y) of the graphs in ``rows(graph, s, p, o)``, sets of triples: equal for graphs equal up to blank names, and seldom for others."""
    h = F.xxhash64(*(F.when(_local(c), F.lit("_:")).otherwise(F.col(c)) for c in SPO))
    low = h.bitwiseAND((1 << 32) - 1)
    return rows.groupBy(*graph).agg(F.count("*").alias("_n"), F.bit_xor(h).alias("_x"), F.sum(low).alias("_y"))


@tidy
def twins(rows: DataFrame, graph: list[str], within: list[str]) -> DataFrame:
    """(graph) of those in ``rows(graph, s, p, o)`` that may equal another with the same ``within``, by outlines; the others equal none."""
    found = settle(outlines(rows, graph))
    same = [*within, "_n", "_x", "_y"]
    several = found.groupBy(*same).agg(F.count("*").alias("_graphs")).where("_graphs > 1")
    return settle(found.join(several.hint("merge"), same).select(*graph))


@tidy
def duplicates_folded(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``rows(keys, number, s, p, o)``, graphs (sets) numbered within their keys, without those equal to one of a lesser number up to blank names.

    Only graphs whose outline another one of their keys has get a certificate.
    """
    graph = [*keys, number]
    alike = twins(rows, graph, keys)
    if alike.isEmpty():
        return rows
    found = rows.join(alike.hint("merge"), graph, "left_semi").withColumn("g", F.to_json(F.struct(*graph)))
    marks = settle(alike.withColumn("g", F.to_json(F.struct(*graph))).join(certificates(found).hint("merge"), "g"))
    first = marks.groupBy(*keys, "certificate").agg(F.min(number).alias("_first"))
    again = marks.join(first.hint("merge"), [*keys, "certificate"]).where(F.col(number) != F.col("_first"))
    # as many rows as graphs, on all sides: none is sent through the driver
    return rows.join(again.select(*graph).hint("merge"), graph, "left_anti")


def _plain_triples(graph) -> Column:
    return F.transform(graph, lambda x: F.array(*(x[c] for c in SPO)))


def _outline(graph) -> Column:
    """A hash of a graph in one row, an array of triples: equal for graphs equal up to blank names, and seldom for others."""
    mask = lambda c: F.when(c.startswith("_:") | c.startswith("?"), F.lit("_:")).otherwise(c)
    return F.xxhash64(F.array_sort(F.transform(graph, lambda x: F.xxhash64(*(mask(x[c]) for c in SPO)))))


def firsts_kept(rows: DataFrame, graphs: str) -> DataFrame:
    """``rows`` whose arrays of graphs, of up to ``SMALL`` triples each, are left with those not equal to one before them up to blank names."""
    import json

    one = _small_certificate()

    def each(rows: pd.Series) -> pd.Series:
        return pd.Series([list(one([json.loads(g) for g in r])) for r in rows], dtype=object)

    # only a row in which two look alike needs certificates; Arrow crashed on deeper arrays than this, so graphs travel as text
    outlines = F.transform(graphs, _outline)
    alike = F.size(F.array_distinct(outlines)) < F.size(outlines)
    text = F.transform(graphs, lambda g: F.to_json(_plain_triples(g)))
    marked = rows.withColumn("_marks", F.pandas_udf(each, "array<string>")(F.when(alike, text).otherwise(F.array().cast("array<string>"))))
    first = F.filter(graphs, lambda _, i: F.array_position("_marks", F.get("_marks", i)) == i + 1)
    return marked.withColumn(graphs, F.when(F.size("_marks") == 0, F.col(graphs)).otherwise(first)).drop("_marks")


@tidy
def rows_folded(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``duplicates_folded`` for ``rows(keys, number, graph)``, a written table with a graph in each row, an array of distinct triples.

    So what tells two graphs apart is found within their rows, and graphs are moved whole; those of more than ``SMALL`` triples
    get the certificates of triples in rows of their own.
    """
    graph = [*keys, number]
    outline = rows.select(*graph, F.size("graph").alias("_n"), _outline(F.col("graph")).alias("_x"))
    alike = outline.groupBy(*keys, "_n", "_x").agg(F.collect_list(number).alias("_numbers")).where(F.size("_numbers") > 1)
    alike = settle(alike.select(*keys, F.explode("_numbers").alias(number)))
    if alike.isEmpty():
        return rows
    slices = slices_of(rows)
    small = F.size("graph") <= SMALL
    of_row = F.pandas_udf(_small_certificate(), "string")(_plain_triples("graph")).alias("certificate")
    own = lambda part: part(rows.where(small), *keys).join(part(alike, *keys).hint("merge"), graph, "left_semi")
    marks = settle_in_slices(slices, lambda part: own(part).select(*graph, of_row))
    large = settle(rows.where(~small).join(alike.hint("merge"), graph, "left_semi").withColumn("g", F.to_json(F.struct(*graph))))
    if not large.isEmpty():
        told = certificates(large.select("g", F.inline("graph")))
        marks = marks.union(large.join(told.hint("merge"), "g").select(*graph, "certificate"))
    same = marks.groupBy(*keys, "certificate").agg(F.collect_list(number).alias("_numbers")).where(F.size("_numbers") > 1)
    again = settle(same.select(*keys, F.explode(F.filter("_numbers", lambda n: n > F.array_min("_numbers"))).alias(number)))
    return settle_in_slices(slices, lambda part: part(rows, *keys).join(part(again, *keys).hint("merge"), graph, "left_anti"))
