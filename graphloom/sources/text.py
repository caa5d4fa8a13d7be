"""Triples as text: one subject's statements a line, with prefixes, ``;`` and ``,``, read and written by Spark.

Lines are independent, so files of any size are read and written in parallel. Forms that nest over lines
(``[...]``, ``(...)``, ``{...}``) are not read; lists and named graphs are made with frames instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.vocab import OWL, PREFIXES, TYPE
from ..operators.graph import by_subject, labels, rename
from ..operators.numbers import numbered

#: IRI, blank node, variable, literal with tag or datatype, prefixed name, separators. Fixed value.
TOKEN = r"""<[^>]*>|_:[A-Za-z0-9_.-]*[A-Za-z0-9_-]|\?[A-Za-z0-9_]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^(?:<[^>]*>|[A-Za-z0-9_-]*:[A-Za-z0-9_-]+))?|[A-Za-z0-9_-]*:[A-Za-z0-9_-]*|=|\ba\b|[;,.]"""


def _expand(token: Column, prefixes: dict[str, str]) -> Column:
    """Prefixed names, also as datatypes, in full; ``a`` and ``=`` as the properties they stand for."""
    known = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    full = lambda name: F.concat(F.lit("<"), F.try_element_at(known, F.regexp_extract(name, r"\A([^:]*):", 1)), F.regexp_extract(name, r":(.*)\z", 1), F.lit(">"))
    dtype = F.regexp_extract(token, r"\^\^([^<]*:[^>]*)\z", 1)
    out = F.when(token == "a", F.lit(TYPE)).when(token == "=", F.lit(f"<{OWL}sameAs>"))
    out = out.when(token.startswith('"') & (dtype != ""), F.concat(F.regexp_extract(token, r'(?s)\A(".*")\^\^', 1), F.lit("^^"), full(dtype)))
    return out.when(token.rlike(r"\A[A-Za-z0-9_-]*:") & ~token.startswith("_:"), full(token)).otherwise(token)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """The triples (s, p, o) of text files, as a set; ``#`` starts a comment line.

    A line holds any number of statements, each with its ``.``; one that goes on in the next line, and anything that is
    no token, raises an error when the lines are read. Prefix lines (``@prefix p: <iri> .``) hold for the whole folder:
    there are few, and the driver reads them first; other ``@`` lines raise. Names with an unknown prefix make no triple.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"\A\s*(#|\z)"))
    declared = F.col("value").rlike(r"\A\s*@prefix\s+[A-Za-z0-9_-]*:\s*<[^>]*>\s*\.\s*\z")
    heads = lines.where(declared).select(F.regexp_extract("value", r"@prefix\s+([A-Za-z0-9_-]*):", 1), F.regexp_extract("value", r"<([^>]*)>", 1))
    prefixes = PREFIXES | {r[0]: r[1] for r in heads.distinct().collect()}
    rest = F.regexp_replace("value", TOKEN, " ")
    tokens = F.regexp_extract_all("value", F.lit(TOKEN), F.lit(0))
    wrong = F.col("value").rlike(r"\A\s*@") | (F.trim(rest) != "") | (F.element_at(tokens, -1) != ".")
    told = F.raise_error(F.concat(F.lit("not whole statements: "), F.col("value"))).cast("array<string>")
    # the number goes on before the tokens are laid out, or each token would get its own
    rows = lines.where(~declared).select(F.monotonically_increasing_id().alias("line"), F.when(F.coalesce(wrong, F.lit(True)), told).otherwise(tokens).alias("tokens"))
    rows = rows.select("line", F.posexplode("tokens").alias("i", "t"))
    own = W.partitionBy("line").orderBy("i")
    before = lambda mark: F.sum(F.when(F.col("t") == mark, 1).otherwise(0)).over(own)
    rows = rows.select("line", "i", "t", before(".").alias("statement"), before(";").alias("clause")).where(~F.col("t").isin(";", ".", ","))
    statement = W.partitionBy("line", "statement").orderBy("i")
    rows = rows.select("*", F.first("t").over(statement).alias("s"), F.row_number().over(statement).alias("n")).where("n > 1")
    clause = W.partitionBy("line", "statement", "clause").orderBy("i")
    rows = rows.select("s", F.first("t").over(clause).alias("p"), F.col("t").alias("o"), F.row_number().over(clause).alias("k")).where("k > 1")
    full = rows.select(*(_expand(F.col(c), prefixes).alias(c) for c in "spo"))
    return full.where("s is not null and p is not null and o is not null").distinct()


def lines_of(graph: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """One line of text (column ``value``) for each subject, its properties and objects sorted, names shortened."""
    def short(c: Column) -> Column:
        for p, iri in (prefixes or {}).items():
            c = F.regexp_replace(c, rf"\A<{iri.replace('.', chr(92) + '.')}([A-Za-z0-9_-]+)>\z", f"{p}:$1")
        return c

    verbs = by_subject(graph).select("s", F.concat_ws(" ", short(F.col("p")), F.array_join(F.transform("o", short), " , ")).alias("po"))
    each = verbs.groupBy("s").agg(F.sort_array(F.collect_list("po")).alias("po"))
    return each.select(F.concat(short(F.col("s")), F.lit(" "), F.array_join("po", " ; "), F.lit(" .")).alias("value"))


def largest_blank_number(graph: DataFrame) -> int:
    """The largest whole number that is a blank node's name, 0 if there is none."""
    names = labels(graph).where(F.col("term").rlike(r"\A_:[0-9]{1,18}\z"))
    return names.agg(F.max(F.substring("term", 3, 18).cast("long"))).first()[0] or 0


def renumbered(graph: DataFrame, which: Column | None = None) -> DataFrame:
    """The graph with its blank nodes named by whole numbers, in the order of their names.

    ``which``, a test of ``term``, picks those to rename; they are then numbered on from the largest number in use. Numbers
    are dense and come from counts of ranges of names, so that names never meet in one place.
    """
    blank = labels(graph).where(T.is_blank("term"))
    start = 1 if which is None else largest_blank_number(graph) + 1
    named = numbered(blank if which is None else blank.where(which), ["term"])
    return rename(graph, named.select("term", F.concat(F.lit("_:"), (F.col("number") + start).cast("string")).alias("to")))


def write_triples(graph: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    head = graph.sparkSession.createDataFrame([(f"@prefix {p}: <{i}> .",) for p, i in (prefixes or {}).items()], "value string")
    head.union(lines_of(graph, prefixes)).write.mode("overwrite").text(path)
