"""Tables as virtual triples: one union branch per column, so that a predicate prunes all but its own table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.vocab import TYPE

#: table -> key columns, and for each column what its object is: another table's entity, text, a whole number, or hundredths.
TABLES: dict[str, tuple[list[str], dict[str, str]]] = {
    "region": (["r_regionkey"], {"r_name": "text"}),
    "nation": (["n_nationkey"], {"n_name": "text", "n_regionkey": "region"}),
    "customer": (["c_custkey"], {"c_name": "text", "c_nationkey": "nation", "c_acctbal": "cents", "c_mktsegment": "text"}),
    "supplier": (["s_suppkey"], {"s_name": "text", "s_nationkey": "nation", "s_acctbal": "cents"}),
    "part": (["p_partkey"], {"p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "whole", "p_retailprice": "cents"}),
    "orders": (["o_orderkey"], {"o_custkey": "customer", "o_orderstatus": "text", "o_totalprice": "cents", "o_orderpriority": "text"}),
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier", "l_linenumber": "whole", "l_quantity": "whole", "l_returnflag": "text"}),
    "events": (["event_id"], {"user_id": "whole", "event_type": "text"}),
}


def entity(table: str, *keys) -> Column:
    return F.concat(F.lit(f"<urn:{table}:"), F.concat_ws("-", *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys)), F.lit(">"))


def predicate(column: str) -> str:
    return f"<urn:p:{column}>"


def term(kind: str, column: str) -> Column:
    if kind == "text":
        return T.plain(column)
    if kind == "whole":
        return T.integer(column)
    if kind == "cents":
        return T.integer(F.round(F.col(column) * 100))
    return entity(kind, column)


def lift(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The triples (s, p, o) of whole tables. Null values make no triple; rows that repeat a key repeat theirs.

    The frame also has ``branches``, its triples by property: a pattern with a constant property starts from its branch, and
    Spark never plans the others.
    """
    branches: dict[str, DataFrame] = {}
    for t in tables:
        keys, columns = TABLES[t]
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        subject = entity(t, *keys)
        parts = [(TYPE, rows.select(subject.alias("s"), F.lit(TYPE).alias("p"), F.lit(f"<urn:class:{t}>").alias("o")))]
        parts += [(predicate(c), rows.where(F.col(c).isNotNull()).select(subject.alias("s"), F.lit(predicate(c)).alias("p"), term(kind, c).alias("o"))) for c, kind in columns.items()]
        for p, part in parts:
            branches[p] = branches[p].unionByName(part) if p in branches else part
    out = reduce(DataFrame.unionByName, branches.values())
    out.branches = branches
    return out


def graph_of(spark: SparkSession, triples: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(triples, "s string, p string, o string")
