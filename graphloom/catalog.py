"""Named queries over the driver's tables, each with the SQL of its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .functions import uri as U
from .functions.vocab import ALLOCATED, DOMAIN, INTEGER, RANGE, RDF, RDFS, STRING, SUBCLASS, SUBPROPERTY, TYPE, XML_LITERAL
from .operators import chaining as C
from .operators import entail as E
from .operators import graph as G
from .operators import modifiers as M
from .operators import named as N
from .operators import query as Q
from .operators import relations as L
from .operators import rules as R
from .operators.scratch import tidy
from .sources.mapping import graph_of, lift
from .sources.text import lines_of

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

INT = f'"^^<{INTEGER}>'
#: Shorthands in the SQL below.
WORDS = {"@INT": f"'{INT}'", "@TYPE": f"'{TYPE}'", "@RDFS": RDFS, "@RDF": RDF, "@STRING": f"'^^<{STRING}>'"}


def query(name: str, sql: str | None = None):
    def register(f):
        # of the tables written on the way, those stay that the result reads
        _QUERIES[name] = tidy(f)
        if sql:
            for k, v in WORDS.items():
                sql_ = _SQL.get(name, sql).replace(k, v)
                _SQL[name] = sql_
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


P = Q.pattern


# Selection

CUSTOMER = """SELECT '<urn:customer:' || c_custkey || '>' AS s, @TYPE AS p, '<urn:class:customer>' AS o FROM customer
UNION ALL SELECT '<urn:customer:' || c_custkey || '>', '<urn:p:c_name>', '"' || c_name || '"' FROM customer
UNION ALL SELECT '<urn:customer:' || c_custkey || '>', '<urn:p:c_nationkey>', '<urn:nation:' || c_nationkey || '>' FROM customer
UNION ALL SELECT '<urn:customer:' || c_custkey || '>', '<urn:p:c_acctbal>', '"' || round(c_acctbal * 100)::BIGINT || @INT FROM customer
UNION ALL SELECT '<urn:customer:' || c_custkey || '>', '<urn:p:c_mktsegment>', '"' || c_mktsegment || '"' FROM customer"""


@query("lift_customer", CUSTOMER)
def _(spark, d):
    return lift(spark, d, "customer")


@query("arcs_by_subject", f"SELECT * FROM ({CUSTOMER}) WHERE s = '<urn:customer:7>'")
def _(spark, d):
    return G.extract(lift(spark, d, "customer"), F.col("s") == "<urn:customer:7>")


@query("arcs_by_pred", "SELECT '<urn:orders:' || o_orderkey || '>' AS s, '<urn:p:o_custkey>' AS p, '<urn:customer:' || o_custkey || '>' AS o FROM orders")
def _(spark, d):
    return G.extract(lift(spark, d, "orders", "customer"), F.col("p") == "<urn:p:o_custkey>")


@query("arcs_by_obj", "SELECT '<urn:customer:' || c_custkey || '>' AS s, '<urn:p:c_nationkey>' AS p, '<urn:nation:3>' AS o FROM customer WHERE c_nationkey = 3 UNION ALL SELECT '<urn:supplier:' || s_suppkey || '>', '<urn:p:s_nationkey>', '<urn:nation:3>' FROM supplier WHERE s_nationkey = 3")
def _(spark, d):
    return G.extract(lift(spark, d, "customer", "supplier"), F.col("o") == "<urn:nation:3>")


@query("arcs_allp", "SELECT '<urn:customer:' || c_custkey || '>' AS s, '<urn:p:c_mktsegment>' AS p, '\"BUILDING\"' AS o FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return G.extract(lift(spark, d, "customer"), G.all_of([F.col("p") == "<urn:p:c_mktsegment>", F.col("o") == '"BUILDING"']))


@query("arcs_anyp", f"SELECT * FROM ({CUSTOMER}) WHERE s = '<urn:customer:7>' OR o = '<urn:nation:3>'")
def _(spark, d):
    return G.extract(lift(spark, d, "customer"), G.any_of([F.col("s") == "<urn:customer:7>", F.col("o") == "<urn:nation:3>"]))


@query("arcs_with_label", f"SELECT * FROM ({CUSTOMER}) WHERE '<urn:nation:3>' IN (s, p, o)")
def _(spark, d):
    return G.extract(lift(spark, d, "customer"), G.has_label("<urn:nation:3>"))


@query("pred_values", "SELECT '\"' || n_name || '\"' AS o FROM nation WHERE n_nationkey = 4")
def _(spark, d):
    return G.objects(lift(spark, d, "nation"), "<urn:nation:4>", "<urn:p:n_name>")


@query("value_subjects", "SELECT '<urn:nation:' || n_nationkey || '>' AS s FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    return G.subjects(lift(spark, d, "nation"), "<urn:p:n_regionkey>", "<urn:region:1>")


@query("pred_int_values", "SELECT '<urn:part:' || p_partkey || '>' AS s, p_size::BIGINT AS value FROM part")
def _(spark, d):
    return G.integer_objects(lift(spark, d, "part"), "<urn:p:p_size>").select("s", F.col("value").cast("long").alias("value"))


@query("labels_distinct", f"SELECT s AS term FROM ({CUSTOMER}) UNION SELECT p FROM ({CUSTOMER}) UNION SELECT o FROM ({CUSTOMER})")
def _(spark, d):
    return G.labels(lift(spark, d, "customer"))


@query("nodes_distinct", f"SELECT s AS term FROM ({CUSTOMER}) UNION SELECT o FROM ({CUSTOMER})")
def _(spark, d):
    return G.nodes(lift(spark, d, "customer"))


@query("nodes_literal", f"SELECT DISTINCT o AS term FROM ({CUSTOMER}) WHERE o LIKE '\"%'")
def _(spark, d):
    return G.nodes(lift(spark, d, "customer")).where(T.is_literal("term"))


@query("fmap_rename", "SELECT '<urn:nation:' || n_nationkey || '>' AS s, '<urn:p:n_regionkey>' AS p, '<urn:zone:' || n_regionkey || '>' AS o FROM nation")
def _(spark, d):
    g = G.extract(lift(spark, d, "nation"), F.col("p") == "<urn:p:n_regionkey>")
    mapping = read(spark, d, "region").select(T.iri("urn:region:", "r_regionkey").alias("term"), T.iri("urn:zone:", "r_regionkey").alias("to"))
    return G.rename(g, mapping)


@query("list_decode", "SELECT '_:l-' || l_orderkey || '-0' AS head, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::BIGINT AS position, '\"' || l_linenumber || @INT AS item FROM lineitem")
def _(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    rows = rows.select("l_orderkey", F.transform("x", lambda r: T.integer(r["l_linenumber"])).alias("x"))
    return G.list_items(G.make_lists(rows, "l_orderkey", "x"), rows.select(F.concat(F.lit("_:l-"), "l_orderkey", F.lit("-0")).alias("head")))


# Patterns

CHAIN = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
CHAIN_PATTERN = '?ord <urn:p:o_custkey> ?c . ?c <urn:p:c_nationkey> ?n . ?n <urn:p:n_regionkey> ?r . ?r <urn:p:r_name> "ASIA"'


@query("bgp_one", "SELECT '<urn:nation:' || n_nationkey || '>' AS n, '\"' || n_name || '\"' AS name FROM nation")
def _(spark, d):
    return Q.match(lift(spark, d, "nation"), P("?n <urn:p:n_name> ?name"))


@query("bgp_chain4", f"SELECT '<urn:orders:' || o_orderkey || '>' AS ord, '<urn:customer:' || c_custkey || '>' AS c, '<urn:nation:' || n_nationkey || '>' AS n, '<urn:region:' || r_regionkey || '>' AS r FROM {CHAIN} WHERE r_name = 'ASIA'")
def _(spark, d):
    return Q.match(lift(spark, d, "orders", "customer", "nation", "region"), P(CHAIN_PATTERN))


@query("bgp_star3", "SELECT '<urn:part:' || p_partkey || '>' AS x, '\"' || p_name || '\"' AS a, '\"' || p_brand || '\"' AS b, '\"' || p_size || @INT AS c FROM part")
def _(spark, d):
    return Q.match(lift(spark, d, "part"), P("?x <urn:p:p_name> ?a . ?x <urn:p:p_brand> ?b . ?x <urn:p:p_size> ?c"))


@query("bgp_cross", "SELECT '<urn:region:' || r_regionkey || '>' AS r, '<urn:nation:' || n_nationkey || '>' AS n FROM region, nation")
def _(spark, d):
    return Q.match(lift(spark, d, "region", "nation"), P("?r rdf:type <urn:class:region> . ?n rdf:type <urn:class:nation>"))


@query("bgp_cycle", "SELECT '<urn:orders:' || o_orderkey || '>' AS ord, '<urn:customer:' || o_custkey || '>' AS c, '<urn:lineitem:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '>' AS i, '<urn:supplier:' || l_suppkey || '>' AS sup, '<urn:nation:' || c_nationkey || '>' AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = c_nationkey")
def _(spark, d):
    g = lift(spark, d, "orders", "customer", "supplier", "lineitem")
    return Q.match(g, P("?i <urn:p:l_orderkey> ?ord . ?i <urn:p:l_suppkey> ?sup . ?ord <urn:p:o_custkey> ?c . ?c <urn:p:c_nationkey> ?n . ?sup <urn:p:s_nationkey> ?n")).distinct()


@query("bgp_ground_exists", "SELECT '<urn:nation:' || n_nationkey || '>' AS n FROM nation WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 2)")
def _(spark, d):
    return Q.match(lift(spark, d, "nation"), P("<urn:nation:2> rdf:type <urn:class:nation> . ?n rdf:type <urn:class:nation>"))


@query("bgp_repeated_var", "SELECT '<urn:n:' || n_nationkey || '>' AS x FROM nation WHERE n_nationkey = n_regionkey")
def _(spark, d):
    g = read(spark, d, "nation").select(T.iri("urn:n:", "n_nationkey").alias("s"), F.lit("<urn:p:near>").alias("p"), T.iri("urn:n:", "n_regionkey").alias("o"))
    return Q.match(g, P("?x <urn:p:near> ?x"))


@query("instance_query", "SELECT '<urn:customer:' || c_custkey || '>' AS b_x, '<urn:nation:' || n_nationkey || '>' AS b_n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def _(spark, d):
    return Q.instance_match(lift(spark, d, "customer", "nation"), P("_:x <urn:p:c_nationkey> _:n . _:n <urn:p:n_regionkey> <urn:region:2>"))


@query("simple_entails_bool", "SELECT EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2) AS yes, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 77) AS no")
def _(spark, d):
    g = lift(spark, d, "customer", "nation")
    yes = Q.entails(g, P("_:x <urn:p:c_nationkey> _:n . _:n <urn:p:n_regionkey> <urn:region:2>"))
    return spark.createDataFrame([(yes, Q.entails(g, P("_:n <urn:p:n_regionkey> <urn:region:77>")))], "yes boolean, no boolean")


@query("binding_join", "SELECT '<urn:nation:' || n_nationkey || '>' AS n, '\"' || n_name || '\"' AS v, '<urn:region:' || n_regionkey || '>' AS r FROM nation")
def _(spark, d):
    g = lift(spark, d, "nation")
    a = Q.match(g, P("?n <urn:p:n_name> ?v"))
    return Q.joined(a, Q.match(g, P("?n <urn:p:n_regionkey> ?r")).withColumn("v", F.lit("?")), ["n"]).select("n", "v", "r")


# Filters

#: Terms of every kind from one table: an IRI, a blank, and literals of four kinds.
KINDS = [
    ("iri", "'<urn:nation:' || n_nationkey || '>'", lambda: T.iri("urn:nation:", "n_nationkey")),
    ("blank", "'_:n' || n_nationkey", lambda: F.concat(F.lit("_:n"), "n_nationkey")),
    ("plain", "'\"' || n_name || '\"'", lambda: T.plain("n_name")),
    ("lang", "'\"' || n_name || '\"@en'", lambda: T.tagged("n_name", F.lit("EN"))),
    ("int", f"'\"' || n_nationkey || '{INT}'", lambda: T.integer("n_nationkey")),
    ("xml", f"'\"' || n_name || '\"^^<{XML_LITERAL}>'", lambda: T.typed("n_name", XML_LITERAL)),
    ("member", f"'<{RDF}_' || n_nationkey || '>'", lambda: T.iri(f"{RDF}_", "n_nationkey")),
]


def _kinds(spark, d) -> DataFrame:
    n = read(spark, d, "nation")
    return n.select(F.explode(F.array(*(f() for _, _, f in KINDS))).alias("v"))


for _name, _which in {
    "iri": ["iri", "member"],
    "blank": ["blank"],
    "literal": ["plain", "lang", "int", "xml"],
    "untyped": ["plain", "lang"],
    "typed": ["int", "xml"],
    "xml": ["xml"],
    "member": ["member"],
}.items():
    _sql = " UNION ALL ".join(f"SELECT {s} AS v FROM nation" for k, s, _ in KINDS if k in _which)
    query(f"filter_{_name}", _sql)(lambda spark, d, f=Q.FILTERS[_name]: _kinds(spark, d).where(Q.test(f("v"))))


@query("filter_datatyped", f"SELECT '<{INTEGER}>' AS t, '\"' || n_nationkey || @INT AS v FROM nation")
def _(spark, d):
    return _kinds(spark, d).select(F.lit(f"<{INTEGER}>").alias("t"), "v").where(T.has_datatype("v", "t"))


PAIRS = "FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _pairs(spark, d) -> DataFrame:
    """Customers and suppliers that share a nation, with their key parities, one side open for some."""
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(T.iri("urn:x:", "c_custkey").alias("x"), T.iri("urn:k:", F.col("c_custkey") % 7).alias("a"), F.when(F.col("n_regionkey") > 0, T.iri("urn:k:", F.col("n_nationkey") % 7)).alias("b"))


for _name, _cond, _sql in (
    ("eq", lambda: Q.same("a", "b"), "n_regionkey > 0 AND c_custkey % 7 = n_nationkey % 7"),
    ("ne", lambda: Q.different("a", "b"), "n_regionkey > 0 AND c_custkey % 7 <> n_nationkey % 7"),
    ("or", lambda: Q.either(Q.same("a", "b"), F.col("a") == "<urn:k:0>"), "(n_regionkey > 0 AND c_custkey % 7 = n_nationkey % 7) OR c_custkey % 7 = 0"),
    ("and", lambda: Q.both(Q.different("a", "b"), F.col("a") == "<urn:k:1>"), "n_regionkey > 0 AND c_custkey % 7 <> n_nationkey % 7 AND c_custkey % 7 = 1"),
    ("unbound_false", lambda: Q.test(T.is_iri("b")), "n_regionkey > 0"),
):
    query(f"filter_{_name}", f"SELECT '<urn:x:' || c_custkey || '>' AS x {PAIRS} WHERE {_sql}")(lambda spark, d, f=_cond: _pairs(spark, d).where(f()).select("x"))


# Modifiers

#: n from -40 to 40 or so, and small divisors and exponents, some 0 and negative
NUMBERS = "(SELECT DISTINCT (p_size - 25)::BIGINT AS x, (p_partkey % 9 - 4)::BIGINT AS y FROM part)"


def _numbers(spark, d) -> DataFrame:
    p = read(spark, d, "part")
    return p.select((F.col("p_size") - 25).alias("x"), (F.col("p_partkey") % 9 - 4).alias("y")).distinct().select(T.integer("x").alias("x"), T.integer("y").alias("y"))


def _term(e: str) -> str:
    return f"'\"' || ({e})::BIGINT || @INT"


FLOOR = "(x // y - CASE WHEN x % y <> 0 AND (x < 0) <> (y < 0) THEN 1 ELSE 0 END)"
for _name, _vars, _binds, _where in (
    ("abs", ("a", "x"), {"a": "abs(x)"}, "true"),
    ("neg", ("a", "x"), {"a": "-x"}, "true"),
    ("sum", ("a", "x", "y"), {"a": "x + y"}, "true"),
    ("diff", ("a", "x", "y"), {"a": "x - y"}, "true"),
    ("prod", ("a", "x", "y"), {"a": "x * y"}, "true"),
    ("divmod", ("q", "r", "x", "y"), {"q": FLOOR, "r": f"x - y * {FLOOR}"}, "y <> 0"),
    ("power", ("a", "x", "y"), {"a": "CASE y WHEN 0 THEN 1 WHEN 1 THEN x WHEN 2 THEN x*x WHEN 3 THEN x*x*x ELSE x*x*x*x END"}, "y >= 0"),
):
    _out = ", ".join(f"{_term(e)} AS {v}" for v, e in _binds.items())
    query(f"mod_{_name}", f"SELECT {_term('x')} AS x, {_term('y')} AS y, {_out} FROM {NUMBERS} WHERE {_where}")(lambda spark, d, m=M.INTEGER[_name], v=_vars: m.apply(_numbers(spark, d), *v))
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(f"mod_{_name}", f"SELECT {_term('x')} AS x, {_term('y')} AS y FROM {NUMBERS} WHERE x {_op} y")(lambda spark, d, m=M.INTEGER[_name]: m.apply(_numbers(spark, d), "x", "y"))
for _name, _vars, _expr, _where in (
    ("sum_inverse", ("x", "y", "c"), "x - y", "true"),
    ("diff_inverse", ("x", "b", "y"), "x + y", "true"),
    ("prod_exact", ("x", "y", "c"), "x // y", "y <> 0 AND x % y = 0"),
    ("neg_inverse", ("x", "b"), "-x", "true"),
):
    _new = next(v for v in _vars if v not in "xy")
    query(f"mod_{_name}", f"SELECT {_term('x')} AS x, {_term('y')} AS y, {_term(_expr)} AS {_new} FROM {NUMBERS} WHERE {_where}")(lambda spark, d, m=M.INTEGER[_name.split('_')[0]], v=_vars: m.apply(_numbers(spark, d), *v))


@query("mod_abs_test", f"SELECT {_term('x')} AS x, {_term('y')} AS y FROM {NUMBERS} WHERE x = abs(y)")
def _(spark, d):
    return M.INTEGER["abs"].apply(_numbers(spark, d), "x", "y")


@query("mod_compose_sum_gt", f"SELECT {_term('x')} AS x, {_term('y')} AS y, {_term('x + y')} AS a FROM {NUMBERS} WHERE x + y > x")
def _(spark, d):
    steps = M.find_order({"x", "y"}, [M.Step(M.INTEGER["gt"], ("a", "x")), M.Step(M.INTEGER["sum"], ("a", "x", "y"))])
    return M.compose(*steps)(_numbers(spark, d))


@query("mod_total", f"SELECT {_term('x')} AS x, {_term('y')} AS y, {_term('x + y + x')} AS a FROM {NUMBERS}")
def _(spark, d):
    return M.total(_numbers(spark, d), "a", "x", "y", "x")


@query("canonical_int", "SELECT n_nationkey AS k, '\"' || n_nationkey || @INT AS v FROM nation")
def _(spark, d):
    odd = F.concat(F.lit('"+00'), "n_nationkey", F.lit(INT))
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), T.canonical(odd).alias("v"))


@query("str_plain_to_typed", "SELECT n_nationkey AS k, '\"' || n_name || '\"' || @STRING AS v FROM nation")
def _(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), T.plain_to_typed(T.plain("n_name")).alias("v"))


@query("str_typed_to_plain", "SELECT n_nationkey AS k, '\"' || n_name || '\"' AS v FROM nation")
def _(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), T.typed_to_plain(T.typed("n_name", STRING)).alias("v"))


for _name, _op in (("eq", "="), ("ne", "<>")):

    @query(f"str_{_name}", f"SELECT '\"' || p_type || '\"' || @STRING AS a, '\"' || b || '\"' || @STRING AS b, count(*) AS n FROM (SELECT p_type, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS b FROM part) WHERE p_type {_op} b GROUP BY ALL")
    def _(spark, d, m=M.STRING[_name]):
        other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
        p = read(spark, d, "part").select(T.typed("p_type", STRING).alias("a"), T.typed(other, STRING).alias("b"))
        return m.apply(p, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


# Construction and rules


@query("construct_simple", "SELECT '<urn:nation:' || n_nationkey || '>' AS s, '<urn:p:in>' AS p, '<urn:region:' || n_regionkey || '>' AS o FROM nation")
def _(spark, d):
    return Q.construct(Q.match(lift(spark, d, "nation"), P("?n <urn:p:n_regionkey> ?r")), P("?n <urn:p:in> ?r"))


@query("construct_multi_head", "SELECT '<urn:nation:' || n_nationkey || '>' AS s, '<urn:p:in>' AS p, '<urn:region:' || n_regionkey || '>' AS o FROM nation UNION SELECT '<urn:region:' || n_regionkey || '>', @TYPE, '<urn:class:place>' FROM nation")
def _(spark, d):
    return Q.construct(Q.match(lift(spark, d, "nation"), P("?n <urn:p:n_regionkey> ?r")), P("?n <urn:p:in> ?r . ?r rdf:type <urn:class:place>"))


@query("construct_drop_unbound", "SELECT '' AS s, '' AS p, '' AS o WHERE false")
def _(spark, d):
    return Q.construct(Q.match(lift(spark, d, "nation"), P("?n <urn:p:n_regionkey> ?r")), P("?n <urn:p:in> ?nowhere"))


@query("construct_blank", "SELECT '<urn:nation:' || n_nationkey || '>' AS s, '<urn:p:has>' AS p, '_:sk' || sha256('new|z|<urn:nation:' || n_nationkey || '>|<urn:region:' || n_regionkey || '>') AS o FROM nation")
def _(spark, d):
    return Q.construct_blank(Q.match(lift(spark, d, "nation"), P("?n <urn:p:n_regionkey> ?r")), P("?n <urn:p:has> ?z"))


@query("alloc_per_value", "SELECT '<urn:customer:' || c_custkey || '>' AS s, '<urn:p:group>' AS p, '_:sk' || sha256('alloc|\"' || c_mktsegment || '\"') AS o FROM customer")
def _(spark, d):
    rule = R.Rule("segments", P("?c <urn:p:c_mktsegment> ?m"), P("?c <urn:p:group> ?g"), R.allocate("g", "m"))
    return rule.forward(lift(spark, d, "customer"))


@query("fwd_rule_soldin", f"SELECT '<urn:orders:' || o_orderkey || '>' AS s, '<urn:p:soldIn>' AS p, '<urn:region:' || r_regionkey || '>' AS o FROM {CHAIN} WHERE r_name = 'ASIA'")
def _(spark, d):
    return R.Rule("soldIn", P(CHAIN_PATTERN), P("?ord <urn:p:soldIn> ?r")).forward(lift(spark, d, "orders", "customer", "nation", "region"))


@query("fwd_rule_grandparent", "SELECT DISTINCT '<urn:customer:' || c_custkey || '>' AS s, '<urn:p:region>' AS p, '<urn:region:' || n_regionkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return R.Rule("region", P("?c <urn:p:c_nationkey> ?n . ?n <urn:p:n_regionkey> ?r"), P("?c <urn:p:region> ?r")).forward(lift(spark, d, "customer", "nation"))


@query("fwd_rule_sibling_ne", "SELECT '<urn:nation:' || a.n_nationkey || '>' AS s, '<urn:p:near>' AS p, '<urn:nation:' || b.n_nationkey || '>' AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def _(spark, d):
    rule = R.Rule("near", P("?a <urn:p:n_regionkey> ?r . ?b <urn:p:n_regionkey> ?r"), P("?a <urn:p:near> ?b"), R.where(Q.different("a", "b")))
    return rule.forward(lift(spark, d, "nation"))


# Graphs as sets


def _halves(spark, d):
    """Two overlapping graphs: customers outside one segment, and customers without debt."""
    c = read(spark, d, "customer")
    arcs = lambda rows: rows.select(T.iri("urn:customer:", "c_custkey").alias("s"), F.lit("<urn:p:c_nationkey>").alias("p"), T.iri("urn:nation:", "c_nationkey").alias("o"))
    return arcs(c.where("c_mktsegment <> 'BUILDING'")), arcs(c.where("c_acctbal >= 0"))


HALF = "SELECT '<urn:customer:' || c_custkey || '>' AS s, '<urn:p:c_nationkey>' AS p, '<urn:nation:' || c_nationkey || '>' AS o FROM customer WHERE"
LEFT, RIGHT = "c_mktsegment <> 'BUILDING'", "c_acctbal >= 0"


@query("graph_add", f"{HALF} {LEFT} UNION {HALF} {RIGHT}")
def _(spark, d):
    return G.add(*_halves(spark, d))


@query("graph_delete", f"{HALF} {LEFT} AND NOT {RIGHT}")
def _(spark, d):
    return G.delete(*_halves(spark, d))


@query("graph_diff", f"SELECT *, '<' AS side FROM ({HALF} {LEFT} AND NOT {RIGHT}) UNION ALL SELECT *, '>' FROM ({HALF} {RIGHT} AND NOT {LEFT})")
def _(spark, d):
    return G.difference(*_halves(spark, d))


@query("graph_merge_count", "SELECT count(*) AS n FROM (SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(spark, d):
    g = read(spark, d, "nation").select(F.concat(F.lit("_:n"), "n_nationkey").alias("s"), F.lit("<urn:p:name>").alias("p"), T.plain("n_name").alias("o"), "n_regionkey")
    return G.merge(g.select(*G.SPO), g.where("n_regionkey < 3").select(*G.SPO)).agg(F.count("*").alias("n"))


@query("graph_subset", f"SELECT true AS inside, NOT EXISTS (SELECT 1 FROM customer WHERE {RIGHT} AND NOT {LEFT}) AS outside")
def _(spark, d):
    a, b = _halves(spark, d)
    return spark.createDataFrame([(G.contained(G.delete(a, b), a), G.contained(b, a))], "inside boolean, outside boolean")


@query("subject_tree", "SELECT '<urn:region:' || n_regionkey || '>' AS s, '<urn:p:holds>' AS p, '[' || array_to_string(list(DISTINCT '<urn:nation:' || n_nationkey || '>' ORDER BY '<urn:nation:' || n_nationkey || '>'), ', ') || ']' AS o FROM nation GROUP BY n_regionkey")
def _(spark, d):
    g = R.Rule("holds", P("?n <urn:p:n_regionkey> ?r"), P("?r <urn:p:holds> ?n")).forward(lift(spark, d, "nation"))
    return G.by_subject(g).select("s", "p", F.concat(F.lit("["), F.array_join("o", ", "), F.lit("]")).alias("o"))


# Built-in rules over an ontology for the tables

ONTOLOGY_SQL = f"""
o AS (
  SELECT DISTINCT '<urn:type:' || replace(p_type, ' ', '_') || '>' AS s, '{SUBCLASS}' AS p, '<urn:class:part>' AS o FROM part
  UNION SELECT DISTINCT '<urn:brand:' || replace(p_brand, ' ', '_') || '>', '{SUBCLASS}', '<urn:type:' || replace(p_type, ' ', '_') || '>' FROM part
  UNION VALUES ('<urn:class:part>', '{SUBCLASS}', '<urn:class:thing>'),
    ('<urn:p:o_custkey>', '{DOMAIN}', '<urn:class:orders>'), ('<urn:p:o_custkey>', '{RANGE}', '<urn:class:customer>'),
    ('<urn:p:c_nationkey>', '{SUBPROPERTY}', '<urn:p:locatedIn>'), ('<urn:p:n_regionkey>', '{SUBPROPERTY}', '<urn:p:locatedIn>'),
    ('<urn:p:locatedIn>', '{SUBPROPERTY}', '<urn:p:related>'), ('<urn:p:locatedIn>', '{DOMAIN}', '<urn:class:place>'),
    ('<urn:p:locatedIn>', '{RANGE}', '<urn:class:place>'), ('<urn:p:c_nationkey>', '{DOMAIN}', '<urn:class:customer>'), ('<urn:p:c_nationkey>', '{RANGE}', '<urn:class:place>'), ('<urn:class:place>', '{SUBCLASS}', '<urn:class:thing>'),
    ('<urn:p:x>', @TYPE, '<@RDFProperty>'), ('<urn:class:thing>', @TYPE, '<@RDFSClass>'), ('<urn:class:place>', @TYPE, '<@RDFSClass>'),
    ('<urn:list>', '<urn:p:uses>', '<@RDF_2>'), ('<@RDF_1>', @TYPE, '<@RDFSContainerMembershipProperty>'), ('<{INTEGER}>', @TYPE, '<@RDFSDatatype>'), ('<{STRING}>', @TYPE, '<@RDFSDatatype>')),
n AS (
  SELECT '<urn:customer:' || c_custkey || '>' AS s, '<urn:p:c_nationkey>' AS p, '<urn:nation:' || c_nationkey || '>' AS o FROM customer
  UNION SELECT '<urn:nation:' || n_nationkey || '>', '<urn:p:n_regionkey>', '<urn:region:' || n_regionkey || '>' FROM nation
  UNION SELECT '<urn:nation:' || n_nationkey || '>', '<urn:p:n_name>', '"' || n_name || '"' FROM nation
  UNION SELECT '<urn:region:' || r_regionkey || '>', '<@RDF_' || (r_regionkey + 1) || '>', '"' || r_regionkey || @INT FROM region
  UNION SELECT '<urn:part:' || p_partkey || '>', @TYPE, '<urn:brand:' || replace(p_brand, ' ', '_') || '>' FROM part),
g AS (SELECT * FROM o UNION SELECT * FROM n)"""


def _ontology(spark, d) -> DataFrame:
    p = read(spark, d, "part")
    kind, brand = T.iri("urn:type:", F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))), T.iri("urn:brand:", F.replace(F.col("p_brand"), F.lit(" "), F.lit("_")))
    fixed = [
        ("<urn:class:part>", SUBCLASS, "<urn:class:thing>"),
        ("<urn:p:o_custkey>", DOMAIN, "<urn:class:orders>"),
        ("<urn:p:o_custkey>", RANGE, "<urn:class:customer>"),
        ("<urn:p:c_nationkey>", SUBPROPERTY, "<urn:p:locatedIn>"),
        ("<urn:p:n_regionkey>", SUBPROPERTY, "<urn:p:locatedIn>"),
        ("<urn:p:locatedIn>", SUBPROPERTY, "<urn:p:related>"),
        ("<urn:p:locatedIn>", DOMAIN, "<urn:class:place>"),
        ("<urn:p:locatedIn>", RANGE, "<urn:class:place>"),
        ("<urn:p:c_nationkey>", DOMAIN, "<urn:class:customer>"),
        ("<urn:p:c_nationkey>", RANGE, "<urn:class:place>"),
        ("<urn:class:place>", SUBCLASS, "<urn:class:thing>"),
        ("<urn:p:x>", TYPE, f"<{RDF}Property>"),
        ("<urn:class:thing>", TYPE, f"<{RDFS}Class>"),
        ("<urn:class:place>", TYPE, f"<{RDFS}Class>"),
        ("<urn:list>", "<urn:p:uses>", f"<{RDF}_2>"),
        (f"<{RDF}_1>", TYPE, f"<{RDFS}ContainerMembershipProperty>"),
        (f"<{INTEGER}>", TYPE, f"<{RDFS}Datatype>"),
        (f"<{STRING}>", TYPE, f"<{RDFS}Datatype>"),
    ]
    g = graph_of(spark, fixed)
    g = g.union(p.select(kind, F.lit(SUBCLASS), F.lit("<urn:class:part>")).distinct()).union(p.select(brand, F.lit(SUBCLASS), kind).distinct()).union(p.select(T.iri("urn:part:", "p_partkey"), F.lit(TYPE), brand))
    data = lift(spark, d, "customer", "nation").where(F.col("p").isin("<urn:p:c_nationkey>", "<urn:p:n_regionkey>", "<urn:p:n_name>"))
    members = read(spark, d, "region").select(T.iri("urn:region:", "r_regionkey"), T.iri(f"{RDF}_", F.col("r_regionkey") + 1), T.integer("r_regionkey"))
    return g.union(data).union(members).distinct()


_SK = "'_:sk' || sha256('rdf:lg|' || o)"
_TYPED = {
    "rdf_r1": f"SELECT DISTINCT p AS s, @TYPE AS p, '<@RDFProperty>' AS o FROM g",
    "rdf_lg": f"SELECT s, p, {_SK} AS o FROM g WHERE o LIKE '\"%' UNION SELECT {_SK}, '{ALLOCATED}', o FROM g WHERE o LIKE '\"%'",
    "rdf_cp1": "SELECT DISTINCT p AS s, @TYPE AS p, '<@RDFProperty>' AS o FROM g WHERE regexp_matches(p, '^<@RDF_[0-9]*>$')",
    "rdf_cp2": "SELECT DISTINCT s, @TYPE AS p, '<@RDFProperty>' AS o FROM g WHERE regexp_matches(s, '^<@RDF_[0-9]*>$')",
    "rdf_cp3": "SELECT DISTINCT o AS s, @TYPE AS p, '<@RDFProperty>' AS o FROM g WHERE regexp_matches(o, '^<@RDF_[0-9]*>$')",
    "rdfs_r2": f"SELECT DISTINCT g.s, @TYPE AS p, d.o FROM g JOIN g d ON d.s = g.p AND d.p = '{DOMAIN}'",
    "rdfs_r3": f"SELECT DISTINCT g.o AS s, @TYPE AS p, d.o FROM g JOIN g d ON d.s = g.p AND d.p = '{RANGE}' WHERE g.o NOT LIKE '\"%'",
    "rdfs_r4a": "SELECT DISTINCT s, @TYPE AS p, '<@RDFSResource>' AS o FROM g",
    "rdfs_r4b": "SELECT DISTINCT o AS s, @TYPE AS p, '<@RDFSResource>' AS o FROM g WHERE o NOT LIKE '\"%'",
    "rdfs_r5": f"SELECT DISTINCT a.s, '{SUBPROPERTY}' AS p, b.o FROM g a JOIN g b ON a.o = b.s AND a.p = '{SUBPROPERTY}' AND b.p = a.p",
    "rdfs_r6": f"SELECT s, '{SUBPROPERTY}' AS p, s AS o FROM g WHERE p = @TYPE AND o = '<@RDFProperty>'",
    "rdfs_r7": f"SELECT DISTINCT g.s, d.o AS p, g.o FROM g JOIN g d ON d.s = g.p AND d.p = '{SUBPROPERTY}'",
    "rdfs_r8": f"SELECT s, '{SUBCLASS}' AS p, '<@RDFSResource>' AS o FROM g WHERE p = @TYPE AND o = '<@RDFSClass>'",
    "rdfs_r9": f"SELECT DISTINCT t.s, @TYPE AS p, c.o FROM g t JOIN g c ON t.o = c.s AND c.p = '{SUBCLASS}' WHERE t.p = @TYPE",
    "rdfs_r10": f"SELECT s, '{SUBCLASS}' AS p, s AS o FROM g WHERE p = @TYPE AND o = '<@RDFSClass>'",
    "rdfs_r11": f"SELECT DISTINCT a.s, '{SUBCLASS}' AS p, b.o FROM g a JOIN g b ON a.o = b.s AND a.p = '{SUBCLASS}' AND b.p = a.p",
    "rdfs_r12": f"SELECT s, '{SUBPROPERTY}' AS p, '<@RDFSmember>' AS o FROM g WHERE p = @TYPE AND o = '<@RDFSContainerMembershipProperty>'",
    "rdfs_r13": f"SELECT s, '{SUBCLASS}' AS p, '<@RDFSLiteral>' AS o FROM g WHERE p = @TYPE AND o = '<@RDFSDatatype>'",
    "rdfs_cp11": "SELECT DISTINCT p AS s, @TYPE AS p, '<@RDFSContainerMembershipProperty>' AS o FROM g WHERE regexp_matches(p, '^<@RDF_[0-9]*>$')",
    "rdfs_cp21": f"SELECT DISTINCT p AS s, '{DOMAIN}' AS p, '<@RDFSResource>' AS o FROM g WHERE regexp_matches(p, '^<@RDF_[0-9]*>$')",
    "rdfs_cp31": f"SELECT DISTINCT p AS s, '{RANGE}' AS p, '<@RDFSResource>' AS o FROM g WHERE regexp_matches(p, '^<@RDF_[0-9]*>$')",
    **{
        f"rdfs_cp{i}{j}": f"SELECT DISTINCT {c} AS s, {p} AS p, {o} AS o FROM g WHERE regexp_matches({c}, '^<@RDF_[0-9]*>$')"
        for i, p, o in ((1, "@TYPE", "'<@RDFSContainerMembershipProperty>'"), (2, f"'{DOMAIN}'", "'<@RDFSResource>'"), (3, f"'{RANGE}'", "'<@RDFSResource>'"))
        for j, c in ((2, "g.s"), (3, "g.o"))
    },
    "extensional_ext1": f"SELECT DISTINCT a.s, '{DOMAIN}' AS p, b.o FROM g a JOIN g b ON a.o = b.s AND a.p = '{DOMAIN}' AND b.p = '{SUBCLASS}'",
    "extensional_ext2": f"SELECT DISTINCT a.s, '{RANGE}' AS p, b.o FROM g a JOIN g b ON a.o = b.s AND a.p = '{RANGE}' AND b.p = '{SUBCLASS}'",
    "extensional_ext3": f"SELECT DISTINCT b.s, '{DOMAIN}' AS p, a.o FROM g a JOIN g b ON a.s = b.o AND a.p = '{DOMAIN}' AND b.p = '{SUBPROPERTY}'",
    "extensional_ext4": f"SELECT DISTINCT b.s, '{RANGE}' AS p, a.o FROM g a JOIN g b ON a.s = b.o AND a.p = '{RANGE}' AND b.p = '{SUBPROPERTY}'",
    "rdfd_r2": f"SELECT s, p, '\"' || regexp_extract(o, '\"([0-9]+)\"', 1) || @INT AS o FROM g WHERE o LIKE '%' || @INT",
    "xsd_string_ls": "SELECT s, p, o || @STRING AS o FROM g WHERE o LIKE '\"%\"'",
}
for _name, _sql in _TYPED.items():
    _set, _, _rule = _name.rpartition("_")
    query(_name, f"WITH {ONTOLOGY_SQL} {_sql}")(lambda spark, d, r=f"{_set}:{_rule}": R.find_rule(r).forward(_ontology(spark, d)))


_TOP = [(TYPE, SUBPROPERTY, "<urn:p:locatedIn>"), (SUBCLASS, SUBPROPERTY, "<urn:p:locatedIn>"), (SUBPROPERTY, SUBPROPERTY, "<urn:p:locatedIn>")]
for _name, _prop, _what, _end in (("ext5", TYPE, "Resource", DOMAIN), ("ext6", SUBCLASS, "Class", DOMAIN), ("ext7", SUBPROPERTY, "Property", DOMAIN), ("ext8", SUBCLASS, "Class", RANGE), ("ext9", SUBPROPERTY, "Property", RANGE)):
    query(f"extensional_{_name}", f"WITH {ONTOLOGY_SQL}, t AS (SELECT * FROM g UNION VALUES {', '.join(repr(x) for x in _TOP)}) SELECT DISTINCT '<@RDFS{_what}>' AS s, '{SUBCLASS}' AS p, b.o FROM t a JOIN t b ON a.s = '{_prop}' AND a.p = '{SUBPROPERTY}' AND b.s = a.o AND b.p = '{_end}'")(
        lambda spark, d, r=f"extensional:{_name}": R.find_rule(r).forward(_ontology(spark, d).union(graph_of(spark, _TOP)))
    )


@query("xsd_string_sl", f"WITH {ONTOLOGY_SQL} SELECT s, p, o FROM g WHERE o LIKE '\"%\"'")
def _(spark, d):
    return R.find_rule("xsd_string:sl").forward(R.find_rule("xsd_string:ls").forward(_ontology(spark, d)))


def _allocated(spark, d) -> DataFrame:
    g = _ontology(spark, d)
    xml = read(spark, d, "region").select(T.iri("urn:region:", "r_regionkey").alias("s"), F.lit("<urn:p:xml>").alias("p"), T.typed("r_name", XML_LITERAL).alias("o"))
    return R.find_rule("rdf:lg").forward(g.union(xml))


_ALLOCATED = f"""WITH {ONTOLOGY_SQL}, x AS (SELECT * FROM g UNION SELECT '<urn:region:' || r_regionkey || '>', '<urn:p:xml>', '"' || r_name || '"^^<{XML_LITERAL}>' FROM region),
l AS (SELECT s, p, {_SK} AS b, o FROM x WHERE o LIKE '\"%')"""
for _name, _sql in {
    "rdf_r2": f"SELECT DISTINCT b AS s, @TYPE AS p, '<{XML_LITERAL}>' AS o FROM l WHERE o LIKE '%^^<{XML_LITERAL}>'",
    "rdfs_r1": "SELECT DISTINCT b AS s, @TYPE AS p, '<@RDFSLiteral>' AS o FROM l WHERE o LIKE '%\"'",
}.items():
    _set, _, _rule = _name.rpartition("_")
    query(_name, f"{_ALLOCATED} {_sql}")(lambda spark, d, r=f"{_set}:{_rule}": R.find_rule(r).forward(_allocated(spark, d)))


@query("rdf_gl", f"{_ALLOCATED} SELECT s, p, b AS o FROM l UNION SELECT b, '{ALLOCATED}', b FROM l")
def _(spark, d):
    xml = read(spark, d, "region").select(T.iri("urn:region:", "r_regionkey").alias("s"), F.lit("<urn:p:xml>").alias("p"), T.typed("r_name", XML_LITERAL).alias("o"))
    return R.find_rule("rdf:gl").forward(G.add(_ontology(spark, d).union(xml), _allocated(spark, d)))


@query("rdfd_r1", f"{_ALLOCATED} SELECT DISTINCT b AS s, @TYPE AS p, '<{INTEGER}>' AS o FROM l WHERE o LIKE '%' || @INT")
def _(spark, d):
    types = graph_of(spark, [(f"<{INTEGER}>", TYPE, f"<{RDFS}Datatype>")])
    return R.find_rule("rdfd:r1").forward(_allocated(spark, d).union(types))


for _name, _p in (("rdfs_r11_closure", SUBCLASS), ("rdfs_r5_closure", SUBPROPERTY)):

    @query(_name, f"WITH RECURSIVE {ONTOLOGY_SQL}, r AS (SELECT s, o FROM g WHERE p = '{_p}' UNION SELECT r.s, g.o FROM r JOIN g ON r.o = g.s AND g.p = '{_p}') SELECT s, o FROM r")
    def _(spark, d, p=_p):
        return R.transitive(_ontology(spark, d).where(F.col("p") == p))


@query(
    "rdfs_full_closure",
    f"""WITH RECURSIVE {ONTOLOGY_SQL},
sp AS (SELECT s, o FROM g WHERE p = '{SUBPROPERTY}' UNION SELECT sp.s, g.o FROM sp JOIN g ON sp.o = g.s AND g.p = '{SUBPROPERTY}'),
sc AS (SELECT s, o FROM g WHERE p = '{SUBCLASS}' UNION SELECT sc.s, g.o FROM sc JOIN g ON sc.o = g.s AND g.p = '{SUBCLASS}'),
a AS (SELECT * FROM g UNION SELECT s, '{SUBPROPERTY}', o FROM sp UNION SELECT s, '{SUBCLASS}', o FROM sc UNION SELECT g.s, sp.o, g.o FROM g JOIN sp ON g.p = sp.s),
t AS (SELECT * FROM a UNION SELECT a.s, @TYPE, d.o FROM a JOIN g d ON d.s = a.p AND d.p = '{DOMAIN}' UNION SELECT a.o, @TYPE, d.o FROM a JOIN g d ON d.s = a.p AND d.p = '{RANGE}' WHERE a.o NOT LIKE '"%')
SELECT * FROM t UNION SELECT t.s, @TYPE, sc.o FROM t JOIN sc ON t.o = sc.s WHERE t.p = @TYPE""",
)
def _(spark, d):
    return R.rdfs_closure(_ontology(spark, d))


@query("axioms_count", "SELECT 48::BIGINT AS n")
def _(spark, d):
    return graph_of(spark, R.RDF_AXIOMS + R.RDFS_AXIOMS).distinct().agg(F.count("*").alias("n"))


# Backward steps


@query("bwd_candidates", "SELECT * FROM (VALUES (0, 0, 'a', '<urn:x>'), (0, 0, 'c', '<urn:y>'), (1, 0, 'a', '<urn:x>'), (1, 0, 'c', '<urn:z>')) t(goal, head, variable, term)")
def _(spark, d):
    goals = P("<urn:x> <urn:grand> <urn:y> . <urn:x> <urn:grand> <urn:z>")
    return R.Rule("grand", P("?a <urn:child> ?b . ?b <urn:child> ?c"), P("?a <urn:grand> ?c")).backward(goals, spark)


@query("bwd_filter_all", "SELECT o_custkey AS alternative, '<urn:orders:' || o_orderkey || '>' AS x FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    b = read(spark, d, "orders").select(F.col("o_custkey").alias("alternative"), T.iri("urn:orders:", "o_orderkey").alias("x"), T.plain("o_orderstatus").alias("status"))
    return Q.keep_alternatives(b, F.col("status") != '"P"').select("alternative", "x")


# Class restrictions


def _sums(spark, d, wrong: bool) -> DataFrame:
    """A bag node for each part with size and key as second and third members, and for some the sum as first."""
    p = read(spark, d, "part")
    node = F.concat(F.lit("_:n"), "p_partkey")
    member = lambda i, v, rows=p: rows.select(node.alias("s"), F.lit(f"<{RDF}_{i}>").alias("p"), T.integer(v).alias("o"))
    g = p.select(node.alias("s"), F.lit(TYPE).alias("p"), F.lit("<urn:Sum>").alias("o"))
    third = p.where("p_partkey % 3 = 0")
    given = F.col("p_size") + F.col("p_partkey") + (F.lit(1) if wrong else F.lit(0))
    return g.union(member(2, "p_size")).union(member(3, "p_partkey")).union(member(1, given, third))


@query("restriction_sum_forward", f"SELECT '_:n' || p_partkey AS s, '<@RDF_1>' AS p, '\"' || (p_size + p_partkey) || @INT AS o FROM part WHERE p_partkey % 3 <> 0")
def _(spark, d):
    return E.restrict(_sums(spark, d, False), "<urn:Sum>", M.INTEGER["sum"])


@query("restriction_false_graph", f"SELECT '_:a' AS s, '{E.FALSE}' AS p, '_:b' AS o")
def _(spark, d):
    return E.restrict(_sums(spark, d, True), "<urn:Sum>", M.INTEGER["sum"])


@query("restriction_cardinality", f"SELECT '<urn:customer:' || o_custkey || '>' AS s, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def _(spark, d):
    g = lift(spark, d, "orders").where(F.col("p") == "<urn:p:o_custkey>")
    return g.groupBy(F.col("o").alias("s")).agg(F.count("*").alias("n")).where("n > 10")


# Partial orders, isomorphism, partitions

for _name, _least, _op in (("skyline_maxima", False, ">"), ("skyline_minima", True, "<")):

    @query(_name, f"SELECT DISTINCT p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size {_op}= a.p_size AND b.p_retailprice {_op}= a.p_retailprice AND (b.p_size {_op} a.p_size OR b.p_retailprice {_op} a.p_retailprice))")
    def _(spark, d, least=_least):
        return E.maxima(read(spark, d, "part"), ["p_size", "p_retailprice"], least)


def _ring(spark, d, stem: str, shift: int) -> DataFrame:
    n = read(spark, d, "nation")
    at = lambda c: F.concat(F.lit(f"_:{stem}"), ((c * shift) % 25).cast("string"))
    return n.select(at(F.col("n_nationkey")).alias("s"), F.lit("<urn:p:next>").alias("p"), at((F.col("n_nationkey") + 1) % 25).alias("o"))


@query("iso_equal", "SELECT true AS same")
def _(spark, d):
    return spark.createDataFrame([(E.isomorphic(_ring(spark, d, "a", 1), _ring(spark, d, "b", 2)),)], "same boolean")


@query("iso_not_equal", "SELECT false AS same")
def _(spark, d):
    a = _ring(spark, d, "a", 1)
    b = _ring(spark, d, "b", 2).where("s <> '_:b0'").union(graph_of(spark, [("_:b0", "<urn:p:next>", "_:b0")]))
    return spark.createDataFrame([(E.isomorphic(a, b),)], "same boolean")


@query("colour_refine_1", "SELECT n, count(*) AS nodes FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL) GROUP BY n")
def _(spark, d):
    g = read(spark, d, "nation").select(T.iri("urn:nation:", F.lit(0)).alias("s"), F.lit("<urn:p:in>").alias("p"), F.concat(F.lit("_:r"), "n_regionkey").alias("o"), "n_nationkey")
    g = g.select(F.concat(F.lit("<urn:nation:"), "n_nationkey", F.lit(">")).alias("s"), "p", "o")
    c = E.colours(g, 1).where(T.is_blank("term"))
    sizes = g.groupBy(F.col("o").alias("term")).agg(F.count("*").alias("n"))
    return c.join(sizes, "term").groupBy("n").agg(F.countDistinct("colour").alias("nodes"))


@query("partition_indegree", "SELECT '<urn:nation:' || n_nationkey || '>' AS term, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def _(spark, d):
    g = lift(spark, d, "nation", "customer")
    return E.references(g).where(F.col("term").startswith("<urn:nation:"))


@query("partition_top_level", "SELECT '_:n' || n_regionkey AS term FROM nation GROUP BY n_regionkey HAVING count(*) <> 1")
def _(spark, d):
    n = read(spark, d, "nation")
    g = n.select(F.concat(F.lit("_:n"), "n_regionkey").alias("s"), F.lit("<urn:p:k>").alias("p"), F.concat(F.lit("_:n"), "n_regionkey").alias("o"), "n_nationkey")
    return E.top_level(g)


# URIs and dates

URL = "SELECT page_id, url FROM pages"


@query("uri_split", "SELECT page_id, substr(url, 1, length(url) - length(regexp_extract(url, '([A-Za-z_][A-Za-z0-9_.-]*)$', 1))) AS namespace, regexp_extract(url, '([A-Za-z_][A-Za-z0-9_.-]*)$', 1) AS local FROM pages")
def _(spark, d):
    ns, local = T.split_uri("url")
    return read(spark, d, "pages").select("page_id", ns.alias("namespace"), local.alias("local"))


@query("uri_fragment", "SELECT page_id, url || '#p' || page_id AS full, url AS base, 'p' || page_id AS fragment FROM pages WHERE url NOT LIKE '%#%'")
def _(spark, d):
    p = read(spark, d, "pages").where(~F.col("url").contains("#"))
    full = U.with_fragment("url", F.concat(F.lit("p"), "page_id"))
    return p.select("page_id", full.alias("full"), U.without_fragment(full).alias("base"), U.fragment(full).alias("fragment"))


@query("uri_valid", "SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:([A-Za-z0-9_.!~*''();/?:@&=+$,-]|\\[|\\]|%[0-9A-Fa-f]{2})+$') AS absolute FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", U.is_absolute("url").alias("absolute"))


@query("uri_resolve", "SELECT page_id, 'http://h.example/a/x' || page_id || '/c' AS full FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", U.resolve(F.lit("http://h.example/a/b/z?q"), F.concat(F.lit("./../x"), "page_id", F.lit("/./c"))).alias("full"))


@query("date_days1900", "SELECT o_orderkey, date_diff('day', DATE '1900-01-01', o_orderdate::DATE)::INTEGER AS days FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", U.day_number(F.col("o_orderdate").cast("date")).alias("days"))


@query("date_from_days", "SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS day FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", U.from_day_number(U.day_number(F.col("o_orderdate").cast("date"))).cast("string").alias("day"))


@query("date_add", "SELECT event_id, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS later FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", U.show_time(U.add_minutes("ts", F.lit(90))).alias("later"))


@query("date_leap", "SELECT DISTINCT year(o_orderdate)::INTEGER AS y, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap, day(last_day(make_date(year(o_orderdate), 2, 1)))::INTEGER AS february FROM orders")
def _(spark, d):
    y = read(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return y.select("y", U.leap_year("y").alias("leap"), U.days_in_month("y", F.lit(2)).alias("february"))


@query("date_tz_norm", "SELECT event_id, strftime(ts - INTERVAL (event_id % 24 - 12) HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format(U.to_utc("ts", (F.col("event_id") % 24 - 12) * 60), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("uri_escape", "SELECT n_nationkey, replace(n_name, ' ', '%20') || '%2F%25' AS escaped, n_name || '/%' AS back FROM nation")
def _(spark, d):
    escaped = U.escape(F.concat("n_name", F.lit("/%")))
    return read(spark, d, "nation").select("n_nationkey", escaped.alias("escaped"), U.unescape(escaped).alias("back"))


# Text and proofs


@query("text_lines", "SELECT '<urn:nation:' || n_nationkey || '> <urn:p:n_name> \"' || n_name || '\" ; <urn:p:n_regionkey> <urn:region:' || n_regionkey || '> .' AS value FROM nation")
def _(spark, d):
    return lines_of(lift(spark, d, "nation").where(F.col("p") != TYPE))


@query("proof_check", "SELECT 'good' AS proof, 'valid' AS verdict UNION ALL SELECT 'unknown rule', 'Invalid step: rule other not present' UNION ALL SELECT 'unproved', 'Result not demonstrated'")
def _(spark, d):
    rule = R.Rule("region", P("?c <urn:p:c_nationkey> ?n . ?n <urn:p:n_regionkey> ?r"), P("?c <urn:p:region> ?r"))
    data = lift(spark, d, "customer", "nation")
    graphs = {"data": data, "claim": rule.forward(data).where(F.col("s") == "<urn:customer:1>")}

    def verdict(name: str, steps: int) -> str:
        return E.Proof(graphs, [], ["data"], [E.Step(name, ["data"], "claim")][:steps], "claim", [rule]).explain() or "valid"

    return spark.createDataFrame([("good", verdict("region", 1)), ("unknown rule", verdict("other", 1)), ("unproved", verdict("region", 0))], "proof string, verdict string")


@query("top_usage", "SELECT p, count(*) AS n FROM (SELECT unnest(['<urn:p:n_name>', '<urn:p:n_regionkey>', @TYPE]) AS p FROM nation) GROUP BY p")
def _(spark, d):
    return lift(spark, d, "nation").groupBy("p").agg(F.count("*").alias("n"))


# Relations and the restrictions that a graph defines


def _pairs_of(spark, d, first: str, second: str) -> DataFrame:
    """x and y as terms, one of them open, by the key modulo 3."""
    part = read(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).alias("x"), (F.col("p_partkey") % 9 - 4).alias("y"))
    k = F.col("p_partkey") % 3
    return part.select("p_partkey", F.when(k != 1, T.integer(first)).alias("a"), F.when(k != 2, T.integer(second)).alias("b"))


SIGNED = "(SELECT p_partkey, (p_size - 25)::BIGINT AS x, (p_partkey % 9 - 4)::BIGINT AS y FROM part)"


@query("relation_abs", f"SELECT p_partkey, {_term('abs(x)')} AS a, {_term('x')} AS b FROM {SIGNED} WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, {_term('x')}, {_term('x')} FROM {SIGNED} WHERE p_partkey % 3 <> 1 AND x >= 0 UNION ALL SELECT p_partkey, {_term('x')}, {_term('-x')} FROM {SIGNED} WHERE p_partkey % 3 = 2 AND x > 0")
def _(spark, d):
    done = L.INTEGER_RELATIONS["abs"].complete(_pairs_of(spark, d, "x", "x"), ["a", "b"])
    return done.where("consistent").select("p_partkey", F.explode("tuples").alias("t")).select("p_partkey", F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b"))


for _name, _op in (("lt", "<"), ("ge", ">=")):

    @query(f"relation_{_name}", f"SELECT p_partkey, NOT (p_partkey % 3 = 0 AND NOT x {_op} y) AS consistent, CASE WHEN p_partkey % 3 = 0 AND x {_op} y THEN 1 WHEN p_partkey % 3 = 0 THEN -1 ELSE 0 END::INTEGER AS n FROM {SIGNED}")
    def _(spark, d, r=L.INTEGER_RELATIONS[_name]):
        return r.complete(_pairs_of(spark, d, "x", "y"), ["a", "b"]).select("p_partkey", "consistent", F.coalesce(F.size("tuples"), F.lit(-1)).alias("n"))


for _name, _gap, _expr in (("sum", 0, "x + y"), ("sum", 1, "x - y"), ("diff", 2, "y - x"), ("prod", 0, "x * y")):

    @query(f"relation_{_name}_{_gap}", f"SELECT p_partkey, {_term(_expr)} AS v FROM {SIGNED}")
    def _(spark, d, r=L.INTEGER_RELATIONS[_name], gap=_gap):
        part = read(spark, d, "part").select("p_partkey", T.integer(F.col("p_size") - 25).alias("x"), T.integer(F.col("p_partkey") % 9 - 4).alias("y"))
        names = ["x", "y"]
        names.insert(gap, "gap")
        # what is asked for stands at the gap; the others are given in order, a difference's from its end
        done = r.complete(part.withColumn("gap", F.lit(None).cast("string")), names if gap < 2 else ["x", "y", "gap"])
        return done.select("p_partkey", F.get(F.get("tuples", F.lit(0)), F.lit(gap)).alias("v"))


def _instances(spark, d, of_class: str, *members) -> DataFrame:
    """A node for each part, of a class, with rdf:_i the i-th of ``members`` (None: not given)."""
    p = read(spark, d, "part")
    node = F.concat(F.lit("_:n"), "p_partkey")
    g = p.select(node.alias("s"), F.lit(TYPE).alias("p"), F.lit(of_class).alias("o"))
    for i, m in enumerate(members, 1):
        if m is not None:
            g = g.union(p.select(node, F.lit(f"<{RDF}_{i}>"), m))
    return g


def _built_in(spark, name: str) -> L.Restriction:
    return next(r for r in L.built_in_classes() if r.of_class == name)


@query("restriction_find", "SELECT count(*) AS classes, sum(n)::BIGINT AS properties, sum(1)::BIGINT AS limits FROM (VALUES (2), (2), (3), (3), (3), (4), (3), (2), (2), (2), (2), (2), (2), (2), (2)) t(n)")
def _(spark, d):
    found = L.find_restrictions(L.restriction_graph(spark))
    return found.agg(F.count("*").alias("classes"), F.sum(F.size("properties")).alias("properties"), F.sum("most").alias("limits"))


_X, _Y = "(p_size - 25)", "(p_partkey % 9 + 1)"
for _name, _given, _new in (
    ("Abs", (None, "x"), {1: f"abs({_X})"}),
    ("Neg", ("x", None), {2: f"-{_X}"}),
    ("Sum", (None, "x", "y"), {1: f"{_X} + {_Y}"}),
    ("Diff", ("x", "y", None), {3: f"{_Y} - {_X}"}),
    ("Prod", (None, "x", "y"), {1: f"{_X} * {_Y}"}),
    ("DivMod", (None, None, "x", "y"), {1: f"floor({_X} / {_Y})", 2: f"(({_X} % {_Y}) + {_Y}) % {_Y}"}),
    ("Lt", ("x", "z"), {}),
):
    _sql = " UNION ALL ".join(f"SELECT '_:n' || p_partkey AS s, '<@RDF_{i}>' AS p, {_term(e)} AS o FROM part" for i, e in _new.items()) or "SELECT '' AS s, '' AS p, '' AS o WHERE false"

    @query(f"restriction_{_name.lower()}", _sql)
    def _(spark, d, name=f"<{L.XSD_INTEGER_NS}{_name}>", given=_given):
        columns = {"x": T.integer(F.col("p_size") - 25), "y": T.integer(F.col("p_partkey") % 9 + 1), "z": T.integer(F.col("p_size") + 1)}
        return L.apply_restriction(_instances(spark, d, name, *(columns.get(c) for c in given)), _built_in(spark, name))


@query("restriction_max_cardinality", f"SELECT '_:a' AS s, '{L.FALSE}' AS p, '_:b' AS o")
def _(spark, d):
    """Two second members make two sums of each node, where one is allowed."""
    name = f"<{L.XSD_INTEGER_NS}Sum>"
    g = _instances(spark, d, name, None, T.integer("p_size"), T.integer("p_partkey"))
    more = read(spark, d, "part").select(F.concat(F.lit("_:n"), "p_partkey"), F.lit(f"<{RDF}_2>"), T.integer(F.col("p_size") + 1))
    return L.apply_restriction(g.union(more), _built_in(spark, name))


# Backward chaining over frames of goals


@query("bwd_alternatives", "SELECT '<urn:orders:' || o_orderkey || '>' AS claim, count(*)::BIGINT AS n, sum(bindings)::BIGINT AS bindings FROM (SELECT o_orderkey, 2 AS bindings FROM orders, (VALUES (1), (2), (3), (4)) t(i)) GROUP BY o_orderkey")
def _(spark, d):
    """Two goals an order, each of which two heads fit."""
    heads = P("?a <urn:p:soldTo> ?c . ?x <urn:p:soldTo> ?y . ?c <urn:p:bought> ?a")
    o = read(spark, d, "orders").select(T.iri("urn:orders:", "o_orderkey").alias("claim"), T.iri("urn:customer:", "o_custkey").alias("c"))
    goals = o.select("claim", F.posexplode(F.array("c", F.lit("<urn:any>"))).alias("goal", "o")).select("claim", "goal", F.col("claim").alias("s"), F.lit("<urn:p:soldTo>").alias("p"), "o")
    rows = C.alternatives(goals, C.unifiers(goals, heads))
    return rows.groupBy("claim").agg(F.count("*").alias("n"), F.sum(F.size("bindings")).alias("bindings"))


@query("bwd_support", "SELECT '<urn:orders:' || o_orderkey || '>' AS claim, 0 AS alternative, '<urn:orders:' || o_orderkey || '>' AS s, '<urn:p:o_custkey>' AS p, '_:sk' || sha256('soldIn|c|o=<urn:orders:' || o_orderkey || '>|r=<urn:region:' || o_custkey % 5 || '>') AS o FROM orders UNION ALL SELECT '<urn:orders:' || o_orderkey || '>', 0, '_:sk' || sha256('soldIn|c|o=<urn:orders:' || o_orderkey || '>|r=<urn:region:' || o_custkey % 5 || '>'), '<urn:p:region>', '<urn:region:' || o_custkey % 5 || '>' FROM orders")
def _(spark, d):
    rule = R.Rule("soldIn", P("?o <urn:p:o_custkey> ?c . ?c <urn:p:region> ?r"), P("?o <urn:p:soldIn> ?r"))
    key = T.iri("urn:orders:", "o_orderkey")
    goals = read(spark, d, "orders").select(key.alias("claim"), F.lit(0).alias("goal"), key.alias("s"), F.lit("<urn:p:soldIn>").alias("p"), T.iri("urn:region:", F.col("o_custkey") % 5).alias("o"))
    return C.backward_apply(rule, goals)


@query("instance_entails", "SELECT true AS whole, false AS part")
def _(spark, d):
    g = read(spark, d, "region").select(T.iri("urn:region:", "r_regionkey").alias("s"), F.lit("<urn:p:name>").alias("p"), T.plain("r_name").alias("o"))
    names = [r.r_name for r in read(spark, d, "region").orderBy("r_regionkey").collect()]
    claim = [(f"_:r{i}", "<urn:p:name>", f'"{n}"') for i, n in enumerate(names)]
    return spark.createDataFrame([(Q.instance_entails(g, claim), Q.instance_entails(g, claim[1:]))], "whole boolean, part boolean")


# Named graphs


def _quads(spark, d, shift: int) -> DataFrame:
    n = read(spark, d, "nation")
    return n.select(T.iri("urn:g:", "n_regionkey").alias("g"), T.iri("urn:nation:", "n_nationkey").alias("s"), F.lit("<urn:p:k>").alias("p"), T.integer(F.when(F.col("n_regionkey") == 2, F.col("n_nationkey") + shift).otherwise(F.col("n_nationkey"))).alias("o"))


@query("named_same", "SELECT '<urn:g:' || r_regionkey || '>' AS g, r_regionkey <> 2 AS same FROM region")
def _(spark, d):
    return N.same_formulae(_quads(spark, d, 0), _quads(spark, d, 1))


@query("named_set", "SELECT '<urn:g:1>' AS g, '<urn:nation:' || n_nationkey || '>' AS s, '<urn:p:k>' AS p, '\"' || n_nationkey || @INT AS o FROM nation WHERE n_regionkey = 3 UNION ALL SELECT '<urn:g:' || n_regionkey || '>', '<urn:nation:' || n_nationkey || '>', '<urn:p:k>', '\"' || n_nationkey || @INT FROM nation WHERE n_regionkey <> 1")
def _(spark, d):
    q = _quads(spark, d, 0)
    return N.with_formula(q, "<urn:g:1>", N.formula(q, "<urn:g:3>"))


# Circles of blank nodes


@query("partition_circles", "SELECT min('_:n' || n_nationkey) AS term FROM nation GROUP BY n_regionkey")
def _(spark, d):
    """The nations of a region refer to each other in a circle."""
    listed = read(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("x"))
    ring = listed.select("x", F.posexplode("x").alias("i", "k")).select("k", F.get("x", (F.col("i") + 1) % F.size("x")).alias("next"))
    return E.top_level(ring.select(F.concat(F.lit("_:n"), "k").alias("s"), F.lit("<urn:p:next>").alias("p"), F.concat(F.lit("_:n"), "next").alias("o")))


# More of URIs, dates and values


@query("uri_relativise", "SELECT page_id, '../../x/' || page_id || '?q' AS up, 'd' || page_id AS beside, '//k/' || page_id AS away, '/z/' || page_id AS root FROM pages")
def _(spark, d):
    base, k = F.lit("http://h/a/b/c/d"), F.col("page_id").cast("string")
    to = lambda *x: U.relativise(base, F.concat(*x))
    return read(spark, d, "pages").select("page_id", to(F.lit("http://h/a/x/"), k, F.lit("?q")).alias("up"), to(F.lit("http://h/a/b/c/d"), k).alias("beside"), to(F.lit("http://k/"), k).alias("away"), to(F.lit("http://h/z/"), k).alias("root"))


@query("date_compare", "SELECT event_id, event_id % 3 <> 0 AS earlier FROM events")
def _(spark, d):
    hour = F.lpad((F.col("event_id") % 3).cast("string"), 2, "0")
    a, b = F.lit("2001-02-03T04:05:06Z"), F.concat(F.lit("2001-02-03T04:05:06-"), hour, F.lit(":00"))
    return read(spark, d, "events").select("event_id", U.earlier(a, b).alias("earlier"))


@query("same_value", "SELECT n_nationkey, true AS number, true AS text, false AS other FROM nation")
def _(spark, d):
    n = read(spark, d, "nation")
    odd = F.concat(F.lit('"+0'), "n_nationkey", F.lit(INT))
    return n.select("n_nationkey", T.same_value(odd, T.integer("n_nationkey")).alias("number"), T.same_value(T.plain("n_name"), T.string("n_name")).alias("text"), T.same_value(T.plain("n_nationkey"), T.integer("n_nationkey")).alias("other"))


from . import catalog_more  # noqa: E402, F401  its queries join those above
