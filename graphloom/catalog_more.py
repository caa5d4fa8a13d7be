"""More named queries: nested statements, their differences, many small graphs, backward steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ONTOLOGY_SQL, SIGNED, P, _ontology, _term, query, read
from .functions import terms as T
from .functions import uri as U
from .functions.vocab import ALLOCATED, DOMAIN, FIRST, NIL, RANGE, REST, SUBCLASS, SUBPROPERTY, TYPE
from .operators import chaining as C
from .operators import entail as E
from .operators import named as N
from .operators import orders as O
from .operators import relations as L
from .operators import rules as R
from .operators import claims, trees
from .operators.columns import computed
from .operators.modifiers import INTEGER
from .operators.scratch import settle
from .sources.mapping import graph_of, lift
from .sources.text import largest_blank_number, lines_of, renumbered

# Nested statements

#: One row an item: lines that repeat their keys are one.
ITEMS = """items AS (SELECT l_orderkey AS k, l_partkey AS part, l_suppkey AS sup, l_linenumber AS line, max(l_quantity)::BIGINT AS q, min(l_returnflag) AS flag,
  l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id FROM lineitem GROUP BY ALL)"""


def _items(spark, d) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = read(spark, d, "lineitem").groupBy(*keys).agg(F.max("l_quantity").cast("long").alias("q"), F.min("l_returnflag").alias("flag"))
    return settle(rows.withColumn("id", F.concat_ws("-", *keys)))


def _order_trees(items: DataFrame, orders: DataFrame, name) -> DataFrame:
    """Orders whose items are blank nodes, with what was paid as one more inside each; ``name`` names the blank nodes."""
    arc = lambda s, p, o: F.struct(s.alias("s"), F.lit(f"<urn:p:{p}>").alias("p"), o.alias("o"))
    order, item, pay = T.iri("urn:orders:", "l_orderkey"), F.col("_item"), F.col("_pay")
    # an item's triples come from one row, so that what is grouped by subject is grouped before it is moved
    arcs = [arc(order, "item", item), arc(item, "line", T.integer("l_linenumber")), arc(item, "part", T.iri("urn:part:", "l_partkey")), arc(item, "sup", T.iri("urn:supplier:", "l_suppkey"))]
    arcs += [arc(item, "pay", pay), arc(pay, "flag", T.plain("flag")), arc(pay, "quantity", T.integer("q"))]
    named = computed(items, {"_item": name("i", F.col("id")), "_pay": name("m", F.col("id"))})
    return named.select(F.inline(F.array(*arcs))).union(orders.select(F.inline(F.array(arc(T.iri("urn:orders:", "o_orderkey"), "status", T.plain("o_orderstatus"))))))


def _plain_name(stem: str, key: Column) -> Column:
    return F.concat(F.lit(f"_:{stem}-"), key)


_NESTED = f"""WITH {ITEMS}, t AS (SELECT k, string_agg('<urn:p:item> (_:i-' || id || ' <urn:p:line> "' || line || @INT || ' ; <urn:p:part> <urn:part:' || part || '> ; <urn:p:pay> (_:m-' || id || ' <urn:p:flag> "' || flag || '" ; <urn:p:quantity> "' || q || @INT || ') ; <urn:p:sup> <urn:supplier:' || sup || '>)', ' ; ' ORDER BY '_:i-' || id) AS items FROM items GROUP BY k),
o AS (SELECT o_orderkey AS k, string_agg(DISTINCT '<urn:p:status> "' || o_orderstatus || '"', ' ; ' ORDER BY '<urn:p:status> "' || o_orderstatus || '"') AS status FROM orders GROUP BY ALL)
SELECT '<urn:orders:' || k || '>' AS subject, '(<urn:orders:' || k || '> ' || concat_ws(' ; ', items, status) || ')' AS text FROM t FULL JOIN o USING (k)"""


@query("nested_statements", _NESTED)
def _(spark, d):
    return trees.statements(_order_trees(_items(spark, d), read(spark, d, "orders"), _plain_name))


@query(
    "nested_lines",
    """WITH c AS (SELECT o_orderkey AS k, o_custkey AS c, '_:o-' || o_orderkey AS b, min(o_orderstatus) AS status FROM orders GROUP BY ALL)
SELECT '<urn:customer:' || c || '>' AS subject, chr(10) || '(<urn:customer:' || c || '> ' || string_agg('<urn:p:order> ' || chr(10) || '  (' || b || ' <urn:p:status> "' || status || '")', chr(10) || '  ; ' ORDER BY b) || ')' AS text FROM c GROUP BY c""",
)
def _(spark, d):
    o = read(spark, d, "orders").groupBy("o_orderkey", "o_custkey").agg(F.min("o_orderstatus").alias("status"))
    blank = F.concat(F.lit("_:o-"), "o_orderkey")
    g = o.select(T.iri("urn:customer:", "o_custkey").alias("s"), F.lit("<urn:p:order>").alias("p"), blank.alias("o"))
    return trees.statements(g.union(o.select(blank, F.lit("<urn:p:status>"), T.plain("status"))), "\n")


@query("nesting_depth", f"WITH {ITEMS} SELECT depth, count(*) AS n FROM (SELECT DISTINCT k, 0 AS depth FROM items UNION ALL SELECT DISTINCT o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT k FROM items) UNION ALL SELECT k, unnest([1, 2]) FROM items) GROUP BY depth")
def _(spark, d):
    found = trees.subject_depths(_order_trees(_items(spark, d), read(spark, d, "orders"), _plain_name))
    return found.groupBy(F.col("depth").cast("int").alias("depth")).agg(F.count("*").alias("n"))


@query(
    "tree_difference",
    f"""WITH {ITEMS}, o AS (SELECT DISTINCT o_orderkey AS k, o_orderstatus AS status FROM orders),
there AS (SELECT k FROM items WHERE sup % 7 <> 3 UNION SELECT k FROM o WHERE k % 11 <> 4)
SELECT '<urn:orders:' || k || '>' AS root, '<urn:p:item>' AS path, '_:i-' || id AS left, NULL AS right FROM items WHERE sup % 7 = 3 AND k IN (FROM there)
UNION ALL SELECT '<urn:orders:' || k || '>', '<urn:p:item> <urn:p:pay> <urn:p:quantity>', {_term("q")}, {_term("q + 1")} FROM items WHERE part % 5 = 0 AND sup % 7 <> 3
UNION ALL SELECT '<urn:orders:' || k || '>', '<urn:p:status>', '"' || status || '"', NULL FROM o WHERE k % 11 = 4 AND k IN (FROM there)
UNION ALL SELECT '<urn:orders:' || k || '>', '<urn:p:status>', '"' || status || '"', '"changed"' FROM o WHERE k % 13 = 5 AND k % 11 <> 4
UNION ALL SELECT DISTINCT '<urn:orders:' || k || '>', '', '<urn:orders:' || k || '>', NULL FROM (SELECT k FROM items UNION SELECT k FROM o) WHERE k NOT IN (FROM there)""",
)
def _(spark, d):
    """One side has its blank nodes renamed, some quantities and states changed, and some items and states left out."""
    items, orders = _items(spark, d), read(spark, d, "orders").select("o_orderkey", "o_orderstatus").distinct()
    other = lambda stem, key: F.concat(F.lit("_:x"), F.md5(F.concat(F.lit(stem), key).cast("binary")))
    changed = items.where("l_suppkey % 7 <> 3").withColumn("q", F.when(F.col("l_partkey") % 5 == 0, F.col("q") + 1).otherwise(F.col("q")))
    states = orders.where("o_orderkey % 11 <> 4").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 5, F.lit("changed")).otherwise(F.col("o_orderstatus")))
    return trees.tree_difference(_order_trees(items, orders, _plain_name), _order_trees(changed, states, other))


# Many small graphs


@query("named_equal", "SELECT '<urn:customer:' || o_custkey || '>' AS g, o_custkey % 5 <> 0 OR count(*) = 1 AS same FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY o_custkey")
def _(spark, d):
    """A graph for each customer: orders around one blank node, and of some customers in a chain on the other side."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderkey")).alias("keys"))
    o = o.select("o_custkey", "keys", F.posexplode("keys").alias("i", "k"))
    g, blank = T.iri("urn:customer:", "o_custkey"), lambda stem, k: F.concat(F.lit(f"_:{stem}"), k.cast("string"))
    star = o.select(g.alias("g"), blank("h", F.col("o_custkey")).alias("s"), F.lit("<urn:p:has>").alias("p"), blank("o", F.col("k")).alias("o"))
    near = F.when((F.col("o_custkey") % 5 == 0) & (F.col("i") > 0), blank("x", F.get("keys", F.col("i") - 1))).otherwise(blank("c", F.col("o_custkey")))
    return N.same_formulae(star, o.select(g.alias("g"), near.alias("s"), F.lit("<urn:p:has>").alias("p"), blank("x", F.col("k")).alias("o")))


# Backward steps


@query("bwd_folded", "SELECT '<urn:orders:' || o_orderkey || '>' AS claim, CASE WHEN o_orderstatus = 'P' THEN 4 ELSE 2 END::BIGINT AS alternatives, CASE WHEN o_orderstatus = 'P' THEN 14 ELSE 4 END::BIGINT AS triples FROM (SELECT o_orderkey, max(o_orderstatus) AS o_orderstatus FROM orders GROUP BY ALL)")
def _(spark, d):
    """Three heads fit each goal; two of them need the same but for a blank node's name, also where two goals do."""
    rule = R.Rule("paid", P("?o <urn:p:by> ?c . ?c <urn:p:paid> ?z"), P("?o <urn:p:soldTo> ?c . ?o <urn:p:soldTo> ?who . ?o <urn:p:soldTo> ?else"))
    o = read(spark, d, "orders").groupBy("o_orderkey").agg(F.max("o_orderstatus").alias("status"), F.max("o_custkey").alias("c"))
    ends = F.when(F.col("status") == "P", F.array(T.iri("urn:customer:", "c"), F.lit("<urn:any>"))).otherwise(F.array(T.iri("urn:customer:", "c")))
    goals = o.select(T.iri("urn:orders:", "o_orderkey").alias("claim"), F.posexplode(ends).alias("goal", "o"))
    needed = C.backward_apply(rule, goals.select("claim", "goal", F.col("claim").alias("s"), F.lit("<urn:p:soldTo>").alias("p"), "o"))
    return needed.groupBy("claim").agg(F.countDistinct("alternative").alias("alternatives"), F.count("*").alias("triples"))


@query(
    "bwd_modify",
    f"""WITH {ITEMS}, ok AS (SELECT k FROM items GROUP BY k HAVING min(q) > 3)
SELECT '<urn:orders:' || k || '>' AS claim, 0 AS alternative, '<urn:item:' || id || '>' AS s, '<urn:p:line>' AS p, {_term("q - 1")} AS o FROM items WHERE k IN (FROM ok)""",
)
def _(spark, d):
    """Quantities as one more than what must hold; an order is proved if all of its items leave more than two."""
    less = lambda b: INTEGER["gt"].apply(INTEGER["sum"].apply(b.withColumn("one", T.integer(F.lit(1))), "n", "k", "one").withColumn("two", T.integer(F.lit(2))), "k", "two")
    rule = R.Rule("next", P("?i <urn:p:line> ?k"), P("?i <urn:p:next> ?n"), less)
    items = _items(spark, d).withColumn("goal", F.col("id"))
    goals = items.select(T.iri("urn:orders:", "l_orderkey").alias("claim"), "goal", T.iri("urn:item:", "id").alias("s"), F.lit("<urn:p:next>").alias("p"), T.integer("q").alias("o"))
    return C.backward_apply(rule, goals)


@query("bwd_counts", f"WITH {ITEMS} SELECT '<urn:orders:' || k || '>' AS claim, power(3, count(*))::BIGINT AS n FROM items GROUP BY k")
def _(spark, d):
    """Numbers of alternatives that are never made: three heads for each item of an order."""
    items = _items(spark, d)
    goals = items.select(T.iri("urn:orders:", "l_orderkey").alias("claim"), F.col("id").alias("goal"), T.iri("urn:item:", "id").alias("s"), F.lit("<urn:p:next>").alias("p"), T.integer("q").alias("o"))
    heads = P("?i <urn:p:next> ?n . ?i <urn:p:next> ?m . ?i ?p ?n . ?i <urn:p:other> ?n")
    counts = C.alternative_counts(C.unifiers(goals, heads))
    return counts.select("claim", F.col("n").cast("long").alias("n"))


# Products


for _gap, _known in ((1, "c"), (2, "b")):

    @query(f"relation_prod_{_gap}", f"SELECT p_partkey, CASE WHEN y = 0 THEN x = 0 ELSE x % y = 0 END AS consistent, CASE WHEN y <> 0 AND x % y = 0 THEN {_term('x // y')} END AS v FROM {SIGNED}")
    def _(spark, d, gap=_gap, known=_known):
        """The factor that makes x of y; there is none where y does not divide x, and nothing follows from 0 = 0 * y."""
        part = read(spark, d, "part").select("p_partkey", T.integer(F.col("p_size") - 25).alias("a"), T.integer(F.col("p_partkey") % 9 - 4).alias(known))
        gap_name = "b" if known == "c" else "c"
        done = L.INTEGER_RELATIONS["prod"].complete(part.withColumn(gap_name, F.lit(None).cast("string")), ["a", "b", "c"])
        return done.select("p_partkey", "consistent", F.get(F.get("tuples", F.lit(0)), F.lit(gap)).alias("v"))


# Claims with blank nodes


@query("claims_entailed", "SELECT '_:a' || a.o_orderkey AS component, count(DISTINCT x.o_orderkey) > 0 AS entailed FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus FROM orders) a LEFT JOIN (SELECT o_orderkey, o_custkey AS c, o_orderstatus AS status, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey) x ON c = a.o_custkey AND status = 'P' AND n = a.o_orderkey % 25 GROUP BY a.o_orderkey")
def _(spark, d):
    """For each order: is there one of its customer that is in state P, and does the customer live in a certain nation?"""
    g = lift(spark, d, "orders", "customer")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey").distinct()
    blank = lambda stem: F.concat(F.lit(f"_:{stem}"), "o_orderkey")
    arc = lambda s, p, x: F.struct(s.alias("s"), F.lit(f"<urn:p:{p}>").alias("p"), x.alias("o"))
    named = o.join(read(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    claim = named.select(F.inline(F.array(arc(blank("a"), "o_custkey", blank("b")), arc(blank("a"), "o_orderstatus", T.plain(F.lit("P"))), arc(blank("b"), "c_name", F.coalesce(T.plain("c_name"), F.lit('"?"'))), arc(blank("b"), "c_nationkey", T.iri("urn:nation:", F.col("o_orderkey") % 25)))))
    return claims.components_entailed(g, claim)


# Numbers for blank nodes


@query("text_renumbered", "WITH c AS (SELECT o_custkey AS c, '_:o-' || o_orderkey AS b, min(o_orderstatus) AS status FROM orders GROUP BY ALL), n AS (SELECT *, '_:' || row_number() OVER (ORDER BY b) AS name FROM c) SELECT '<urn:customer:' || c || '> <urn:p:order> ' || string_agg(name, ' , ' ORDER BY name) || ' .' AS value FROM n GROUP BY c UNION ALL SELECT name || ' <urn:p:status> \"' || status || '\" .' FROM n")
def _(spark, d):
    o = read(spark, d, "orders").groupBy("o_orderkey", "o_custkey").agg(F.min("o_orderstatus").alias("status"))
    blank = F.concat(F.lit("_:o-"), "o_orderkey")
    g = o.select(T.iri("urn:customer:", "o_custkey").alias("s"), F.lit("<urn:p:order>").alias("p"), blank.alias("o")).union(o.select(blank, F.lit("<urn:p:status>"), T.plain("status")))
    return lines_of(renumbered(settle(g)))


@query("blank_numbers", "SELECT (SELECT max(o_orderkey) FROM orders)::BIGINT AS largest, count(*) AS n, max(k)::BIGINT AS top FROM (SELECT row_number() OVER (ORDER BY o_custkey::VARCHAR) + (SELECT max(o_orderkey) FROM orders) AS k FROM (SELECT DISTINCT o_custkey FROM orders))")
def _(spark, d):
    """Orders keep their numbers as names, and customers are numbered on from the largest of them."""
    g = settle(read(spark, d, "orders").select(F.concat(F.lit("_:"), "o_orderkey").alias("s"), F.lit("<urn:p:c>").alias("p"), F.concat(F.lit("_:c"), "o_custkey").alias("o")))
    done = renumbered(g, F.col("term").startswith("_:c"))
    return done.select("o").distinct().agg(F.lit(largest_blank_number(g)).alias("largest"), F.count("*").alias("n"), F.max(F.substring("o", 3, 18).cast("long")).alias("top"))


# Partial orders


@query("maximal_sets", "WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS x FROM lineitem GROUP BY ALL), d AS (SELECT x, row_number() OVER () AS id FROM (SELECT DISTINCT x FROM s)), e AS (SELECT id, len(x) AS n, unnest(x) AS i FROM d), c AS (SELECT a.id FROM e a JOIN e b ON a.i = b.i AND a.id <> b.id GROUP BY a.id, b.id, a.n HAVING count(*) = a.n) SELECT array_to_string(x, ',') AS items FROM d WHERE id NOT IN (SELECT id FROM c)")
def _(spark, d):
    """Sets of suppliers of an order that are in no other order's set."""
    sets = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("items"))
    return O.maximal_sets(sets, "items").select(F.array_join("items", ",").alias("items"))


@query("skyline_three", "SELECT DISTINCT p_size, p_retailprice, k FROM (SELECT p_size, p_retailprice, p_partkey % 97 AS k FROM part) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_size, p_retailprice, p_partkey % 97 AS k FROM part) b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND b.k >= a.k AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice OR b.k > a.k))")
def _(spark, d):
    return O.maxima(read(spark, d, "part").withColumn("k", F.col("p_partkey") % 97), ["p_size", "p_retailprice", "k"])


@query("skyline_dates", "WITH o AS (SELECT DISTINCT o_orderdate::DATE AS day, o_totalprice AS price FROM orders) SELECT strftime(day, '%Y-%m-%d') AS day, price FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.day <= a.day AND b.price <= a.price AND (b.day < a.day OR b.price < a.price))")
def _(spark, d):
    """Orders that none before them or on their day undercuts."""
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price"))
    return O.maxima(o, ["day", "price"], least=True).select(F.col("day").cast("string").alias("day"), "price")


@query("most_complete", "WITH l AS (SELECT DISTINCT l_orderkey AS k, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::VARCHAR END AS b, CASE WHEN l_quantity > 25 THEN (l_linenumber % 2)::VARCHAR END AS c FROM lineitem) SELECT * FROM l x WHERE NOT EXISTS (SELECT 1 FROM l y WHERE x.k = y.k AND (x.a IS NULL OR x.a = y.a) AND (x.b IS NULL OR x.b = y.b) AND (x.c IS NULL OR x.c = y.c) AND (x.a IS DISTINCT FROM y.a OR x.b IS DISTINCT FROM y.b OR x.c IS DISTINCT FROM y.c))")
def _(spark, d):
    when = lambda c, x: F.when(F.expr(c), F.expr(x))
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), when("l_linenumber % 3 <> 0", "l_returnflag").alias("a"), when("l_linenumber % 2 = 0", "string(l_linenumber)").alias("b"), when("l_quantity > 25", "string(l_linenumber % 2)").alias("c"))
    return O.most_complete(rows, ["k"], ["a", "b", "c"])


# Restrictions that a graph made from tables defines


def _nation_classes(spark, d) -> DataFrame:
    """A class for each nation: sums or differences of three properties, for as many tuples as its region's number, if any."""
    n = read(spark, d, "nation")
    of, cell = T.iri("urn:class:", "n_nationkey"), lambda i: F.concat(F.lit(f"_:c{i}-"), "n_nationkey")
    arc = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    rule = F.when(F.col("n_nationkey") % 2 == 0, F.lit(f"<{L.XSD_INTEGER_NS}sum>")).otherwise(F.lit(f"<{L.XSD_INTEGER_NS}diff>"))
    about = [arc(of, TYPE, F.lit(f"<{L.RDFD}GeneralRestriction>")), arc(of, f"<{L.RDFD}onProperties>", cell(0)), arc(of, f"<{L.RDFD}constraint>", rule), arc(of, f"<{L.RDFD}maxCardinality>", T.integer("n_regionkey"))]
    for i, p in enumerate(("total", "first", "second")):
        about += [arc(cell(i), FIRST, T.iri(f"urn:p:{p}", F.lit(""))), arc(cell(i), REST, cell(i + 1) if i < 2 else F.lit(NIL))]
    return n.select(F.inline(F.array(*about)))


@query("restriction_from_tables", f"SELECT '<urn:class:' || n_nationkey || '>' AS class, '<{L.XSD_INTEGER_NS}' || CASE WHEN n_nationkey % 2 = 0 THEN 'sum' ELSE 'diff' END || '>' AS constraint, '<urn:p:total> <urn:p:first> <urn:p:second>' AS properties, CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR ELSE 'any' END AS most FROM nation")
def _(spark, d):
    found = L.find_restrictions(settle(_nation_classes(spark, d)))
    return found.select("class", "constraint", F.array_join("properties", " ").alias("properties"), F.coalesce(F.col("most").cast("string"), F.lit("any")).alias("most"))


#: Wanted values of each part (0 total, 1 first, 2 second), the full tuples that pairs of them lead to, the least parts of those.
_WANTED = """p AS (SELECT p_partkey AS k, max(p_size)::BIGINT AS x FROM part GROUP BY ALL),
w AS (SELECT *, (1 << (row_number() OVER (PARTITION BY k ORDER BY i, v) - 1)::INT)::INT AS bit FROM (SELECT k, 0 AS i, x + k % 9 AS v FROM p UNION SELECT k, 1, x FROM p
  UNION SELECT k, 0, x + k % 9 + 7 FROM p WHERE k % 4 = 1 UNION SELECT k, 1, x + 3 FROM p WHERE k % 4 = 0 UNION SELECT k, 2, k % 9 + 1 FROM p WHERE k % 4 = 2)),
f AS (SELECT a.k, a.v AS a, b.v AS b, a.v - b.v AS c FROM w a JOIN w b ON a.k = b.k AND a.i = 0 AND b.i = 1 UNION SELECT a.k, a.v, a.v - c.v, c.v FROM w a JOIN w c ON a.k = c.k AND a.i = 0 AND c.i = 2
  UNION SELECT b.k, b.v + c.v, b.v, c.v FROM w b JOIN w c ON b.k = c.k AND b.i = 1 AND c.i = 2),
d AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY a, b, c, mask) - 1)::INT AS id FROM f, (VALUES (3), (5), (6)) m(mask)),
e AS (SELECT d.k, id, sum(bit)::INT AS cov, coalesce(sum(bit) FILTER ((mask >> i) & 1 = 1), 0)::INT AS held FROM d JOIN w ON d.k = w.k AND w.v = CASE i WHEN 0 THEN a WHEN 1 THEN b ELSE c END GROUP BY ALL)"""


@query(
    "restriction_backward",
    f"""WITH {_WANTED}, s AS (SELECT k, unnest(generate_series(1, (1 << n) - 1)) AS sub FROM (SELECT k, count(*)::INT AS n FROM e GROUP BY k)),
j AS (SELECT s.k, sub, cov, held, count(*) FILTER (cov & 1 > 0) OVER q AS c1, count(*) FILTER (cov & 2 > 0) OVER q AS c2, count(*) FILTER (cov & 4 > 0) OVER q AS c4 FROM s JOIN e ON s.k = e.k AND (sub >> id) & 1 = 1 WINDOW q AS (PARTITION BY s.k, sub)),
g AS (SELECT k, sub, bit_or(cov) AS cov, bit_or(held) AS held FROM j GROUP BY ALL HAVING bool_and((cov & 1 > 0 AND c1 = 1) OR (cov & 2 > 0 AND c2 = 1) OR (cov & 4 > 0 AND c4 = 1))),
ok AS (SELECT g.k, sub FROM g JOIN (SELECT k, sum(bit) AS whole FROM w GROUP BY k) USING (k) WHERE cov = whole AND held <> whole),
arcs AS (SELECT ok.k, sub, unnest([CASE WHEN mask & 1 > 0 THEN '<urn:p:total> ' || {_term("a")} END, CASE WHEN mask & 2 > 0 THEN '<urn:p:first> ' || {_term("b")} END, CASE WHEN mask & 4 > 0 THEN '<urn:p:second> ' || {_term("c")} END]) AS arc FROM ok JOIN d ON ok.k = d.k AND (sub >> id) & 1 = 1)
SELECT '<urn:part:' || k || '>' AS subject, string_agg(DISTINCT arc, ' ; ' ORDER BY arc) AS needs FROM arcs WHERE arc IS NOT NULL GROUP BY k, sub""",
)
def _(spark, d):
    """What each part's sums follow from: two totals or two firsts for some parts, and for some a second that does not fit both."""
    part = read(spark, d, "part").groupBy("p_partkey").agg(F.max("p_size").cast("long").alias("x"))
    k, total = F.col("p_partkey"), F.col("x") + F.col("p_partkey") % 9
    arc = lambda name, v: F.struct(F.lit(f"<urn:p:{name}>").alias("p"), T.integer(v).alias("o"))
    only = lambda i, a: F.when(k % 4 == i, F.array(a)).otherwise(F.array().cast("array<struct<p: string, o: string>>"))
    arcs = F.concat(F.array(F.struct(F.lit(TYPE).alias("p"), F.lit("<urn:class:Sum>").alias("o")), arc("total", total), arc("first", F.col("x"))), only(1, arc("total", total + 7)), only(0, arc("first", F.col("x") + 3)), only(2, arc("second", k % 9 + 1)))
    claim = settle(part.select(T.iri("urn:part:", "p_partkey").alias("s"), F.inline(arcs)))
    sums = L.Restriction("<urn:class:Sum>", tuple(f"<urn:p:{x}>" for x in ("total", "first", "second")), L.INTEGER_RELATIONS["sum"])
    needed = L.backward_restriction(claim, sums).where(F.col("p") != TYPE)
    text = F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "p", "o"))), " ; ")
    return needed.groupBy("s", "alternative").agg(text.alias("needs")).select(F.col("s").alias("subject"), "needs")


# Proofs over the tables


@query("proof_exact", "SELECT 'whole' AS proof, 'valid' AS verdict, 0 AS axioms UNION ALL SELECT 'part', CASE WHEN (SELECT count(*) FROM customer) > 1 THEN 'Invalid step: rule does not deduce consequence from antecedents' ELSE 'valid' END, 0 UNION ALL SELECT 'backward', 'valid', 0 UNION ALL SELECT 'cited', 'valid', 1")
def _(spark, d):
    """A step's consequent is all that its rule deduces, or needs just what is an antecedent; axioms count where they are cited."""
    rule = R.Rule("region", P("?c <urn:p:c_nationkey> ?n . ?n <urn:p:n_regionkey> ?r"), P("?c <urn:p:region> ?r"))
    back = R.Rule("back", P("?c <urn:p:lives> ?n"), P("?n <urn:p:homeOf> ?c"))
    data = settle(lift(spark, d, "customer", "nation"))
    whole = settle(rule.forward(data))
    first = whole.groupBy().agg(F.min("s").alias("s")).join(whole, "s").select("s", "p", "o")
    home = lift(spark, d, "customer").where("p = '<urn:p:c_nationkey>'").select("s", F.lit("<urn:p:lives>").alias("p"), "o")
    axiom = R.RULESETS["xsd_integer"].axioms
    graphs = {"data": data, "whole": whole, "part": first, "home": home, "homes": home.select(F.col("o").alias("s"), F.lit("<urn:p:homeOf>").alias("p"), F.col("s").alias("o")), "cited": data.union(graph_of(spark, axiom))}

    def row(name: str, given: str, rule_name: str, goal: str, context=()) -> tuple[str, str, int]:
        proof = E.Proof(graphs, list(context), [given], [E.Step(rule_name, [given], goal)], goal, [rule, back], exact=True)
        return name, proof.explain() or "valid", len(proof.axioms_used())

    rows = [row("whole", "data", "region", "whole"), row("part", "data", "region", "part"), row("backward", "home", "back", "homes"), row("cited", "cited", "region", "whole", [R.RULESETS["xsd_integer"]])]
    return spark.createDataFrame(rows, "proof string, verdict string, axioms int")


# Parts of dates, hosts, language tags, labels


_ZONE = "((event_id % 29 - 14) * 30)"


@query(
    "date_accessors",
    f"""SELECT event_id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute, floor(second(ts))::INTEGER AS second,
(event_id % 1000)::INTEGER AS millisecs, {_ZONE}::INTEGER AS timezone, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 1000 <> 0 THEN '.' || lpad((event_id % 1000)::VARCHAR, 3, '0') ELSE '' END
|| CASE WHEN {_ZONE} = 0 THEN 'Z' ELSE CASE WHEN {_ZONE} < 0 THEN '-' ELSE '+' END || lpad((abs({_ZONE}) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs({_ZONE}) % 60)::VARCHAR, 2, '0') END AS shown FROM events""",
)
def _(spark, d):
    """Texts with thousandths and zones of every half hour, taken apart and shown again; +00:00 becomes Z."""
    e, zone = read(spark, d, "events"), F.expr(_ZONE)
    hours = F.concat(F.lpad(F.floor(F.abs(zone) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(zone) % 60).cast("string"), 2, "0"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.when(zone < 0, "-").otherwise("+"), hours)
    rows = e.select("event_id", U.accessors(text).alias("x"))
    return rows.select("event_id", "x.*", U.show_date_time("x").alias("shown"))


@query("date_valid", "SELECT o_orderkey, day(o_orderdate) + o_orderkey % 5 <= day(last_day(o_orderdate::DATE)) AS valid, month(o_orderdate) + o_orderkey % 3 <= 12 AS first FROM orders")
def _(spark, d):
    """Is there a day so many days on in the month, and a first of a month so many months on in the year?"""
    o, day = read(spark, d, "orders"), F.col("o_orderdate").cast("date")
    later = lambda part, n: (part + F.col("o_orderkey") % n).cast("int")
    return o.select("o_orderkey", U.valid_date(F.year(day), F.month(day), later(F.dayofmonth(day), 5)).alias("valid"), U.valid_date(F.year(day), later(F.month(day), 3), F.lit(1)).alias("first"))


_AUTHORITY = "CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN ':80' WHEN 2 THEN ':x' ELSE '..' END"


@query("uri_host", f"""SELECT page_id, regexp_matches(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '^([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\\.)*[A-Za-z]([A-Za-z0-9-]*[A-Za-z0-9])?$') AND page_id % 4 < 2 AS host FROM pages""")
def _(spark, d):
    """Hosts of pages as they are, with a port, with one that is no number, and with empty labels."""
    changed = F.regexp_replace("url", r"\A([^:/?#]+://[^/?#]*)", F.concat(F.lit("$1"), F.expr(_AUTHORITY)))
    return read(spark, d, "pages").select("page_id", F.coalesce(U.has_host(changed), F.lit(False)).alias("host"))


@query("language_matches", "SELECT c_custkey, c_custkey % 5 IN (0, 1, 2) AS english FROM customer")
def _(spark, d):
    """Names tagged en, en-gb, EN-US, enx and without a tag."""
    tags = F.get(F.array(*map(F.lit, ("en", "en-gb", "EN-US", "enx"))), (F.col("c_custkey") % 5).cast("int"))
    name = F.when(tags.isNull(), T.plain("c_name")).otherwise(T.tagged("c_name", tags))
    return read(spark, d, "customer").select("c_custkey", T.language_matches(name, "EN").alias("english"))


@query("collect_runs", "SELECT o_custkey, string_agg(k, ',' ORDER BY k) AS orders FROM (SELECT DISTINCT o_custkey, o_orderkey AS k FROM orders) GROUP BY o_custkey HAVING count(*) >= 3")
def _(spark, d):
    found = E.collect_runs(read(spark, d, "orders"), "o_custkey", "o_orderkey", 3)
    return found.select("o_custkey", F.array_join("values", ",").alias("orders"))


_QUADS = """q AS (SELECT NULL AS g, '<urn:region:' || n_regionkey || '>' AS s, '<urn:p:says>' AS p, '<urn:nation:' || n_nationkey || '>' AS o FROM nation WHERE n_regionkey % 2 = 1
UNION ALL SELECT '<urn:nation:' || c_nationkey || '>', '<urn:me>', '<urn:p:knows>', '<urn:customer:' || c_custkey || '>' FROM customer
UNION ALL SELECT '<urn:customer:' || o_custkey || '>', '<urn:orders:' || o_orderkey || '>', '<urn:p:status>', '"' || o_orderstatus || '"' FROM orders)"""


def _quads(spark, d) -> DataFrame:
    """The outer graph mentions some nations, whose graphs mention customers, whose graphs mention orders."""
    arc = lambda rows, g, s, p, o: rows.select(g.alias("g"), s.alias("s"), F.lit(f"<urn:p:{p}>").alias("p"), o.alias("o"))
    nation, customer, orders = (read(spark, d, x) for x in ("nation", "customer", "orders"))
    q = arc(nation.where("n_regionkey % 2 = 1"), F.lit(None).cast("string"), T.iri("urn:region:", "n_regionkey"), "says", T.iri("urn:nation:", "n_nationkey"))
    q = q.union(arc(customer, T.iri("urn:nation:", "c_nationkey"), F.lit("<urn:me>"), "knows", T.iri("urn:customer:", "c_custkey")))
    return q.union(arc(orders, T.iri("urn:customer:", "o_custkey"), T.iri("urn:orders:", "o_orderkey"), "status", T.plain("o_orderstatus")))


@query("named_labels", f"WITH {_QUADS} SELECT DISTINCT unnest([g, s, p, o]) AS term FROM q WHERE g IS NOT NULL UNION SELECT unnest([s, p, o]) FROM q WHERE g IS NULL")
def _(spark, d):
    return N.all_labels(_quads(spark, d))


@query("named_labels_reachable", f"WITH RECURSIVE {_QUADS}, r AS (SELECT unnest([s, p, o]) AS term FROM q WHERE g IS NULL UNION SELECT unnest([q.s, q.p, q.o]) FROM r JOIN q ON q.g = r.term) SELECT term FROM r")
def _(spark, d):
    return N.reachable_labels(_quads(spark, d))


# All rules at once


def _round_sql(x: str) -> str:
    """What one round of all RDFS rules makes of the triples ``x``, with those; members are properties, wherever they stand."""
    terms = f"(SELECT s AS m FROM {x} UNION SELECT p FROM {x} UNION SELECT o FROM {x})"
    typed = lambda c: f"SELECT s FROM {x} WHERE p = @TYPE AND o = '<@RDF{c}>'"
    of = lambda p: f"(SELECT s AS a, o AS z FROM {x} WHERE p = '{p}')"
    member = r"regexp_matches(m, '^<@RDF_[0-9]*>$')"
    return f"""SELECT * FROM {x} UNION SELECT p, @TYPE, '<@RDFProperty>' FROM {x}
UNION SELECT m, @TYPE, '<@RDFProperty>' FROM {terms} WHERE {member} UNION SELECT m, @TYPE, '<@RDFSContainerMembershipProperty>' FROM {terms} WHERE {member}
UNION SELECT m, '{DOMAIN}', '<@RDFSResource>' FROM {terms} WHERE {member} UNION SELECT m, '{RANGE}', '<@RDFSResource>' FROM {terms} WHERE {member}
UNION SELECT b.s, @TYPE, '<@RDFSLiteral>' FROM {x} b JOIN {x} t ON t.o = b.s WHERE b.p = '{ALLOCATED}' AND b.o LIKE '"%' AND b.o NOT LIKE '%"^^<%'
UNION SELECT s, @TYPE, z FROM {x} JOIN {of(DOMAIN)} ON p = a UNION SELECT o, @TYPE, z FROM {x} JOIN {of(RANGE)} ON p = a WHERE o NOT LIKE '"%'
UNION SELECT s, @TYPE, '<@RDFSResource>' FROM {x} UNION SELECT o, @TYPE, '<@RDFSResource>' FROM {x} WHERE o NOT LIKE '"%'
UNION SELECT x.a, '{SUBPROPERTY}', y.z FROM {of(SUBPROPERTY)} x JOIN {of(SUBPROPERTY)} y ON x.z = y.a UNION SELECT s, '{SUBPROPERTY}', s FROM ({typed("Property")})
UNION SELECT s, z, o FROM {x} JOIN {of(SUBPROPERTY)} ON p = a
UNION SELECT s, '{SUBCLASS}', '<@RDFSResource>' FROM ({typed("SClass")}) UNION SELECT s, '{SUBCLASS}', s FROM ({typed("SClass")})
UNION SELECT s, @TYPE, z FROM {x} JOIN {of(SUBCLASS)} ON o = a WHERE p = @TYPE UNION SELECT x.a, '{SUBCLASS}', y.z FROM {of(SUBCLASS)} x JOIN {of(SUBCLASS)} y ON x.z = y.a
UNION SELECT s, '{SUBPROPERTY}', '<@RDFSmember>' FROM ({typed("SContainerMembershipProperty")}) UNION SELECT s, '{SUBCLASS}', '<@RDFSLiteral>' FROM ({typed("SDatatype")})"""


#: More rounds than the closure needs; those after the fixpoint add nothing.
_ROUNDS = 12


@query(
    "rdfs_all_closure",
    f"WITH {ONTOLOGY_SQL}, c0 AS MATERIALIZED (SELECT * FROM g UNION VALUES {', '.join(repr(x) for x in R.RDF_AXIOMS + R.RDFS_AXIOMS)}), "
    + ", ".join(f"c{i + 1} AS MATERIALIZED ({_round_sql(f'c{i}')})" for i in range(_ROUNDS))
    + f" SELECT * FROM c{_ROUNDS}",
)
def _(spark, d):
    """Every rule of RDFS, with its axioms and those of RDF, to the fixpoint."""
    return R.rdfs_all_closure(_ontology(spark, d))
