"""Program queries over one global graph made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from ..plans import programs as P
from ..session import table


def kg_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples of customers, orders, lines, parts, suppliers, nations and regions; ids carry a type prefix.

    Lines merge where order and line number repeat, so use set semantics.
    """

    def from_table(name: str, head: F.Column, **tails: F.Column) -> list[DataFrame]:
        # one branch a relation: a program's filter on the relation leaves one scan of two columns
        t = table(spark, d, name)
        return [t.select(head.alias("head"), F.lit(k.replace("__", ".")).alias("relation"), v.cast("string").alias("tail")) for k, v in tails.items()]

    ident = lambda p, *c: F.concat(F.lit(f"{p}:"), F.concat_ws("-", *c))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    parts = [
        *from_table("orders", ident("o", "o_orderkey"), order__customer=ident("c", "o_custkey"), order__date=day, order__totalprice=F.col("o_totalprice"), order__status=F.col("o_orderstatus"), order__urgent_day=F.when(F.col("o_orderpriority") == "1-URGENT", day)),
        *from_table("customer", ident("c", "c_custkey"), customer__nation=ident("n", "c_nationkey"), customer__segment=F.col("c_mktsegment"), customer__balance=F.col("c_acctbal")),
        *from_table("supplier", ident("s", "s_suppkey"), supplier__nation=ident("n", "s_nationkey")),
        *from_table("nation", ident("n", "n_nationkey"), nation__region=ident("r", "n_regionkey")),
        *from_table("lineitem", ident("l", "l_orderkey", "l_linenumber"), lineitem__part=ident("p", "l_partkey"), lineitem__supplier=ident("s", "l_suppkey"), lineitem__order=ident("o", "l_orderkey")),
        *from_table("part", ident("p", "p_partkey"), part__size=F.col("p_size"), part__brand=F.col("p_brand")),
    ]
    t = parts[0]
    for x in parts[1:]:
        t = t.unionByName(x)
    return t.where("tail is not null")


def _conj(spark: SparkSession, d: str, select: str, atoms: list[tuple[str, str, str]], **rest) -> DataFrame:  # noqa: ANN003
    return P.run_conjunctive(kg_triples(spark, d), P.Conjunctive(select, tuple(P.Atom(*a) for a in atoms), **rest)).answers.select("answer")


def region_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders reached from each region by a three-hop backward chain, counted."""
    t = kg_triples(spark, d).withColumn("question_id", F.lit(""))
    regions = t.where("relation = 'nation.region'").select("question_id", F.col("tail").alias("node")).distinct()
    got = graph.reach(t, regions, [("nation.region", "backward"), ("customer.nation", "backward"), ("order.customer", "backward")])
    return got.groupBy("anchor").agg(F.count("*").alias("orders"), F.min("node").alias("first_order"))


def conj_two_anchor_join(spark: SparkSession, d: str) -> DataFrame:
    return _conj(spark, d, "?c", [("?c", "customer.segment", "BUILDING"), ("?c", "customer.nation", "n:7")])


def conj_both_bound_check(spark: SparkSession, d: str) -> DataFrame:
    """Orders of parts of one size whose line's supplier and customer share a nation."""
    atoms = [("?p", "part.size", "15"), ("?l", "lineitem.part", "?p"), ("?l", "lineitem.order", "?o"), ("?l", "lineitem.supplier", "?s"), ("?s", "supplier.nation", "?n"), ("?o", "order.customer", "?c"), ("?c", "customer.nation", "?n")]
    return _conj(spark, d, "?o", atoms)


def conj_value_filter(spark: SparkSession, d: str) -> DataFrame:
    filters = (P.ValueFilter("?v", "GreaterThan", '"350000"^^xsd:float'), P.ValueFilter("?t", "GreaterOrEqual", '"1997-06-01"^^xsd:date'))
    return _conj(spark, d, "?o", [("?c", "customer.nation", "n:3"), ("?o", "order.customer", "?c"), ("?o", "order.totalprice", "?v"), ("?o", "order.date", "?t")], filters=filters)


def conj_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Nations of suppliers, other than the customer's, in one customer nation's orders."""
    atoms = [("?c", "customer.nation", "n:5"), ("?o", "order.customer", "?c"), ("?l", "lineitem.order", "?o"), ("?l", "lineitem.supplier", "?s"), ("?s", "supplier.nation", "?n")]
    return _conj(spark, d, "?n", atoms, exclusions=(("?n", "n:5"), ("?c", "?s")))


def conj_optional_filter(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are not urgent, or urgent and of 1998 or later."""
    opt = (P.OptionalFilter("?o", "order.urgent_day", "GreaterOrEqual", '"1998-01-01"^^xsd:date'),)
    return _conj(spark, d, "?o", [("?c", "customer.nation", "n:11"), ("?o", "order.customer", "?c")], optional_filters=opt)


def conj_superlative(spark: SparkSession, d: str) -> DataFrame:
    return _conj(spark, d, "?o", [("?c", "customer.nation", "n:2"), ("?o", "order.customer", "?c"), ("?o", "order.totalprice", "?v")], order=P.Order("?v", True, 5))


def conj_disconnected(spark: SparkSession, d: str) -> DataFrame:
    """Atoms without a bound end are never joined: no answers."""
    return _conj(spark, d, "?x", [("?x", "customer.nation", "?y"), ("?z", "nation.region", "?w")])


SPARQL = """PREFIX ns: <http://example.org/>
SELECT DISTINCT ?x
WHERE {
?c ns:customer.segment ns:MACHINERY .
?x ns:order.customer ?c .
?x ns:order.totalprice ?v .
?x ns:order.date ?t .
FILTER (?v > "200000"^^xsd:float)
FILTER (NOT EXISTS {?x ns:order.urgent_day ?u} || EXISTS {?x ns:order.urgent_day ?u . FILTER(xsd:dateTime(?u) >= "1999-01-01"^^xsd:dateTime) })
FILTER (?c != ns:c)
}
ORDER BY DESC(xsd:datetime(?t)) LIMIT 25"""


def sparql_compiled(spark: SparkSession, d: str) -> DataFrame:
    return P.run_conjunctive(kg_triples(spark, d), P.compile_sparql(SPARQL)).answers.select("answer")


def _chain(spark: SparkSession, d: str, chain: P.Chain) -> DataFrame:
    return P.run_chain(kg_triples(spark, d), chain).answers.select("answer")


CUSTOMERS = (("nation.region", "backward"), ("customer.nation", "backward"))
ORDERS = (*CUSTOMERS, ("order.customer", "backward"))


def chain_constraint_required(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d, P.Chain("r:1", ORDERS, (P.Constraint(2, "order.urgent_day", "LessThan", "1996-01-01"), P.Constraint(1, "customer.segment", "Equal", "building"))))


def chain_constraint_optional(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d, P.Chain("r:1", ORDERS, (P.Constraint(2, "order.urgent_day", "LessThan", "1996-01-01", True), P.Constraint(1, "customer.segment", "Equal", "building"))))


def chain_order_desc_nulls_first(spark: SparkSession, d: str) -> DataFrame:
    """Descending by an attribute most orders lack: those come first."""
    return _chain(spark, d, P.Chain("n:4", ORDERS[1:], order=P.ChainOrder(1, "order.urgent_day", True, 10, 40)))


def chain_order_asc_offset(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d, P.Chain("r:2", CUSTOMERS, order=P.ChainOrder(1, "customer.balance", False, 5, 20)))


def typed_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the literals of each relation after typed parsing."""
    k = text.comparable(F.col("tail"))
    t = kg_triples(spark, d).where("relation in ('order.date', 'order.totalprice', 'customer.segment', 'part.size', 'part.brand')").distinct()
    return t.select("relation", k["kind"].alias("kind"), k["num"].alias("num"), k["ts"].alias("ts")).groupBy("relation", "kind").agg(F.count("*").alias("n"), F.round(F.max("num"), 2).alias("most"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


QUERIES = {
    f.__name__: f
    for f in (
        region_orders, conj_two_anchor_join, conj_both_bound_check, conj_value_filter, conj_exclusion, conj_optional_filter, conj_superlative, conj_disconnected, sparql_compiled,
        chain_constraint_required, chain_constraint_optional, chain_order_desc_nulls_first, chain_order_asc_offset, typed_comparison,
    )
}

_O = "orders JOIN customer ON o_custkey = c_custkey"
_URGENT = "CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') END"
SQL = {
    "region_orders": f"SELECT 'r:' || n_regionkey AS anchor, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, min('o:' || o_orderkey) AS first_order FROM {_O} JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "conj_two_anchor_join": "SELECT DISTINCT 'c:' || c_custkey AS answer FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7",
    # lines merge by order and line number, as their node does
    "conj_both_bound_check": f"SELECT DISTINCT 'o:' || o_orderkey AS answer FROM lineitem a JOIN part ON a.l_partkey = p_partkey JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber JOIN supplier ON b.l_suppkey = s_suppkey JOIN ({_O}) ON o_orderkey = a.l_orderkey WHERE p_size = 15 AND s_nationkey = c_nationkey",
    "conj_value_filter": f"SELECT DISTINCT 'o:' || o_orderkey AS answer FROM {_O} WHERE c_nationkey = 3 AND o_totalprice > 350000 AND o_orderdate >= DATE '1997-06-01'",
    "conj_exclusion": f"SELECT DISTINCT 'n:' || s_nationkey AS answer FROM {_O} JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = 5 AND s_nationkey <> 5",
    "conj_optional_filter": f"SELECT DISTINCT 'o:' || o_orderkey AS answer FROM {_O} WHERE c_nationkey = 11 AND (o_orderpriority <> '1-URGENT' OR o_orderdate >= DATE '1998-01-01')",
    "conj_superlative": f"SELECT answer FROM (SELECT DISTINCT 'o:' || o_orderkey AS answer, o_totalprice, 'c:' || o_custkey AS c FROM {_O} WHERE c_nationkey = 2) ORDER BY o_totalprice DESC, c, answer LIMIT 5",
    "conj_disconnected": "SELECT 'x' AS answer WHERE false",
    "sparql_compiled": f"SELECT answer FROM (SELECT 'o:' || o_orderkey AS answer, strftime(o_orderdate, '%Y-%m-%d') AS t, 'c:' || o_custkey AS c, o_totalprice FROM {_O} WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 200000 AND (o_orderpriority <> '1-URGENT' OR o_orderdate >= DATE '1999-01-01')) ORDER BY t DESC, c, answer LIMIT 25",
    "chain_constraint_required": f"SELECT DISTINCT 'o:' || o_orderkey AS answer FROM {_O} JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING' AND {_URGENT} < '1996-01-01'",
    "chain_constraint_optional": f"SELECT DISTINCT 'o:' || o_orderkey AS answer FROM {_O} JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING' AND coalesce({_URGENT} < '1996-01-01', true)",
    "chain_order_desc_nulls_first": f"SELECT answer FROM (SELECT 'c:' || c_custkey AS c, 'o:' || o_orderkey AS answer, {_URGENT} AS u FROM {_O} WHERE c_nationkey = 4) ORDER BY u DESC NULLS FIRST, c, answer LIMIT 40 OFFSET 10",
    "chain_order_asc_offset": "SELECT answer FROM (SELECT 'n:' || c_nationkey AS n, 'c:' || c_custkey AS answer, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2) ORDER BY c_acctbal NULLS LAST, n, answer LIMIT 20 OFFSET 5",
    "typed_comparison": """WITH t AS (SELECT DISTINCT 'order.date' AS relation, 0 AS kind, 'o:' || o_orderkey AS h, CAST(NULL AS DOUBLE) AS num, strftime(o_orderdate, '%Y-%m-%d') AS ts FROM orders
        UNION ALL SELECT DISTINCT 'order.totalprice', 1, 'o:' || o_orderkey, o_totalprice, NULL FROM orders UNION ALL SELECT DISTINCT 'customer.segment', 2, 'c:' || c_custkey, NULL, NULL FROM customer
        UNION ALL SELECT DISTINCT 'part.size', 1, 'p:' || p_partkey, CAST(p_size AS DOUBLE), NULL FROM part UNION ALL SELECT DISTINCT 'part.brand', 2, 'p:' || p_partkey, NULL, NULL FROM part)
        SELECT relation, CAST(kind AS INT) AS kind, CAST(count(*) AS BIGINT) AS n, round(max(num), 2) AS most, max(ts) AS last_day FROM t GROUP BY ALL""",
}
