"""Queries of aliases, of shapes that are rewritten, and of checked payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.plans import compile as plan
from facetry.plans import facets
from facetry.plans import shapes as s
from facetry.queries import chosen, query
from facetry.sources import jsonld, payloads
from facetry.sources.catalog import trade

# --- aliases: a purchase has the fields of its buyer


_BOUGHT = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT o_orderkey AS id FROM {_BOUGHT} WHERE c_mktsegment = 'BUILDING' AND r_name = 'ASIA' AND o_orderstatus = 'O' AND c_acctbal >= 0")
def link_filter(spark, d):
    catalog = trade(spark, d)
    q = facets.parsed(catalog, "purchase", {"segment": "BUILDING", "nation.region.label": "ASIA", "status": "O", ">= balance": 0})
    return plan.selected(catalog, "purchase", q["shape"]).select(F.col("o_orderkey").alias("id"))


@query(f"SELECT o_orderkey AS id FROM {_BOUGHT} WHERE c_mktsegment = 'MACHINERY' AND c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def link_shape(spark, d):
    return chosen(spark, d, "purchase", s.link("buyer", s.field("segment", s.one_of("MACHINERY")), s.field("orders", s.min_count(12))))


@query(f"SELECT n_name AS value, count(DISTINCT o_orderkey) AS count FROM {_BOUGHT} WHERE o_orderstatus = 'F' GROUP BY 1")
def link_terms(spark, d):
    return plan.terms(trade(spark, d), "purchase", "nation.label", s.field("status", s.one_of("F")))


@query(f"SELECT o_orderkey AS id, c_name AS name, o_orderstatus AS status, r_name AS region FROM {_BOUGHT} ORDER BY c_acctbal DESC, o_orderkey LIMIT 30")
def link_projection(spark, d):
    return plan.items(trade(spark, d), "purchase", project={"name": "name", "status": "status", "region": "nation.region.label"}, orders=[("balance", True)], limit=30)


# --- languages


@query("SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'fr') AND length(text) >= 500")
def shape_lang(spark, d):
    return chosen(spark, d, "document", s.both(s.field("text", s.lang("en", "fr", "xx"), s.min_length(500)), s.field("text", s.lang("fr", "en"))))


@query("SELECT doc_id AS id FROM documents WHERE lang IN ('de')")
def shape_localised_to(spark, d):
    return chosen(spark, d, "document", s.localised(s.field("text", s.lang("en", "de")), "de", "it"))


@query("SELECT n_chars AS id FROM documents WHERE n_chars IS NOT NULL GROUP BY 1 HAVING n_chars NOT IN (SELECT n_chars FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL GROUP BY n_chars, lang HAVING count(DISTINCT text) > 1)")
def shape_localized(spark, d):
    return chosen(spark, d, "size", s.field("texts", s.field("text", s.localized())))


# --- shapes that are rewritten


@query("""SELECT o_orderkey AS focus, 'status' AS path, 'every one_of(O, F)' AS rule FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'customer', 'any(1, 2, 3)' FROM orders WHERE o_custkey NOT IN (1, 2, 3)""")
def validate_expanded(spark, d):
    shape = s.expanded(s.both(s.field("status", s.in_range("O", "F")), s.field("customer", s.has_any(1, 2, 3))))
    return plan.violations(trade(spark, d), "order", shape)


@query("""SELECT 'customer/' || c_custkey AS s, 'type' AS p, 'Customer' AS o FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'within', 'Market' FROM customer
UNION ALL SELECT 'Register', 'lists', 'customer/' || c_custkey FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'record', 'customer/' || c_custkey || '/record' FROM customer UNION ALL SELECT 'Market', 'type', 'Place'""")
def shape_outlined(spark, d):
    shape = s.both(s.Clazz("Customer"), s.field("within", s.has_all("Market"), s.Clazz("Place")), s.field("^lists", s.has_all("Register")), s.field("record", s.has_all(s.Focus("/record"))), s.field("name", s.required()))
    return plan.outlines(trade(spark, d).rows("customer"), "c_custkey", "customer/", shape)


@query("""SELECT c_custkey AS id, '{"@id":"customer/' || c_custkey || '","name":"' || c_name || '","nation":{"@id":"nation/' || n_nationkey || '","label":"' || n_name || '"}}' AS json
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 5000 AND r_name = 'EUROPE'""")
def shape_conveyed(spark, d):
    only = lambda mode, *shapes: s.When(s.Guard("mode", (mode,)), s.both(*shapes), True)
    shape = s.both(
        only("filter", s.field("balance", s.min_inclusive(5000))),
        s.field("name", s.required()),
        s.field("nation", s.field("label", s.required()), only("filter", s.field("region", s.field("label", s.one_of("EUROPE"))))),
    )
    rows, tree = plan.conveyed(trade(spark, d), "customer", shape)
    return jsonld.encoded(trade(spark, d), "customer", tree, items=rows)


# --- validation


@query("""SELECT c_custkey AS focus, '' AS path, 'or' AS rule FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT (c_acctbal >= 2000 OR n_name = 'NATION_3')
UNION ALL SELECT c_custkey, 'segment', 'when' FROM customer WHERE CASE WHEN c_mktsegment LIKE 'B%' THEN length(c_mktsegment) > 8 ELSE c_mktsegment <> 'MACHINERY' END
UNION ALL SELECT c_custkey, 'name', 'pattern(Customer#0*[0-9]{1,2})' FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#0*[0-9]{1,2}')
UNION ALL SELECT c_custkey, 'nation.label', 'max_length(8)' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE length(n_name) > 8
UNION ALL SELECT c_custkey, 'orders', '1.. values' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'orders.status', 'one_of(O, F)' FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus NOT IN ('O', 'F')""")
def validate_nested(spark, d):
    first = s.When(s.stem("B"), s.max_length(8), s.one_of("MACHINERY"))
    shape = s.both(
        s.either(s.field("balance", s.min_inclusive(2000)), s.field("nation", s.field("label", s.one_of("NATION_3")))),
        s.field("segment", first), s.field("name", s.pattern("Customer#0*[0-9]{1,2}")), s.field("nation", s.field("label", s.max_length(8))),
        s.field("orders", s.min_count(1), s.field("status", s.one_of("O", "F"))),
    )
    return plan.violations(trade(spark, d), "customer", shape)


@query("""SELECT o_orderkey AS focus, 'total' AS path, 'max_exclusive(100000)' AS rule FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice >= 100000
UNION ALL SELECT o_orderkey, 'status', 'one_of(O)' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' AND o_orderstatus <> 'O'""")
def validate_when(spark, d):
    shape = s.When(s.field("customer", s.field("segment", s.one_of("BUILDING"))), s.field("total", s.max_exclusive(100000)), s.field("status", s.one_of("O")))
    return plan.violations(trade(spark, d), "order", shape)


def order_payloads(spark, d):
    """Orders with their customers and lines as JSON, with a field that no shape knows."""
    found = jsonld.encoded(trade(spark, d), "order", {"status": None, "total": None, "customer": {"name": None, "segment": None}, "lines": {"flag": None, "quantity": None}})
    return found.withColumn("json", F.regexp_replace("json", r"^\{", '{"note":[1,{"x":2}],'))


_ORDER = s.both(
    s.field("status", s.required(s.one_of("O", "F"))), s.field("customer", s.required(s.field("segment", s.required(s.max_length(9))))),
    s.field("lines", s.min_count(2), s.either(s.field("flag", s.has_any("N")), s.field("quantity", s.max_inclusive(40)))),
)


@query("""SELECT o_orderkey AS id, 'status' AS path, 'one_of(O, F)' AS rule FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'customer.segment', 'max_length(9)' FROM orders JOIN customer ON o_custkey = c_custkey WHERE length(c_mktsegment) > 9
UNION ALL SELECT o_orderkey, 'lines', '2.. values' FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) < 2
UNION ALL SELECT o_orderkey, 'lines', 'or' FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)""")
def payload_report(spark, d):
    found = payloads.checked(order_payloads(spark, d), trade(spark, d), "order", _ORDER)
    return found.select("id", F.inline("report"))


@query("""SELECT o_orderkey AS id, '{"@id":"order/' || o_orderkey || '","status":"' || o_orderstatus || '","customer":{"@id":"customer/' || c_custkey || '","segment":"' || c_mktsegment || '"}}' AS trimmed
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND length(c_mktsegment) <= 9""")
def payload_trimmed(spark, d):
    shape = s.both(s.field("status", s.required(s.has_all("O"))), s.field("customer", s.required(s.field("segment", s.required(s.max_length(9))))))
    return payloads.checked(order_payloads(spark, d), trade(spark, d), "order", shape).where("trimmed IS NOT NULL").select("id", "trimmed")
