"""Queries of statements that follow from others, of frames, and of groups and batches of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.more import trade_statements
from facetry.operators import flow, graph, inference, patterns
from facetry.plans import shapes as s
from facetry.queries import nations, query, table
from facetry.sources import frames

_SCHEMA = [
    ("MACHINERY", "rdfs:subClassOf", "INDUSTRY"), ("AUTOMOBILE", "rdfs:subClassOf", "INDUSTRY"), ("INDUSTRY", "rdfs:subClassOf", "BUSINESS"), ("Place", "rdfs:subClassOf", "Thing"),
    ("nation", "rdfs:subPropertyOf", "within"), ("region", "rdfs:subPropertyOf", "within"), ("within", "rdfs:range", "Place"), ("segment", "rdfs:subPropertyOf", "rdf:type"),
    ("label", "rdfs:domain", "Named"), ("isA", "rdfs:subPropertyOf", "rdfs:subClassOf"), ("BUILDING", "isA", "BUSINESS"),
]


def schema_statements(spark, d) -> DataFrame:
    """The trade statements under a small schema, in which a property of its own states classes."""
    schema = spark.createDataFrame([("schema", *x) for x in _SCHEMA], graph.STATEMENT)
    return trade_statements(spark, d).select(graph.STATEMENT).unionByName(schema)


@query(f"""WITH RECURSIVE store AS (SELECT 'region/' || r_regionkey AS s, 'label' AS p, r_name AS o FROM region UNION SELECT 'nation/' || n_nationkey, 'label', n_name FROM nation UNION SELECT 'nation/' || n_nationkey, 'region', 'region/' || n_regionkey FROM nation
  UNION SELECT 'customer/' || c_custkey, 'segment', c_mktsegment FROM customer UNION SELECT 'customer/' || c_custkey, 'nation', 'nation/' || c_nationkey FROM customer UNION SELECT * FROM (VALUES {", ".join(map(str, _SCHEMA))}) v(s, p, o)),
sub AS (SELECT s, o FROM store WHERE p IN ('rdfs:subClassOf', 'isA') UNION SELECT sub.s, e.o FROM sub JOIN store e ON e.s = sub.o AND e.p IN ('rdfs:subClassOf', 'isA')),
prop AS (SELECT s, o FROM store WHERE p = 'rdfs:subPropertyOf' UNION SELECT prop.s, e.o FROM prop JOIN store e ON e.s = prop.o AND e.p = 'rdfs:subPropertyOf'),
lifted AS (SELECT * FROM store UNION SELECT store.s, prop.o, store.o FROM store JOIN prop ON prop.s = store.p),
typed AS (SELECT s, o FROM lifted WHERE p = 'rdf:type' UNION SELECT l.s, d.o FROM lifted l JOIN store d ON d.p = 'rdfs:domain' AND d.s = l.p UNION SELECT l.o, r.o FROM lifted l JOIN store r ON r.p = 'rdfs:range' AND r.s = l.p)
SELECT * FROM lifted UNION SELECT s, 'rdf:type', o FROM typed UNION SELECT typed.s, 'rdf:type', sub.o FROM typed JOIN sub ON sub.s = typed.o UNION SELECT s, 'rdfs:subClassOf', o FROM sub UNION SELECT s, 'rdfs:subPropertyOf', o FROM prop""")
def rdfs_inferred(spark, d):
    return inference.inferred(schema_statements(spark, d))


@query("""WITH RECURSIVE n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT 'order/' || a.o_orderkey AS a, 'order/' || b.o_orderkey AS b FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND b.i < a.i""")
def closure_of_chains(spark, d):
    """All earlier orders of each order's customer, from each order's link to the one before."""
    orders = table(spark, d, "orders")
    name = lambda c: F.concat(F.lit("order/"), F.col(c).cast("string"))
    before = orders.withColumn("before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("before IS NOT NULL")
    found = graph.closure(before.select(F.col("o_orderkey").alias("a"), F.col("before").alias("b")))
    return found.select(name("a").alias("a"), name("b").alias("b"))


# --- frames


_NATION = s.both(s.field("label", s.required()), s.field("region", s.required(s.field("label", s.required()), s.field("nations", s.field("label", s.required())))))
_CONTEXT = {"nations": "^region"}


@query("""WITH r AS (SELECT n.n_nationkey AS k, string_agg(CASE WHEN o.n_nationkey = n.n_nationkey THEN '{"@id":"nation/' || o.n_nationkey || '"}' ELSE '{"@id":"nation/' || o.n_nationkey || '","label":"' || o.n_name || '"}' END, ',' ORDER BY 'nation/' || o.n_nationkey) AS nations FROM nation n JOIN nation o ON o.n_regionkey = n.n_regionkey GROUP BY 1)
SELECT 'nation/' || n_nationkey AS focus, '{"@id":"nation/' || n_nationkey || '","label":"' || n_name || '","region":{"@id":"region/' || r_regionkey || '","label":"' || r_name || '","nations":[' || nations || ']}}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey JOIN r ON k = n_nationkey""")
def frames_cyclic(spark, d):
    store = trade_statements(spark, d)
    foci = store.where("p = 'label' AND s LIKE 'nation/%'").select("s")
    return frames.framed(store, foci, _NATION, _CONTEXT)


@query("""SELECT 'nation/' || n_nationkey AS s, 'label' AS p, n_name AS o FROM nation UNION ALL SELECT 'nation/' || n_nationkey, 'region', 'region/' || n_regionkey FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'label', r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def frames_roundtrip(spark, d):
    return frames.unframed(frames_cyclic(spark, d), _NATION, _CONTEXT).select("s", "p", "o")


# --- groups and batches


@query("SELECT event_type AS kind, list(DISTINCT user_id ORDER BY user_id) AS users FROM events GROUP BY 1")
def flow_group_values(spark, d):
    return flow.grouped(table(spark, d, "events"), F.col("event_type").alias("kind"), "user_id", name="users")


@query("SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 1000) AS BIGINT) AS batch FROM events")
def flow_batch_all(spark, d):
    return flow.batched(table(spark, d, "events"), 1000, order=["ts", "event_id"]).select("event_id", "batch")


# --- what changes find, and graphs in patterns


@query("""SELECT 'nation/' || k AS s, CASE WHEN k IN (SELECT n_nationkey FROM nation) THEN 'conflict' ELSE 'created' END AS outcome FROM (SELECT DISTINCT c_custkey % 40 AS k FROM customer)""")
def crud_outcomes(spark, d):
    new = table(spark, d, "customer").select(F.concat(F.lit("nation/"), (F.col("c_custkey") % 40).cast("string")).alias("s"))
    return graph.outcomes(nations(spark, d), new, "conflict", "created")


@query("SELECT 'nations' AS graph, 'replaced' AS outcome UNION ALL SELECT 'regions', 'created' UNION ALL SELECT 'none', 'missing'")
def graph_outcomes(spark, d):
    store = nations(spark, d)
    put = graph.graph_outcome(store, "nations", "replaced", "created").union(graph.graph_outcome(store, "regions", "replaced", "created"))
    return put.union(graph.graph_outcome(graph.drop_graph(store, "nations"), "none", "deleted", "missing"))


@query("SELECT g, 'nation/' || n_nationkey AS s, n_name AS name FROM nation, (VALUES ('nations'), ('copy')) v(g) WHERE n_regionkey = 1")
def sparql_graph_variable(spark, d):
    store = nations(spark, d)
    store = store.union(store.withColumn("graph", F.lit("copy"))).union(store.withColumn("graph", F.lit("other"))).union(store.withColumn("graph", F.lit(None).cast("string")))
    named = patterns.from_named(store, "nations", "copy")
    found = patterns.both(patterns.matched(named, "?s", "n_name", "?name", "?g"), patterns.matched(named, "?s", "n_regionkey", "?region", "?g"))
    return patterns.bound_to(found, region="1").select("g", "s", "name")
