"""Queries of the facet language, of shapes as validators and JSON forms, of changes to statements, and of spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.functions import text as fn
from facetry.more import trade_statements
from facetry.operators import graph, patterns, spans, updates
from facetry.plans import compile as plan
from facetry.plans import facets
from facetry.plans import shapes as s
from facetry.queries import _NATIONS, SQL, Q, nations, query, table
from facetry.sources import jsonld
from facetry.sources.catalog import trade

# --- the facet language


def faceted(name: str, entity: str, text: str | dict, sql: str) -> None:
    """Registers the identifiers that a query in the facet language selects."""

    def run(spark, d):
        catalog = trade(spark, d)
        return plan.selected(catalog, entity, facets.parsed(catalog, entity, text)["shape"]).select(F.col(catalog[entity].key).alias("id"))

    Q[name], SQL[name] = run, sql


_C = "SELECT c_custkey AS id FROM customer WHERE "
_O = "SELECT o_orderkey AS id FROM orders WHERE "
faceted("facet_form_values", "customer", "segment=BUILDING,MACHINERY&>%3Dbalance=1000", _C + "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000")
faceted("facet_url_json", "customer", "%7B%22%3C%20balance%22%3A%200%7D", _C + "c_acctbal < 0")
faceted("facet_exclusive", "customer", '{"> balance": "100.5", "< balance": 2000}', _C + "c_acctbal > 100.5 AND c_acctbal < 2000")
faceted("facet_dates", "order", {">= date": "1996-01-01", "<= date": "1996-12-31"}, _O + "o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
faceted("facet_datatype", "customer", {"^ balance": "xsd:double", "^ name": "string"}, _C + "c_acctbal IS NOT NULL AND c_name IS NOT NULL")
faceted("facet_class", "customer", {"@": "BUSINESS"}, "WITH RECURSIVE up AS (SELECT 'BUSINESS' AS c UNION SELECT a FROM (VALUES ('MACHINERY', 'INDUSTRY'), ('AUTOMOBILE', 'INDUSTRY'), ('BUILDING', 'CONSTRUCTION'), ('INDUSTRY', 'BUSINESS'), ('CONSTRUCTION', 'BUSINESS')) v(a, b) JOIN up ON b = up.c) " + _C + "c_mktsegment IN (SELECT c FROM up)")
faceted("facet_class_inner", "nation", {"@ customers": "INDUSTRY"}, "SELECT DISTINCT n_nationkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('MACHINERY', 'AUTOMOBILE')")
faceted("facet_range", "order", {"% lines.flag": ["N", "A"]}, _O + "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag NOT IN ('N', 'A'))")
faceted("facet_lengths", "customer", {"$> segment": 9, "$< segment": 9}, _C + "length(c_mktsegment) = 9")
faceted("facet_pattern_like_stem", "customer", {"* name": "[13579]$", "~ segment": "auto", "' segment": "A"}, _C + r"regexp_matches(c_name, '[13579]$') AND regexp_matches(c_mktsegment, '(?i)\bauto') AND starts_with(c_mktsegment, 'A')")
faceted("facet_counts", "order", {"#> lines": 2, "#< lines": 3}, _O + "(SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) BETWEEN 2 AND 3")
faceted("facet_all", "order", {"! lines.flag": ["R", "A"]}, _O + "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2)")
faceted("facet_any_path", "order", {"? customer.nation.region.label": ["ASIA", "EUROPE"], ".order": "-total", ".limit": 5, "status": []}, _O + "o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))")
faceted("facet_root", "customer", {"?": [3, 4, "5"]}, _C + "c_custkey IN (3, 4, 5)")
faceted("filter_set_below_steps", "nation", {"#> customers.orders": 3}, "SELECT DISTINCT c_nationkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 3)")


@query("SELECT c_mktsegment AS value, count(*) AS count, CAST(NULL AS VARCHAR) AS label FROM customer WHERE c_acctbal >= 0 GROUP BY 1")
def facet_terms_first(spark, d):
    return facets.answered(trade(spark, d), "customer", {".terms": "segment", ".stats": "balance", ".order": "name", ">= balance": 0})


@query("SELECT c_nationkey AS value, count(*) AS count, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 3")
def terms_labelled(spark, d):
    return facets.answered(trade(spark, d), "customer", ".terms=nation")


@query("SELECT count(c_acctbal) AS count, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer WHERE c_mktsegment = 'BUILDING'")
def facet_stats(spark, d):
    return facets.answered(trade(spark, d), "customer", "segment=BUILDING&.stats=balance")


@query("""WITH i AS (SELECT c_custkey AS id, c_nationkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS position FROM customer QUALIFY position < 20)
SELECT id, position, (SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) FROM orders WHERE o_custkey = id) AS statuses, (SELECT list(DISTINCT s_suppkey ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey) AS suppliers FROM i""")
def items_grouped(spark, d):
    return facets.answered(trade(spark, d), "customer", {".order": "-balance", ".limit": 20}, {"statuses": "orders.status", "suppliers": "nation.suppliers"})


@query("""SELECT '{"contains":[' || string_agg('{"@id":' || r_regionkey || ',"label":["' || r_name || '"]}', ',' ORDER BY r_name DESC) || ']}' AS json FROM region""")
def facet_document_items(spark, d):
    return facets.document(trade(spark, d), "region", {".order": "-label"}, {"label": "label"})


@query("""WITH t AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1) SELECT '{"terms":[' || string_agg('{"value":"' || v || '","count":' || n || '}', ',' ORDER BY n DESC, v) || ']}' AS json FROM t""")
def facet_document_terms(spark, d):
    return facets.document(trade(spark, d), "order", {".terms": "status"})


# --- shapes as validators and JSON forms


@query("""SELECT l_orderkey * 10 + l_linenumber AS focus, 'quantity' AS path, 'min_inclusive(5)' AS rule FROM lineitem WHERE l_quantity < 5
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'flag', 'one_of(N, A)' FROM lineitem WHERE l_returnflag NOT IN ('N', 'A')""")
def validate_shape(spark, d):
    return plan.violations(trade(spark, d), "line", s.both(s.field("quantity", s.min_inclusive(5)), s.field("flag", s.one_of("N", "A"))))


@query("""SELECT o_orderkey AS focus, 'lines' AS path, '..3 values' AS rule FROM orders WHERE (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) > 3
UNION ALL SELECT o_orderkey, 'total', 'max_exclusive(200000)' FROM orders WHERE o_totalprice >= 200000""")
def validate_counts(spark, d):
    return plan.violations(trade(spark, d), "order", s.both(s.field("lines", s.max_count(3)), s.field("total", s.max_exclusive(200000))))


_TREE = {"label": None, "region": {"label": None}}


@query("""SELECT n_nationkey AS id, '{"@id":"nation/' || n_nationkey || '","label":"' || n_name || '","region":{"@id":"region/' || r_regionkey || '","label":"' || r_name || '"}}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey""")
def jsonld_shape_encode(spark, d):
    return jsonld.encoded(trade(spark, d), "nation", _TREE)


@query("""SELECT 'region/' || r_regionkey AS s, 'label' AS p, r_name AS o FROM region
UNION ALL SELECT 'region/' || n_regionkey, 'nations', 'nation/' || n_nationkey FROM nation UNION ALL SELECT 'nation/' || n_nationkey, 'label', n_name FROM nation""")
def jsonld_roundtrip(spark, d):
    catalog, tree = trade(spark, d), {"label": None, "nations": {"label": None}}
    return jsonld.decoded(jsonld.encoded(catalog, "region", tree), catalog, "region", tree)


# --- statements


_Q = f"WITH q AS ({_NATIONS}) "


@query(_Q + "SELECT graph, s, CASE WHEN p = 'n_name' AND EXISTS (SELECT 1 FROM q r WHERE r.s = q.s AND r.p = 'n_regionkey' AND r.o = '1') THEN 'label' ELSE p END AS p, o FROM q")
def sparql_update(spark, d):
    store = nations(spark, d)
    bound = patterns.group(store, ("?n", "n_regionkey", "1"), ("?n", "n_name", "?label"))
    return updates.modified(store, "nations", bound, delete=(("?n", "n_name", "?label"),), insert=(("?n", "label", "?label"),))


@query(_Q + "SELECT * FROM q UNION ALL SELECT 'regions', 'region/' || r_regionkey, 'r_name', r_name FROM region")
def graph_upload(spark, d):
    new = graph.statements(table(spark, d, "region").select("r_regionkey", "r_name"), "new", "region/", "r_regionkey")
    once = updates.uploaded(nations(spark, d), new, "regions")
    return updates.uploaded(once, new, "regions", clear=True)


@query(_Q + "SELECT DISTINCT s, p, o FROM q")
def sparql_from_graphs(spark, d):
    store = nations(spark, d)
    return patterns.in_graphs(store.union(store.withColumn("graph", F.lit("copy"))).union(store.withColumn("graph", F.lit("other")).withColumn("o", F.lit("x"))), "nations", "copy")


@query(_Q + "SELECT s AS start, o AS \"end\" FROM q")
def sparql_path_alternatives(spark, d):
    return patterns.any_of(nations(spark, d), "n_name", "n_regionkey")


@query("""WITH RECURSIVE up AS (SELECT 'nation/' || n_nationkey AS a, 'nation/' || (n_nationkey // 2) AS b FROM nation WHERE n_nationkey > 0), c AS (SELECT a, b FROM up UNION SELECT c.a, up.b FROM c JOIN up ON c.b = up.a)
SELECT a AS start, b AS "end" FROM c UNION SELECT 'nation/' || n_nationkey, 'nation/' || n_nationkey FROM nation""")
def sparql_path_repeated(spark, d):
    half = table(spark, d, "nation").where("n_nationkey > 0").select("n_nationkey", F.concat(F.lit("nation/"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("half"))
    return patterns.repeated(graph.statements(half, "halves", "nation/", "n_nationkey"), "half", zero=True)


@query("SELECT 'nation/' || n_nationkey AS nation, 'region/' || n_regionkey AS region, n_name AS label FROM nation WHERE (n_regionkey = 1 AND n_name = 'NATION_1') OR n_regionkey = 2")
def sparql_values_columns(spark, d):
    bound = patterns.group(trade_statements(spark, d), ("?nation", "region", "?region"), ("?nation", "label", "?label"))
    return patterns.values(bound, region=["region/1", "region/2"], label=["NATION_1", None])


@query("SELECT 'trade' AS graph, 'region/1' AS s, 'label' AS p, r_name AS o FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'trade', 'nation/' || n_nationkey, 'region', 'region/1' FROM nation WHERE n_regionkey = 1")
def sparql_describe(spark, d):
    return patterns.described(trade_statements(spark, d).select(graph.STATEMENT), spark.createDataFrame([("region/1",)], "s string"))


@query(_Q + "SELECT graph, CASE WHEN s = 'nation/3' THEN 'nation/300' ELSE s END AS s, p, o FROM q")
def frame_refocus(spark, d):
    return updates.refocused(nations(spark, d), "nation/3", "nation/300")


@query("SELECT user_id AS item, max(event_id) AS version FROM events GROUP BY 1 HAVING max(event_id) > coalesce(max(CASE WHEN event_type = 'click' THEN event_id END), -1)")
def mirror_stale(spark, d):
    seen = table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("version"), "event_type")
    return updates.stale(seen.groupBy("item").agg(F.max("version").alias("version")), seen.where("event_type = 'click'"))


@query(_Q + "SELECT graph, s, p, o FROM q WHERE CAST(split_part(s, '/', 2) AS INT) >= 10 UNION ALL SELECT 'nations', 'nation/' || n_nationkey, 'n_name', upper(n_name) || '!' FROM nation WHERE n_nationkey < 10")
def mirror_load(spark, d):
    few = table(spark, d, "nation").where("n_nationkey < 10").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"))
    new = graph.statements(few, "nations", "nation/", "n_nationkey")
    return updates.mirrored(nations(spark, d), new.select(F.col("s").alias("item")), new)


@query("""SELECT 'trade' AS graph, 'nation/' || n_nationkey AS s, 'label' AS p, n_name AS o FROM nation UNION ALL SELECT 'trade', 'nation/' || n_nationkey, 'region', 'region/' || n_regionkey FROM nation WHERE n_regionkey < 3
UNION ALL SELECT 'trade', 'region/' || r_regionkey, 'label', r_name FROM region WHERE r_regionkey < 3""")
def mirror_reap(spark, d):
    store = trade_statements(spark, d).where(~F.col("s").startswith("customer/"))
    live = table(spark, d, "region").where("r_regionkey < 3").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("item"))
    return updates.reaped(store, live, "region/")


@query("""SELECT 'region/' || r_regionkey AS s, 'schema:name' AS p, r_name AS o, 'en' AS lang FROM region UNION ALL SELECT 'region/' || r_regionkey, 'code', CAST(r_regionkey AS VARCHAR), NULL FROM region""")
def statements_localised(spark, d):
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("schema:name"), F.col("r_regionkey").alias("code"))
    store = graph.statements(rows.select("k", F.col("`schema:name`").alias("schema_name"), "code"), "regions", "region/", "k").withColumn("p", F.replace("p", F.lit("schema_"), F.lit("schema:")))
    return updates.localised(store, "en").select("s", "p", "o", "lang")


@query("""WITH RECURSIVE r AS (SELECT 'https://site/a/1' AS url UNION SELECT 'https://site/a/' || k.to_ FROM r JOIN (SELECT o_orderkey % 200 + 1 AS from_, o_custkey % 150 + 1 AS to_ FROM orders) k ON r.url = 'https://site/a/' || k.from_ WHERE k.to_ % 3 <> 0) SELECT url FROM r""")
def crawl_frontier(spark, d):
    page = lambda c: F.concat(F.lit("https://site/a/"), c.cast("string"))
    to = F.col("o_custkey") % 150 + 1
    links = table(spark, d, "orders").select(page(F.col("o_orderkey") % 200 + 1).alias("source"), F.when(to % 3 == 0, F.concat(F.lit("https://other/"), to.cast("string"))).otherwise(F.concat(page(to), F.lit("?ref=x#top"))).alias("target"))
    return updates.crawled(links, spark.createDataFrame([("https://site/a/1#start",)], "url string"), "https://site/a/")


# --- spans and functions


_SPANS = "WITH e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + 1 + event_id % 900 AS b, event_type FROM events), x AS (SELECT * FROM e WHERE event_type = 'click'), y AS (SELECT * FROM e WHERE event_type = 'error') "


def event_spans(spark, d):
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    e = table(spark, d, "events").select("user_id", "event_id", start.alias("start"), (start + 1 + F.col("event_id") % 900).alias("end"), "event_type")
    return [e.where(F.col("event_type") == k).drop("event_type") for k in ("click", "error")]


@query(_SPANS + "SELECT x.event_id AS outer_id, y.event_id AS inner_id FROM x JOIN y USING (user_id) WHERE x.a <= y.a AND y.b <= x.b")
def span_contains(spark, d):
    return spans.joined(*event_spans(spark, d), "user_id", "contains", 600).select(F.col("event_id").alias("outer_id"), F.col("_event_id").alias("inner_id"))


@query(_SPANS + "SELECT x.event_id AS one, y.event_id AS other FROM x JOIN y USING (user_id) WHERE x.a < y.b AND y.a < x.b")
def span_intersects(spark, d):
    return spans.joined(*event_spans(spark, d), "user_id", "intersects", 600).select(F.col("event_id").alias("one"), F.col("_event_id").alias("other"))


@query("""WITH e AS (SELECT event_type, event_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 1 + CASE WHEN event_id % 50 = 0 THEN 86400 * (event_id % 7 + 1) ELSE event_id % 900 END AS b FROM events)
SELECT x.event_id AS outer_id, count(*) AS inner FROM e x JOIN e y ON x.event_type = y.event_type AND x.event_id % 50 = 0 AND y.event_id % 50 <> 0 AND x.a <= y.a AND y.b <= x.b GROUP BY 1""")
def span_holds(spark, d):
    """How many short events each event of days holds: spans of very different lengths."""
    start, n = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000), F.col("event_id")
    e = table(spark, d, "events").select("event_type", "event_id", start.alias("start"), (start + 1 + F.when(n % 50 == 0, 86400 * (n % 7 + 1)).otherwise(n % 900)).alias("end"))
    found = spans.held(e.where(n % 50 == 0), e.where(n % 50 != 0), "event_type").where("held > 0")
    return found.groupBy(F.col("event_id").alias("outer_id")).agg(F.sum("held").alias("inner"))


@query("""SELECT c_custkey, ['a=' || c_custkey, 'b c=' || coalesce(c_mktsegment, ''), 'flag='] AS pairs FROM customer""")
def fn_query_parameters(spark, d):
    text = F.concat(F.lit("a="), F.col("c_custkey").cast("string"), F.lit("&b+c="), F.col("c_mktsegment"), F.lit("&flag"))
    return table(spark, d, "customer").select("c_custkey", F.transform(fn.parameters(text), lambda x: F.concat(x["name"], F.lit("="), x["value"])).alias("pairs"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'item/' || md5(url) ELSE url END AS name FROM pages")
def fn_iri_rewrite(spark, d):
    return table(spark, d, "pages").select("page_id", fn.rewritten(F.col("url"), "https://", "item/").alias("name"))


@query("SELECT n_nationkey, list(n_name || '/' || r_name || '/' || x ORDER BY r_regionkey, x) AS paths FROM nation, region, (VALUES ('en'), ('fr')) v(x) GROUP BY n_nationkey")
def fn_fill_each(spark, d):
    names = table(spark, d, "region").agg(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]).alias("regions"))
    rows = table(spark, d, "nation").join(F.broadcast(names), F.lit(True))  # one row
    return rows.select("n_nationkey", fn.filled_each("{n}/{r}/{l}", n=F.array("n_name"), r=F.col("regions"), l=F.array(F.lit("en"), F.lit("fr"))).alias("paths"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 39) || '…' || right(text, 39) END AS short FROM documents")
def fn_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.clipped(F.col("text")).alias("short"))
