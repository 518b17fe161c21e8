"""Further queries: graph patterns, statements as text and JSON, values of mixed kinds, pages and windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import html, slices, values
from facetry.functions import text as fn
from facetry.operators import graph, patterns
from facetry.plans import compile as plan
from facetry.queries import _NATIONS, nations, query, table
from facetry.sources import nquads
from facetry.sources.catalog import trade
from facetry.streaming.facets import windowed_terms

# --- graph patterns


def trade_statements(spark, d) -> DataFrame:
    """Regions, nations and customers as statements with references between them."""
    ref = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("label"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"), ref("region", "n_regionkey").alias("region"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), ref("nation", "c_nationkey").alias("nation"))
    parts = [graph.statements(rows, "trade", f"{kind}/", "k") for kind, rows in (("region", region), ("nation", nation), ("customer", customer))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT 'nation/' || n_nationkey AS nation, 'region/' || n_regionkey AS region, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def sparql_bgp(spark, d):
    return patterns.group(trade_statements(spark, d), ("?nation", "region", "?region"), ("?region", "label", "?label"))


@query("SELECT 'region/' || r_regionkey AS region, r_name AS label, 'nation/' || n_nationkey AS nation FROM region LEFT JOIN (SELECT * FROM nation WHERE n_name = 'NATION_3') ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def sparql_optional(spark, d):
    store = trade_statements(spark, d)
    regions = patterns.matched(store, "?region", "label", "?label").where(F.col("region").startswith("region/") & (F.col("label") != "ASIA"))
    return patterns.optional(regions, patterns.group(store, ("?nation", "region", "?region"), ("?nation", "label", "NATION_3")))


@query("SELECT 'nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer/' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def sparql_union(spark, d):
    store = trade_statements(spark, d)
    return patterns.either(patterns.matched(store, "?x", "region", "region/1"), patterns.matched(store, "?x", "segment", "BUILDING"))


@query("SELECT 'nation/' || n_nationkey AS nation, 'region/' || n_regionkey AS region FROM nation WHERE n_regionkey <> 0")
def sparql_minus(spark, d):
    store = trade_statements(spark, d)
    return patterns.without(patterns.matched(store, "?nation", "region", "?region"), patterns.matched(store, "?nation", "region", "region/0"))


@query("SELECT 'nation/' || n_nationkey AS nation FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING')")
def sparql_notexists(spark, d):
    store = trade_statements(spark, d)
    return patterns.without(patterns.matched(store, "?nation", "region", "?region").select("nation"), patterns.group(store, ("?c", "nation", "?nation"), ("?c", "segment", "BUILDING")))


@query("SELECT 'nation/' || n_nationkey AS nation, n_name AS label FROM nation WHERE n_name IN ('NATION_1', 'NATION_7')")
def sparql_values(spark, d):
    return patterns.matched(trade_statements(spark, d), "?nation", "label", "?label").where(F.col("label").isin("NATION_1", "NATION_7"))


@query("SELECT 'customer/' || c_custkey AS customer, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def sparql_path(spark, d):
    return patterns.along(trade_statements(spark, d), "nation", "region", "label", start="customer", end="region")


@query("SELECT 'nation/' || c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY c_nationkey HAVING count(*) > 3")
def sparql_group(spark, d):
    return patterns.matched(trade_statements(spark, d), "?c", "nation", "?nation").groupBy("nation").agg(F.count("*").alias("customers")).where("customers > 3")


@query("SELECT DISTINCT 'region/' || n_regionkey AS s, 'segment' AS p, c_mktsegment AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def sparql_construct(spark, d):
    rows = patterns.group(trade_statements(spark, d), ("?c", "segment", "?segment"), ("?c", "nation", "?n"), ("?n", "region", "?region"))
    return patterns.constructed(rows, ("?region", "segment", "?segment"))


@query("SELECT count(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'MACHINERY'")
def sparql_ask(spark, d):
    return patterns.asked(patterns.matched(trade_statements(spark, d), "?c", "segment", "MACHINERY"))


# --- statements as text and JSON


@query(_NATIONS)
def nquads_roundtrip(spark, d):
    return nquads.parsed(nquads.formatted(nations(spark, d))).select("graph", "s", "p", "o")


@query("SELECT 'nations' AS graph, 'region/' || r_regionkey AS s, 'r_name' AS p, r_name AS o FROM region")
def graph_replace(spark, d):
    new = graph.statements(table(spark, d, "region").select("r_regionkey", "r_name"), "regions", "region/", "r_regionkey")
    return graph.replace_graph(nations(spark, d), "nations", new)


@query("SELECT 'event/' || event_id AS s, 'k' AS p, json_extract_string(props, '$.k') AS o FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def jsonld_decode(spark, d):
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k string").alias("x")).select("event_id", "x.k")
    return graph.statements(rows, "events", "event/", "event_id").select("s", "p", "o")


@query("""SELECT n_nationkey, '{"@id":"nation/' || n_nationkey || '","label":"' || n_name || '","region":{"@id":"region/' || r_regionkey || '","label":"' || r_name || '"}}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey""")
def jsonld_encode(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    node = lambda kind, key, label, *more: F.struct(F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("@id"), F.col(label).alias("label"), *more)
    return rows.select("n_nationkey", F.to_json(node("nation", "n_nationkey", "n_name", node("region", "r_regionkey", "r_name").alias("region"))).alias("json"))


# --- facets and values


@query("SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def link_alias_hop(spark, d):
    joined, at = plan.followed(trade(spark, d), "order", "customer.name", trade(spark, d).rows("order"), outer=False)
    return joined.select(F.col("o_orderkey").alias("id"), at.alias("name"))


@query("SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL")
def filter_datatype_kind(spark, d):
    return table(spark, d, "events").where(fn.json_at(F.col("props"), "k").try_cast("bigint").isNotNull()).select("event_id")


@query("SELECT source FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source HAVING max(n) <= 1")
def filter_localized(spark, d):
    each = table(spark, d, "documents").groupBy("source", "lang").count()
    return each.groupBy("source").agg(F.max("count").alias("n")).where("n <= 1").select("source")


@query("""WITH v AS (SELECT 'string' AS type, event_type AS x FROM events UNION ALL SELECT 'number', CAST(user_id AS VARCHAR) FROM events), g AS (SELECT type, count(*) AS n FROM v GROUP BY 1 ORDER BY n DESC, type LIMIT 1)
SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS types FROM g""")
def stats_totals_after_slice(spark, d):
    e = table(spark, d, "events")
    v = e.select(F.lit("string").alias("type"), F.col("event_type").alias("x")).union(e.select(F.lit("number"), F.col("user_id").cast("string")))
    groups = v.groupBy("type").agg(F.count("*").alias("n"))
    return plan.sliced(groups, [F.desc("n"), F.asc("type")], 0, 1).agg(F.sum("n").alias("count"), F.count("*").alias("types"))


@query("""WITH v AS (SELECT DISTINCT kind, text FROM (SELECT 'number' AS kind, CAST(user_id AS VARCHAR) AS text FROM events UNION ALL SELECT 'string', event_type FROM events UNION ALL SELECT 'iri', 'nation/' || n_nationkey FROM nation UNION ALL SELECT 'number', 'many'))
SELECT kind, text FROM v ORDER BY CASE kind WHEN 'iri' THEN 2 WHEN 'number' THEN 4 ELSE 6 END, kind = 'number' AND try_cast(text AS DOUBLE) IS NULL, CASE WHEN kind = 'number' THEN try_cast(text AS DOUBLE) END NULLS FIRST, text""")
def value_order(spark, d):
    e, n = table(spark, d, "events"), table(spark, d, "nation")
    kind = lambda k: F.lit(k).alias("kind")
    v = e.select(kind("number"), F.col("user_id").cast("string").alias("text")).union(e.select(kind("string"), "event_type")).union(n.select(kind("iri"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")))).union(n.limit(1).select(kind("number"), F.lit("many")))
    return v.distinct().orderBy(values.sort_key(F.col("kind"), F.col("text")))


# --- functions


@query("SELECT event_id, unnest([CAST(user_id AS VARCHAR), event_type]) AS value FROM events")
def flow_flatmap(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.array(F.col("user_id").cast("string"), "event_type")).alias("value"))


@query(r"SELECT o_orderkey, regexp_extract(o_orderpriority, '^(\d)-(.*)$', 2) AS priority FROM orders")
def fn_regex_group(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.regexp_extract("o_orderpriority", r"^(\d)-(.*)$", 2).alias("priority"))


@query("SELECT c_custkey, replace(url_encode(c_mktsegment || ' & more'), '%20', '+') AS code, c_mktsegment || ' & more' AS text FROM customer")
def fn_url_codec(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.url_encode(F.concat("c_mktsegment", F.lit(" & more"))).alias("code"))
    return rows.withColumn("text", F.url_decode("code"))


@query("SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS lat, CAST(c_nationkey AS DOUBLE) AS lon FROM customer")
def fn_point(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.format_string("Point(%d %d)", "c_nationkey", "c_custkey").alias("point"))
    lat, lon = fn.point(F.col("point"))
    return rows.select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def fn_clean_marks(spark, d):
    return slices.with_column(table(spark, d, "documents").select("doc_id", "text"), "text", F.col("text"), values.bare_texts, "string")


# --- pages, texts and time


@query()
def html_untag(spark, d):
    return slices.with_column(table(spark, d, "pages").select("page_id", F.col("html").alias("text")), "text", F.col("text"), html.untagged_texts, "string")


@query()
def html_extract(spark, d):
    return slices.with_column(table(spark, d, "pages").select("page_id", F.col("html").alias("text")), "text", F.col("text"), html.main_texts, "string")


@query("""WITH b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))) AS token FROM benchmark), t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))) AS token FROM documents)
SELECT doc_id, count(*) AS tokens, count(b.token) AS tagged FROM t LEFT JOIN b USING (token) GROUP BY 1""")
def text_corpus_tag(spark, d):
    words = lambda name, *keep: table(spark, d, name).select(*keep, F.explode(F.transform(fn.tokens(F.col("text")), F.lower)).alias("token"))
    known = words("benchmark").distinct().withColumn("type", F.lit("benchmark"))
    counted = words("documents", "doc_id").groupBy("doc_id", "token").agg(F.count("*").alias("n"))  # before the shuffle, so that a frequent token is a row a text
    return counted.join(known, "token", "left").groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))), F.lit(0).cast("long")).alias("tagged"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS value, count(*) AS count FROM events GROUP BY 1, 2")
def stream_terms_tumbling(spark, d):
    return windowed_terms(table(spark, d, "events"), "ts", "event_type")
