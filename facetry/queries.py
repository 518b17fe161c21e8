"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions import text as fn
from facetry.operators import flow, graph
from facetry.plans import compile as plan
from facetry.plans import facets
from facetry.plans import shapes as s
from facetry.sources import nquads
from facetry.sources.catalog import trade

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def faceted(spark: SparkSession, folder: str, entity: str, query: dict, project: dict[str, str]) -> DataFrame:
    q = facets.parsed(trade(spark, folder), entity, query)
    return plan.items(trade(spark, folder), entity, q["shape"], project, q["orders"], q["offset"], q["limit"])


def chosen(spark: SparkSession, folder: str, entity: str, shape) -> DataFrame:
    catalog = trade(spark, folder)
    return plan.selected(catalog, entity, shape).select(F.col(catalog[entity].key).alias("id"))


# --- items, terms, stats


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND r_name = 'EUROPE' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10""")
def items_filter_order_slice(spark, d):
    return faceted(spark, d, "customer", {"segment": "BUILDING", ">= balance": 0, "nation.region.label": "EUROPE", ".order": "-balance", ".limit": 10}, {"name": "name", "balance": "balance", "nation": "nation.label"})


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_orderkey LIMIT 100")
def items_default_limit_100(spark, d):
    return faceted(spark, d, "order", {}, {"total": "total"})


@query("""WITH c AS (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50) SELECT c_custkey AS id, o_orderkey AS "order" FROM c LEFT JOIN orders ON o_custkey = c_custkey""")
def items_optional_projection(spark, d):
    return faceted(spark, d, "customer", {".limit": 50}, {"order": "orders"})


@query("""WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('R')) ORDER BY 1 LIMIT 100)
SELECT o_orderkey AS id, l_returnflag AS flag FROM o JOIN lineitem ON l_orderkey = o_orderkey""")
def items_independent_bindings(spark, d):
    return plan.items(trade(spark, d), "order", s.field("lines", s.field("flag", s.one_of("R"))), {"flag": "lines.flag"})


@query("SELECT o_orderkey AS id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey ORDER BY max(l_extendedprice) DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
def items_multivalued_sort(spark, d):
    return plan.items(trade(spark, d), "order", orders=[("lines.price", True)], offset=5, limit=20)


@query("SELECT c_mktsegment AS value, count(DISTINCT c_custkey) AS count FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def terms_segment(spark, d):
    return plan.terms(trade(spark, d), "customer", "segment")


@query("SELECT l_returnflag AS value, count(DISTINCT l_orderkey * 10 + l_linenumber) AS count FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def terms_filtered_same_path(spark, d):
    return plan.terms(trade(spark, d), "line", "flag", s.field("flag", s.has_any("A", "R")))


@query("SELECT n_name AS value, count(DISTINCT c_custkey) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY count DESC, value LIMIT 5 OFFSET 2")
def terms_slice(spark, d):
    return plan.terms(trade(spark, d), "customer", "nation.label", offset=2, limit=5)


@query("SELECT count(l_quantity) AS count, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def stats_numeric(spark, d):
    return plan.stats(trade(spark, d), "order", "lines.quantity", s.field("status", s.has_all("O")))


@query("""SELECT CASE WHEN x IS NULL THEN 'null' WHEN try_cast(x AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END AS type, count(*) AS count, min(x) AS min, max(x) AS max
FROM (SELECT event_type AS x FROM events UNION ALL SELECT CAST(user_id AS VARCHAR) FROM events) GROUP BY 1""")
def stats_by_type(spark, d):
    e = table(spark, d, "events")
    x = e.select(F.col("event_type").alias("x")).union(e.select(F.col("user_id").cast("string")))
    kind = F.when(F.col("x").isNull(), "null").when(F.col("x").try_cast("double").isNotNull(), "number").otherwise("string")
    return plan.typed_stats(x.withColumn("kind", kind), "x", "kind")


# --- constraints


def simple(name: str, entity: str, shape, sql: str) -> None:
    Q[name] = lambda spark, d: chosen(spark, d, entity, shape)
    SQL[name] = sql


_LINE = "SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE "
simple("filter_min_inclusive", "line", s.field("quantity", s.min_inclusive(30)), _LINE + "l_quantity >= 30")
simple("filter_min_exclusive", "line", s.field("quantity", s.min_exclusive(30)), _LINE + "l_quantity > 30")
simple("filter_max_inclusive", "line", s.field("quantity", s.max_inclusive(10)), _LINE + "l_quantity <= 10")
simple("filter_max_exclusive", "line", s.field("quantity", s.max_exclusive(10)), _LINE + "l_quantity < 10")
simple("filter_min_length", "customer", s.field("segment", s.min_length(9)), "SELECT c_custkey AS id FROM customer WHERE length(c_mktsegment) >= 9")
simple("filter_max_length", "customer", s.field("segment", s.max_length(8)), "SELECT c_custkey AS id FROM customer WHERE length(c_mktsegment) <= 8")
simple("filter_pattern", "customer", s.field("name", s.pattern("0[1-5]$")), "SELECT c_custkey AS id FROM customer WHERE regexp_matches(c_name, '0[1-5]$')")
simple("filter_like", "customer", s.field("segment", s.like("build")), r"SELECT c_custkey AS id FROM customer WHERE regexp_matches(c_mktsegment, '(?i)\bbuild')")
simple("filter_stem", "customer", s.field("segment", s.stem("AUTO")), "SELECT c_custkey AS id FROM customer WHERE starts_with(c_mktsegment, 'AUTO')")
simple("filter_range", "order", s.field("lines", s.field("flag", s.in_range("N", "A"))), "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag NOT IN ('N', 'A'))")
simple("filter_min_count", "order", s.field("lines", s.min_count(5)), "SELECT o_orderkey AS id FROM orders WHERE (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) >= 5")
simple("filter_max_count", "order", s.field("lines", s.max_count(2)), "SELECT o_orderkey AS id FROM orders WHERE (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) <= 2")
simple("filter_all_nested", "order", s.field("lines", s.field("flag", s.has_all("R", "A"))), "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2)")
simple("filter_all_root", "customer", s.has_all(5), "SELECT c_custkey AS id FROM customer WHERE c_custkey = 5")
simple("filter_any", "order", s.field("lines", s.field("flag", s.one_of("R", "A"))), "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('R', 'A'))")
simple("filter_or_union", "customer", s.either(s.field("balance", s.min_exclusive(9000)), s.field("nation", s.field("label", s.one_of("NATION_3")))), "SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 OR n_name = 'NATION_3'")
simple("filter_and_merge", "line", s.both(s.field("quantity", s.min_inclusive(10)), s.field("quantity", s.max_inclusive(20))), _LINE + "l_quantity BETWEEN 10 AND 20")
simple("path_inverse_step", "nation", s.field("customers", s.field("balance", s.min_exclusive(9900))), "SELECT DISTINCT n_nationkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9900")
simple("path_seq", "order", s.field("customer", s.field("nation", s.field("region", s.field("label", s.one_of("ASIA"))))), "SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
simple("when_conditional", "customer", s.When(s.field("segment", s.one_of("BUILDING")), s.field("balance", s.min_inclusive(0)), s.field("balance", s.max_exclusive(0))), "SELECT c_custkey AS id FROM customer WHERE CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal >= 0 ELSE c_acctbal < 0 END")
simple("guard_redaction", "customer", s.redact(s.both(s.guarded("role", ("admin",), s.field("balance", s.min_inclusive(5000))), s.field("segment", s.one_of("MACHINERY"))), "role", "guest", "admin"), "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment = 'MACHINERY'")


@query("SELECT n_nationkey AS nation, s_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey")
def path_alt(spark, d):
    return plan.alternatives(trade(spark, d), "nation", ["suppliers.name", "customers.name"], "name").withColumnRenamed("id", "nation")


@query("SELECT lang, count(*) AS count FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def filter_lang(spark, d):
    return table(spark, d, "documents").where(s.one_of("en", "fr").test(F.col("lang"))).groupBy("lang").agg(F.count("*").alias("count"))


@query("SELECT 'min_quantity' AS rule, l_orderkey AS focus, l_linenumber AS line FROM lineitem WHERE NOT l_quantity >= 5 UNION ALL SELECT 'flag', l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('N', 'A')")
def validate_violations(spark, d):
    rows = table(spark, d, "lineitem")
    rules = {"min_quantity": s.min_inclusive(5).test(F.col("l_quantity")), "flag": s.one_of("N", "A").test(F.col("l_returnflag"))}
    broken = F.explode(F.filter(F.array(*(F.when(~ok, F.lit(k)) for k, ok in rules.items())), lambda x: x.isNotNull()))
    return rows.select(broken.alias("rule"), F.col("l_orderkey").alias("focus"), F.col("l_linenumber").alias("line"))


@query("""WITH RECURSIVE e AS (SELECT 'nation/' || n_nationkey AS a, 'region/' || n_regionkey AS b FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c""")
def class_closure(spark, d):
    name = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    edges = table(spark, d, "nation").select(name("nation", "n_nationkey").alias("a"), name("region", "n_regionkey").alias("b"))
    return graph.closure(edges.union(table(spark, d, "customer").select(name("customer", "c_custkey"), name("nation", "c_nationkey"))))


# --- dataflow


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def flow_optmap(spark, d):
    return flow.opt_map(table(spark, d, "events"), event_id=F.col("event_id"), k=fn.json_at(F.col("props"), "k").try_cast("bigint"))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def flow_bagmap(spark, d):
    return flow.bag_map(table(spark, d, "documents").select("doc_id", "text"), F.split("text", "\n", -1), "line").select("doc_id", "line")


@query("SELECT user_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 10) AS BIGINT) AS batch FROM events")
def flow_batch(spark, d):
    return flow.batched(table(spark, d, "events"), 10, "user_id", order=[F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "batch")


@query("SELECT DISTINCT user_id, event_type FROM events")
def flow_distinct(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct()


@query("SELECT event_type, count(*) AS count, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def flow_groupby(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT n_nationkey + 3 AS n FROM nation")
def flow_iter(spark, d):
    return flow.iterated(table(spark, d, "nation").select(F.col("n_nationkey").alias("n")), 3, lambda r: r.select((F.col("n") + 1).alias("n")))


@query("WITH RECURSIVE r AS (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation UNION SELECT n // 2 FROM r WHERE n > 1) SELECT n FROM r")
def flow_loop(spark, d):
    return flow.looped(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n")), lambda r: r.where("n > 1").select(F.floor(F.col("n") / 2).cast("long").alias("n")))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS "start", floor(epoch(ts))::BIGINT + event_id % 5000 + 1 AS "end" FROM events),
b AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" >= before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS cluster FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, cluster ORDER BY "end" - "start" DESC, "start", "end", event_id) AS n FROM c),
k AS (SELECT user_id, cluster, n, [{'a': "start", 'b': "end", 'id': event_id}] AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.cluster, o.n, CASE WHEN len(list_filter(kept, lambda x: x.a < o."end" AND o."start" < x.b)) = 0 THEN list_append(kept, {'a': o."start", 'b': o."end", 'id': o.event_id}) ELSE kept END
  FROM k JOIN o ON o.user_id = k.user_id AND o.cluster = k.cluster AND o.n = k.n + 1),
f AS (SELECT user_id, unnest(kept) AS x FROM (SELECT * FROM k QUALIFY n = max(n) OVER (PARTITION BY user_id, cluster)))
SELECT user_id, x.id AS event_id, x.a AS "start", x.b AS "end" FROM f""")
def flow_prune(spark, d):
    start = F.col("ts").cast("timestamp").cast("long")  # the tables hold times without a zone
    e = table(spark, d, "events").select("user_id", "event_id", start.alias("start"), (start + F.col("event_id") % 5000 + 1).alias("end"))
    return flow.pruned(e, "user_id", "start", "end")


# --- functions


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def fn_clean_space(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.clean_space(F.col("text")).alias("text"))


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z][\\w+.-]*://[^/?#]*)', 1) AS root, md5(url) AS md5 FROM pages")
def fn_url_root(spark, d):
    return table(spark, d, "pages").select("page_id", fn.root_of(F.col("url")).alias("root"), F.md5("url").alias("md5"))


@query("SELECT c_custkey, 'customers/' || c_custkey || '/' || coalesce(c_mktsegment, '') AS path FROM customer")
def fn_fill(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.filled("customers/{id}/{segment}", id=F.col("c_custkey"), segment=F.col("c_mktsegment")).alias("path"))


@query("SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS date FROM orders")
def fn_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.date_of(F.date_format("o_orderdate", "d/M/yyyy")).alias("date"))


# --- statements


_NATIONS = "SELECT 'nations' AS graph, 'nation/' || n_nationkey AS s, 'n_name' AS p, n_name AS o FROM nation UNION ALL SELECT 'nations', 'nation/' || n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation"


def nations(spark, d) -> DataFrame:
    return graph.statements(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nations", "nation/", "n_nationkey")


def described(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where(F.substring_index("s", "/", -1).cast("int").between(low, high)).withColumn("p", F.lit("n_name")).withColumn("o", F.lit("new")).distinct()


@query(_NATIONS)
def quads_roundtrip(spark, d):
    return nquads.parsed(nquads.formatted(nations(spark, d))).select(graph.STATEMENT)


@query(f"WITH q AS ({_NATIONS}) SELECT * FROM q UNION SELECT 'nations', 'nation/100', 'n_name', 'new'")
def crud_create(spark, d):
    new = nations(spark, d).limit(1).select(F.lit("nations").alias("graph"), F.lit("nation/100").alias("s"), F.lit("n_name").alias("p"), F.lit("new").alias("o"))
    return graph.create(nations(spark, d), new)


@query(f"WITH q AS ({_NATIONS}) SELECT graph, s, p, CASE WHEN p = 'n_name' AND CAST(split_part(s, '/', 2) AS INT) BETWEEN 3 AND 7 THEN 'new' ELSE o END AS o FROM q")
def crud_update(spark, d):
    return graph.update(nations(spark, d), described(nations(spark, d), 3, 7), ["n_name"])


@query(f"WITH q AS ({_NATIONS}) SELECT * FROM q WHERE NOT CAST(split_part(s, '/', 2) AS INT) BETWEEN 3 AND 7")
def crud_delete(spark, d):
    return graph.delete(nations(spark, d), described(nations(spark, d), 3, 7), ["n_name", "n_regionkey"])


@query(f"WITH q AS ({_NATIONS}) SELECT DISTINCT graph FROM q")
def graph_catalog(spark, d):
    return graph.graphs(nations(spark, d))


# --- texts


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS token FROM documents")
def text_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(fn.tokens(F.col("text"))).alias("token"))


@query("WITH t AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM benchmark), i AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM t) SELECT item_id, w[i] || ' ' || w[i + 1] AS ngram FROM i")
def text_ngrams(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(fn.ngrams(fn.tokens(F.col("text")), 2)).alias("ngram"))


@query("SELECT token, count(*) AS count, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))) AS token FROM documents) GROUP BY 1")
def text_index(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.transform(fn.tokens(F.col("text")), F.lower)).alias("token"))
    counted = words.groupBy("token", "doc_id").agg(F.count("*").alias("n"))  # so that a frequent token is a row a text
    return counted.groupBy("token").agg(F.sum("n").alias("count"), F.count("doc_id").alias("docs"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def crawl_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(fn.links(F.col("html"))).alias("link"))


@query("SELECT l_suppkey AS id, count(*) AS weight FROM lineitem GROUP BY 1")
def degree_weight(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("weight"))
