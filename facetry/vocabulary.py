"""Queries of terms, of names, of JSON by paths and of cleaned texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.functions import terms as tm
from facetry.queries import query, table


@query("""SELECT event_id, 'literal' AS kind, 'integer' AS type, true AS number, '' AS lang, CAST(user_id AS VARCHAR) AS plain FROM events
UNION ALL SELECT event_id, 'literal', 'langString', false, 'en', '''' || event_type || '''@en' FROM events UNION ALL SELECT event_id, 'iri', 'iri', false, NULL, '<user/' || user_id || '>' FROM events
UNION ALL SELECT event_id, 'literal', 'string', false, '', '''' || replace(replace(props, '\\', '\\\\'), '''', '\\''') || '''' FROM events WHERE props IS NOT NULL""")
def fn_terms(spark, d):
    e = table(spark, d, "events")
    made = [tm.term(F.col("user_id"), datatype="integer"), tm.term(F.col("event_type"), lang=F.lit("en")), tm.term(F.concat(F.lit("user/"), F.col("user_id").cast("string")), "iri"), tm.term(F.col("props"))]
    rows = e.select("event_id", F.explode(F.array(*made)).alias("t")).where(tm.bound(F.col("t")))
    t = F.col("t")
    return rows.select("event_id", F.col("t.kind").alias("kind"), tm.type_of(t).alias("type"), tm.is_numeric(t).alias("number"), tm.lang_of(t).alias("lang"), tm.formatted(t).alias("plain"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS whole, try_cast(value AS DECIMAL(38, 10)) AS exact, CAST(ts AS DATE) AS day, event_type = 'click' AS flag FROM events""")
def fn_convert(spark, d):
    k = F.get_json_object("props", "$.k")
    literal = lambda c, kind: tm.converted(tm.term(c.cast("string")), kind)
    exact = F.col("value").cast("decimal(38,10)")
    return table(spark, d, "events").select("event_id", literal(k, "integer").cast("long").alias("whole"), literal(exact, "decimal").alias("exact"), literal(F.col("ts").cast("date"), "date").alias("day"), literal(F.col("event_type") == "click", "boolean").alias("flag"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '#(.*)$', 1) AS fragment,
substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-3' || substr(md5(url), 14, 3) || '-' || substr('89ab', CAST('0x' || substr(md5(url), 17, 1) AS INT) % 4 + 1, 1) || substr(md5(url), 18, 3) || '-' || substr(md5(url), 21, 12) AS uuid FROM pages""")
def fn_names(spark, d):
    parts = tm.iri_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", *(parts[k].alias(k) for k in ("scheme", "host", "path", "fragment")), tm.named_uuid(F.col("url")).alias("uuid"))


@query("""SELECT n_nationkey, [n_name, r_name] AS texts, [CAST(n_nationkey AS BIGINT), CAST(r_regionkey AS BIGINT)] AS keys, r_name AS second, n_nationkey % 2 = 0 AS even FROM nation JOIN region ON n_regionkey = r_regionkey""")
def fn_json_paths(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = lambda name, key: F.struct(F.col(name).alias("name"), F.col(key).alias("key"))
    json = F.to_json(F.struct(F.array(item("n_name", "n_nationkey"), item("r_name", "r_regionkey")).alias("items"), F.struct((F.col("n_nationkey") % 2 == 0).alias("even")).alias("flags")))
    rows = rows.select("n_nationkey", json.alias("json"))
    j = F.col("json")
    return rows.select("n_nationkey", tm.json_texts(j, "items.*.name").alias("texts"), tm.json_integers(j, "items.*.key").alias("keys"), F.get(tm.json_texts(j, "items.1.name"), 0).alias("second"), F.get(tm.json_booleans(j, "flags.*"), 0).alias("even"))


@query(r"SELECT o_orderkey, CASE WHEN regexp_full_match(o_orderpriority, '(\d)-(.*)') THEN regexp_extract(o_orderpriority, '^(\d)-(.*)$', 2) END AS priority, regexp_extract_all(o_orderpriority, '[A-Z]+') AS words FROM orders")
def fn_expressions(spark, d):
    c = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", tm.group(c, r"(\d)-(.*)", 2).alias("priority"), tm.results(c, "[A-Z]+").alias("words"))


@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\x00-\x20\x7f-\xa0]+', ' ', 'g')) AS clean, trim(regexp_replace(strip_accents(text), '[\x00-\x20\x7f-\xa0]+', ' ', 'g')) AS plain FROM documents")
def fn_cleaned(spark, d):
    return table(spark, d, "documents").select("doc_id", tm.cleaned(F.col("text")).alias("clean"), tm.cleaned(F.col("text"), marks=True).alias("plain"))


@query("SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'https://schema.org/' || page_id ELSE 'none' END AS name FROM pages")
def fn_normalise(spark, d):
    told = F.when(F.col("url").startswith("http://"), F.concat(F.lit("http://schema.org/"), F.col("page_id").cast("string"), F.lit(" "))).otherwise("other")
    rules = (F.trim, tm.vocabulary, lambda v: F.when(v == "other", "none"))
    return table(spark, d, "pages").select("page_id", tm.normalised(told, *rules).alias("name"))
