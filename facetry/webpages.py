"""Queries of pages: steps over their nodes, and their microdata; and of a mirror that a stream keeps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetry.functions import pages as pg
from facetry.operators import axes
from facetry.operators.durable import checkpoint_folder, durable
from facetry.queries import query, table
from facetry.streaming.mirror import Mirror


def nodes(spark, d):
    return durable(pg.page_rows(table(spark, d, "pages").select(F.col("page_id").alias("page"), "html"), ["page"], F.col("html")))


_NAV = "SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages"


@query(rf"WITH n AS ({_NAV}), l AS (SELECT page_id, unnest(regexp_extract_all(nav, '<a href=\"([^\"]*)\">', 1)) AS href FROM n) SELECT page_id, href, count(*) AS count FROM l GROUP BY ALL")
def xpath_links(spark, d):
    found = axes.along(nodes(spark, d), ("descendant", "nav"), ("descendant", "a", axes.attribute("href").isNotNull()))
    return found.groupBy(F.col("page").alias("page_id"), axes.attribute("href").alias("href")).agg(F.count("*").alias("count"))


@query(rf"WITH n AS ({_NAV}) SELECT page_id, list_extract(regexp_extract_all(nav, '<a href=\"([^\"]*)\">', 1), 2) AS second FROM n WHERE len(regexp_extract_all(nav, '<a href=\"([^\"]*)\">', 1)) >= 2")
def xpath_second_item(spark, d):
    found = axes.along(nodes(spark, d), ("descendant", "nav"), ("child", "ul"), ("child", "li", None, 2), ("child", "a"))
    return found.select(F.col("page").alias("page_id"), axes.attribute("href").alias("second"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<meta charset=')) AS count FROM pages WHERE html LIKE '%<title>%'")
def xpath_siblings(spark, d):
    """The meta elements beside, and before, a page's title."""
    found = axes.along(nodes(spark, d), ("descendant", "title"), ("preceding-sibling", "meta"), ("ancestor", "head"), ("child", "meta"))
    return found.groupBy(F.col("page").alias("page_id")).agg(F.count("*").alias("count"))


def marked_up(spark, d):
    """Pages with their articles, headings and links marked as items and properties."""
    html = F.regexp_replace("html", "<article>", '<article itemscope itemtype="https://schema.org/Article" itemid="#article" itemref="menu">')
    html = F.regexp_replace(F.regexp_replace(html, "<nav>", '<nav id="menu">'), "<a href=", '<a itemprop="mentions relatedLink" href=')
    return table(spark, d, "pages").select("page_id", "url", F.regexp_replace(html, '<meta charset="utf-8">', '<meta charset="utf-8"><link itemprop="lost" href="/x">').alias("html"))


@query(rf"""WITH n AS (SELECT page_id, url, html FROM pages WHERE html LIKE '%<article>%'), l AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=\"([^\"]*)\">', 1)) AS href FROM n)
SELECT page_id, regexp_replace(url, '#.*', '') || '#article' AS s, 'rdf:type' AS p, 'https://schema.org/Article' AS o, 'iri' AS kind FROM n
UNION SELECT page_id, regexp_replace(url, '#.*', '') || '#article', 'https://schema.org/' || p, regexp_extract(url, '^[a-z]+://[^/]+') || href, 'iri' FROM l, (VALUES ('mentions'), ('relatedLink')) v(p)""")
def microdata_statements(spark, d):
    return marked_up(spark, d).select("page_id", F.inline(pg.microdata(F.col("html"), F.col("url"))))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def stream_mirror(spark, d):
    """The last event of each user, errors as deletions, kept by a stream over the table in several batches."""
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    changes = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    changes.repartitionByRange(4, "event_id").write.parquet(f"{folder}/changes")
    mirror = Mirror(spark, f"{folder}/mirror", "user_id", "event_id", "gone")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/changes")
    mirror.follow(stream, f"{folder}/progress").awaitTermination()
    return mirror.items()
