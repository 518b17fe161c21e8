"""Queries of words, labels and entities in texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import models as md
from facetry.functions import tokens as tk
from facetry.operators import labels as lb
from facetry.operators import linker as ln
from facetry.operators.durable import checkpoint_folder
from facetry.queries import SQL, query, table

# The rules once more, without looks ahead and over letters told as plain ones, as DuckDB's expressions know plain letters only.
_LD, _PART = "a-zA-Z0-9", "[a-zA-Z0-9][-+_a-zA-Z0-9]*"
_NAME, _RUN = rf"{_PART}(?:\.{_PART})*", "[-._&/a-zA-Z0-9]"
_CODE = rf"\b(?:[{_LD}]{_RUN}*)?(?:{_RUN}[A-Z]|[a-zA-Z]{_RUN}*[0-9]|[0-9]{_RUN}*[a-zA-Z])(?:{_RUN}*[{_LD}])?\b"
_RULES = (
    ("NNP", rf"\bhttps?://[-+&@#/%?=~_|!:,.;{_LD}]*[-+&@#/%=~_|{_LD}]"), ("NNP", rf"\b{_NAME}@{_NAME}\.[a-zA-Z]{{2,}}\b"), ("NNP", _CODE), ("CD", r"[-+]?(?:\d*(?:[.,]\d{3})*[.,])?\d+\b"),
    ("SYM", r"[-+]?\p{S}"), ("", r"\b(?:[a-zA-Z]-)?[a-zA-Z][a-z]*\b"), ("", r"\.{3}"), ("", r"\S"),
)
_PATTERN = "(?s)" + "|".join(f"({p})" for _, p in _RULES) + "|."
_PLAIN = r"array_to_string(list_transform(string_split({x}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN ch WHEN regexp_full_match(ch, '\p{{Lu}}') THEN 'A' WHEN regexp_full_match(ch, '\p{{L}}') THEN 'a' ELSE ch END), '')"
_TYPE = " ".join(f"WHEN g{k + 1}[i] IS NOT NULL THEN '{t}'" for k, (t, _) in enumerate(_RULES))


def tokens_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in ``name`` (key, at, text, type, start, end): the tokens of a table's texts."""
    groups = ", ".join(f"regexp_extract_all(p, '{_PATTERN}', {k}) AS g{k}" for k in range(len(_RULES) + 1))
    return f"""{name}_p AS (SELECT {key}, {text} AS whole, {_PLAIN.format(x=text)} AS p FROM {source} WHERE {text} IS NOT NULL),
{name}_g AS (SELECT {key}, whole, {groups} FROM {name}_p),
{name}_s AS (SELECT {key}, whole, i, len(g0[i]) AS n, CASE {_TYPE} ELSE ' ' END AS type FROM (SELECT *, unnest(range(1, len(g0) + 1)) AS i FROM {name}_g)),
{name}_o AS (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY i) AS stop FROM {name}_s),
{name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS "at", substr(whole, (stop - n + 1)::BIGINT, n) AS text, type, (stop - n)::BIGINT AS start, stop::BIGINT AS "end" FROM {name}_o WHERE type <> ' ')"""


@query("WITH " + tokens_sql("t", "documents", "doc_id", "text") + " SELECT * FROM t")
def text_typed_tokens(spark, d):
    return tk.token_rows(table(spark, d, "documents"), ["doc_id"], F.col("text"), "at")


@query("WITH " + tokens_sql("t", "pages", "page_id", "url") + """ SELECT page_id, string_agg(text || '/' || type, ' ' ORDER BY "at") AS tokens FROM t GROUP BY 1""")
def text_url_tokens(spark, d):
    found = F.transform(tk.typed_tokens(F.col("url")), lambda t: F.concat(t["text"], F.lit("/"), t["type"]))
    return table(spark, d, "pages").select("page_id", F.array_join(found, " ").alias("tokens"))


def benchmark_labels(spark, d) -> DataFrame:
    """Each sentence of an item as a label of it, and the count of lines of the supplier of its number as its weight."""
    sentences = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", r"[.!?]\s*")).alias("label"))
    weights = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.count("*").alias("weight"))
    return lb.labelled(sentences.where("label <> ''"), "item_id", "label", weights)


_LABELS = "b AS (SELECT DISTINCT item_id, label, item_id || ':' || label AS key FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.!?]\\s*')) AS label FROM benchmark) WHERE label <> '')"


@query(f"""WITH {_LABELS}, {tokens_sql("t", "documents", "doc_id", "text")}, {tokens_sql("l", "b", "key", "label")},
dw AS (SELECT doc_id, list(lower(text) ORDER BY "at") AS w, list(start ORDER BY "at") AS a, list("end" ORDER BY "at") AS z FROM t GROUP BY 1), lw AS (SELECT key, list(lower(text) ORDER BY "at") AS w FROM l GROUP BY 1),
near AS (SELECT doc_id, key, dw.w AS dw, lw.w AS lw, a, z FROM dw JOIN lw ON contains(' ' || array_to_string(dw.w, ' ') || ' ', ' ' || array_to_string(lw.w, ' ') || ' ')),
hit AS (SELECT *, unnest(list_filter(range(1, len(dw) - len(lw) + 2), lambda i: dw[i:i + len(lw) - 1] = lw)) AS i FROM near)
SELECT doc_id, b.item_id AS entity, b.label, coalesce(n, 0) AS weight, i - 1 AS first, len(lw) AS words, a[i] AS start, z[i + len(lw) - 1] AS "end" FROM hit JOIN b USING (key) LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = b.item_id""")
def text_label_matches(spark, d):
    return lb.label_matches(table(spark, d, "documents"), "doc_id", "text", benchmark_labels(spark, d))


def names() -> md.Model:
    """Capitals in a row, with a small word of a name between them."""
    capitals = md.token(md.upper).repeated(1)
    return capitals + (md.token(md.among("of", "the", "de", "la")) + capitals).optional()


_CODED = "CASE WHEN regexp_matches(text, '^\\p{Lu}') THEN 'U' WHEN lower(text) IN ('of', 'the', 'de', 'la') THEN 'o' ELSE 'x' END"


def models_sql(expression: str) -> str:
    """CTE ``m`` (doc_id, first, words, start, end): matches of an expression over codes of the tokens ``t``."""
    return f"""c AS (SELECT doc_id, regexp_extract_all(string_agg({_CODED}, '' ORDER BY "at"), '{expression}|.', 0) AS runs FROM t GROUP BY 1),
r AS (SELECT doc_id, unnest(range(1, len(runs) + 1)) AS i, unnest(runs) AS run FROM c),
rr AS (SELECT *, sum(len(run)) OVER (PARTITION BY doc_id ORDER BY i) - len(run) AS first FROM r),
m AS (SELECT rr.doc_id, first::INT AS first, len(run)::INT AS words, x.start, y."end" FROM rr JOIN t x ON x.doc_id = rr.doc_id AND x."at" = first JOIN t y ON y.doc_id = rr.doc_id AND y."at" = first + len(run) - 1 WHERE regexp_full_match(run, '{expression}'))"""


@query("WITH " + tokens_sql("t", "documents", "doc_id", "text") + ", " + models_sql("U+(?:oU+)?") + """ SELECT doc_id, 'NAME' AS type, first, words, start, "end" FROM m""")
def text_model_find(spark, d):
    return md.model_rows(table(spark, d, "documents"), ["doc_id"], F.col("text"), names(), "NAME")


@query("WITH " + tokens_sql("t", "benchmark", "item_id", "text") + r""", w AS (SELECT *, regexp_matches(text, '^\p{Lu}') OR type = 'NNP' AS head FROM t)
SELECT a.item_id, a."at"::INT AS first, (b."at" - a."at" + 1)::INT AS words, a.start, b."end" FROM w a JOIN w b ON a.item_id = b.item_id AND b."at" - a."at" BETWEEN 1 AND 3 WHERE a.head AND (b.head OR b.type = 'CD')""")
def text_ngram_find(spark, d):
    words = table(spark, d, "benchmark").select("item_id", tk.typed_tokens(F.col("text")).alias("words"))
    return words.select("item_id", F.inline(md.ngrams(F.col("words"), 2, 4))).drop("type")


@query("WITH " + tokens_sql("t", "documents", "doc_id", "text") + """, k AS (SELECT lower(c_mktsegment) AS entry, 'SEGMENT' AS type FROM customer UNION SELECT w, 'SMALL' FROM (VALUES ('of'), ('the'), ('de')) v(w))
SELECT doc_id, t.type AS was, CASE WHEN t.type = '' THEN coalesce(k.type, '') ELSE t.type END AS type, count(*) AS count FROM t LEFT JOIN k ON lower(text) = entry GROUP BY ALL""")
def text_tagged(spark, d):
    words = tk.token_rows(table(spark, d, "documents"), ["doc_id"], F.col("text"))
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("entry"), F.lit("SEGMENT").alias("type"), F.lit(1).alias("rank"))
    small = spark.createDataFrame([(w, "SMALL", 2) for w in ("Of", "the", "DE")], "entry string, type string, rank int")
    return ln.tagged(words.withColumn("was", F.col("type")), segments.union(small)).groupBy("doc_id", "was", "type").agg(F.count("*").alias("count"))


@query(f"""WITH RECURSIVE mm AS ({SQL["text_label_matches"]}), {tokens_sql("t", "documents", "doc_id", "text")}, {models_sql("U+(?:oU+)?")},
p AS (SELECT DISTINCT mm.doc_id, mm.start, mm."end" FROM mm JOIN m ON m.doc_id = mm.doc_id AND mm.start <= m.start AND m."end" <= mm."end"),
b AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
cl AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS cluster FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY "end" - start DESC, start) AS n FROM cl),
k AS (SELECT doc_id, cluster, n, [{{'a': start, 'b': "end"}}] AS kept FROM o WHERE n = 1 UNION ALL
  SELECT o.doc_id, o.cluster, o.n, CASE WHEN len(list_filter(kept, lambda x: x.a < o."end" AND o.start < x.b)) = 0 THEN list_append(kept, {{'a': o.start, 'b': o."end"}}) ELSE kept END FROM k JOIN o ON o.doc_id = k.doc_id AND o.cluster = k.cluster AND o.n = k.n + 1),
f AS (SELECT doc_id, x.a AS start, x.b AS "end" FROM (SELECT doc_id, unnest(kept) AS x FROM (SELECT * FROM k QUALIFY n = max(n) OVER (PARTITION BY doc_id, cluster)))),
q AS (SELECT doc_id, start, "end", entity, lower(label) AS words, max(weight) AS weight FROM mm JOIN f USING (doc_id, start, "end") GROUP BY ALL),
e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS o FROM lineitem WHERE l_suppkey <> l_partkey UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey <> l_partkey),
nb AS (SELECT DISTINCT x.doc_id, x.entity, y.entity AS other FROM q x JOIN e ON e.s = x.entity JOIN q y ON y.entity = e.o AND y.doc_id = x.doc_id
  WHERE NOT EXISTS (SELECT 1 FROM q a JOIN q c ON a.doc_id = c.doc_id AND a.words = c.words WHERE a.doc_id = x.doc_id AND a.entity = x.entity AND c.entity = y.entity)),
nn AS (SELECT doc_id, entity, count(*) AS n FROM nb GROUP BY ALL), lh AS (SELECT doc_id, min(weight) AS low, max(weight) AS high FROM q GROUP BY 1),
ww AS (SELECT doc_id, start, "end", entity, CASE WHEN high > low THEN 0.1::DOUBLE * (weight - low)::DOUBLE / (high - low)::DOUBLE ELSE 0.1::DOUBLE END + coalesce(n, 0)::DOUBLE AS weight FROM q JOIN lh USING (doc_id) LEFT JOIN nn USING (doc_id, entity))
SELECT doc_id, start, "end", entity, weight FROM ww QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY weight DESC, entity) = 1""")
def text_link(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("o"))
    return ln.linked_texts(table(spark, d, "documents"), "doc_id", "text", benchmark_labels(spark, d), names(), edges)


@query(f"""WITH l AS ({SQL["text_link"]}), n AS (SELECT 'reference/' || md5(doc_id || '|' || start || '|' || "end" || '|' || entity) AS s, l.*, substr(text, start + 1, "end" - start) AS anchor FROM l JOIN documents USING (doc_id))
SELECT 'references' AS graph, s, unnest(['rdf:type', 'source', 'target', 'anchor', 'offset', 'length']) AS p, unnest(['Reference', CAST(doc_id AS VARCHAR), CAST(entity AS VARCHAR), anchor, CAST(start AS VARCHAR), CAST("end" - start AS VARCHAR)]) AS o FROM n""")
def text_references(spark, d):
    links = text_link(spark, d)
    return ln.references(links, table(spark, d, "documents"), "doc_id", "text").where("p <> 'weight'")  # numbers with a point have other texts in SQL


@query(r"SELECT DISTINCT lower(trim(line)) AS entry, 'WORD' AS type FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE trim(line) <> '' AND line NOT LIKE '#%'")
def text_corpus_load(spark, d):
    """The lines of the benchmark's texts, written as a word list and loaded."""
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    table(spark, d, "benchmark").select(F.col("text").alias("value")).union(spark.range(1).select(F.lit("# a comment\n\n   "))).write.text(folder)
    return ln.corpus(spark, folder, "WORD").drop("rank")
