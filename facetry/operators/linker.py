"""Entities linked to the places of texts that name them, and words tagged by corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.models import Model
from facetry.operators import flow, labels, spans
from facetry.operators.durable import durable

#: Places of a text that a bucket of spans covers.
WIDTH = 256
#: The weight that the heaviest entity of a text gets from its label alone; each neighbour adds 1.
TOP = 0.1


def tagged(words: DataFrame, corpora: DataFrame) -> DataFrame:
    """Gives rows of tokens (``text``, ``type``) without a type that of the first of the corpora (``entry``, ``type``, ``rank``) that has the word, whatever its case."""
    known = corpora.where(F.col("entry").isNotNull()).groupBy(F.lower("entry").alias("_entry")).agg(F.min(F.struct("rank", "type"))["type"].alias("_type"))
    found = words.join(known, F.lower("text") == F.col("_entry"), "left")
    return found.withColumn("type", F.when(F.col("type") == "", F.coalesce("_type", "type")).otherwise(F.col("type"))).drop("_entry", "_type")


def linked(matches: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``end``, ``entity``, ``weight``: for each place of a text the entity that it most likely names.

    Of the ``matches`` of whole labels (``label_matches``) those stay that contain one of the ``targets`` (``doc_id``, ``start``,
    ``end``). Longer places go first, then earlier ones; a place that overlaps one that is kept goes. An entity weighs its own
    weight, brought to 0 to TOP within its text (TOP if all are equal), and 1 for each other candidate of the text that an edge (``s``, ``o``) joins
    it with, alternatives for the same words not counted. Of a place's entities the heaviest stays, of equals the smallest.
    """
    matches = durable(matches.select("doc_id", "entity", "label", "weight", "start", "end"))
    places = matches.select("doc_id", "start", "end").distinct()
    wanted = targets.select("doc_id", "start", "end").where(F.col("doc_id").isNotNull()).distinct()
    inside = spans.joined(places, wanted, "doc_id", "contains", WIDTH).select("doc_id", "start", "end").distinct()
    return likeliest(matches.join(flow.pruned(inside, "doc_id", "start", "end"), ["doc_id", "start", "end"]), edges)


def linked_texts(texts: DataFrame, id_col: str, text_col: str, entities: DataFrame, target: Model, edges: DataFrame) -> DataFrame:
    """``linked``, of the labels of entities (``labelled``) that stand in texts, with the matches of a model in them as targets.

    Whether a place holds a target is told where its text is; places are pruned before they meet the entities that have their words as a label.
    """
    known = labels.keyed(entities)
    places = durable(labels.at_labels(labels.label_places(texts, id_col, text_col, known, target), known, "left_semi"))
    kept = flow.pruned(places, "doc_id", "start", "end")
    return likeliest(labels.at_labels(kept, known), edges)


def likeliest(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """The last step of ``linked``: of the entities of each place that is kept the heaviest."""
    label = F.lower("label")
    found = durable(matches.groupBy("doc_id", "start", "end", "entity", label.alias("words")).agg(F.max("weight").alias("weight")))
    ranges = found.groupBy("doc_id").agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), F.lit(TOP) * (F.col("weight") - F.col("low")).cast("double") / (F.col("high") - F.col("low")).cast("double")).otherwise(F.lit(TOP))
    weighed = found.join(ranges, "doc_id").join(connected(found, edges), ["doc_id", "entity"], "left").withColumn("weight", scaled + F.coalesce("neighbours", F.lit(0)))
    best = F.min(F.struct((-F.col("weight")).alias("less"), "entity"))
    return weighed.groupBy("doc_id", "start", "end").agg(best.alias("x")).select("doc_id", "start", "end", "x.entity", (-F.col("x.less")).alias("weight"))


def references(links: DataFrame, texts: DataFrame, id_col: str, text_col: str, base: str = "reference/") -> DataFrame:
    """``graph``, ``s``, ``p``, ``o``: a note of each link (of ``linked``): its text, entity, words, place, length and weight. Notes are named by what they say, so that the same link gives the same note."""
    words = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    length = F.col("end") - F.col("start")
    noted = links.join(words, "doc_id").withColumn("anchor", F.substr("_text", F.col("start") + 1, length))
    text = lambda c: c.cast("string")
    name = F.concat(F.lit(base), F.md5(F.concat_ws("|", text(F.col("doc_id")), text(F.col("start")), text(F.col("end")), text(F.col("entity"))).cast("binary")))
    told = {"rdf:type": F.lit("Reference"), "source": text(F.col("doc_id")), "target": text(F.col("entity")), "anchor": F.col("anchor"), "offset": text(F.col("start")), "length": text(length), "weight": text(F.round("weight", 6))}
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in told.items()))).alias("x")
    return noted.select(F.lit("references").alias("graph"), name.alias("s"), pairs).select("graph", "s", "x.p", "x.o").where("o IS NOT NULL")


def corpus(spark: SparkSession, path: str, kind: str, rank: int = 0) -> DataFrame:
    """``entry``, ``type``, ``rank`` of a word list in text files, a word a line, each once: blank lines and those that begin with ``#`` are none, case and outer spaces don't count."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(word.alias("entry")).where("entry <> ''").distinct().select("entry", F.lit(kind).alias("type"), F.lit(rank).alias("rank"))


def connected(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id``, ``entity``, ``neighbours``: the other candidates of the text that edges join an entity with, but for alternatives for the same words.

    Candidates meet over edges, not over texts: a text's candidates are never paired.
    """
    candidates = found.select("doc_id", "entity").distinct()
    named = durable(candidates.select("entity").distinct())  # edges that leave the candidates of all texts go before they meet any
    among = edges.where("s <> o").join(named.withColumnRenamed("entity", "s"), "s", "left_semi").join(named.withColumnRenamed("entity", "o"), "o", "left_semi")
    both = durable(among.select("s", "o").union(among.select("o", "s")).distinct())
    near = candidates.join(both, F.col("entity") == F.col("s")).select("doc_id", "entity", F.col("o").alias("other"))
    near = near.join(candidates.select("doc_id", F.col("entity").alias("other")), ["doc_id", "other"], "left_semi")
    words = found.select("doc_id", "entity", "words").distinct()
    same = near.join(words, ["doc_id", "entity"]).join(words.select("doc_id", F.col("entity").alias("other"), "words"), ["doc_id", "other", "words"], "left_semi")
    return near.join(same.select("doc_id", "entity", "other").distinct(), ["doc_id", "entity", "other"], "left_anti").groupBy("doc_id", "entity").agg(F.count("*").alias("neighbours"))


def offsets(found: Column) -> Column:
    """The spans of an array of model matches as rows."""
    return F.inline(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
