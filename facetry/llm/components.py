"""Connected components: of a task's own links in numpy, of all links as rounds of joins and sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.texts import checkpointed


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links a[i] to b[i], the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != (up := label[label])).any():
            label = up
        if (label == before).all():
            break
        still = label[a] != label[b]
        a, b = a[still], b[still]
    return label


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node of ``links``, two columns of longs ``a`` and ``b``.

    Alternates two steps until nothing changes: every greater neighbour of a node, then every smaller one, is linked to the
    smallest. Rounds grow with the logarithm of the longest path; minima are summed before the shuffle, so that a hub costs
    a row a task. Each round is cut off through the shared folder.
    """
    links = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        links = checkpointed(small.where("a != b").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
