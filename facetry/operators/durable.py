"""Results that later steps read more than once, kept in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; one under /tmp where it names none on a local master. A cluster must name one, as its machines share no local folder."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not (conf.get("spark.master") or "").startswith(("local[", "local")) or (conf.get("spark.master") or "").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return "/tmp/facetry-checkpoints"


def durable(rows: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, which cuts the lineage. Its files go when nothing refers to it any more (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    context = rows.sparkSession.sparkContext
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(rows.sparkSession))
    conf, name = rows.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    was = conf.get(name)
    conf.set(name, "false")  # a checkpoint keeps the constraints of its plan, some on columns that it doesn't have, which unions of checkpoints don't survive
    try:
        return rows.checkpoint()
    finally:
        conf.set(name, was)
