"""Tables written to the folder that all machines share: lineage cuts and fixpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F


def shared(spark, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Unset, only a single machine has a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written once and read back."""
    out = shared(df.sparkSession, "table")
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def fixpoint(best: DataFrame, step, key: list[str], value: str) -> DataFrame:
    """Label setting: step(frontier) offers (key, value); smaller values replace and form the next frontier.

    A round writes its table once; the frontier is the part of it that the round improved."""
    best = cut(best.groupBy(*key).agg(F.min(value).alias(value)).withColumn("__new", F.lit(True)))
    while not (frontier := best.where("__new").drop("__new")).isEmpty():
        offers = step(frontier).groupBy(*key).agg(F.min(value).alias("__offer"))
        both = best.drop("__new").join(offers, key, "full")
        better = F.coalesce(F.col("__offer") < F.col(value), F.col("__offer").isNotNull() & F.col(value).isNull())
        best = cut(both.select(*key, F.when(better, F.col("__offer")).otherwise(F.col(value)).alias(value), better.alias("__new")))
    return best.drop("__new")
