"""Helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so that clashing extra columns do no harm."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def shared(spark, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Unset, only a single machine has a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table written once in the shared folder (checkpoint() would compute its input twice)."""
    spark, out = df.sparkSession, shared(df.sparkSession, "table")
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def ship(spark) -> None:
    """Sends this package to the workers once per application, so that they need no path of the driver's."""
    global _sent
    sc = spark.sparkContext
    # Texts are long: Arrow batches of the usual 10,000 rows would hold tens of megabytes in each task, twice.
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    # So would 1,000 very long texts, or pairs of their lines. A caller's own bound stays.
    if spark.conf.get(BYTES, None) is None:
        spark.conf.set(BYTES, str(BATCH_BYTES))
    if _sent == sc.applicationId:
        return
    top = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="package")) / f"{top.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(out))
    _sent = sc.applicationId


_sent = None
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
