"""The listing lifecycle as a stream: each micro-batch of pages is a cycle that updates stored state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.html import page_listings
from ..operators import listings as L
from ..sources.files import exists

TABLES = ("cycles", "snapshot", "history", "logs", "cache")


def load(spark, base: str, batch: int | None) -> dict[str, DataFrame]:
    """State after a batch; None or a batch without state: empty."""
    if batch is None or not exists(spark, f"{base}/{batch}/_done"):
        return L.empty_state(spark)
    return {n: spark.read.parquet(f"{base}/{batch}/{n}") for n in TABLES}


def batches(spark, base: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit() and exists(spark, f"{base}/{n}/_done"))


def cycles_of(pages: DataFrame, base: str, kind: str, as_of_year: int, url_base: str, now: Callable, **options):
    """A writer of a stream of pages (prefecture, is_new, page, status, html) that keeps state under base, one folder a batch.

    A batch that runs again starts from the state before it, so its result is written once and for all."""

    def one(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if exists(spark, f"{base}/{batch}/_done"):
            return
        before = [b for b in batches(spark, base) if b < batch]
        df = df.persist()
        found = page_listings(df.where("status = 'success'"), kind, as_of_year, url_base)
        read = df.select("prefecture", "is_new", "status").selectExpr("prefecture", f"'{kind}' as listing_type", "is_new", "status")
        state = L.crawl(load(spark, base, before[-1] if before else None), found, read, now(), **options)
        for n in TABLES:
            state[n].write.mode("overwrite").parquet(f"{base}/{batch}/{n}")
        spark.range(1).write.mode("overwrite").parquet(f"{base}/{batch}/_done")
        df.unpersist()

    return pages.writeStream.foreachBatch(one)
