"""Tables written whole or not at all, appended, reloaded, kept by the fingerprint of what they were made from."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame

from ..operators.tables import counts
from ..sources.files import exists


def files(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Adds the rows to a table; Spark writes them in batches and commits them together."""
    df.write.mode("append").partitionBy(*(by or [])).parquet(path)


def replace(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Reloads a table: written beside it first, then put in its place, so that a failed write leaves the old one."""
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    old = f"{beside}.old"
    p, fs = files(spark, path)
    try:
        df.write.partitionBy(*(by or [])).parquet(beside)
    except Exception:
        fs.delete(files(spark, beside)[0], True)
        raise
    if fs.exists(p):
        fs.rename(p, files(spark, old)[0])
    fs.rename(files(spark, beside)[0], p)
    fs.delete(files(spark, old)[0], True)


def replace_all(tables: dict[str, DataFrame], base: str) -> None:
    """Reloads several tables of a folder in order; all are written before the first is put in place."""
    held = {}
    for name, df in tables.items():
        path = f"{base}/{name}.{uuid.uuid4().hex}"
        df.write.parquet(path)
        held[name] = path
    for name, path in held.items():
        spark = tables[name].sparkSession
        p, fs = files(spark, f"{base}/{name}")
        fs.delete(p, True)
        fs.rename(files(spark, path)[0], p)


#: Tables of the transit and listing schemas, those that others refer to first.
SCHEMAS = {
    "bus_stops": "busstop_id string, name_ja string, name_en string, name_kana string, latitude double, longitude double, operator string, busstop_pole_number string, busroute_pattern array<string>, geom struct<lon:double,lat:double>",
    "bus_routes": "route_id string, title string, operator string, direction string, geom string",
    "bus_route_stops": "route_id string, busstop_id string, stop_order int",
    "bus_timetable": "timetable_id string, route_id string, busstop_id string, stop_order int, arr_s int, dep_s int",
    "railway_lines": "railway_id string, operator string",
    "railway_stations": "station_id string, station_code string, name_ja string, name_en string, latitude double, longitude double, railway_id string, geom struct<lon:double,lat:double>",
    "railway_station_timetable": "station_id string, calendar string, rail_direction string, train_number string, train_type string, dep_s int, destination_station string",
    "railway_train_timetable": "timetable_id string, train_id string, railway_id string, calendar string, rail_direction string, train_type string, train_number string, origin_station string, destination_station string",
    "railway_train_timetable_stops": "timetable_id string, stop_order int, station_id string, arr_s int, dep_s int",
    "crawl_cycles": "id long, started_at timestamp, finished_at timestamp, status string, stats map<string,long>",
    "price_history": "content_hash string, listing_type string, price long, crawl_cycle_id long, recorded_at timestamp",
    "geocode_cache": "address string, latitude double, longitude double, created_at timestamp",
    "crawl_logs": "crawl_cycle_id long, prefecture int, listing_type string, is_new boolean, total_pages long, total_items long, new_listings long, updated_listings long, duplicates_skipped long, errors long, status string",
}


def create(spark, base: str, reset: bool = False) -> None:
    """Empty tables where there are none; with reset all are dropped first, in reverse order."""
    if reset:
        for name in reversed(SCHEMAS):
            p, fs = files(spark, f"{base}/{name}")
            fs.delete(p, True)
    for name, schema in SCHEMAS.items():
        if not exists(spark, f"{base}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{base}/{name}")


def report(spark, base: str) -> DataFrame:
    """table, rows of the tables that exist."""
    return counts({n: spark.read.parquet(f"{base}/{n}") for n in SCHEMAS if exists(spark, f"{base}/{n}")})


def kept(spark, base: str, name: str, made_from: dict, build) -> DataFrame:
    """The table built from these parameters and inputs (say paths and their modification times); built and stored if it is not there yet."""
    mark = hashlib.sha256(json.dumps(made_from, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{base}/{name}-{mark}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
