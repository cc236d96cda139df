"""The transit network that reach runs on: stops, stop times with separate arrivals and departures, walks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import walk_seconds
from .spatial import within
from .stored import cut
from .tables import only_known


@dataclass
class Network:
    stops: DataFrame
    stop_times: DataFrame
    walks: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    snaps: DataFrame | None = None


def rail_stops(stations: DataFrame) -> DataFrame:
    return stations.where("latitude is not null and longitude is not null").select(F.col("station_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit("rail").alias("kind"))


def bus_stops(stops: DataFrame) -> DataFrame:
    return stops.where("latitude is not null and longitude is not null").select(F.col("busstop_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit("bus").alias("kind"))


def overriding(low: DataFrame, high: DataFrame, key: str) -> DataFrame:
    """Both tables by key; all rows of a key that both have come from `high`."""
    return low.join(high.select(key).distinct(), key, "left_anti").unionByName(high)


def train_times(headers: DataFrame, stops: DataFrame, calendar: str) -> DataFrame:
    """stop_times of the trains of one calendar, in the order of their stops."""
    chosen = headers.where(F.col("calendar") == calendar).select("timetable_id")
    return only_known(stops, (chosen, "timetable_id")).select(F.col("timetable_id").alias("trip_id"), F.col("stop_order").alias("seq"), F.col("station_id").alias("stop_id"), "arr_s", "dep_s")


def lines_without_trains(stations: DataFrame, headers: DataFrame, calendar: str) -> DataFrame:
    """railway_id of lines that have stations but no train of the calendar."""
    return stations.select("railway_id").distinct().join(headers.where(F.col("calendar") == calendar).select("railway_id").distinct(), "railway_id", "left_anti")


def synthesised(stations: DataFrame, timetable: DataFrame, headers: DataFrame, calendar: str) -> DataFrame:
    """stop_times of trains chained from station timetables, for lines without trains: (line, direction, train) by time.

    Rows without a time go; a train needs two; it arrives when it departs; equal times go by station."""
    lines = lines_without_trains(stations, headers, calendar)
    rows = timetable.where((F.col("calendar") == calendar) & F.col("dep_s").isNotNull()).join(only_known(stations, (lines, "railway_id")).select("station_id", "railway_id"), "station_id")
    rows = rows.withColumn("trip_id", F.concat_ws("_", F.lit("synth"), "railway_id", F.coalesce("rail_direction", F.lit("None")), F.coalesce("train_number", F.lit("None"))))
    by = Window.partitionBy("trip_id")
    rows = rows.withColumn("seq", F.row_number().over(by.orderBy("dep_s", "station_id")) - 1).withColumn("n", F.count("*").over(by))
    return rows.where("n >= 2").select("trip_id", "seq", F.col("station_id").alias("stop_id"), F.col("dep_s").alias("arr_s"), "dep_s")


def bus_times(timetable: DataFrame) -> DataFrame:
    """stop_times of all buses, whatever the calendar."""
    return timetable.select(F.col("timetable_id").alias("trip_id"), F.col("stop_order").alias("seq"), F.col("busstop_id").alias("stop_id"), "arr_s", "dep_s")


def departure_index(stop_times: DataFrame) -> DataFrame:
    """stop_id, dep_s, trip_id of all departures, sorted by stop, time and trip within its files."""
    rows = stop_times.where("dep_s is not null").select("stop_id", "dep_s", "trip_id")
    return rows.repartition("stop_id", F.floor(F.col("dep_s") / 3600)).sortWithinPartitions("stop_id", "dep_s", "trip_id")


def crow_walks(stops: DataFrame, max_walk_m: float, kmh: float = 5.0) -> DataFrame:
    """src, dst, walk_s of stops at most max_walk_m apart."""
    return within(stops, stops, max_walk_m).where("src <> dst").select("src", "dst", walk_seconds(F.col("dist"), kmh).alias("walk_s"))


def load(stations: DataFrame, headers: DataFrame, train_stops: DataFrame, station_times: DataFrame, buses: DataFrame, bus_timetable: DataFrame, calendar: str, max_walk_m: float = 800.0, roads: tuple[DataFrame, DataFrame] | None = None) -> Network:
    """The network of a calendar. Buses override trains and stops of the same id. With roads (nodes, edges) walks follow them, else the crow."""
    from . import walk

    stops = cut(overriding(rail_stops(stations), bus_stops(buses), "id"))
    trains = train_times(headers, train_stops, calendar)
    # A chained trip replaces none of the real ones, whose ids are others.
    rail = trains.unionByName(synthesised(stations, station_times, headers, calendar))
    times = cut(overriding(rail, bus_times(bus_timetable), "trip_id"))
    if roads is None:
        return Network(stops, times, cut(crow_walks(stops, max_walk_m)))
    nodes, edges = roads
    edges = cut(walk.both_ways(walk.undirected(edges if "length" in edges.columns else walk.with_length(edges, nodes))))
    snaps = cut(walk.snapped(stops, nodes))
    return Network(stops, times, cut(walk.neighbours(edges, snaps, max_walk_m)), nodes, edges, snaps)
