"""Earliest arrival by rides and walks, bounded shortest paths and band edges as DataFrame fixpoints.

Tables: stop_times (trip_id, seq, stop_id, arr_s, dep_s), walks (src, dst, walk_s), stops (id, lat, lon), origins
(origin_id, stop_id, arr). Null times: the arrival falls back to the departure; stops without either are passed by, and
nobody boards where the departure is null. Origins run side by side. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .spatial import within
from .stored import cut, fixpoint  # noqa: F401
from ..functions.scalars import walk_seconds

#: Seconds of one bucket of departures.
HOUR = 3600


def with_both_times(stop_times: DataFrame) -> DataFrame:
    """stop_times with arr_s and dep_s; a table with a single time t arrives and departs at it."""
    return stop_times if "arr_s" in stop_times.columns else stop_times.withColumnsRenamed({"t": "arr_s"}).withColumn("dep_s", F.col("arr_s"))


def departures(stop_times: DataFrame) -> DataFrame:
    """stop_id, dep_s, trip_id, s0: where a trip departs, s0 being its first place at that stop, from which a ride goes on."""
    t = with_both_times(stop_times).select("trip_id", "seq", "stop_id", "dep_s")
    first = F.min("seq").over(Window.partitionBy("trip_id", "stop_id"))
    return t.withColumn("s0", first).where("dep_s is not null").select("stop_id", "dep_s", "trip_id", "s0")


def ride_on(boarded: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The columns of boarded (with trip_id, s0, dep) and dst, seq, arr of each later stop of the ride.

    Times never fall below the boarding time or the last one accepted, a running maximum from the boarding on."""
    keys = boarded.columns
    t = with_both_times(stop_times).select("trip_id", "seq", F.col("stop_id").alias("dst"), F.coalesce("arr_s", "dep_s").alias("arr"))
    rows = boarded.join(t, "trip_id").where("seq > s0 and arr is not null")
    so_far = F.max("arr").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__top", F.greatest("dep", so_far)).where("arr >= __top").drop("__top")


def rides(stop_times: DataFrame) -> DataFrame:
    """Hops src, dep, dst, arr of every boarding."""
    board = departures(stop_times).select("trip_id", F.col("stop_id").alias("src"), "s0", F.col("dep_s").alias("dep")).distinct()
    return ride_on(board, stop_times).select("src", "dep", "dst", "arr")


def next_departures(at: DataFrame, deps: DataFrame, until: int) -> DataFrame:
    """The rows of at (with stop_id, arr) and dep, trip_id, s0 of each trip's first departure there from arr on, none after until.

    Hours cut a stop's departures into buckets, so a popular stop is no single group and only buckets from arr on are met."""
    keys = at.columns
    d = deps.where(F.col("dep_s") <= until).withColumn("__h", F.floor(F.col("dep_s") / HOUR)).withColumnRenamed("dep_s", "dep")
    a = at.where(F.col("arr") <= until).withColumn("__h", F.explode(F.sequence(F.floor(F.col("arr") / HOUR), F.floor(F.lit(until) / HOUR))))
    return a.join(d, ["stop_id", "__h"]).where("dep >= arr").groupBy(*keys, "trip_id", "s0").agg(F.min("dep").alias("dep"))


def earliest_arrival(stop_times: DataFrame, walks: DataFrame, origins: DataFrame, deadline: int) -> DataFrame:
    """origin_id, stop_id, arr: first arrival within the deadline, by rides and walks between stops."""
    first = origins.agg(F.min("arr")).first()[0]
    times = cut(with_both_times(stop_times).where(F.coalesce("arr_s", "dep_s").between(first, deadline)) if first is not None else with_both_times(stop_times).limit(0))
    # A trip's first place at a stop may lie before the window, so departures come from all times.
    deps = cut(departures(stop_times).where(F.col("dep_s").between(first or 0, deadline)))
    w = cut(walks.select("src", "dst", "walk_s"))

    def step(front: DataFrame) -> DataFrame:
        # Of all boardings of one trip at one place the earliest serves each origin.
        board = next_departures(front, deps, deadline).groupBy("origin_id", "trip_id", "s0", "dep").agg(F.min("arr").alias("at")).drop("at")
        ride = ride_on(board, times).select("origin_id", F.col("dst").alias("stop_id"), "arr")
        walk = front.join(w, F.col("stop_id") == F.col("src")).select("origin_id", F.col("dst").alias("stop_id"), (F.col("arr") + F.col("walk_s")).alias("arr"))
        return ride.unionByName(walk).where(F.col("arr") <= deadline)

    return fixpoint(origins.select("origin_id", "stop_id", "arr").where(F.col("arr") <= deadline), step, ["origin_id", "stop_id"], "arr")


def access(origins: DataFrame, stops: DataFrame, departure: int, max_walk_m: float, kmh: float = 5.0) -> DataFrame:
    """Stops (id, lat, lon) that origins (id, lat, lon) reach on foot as the crow flies: origin_id, stop_id, arr."""
    return within(origins, stops, max_walk_m).select(F.col("src").alias("origin_id"), F.col("dst").alias("stop_id"), (F.lit(departure) + walk_seconds(F.col("dist"), kmh)).alias("arr"))


def bounded_sssp(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """source, node, dist within the cutoff, over directed edges (u, v, length); sources has source, and node if that differs."""
    kind = edges.schema["length"].dataType
    node = F.col("node") if "node" in sources.columns else F.col("source").alias("node")
    start = sources.select("source", node, F.lit(0).cast(kind).alias("dist"))
    e = edges.select("u", "v", "length")
    return fixpoint(start, lambda f: f.join(e, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("dist") + F.col("length")).alias("dist")).where(F.col("dist") <= cutoff), ["source", "node"], "dist")


def band_edges(edges: DataFrame, dist: DataFrame, bands: list[int]) -> DataFrame:
    """band, u, v: edges with both ends within the band of one and the same source."""
    i, j = dist.select("source", F.col("node").alias("u"), F.col("dist").alias("du")), dist.select("source", F.col("node").alias("v"), F.col("dist").alias("dv"))
    both = edges.select("u", "v").join(i, "u").join(j, ["source", "v"]).groupBy("u", "v").agg(F.min(F.greatest("du", "dv")).alias("need"))
    return both.withColumn("band", F.explode(F.array(*map(F.lit, bands)))).where("need <= band").select("band", "u", "v")
