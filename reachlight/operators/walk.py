"""Walk networks: undirected graphs, snapping, walking neighbours, access and egress within time bands.

Tables: nodes (id, x, y), edges (u, v, length), stops (id, lat, lon). Empty tables give empty results; stops and edges
with null coordinates or ends take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import WALK_KMH, great_circle_m, walk_seconds
from .reach import bounded_sssp
from .spatial import nearest
from .stored import cut

#: Fixed value: seconds that must be left for a walk to count.
LEAST_S = 30


def with_length(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their great-circle length in metres."""
    end = lambda s: nodes.select(F.col("id").alias(s), F.col("y").alias("lat_" + s), F.col("x").alias("lon_" + s))
    both = edges.join(end("u"), "u").join(end("v"), "v")
    return both.withColumn("length", great_circle_m(F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v"))).drop("lat_u", "lon_u", "lat_v", "lon_v")


def undirected(edges: DataFrame) -> DataFrame:
    """u < v with the shortest length of each pair; loops go."""
    return edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("length").alias("length"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "length").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length"))


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with an index from 0 on, without gaps, and the edges between indexes: a sparse matrix in coordinates."""
    ids = nodes.select("id").distinct().orderBy("id")
    part = cut(ids.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    # Row numbers restart in each partition; partitions are few and add what lies before them.
    size = part.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    before = size.alias("a").join(size.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part", "a.low").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("base"))
    index = cut(part.join(F.broadcast(before), "part").select("id", (F.col("row") - F.col("low") + F.col("base")).alias("index")))
    x, y = index.toDF("u", "i"), index.toDF("v", "j")
    return nodes.join(index, "id"), edges.join(x, "u").join(y, "v").groupBy("i", "j").agg(F.min("length").alias("length"))


def snapped(points: DataFrame, nodes: DataFrame, start_m: float = 200.0) -> DataFrame:
    """id, node, dist: the nearest node of each point (id, lat, lon), ties to the smaller id."""
    at = nodes.select("id", F.col("y").alias("lat"), F.col("x").alias("lon"))
    return nearest(points, at, start_m).select(F.col("src").alias("id"), F.col("dst").alias("node"), "dist")


def neighbours(edges: DataFrame, snaps: DataFrame, max_walk_m: float, kmh: float = WALK_KMH, same_node: bool = True) -> DataFrame:
    """src, dst, walk_s between snapped stops (id, node); one search for each node. Stops at one node are 0 seconds apart, or none with same_node False."""
    near = bounded_sssp(cut(edges), snaps.select(F.col("node").alias("source")).distinct(), max_walk_m)
    x, y = snaps.select(F.col("id").alias("src"), F.col("node").alias("source")), snaps.select(F.col("id").alias("dst"), "node")
    both = near.join(x, "source").join(y, "node").where("src <> dst")
    return (both if same_node else both.where("source <> node")).select("src", "dst", walk_seconds(F.col("dist"), kmh).alias("walk_s"))


def access(edges: DataFrame, nodes: DataFrame, origins: DataFrame, snaps: DataFrame, departure: int, max_walk_m: float, kmh: float = WALK_KMH) -> tuple[DataFrame, DataFrame]:
    """Stops that origins (id, lat, lon) reach on the network (origin_id, stop_id, arr), and each origin's node (origin_id, node)."""
    at = cut(snapped(origins, nodes).select(F.col("id").alias("origin_id"), "node"))
    near = bounded_sssp(cut(edges), at.select(F.col("node").alias("source")).distinct(), max_walk_m)
    hits = near.join(at.select("origin_id", F.col("node").alias("source")), "source").join(snaps.select(F.col("id").alias("stop_id"), "node"), "node")
    return hits.select("origin_id", "stop_id", (F.lit(departure) + walk_seconds(F.col("dist"), kmh)).alias("arr")), at


def sources(best: DataFrame, snaps: DataFrame, origins: DataFrame, departure: int) -> DataFrame:
    """origin_id, node, arr, is_origin: the earliest arrival at each node of a reached stop, and the origin's own node at departure.

    Reached stops that are not snapped are left out; the origin's node has its whole band, whenever a stop there is reached."""
    at = best.join(snaps.select(F.col("id").alias("stop_id"), "node"), "stop_id").select("origin_id", "node", "arr", F.lit(False).alias("is_origin"))
    own = origins.select("origin_id", "node", F.lit(departure).cast("double").alias("arr"), F.lit(True).alias("is_origin"))
    return at.withColumn("arr", F.col("arr").cast("double")).unionByName(own).groupBy("origin_id", "node").agg(F.min("arr").alias("arr"), F.max("is_origin").alias("is_origin"))


def egress_bands(edges: DataFrame, starts: DataFrame, departure: int, bands: list[int], kmh: float = WALK_KMH) -> DataFrame:
    """origin_id, band, u, v of undirected edges that lie within a band.

    An edge counts if one source reaches both its ends with what the band leaves after its arrival, at least LEAST_S
    seconds; the origin's node has the whole band. Both come down to the least seconds an edge needs, so bands nest."""
    speed = kmh * 1000 / 3600
    e = cut(undirected(edges))
    left = F.lit(max(bands, default=0)) - F.when(F.col("is_origin"), 0).otherwise(F.col("arr") - departure)
    starts = cut(starts.withColumn("left", left).where(F.col("left") >= LEAST_S))
    near = bounded_sssp(cut(both_ways(e).withColumn("length", F.col("length").cast("double"))), starts.select(F.col("node").alias("source")).distinct(), max(bands, default=0) * speed)
    i, j = (near.select("source", F.col("node").alias(s), F.col("dist").alias("d" + s)) for s in "uv")
    ends = e.select("u", "v").join(i, "u").join(j, ["source", "v"]).select("source", "u", "v", F.greatest("du", "dv").alias("far"))
    spent = F.when(F.col("is_origin"), F.lit(0.0)).otherwise(F.col("arr") - departure)
    # Metres are compared with metres, so an edge at the very edge of a band is within it.
    rows = ends.join(starts.select("origin_id", F.col("node").alias("source"), spent.alias("spent")), "source")
    rows = rows.withColumn("band", F.explode(F.array(*map(F.lit, bands)).cast("array<int>")))
    return rows.where((F.col("band") - F.col("spent") >= LEAST_S) & (F.col("far") <= (F.col("band") - F.col("spent")) * speed)).select("origin_id", "band", "u", "v").distinct()
