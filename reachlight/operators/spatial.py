"""Spatial joins over grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import LAT_M, LON_M, planar_m
from .stored import cut


def cell(x, size: float):
    return F.floor(x / F.lit(size))


def ring(df: DataFrame, size: float, reach: int = 1) -> DataFrame:
    """Each row once for every cell within `reach` of its own."""
    near = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).withColumn("cx", cell(F.col("lon"), size) + F.col("_i")).withColumn("cy", cell(F.col("lat"), size) + F.col("_j")).drop("_i", "_j")


def within(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Pairs src, dst, dist of (id, lat, lon) rows at most `metres` apart: an equi-join of cells, none missed."""
    size = metres / min(LAT_M, LON_M) * 1.0001
    l = ring(a.select(F.col("id").alias("src"), "lat", "lon"), size).withColumnsRenamed({"lat": "lat1", "lon": "lon1"})
    r = b.select(F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), cell(F.col("lon"), size).alias("cx"), cell(F.col("lat"), size).alias("cy"))
    dist = planar_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return l.join(r, ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= metres).select("src", "dst", "dist")


def cells_truncated(x, size: float):
    """Cell numbers cut towards zero."""
    return (x / F.lit(size)).cast("long")


def within_coarse(a: DataFrame, b: DataFrame, metres: float, size: float = 0.005) -> DataFrame:
    """Like `within`, but only pairs of the same or adjacent cells of `size` degrees, however large `metres` is."""
    near = F.sequence(F.lit(-1), F.lit(1))
    l = a.select(F.col("id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near))
    l = l.withColumn("cx", cells_truncated(F.col("lon1"), size) + F.col("_i")).withColumn("cy", cells_truncated(F.col("lat1"), size) + F.col("_j")).drop("_i", "_j")
    r = b.select(F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).withColumn("cx", cells_truncated(F.col("lon2"), size)).withColumn("cy", cells_truncated(F.col("lat2"), size))
    dist = planar_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return l.join(r, ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= metres).select("src", "dst", "dist")


def nearest(a: DataFrame, b: DataFrame, start_m: float = 1000.0) -> DataFrame:
    """src with its nearest dst (ties: smaller id) and dist, for each id of a, by growing grids; rows found leave the search.

    Rows without coordinates take no part. The last ring spans the earth, so all others are found unless b is empty."""
    a, b = (x.where("lat is not null and lon is not null").select("id", "lat", "lon") for x in (a, b))
    left = cut(a.dropDuplicates(["id"]))
    found, b = [], cut(b)
    if b.isEmpty():
        return left.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist")).limit(0)
    while not left.isEmpty():
        got = within(left, b, start_m).groupBy("src").agg(F.min(F.struct("dist", "dst")).alias("m"))
        found.append(cut(got.select("src", F.col("m.dst").alias("dst"), F.col("m.dist").alias("dist"))))
        left = cut(left.join(found[-1].select(F.col("src").alias("id")), "id", "left_anti"))
        start_m *= 4
    out = found[0] if found else left.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    for f in found[1:]:
        out = out.unionAll(f)
    return out
