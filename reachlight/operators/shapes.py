"""Polygons of what is reached: raster cells round edges or stops, their union, rings, holes, simplification, features.

Cells are squares of `cell_m` metres (planar, as distances are), numbered from the origin of coordinates; a cell is in
if its centre is. The union of cells is a distinct, their outline the sides that no other cell shares; only outlines meet
in one task, once for each origin and band. Bands without cells have no outline; `features` gives them an empty polygon.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import LAT_M, LON_M, metres_to_degrees

#: Fixed value: smallest hole that stays, in square degrees.
LEAST_HOLE = 22_500.0 / (111_320.0 * 90_400.0)
RING = "origin_id {kind}, band int, ring array<struct<x:double,y:double>>, hole boolean"


def span(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long")))


def cells_by(df: DataFrame, x1: Column, x2: Column, y1: Column, y2: Column, test, cell_m: float, keep: list[str]) -> DataFrame:
    """Cells of the box of each row whose centre (metres) passes the test."""
    rows = df.withColumn("cx", span(x1 / cell_m, x2 / cell_m)).withColumn("cy", span(y1 / cell_m, y2 / cell_m))
    return rows.where(test((F.col("cx") + 0.5) * cell_m, (F.col("cy") + 0.5) * cell_m)).select(*keep, "cx", "cy").distinct()


def edge_cells(edges: DataFrame, buffer_m: float, cell_m: float = 10.0) -> DataFrame:
    """origin_id, band, cx, cy of cells within buffer_m of an edge (x1, y1, x2, y2 in degrees), ends round."""
    m = {"x1": LON_M, "x2": LON_M, "y1": LAT_M, "y2": LAT_M}
    df = edges.withColumns({"m" + c: F.col(c) * k for c, k in m.items()})
    ax, ay, bx, by = (F.col("m" + c) for c in ("x1", "y1", "x2", "y2"))

    def near(px: Column, py: Column) -> Column:
        dx, dy = bx - ax, by - ay
        t = F.when(dx * dx + dy * dy > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))).otherwise(0.0)
        ex, ey = px - ax - t * dx, py - ay - t * dy
        return ex * ex + ey * ey <= buffer_m * buffer_m

    lo, hi = lambda a, b: F.least(a, b) - buffer_m, lambda a, b: F.greatest(a, b) + buffer_m
    return cells_by(df, lo(ax, bx), hi(ax, bx), lo(ay, by), hi(ay, by), near, cell_m, ["origin_id", "band"])


def circles(best: DataFrame, stops: DataFrame, origins: DataFrame, departure: int, bands: list[int], kmh: float = 5.0) -> DataFrame:
    """origin_id, band, x, y, r (degrees): round each origin what it walks in the whole band, round reached stops what is left; none without."""
    speed = kmh * 1000 / 3600
    each = F.explode(F.array(*map(F.lit, bands)).cast("array<int>")).alias("band")
    at = best.join(stops.select(F.col("id").alias("stop_id"), "lat", "lon"), "stop_id").select("origin_id", F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("arr") - departure).alias("spent"), each)
    own = origins.select(F.col("id").alias("origin_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(0.0).alias("spent"), each)
    both = at.unionByName(own).where("band > spent")
    return both.select("origin_id", "band", "x", "y", metres_to_degrees((F.col("band") - F.col("spent")) * speed).alias("r"))


def circle_cells(rows: DataFrame, cell_m: float = 50.0) -> DataFrame:
    """Cells whose centre lies in a circle of r degrees, as wide in degrees both ways."""
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    inside = lambda px, py: F.pow(px / LON_M - x, 2) + F.pow(py / LAT_M - y, 2) <= r * r
    return cells_by(rows, (x - r) * LON_M, (x + r) * LON_M, (y - r) * LAT_M, (y + r) * LAT_M, inside, cell_m, ["origin_id", "band"])


def outlines(cells: DataFrame) -> DataFrame:
    """Sides (x1, y1) to (x2, y2) of cells whose neighbour there is none, the cell on their left."""
    sides = [(0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)]
    s = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for v, n in zip(side, ("dx", "dy", "a", "b", "c", "d")))) for side in sides))
    rows = cells.select("origin_id", "band", "cx", "cy", F.inline(s))
    rows = rows.select("origin_id", "band", (F.col("cx") + F.col("dx")).alias("nx"), (F.col("cy") + F.col("dy")).alias("ny"), *((F.col("c" + "xy"[k % 2]) + F.col(n)).alias(o) for k, (n, o) in enumerate(zip("abcd", ("x1", "y1", "x2", "y2")))))
    other = cells.select("origin_id", "band", F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    return rows.join(other, ["origin_id", "band", "nx", "ny"], "left_anti").select("origin_id", "band", "x1", "y1", "x2", "y2")


def chained(x1, y1, x2, y2) -> list[np.ndarray]:
    """Closed rings of directed sides, corners only. Where two rings touch in a point each turns left, so cells that meet at a corner stay apart."""
    after: dict = {}
    for a, b, c, d in zip(x1, y1, x2, y2):
        after.setdefault((a, b), []).append((c, d))
    rings = []
    while after:
        start = next(iter(after))
        ring, at, way = [start], start, None
        while True:
            ends = after[at]
            pick = 0
            if len(ends) > 1 and way is not None:
                left = (-way[1], way[0])
                pick = next((k for k, e in enumerate(ends) if (e[0] - at[0], e[1] - at[1]) == left), 0)
            to = ends.pop(pick)
            if not ends:
                del after[at]
            now = (to[0] - at[0], to[1] - at[1])
            if now == way:
                ring[-1] = to
            else:
                ring.append(to)
            at, way = to, now
            if at == start:
                break
        first = (ring[1][0] - ring[0][0], ring[1][1] - ring[0][1])
        if first[0] * way[1] == first[1] * way[0]:
            ring = ring[1:-1] + [ring[1]]
        rings.append(np.array(ring, float))
    return rings


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring from its first point and the one farthest from it; at least a triangle stays."""
    if tolerance <= 0 or len(ring) < 5:
        return ring
    far = int(((ring - ring[0]) ** 2).sum(1).argmax())
    keep, todo = {0, far, len(ring) - 1}, [(0, far), (far, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = ring[a + 1 : b] - ring[a], ring[b] - ring[a]
        size = np.hypot(*d)
        off = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / size if size else np.hypot(p[:, 0], p[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[sorted(keep)] if len(keep) >= 4 else ring


def inside(point, ring: np.ndarray) -> bool:
    x, y = point
    a, b = ring[:-1], ring[1:]
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((cross & (x < at)).sum() % 2)


def polygons(cells: DataFrame, cell_m: float, tolerance: float = 0.0005, least_hole: float = LEAST_HOLE) -> DataFrame:
    """origin_id, band, geometry: GeoJSON text of the union of a band's cells, small holes filled, simplified by tolerance degrees."""
    kind = cells.schema["origin_id"].dataType.simpleString()
    sx, sy = cell_m / LON_M, cell_m / LAT_M

    def trace(sides: pd.DataFrame) -> pd.DataFrame:
        sides = sides.sort_values(["y1", "x1", "y2", "x2"])
        rings = [r * (sx, sy) for r in chained(*(sides[c].tolist() for c in ("x1", "y1", "x2", "y2")))]
        outer, holes = [r for r in rings if signed_area(r) > 0], [r for r in rings if signed_area(r) < -least_hole]
        shapes = [[r] for r in sorted(outer, key=lambda r: -signed_area(r))]
        for h in holes:
            # A point just inside the hole's first side, within the polygon that has the hole.
            around = [s for s in shapes if inside(h[0] + (h[1] - h[0]) / 2 + np.array([-(h[1] - h[0])[1], (h[1] - h[0])[0]]) * 1e-3, s[0])]
            (around or shapes)[-1].append(h)
        coords = [[simplified(r, tolerance).tolist() for r in s] for s in shapes]
        shape = {"type": "Polygon", "coordinates": coords[0]} if len(coords) == 1 else {"type": "MultiPolygon", "coordinates": coords}
        return pd.DataFrame({"origin_id": [sides["origin_id"].iloc[0]], "band": [sides["band"].iloc[0]], "geometry": [json.dumps(shape)]})

    return outlines(cells).groupBy("origin_id", "band").applyInPandas(trace, f"origin_id {kind}, band int, geometry string")


EMPTY = '{"type": "Polygon", "coordinates": []}'


def features(shapes: DataFrame, best: DataFrame, origins: DataFrame, departure: int, bands: list[int], method: str, kmh: float = 5.0) -> DataFrame:
    """origin_id, band, reachable_stops, feature: GeoJSON features of all bands, largest first; a band without shape is empty, without stops."""
    rows = origins.select(F.col("id").alias("origin_id"), F.explode(F.array(*map(F.lit, bands)).cast("array<int>")).alias("band"))
    reached = best.join(rows, "origin_id").where(F.col("arr") <= departure + F.col("band")).groupBy("origin_id", "band").agg(F.count("*").alias("n"))
    rows = rows.join(reached, ["origin_id", "band"], "left").join(shapes, ["origin_id", "band"], "left")
    rows = rows.withColumn("reachable_stops", F.when(F.col("geometry").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long"))
    known = F.to_json(F.struct(F.lit(departure).alias("departure_seconds"), F.col("band").alias("duration_seconds"), "reachable_stops", F.when(F.col("geometry").isNotNull(), F.lit(kmh)).alias("walk_speed_kmh"), F.when(F.col("geometry").isNotNull(), F.lit(method)).alias("method"), F.floor(F.col("band") / 60).alias("duration_minutes")))
    text = F.concat(F.lit('{"type": "Feature", "geometry": '), F.coalesce("geometry", F.lit(EMPTY)), F.lit(', "properties": '), known, F.lit("}"))
    return rows.select("origin_id", "band", "reachable_stops", text.alias("feature")).orderBy("origin_id", F.desc("band"))


def isochrones(net, origins: DataFrame, departure: int, bands: list[int], kmh: float = 5.0, max_walk_m: float = 800.0, buffer_m: float = 20.0, cell_m: float = 10.0, tolerance: float = 0.0005) -> DataFrame:
    """Features of origins (id, lat, lon) by bands (seconds): on the network's roads if it has any, else by circles.

    Bands must not be empty; one band is an isochrone of one duration. The longest is searched once and serves all."""
    from . import reach, walk
    from .stored import cut

    if not bands or min(bands) <= 0:
        raise ValueError("bands must be positive seconds")
    longest = max(bands)
    if net.edges is None:
        best = cut(reach.earliest_arrival(net.stop_times, net.walks, reach.access(origins, net.stops, departure, max_walk_m, kmh), departure + longest))
        shapes = polygons(circle_cells(circles(best, net.stops, origins, departure, bands, kmh), 5 * cell_m), 5 * cell_m, tolerance)
        return features(shapes, best, origins, departure, bands, "circular_buffer", kmh)
    start, at = walk.access(net.edges, net.nodes, origins, net.snaps, departure, max_walk_m, kmh)
    best = cut(reach.earliest_arrival(net.stop_times, net.walks, cut(start), departure + longest))
    marked = walk.egress_bands(net.edges, walk.sources(best, net.snaps, at, departure), departure, bands, kmh)
    end = lambda s, k: net.nodes.select(F.col("id").alias(s), F.col("x").alias("x" + k), F.col("y").alias("y" + k))
    drawn = marked.join(end("u", "1"), "u").join(end("v", "2"), "v")
    return features(polygons(edge_cells(drawn, buffer_m, cell_m), cell_m, tolerance), best, origins, departure, bands, "road_network" if len(bands) == 1 else "edge_buffer", kmh)
