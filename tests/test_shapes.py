"""Shapes, sinks and maps."""

import json

import pytest
from pyspark.sql import functions as F

from reachlight.functions import scalars as S
from reachlight.operators import network as N, shapes as G, spatial, walk as W
from reachlight.sinks import maps, tables

CELLS = "origin_id string, band int, cx long, cy long"


def outline(spark, cells, **options):
    df = spark.createDataFrame([("o", 1, *c) for c in cells], CELLS)
    return json.loads(G.polygons(df, 1.0, 0.0, **options).first().geometry)


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2 * S.LAT_M * S.LON_M


def test_rings(spark):
    square = [(x, y) for x in range(5) for y in range(5)]
    p = outline(spark, square)
    assert p["type"] == "Polygon" and len(p["coordinates"][0]) == 5 and area(p["coordinates"][0]) == pytest.approx(25)
    ring = [c for c in square if c != (2, 2)]
    assert [round(area(r)) for r in outline(spark, ring, least_hole=0.0)["coordinates"]] == [25, -1]
    assert len(outline(spark, ring)["coordinates"]) == 1
    two = outline(spark, [(0, 0), (1, 1), (9, 9)])
    assert two["type"] == "MultiPolygon" and len(two["coordinates"]) == 3
    island = outline(spark, ring + [(20, 0)], least_hole=0.0)
    assert [len(s) for s in island["coordinates"]] == [2, 1]
    # An island in a hole, and holes that touch in a corner.
    big = {(x, y) for x in range(9) for y in range(9)} - {(x, y) for x in range(2, 7) for y in range(2, 7)} | {(4, 4)}
    assert sorted(len(s) for s in outline(spark, sorted(big), least_hole=0.0)["coordinates"]) == [1, 2]
    touch = {(x, y) for x in range(5) for y in range(5)} - {(1, 1), (2, 2)}
    assert sum(area(r) for s in [outline(spark, sorted(touch), least_hole=0.0)["coordinates"]] for r in s) == pytest.approx(23)
    assert G.polygons(spark.createDataFrame([], CELLS), 1.0).count() == 0


def test_simplify():
    import numpy as np

    stairs = np.array([[x, y] for k in range(20) for x, y in ((k, k), (k + 1, k))] + [[0, 20], [0, 0]], float)
    got = G.simplified(stairs, 1.0)
    assert len(got) < 8 and (got[0] == got[-1]).all() and (G.simplified(stairs, 0.0) == stairs).all()


def test_cells(spark):
    e = spark.createDataFrame([("o", 1, 0.0, 0.0, 100 / S.LON_M, 0.0)], "origin_id string, band int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.cx, r.cy) for r in G.edge_cells(e.union(e), 20.0, 10.0).collect()}
    want = {(x, y) for x in range(-4, 14) for y in range(-4, 4) if (max(0, -(x + 0.5) * 10, (x + 0.5) * 10 - 100) ** 2 + ((y + 0.5) * 10) ** 2) <= 400}
    assert got == want
    c = spark.createDataFrame([("o", 1, 0.0, 0.0, 30 / S.LON_M)], "origin_id string, band int, x double, y double, r double")
    assert 0 < G.circle_cells(c, 10.0).count() < 60
    assert G.edge_cells(e.limit(0), 20.0).count() == 0


def network(spark):
    m = 0.0009
    nodes = spark.createDataFrame([(i * 12 + j, 139.7 + j * m, 35.6 + i * m) for i in range(12) for j in range(12)], "id long, x double, y double")
    pairs = [(i * 12 + j, i * 12 + j + 1) for i in range(12) for j in range(11)] + [(i * 12 + j, i * 12 + j + 12) for i in range(11) for j in range(12)]
    edges = W.both_ways(W.with_length(spark.createDataFrame(pairs, "u long, v long"), nodes))
    stops = spark.createDataFrame([("a", 35.6001, 139.7001), ("b", 35.6099, 139.7099)], "id string, lat double, lon double")
    times = spark.createDataFrame([("t", 0, "a", None, 30700), ("t", 1, "b", 30800, None)], "trip_id string, seq int, stop_id string, arr_s int, dep_s int")
    snaps = W.snapped(stops, nodes)
    return N.Network(stops, times, W.neighbours(edges, snaps, 300.0), nodes, edges, snaps)


def test_isochrones(spark, tmp_path):
    net, o = network(spark), spark.createDataFrame([("o", 35.6, 139.7), ("far", 36.5, 139.7)], "id string, lat double, lon double")
    rows = G.isochrones(net, o.where("id = 'o'"), 30600, [200, 400]).collect()
    found = [json.loads(r.feature) for r in rows]
    assert [(r.band, r.reachable_stops) for r in rows] == [(400, 2), (200, 2)] and found[0]["properties"]["method"] == "edge_buffer"
    size = [sum(area(r) for s in (f["geometry"]["coordinates"] if f["geometry"]["type"] == "MultiPolygon" else [f["geometry"]["coordinates"]]) for r in s) for f in found]
    assert size[0] > size[1] > 0
    crow = N.Network(net.stops, net.stop_times, N.crow_walks(net.stops, 300.0))
    rows = {(r.origin_id, r.band): json.loads(r.feature) for r in G.isochrones(crow, o, 30600, [200]).collect()}
    assert rows["o", 200]["properties"]["reachable_stops"] == 2 and rows["far", 200]["properties"]["method"] == "circular_buffer"
    empty = json.loads(G.features(spark.createDataFrame([], "origin_id string, band int, geometry string"), spark.createDataFrame([], "origin_id string, stop_id string, arr int"), o.limit(1), 5, [60], "x").first().feature)
    assert empty["geometry"] == {"type": "Polygon", "coordinates": []} and "method" not in empty["properties"] and empty["properties"]["reachable_stops"] == 0
    with pytest.raises(ValueError):
        G.isochrones(crow, o, 30600, [])
    path = str(tmp_path / "out/map.geojson")
    maps.save_geojson(spark, found, path, indent=1)
    assert json.load(open(path)) == {"type": "FeatureCollection", "features": found} and maps.collection(found[0])["features"] == [found[0]]
    html = maps.contour_map([f | {"properties": {"duration_minutes": m}} for f, m in zip(found, (10, 90))], 10, 35.6, 139.7, "Origin (08:30)")
    assert html.index("90min") < html.index("10min") and maps.COLOURS[5] in html and maps.COLOURS[0] in html and "Origin (08:30)" in maps.single_map(found[0], 1.0, 2.0, "Origin (08:30)")


def test_names_and_notices():
    assert maps.output_path(None, {}, "s") == "output/s.html" and maps.output_path("x", {"output": {"path": "y"}}, "s") == "x" and maps.output_path(None, {"output": {"dir": "d"}}, "s", ".geojson") == "d/s.geojson"
    assert maps.wants_geojson(None, {"output": {"geojson": True}}) and not maps.wants_geojson(False, {"output": {"geojson": True}})
    assert "50%" in maps.notice("suspicious", 1, found=1, active=2, threshold=0.5) and "errors=2" in maps.notice("completed", 1, status="completed", stats={"errors": 2})
    assert "東京" in maps.notice("started", 1, prefectures=[13], types=["mansion"]) and "dup=3" in maps.notice("prefecture", 1, prefecture=14, stats={"duplicates": 3}, total={}) and "BAN" in maps.notice("banned", 1, stats={}) and "boom" in maps.notice("error", 1, message="boom")
    assert not maps.notify(None, "x") and not maps.notify(lambda t: 1 / 0, "x") and maps.notify(lambda t: None, "x")


def test_tables(spark, tmp_path):
    base = str(tmp_path)
    tables.create(spark, base)
    tables.append(spark.createDataFrame([("r", "o")], "railway_id string, operator string"), f"{base}/railway_lines")
    tables.create(spark, base)
    assert {r.table: r.rows for r in tables.report(spark, base).collect()}["railway_lines"] == 1
    tables.create(spark, base, reset=True)
    assert {r.table: r.rows for r in tables.report(spark, base).collect()}["railway_lines"] == 0
    tables.replace(spark.range(3), f"{base}/t")
    with pytest.raises(Exception):
        tables.replace(spark.range(3).select(F.expr("raise_error('no')").alias("x")), f"{base}/t")
    tables.replace_all({"t": spark.range(4), "u": spark.range(2)}, base)
    assert spark.read.parquet(f"{base}/t").count() == 4 and sorted(p.name for p in tmp_path.glob("t*")) == ["t"]
    built = []
    for n in (1, 1, 2):
        assert tables.kept(spark, base, "k", {"n": n}, lambda: built.append(n) or spark.range(n)).count() == n
    assert built == [1, 2]


def test_spatial(spark):
    pts = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double")
    base, deg = 35.65, 1 / S.LAT_M
    b = pts([(k, base + m * deg, 139.7) for k, m in ((1, 450), (2, 560), (3, 790), (4, 810))])
    a = pts([(0, base, 139.7)])
    assert sorted(r.dst for r in spatial.within(a, b, 800.0).collect()) == [1, 2, 3] and {r.dst for r in spatial.within_coarse(a, b, 800.0).collect()} <= {1, 2, 3}
    far = pts([(9, -40.0, -70.0), (8, None, 1.0)])
    assert [(r.src, r.dst) for r in spatial.nearest(far, b).collect()] == [(9, 1)] and spatial.nearest(a, b.limit(0)).count() == 0
    same = pts([(2, base, 139.7), (1, base, 139.7)])
    assert spatial.nearest(a, same).first().dst == 1
    ring = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)],)], "r array<struct<x:double,y:double>>")
    assert ring.select(S.ring_area(F.col("r"))).first()[0] == 2.0 and ring.select(S.vertices(F.array("r", "r"))).first()[0] == 8
