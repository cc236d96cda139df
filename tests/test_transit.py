"""Importers, network loading and reach on hand-written files and networks."""

import json
import random

import pytest

from reachlight.operators import network as N, reach as R, walk as W
from reachlight.operators.tables import chunked, counts, first_wins, insert_or_ignore, latest, upsert_last
from reachlight.sources import files, transit as T


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8-sig" if path.suffix == ".txt" else "utf-8")
    return str(path)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_bus(spark, tmp_path):
    stops = put(tmp_path / "stops.json", [
        {"owl:sameAs": "odpt.BusstopPole:Toei.Zoshiki.848.2", "dc:title": "A", "title": {"en": "Aa"}, "geo:lat": 35.6, "geo:long": 139.7, "odpt:operator": ["odpt.Operator:Toei"], "odpt:busroutePattern": ["odpt.BusroutePattern:Toei.Ou57.30902.2", ""]},
        {"owl:sameAs": "odpt.BusstopPole:Toei.Zoshiki.848.2", "dc:title": "again", "geo:lat": 1.0, "geo:long": 1.0, "odpt:operator": "odpt.Operator:Other"},
        {"owl:sameAs": "odpt.BusstopPole:Toei.B.849.1", "dc:title": "B", "title": "text", "geo:lat": 35.61, "geo:long": 139.7, "odpt:operator": "odpt.Operator:Toei", "odpt:busroutePattern": []},
        {"owl:sameAs": "odpt.BusstopPole:Toei.C.850.1", "dc:title": "no place"},
    ])
    s = T.bus_stops(spark, stops)
    assert rows(s, "busstop_id", "name_ja", "name_en", "operator") == [("848.2", "A", "Aa", "Toei"), ("849.1", "B", "Unknown", "Toei")]
    assert {r.busstop_id: r.busroute_pattern for r in s.collect()} == {"848.2": ["30902.2"], "849.1": []}
    routes = put(tmp_path / "routes.json", [
        {"odpt:pattern": "30902", "odpt:direction": "2", "dc:title": "one", "odpt:operator": "odpt.Operator:Toei", "ug:region": {"coordinates": [[139.7, 35.6], [139.7, 35.61]]}, "odpt:busstopPoleOrder": [{"odpt:index": 1, "odpt:busstopPole": "odpt.BusstopPole:Toei.Zoshiki.848.2"}]},
        {"odpt:pattern": "30902", "odpt:direction": "2", "dc:title": "two", "ug:region": {"coordinates": [[1.0, 2.0]]}},
        {"odpt:pattern": "7", "dc:title": "no direction"}, {"odpt:pattern": "", "dc:title": "no pattern"},
    ])
    r = T.bus_routes(spark, routes)
    assert rows(r, "route_id", "title", "geom") == [("30902.2", "one", None), ("7.None", "no direction", None)]
    assert rows(T.bus_route_stops(spark, routes), "route_id", "busstop_id", "stop_order") == [("30902.2", "848.2", 1)]
    pole = lambda i, p, a, d: {"odpt:index": i, "odpt:busstopPole": p, "odpt:arrivalTime": a, "odpt:departureTime": d}
    times = put(tmp_path / "times.json", [
        {"owl:sameAs": "odpt.BusTimetable:T1", "odpt:busroutePattern": "odpt.BusroutePattern:Toei.Ou57.30902.2", "odpt:busTimetableObject": [pole(1, "odpt.BusstopPole:Toei.Zoshiki.848.2", None, "08:00"), pole(2, "odpt.BusstopPole:Toei.B.849.1", "08:05", "08:06"), pole(3, "odpt.BusstopPole:Toei.Zoshiki.848.2", "08:10", None), pole(4, "x.1.1", "08:11", None)]},
        {"owl:sameAs": "odpt.BusTimetable:T2", "odpt:busroutePattern": "odpt.BusroutePattern:Toei.X.1.1", "odpt:busTimetableObject": [pole(1, "odpt.BusstopPole:Toei.Zoshiki.848.2", None, "09:00")]},
        {"owl:sameAs": "", "odpt:busroutePattern": "odpt.BusroutePattern:Toei.Ou57.30902.2", "odpt:busTimetableObject": [pole(1, "odpt.BusstopPole:Toei.Zoshiki.848.2", None, "09:00")]},
    ])
    assert rows(T.bus_timetable(spark, times, r, s), "timetable_id", "busstop_id", "stop_order", "arr_s", "dep_s") == [("T1", "848.2", 1, None, 28800), ("T1", "849.1", 2, 29100, 29160)]


def test_rail(spark, tmp_path):
    st = lambda i, line, lat, op: {"owl:sameAs": f"odpt.Station:{line}.{i}", "dc:title": i, "geo:lat": lat, "geo:long": 139.0 if lat else None, "odpt:railway": f"odpt.Railway:{line}", "odpt:operator": op, "odpt:stationTitle": {"en": i.lower()}}
    p = put(tmp_path / "st.json", [st("A", "L.One", 35.0, "odpt.Operator:First"), st("B", "L.One", 35.1, "odpt.Operator:Second"), st("C", "L.Two", None, ["odpt.Operator:Third"])])
    assert rows(T.railway_lines(spark, p), "railway_id", "operator") == [("L.One", "First"), ("L.Two", "Third")]
    assert rows(T.railway_stations(spark, p), "station_id", "name_en", "railway_id") == [("L.One.A", "a", "L.One"), ("L.One.B", "b", "L.One")]
    obj = lambda n, t, to: {"odpt:trainNumber": n, "odpt:trainType": "odpt.TrainType:L.Local", "odpt:departureTime": t, "odpt:destinationStation": to}
    q = put(tmp_path / "stt.json", [{"odpt:station": "odpt.Station:L.One.A", "odpt:calendar": "odpt.Calendar:Weekday", "odpt:railDirection": "odpt.RailDirection:Out", "odpt:stationTimetableObject": [obj("1", "08:00", ["odpt.Station:L.One.B"]), obj("2", None, "odpt.Station:L.One.B"), obj("3", "24:10", [])]}])
    assert rows(T.station_timetable(spark, q), "train_number", "dep_s", "destination_station", "calendar") == [("1", 28800, "L.One.B", "Weekday"), ("2", None, "L.One.B", "Weekday"), ("3", 600, None, "Weekday")]
    stop = lambda d, a, t: {"odpt:departureStation": d, "odpt:arrivalStation": a, "odpt:departureTime": t}
    trains = [{"owl:sameAs": "odpt.TrainTimetable:X", "odpt:railway": "odpt.Railway:L.One", "odpt:calendar": "odpt.Calendar:Weekday", "odpt:originStation": ["odpt.Station:L.One.A"], "odpt:trainTimetableObject": [stop("odpt.Station:L.One.A", None, "08:00"), stop("", "odpt.Station:L.One.B", "08:09")]}, {"owl:sameAs": "odpt.TrainTimetable:X", "odpt:railway": "odpt.Railway:other"}, {"owl:sameAs": None}]
    heads, stops = T.train_timetable(spark, put(tmp_path / "tt.json", trains))
    assert rows(heads, "timetable_id", "railway_id", "origin_station", "destination_station") == [("X", "L.One", "L.One.A", None)]
    assert rows(stops, "timetable_id", "stop_order", "station_id", "dep_s") == [("X", 0, "L.One.A", 28800), ("X", 1, "L.One.B", 29340)]


def test_metro_and_further(spark, tmp_path):
    put(tmp_path / "g/routes.txt", "route_id,x\n1,\n99,\n")
    put(tmp_path / "g/stops.txt", "stop_id,stop_code,stop_name,stop_lat,stop_lon\ns1,G01,渋谷,35.6,139.7\ns2,g02,表参道,35.61,139.71\ns3,Q1,none,1,1\ns4,,none,1,1\n")
    put(tmp_path / "g/trips.txt", "trip_id,route_id,service_id,direction_id\nt1,1,1,1\nt2,99,0,0\nt3,1,7,\nt4,1,0,0\n")
    put(tmp_path / "g/stop_times.txt", "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nt1,s2,10,24:08:00,24:08:30\nt1,s1,2,23:59:00,23:59:30\nt1,s3,3,,\nt3,s1,1,,08:00:00\n")
    m = T.metro(spark, str(tmp_path / "g"))
    assert rows(m["stations"], "station_id", "name_en") == [("TokyoMetro.Ginza.G01", ""), ("TokyoMetro.Ginza.g02", "")]
    assert rows(m["headers"], "timetable_id", "calendar", "rail_direction", "origin_station", "destination_station") == [("TokyoMetro.t1", "SaturdayHoliday", "Inbound", "TokyoMetro.Ginza.G01", "TokyoMetro.Ginza.g02"), ("TokyoMetro.t3", "Weekday", "Outbound", "TokyoMetro.Ginza.G01", "TokyoMetro.Ginza.G01")]
    assert rows(m["stops"], "timetable_id", "stop_order", "arr_s", "dep_s") == [("TokyoMetro.t1", 0, 86340, 86370), ("TokyoMetro.t1", 2, 480, 510), ("TokyoMetro.t3", 0, None, 28800)]
    put(tmp_path / "g/translations.txt", "table_name,language,field_value,translation\nstops,en,渋谷,Shibuya\nstops,ja,表参道,x\n")
    assert rows(T.metro(spark, str(tmp_path / "g"))["stations"], "name_ja", "name_en") == sorted([("渋谷", "Shibuya"), ("表参道", "")], key=str)
    lines = put(tmp_path / "railways.json", [{"id": "JR.Yamanote"}, {"id": "Toei.Mita"}])
    stations = put(tmp_path / "stations.json", [{"id": "JR.Yamanote.A", "coord": [139.7, 35.6], "railway": "JR.Yamanote", "title": {"ja": "あ"}}, {"id": "JR.Yamanote.B", "railway": "JR.Yamanote"}, {"id": "JR.X.C", "coord": [1.0, 1.0], "railway": "JR.X"}])
    trip = lambda i: {"id": i, "r": "JR.Yamanote", "t": "t", "d": "d", "y": "y", "n": "n", "os": ["JR.Yamanote.A"], "tt": [{"s": "JR.Yamanote.A", "d": "25:10"}, {"s": "gone", "a": "08:00"}]}
    put(tmp_path / "tt/jr.json", [trip("JR.Yamanote.1.Weekday"), trip("JR.Yamanote.1.Weekday.2"), trip("JR.Yamanote.1.Holiday"), trip("a.b")])
    put(tmp_path / "tt/Toei-mita.json", [trip("JR.Yamanote.9.Weekday")])
    f = T.further_trains(spark, lines, stations, str(tmp_path / "tt"))
    assert rows(f["lines"], "railway_id", "operator") == [("JR.Yamanote", "JR")] and rows(f["stations"], "station_id", "latitude") == [("JR.Yamanote.A", 35.6)]
    assert rows(f["headers"], "timetable_id", "origin_station", "destination_station") == [("JR.Yamanote.1.Weekday", "JR.Yamanote.A", None)]
    assert rows(f["stops"], "timetable_id", "stop_order", "dep_s") == [("JR.Yamanote.1.Weekday", 0, 4200)]


def test_osm_and_config(spark, tmp_path):
    xml = '<osm><node id="1" lat="35.0" lon="139.0"/><node id="2" lat="35.001" lon="139.0"/><node id="3" lat="35.002" lon="139.0"/><node id="9" lat="1" lon="1"/><way id="7"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><tag k="highway" v="path"/></way><way id="8"><nd ref="9"/><nd ref="1"/><tag k="x" v="y"/><tag k="name" v="n"/></way></osm>'
    nodes, edges = files.osm(spark, put(tmp_path / "m.osm", xml.replace("><", ">\n<")))
    assert rows(nodes, "id") == [(1,), (2,), (3,)] and rows(edges, "u", "v", "highway") == [(1, 2, "path"), (2, 1, "path"), (2, 3, "path"), (3, 2, "path")]
    e = W.with_length(edges, nodes)
    assert all(abs(r.length - 111.2) < 0.1 for r in e.collect())
    assert files.within_box(nodes, edges, 139.0, 35.0, 139.0, 35.0)[1].count() == 4 and files.within_box(nodes, edges, 10.0, 10.0, 11.0, 11.0)[1].count() == 0
    path = str(tmp_path / "graph")
    with pytest.raises(FileNotFoundError):
        files.first_graph(spark, path)
    assert files.first_graph(spark, path, build=lambda: (nodes, edges))[1].count() == 4 and files.first_graph(spark, "/nowhere", path)[0].count() == 3
    a = put(tmp_path / "a.yaml", "db:\n  host: x  # note\n  port: 5\nlist:\n  - 1\n  - b\nflag: true\n")
    assert files.load_config(spark, a, str(tmp_path / "none.yaml"), put(tmp_path / "b.yaml", "db:\n  host: y\n")) == {"db": {"host": "y", "port": 5}, "list": [1, "b"], "flag": True}


def brute(times, walks, start, deadline):
    """Label setting from the rules: board where a trip departs, ride from its first place at the stop, times never falling."""
    best, todo = dict(start), list(start)
    while todo:
        s = todo.pop()
        offers = [(d, best[s] + w) for a, d, w in walks if a == s]
        for trip in times.values():
            deps = [x[2] for x in trip if x[0] == s and x[2] is not None and x[2] >= best[s]]
            if deps:
                top, on = min(deps), False
                for stop, arr, dep in trip:
                    t = dep if arr is None else arr
                    if on and t is not None and t >= top:
                        top = t
                        offers.append((stop, t))
                    on = on or stop == s
        for d, t in offers:
            if t <= deadline and t < best.get(d, deadline + 1):
                best[d] = t
                todo.append(d)
    return best


def reached(spark, times, walks, start, deadline):
    st = spark.createDataFrame([(k, i, *x) for k, trip in times.items() for i, x in enumerate(trip)], "trip_id string, seq int, stop_id string, arr_s int, dep_s int")
    w = spark.createDataFrame(walks, "src string, dst string, walk_s int")
    o = spark.createDataFrame([("o", *x) for x in start.items()], "origin_id string, stop_id string, arr int")
    return {r.stop_id: r.arr for r in R.earliest_arrival(st, w, o, deadline).collect()}


def test_rides(spark):
    falling = {"t": [("A", 100, 100), ("B", 50, 50), ("C", 60, 60)]}
    assert reached(spark, falling, [], {"B": 40}, 1000) == {"B": 40, "C": 60}
    assert reached(spark, falling, [], {"A": 40}, 1000) == {"A": 40}
    loop = {"t": [("A", 0, 10), ("B", 20, 20), ("A", 30, 30), ("C", 40, None), ("D", None, 50), ("E", None, None), ("F", 5, 5)]}
    assert reached(spark, loop, [], {"A": 25}, 1000) == {"A": 25, "C": 40, "D": 50} and reached(spark, loop, [], {"C": 0}, 1000) == {"C": 0}
    assert reached(spark, {}, [("A", "B", 5)], {"A": 1}, 10) == {"A": 1, "B": 6} and reached(spark, {}, [], {}, 10) == {}
    rng = random.Random(4)
    for _ in range(3):
        times = {f"t{k}": [(rng.choice("ABCDEFGH"), rng.choice([None, rng.randrange(200)]), rng.choice([None, rng.randrange(200)])) for _ in range(6)] for k in range(12)}
        walks = [(rng.choice("ABCDEFGH"), rng.choice("ABCDEFGH"), rng.randrange(5, 60)) for _ in range(6)]
        assert reached(spark, times, walks, {"A": 20}, 180) == brute(times, walks, {"A": 20}, 180)


def test_network(spark):
    stations = spark.createDataFrame([("L1.a", "L1", 35.0, 139.0), ("L2.b", "L2", 35.001, 139.0), ("L2.c", "L2", 35.5, 139.0), ("x", "L2", None, None)], "station_id string, railway_id string, latitude double, longitude double")
    heads = spark.createDataFrame([("T", "L1", "Weekday"), ("U", "L2", "SaturdayHoliday")], "timetable_id string, railway_id string, calendar string")
    stops = spark.createDataFrame([("T", 0, "L1.a", None, 100), ("U", 0, "L2.b", 1, 2)], "timetable_id string, stop_order int, station_id string, arr_s int, dep_s int")
    tt = spark.createDataFrame([("L2.c", "Weekday", "Out", "5", 300), ("L2.b", "Weekday", "Out", "5", 200), ("L2.b", "Weekday", "Out", "6", 250), ("L2.b", "Weekday", "Out", "7", None), ("L1.a", "Weekday", "Out", "8", 5), ("L1.a", "Weekday", "Out", "8", 6)], "station_id string, calendar string, rail_direction string, train_number string, dep_s int")
    buses = spark.createDataFrame([("L2.c", 35.002, 139.0), ("no", None, 139.0)], "busstop_id string, latitude double, longitude double")
    bt = spark.createDataFrame([("T", 0, "L2.c", 7, 8)], "timetable_id string, stop_order int, busstop_id string, arr_s int, dep_s int")
    net = N.load(stations, heads, stops, tt, buses, bt, "Weekday", 300.0)
    assert rows(net.stop_times, "trip_id", "seq", "stop_id", "dep_s") == [("T", 0, "L2.c", 8), ("synth_L2_Out_5", 0, "L2.b", 200), ("synth_L2_Out_5", 1, "L2.c", 300)]
    assert rows(net.stops, "id", "kind", "lat") == [("L1.a", "rail", 35.0), ("L2.b", "rail", 35.001), ("L2.c", "bus", 35.002)]
    assert rows(net.walks, "src", "dst") == [("L1.a", "L2.b"), ("L1.a", "L2.c"), ("L2.b", "L1.a"), ("L2.b", "L2.c"), ("L2.c", "L1.a"), ("L2.c", "L2.b")]
    assert N.departure_index(net.stop_times).count() == 3


def test_walks(spark):
    nodes = spark.createDataFrame([(i, 139.0, 35.0 + i * 0.0001) for i in range(6)], "id long, x double, y double")
    edges = spark.createDataFrame([(i, i + 1, 10.0) for i in range(5)] + [(1, 0, 30.0), (2, 2, 1.0)], "u long, v long, length double")
    u = W.undirected(edges)
    assert rows(u, "u", "v", "length") == [(i, i + 1, 10.0) for i in range(5)]
    _, matrix = W.numbered(nodes, u)
    assert rows(matrix, "i", "j") == [(i, i + 1) for i in range(5)]
    snaps = spark.createDataFrame([("a", 0), ("b", 0), ("c", 2), ("d", 5)], "id string, node long")
    assert rows(W.neighbours(W.both_ways(u), snaps, 25.0, same_node=False), "src", "dst") == [("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")]
    assert ("a", "b", 0.0) in rows(W.neighbours(W.both_ways(u), snaps, 25.0), "src", "dst", "walk_s")
    # Two sources of 25 m at the ends of a path: the middle edge lies between them and is neither's.
    starts = spark.createDataFrame([("o", 0, 0.0, False), ("o", 5, 0.0, False)], "origin_id string, node long, arr double, is_origin boolean")
    assert rows(W.egress_bands(u, starts, 0, [40], kmh=2.25), "u", "v") == [(0, 1), (1, 2), (3, 4), (4, 5)]
    late = spark.createDataFrame([("o", 0, 100.0, True), ("o", 5, 75.0, False)], "origin_id string, node long, arr double, is_origin boolean")
    assert rows(W.egress_bands(u, late, 0, [40, 100], kmh=3.6), "band", "u", "v") == [(100, i, i + 1) for i in range(5)] + [(40, i, i + 1) for i in range(4)]
    none = spark.createDataFrame([], "id string, lat double, lon double")
    assert W.snapped(none, nodes).count() == 0 and W.snapped(spark.createDataFrame([("p", 35.00021, 139.0), ("n", None, 1.0)], "id string, lat double, lon double"), nodes).first().node == 2


def test_tables(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (None, 2, "c"), (1, 0, None)], "k int, o int, v string")
    got = rows(first_wins(df, "k", "o"), "k", "v")
    assert got == rows(first_wins(df.orderBy("v"), "k", "o"), "k", "v") and len(got) == 2 and (1, None) in got
    assert rows(upsert_last(spark.createDataFrame([(1, 1, "a", "g"), (1, 2, "b", None)], "k int, o int, v string, g string"), "k", "o", ["v"], ["g"]), "k", "v", "g") == [(1, "a", None)]
    assert rows(insert_or_ignore(df.where("k = 1 and o = 0"), df, "k", "o"), "k", "v") == [(1, None), (None, "c")]
    assert rows(counts({"x": df, "y": df.limit(0)}), "table", "rows") == [("x", 4), ("y", 0)] and latest(df, "o").first().v == "c"
    assert chunked(spark.range(10), 3, "id").groupBy("chunk").count().agg({"count": "max"}).first()[0] <= 3
