"""Importers: bus and rail JSON, metro GTFS and the train timetables of further operators, as one table set.

Rows of a key that is already there are ignored, the first of several wins (routes: the geometry of the last). Rows
without coordinates, with an empty key, or of unknown routes, stops or lines are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..operators.tables import first_wins, only_known
from .files import gtfs, json_array, json_folder, text_or_first

BUS_STOP = "`owl:sameAs` string, `dc:title` string, title string, `odpt:kana` string, `geo:lat` double, `geo:long` double, `odpt:operator` string, `odpt:busstopPoleNumber` string, `odpt:busroutePattern` array<string>"
BUS_ROUTE = "`odpt:pattern` string, `odpt:direction` string, `dc:title` string, `odpt:operator` string, `ug:region` struct<coordinates:array<array<double>>>, `odpt:busstopPoleOrder` array<struct<`odpt:index`:int,`odpt:busstopPole`:string>>"
BUS_TIMES = "`owl:sameAs` string, `odpt:busroutePattern` string, `odpt:busTimetableObject` array<struct<`odpt:index`:int,`odpt:busstopPole`:string,`odpt:arrivalTime`:string,`odpt:departureTime`:string>>"
STATION = "`owl:sameAs` string, `odpt:stationCode` string, `dc:title` string, `odpt:stationTitle` string, `geo:lat` double, `geo:long` double, `odpt:railway` string, `odpt:operator` string"
STATION_TIMES = "`odpt:station` string, `odpt:calendar` string, `odpt:railDirection` string, `odpt:stationTimetableObject` array<struct<`odpt:trainNumber`:string,`odpt:trainType`:string,`odpt:departureTime`:string,`odpt:destinationStation`:string>>"
TRAIN_TIMES = "`owl:sameAs` string, `odpt:train` string, `odpt:railway` string, `odpt:calendar` string, `odpt:railDirection` string, `odpt:trainType` string, `odpt:trainNumber` string, `odpt:originStation` array<string>, `odpt:destinationStation` array<string>, `odpt:trainTimetableObject` array<struct<`odpt:departureStation`:string,`odpt:arrivalStation`:string,`odpt:arrivalTime`:string,`odpt:departureTime`:string>>"
FURTHER_STATION = "id string, coord array<double>, railway string, title struct<ja:string,en:string>"
FURTHER_TRIP = "id string, r string, t string, d string, y string, n string, os array<string>, ds array<string>, tt array<struct<s:string,a:string,d:string>>"
#: Metro lines by GTFS route id and by first letter of a stop code; calendars and directions.
LINES = {"1": "Ginza", "2": "Marunouchi", "3": "Hibiya", "4": "Tozai", "5": "Chiyoda", "6": "Yurakucho", "7": "Hanzomon", "8": "Namboku", "9": "Fukutoshin"}
LETTERS = {"G": "Ginza", "M": "Marunouchi", "H": "Hibiya", "T": "Tozai", "C": "Chiyoda", "Y": "Yurakucho", "Z": "Hanzomon", "N": "Namboku", "F": "Fukutoshin"}
CALENDARS, DIRECTIONS = {"0": "Weekday", "1": "SaturdayHoliday"}, {"0": "Outbound", "1": "Inbound"}
#: Operators that other importers bring in, as ids and as file names begin.
ELSEWHERE, ELSEWHERE_FILES = ("Toei.", "TokyoMetro."), "^(toei|tokyometro)-"


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def english(x: Column, default: str) -> Column:
    """The en entry of a title object; the default if it is no object or has none."""
    return F.coalesce(F.get_json_object(x, "$.en"), F.lit(default))


def located(df: DataFrame) -> DataFrame:
    """Without rows that lack coordinates; with geom."""
    return df.where("latitude is not null and longitude is not null").withColumn("geom", S.point(F.col("longitude"), F.col("latitude")))


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Without rows that have a null or empty key."""
    for k in keys:
        df = df.where(F.coalesce(F.col(k), F.lit("")) != "")
    return df


def bus_stops(spark, path: str) -> DataFrame:
    df = json_array(spark, path, BUS_STOP)
    df = df.select(
        S.last_two(c("owl:sameAs")).alias("busstop_id"), F.coalesce(c("dc:title"), F.lit("")).alias("name_ja"), english(F.col("title"), "Unknown").alias("name_en"), c("odpt:kana").alias("name_kana"),
        c("geo:lat").alias("latitude"), c("geo:long").alias("longitude"), S.strip_prefix(text_or_first(c("odpt:operator"))).alias("operator"), c("odpt:busstopPoleNumber").alias("busstop_pole_number"),
        S.patterns(F.coalesce(c("odpt:busroutePattern"), F.array().cast("array<string>"))).alias("busroute_pattern"), "_pos",
    )
    return first_wins(located(df), "busstop_id", "_pos").drop("_pos")


def routes_read(spark, path: str) -> DataFrame:
    df = json_array(spark, path, BUS_ROUTE).withColumn("pattern", c("odpt:pattern")).withColumn("direction", c("odpt:direction"))
    return keyed(df, "pattern").withColumn("route_id", S.route_id(F.col("pattern"), F.col("direction")))


def bus_routes(spark, path: str) -> DataFrame:
    """Of rows with one id the first, with the geometry of the last, null or not."""
    df = routes_read(spark, path)
    first = F.min_by(F.struct(F.coalesce(c("dc:title"), F.lit("")).alias("title"), S.strip_prefix(text_or_first(c("odpt:operator"))).alias("operator"), "direction"), "_pos").alias("f")
    return df.groupBy("route_id").agg(first, F.max_by(S.line_wkt(c("ug:region")["coordinates"]), "_pos").alias("geom")).select("route_id", "f.*", "geom")


def bus_route_stops(spark, path: str) -> DataFrame:
    df = routes_read(spark, path).select("route_id", F.inline(c("odpt:busstopPoleOrder")))
    return df.select("route_id", S.last_two(c("odpt:busstopPole")).alias("busstop_id"), c("odpt:index").alias("stop_order"))


def bus_timetable(spark, path: str, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Times of known routes at known stops; of a timetable's rows at one stop the first."""
    df = json_array(spark, path, BUS_TIMES)
    df = keyed(df.select(S.strip_prefix(c("owl:sameAs")).alias("timetable_id"), S.last_two_stripped(c("odpt:busroutePattern")).alias("route_id"), "_pos", F.posexplode(c("odpt:busTimetableObject")).alias("_k", "o")), "timetable_id")
    df = df.select("timetable_id", "route_id", S.last_two_stripped(F.col("o.`odpt:busstopPole`")).alias("busstop_id"), F.col("o.`odpt:index`").alias("stop_order"), S.clock_seconds(F.col("o.`odpt:arrivalTime`")).alias("arr_s"), S.clock_seconds(F.col("o.`odpt:departureTime`")).alias("dep_s"), F.struct("_pos", "_k").alias("_pos"))
    return first_wins(only_known(df, (routes, "route_id"), (stops, "busstop_id")), ["timetable_id", "busstop_id"], "_pos").drop("_pos")


def stations_read(spark, path: str) -> DataFrame:
    df = json_array(spark, path, STATION)
    return df.withColumn("railway_id", S.strip_prefix(c("odpt:railway")))


def railway_lines(spark, path: str) -> DataFrame:
    """Distinct lines of the stations, the first operator of each."""
    df = keyed(stations_read(spark, path), "railway_id")
    return df.groupBy("railway_id").agg(F.min_by(S.strip_prefix(text_or_first(c("odpt:operator"))), "_pos").alias("operator"))


def railway_stations(spark, path: str) -> DataFrame:
    df = stations_read(spark, path).select(
        S.strip_prefix(c("owl:sameAs")).alias("station_id"), c("odpt:stationCode").alias("station_code"), F.coalesce(c("dc:title"), F.lit("")).alias("name_ja"), english(c("odpt:stationTitle"), "").alias("name_en"),
        c("geo:lat").alias("latitude"), c("geo:long").alias("longitude"), "railway_id", "_pos",
    )
    return first_wins(located(df), "station_id", "_pos").drop("_pos")


def station_timetable(spark, path: str) -> DataFrame:
    df = json_array(spark, path, STATION_TIMES)
    head = [S.strip_prefix(c("odpt:station")).alias("station_id"), S.strip_prefix(c("odpt:calendar")).alias("calendar"), S.strip_prefix(c("odpt:railDirection")).alias("rail_direction")]
    df = df.select(*head, F.inline(c("odpt:stationTimetableObject")))
    return df.select("station_id", "calendar", "rail_direction", c("odpt:trainNumber").alias("train_number"), S.strip_prefix(c("odpt:trainType")).alias("train_type"), S.clock_seconds(c("odpt:departureTime")).alias("dep_s"), S.strip_prefix(text_or_first(c("odpt:destinationStation"))).alias("destination_station"))


HEADER = ["timetable_id", "train_id", "railway_id", "calendar", "rail_direction", "train_type", "train_number", "origin_station", "destination_station"]


def train_timetable(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers, and stops (timetable_id, stop_order from 0, station_id, arr_s, dep_s)."""
    df = json_array(spark, path, TRAIN_TIMES)
    strip = lambda n: S.strip_prefix(c(n))
    df = keyed(df.withColumn("timetable_id", strip("owl:sameAs")), "timetable_id")
    first = lambda n: S.strip_prefix(S.first_of(c(n)))
    cols = [strip("odpt:train"), strip("odpt:railway"), strip("odpt:calendar"), strip("odpt:railDirection"), strip("odpt:trainType"), c("odpt:trainNumber"), first("odpt:originStation"), first("odpt:destinationStation")]
    heads = df.select("timetable_id", *(x.alias(n) for x, n in zip(cols, HEADER[1:])), "_pos")
    stops = first_wins(df, "timetable_id", "_pos").select("timetable_id", F.posexplode(c("odpt:trainTimetableObject")).alias("stop_order", "o"))
    at = S.strip_prefix(F.coalesce(F.nullif(F.col("o.`odpt:departureStation`"), F.lit("")), F.col("o.`odpt:arrivalStation`")))
    stops = stops.select("timetable_id", "stop_order", at.alias("station_id"), S.clock_seconds(F.col("o.`odpt:arrivalTime`")).alias("arr_s"), S.clock_seconds(F.col("o.`odpt:departureTime`")).alias("dep_s"))
    return first_wins(heads, "timetable_id", "_pos").select(*HEADER), stops


def metro(spark, folder: str, operator: str = "TokyoMetro") -> dict[str, DataFrame]:
    """lines, stations, headers and stops of a GTFS folder; unmapped routes and stops are left out, stop orders keep their gaps."""
    routes = gtfs(spark, folder, "routes", ["route_id"]).withColumn("line", S.of_map(LINES, F.col("route_id"))).where("line is not null")
    routes = routes.withColumn("railway_id", F.concat(F.lit(operator + "."), "line"))
    stops = gtfs(spark, folder, "stops", ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon"])
    stops = stops.withColumn("line", S.of_map(LETTERS, F.upper(F.left("stop_code", F.lit(1))))).where("line is not null")
    stops = stops.withColumn("railway_id", F.concat(F.lit(operator + "."), "line")).withColumn("station_id", F.concat_ws(".", "railway_id", "stop_code"))
    names = gtfs(spark, folder, "translations", ["table_name", "language", "field_value", "translation"], optional=True).where("table_name = 'stops' and language = 'en'")
    names = names.groupBy(F.col("field_value").alias("stop_name")).agg(F.max_by("translation", "_pos").alias("name_en"))
    stations = stops.join(names, "stop_name", "left").select("station_id", F.col("stop_code").alias("station_code"), F.col("stop_name").alias("name_ja"), F.coalesce("name_en", F.lit("")).alias("name_en"), F.col("stop_lat").try_cast("double").alias("latitude"), F.col("stop_lon").try_cast("double").alias("longitude"), "railway_id", "_pos")
    trips = gtfs(spark, folder, "trips", ["trip_id", "route_id", "service_id", "direction_id"]).join(routes.select("route_id", "railway_id"), "route_id")
    times = gtfs(spark, folder, "stop_times", ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"])
    # Ordinals before unknown stops go; ends of a trip by the same order.
    order = F.struct(F.col("stop_sequence").try_cast("int"), "_pos")
    times = times.withColumn("stop_order", F.row_number().over(Window.partitionBy("trip_id").orderBy(order)) - 1).join(stops.select("stop_id", "station_id"), "stop_id", "left")
    ends = times.groupBy("trip_id").agg(F.min_by("station_id", "stop_order").alias("origin_station"), F.max_by("station_id", "stop_order").alias("destination_station"))
    name = F.concat(F.lit(operator + "."), "trip_id")
    heads = first_wins(trips, "trip_id", "_pos").join(ends, "trip_id").select(
        name.alias("timetable_id"), F.col("trip_id").alias("train_id"), "railway_id", F.coalesce(S.of_map(CALENDARS, F.col("service_id")), F.lit("Weekday")).alias("calendar"), F.coalesce(S.of_map(DIRECTIONS, F.col("direction_id")), F.lit("Outbound")).alias("rail_direction"),
        F.lit(operator + ".Local").alias("train_type"), F.col("trip_id").alias("train_number"), "origin_station", "destination_station",
    )
    rows = times.where("station_id is not null").join(trips.select("trip_id").distinct(), "trip_id", "left_semi")
    rows = rows.select(name.alias("timetable_id"), "stop_order", "station_id", S.clock_seconds(F.col("arrival_time")).alias("arr_s"), S.clock_seconds(F.col("departure_time")).alias("dep_s"))
    lines = routes.select("railway_id", F.lit(operator).alias("operator")).distinct()
    return {"lines": lines, "stations": first_wins(located(stations), "station_id", "_pos").drop("_pos"), "headers": heads, "stops": rows}


def imported_elsewhere(x: Column) -> Column:
    return F.coalesce(F.startswith(x, F.lit(ELSEWHERE[0])) | F.startswith(x, F.lit(ELSEWHERE[1])), F.lit(False))


def trip_calendar(trip_id: Column) -> Column:
    """The fourth dot segment if it is a calendar and no numbered variant follows; else null."""
    part = lambda i: F.try_element_at(F.split(trip_id, r"\."), F.lit(i))
    return F.when(part(4).isin("Weekday", "SaturdayHoliday") & ~F.coalesce(part(5).rlike(r"^\d+$"), F.lit(False)), part(4))


def further_trains(spark, railways: str, stations: str, folder: str) -> dict[str, DataFrame]:
    """lines, stations, headers and stops of the operators that the other importers leave."""
    lines = json_array(spark, railways, "id string").where(~imported_elsewhere(F.col("id")))
    lines = lines.select(F.col("id").alias("railway_id"), S.first_segment(F.col("id")).alias("operator")).distinct()
    at = json_array(spark, stations, FURTHER_STATION).where(~imported_elsewhere(F.col("id"))).withColumnRenamed("railway", "railway_id")
    at = only_known(at, (lines, "railway_id")).select(
        F.col("id").alias("station_id"), F.lit(None).cast("string").alias("station_code"), F.coalesce("title.ja", F.lit("")).alias("name_ja"), F.coalesce("title.en", F.lit("")).alias("name_en"),
        F.get("coord", F.lit(1)).alias("latitude"), F.get("coord", F.lit(0)).alias("longitude"), "railway_id", "_pos",
    )
    at = first_wins(located(at), "station_id", "_pos").drop("_pos")
    trips = json_folder(spark, folder, FURTHER_TRIP, ELSEWHERE_FILES).withColumn("calendar", trip_calendar(F.col("id"))).where("calendar is not null").where(~imported_elsewhere(F.col("r")))
    trips = first_wins(trips, "id", "_pos")
    heads = trips.select(F.col("id").alias("timetable_id"), F.col("t").alias("train_id"), F.col("r").alias("railway_id"), "calendar", F.col("d").alias("rail_direction"), F.col("y").alias("train_type"), F.col("n").alias("train_number"), S.first_of(F.col("os")).alias("origin_station"), S.first_of(F.col("ds")).alias("destination_station"))
    rows = trips.select(F.col("id").alias("timetable_id"), F.posexplode("tt").alias("stop_order", "o")).select("timetable_id", "stop_order", F.col("o.s").alias("station_id"), S.clock_seconds(F.col("o.a")).alias("arr_s"), S.clock_seconds(F.col("o.d")).alias("dep_s"))
    return {"lines": lines, "stations": at, "headers": heads, "stops": only_known(rows, (at, "station_id"))}
