"""Queries over the driver's tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import scalars as S
from ..operators import listings as L, network as N, reach as R, shapes as P, spatial as G, tables as T, walk as W
from ..streaming import events as V

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def stops(spark, d):
    return t(spark, d, "supplier").selectExpr("s_suppkey as id", "35.5D + (s_suppkey * 7919 % 3500) / 10000D as lat", "139.4D + (s_suppkey * 104729 % 5500) / 10000D as lon")


def stop_times(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return li.withColumn("seq", seq).selectExpr("l_orderkey as trip_id", "seq", "l_suppkey as stop_id", "(l_orderkey * 37 % 1080 + 300) * 60 + seq * 420 as t")


STOPS = "stops as (select s_suppkey as id, 35.5::double + (s_suppkey * 7919 % 3500) / 10000::double as lat, 139.4::double + (s_suppkey * 104729 % 5500) / 10000::double as lon from supplier)"
TIMES = "st as (select l_orderkey as trip_id, seq, l_suppkey as stop_id, (l_orderkey * 37 % 1080 + 300) * 60 + seq * 420 as t from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as seq from lineitem))"
DIST = f"sqrt(((b.lat - a.lat) * {S.LAT_M}::double) * ((b.lat - a.lat) * {S.LAT_M}::double) + ((b.lon - a.lon) * {S.LON_M!r}::double) * ((b.lon - a.lon) * {S.LON_M!r}::double))"
WALKS = f"walks as (select a.id as src, b.id as dst, cast(floor({DIST} / (5000 / 3600::double)) as bigint) as walk_s from stops a join stops b on a.id <> b.id and {DIST} <= 3000)"
HOPS = "hops as (select a.stop_id as src, a.t as dep, b.stop_id as dst, b.t as arr from st a join st b on a.trip_id = b.trip_id and b.seq > a.seq)"
REACH = f"with recursive {STOPS}, {TIMES}, {WALKS}, {HOPS}, r(stop_id, arr) as (select 7::bigint, 30600::bigint union select * from (select h.dst, h.arr from r join hops h on h.src = r.stop_id and h.dep >= r.arr and h.arr <= 34200 union all select w.dst, r.arr + w.walk_s from r join walks w on w.src = r.stop_id and r.arr + w.walk_s <= 34200) z), best as (select stop_id, min(arr) as arr from r group by 1)"


def walks(spark, d):
    s = stops(spark, d)
    return G.within(s, s, 3000.0).where("src <> dst").select("src", "dst", F.floor(S.walk_seconds(F.col("dist"))).alias("walk_s"))


def reached(spark, d):
    start = spark.range(1).selectExpr("7L as origin_id", "7L as stop_id", "30600L as arr")
    return R.earliest_arrival(stop_times(spark, d), walks(spark, d), start, 34200)


@query(f"with {STOPS} select id, cast(round(lat * 10000) as bigint) as lat4, cast(round(lon * 10000) as bigint) as lon4 from stops")
def stops_projection(spark, d):
    return stops(spark, d).selectExpr("id", "cast(round(lat * 10000) as bigint) as lat4", "cast(round(lon * 10000) as bigint) as lon4")


@query(f"with {TIMES} select trip_id, cast(seq as int) as seq, stop_id, t from st")
def trip_sequences(spark, d):
    return stop_times(spark, d)


@query(f"with {TIMES} select trip_id, arg_min(stop_id, seq) as origin, arg_max(stop_id, seq) as destination, count(*) as n from st group by 1")
def trip_origin_destination(spark, d):
    return stop_times(spark, d).groupBy("trip_id").agg(F.min_by("stop_id", "seq").alias("origin"), F.max_by("stop_id", "seq").alias("destination"), F.count("*").alias("n"))


@query(f"with {TIMES} select stop_id, count(*) as departures, min(t) as first_dep, max(t) as last_dep from st group by 1")
def departure_index(spark, d):
    return stop_times(spark, d).groupBy("stop_id").agg(F.count("*").alias("departures"), F.min("t").alias("first_dep"), F.max("t").alias("last_dep"))


@query(f"with {TIMES}, q as (select s_suppkey as stop_id, 28800 + s_suppkey % 7 * 3600 as at from supplier) select q.stop_id, q.at, min(t) as dep from q join st on st.stop_id = q.stop_id and t >= q.at group by all")
def first_departure_lookup(spark, d):
    q = t(spark, d, "supplier").selectExpr("s_suppkey as stop_id", "28800 + s_suppkey % 7 * 3600 as at")
    deps = R.departures(stop_times(spark, d))
    return R.next_departures(q.withColumnRenamed("at", "arr"), deps, 86400 * 2).groupBy("stop_id", F.col("arr").alias("at")).agg(F.min("dep").alias("dep"))


#: Times that fall, null arrivals and departures, and trips that come to a stop again.
ODD = "od as (select trip_id, seq, stop_id % 9 as stop_id, case when (trip_id + seq) % 11 > 0 then t - (trip_id + seq) % 3 * 500 end as arr_s, case when (trip_id + seq) % 13 > 0 then t - (trip_id + seq) % 3 * 500 + 30 end as dep_s from st)"


def odd_times(spark, d):
    t = "t - (trip_id + seq) % 3 * 500"
    return stop_times(spark, d).selectExpr("trip_id", "seq", "stop_id % 9 as stop_id", f"case when (trip_id + seq) % 11 > 0 then {t} end as arr_s", f"case when (trip_id + seq) % 13 > 0 then {t} + 30 end as dep_s")


@query(f"with {TIMES}, {ODD}, b as (select distinct trip_id, stop_id as src, min(seq) over (partition by trip_id, stop_id) as s0, dep_s as dep from od), c as (select * from b where dep is not null), j as (select c.*, od.seq, od.stop_id as dst, coalesce(od.arr_s, od.dep_s) as arr from c join od on od.trip_id = c.trip_id and od.seq > c.s0 where coalesce(od.arr_s, od.dep_s) is not null), w as (select *, greatest(dep, coalesce(max(arr) over (partition by trip_id, src, s0, dep order by seq rows between unbounded preceding and 1 preceding), dep)) as top from j) select src, dst, count(*) as rides, min(arr - dep) as shortest, cast(sum(arr) as bigint) as arrivals from w where arr >= top group by all")
def ride_propagation(spark, d):
    return R.rides(odd_times(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("rides"), F.min(F.col("arr") - F.col("dep")).alias("shortest"), F.sum("arr").alias("arrivals"))


@query(f"with {STOPS}, {WALKS} select * from walks")
def walk_edges_grid(spark, d):
    return walks(spark, d)


@query(f"with {STOPS}, c as (select c_custkey as id, 35.5::double + (c_custkey * 6967 % 3500) / 10000::double as lat, 139.4::double + (c_custkey * 7351 % 5500) / 10000::double as lon from customer) select src, dst from (select a.id as src, b.id as dst, row_number() over (partition by a.id order by {DIST}, b.id) as n from c a, stops b) where n = 1")
def nearest_snap(spark, d):
    c = t(spark, d, "customer").selectExpr("c_custkey as id", "35.5D + (c_custkey * 6967 % 3500) / 10000D as lat", "139.4D + (c_custkey * 7351 % 5500) / 10000D as lon")
    return G.nearest(c, stops(spark, d), 4000.0).select("src", "dst")


@query(f"{REACH} select stop_id, arr from best")
def earliest_arrival(spark, d):
    return reached(spark, d).select("stop_id", "arr")


@query(f"{REACH} select band::int as band, count(*) filter (arr <= 30600 + band * 60) as stops from best, range(10, 61, 10) b(band) group by 1")
def band_counts(spark, d):
    return reached(spark, d).withColumn("band", F.explode(F.sequence(F.lit(10), F.lit(60), F.lit(10)))).groupBy("band").agg(F.count_if(F.expr("arr <= 30600 + band * 60")).alias("stops"))


EDGES = "e as (select u, v, min(l) as length from (select least(l_suppkey, l_partkey % 90 + 1) as u, greatest(l_suppkey, l_partkey % 90 + 1) as v, l_linenumber * 10 + l_orderkey % 7 as l from lineitem where l_suppkey <> l_partkey % 90 + 1) group by all)"
BOTH = "b2 as (select u, v, length from e union all select v, u, length from e)"
SSSP = f"with recursive {EDGES}, {BOTH}, w(source, node, dist) as (select n, n, 0::bigint from (values (1::bigint), (5), (9)) x(n) union select w.source, b2.v, w.dist + b2.length from w join b2 on w.node = b2.u where w.dist + b2.length <= 40), dd as (select source, node, min(dist) as dist from w group by all)"


def edges(spark, d):
    li = t(spark, d, "lineitem").selectExpr("l_suppkey as a", "l_partkey % 90 + 1 as b", "l_linenumber * 10 + l_orderkey % 7 as l").where("a <> b")
    return li.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("l").alias("length"))


def distances(spark, d):
    e = edges(spark, d)
    e = R.cut(e.unionByName(e.selectExpr("v as u", "u as v", "length")))
    return R.bounded_sssp(e, spark.createDataFrame([(1,), (5,), (9,)], "source long"), 40)


@query(f"with {EDGES} select * from e")
def undirected_edges(spark, d):
    return edges(spark, d)


@query(f"{SSSP} select * from dd")
def bounded_sssp(spark, d):
    return distances(spark, d)


@query(f"{SSSP} select distinct band::int as band, e.u, e.v from e join dd i on i.node = e.u join dd j on j.node = e.v and j.source = i.source, (values (15), (30), (40)) x(band) where greatest(i.dist, j.dist) <= band")
def edge_marking(spark, d):
    return R.band_edges(edges(spark, d), distances(spark, d), [15, 30, 40])


undirected_edges_whole, bounded_sssp_whole, edge_marking_whole = undirected_edges, bounded_sssp, edge_marking


@query(f"with {TIMES}, m as (select * from st where trip_id not in (select o_orderkey from orders where o_orderstatus = 'F')) select trip_id, 'synth_' || trip_id as synth_id, count(*) as n, min(t) as first_t, max(t) as last_t from m group by trip_id having count(*) >= 2")
def missing_lines_synthesis(spark, d):
    m = stop_times(spark, d).join(t(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as trip_id"), "trip_id", "left_anti")
    return m.groupBy("trip_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).where("n >= 2").withColumn("synth_id", F.concat(F.lit("synth_"), F.col("trip_id").cast("string")))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') and l_partkey in (select p_partkey from part where p_size < 10)")
def semi_filtered_load(spark, d):
    o, p = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey as l_orderkey"), t(spark, d, "part").where("p_size < 10").selectExpr("p_partkey as l_partkey")
    return T.only_known(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), (o, "l_orderkey"), (p, "l_partkey"))


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
def first_wins_insert(spark, d):
    return T.first_wins(t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("select o_custkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus, arg_max(o_orderpriority, o_orderkey) as o_orderpriority from orders group by 1")
def last_wins_upsert(spark, d):
    return T.upsert_last(t(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus"], ["o_orderpriority"])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def anti_existing(spark, d):
    return t(spark, d, "customer").select("c_custkey").join(t(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey as c_custkey"), "c_custkey", "left_anti")


@query("select p_partkey, p_brand || '.' || p_size || '.' || p_partkey as stripped, p_size || '.' || p_partkey as last_two, p_brand || '.None' as route from part")
def id_cleaning(spark, d):
    p = t(spark, d, "part").withColumn("raw", F.expr("concat('odpt.Stop:', p_brand, '.', p_size, '.', p_partkey)"))
    return p.select("p_partkey", S.strip_prefix(F.col("raw")).alias("stripped"), S.last_two(F.col("raw")).alias("last_two"), S.route_id(F.col("p_brand"), F.lit(None).cast("string")).alias("route"))


@query("select o_orderkey, cast((o_orderkey % 28 % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 as int) as seconds from orders")
def time_normalise(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.clock_seconds(F.expr("concat(o_orderkey % 28, ':', lpad(o_orderkey % 60, 2, '0'), ':', lpad(o_orderkey % 59, 2, '0'))")).alias("seconds"))


@query("select o_orderkey, case when isodow(o_orderdate) < 6 then 'Weekday' else 'SaturdayHoliday' end as calendar from orders")
def calendar_infer(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.calendar(F.col("o_orderdate")).alias("calendar"))


@query("select p_partkey, p_size * 10000 + p_partkey as price, (p_size || '.5')::double as area, p_partkey * 100 as fee, cast(1950 + p_size as int) as year, 'S' || p_size as station, cast(p_size % 20 as int) as walk_min from part")
def listing_fields(spark, d):
    p = t(spark, d, "part")
    access = S.station_access(F.expr("concat('Line「S', p_size, '」徒歩', p_size % 20, '分')"))
    return p.select("p_partkey", S.price_man(F.expr("concat(p_size, '億', p_partkey, '万円')")).alias("price"), S.area_m2(F.expr("concat(p_size, '.5m2（壁芯）')")).alias("area"), S.monthly_fee(F.expr("concat(p_partkey * 100, '円/月')")).alias("fee"), S.building_year(F.expr("concat(1950 + p_size, '年8月')")).alias("year"), access[0]["station"].alias("station"), access[0]["walk_min"].alias("walk_min"))


@query("select content_hash, min(doc_id) as doc_id, count(*) as n from (select sha256(coalesce(lang, '') || '|' || coalesce(text, '')) as content_hash, doc_id from documents) group by 1")
def content_hash_dedup(spark, d):
    return t(spark, d, "documents").select(S.content_hash(F.col("lang"), F.col("text")).alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as links, coalesce(try_cast(regexp_extract(url, '[?&]page=([0-9]+)', 1) as int), 1) as page from pages")
def page_extract(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.coalesce(F.regexp_extract("url", "[?&]page=([0-9]+)", 1).try_cast("int"), F.lit(1)).alias("page"))


@query("with s as (select cast(date_trunc('month', o_orderdate) as date) as m, o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as v from orders where o_orderdate is not null group by all), c as (select m, row_number() over (order by m)::int as cycle from (select distinct m from s)), k as (select cycle, o_custkey, v from s join c using (m)), o as (select cycle + 1 as cycle, o_custkey, v from k where cycle < (select max(cycle) from c)) select coalesce(o.cycle, k.cycle) as cycle, coalesce(o.o_custkey, k.o_custkey) as o_custkey, o.v as old_value, k.v as new_value, case when o.v is null then 'new' when k.v is null then 'delisted' when o.v <> k.v then 'updated' else 'same' end as state from o full join k on o.cycle = k.cycle and o.o_custkey = k.o_custkey")
def listing_upsert(spark, d):
    s = t(spark, d, "orders").where("o_orderdate is not null").groupBy(F.trunc("o_orderdate", "month").alias("m"), "o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v"))
    # Months are few; one task may number them.
    k = s.join(F.broadcast(s.select("m").distinct().withColumn("cycle", F.row_number().over(Window.orderBy("m")))), "m").drop("m")
    last = k.agg(F.max("cycle").alias("last"))
    old = k.join(F.broadcast(last), F.col("cycle") < F.col("last")).drop("last").withColumn("cycle", F.col("cycle") + 1)
    return T.snapshot_delta(old, k, ["cycle", "o_custkey"], "v")


listing_upsert_cycles = listing_upsert


@query("select * from (select o_custkey, o_orderkey, o_orderpriority, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from orders) where previous <> o_orderpriority")
def price_history(spark, d):
    return T.changes(t(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority").select("o_custkey", "o_orderkey", "o_orderpriority", "previous")


@query("select o_orderpriority, count(*) as active, count(*) filter (o_orderstatus = 'F') as found, count(*) filter (o_orderstatus = 'F') < count(*) * 0.5 as suspicious from orders group by 1")
def safety_ratio(spark, d):
    o = t(spark, d, "orders")
    return T.safety(o.where("o_orderstatus = 'F'"), o, "o_orderpriority")


@query("select o_orderdate, count(*) as n, count(*) filter (o_orderstatus = 'F') as done from orders group by 1 order by 1 desc limit 5")
def status_report(spark, d):
    return t(spark, d, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("done")).orderBy(F.desc("o_orderdate")).limit(5)


@query("select n_name, kind from nation, (values ('mansion'), ('kodate')) x(kind) where (n_nationkey, kind) not in (select n_nationkey, 'kodate' from nation where n_nationkey % 2 = 0)")
def query_matrix_resume(spark, d):
    m = t(spark, d, "nation").withColumn("kind", F.explode(F.array(F.lit("mansion"), F.lit("kodate"))))
    done = t(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("kodate").alias("kind"))
    return m.join(done, ["n_nationkey", "kind"], "left_anti").select("n_name", "kind")


@query("select event_type, count(*) as n, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by 1")
def json_explode(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k"))


@query(f"with {STOPS} select distinct cast(floor(lon / 0.01) as bigint) + i as cx, cast(floor(lat / 0.01) as bigint) + j as cy from stops, range(-1, 2) a(i), range(-1, 2) b(j)")
def raster_union(spark, d):
    return G.ring(stops(spark, d), 0.01).select("cx", "cy").distinct()


# Network loading, walks and shapes.
STATIONS = "sta as (select s_suppkey as station_id, cast(s_suppkey % 7 as varchar) as railway_id from supplier), tt as (select stop_id as station_id, case when trip_id % 3 = 0 then 'SaturdayHoliday' else 'Weekday' end as calendar, cast(seq % 2 as varchar) as rail_direction, cast(trip_id % 500 as varchar) as train_number, case when seq % 5 > 0 then t end as dep_s from st)"


@query(f"with {TIMES}, {STATIONS}, g as (select 'synth_' || railway_id || '_' || rail_direction || '_' || train_number as trip_id, station_id as stop_id, dep_s from tt join sta using (station_id) where calendar = 'Weekday' and dep_s is not null and railway_id not in ('0', '1', '2')), n as (select *, row_number() over (partition by trip_id order by dep_s, stop_id) - 1 as seq, count(*) over (partition by trip_id) as n from g) select trip_id, count(*) as n, min(dep_s) as first_t, max(dep_s) as last_t, cast(sum(seq * dep_s) as bigint) as in_order from n where n >= 2 group by 1")
def trip_synthesis(spark, d):
    stations = t(spark, d, "supplier").selectExpr("s_suppkey as station_id", "cast(s_suppkey % 7 as string) as railway_id")
    times = stop_times(spark, d).selectExpr("stop_id as station_id", "case when trip_id % 3 = 0 then 'SaturdayHoliday' else 'Weekday' end as calendar", "cast(seq % 2 as string) as rail_direction", "cast(trip_id % 500 as string) as train_number", "case when seq % 5 > 0 then t end as dep_s")
    heads = spark.createDataFrame([("0", "Weekday"), ("1", "Weekday"), ("2", "Weekday"), ("3", "SaturdayHoliday")], "railway_id string, calendar string")
    return N.synthesised(stations, times, heads, "Weekday").groupBy("trip_id").agg(F.count("*").alias("n"), F.min("dep_s").alias("first_t"), F.max("dep_s").alias("last_t"), F.sum(F.col("seq") * F.col("dep_s")).alias("in_order"))


@query(f"with {STOPS}, bus as (select c_custkey * 3 as id, c_acctbal as lat, 'bus' as kind from customer) select id, lat, 'rail' as kind from stops where id not in (select id from bus) union all select * from bus")
def stops_override(spark, d):
    rail = stops(spark, d).selectExpr("id", "lat", "'rail' as kind")
    return N.overriding(rail, t(spark, d, "customer").selectExpr("c_custkey * 3 as id", "c_acctbal as lat", "'bus' as kind"), "id")


@query(f"with {TIMES}, {ODD} select stop_id, dep_s, trip_id from od where dep_s is not null")
def departures_sorted(spark, d):
    return N.departure_index(odd_times(spark, d))


@query(f"with {STOPS} select a.id as src, b.id as dst from stops a join stops b on a.id <> b.id and abs(cast(trunc(a.lon / 0.005::double) as bigint) - cast(trunc(b.lon / 0.005::double) as bigint)) <= 1 and abs(cast(trunc(a.lat / 0.005::double) as bigint) - cast(trunc(b.lat / 0.005::double) as bigint)) <= 1 and {DIST} <= 800")
def walk_edges_coarse(spark, d):
    s = stops(spark, d)
    return G.within_coarse(s, s, 800.0).where("src <> dst").select("src", "dst")


@query(f"with {STOPS} select id as stop_id, 30600 + cast(floor(sqrt(pow((lat - 35.7::double) * {S.LAT_M}::double, 2) + pow((lon - 139.7::double) * {S.LON_M!r}::double, 2)) / (5000 / 3600::double)) as bigint) as arr from stops where sqrt(pow((lat - 35.7::double) * {S.LAT_M}::double, 2) + pow((lon - 139.7::double) * {S.LON_M!r}::double, 2)) <= 9000")
def access_stops(spark, d):
    origin = spark.createDataFrame([(1, 35.7, 139.7)], "id int, lat double, lon double")
    return R.access(origin, stops(spark, d), 30600, 9000.0).select("stop_id", F.floor("arr").alias("arr"))


REACH60 = SSSP.replace("<= 40", "<= 60")


@query(f"{REACH60}, s as (select * from (values (1::bigint, 0, true), (5, 5, false), (9, 10, false)) x(node, arr, own)), b as (select * from (values (30), (45), (60)) x(band)) select distinct band, e.u, e.v from e join dd i on i.node = e.u join dd j on j.node = e.v and j.source = i.source join s on s.node = i.source, b where band - (case when own then 0 else arr end) >= 30 and greatest(i.dist, j.dist) <= band - (case when own then 0 else arr end)")
def egress_marking(spark, d):
    starts = spark.createDataFrame([("o", 1, 0.0, True), ("o", 5, 5.0, False), ("o", 9, 10.0, False)], "origin_id string, node long, arr double, is_origin boolean")
    return W.egress_bands(edges(spark, d), starts, 0, [30, 45, 60], 3.6).select("band", "u", "v")


@query(f"with recursive {EDGES}, {BOTH}, sn as (select s_suppkey as id, s_suppkey % 40 + 1 as node from supplier), w(source, node, dist) as (select distinct node, node, 0::bigint from sn union select w.source, b2.v, w.dist + b2.length from w join b2 on w.node = b2.u where w.dist + b2.length <= 20), dd as (select source, node, min(dist) as dist from w group by all) select a.id as src, b.id as dst, dist from dd join sn a on a.node = dd.source join sn b on b.node = dd.node where a.id <> b.id")
def walk_neighbours(spark, d):
    snaps = t(spark, d, "supplier").selectExpr("s_suppkey as id", "s_suppkey % 40 + 1 as node")
    return W.neighbours(W.both_ways(edges(spark, d)), snaps, 20, 3.6).select("src", "dst", F.round("walk_s").cast("long").alias("dist"))


@query(f"with {STOPS} select a.id, cast(round(2 * 6371009 * asin(sqrt(pow(sin(radians(35.7::double - lat) / 2), 2) + cos(radians(lat)) * cos(radians(35.7::double)) * pow(sin(radians(139.7::double - lon) / 2), 2)))) as bigint) as metres from stops a")
def great_circle(spark, d):
    return stops(spark, d).select("id", F.round(S.great_circle_m(F.col("lat"), F.col("lon"), F.lit(35.7), F.lit(139.7))).cast("long").alias("metres"))


@query(f"with {STOPS}, c as (select lat, lon, unnest(range(cast(floor((lon - 0.01::double) * {S.LON_M!r}::double / 200) as bigint), cast(floor((lon + 0.01::double) * {S.LON_M!r}::double / 200) as bigint) + 1)) as cx from stops), k as (select *, unnest(range(cast(floor((lat - 0.01::double) * {S.LAT_M}::double / 200) as bigint), cast(floor((lat + 0.01::double) * {S.LAT_M}::double / 200) as bigint) + 1)) as cy from c) select distinct cx, cy from k where ((cx + 0.5::double) * 200 / {S.LON_M!r}::double - lon) * ((cx + 0.5::double) * 200 / {S.LON_M!r}::double - lon) + ((cy + 0.5::double) * 200 / {S.LAT_M}::double - lat) * ((cy + 0.5::double) * 200 / {S.LAT_M}::double - lat) <= 0.01::double * 0.01::double")
def circle_cover(spark, d):
    rows = stops(spark, d).selectExpr("'o' as origin_id", "1 as band", "lon as x", "lat as y", "0.01D as r")
    return P.circle_cells(rows, 200.0).select("cx", "cy")


def isochrone_bands(spark, d):
    """Features of one stop's bands, by circles: no SQL; tests hold shapes against brute force."""
    s = stops(spark, d)
    net = N.Network(s.withColumn("kind", F.lit("rail")), stop_times(spark, d), R.cut(walks(spark, d)))
    return P.isochrones(net, s.where("id = 7"), 30600, [1200, 2400, 3600], max_walk_m=3000.0, cell_m=20.0)


QUERIES["isochrone_bands"] = isochrone_bands


# Listing texts and lifecycle.
@query("select p_partkey, p_size * 10000 + p_partkey as low_price, p_partkey * 125 // 10 as fee, '東京都' as prefecture, 'N' || p_size || '市' as city, 'T' || p_partkey as town, 'RC造' as structure, p_size as units, 2020 - (1950 + p_size) as age from part")
def listing_texts(spark, d):
    p = t(spark, d, "part")
    at = S.address_parts(F.expr("concat('東京都N', p_size, '市T', p_partkey)"), F.lit(13))
    return p.select("p_partkey", S.price_man(F.expr("concat('価格 ', p_size, '億 ', format_number(p_partkey, 0), '万円〜', p_size + 1, '億円')")).alias("low_price"), S.monthly_fee(F.expr("concat(cast(p_partkey * 125 as decimal(18, 0)) / 100000, '万円')")).alias("fee"), at["prefecture"].alias("prefecture"), at["city"].alias("city"), at["town"].alias("town"), S.structure(F.lit("RC造10階建")).alias("structure"), S.first_integer(F.expr("concat('全', p_size, '戸')")).alias("units"), S.building_age(F.expr("concat(1950 + p_size, '年8月')"), 2020).alias("age"))


@query("select p_partkey, sha256('A' || p_partkey || '|' || p_size || '|' || printf('%.1f', p_retailprice / 7) || '||mansion') as content_hash from part")
def listing_hash(spark, d):
    return t(spark, d, "part").select("p_partkey", S.listing_hash(F.expr("concat('A', p_partkey)"), F.col("p_size"), F.col("p_retailprice") / 7, F.lit(None).cast("string"), F.lit("mansion")).alias("content_hash"))


@query("select p_partkey, unnest(range(10, p_size + 1, 10))::int as band from part")
def band_series(spark, d):
    return t(spark, d, "part").select("p_partkey", F.explode(S.bands(F.lit(10), F.col("p_size"))).alias("band"))


@query("select c_custkey, c_custkey % 2 = 0 and c_custkey % 3 > 0 as seen, case when c_custkey % 2 = 0 and c_custkey % 3 > 0 then 'active' else 'delisted' end as status, case when c_custkey % 5 = 0 and c_custkey % 2 = 1 then 0 when c_custkey % 2 = 0 and c_custkey % 3 > 0 then -1 else 1 end as gone from customer")
def delist(spark, d):
    c = t(spark, d, "customer")
    old = "2020-01-01 00:00:00"
    snap = c.selectExpr("c_custkey", "cast(if(c_custkey % 2 = 0 and c_custkey % 3 > 0, 2, 1) as long) as crawl_cycle_id", "if(c_custkey % 5 = 0 and c_custkey % 2 = 1, 'delisted', 'active') as status", f"if(c_custkey % 5 = 0 and c_custkey % 2 = 1, timestamp'{old}', null) as delisted_at", "cast(null as timestamp) as updated_at")
    got = L.delist(snap, 2, "2021-01-01 00:00:00")
    return got.selectExpr("c_custkey", "crawl_cycle_id = 2 as seen", "status", f"case when delisted_at = timestamp'{old}' then 0 when delisted_at is not null then 1 else -1 end as gone")


@query("select c_custkey, case when c_custkey % 2 = 0 or c_custkey % 5 = 0 then c_mktsegment when c_custkey % 3 = 0 then 'filled' else c_mktsegment end as direction, case when c_custkey % 2 = 1 and c_custkey % 5 > 0 and c_custkey % 4 = 0 then 9 else c_custkey % 4 end as total_units, c_custkey % 5 > 0 as fetched from (select c_custkey, case when c_custkey % 3 = 0 then '' else c_mktsegment end as c_mktsegment from customer)")
def fill_if_missing(spark, d):
    c = t(spark, d, "customer").selectExpr("c_custkey", "if(c_custkey % 2 = 1, 'mansion', 'kodate') as listing_type", "concat('u', c_custkey) as url", "if(c_custkey % 3 = 0, '', c_mktsegment) as direction", "c_custkey % 4 as total_units", "1L as crawl_cycle_id", "cast(null as timestamp) as detail_fetched_at")
    details = c.where("c_custkey % 5 > 0").selectExpr("url", "'filled' as direction", "9L as total_units")
    got, _ = L.enrich(c, details, 1, "2021-01-01 00:00:00")
    return got.selectExpr("c_custkey", "direction", "total_units", "detail_fetched_at is not null as fetched")


@query("with a as (select distinct case when c_custkey % 50 = 0 then '' else 'A' || c_custkey % 50 end as address from customer) select address, case when address = '' then 'skip' when cast(substr(address, 2) as int) < 20 then 'cache' else 'api' end as source, case when address <> '' then cast(substr(address, 2) as double) end as latitude from a")
def geocode_cache(spark, d):
    a = t(spark, d, "customer").selectExpr("if(c_custkey % 50 = 0, null, concat('A', c_custkey % 50)) as address")
    known = spark.range(1, 20).selectExpr("concat('A', id) as address", "cast(id as double) as latitude", "0D as longitude", "current_timestamp() as created_at")
    got, _ = L.geocoded(a, known, lambda m: m.selectExpr("address", "cast(substr(address, 2) as double) as latitude", "0D as longitude"))
    return got.select("address", "source", "latitude")


@query("with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders), p as (select *, n // 3 as page from o) select o_custkey, o_orderkey from p where page * 3 < 7")
def page_caps(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey").withColumn("page", F.floor((F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) / 3))
    return L.page_caps(o, ["o_custkey"], max_items=7).select("o_custkey", "o_orderkey")


@query("with k as (select o_custkey, min(o_orderkey) as o_orderkey from orders where o_orderstatus = 'F' group by 1), n as (select o_custkey, min(o_orderkey) as o_orderkey from orders where o_orderstatus = 'O' group by 1) select * from k union all select * from n where o_custkey not in (select o_custkey from k)")
def insert_or_ignore(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    have = T.first_wins(o.where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey").drop("o_orderstatus")
    return T.insert_or_ignore(have, o.where("o_orderstatus = 'O'").drop("o_orderstatus"), "o_custkey", "o_orderkey")


@query("select event_type, count(*) as n, cast(sum(try_cast(json_extract_string(x, '$.k') as bigint)) as bigint) as k from (select event_type, unnest([props, '{\"k\": 1}', props]) as x from events) group by 1")
def json_arrays(spark, d):
    e = t(spark, d, "events").select("event_type", F.explode(F.from_json(F.concat(F.lit("["), F.coalesce("props", F.lit("{}")), F.lit(', {"k": 1}, '), F.coalesce("props", F.lit("{}")), F.lit("]")), "array<struct<k:bigint>>")).alias("x"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("x.k").alias("k"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, cast(round(sum(value) * 100) as bigint) as cents from events group by all")
def event_windows(spark, d):
    return V.counted(t(spark, d, "events")).select("start", "event_type", "n", F.round(F.col("total") * 100).cast("long").alias("cents"))
