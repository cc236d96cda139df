"""Scalars, pages, the listing lifecycle over several cycles, web sources, and the stream of cycles."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from reachlight.functions import html as H, scalars as S
from reachlight.operators import listings as L
from reachlight.operators.tables import changes, safety, snapshot_delta
from reachlight.sources import web
from reachlight.streaming import events, listings as stream

NOW = datetime.datetime(2025, 1, 1)


def each(spark, f, *xs, kind="string"):
    df = spark.createDataFrame(list(enumerate(xs)), f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_golden_values(spark):
    assert each(spark, S.strip_prefix, "odpt.Station:Toei.Mita.Nishitakashimadaira", "odpt.Operator:Toei", "Toei.Mita", None, "") == ["Toei.Mita.Nishitakashimadaira", "Toei", "Toei.Mita", None, ""]
    assert each(spark, S.last_two, "odpt.BusstopPole:Toei.Zoshiki.848.2", "odpt.BusroutePattern:Toei.Ou57.30902.2", "odpt.X:one", None) == ["848.2", "30902.2", "odpt.X:one", None]
    assert each(spark, S.last_two_stripped, "odpt.X:one", "a.b.c") == ["one", "b.c"]
    assert each(spark, S.clock_seconds, "24:08:00", "08:30", "x", None, "8") == [480, 30600, None, None, None]
    assert each(spark, S.price_man, "1280万円", "1億2000万円", "1億7120万円〜2億300万円", "価格 1,280万円", "1億 2000万円", "0万円", "", None) == [1280, 12000, 17120, 1280, 12000, None, None, None]
    assert each(spark, S.area_m2, "68.5m2（20.72坪）（壁芯）", "1.2.3m", "-", None) == [68.5, None, None, None]
    assert each(spark, S.building_year, "1986年8月", "2025年3月（築1年）", "x") == [1986, 2025, None]
    assert each(spark, lambda x: S.building_age(x, 2025), "1986年8月", "2025年3月（築1年）", "2025年9月新築", "x") == [39, 1, 0, None]
    got = each(spark, S.station_access, "ＪＲ青梅線「河辺」徒歩9分", "Ａ線「甲」徒歩1分/Ｂ線「乙」バス12分", "Ｃ線/丙駅 徒歩5分", "none")
    assert [[tuple(r) for r in x] for x in got] == [[("ＪＲ青梅線", "河辺", 9)], [("Ａ線", "甲", 1), ("Ｂ線", "乙", 12)], [("Ｃ線", "丙駅", 5)], []]
    assert each(spark, S.structure, "RC造10階建", "木造", "SRC", "x") == ["RC造", "木造", "SRC", None]
    assert each(spark, S.monthly_fee, "12,500円/月", "1.25万円", "800", "不要", "-", None) == [12500, 12500, 800, None, None, None]
    assert each(spark, S.first_integer, "150戸", "x") == [150, None]
    assert [tuple(r) for r in each(spark, lambda x: S.address_parts(x, F.lit(13)), "東京都青梅市河辺町1", "大阪府", "東京都どこか")] == [("東京都", "青梅市", "河辺町1"), ("", "", ""), ("東京都", "どこか", "")]
    assert each(spark, S.large_image, "https://h/resizeImage?src=a&w=96&h=72", "https://h/a?w=1") == ["https://h/resizeImage?src=a&w=640&h=480", "https://h/a?w=1"]
    assert each(spark, lambda x: S.caption(x, F.lit("Alt")), "Alt  text" + "y" * 300, "other", "") == [("text" + "y" * 300)[:200], "other", ""]
    assert each(spark, lambda x: S.bands(F.lit(10), x), 30, 9, kind="int") == [[10, 20, 30], []]


def test_hash(spark):
    rng = random.Random(1)
    areas = [68.35, 68.25, 0.25, 100.0, 7.06, 0.04, 0.05, 0.15, 1e6 + 0.05] + [rng.random() * 10 ** rng.randrange(4) for _ in range(300)]
    got = each(spark, lambda x: S.listing_hash(F.lit("a"), F.lit(5), x, F.lit(None), F.lit("m")), *areas, kind="double")
    assert got == [hashlib.sha256(f"a|5|{x:.1f}||m".encode()).hexdigest() for x in areas]
    assert each(spark, lambda x: S.listing_hash(F.lit(""), F.lit(0), x, F.lit("p"), F.lit("m")), 0.0, None, kind="double") == [hashlib.sha256(b"|||p|m").hexdigest()] * 2


UNIT = '<div class="property_unit x"><h2 class="property_unit-title"><a href="/ms/nc_{id}/"> T &amp; {id} </a></h2><div class="dottable--cassette"><dl><dt>販売価格<dd>{price}万円</dl><dl><dt>所在地</dt><dd>{at}</dd></dl><dl><dt>所在地</dt><dd>second</dd></dl><dl><dt>専有面積</dt><dd>68.5m2</dd></dl></div></div>'


def page(*units, last=""):
    return f'<html><body>{"".join(UNIT.format(id=i, price=p, at=a) for i, p, a in units)}<div class="property_unit"><h2 class="property_unit-title"><a href="/x">none</a></h2></div>{last}<br></body>'


def found(spark, *pages):
    rows = [(13, False, k, "success", p) for k, p in enumerate(pages, 1)]
    return spark.createDataFrame(rows, "prefecture int, is_new boolean, page int, status string, html string")


def listed(df):
    return H.page_listings(df, "mansion", 2025, "https://h")


def test_pages(spark):
    last = '<div class="pagination_set"><a>2</a><a>14</a><a>次へ</a></div>'
    got = listed(found(spark, page((1, "1,280", "東京都青梅市河辺"), last=last), None, "<div class=property_unit><h2", "")).collect()
    assert [(r.listing_code, r.title, r.price, r.address, r.area_sqm, r.url, r.total_pages) for r in got] == [("nc_1", "T & 1", 1280, "東京都青梅市河辺", 68.5, "https://h/ms/nc_1/", 14)]
    detail = '<table><tr><th>管理費ヒント<td>12,500円/月<th>向き<td>南<tr><th>建ぺい率・容積率</th><td>60％・200％</td></tr><tr><th>会社</th><td>x</td></tr><tr><th>総戸数<td>-</table><div>リビング 広い<div class="w220 h165"><img alt="リビング" rel="https://i.h/resizeImage?src=bukken&w=96&h=72"></div></div><div><div class="w220 h165"><img alt="プレゼント" src="https://i.h/bukken/2.jpg"></div></div><div><div class="w220 h165"><img alt="x" src="https://i.h/bukken/2.jpg"></div></div><p class="property_view_note comment">A long enough note.</p>'
    r, none = H.page_details(spark.createDataFrame([(1, detail), (2, None)], "i int, html string"), 2025, "i.h").orderBy("i").collect()
    assert (r.management_fee, r.direction, r.building_coverage, r.floor_area_ratio, r.total_units) == (12500, "南", "60％", "200％", None)
    assert [(i.alt, i.url[-11:], i.caption) for i in r.images] == [("リビング", "w=640&h=480", "広い")] and r.description == "A long enough note.\nA long enough note." and none.detail_fields == {} and none.images == []


def crawl(state, spark, n, *pages, **options):
    df = found(spark, *pages)
    read = df.selectExpr("prefecture", "'mansion' as listing_type", "is_new", "status")
    return L.crawl(state, listed(df), read, NOW + datetime.timedelta(days=n), **options)


def view(state):
    return {r.listing_code: (r.status, r.crawl_cycle_id, r.price, r.delisted_at is None) for r in state["snapshot"].collect()}


def test_cycles(spark):
    a, b, c = (1, "1280", "東京都青梅市河辺"), (2, "900", "東京都港区"), (3, "5000", "東京都品川区")
    look_up = lambda df: df.select("address", F.lit(35.0).alias("latitude"), F.lit(139.0).alias("longitude"))
    s1 = crawl(L.empty_state(spark), spark, 1, page(a, b), page(a, c), look_up=look_up)
    assert view(s1) == {f"nc_{i}": ("active", 1, p, True) for i, p in ((1, 1280), (2, 900), (3, 5000))}
    assert (s1["status"], s1["stats"]["new"], s1["stats"]["duplicates"], s1["history"].count(), s1["cache"].count()) == ("completed", 3, 1, 3, 3)
    first = s1["snapshot"].where("listing_code = 'nc_1'").first()
    assert (first.prefecture, first.city, first.latitude, first.exclusive_area_sqm, first.building_area_sqm) == ("東京都", "青梅市", 35.0, 68.5, None)
    s2 = crawl(s1, spark, 2, page(a, (4, "900", "東京都港区")))
    assert view(s2) == {"nc_1": ("active", 2, 1280, True), "nc_4": ("active", 2, 900, True), "nc_3": ("delisted", 1, 5000, False)}
    assert (s2["stats"]["updated"], s2["stats"]["delisted"], s2["history"].count()) == (2, 1, 3)
    s3 = crawl(s2, spark, 3, page(a, b, c), ceiling=4000)
    assert view(s3)["nc_3"] == ("delisted", 1, 5000, False)
    s4 = crawl(s3, spark, 4, page(a, b, c))
    assert view(s4)["nc_3"] == ("active", 4, 5000, True) and s4["cycle"] == 4
    few = crawl(s4, spark, 5, page(a))
    assert few["status"] == "suspicious" and view(few)["nc_2"] == ("active", 4, 900, True)
    part = crawl(s4, spark, 5, page(a), partial=True)
    assert part["status"] == "partial" and view(part)["nc_2"][0] == "active"
    banned = found(spark, page(a), None).withColumn("status", F.when(F.col("page") == 2, "banned").otherwise("success"))
    held = L.crawl(s4, listed(banned), banned.selectExpr("prefecture", "'mansion' as listing_type", "is_new", "status"), NOW)
    assert held["status"] == "running" and held["cycles"].where("status = 'running'").count() == 1
    queries = spark.createDataFrame([(13, "mansion", False), (13, "kodate", False)], "prefecture int, listing_type string, is_new boolean")
    assert L.remaining(queries, held["logs"], held["cycle"]).count() == 2 and L.remaining(queries, s4["logs"], 4).first().listing_type == "kodate"
    again = crawl(held, spark, 6, page(a, b, c))
    assert again["cycle"] == held["cycle"] and again["status"] == "completed"
    newest, rows = L.status_report(again["cycles"], again["snapshot"], 2)
    assert [r.id for r in newest.collect()] == [5, 4] and rows.first().active == 3
    assert L.totals(again["logs"]).where("prefecture is null").first().new_listings == s1["stats"]["new"]


def test_details(spark):
    s = crawl(L.empty_state(spark), spark, 1, page((1, "1280", "東京都青梅市河辺"), (2, "1", "x")))
    details = spark.createDataFrame([("https://h/ms/nc_1/", [("u", "a", "c")], "text", {"k": "v"}, 0, 5, "RC造", 1990, 35, "Name")], "url string, images array<struct<url:string,alt:string,caption:string>>, description string, detail_fields map<string,string>, management_fee long, total_units long, structure string, building_year int, building_age int, building_name string")
    snap, n = L.enrich(s["snapshot"], details, 1, NOW)
    r = snap.where("listing_code = 'nc_1'").first()
    assert (r.management_fee, r.total_units, r.structure, r.building_year, r.building_name, r.images[0].url) == (None, 5, "RC造", 1990, "Name", "u")
    assert tuple(n.first()) == (2, 1, 1) and L.awaiting_details(snap, 1).first().listing_code == "nc_2"
    again, n = L.enrich(snap, details.withColumn("structure", F.lit("木造")), 1, NOW)
    assert n.first().fetched == 0 and again.where("listing_code = 'nc_1'").first().structure == "RC造"
    assert "land_rights" not in L.of_kind(snap, "mansion").columns
    with pytest.raises(KeyError):
        L.of_kind(snap, "other")


def test_caps(spark):
    df = spark.createDataFrame([(1, p, 100 * p) for p in range(1, 6) for _ in range(3)], "q int, page int, price long")
    assert L.page_caps(df, ["q"], max_items=4).count() == 6 and L.page_caps(df, ["q"], max_pages=3).count() == 9 and L.below_ceiling(df, 300).count() == 9 and L.below_ceiling(df, None).count() == 15
    assert L.ceiling_hit(df, 450, ["q"]).first().hit and not L.ceiling_hit(df, 500, ["q"]).first().hit


def test_deltas(spark):
    old, new = (spark.createDataFrame(r, "k int, v int") for r in ([(1, None), (2, 5), (3, 1)], [(1, None), (2, None), (4, None)]))
    assert {r.k: r.state for r in snapshot_delta(old, new, "k", "v").collect()} == {1: "same", 2: "updated", 3: "delisted", 4: "new"}
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, 5), (1, 4, None)], "k int, t int, v int")
    assert sorted(r.t for r in changes(rows, "k", ["t"], "v").collect()) == [2, 4]
    one = spark.createDataFrame([("a",), ("b",)], "g string")
    assert {r.g: (r.active, r.found, r.suspicious) for r in safety(one, one.where("g = 'a'"), "g").collect()} == {"a": (1, 1, False), "b": (0, 1, False)}


def test_web(spark, tmp_path):
    q = web.query_matrix(spark)
    urls = q.withColumn("url", web.search_url("https://h/s", F.lit(2))).where("prefecture = 13 and listing_type = 'kodate' and is_new").first()
    assert q.count() == 16 and urls.url == "https://h/s?ar=030&bs=022&ta=13&jspIdFlg=patternShikugun&kb=0&kt=9999999&tb=0&tt=9999999&hb=0&ht=9999999&ekTjCd=&ekTjNm=&tj=0&cnb=0&cn=9999999&srch_navi=1&pn=2"
    assert "pn=" not in q.select(web.search_url("https://h/s", F.lit(1)).alias("u")).first().u
    tries, waits = iter([(500, ""), (200, "ok")]), []
    assert web.fetch(lambda u, h: next(tries), "u", waits.append, spacing=(2, 2)) == "ok" and waits == [2, 5, 2]
    with pytest.raises(web.Banned):
        web.fetch(lambda u, h: (403, ""), "u")
    assert web.fetch(lambda u, h: (404, "gone"), "u") == ""
    pages = spark.createDataFrame([(1, "a"), (2, "ban"), (3, "c"), (4, None)], "i int, url string").coalesce(1)
    got = web.read_pages(pages, lambda u, h: (503 if u == "ban" else 200, u)).orderBy("i").collect()
    assert [(r.html, r.status) for r in got] == [("a", "success"), (None, "banned"), (None, "banned"), (None, "banned")]
    asked = []
    for _ in range(2):
        df = web.stored_json(spark, str(tmp_path / "x.json"), "a int", "https://h/x", "KEY", lambda u, h: (asked.append(u), (200, '[{"a": 1}]'))[1])
        assert df.first().a == 1
    assert asked == ["https://h/x?acl:consumerKey=KEY"]
    places = spark.createDataFrame([("a",), ("bad",), (None,)], "address string")
    find = lambda a: (139.0, 35.0) if a == "a" else 1 / 0
    got = sorted(((r.address, r.latitude) for r in web.geocode(places, find).collect()), key=str)
    assert got[0] == ("a", 35.0) and all(x[1] is None or x[1] != x[1] for x in got[1:])
    assert web.geocode_station(places.withColumnRenamed("address", "station").limit(1), find).first().longitude == 139.0


def test_stream(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "state")
    cols = "prefecture int, is_new boolean, page int, status string, html string"
    for k, p in enumerate((page((1, "10", "東京都港区"), (2, "20", "東京都港区")), page((2, "20", "東京都港区")))):
        found(spark, p).coalesce(1).write.mode("append").parquet(str(source))
        pages = spark.readStream.schema(cols).parquet(str(source))
        q = stream.cycles_of(pages, base, "mansion", 2025, "https://h", lambda: NOW).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    done = stream.batches(spark, base)
    state = stream.load(spark, base, done[-1])
    assert len(done) == 2 and view(state) == {"nc_1": ("delisted", 1, 10, False), "nc_2": ("active", 2, 20, True)}
    rows = spark.createDataFrame([(NOW, "a", 1.0), (NOW + datetime.timedelta(minutes=5), "a", 2.0), (NOW + datetime.timedelta(hours=1), "a", 4.0)], "ts timestamp, event_type string, value double")
    assert sorted((r.n, r.total) for r in events.counted(rows).collect()) == [(1, 4.0), (2, 3.0)]
