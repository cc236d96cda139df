"""Listing and detail pages read into typed rows.

Pages are parsed by the standard library inside Arrow batches; fields are typed by column expressions afterwards. Null
and broken pages give no listings, one page, and details without fields.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import scalars as S

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that a later sibling of their kind, or one of these, closes.
ENDS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "p": {"p"}, "option": {"option"}}
#: Keys of detail tables that describe the property.
DETAIL_KEYS = """物件名 所在地 住所 交通 価格 販売価格 最多価格帯 管理費 管理費等 修繕積立金 修繕積立基金 諸費用 専有面積 建物面積 土地面積 その他面積
敷地面積 間取り バルコニー 所在階 所在階/構造・階建 構造・階建て 構造・工法 階建て 完成時期（築年月） 完成時期(築年月) 築年月 向き エネルギー消費性能
断熱性能 目安光熱費 販売戸数 総戸数 引渡可能時期 販売スケジュール 土地の権利形態 敷地の権利形態 土地権利 用途地域 建ぺい率・容積率 建ぺい率 容積率
私道負担・道路 接道状況 地目 都市計画 駐車場 施工 リフォーム 情報提供日""".split()


class Node:
    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.up, self.inner = tag, attrs, up, []
        self.classes = set((attrs.get("class") or "").split())

    def all(self, test):
        """Elements below in document order."""
        for x in self.inner:
            if isinstance(x, Node):
                if test(x):
                    yield x
                yield from x.all(test)

    def one(self, test) -> Node | None:
        return next(self.all(test), None)

    def text(self) -> str:
        """The texts below, each stripped, joined."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x.strip())
            elif x.tag not in ("script", "style"):
                todo += reversed(x.inner)
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.at.tag in ENDS.get(tag, ()):
            self.at = self.at.up
            if tag == "tr" and self.at.tag == "tr":
                self.at = self.at.up
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.inner.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x.up is not None and x.tag != tag:
            x = x.up
        if x.up is not None:
            self.at = x.up

    def handle_data(self, data):
        self.at.inner.append(data)


def named(tag: str):
    return lambda x: x.tag == tag


def classed(*names: str, tag: str = ""):
    return lambda x: x.classes.issuperset(names) and (not tag or x.tag == tag)


def total_pages(html: str | None) -> int:
    """The largest number among pagination links, 1 without any."""
    box = Tree(html or "").root.one(classed("pagination_set"))
    numbers = [int(t) for a in (box.all(named("a")) if box else ()) if (t := a.text()).isascii() and t.isdigit()]
    return max([1, *numbers])


def listings(html: str | None) -> list[dict]:
    """href, title, thumbnail and fields of each unit with a title link."""
    out = []
    for unit in Tree(html or "").root.all(classed("property_unit")):
        head = unit.one(classed("property_unit-title", tag="h2"))
        link = head and head.one(named("a"))
        if not link:
            continue
        image = unit.one(lambda x: x.tag == "img" and x.classes & {"property_unit-thumbnail", "js-noContextMenu"})
        src = (image.attrs.get("data-src") or image.attrs.get("src") or "") if image else ""
        fields, table = {}, unit.one(classed("dottable--cassette"))
        for dl in table.all(named("dl")) if table else ():
            dt, dd = dl.one(named("dt")), dl.one(named("dd"))
            if dt and dd and (key := dt.text()):
                fields.setdefault(key, dd.text())
        out.append({"href": link.attrs.get("href", ""), "title": link.text(), "thumbnail": src if src and not src.endswith("noimage.gif") else None, "fields": fields})
    return out


def detail(html: str | None, image_host: str) -> dict:
    """images (src, alt, text), fields (raw keys, th paired with td by row) and descriptions of a detail page."""
    root = Tree(html or "").root
    images = []
    for box in root.all(classed("w220", "h165", tag="div")):
        if img := box.one(named("img")):
            src = img.attrs.get("data-src") or img.attrs.get("src") or img.attrs.get("rel") or ""
            if image_host in src and "bukken" in src:
                images.append({"src": src, "alt": img.attrs.get("alt", ""), "text": box.up.text()})
    fields = {}
    for table in root.all(named("table")):
        for row in table.all(named("tr")):
            for th, td in zip(row.all(named("th")), row.all(named("td"))):
                key, value = th.text(), td.text()
                if key and value and value != "-":
                    fields.setdefault(key.replace("ヒント", "").strip(), value)
    tests = [classed("property_view_note"), classed("property_view_detail-comment"), lambda x: "description" in x.attrs.get("class", ""), lambda x: "comment" in x.attrs.get("class", ""), classed("informationComment")]
    notes = [t for test in tests for x in root.all(test) if len(t := x.text()) > 10]
    return {"images": images, "fields": fields, "description": "\n".join(notes) if notes else None}


PAGES = "array<struct<href:string,title:string,thumbnail:string,fields:map<string,string>>>"
DETAIL = "struct<images:array<struct<src:string,alt:string,text:string>>,fields:map<string,string>,description:string>"


def page_listings(pages: DataFrame, kind: str, as_of_year: int, base: str) -> DataFrame:
    """The columns of pages (with html), total_pages, _pos (order in the page) and the typed fields of each listing with a code."""

    @F.pandas_udf(PAGES)
    def read(html: pd.Series) -> pd.Series:
        return html.map(listings)

    @F.pandas_udf("int")
    def count(html: pd.Series) -> pd.Series:
        return html.map(total_pages).astype("int32")

    rest = [c for c in pages.columns if c != "html"]
    rows = pages.select(*rest, count("html").alias("total_pages"), F.posexplode(read("html")).alias("_pos", "_x"))
    f = lambda *k: S.first_present(F.col("_x.fields"), *k)
    floors = f("構造・階建て", "所在階", "階")
    material = F.coalesce(*(S.structure(f(k)) for k in ("構造・階建て", "所在階", "階")))
    rows = rows.select(
        *rest, "total_pages", "_pos", S.listing_code(F.col("_x.href")).alias("listing_code"), F.col("_x.title").alias("title"), S.absolute(F.col("_x.href"), base).alias("url"), F.col("_x.thumbnail").alias("thumbnail"),
        f("物件名").alias("building_name"), S.price_man(f("販売価格")).alias("price"), f("所在地").alias("address"), S.station_access(f("沿線・駅")).alias("station_access"),
        F.coalesce(F.nullif(S.area_m2(f("専有面積")), F.lit(0.0)), S.area_m2(f("建物面積"))).alias("area_sqm"), S.area_m2(f("土地面積")).alias("land_area_sqm"), f("間取り").alias("floor_plan"),
        S.building_year(f("築年月")).alias("building_year"), S.building_age(f("築年月"), as_of_year).alias("building_age"), S.area_m2(f("バルコニー")).alias("balcony_sqm"),
        floors.alias("floors"), material.alias("structure"), F.col("_x.fields").alias("raw_fields"), F.lit(kind).alias("listing_type"),
    ).where("listing_code is not null")
    return rows.withColumn("content_hash", S.listing_hash(F.col("address"), F.col("price"), F.col("area_sqm"), F.col("floor_plan"), F.col("listing_type")))


def images_of(images: Column, promo: str = "プレゼント") -> Column:
    """url, alt and caption of the first image of each large url; urls of promotions count as seen, and go."""
    large = F.transform(images, lambda i: F.struct(S.large_image(i["src"]).alias("url"), i["alt"].alias("alt"), S.caption(i["text"], i["alt"]).alias("caption")))
    first = F.filter(large, lambda i, k: ~F.exists(F.slice(large, 1, k), lambda j: j["url"] == i["url"]))
    return F.filter(first, lambda i: i["alt"] != promo)


def page_details(pages: DataFrame, as_of_year: int, image_host: str) -> DataFrame:
    """The columns of pages (with html) but html, and the typed fields of a detail page."""

    @F.pandas_udf(DETAIL)
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detail(h, image_host) for h in html], columns=["images", "fields", "description"])

    rest = [c for c in pages.columns if c != "html"]
    rows = pages.select(*rest, read("html").alias("_d")).withColumn("detail_fields", S.clean_fields(F.col("_d.fields"), DETAIL_KEYS))
    f = lambda *k: S.first_present(F.col("detail_fields"), *k)
    year = f("完成時期（築年月）", "完成時期(築年月)", "築年月")
    return rows.select(
        *rest, images_of(F.col("_d.images")).alias("images"), F.col("_d.description").alias("description"), "detail_fields",
        S.monthly_fee(f("管理費")).alias("management_fee"), S.monthly_fee(f("修繕積立金")).alias("repair_reserve"), S.first_integer(f("総戸数")).alias("total_units"), f("向き").alias("direction"),
        f("所在階", "所在階/構造・階建").alias("floor_location"), f("構造・階建て", "構造・工法", "所在階/構造・階建").alias("total_floors"),
        F.coalesce(S.structure(f("構造・階建て", "構造・工法", "所在階/構造・階建")), f("構造・工法", "構造・階建て")).alias("structure"),
        f("土地の権利形態", "敷地の権利形態", "土地権利").alias("land_rights"), f("接道状況", "私道負担・道路").alias("road_access"),
        S.coverage_and_ratio(F.col("detail_fields")).alias("_c"), f("用途地域").alias("zoning"), F.coalesce(S.area_m2(f("専有面積")), S.area_m2(f("建物面積"))).alias("area_sqm"),
        f("その他面積").alias("balcony_area_text"), F.nullif(S.area_m2(f("その他面積")), F.lit(0.0)).alias("balcony_area_sqm"), S.area_m2(f("土地面積")).alias("land_area_sqm"),
        S.building_year(year).alias("building_year"), S.building_age(year, as_of_year).alias("building_age"), f("駐車場").alias("parking"), f("物件名").alias("building_name"),
    ).select("*", "_c.building_coverage", "_c.floor_area_ratio").drop("_c")
