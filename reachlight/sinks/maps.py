"""GeoJSON files, HTML maps, output names and notices. Features are few (origins times bands) and meet on the driver."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame

from .tables import files

#: Colours of bands from the shortest on.
COLOURS = ["#d62728", "#e6550d", "#8b6508", "#2ca02c", "#1f78b4", "#6a3d9a"]


def collection(features: DataFrame | list) -> dict:
    """A FeatureCollection of features as rows, dictionaries or one dictionary."""
    if isinstance(features, DataFrame):
        features = [json.loads(r.feature) for r in features.select("feature").collect()]
    return {"type": "FeatureCollection", "features": features if isinstance(features, list) else [features]}


def put(spark, text: str, path: str) -> None:
    """One text file, wherever Spark can write; folders are made, an old file goes."""
    p, fs = files(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_geojson(spark, features, path: str, indent: int | None = None) -> None:
    """Compact, or indented for a reader."""
    put(spark, json.dumps(collection(features), ensure_ascii=False, indent=indent), path)


def colour(minutes: int, interval: int) -> str:
    """The colour of a band; bands beyond the last share its colour."""
    return COLOURS[min(max(minutes // interval - 1, 0), len(COLOURS) - 1)]


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>%(title)s</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css"><script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script>
<style>html,body,#map{height:100%%;margin:0}</style></head><body><div id="map"></div><script>
const map = L.map("map").setView([%(lat)r, %(lon)r], 12);
L.tileLayer("%(tiles)s", {attribution: "%(credit)s"}).addTo(map);
const layers = {};
for (const [name, style, feature] of %(layers)s) {
  layers[name] = L.geoJSON(feature, {style}).bindTooltip(name).addTo(map);
}
L.marker([%(lat)r, %(lon)r]).bindPopup(%(label)s).addTo(map);
L.control.layers(null, layers).addTo(map);
</script></body></html>
"""
TILES, CREDIT = "https://cyberjapandata.gsi.go.jp/xyz/std/{z}/{x}/{y}.png", "GSI Japan"


def page(layers: list, lat: float, lon: float, label: str, title: str) -> str:
    data = json.dumps(layers, ensure_ascii=False).replace("</", "<\\/")
    return PAGE % {"title": title, "lat": lat, "lon": lon, "layers": data, "label": json.dumps(label), "tiles": TILES, "credit": CREDIT}


def single_map(feature: dict, lat: float, lon: float, label: str, fill: str = "#3388ff", stroke: str = "#1f5fbf") -> str:
    """HTML of one band."""
    return page([["isochrone", {"fillColor": fill, "color": stroke, "weight": 2, "fillOpacity": 0.35}, feature]], lat, lon, label, "isochrone")


def contour_map(features: list[dict], interval: int, lat: float, lon: float, label: str) -> str:
    """HTML of nested bands, the largest drawn first."""
    order = sorted(features, key=lambda f: -f["properties"]["duration_minutes"])
    style = lambda m: {"fillColor": colour(m, interval), "color": colour(m, interval), "weight": 1.5, "fillOpacity": 0.6}
    return page([[f"{m}min", style(m), f] for f in order for m in [f["properties"]["duration_minutes"]]], lat, lon, label, "isochrones")


def output_path(given: str | None, config: dict, stem: str, ending: str = ".html") -> str:
    """The given path, else the configured one, else the stem in the configured folder."""
    out = config.get("output", {}) or {}
    if given or out.get("path"):
        return given or out["path"]
    return str(PurePosixPath(out.get("dir") or "output") / (stem + ending))


def wants_geojson(flag: bool | None, config: dict) -> bool:
    return bool((config.get("output", {}) or {}).get("geojson", False)) if flag is None else flag


NAMES = {11: "埼玉", 12: "千葉", 13: "東京", 14: "神奈川"}


def notice(kind: str, cycle: int, now: str = "", **x) -> str:
    """Text of a crawl's notice: started, prefecture, completed, banned, suspicious or error."""
    s, name = x.get("stats") or {}, NAMES.get(x.get("prefecture"), str(x.get("prefecture")))
    n = lambda k: s.get(k, 0)
    if kind == "started":
        return f"🕷️ *Crawl started* — cycle #{cycle}\nPrefectures: {', '.join(NAMES.get(p, str(p)) for p in x['prefectures'])}\nTypes: {', '.join(x['types'])}\n{now}"
    if kind == "prefecture":
        t = x["total"]
        return f"📊 Cycle #{cycle} — *{name}* done\n  this: new={n('new')} upd={n('updated')} dup={n('duplicates')}\n  total: new={t.get('new', 0)} upd={t.get('updated', 0)} err={t.get('errors', 0)}"
    if kind == "completed":
        parts = [f"new={n('new')}", f"updated={n('updated')}", f"delisted={x.get('delisted', 0)}"] + [f"{label}={n(k)}" for label, k in (("detail pages", "details_fetched"), ("errors", "errors")) if n(k)]
        return f"{'✅' if x['status'] == 'completed' else '⚠️'} *Crawl {x['status']}* — cycle #{cycle}\n{', '.join(parts)}\n{now}"
    if kind == "banned":
        return f"🚨 *BAN DETECTED* — cycle #{cycle} ABORTED\nFound {n('new')} listings before ban.\n*No existing data was modified.*\nCycle stays running for resume.\n{now}"
    if kind == "suspicious":
        share = x["found"] / x["active"] * 100 if x["active"] else 0
        return f"⚠️ *Suspicious crawl* — cycle #{cycle}\nFound {x['found']}/{x['active']} listings ({share:.0f}%)\nThreshold: {x['threshold']:.0%}\n*Delist skipped to protect data.*\n{now}"
    return f"❌ *Crawl error* — cycle #{cycle}\n{x.get('message', '')}\n{now}"


def notify(send, text: str) -> bool:
    """Sends if a sender is configured; a failure to send is no failure of the crawl."""
    if send is None:
        return False
    try:
        send(text)
        return True
    except Exception:
        return False
