"""Web sources: search urls, fetching with retries behind a pluggable opener, JSON read through a stored copy, geocoding.

Nothing here opens a connection by itself: callers pass `open_url(url, headers) -> (status, body)` and may pass `sleep`.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import PREFECTURES
from .files import exists

#: Codes of a search by listing type and newness.
CODES = {("mansion", False): "011", ("mansion", True): "012", ("kodate", False): "021", ("kodate", True): "022"}
#: Browsers that requests name in turn.
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:128.0) Gecko/20100101 Firefox/128.0",
]
#: Statuses that mean a ban, and seconds of the first pause after a failure.
BANS, PAUSE = (403, 503), 5


class Banned(Exception):
    """The site refuses further requests."""


def query_matrix(spark, prefectures=tuple(PREFECTURES), kinds=tuple(CODES)) -> DataFrame:
    """prefecture, listing_type, is_new, code of every search."""
    p = spark.createDataFrame([(x,) for x in prefectures], "prefecture int")
    k = spark.createDataFrame([(t, n, CODES[t, n]) for t, n in kinds], "listing_type string, is_new boolean, code string")
    return p.crossJoin(F.broadcast(k))


def search_url(base: str, page: Column, low: int = 0, high: int = 9999999) -> Column:
    """Url of a search of the columns prefecture, listing_type and code; the page is named from the second on."""
    pair = lambda k, v: F.concat(F.lit(f"{k}="), v if isinstance(v, Column) else F.lit(str(v)))
    area = F.when(F.col("listing_type") == "mansion", F.lit("mb=0&mt=9999999")).otherwise(F.lit("tb=0&tt=9999999&hb=0&ht=9999999"))
    head = [pair("ar", "030"), pair("bs", F.coalesce("code", F.lit("011"))), pair("ta", F.col("prefecture").cast("string")), F.lit("jspIdFlg=patternShikugun"), pair("kb", low), pair("kt", high), area]
    tail = F.lit("ekTjCd=&ekTjNm=&tj=0&cnb=0&cn=9999999&srch_navi=1")
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *head, tail, F.when(page > 1, pair("pn", page.cast("string")))))


def fetch(open_url: Callable, url: str, sleep: Callable = lambda s: None, tries: int = 3, spacing: tuple[float, float] = (2.0, 5.0), rng: random.Random | None = None) -> str:
    """A page's text: spaced requests, up to `tries` of them with growing pauses. A ban raises at once; other error pages are empty."""
    rng = rng or random.Random()
    for k in range(1, tries + 1):
        sleep(rng.uniform(*spacing))
        try:
            status, body = open_url(url, {"User-Agent": rng.choice(AGENTS)})
        except Exception:
            if k == tries:
                raise
            sleep(PAUSE * k)
            continue
        if status in BANS:
            raise Banned(f"{status} for {url}")
        if status < 400:
            return body
        if k < tries and status >= 500:
            sleep(PAUSE * k)
            continue
        return ""
    return ""


def read_pages(rows: DataFrame, open_url: Callable, sleep: Callable = lambda s: None) -> DataFrame:
    """rows (with url) with html and status: success, failed or banned. After a ban a task asks for nothing more.

    Each task spaces its own requests; the caller sets the number of tasks."""
    import pandas as pd

    names = rows.columns

    def run(batches):
        banned = False
        for df in batches:
            html, status = [], []
            for url in df["url"]:
                try:
                    body, s = (None, "banned") if banned else (None, "failed") if not url else (fetch(open_url, url, sleep), "success")
                except Banned:
                    body, s, banned = None, "banned", True
                except Exception:
                    body, s = None, "failed"
                html.append(body)
                status.append(s)
            yield pd.concat([df.reset_index(drop=True), pd.DataFrame({"html": pd.Series(html, dtype=object), "status": status})], axis=1)[[*names, "html", "status"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, html string, status string")


def stored_json(spark, path: str, schema: str, url: str, key: str, open_url: Callable) -> DataFrame:
    """The JSON array stored at path; if there is none it is fetched with the key as a parameter and stored first."""
    if not exists(spark, path):
        from ..sinks.maps import put

        status, body = open_url(f"{url}{'&' if '?' in url else '?'}acl:consumerKey={key}", {})
        if status >= 400:
            raise OSError(f"{status} for {url}")
        put(spark, body, path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def geocode(rows: DataFrame, find: Callable) -> DataFrame:
    """address, latitude, longitude by find(address) -> (lon, lat) or None; failures and empty addresses are null."""
    import pandas as pd

    def run(batches):
        for df in batches:
            out = []
            for a in df["address"]:
                try:
                    at = find(a) if a else None
                except Exception:
                    at = None
                out.append((a, at[1], at[0]) if at else (a, None, None))
            yield pd.DataFrame(out, columns=["address", "latitude", "longitude"]).astype({"latitude": "float64", "longitude": "float64"})

    return rows.select("address").mapInPandas(run, "address string, latitude double, longitude double")


def geocode_station(rows: DataFrame, find: Callable) -> DataFrame:
    """The same for station names (column station), sought as they stand."""
    return geocode(rows.select(F.col("station").alias("address")), find)
