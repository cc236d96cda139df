"""Scalar column functions: identifiers, times, money, areas, distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Metres per degree of latitude, and of longitude at 35.68 degrees north; walking speed in km/h.
LAT_M, LON_M, WALK_KMH = 111320.0, 111320.0 * 0.8123450262, 5.0


def strip_prefix(x: Column) -> Column:
    """What follows the last colon; null stays null."""
    return F.substring_index(x, ":", -1)


def last_two(x: Column) -> Column:
    """Last two dot segments of the stripped id; the raw id if it has fewer."""
    s = strip_prefix(x)
    return F.when(F.size(F.split(s, r"\.")) >= 2, F.substring_index(s, ".", -2)).otherwise(x)


def route_id(pattern: Column, direction: Column) -> Column:
    return F.concat(pattern, F.lit("."), F.coalesce(direction, F.lit("None")))


def clock_seconds(x: Column) -> Column:
    """Seconds of HH:MM or HH:MM:SS with the hour modulo 24; anything else is null."""
    p = F.split(x, ":")
    n = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)), F.lit("0")).try_cast("int")
    return F.when(F.size(p) >= 2, (n(1) % 24) * 3600 + n(2) * 60 + n(3))


def calendar(ts: Column) -> Column:
    return F.when(F.weekday(ts) < 5, "Weekday").otherwise("SaturdayHoliday")


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = (lat2 - lat1) * LAT_M, (lon2 - lon1) * LON_M
    return F.sqrt(a * a + b * b)


def walk_seconds(m: Column, kmh: float = WALK_KMH) -> Column:
    return m / (kmh * 1000 / 3600)


def compact(x: Column) -> Column:
    """Without thousands separators and spaces, full-width ones too."""
    return F.regexp_replace(x, "[,　 ]", "")


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """The first match, null if there is none."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def price_man(x: Column) -> Column:
    """Price in units of 10,000: of a range the lower end, hundred millions carried over; zero or no amount is null."""
    low = F.substring_index(F.substring_index(compact(x), "〜", 1), "～", 1)
    amount = lambda unit: F.coalesce(found(low, f"([0-9]+){unit}").try_cast("long"), F.lit(0))
    return F.nullif(amount("億") * 10000 + amount("万"), F.lit(0).cast("long"))


def area_m2(x: Column) -> Column:
    return found(x, r"([0-9.]+)\s*m").try_cast("double")


def monthly_fee(x: Column) -> Column:
    """Yen a month: 10,000s (cut to whole yen), yen, or bare digits unless the text says there is none."""
    flat = compact(x)
    bare = F.when(~flat.rlike("不要|なし|-"), found(flat, "([0-9]+)").try_cast("long"))
    return F.coalesce((found(flat, "([0-9.]+)万").try_cast("decimal(18,6)") * 10000).cast("long"), found(flat, "([0-9]+)円").try_cast("long"), bare)


def building_year(x: Column) -> Column:
    return found(x, "([0-9]{4})年").try_cast("int")


def building_age(x: Column, as_of_year: int) -> Column:
    """Years: the stated age, 0 if new, else as_of_year less the year."""
    return F.coalesce(found(x, "築([0-9]+)年").try_cast("int"), F.when(x.contains("新築"), 0), F.lit(as_of_year) - building_year(x))


def station_access(x: Column) -> Column:
    """Array of (line, station, walk_min): LINE「STATION」徒歩N分 or バスN分; only without any of those LINE/STATION駅 徒歩N分."""
    flat = F.regexp_replace(F.translate(x, "（）", "()"), "　", " ")

    def hits(pattern: str) -> Column:
        whole = F.regexp_extract_all(flat, F.lit(f"({pattern})"), F.lit(1))
        part = lambda h, g: F.regexp_extract(h, pattern, g)
        return F.transform(whole, lambda h: F.struct(part(h, 1).alias("line"), part(h, 2).alias("station"), part(h, 3).try_cast("int").alias("walk_min")))

    first, second = hits(r"([^「」\s/／]+)「([^」]+)」\s*(?:徒歩|バス)?([0-9]+)分"), hits(r"([^/／\s]+)[/／]([^駅]+駅?)\s*徒歩([0-9]+)分")
    return F.when(F.size(first) > 0, first).otherwise(second)


def structure(x: Column) -> Column:
    """The leftmost building material, with 造 if it follows."""
    return found(x, "(RC|SRC|S|木|鉄筋|鉄骨)造?", 0)


def first_integer(x: Column) -> Column:
    return found(x, "([0-9]+)").try_cast("long")


def content_hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256)


def tenths(x: Column) -> Column:
    """A positive double with one decimal, as its exact binary value rounds (68.35 gives 68.3), to even on exact halves."""
    scale = F.pow(F.lit(2.0), 52 - F.greatest(F.floor(F.log2(x)), F.lit(-5)))
    ten, unit = (x * scale).cast("long") * 10, scale.cast("long")
    over = F.pmod(ten, unit)
    whole = ((ten - over) / unit).cast("long")
    n = whole + ((over * 2 > unit) | ((over * 2 == unit) & (whole % 2 == 1))).cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def listing_hash(address: Column, price: Column, area: Column, plan: Column, kind: Column) -> Column:
    """sha256 of address|price|area|plan|kind; null, empty and zero count as empty, areas have one decimal."""
    return content_hash(address, F.when(price != 0, price), F.when(area > 0, tenths(area)), plan, kind)


#: Codes, names and slugs of prefectures.
PREFECTURES = {11: ("埼玉", "saitama"), 12: ("千葉", "chiba"), 13: ("東京", "tokyo"), 14: ("神奈川", "kanagawa")}
#: Prefectures as addresses begin.
ADDRESS_HEADS = {11: "埼玉県", 12: "千葉県", 13: "東京都", 14: "神奈川県"}


def of_map(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def prefecture_name(code: Column) -> Column:
    return F.coalesce(of_map({k: v[0] for k, v in PREFECTURES.items()}, code.cast("int")), code.cast("string"))


def address_parts(address: Column, code: Column) -> Column:
    """struct(prefecture, city, town): the city ends at the first 市, 区, 町 or 村; without one all the rest is the city; all empty if the address begins otherwise."""
    head = of_map(ADDRESS_HEADS, code.cast("int"))
    rest = F.substring(address, F.length(head) + 1, F.length(address))
    city = found(rest, "^(.+?[市区町村])")
    known = F.startswith(address, head)
    return F.struct(
        F.when(known, head).otherwise("").alias("prefecture"), F.when(known, F.coalesce(city, rest)).otherwise("").alias("city"),
        F.when(known & city.isNotNull(), F.substring(rest, F.length(city) + 1, F.length(rest))).otherwise("").alias("town"),
    )


def large_image(url: Column) -> Column:
    """Width 640 and height 480 in the query of resized images; other urls stay."""
    return F.when(url.contains("resizeImage"), F.regexp_replace(F.regexp_replace(url, r"[&?]w=\d+", "&w=640"), r"[&?]h=\d+", "&h=480")).otherwise(url)


def listing_code(href: Column) -> Column:
    return found(href, r"(nc_[0-9]+)")


def absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def coverage_and_ratio(fields: Column) -> Column:
    """struct(building_coverage, floor_area_ratio) of a field map: the joint entry cut at ・ or /, else the single ones."""
    joint = F.try_element_at(fields, F.lit("建ぺい率・容積率"))
    part = lambda i: F.trim(F.try_element_at(F.split(joint, "[・/]"), F.lit(i)))
    single = lambda k: F.try_element_at(fields, F.lit(k))
    return F.struct(F.when(joint.isNotNull(), part(1)).otherwise(single("建ぺい率")).alias("building_coverage"), F.when(joint.isNotNull(), part(2)).otherwise(single("容積率")).alias("floor_area_ratio"))


def first_present(fields: Column, *keys: str) -> Column:
    return F.coalesce(*(F.try_element_at(fields, F.lit(k)) for k in keys))


def clean_fields(fields: Column, known: list[str]) -> Column:
    """Keys without the hint suffix, only known ones; empty values and - go."""
    pairs = F.transform(F.map_entries(fields), lambda e: F.struct(F.trim(F.regexp_replace(e["key"], "ヒント", "")).alias("key"), e["value"].alias("value")))
    pairs = F.filter(pairs, lambda e: e["key"].isin(known) & (F.length(e["value"]) > 0) & (e["value"] != "-"))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), 1)["value"]))


def caption(text: Column, alt: Column) -> Column:
    """The text behind its alt, 200 characters at most."""
    return F.left(F.trim(F.when((F.length(alt) > 0) & F.startswith(text, alt), F.substring(text, F.length(alt) + 1, F.length(text))).otherwise(text)), F.lit(200))


def output_stem(mode: str, lat: Column, lon: Column, departure: Column, minutes: Column) -> Column:
    """mode_lat_lon_HHMM_Nmin_calendar."""
    return F.format_string("%s_%.4f_%.4f_%s_%dmin_%s", F.lit(mode), lat, lon, F.date_format(departure, "HHmm"), minutes, calendar(departure))


# Identifiers.


def first_of(x: Column) -> Column:
    """First element of an array, null of an empty one."""
    return F.try_element_at(x, F.lit(1))


def operator_name(names: Column) -> Column:
    """Stripped id of the first operator of an array."""
    return strip_prefix(first_of(names))


def last_two_stripped(x: Column) -> Column:
    """Last two dot segments of the stripped id, however few it has."""
    return F.substring_index(strip_prefix(x), ".", -2)


def patterns(x: Column) -> Column:
    """Cleaned ids of an array; null and empty ones go."""
    return F.transform(F.filter(x, lambda v: F.coalesce(v, F.lit("")) != ""), last_two)


def first_segment(x: Column) -> Column:
    return F.substring_index(x, ".", 1)


# Times and distances.


def departure_seconds(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def bands(interval: Column, duration: Column) -> Column:
    """interval, 2 * interval, ... up to duration; none if the interval is longer."""
    return F.when(interval <= duration, F.sequence(interval, F.greatest(interval, duration), interval)).otherwise(F.array().cast("array<int>"))


def metres_to_degrees(m: Column) -> Column:
    """Degrees that are m metres on the mean of both axes."""
    return m * (2.0 / (LAT_M + LON_M))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of 6,371,009 m radius, as edge lengths have them."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371009.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def japan_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "Asia/Tokyo")


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y); open or closed."""
    n = F.size(ring)
    cross = lambda p, i: p["x"] * F.element_at(ring, (i + 1) % n + 1)["y"] - F.element_at(ring, (i + 1) % n + 1)["x"] * p["y"]
    return F.abs(F.aggregate(F.transform(ring, cross), F.lit(0.0), lambda s, v: s + v)) / 2


def vertices(rings: Column) -> Column:
    return F.aggregate(F.transform(rings, F.size), F.lit(0), lambda s, v: s + v)


def line_wkt(points: Column) -> Column:
    """LINESTRING of an array of [lon, lat]; null with fewer than two points."""
    return F.when(F.size(points) >= 2, F.concat(F.lit("LINESTRING("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ", "), F.lit(")")))


def point(lon: Column, lat: Column) -> Column:
    """struct(lon, lat); null if either is missing."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))
