"""Listing lifecycle by cycles: upsert with duplicates and reactivation, price history, delisting behind a safety check,
detail enrichment, geocode cache, resume, logs and reports.

A snapshot has a row for each (listing_type, content_hash): the LISTING columns and the typed fields of its kind. Found
rows are those of `functions.html.page_listings` with prefecture, is_new, page and _pos. Rows without a listing code
never come in. Null, empty and zero count as missing wherever values fill gaps. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S

KEY = ["listing_type", "content_hash"]
#: Columns that an upsert keeps up.
STATE = "crawl_cycle_id long, status string, first_seen_at timestamp, last_seen_at timestamp, delisted_at timestamp, updated_at timestamp, detail_fetched_at timestamp"
PLACE = "prefecture string, city string, town string, latitude double, longitude double"
LISTING = f"listing_type string, content_hash string, listing_code string, is_new boolean, title string, price long, address string, {PLACE}, station_access array<struct<line:string,station:string,walk_min:int>>, floor_plan string, building_year int, building_age int, structure string, url string, raw_fields map<string,string>, building_name string, exclusive_area_sqm double, building_area_sqm double, land_area_sqm double, balcony_area_sqm double, floor_location string, {STATE}"
DETAILS = "images array<struct<url:string,alt:string,caption:string>>, description string, detail_fields map<string,string>, total_floors string, management_fee long, repair_reserve long, total_units long, direction string, land_rights string, road_access string, building_coverage string, floor_area_ratio string, zoning string"
#: Fields of one kind that details fill where they are missing, and the detail's name.
FILLED = {"mansion": {"management_fee": "management_fee", "repair_reserve": "repair_reserve", "total_units": "total_units", "direction": "direction", "floor_location": "floor_location", "total_floors": "total_floors", "exclusive_area_sqm": "area_sqm"},
          "kodate": {"land_rights": "land_rights", "road_access": "road_access", "building_coverage": "building_coverage", "floor_area_ratio": "floor_area_ratio", "zoning": "zoning", "total_floors": "total_floors", "building_area_sqm": "area_sqm", "land_area_sqm": "land_area_sqm"}}
KINDS = tuple(FILLED)


def of_kind(snapshot: DataFrame, kind: str) -> DataFrame:
    """Rows and columns of one listing type; an unknown type is an error."""
    if kind not in FILLED:
        raise KeyError(kind)
    other = {c for k in KINDS if k != kind for c in FILLED[k]} - set(FILLED[kind])
    return snapshot.where(F.col("listing_type") == kind).drop(*other)


def given(x: Column, kind: str) -> Column:
    """x, null if it is empty or zero."""
    return F.when(x != "", x) if kind == "string" else F.when(x != 0, x) if kind in ("bigint", "int", "double") else x


def below_ceiling(found: DataFrame, ceiling: int | None) -> DataFrame:
    """Rows without a price or with one up to the ceiling; without a ceiling all."""
    return found.where(F.col("price").isNull() | (F.col("price") <= ceiling)) if ceiling else found


def ceiling_hit(found: DataFrame, ceiling: int | None, by: list[str]) -> DataFrame:
    """by, hit: whether a price of the group passes the ceiling, so that the pages behind can be left."""
    return found.groupBy(*by).agg(F.coalesce(F.max(F.col("price") > F.lit(ceiling or None).cast("long")), F.lit(False)).alias("hit"))


def page_caps(found: DataFrame, by: list[str], max_pages: int | None = None, max_items: int | None = None) -> DataFrame:
    """Pages up to max_pages, and whole pages while those before hold fewer than max_items rows."""
    if max_pages:
        found = found.where(F.col("page") <= max_pages)
    if max_items:
        size = found.groupBy(*by, "page").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = found.join(size.withColumn("__before", before).where(F.col("__before") < max_items).select(*by, "page"), [*by, "page"], "left_semi")
    return found


def geocoded(addresses: DataFrame, cache: DataFrame, look_up=None) -> tuple[DataFrame, DataFrame]:
    """address, latitude, longitude, source (cache, api, skip) of each address, and the cache with what was looked up.

    Empty addresses are skipped; cached failures count as known. look_up takes a table of addresses and returns address, latitude, longitude."""
    asked = addresses.select(F.coalesce("address", F.lit("")).alias("address")).distinct()
    known = asked.join(cache.select("address", "latitude", "longitude").dropDuplicates(["address"]).withColumn("source", F.lit("cache")), "address")
    misses = asked.where("address <> ''").join(cache.select("address"), "address", "left_anti")
    none = asked.where("address = ''").select("address", F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit("skip").alias("source"))
    if look_up is None:
        fresh = misses.select("address", F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude")).withColumn("source", F.lit("skip"))
        return known.unionByName(fresh).unionByName(none), cache
    got = misses.join(look_up(misses), "address", "left").select("address", "latitude", "longitude")
    after = cache.unionByName(got.withColumn("created_at", F.current_timestamp()), allowMissingColumns=True)
    return known.unionByName(got.withColumn("source", F.lit("api"))).unionByName(none), after


def upsert(snapshot: DataFrame, found: DataFrame, cycle: int, now, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next snapshot, rows for the price history, and counts by prefecture, listing_type and is_new.

    Of several found rows of a key the first by page and place counts, the others are duplicates, as are rows of keys that
    this cycle has already. Known listings move to the cycle, take code, price, url and raw fields, are active again and
    await their details; new ones come in with their first price."""
    at = F.lit(now).cast("timestamp")
    order = Window.partitionBy(*KEY).orderBy("page", "_pos", "listing_code")
    rows = found.withColumn("__n", F.row_number().over(order))
    seen = snapshot.select(*KEY, F.col("price").alias("__price"), F.col("crawl_cycle_id").alias("__cycle"))
    rows = rows.join(seen, KEY, "left")
    kind = F.when((F.col("__n") > 1) | (F.col("__cycle") == cycle), "duplicate").when(F.col("__cycle").isNotNull(), "updated").otherwise("new")
    rows = rows.withColumn("__kind", kind)
    query = ["prefecture_code", "listing_type", "is_new"]
    rows = rows.withColumn("prefecture_code", F.col("prefecture").cast("int")) if "prefecture_code" not in rows.columns else rows
    counts = rows.groupBy(*query).agg(F.count("*").alias("total_items"), *(F.count_if(F.col("__kind") == k).alias(n) for k, n in (("new", "new_listings"), ("updated", "updated_listings"), ("duplicate", "duplicates_skipped"))))
    rows = rows.where("__kind <> 'duplicate'")
    history = rows.where("(__kind = 'new' and price > 0) or (__kind = 'updated' and price > 0 and __price > 0 and price <> __price)")
    history = history.select("content_hash", "listing_type", "price", F.lit(cycle).cast("long").alias("crawl_cycle_id"), at.alias("recorded_at"))
    part = S.address_parts(F.coalesce("address", F.lit("")), F.col("prefecture_code"))
    fresh = rows.where("__kind = 'new'").withColumn("__at", part)
    if places is not None:
        fresh = fresh.join(places.select(F.col("address").alias("__a"), "latitude", "longitude"), F.coalesce("address", F.lit("")) == F.col("__a"), "left").drop("__a")
    else:
        fresh = fresh.withColumn("latitude", F.lit(None).cast("double")).withColumn("longitude", F.lit(None).cast("double"))
    mansion = F.col("listing_type") == "mansion"
    fresh = fresh.withColumns({
        "prefecture": F.col("__at.prefecture"), "city": F.col("__at.city"), "town": F.col("__at.town"), "exclusive_area_sqm": F.when(mansion, F.col("area_sqm")), "building_area_sqm": F.when(~mansion, F.col("area_sqm")),
        "balcony_area_sqm": F.when(mansion, F.col("balcony_sqm")), "land_area_sqm": F.when(~mansion, F.col("land_area_sqm")), "floor_location": F.when(mansion, F.col("floors")),
        "crawl_cycle_id": F.lit(cycle).cast("long"), "status": F.lit("active"), "first_seen_at": at, "last_seen_at": at, "updated_at": at,
        "delisted_at": F.lit(None).cast("timestamp"), "detail_fetched_at": F.lit(None).cast("timestamp"),
    })
    fresh = fresh.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in snapshot.schema))
    new = rows.where("__kind = 'updated'").select(*KEY, *(F.col(c).alias("__" + c) for c in ("listing_code", "price", "url", "raw_fields")), F.lit(True).alias("__hit"))
    hit = F.col("__hit").isNotNull()
    old = snapshot.join(new, KEY, "left").withColumns({
        "listing_code": F.when(hit, F.col("__listing_code")).otherwise(F.col("listing_code")), "price": F.when(hit, F.coalesce(given(F.col("__price"), "bigint"), F.col("price"))).otherwise(F.col("price")),
        "url": F.when(hit, F.coalesce(given(F.col("__url"), "string"), F.col("url"))).otherwise(F.col("url")), "raw_fields": F.when(hit, F.col("__raw_fields")).otherwise(F.col("raw_fields")),
        "crawl_cycle_id": F.when(hit, F.lit(cycle).cast("long")).otherwise(F.col("crawl_cycle_id")), "last_seen_at": F.when(hit, at).otherwise(F.col("last_seen_at")), "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
        "status": F.when(hit & (F.col("status") == "delisted"), "active").otherwise(F.col("status")), "delisted_at": F.when(hit & (F.col("status") == "delisted"), None).otherwise(F.col("delisted_at")),
        "detail_fetched_at": F.when(hit, None).otherwise(F.col("detail_fetched_at")),
    })
    return old.select(*snapshot.columns).unionByName(fresh), history, counts


def awaiting_details(snapshot: DataFrame, cycle: int) -> DataFrame:
    return snapshot.where((F.col("crawl_cycle_id") == cycle) & F.col("detail_fetched_at").isNull())


def enrich(snapshot: DataFrame, details: DataFrame, cycle: int, now) -> tuple[DataFrame, DataFrame]:
    """The snapshot with details (url and the columns of `page_details`) of listings that await them, and counts: total, fetched, errors.

    Images, description and fields are replaced, other columns filled where they are missing, the building's name if the page has one. A url is read once."""
    wanted = F.coalesce((F.col("crawl_cycle_id") == cycle) & F.col("detail_fetched_at").isNull(), F.lit(False))
    names = [c for c in details.columns if c != "url"]
    d = details.where("url is not null").dropDuplicates(["url"]).select(F.col("url").alias("__url"), *(F.col(c).alias("__" + c) for c in names), F.lit(True).alias("__hit"))
    rows = snapshot.withColumn("__want", wanted).join(d, F.col("__want") & (F.col("url") == F.col("__url")), "left")
    counts = rows.agg(F.count_if("__want").alias("total"), F.count_if(F.col("__hit").isNotNull()).alias("fetched"), F.count_if(F.col("__want") & F.col("__hit").isNull()).alias("errors"))
    kinds = {f.name: f.dataType for f in snapshot.schema}
    hit, new = F.col("__hit").isNotNull(), {}
    for c in ("images", "description", "detail_fields"):
        if c in kinds and c in names:
            value = F.when(F.size("__" + c) > 0, F.col("__" + c)) if c != "description" else F.col("__" + c)
            new[c] = F.when(hit, value).otherwise(F.col(c))
    fill = lambda c, by: F.coalesce(given(F.col(c), kinds[c].simpleString()), given(F.col("__" + by).cast(kinds[c]), kinds[c].simpleString()), F.col(c))
    if "structure" in names:
        new["structure"] = fill("structure", "structure")
    if "building_year" in names:
        missing = hit & given(F.col("building_year"), "int").isNull() & given(F.col("__building_year"), "int").isNotNull()
        new["building_year"], new["building_age"] = (F.when(missing, F.col("__" + c)).otherwise(F.col(c)) for c in ("building_year", "building_age"))
    for kind, fields in FILLED.items():
        for c, by in fields.items():
            if c in kinds and by in names:
                new[c] = F.when(hit & (F.col("listing_type") == kind), fill(c, by)).otherwise(new.get(c, F.col(c)))
    if "building_name" in names:
        new["building_name"] = F.when(F.col("listing_type") == "mansion", F.coalesce(given(F.col("__building_name"), "string"), F.col("building_name"))).otherwise(F.col("building_name"))
    new["detail_fetched_at"] = F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("detail_fetched_at"))
    return rows.withColumns(new).select(*snapshot.columns), counts


def delist(snapshot: DataFrame, cycle: int, now) -> DataFrame:
    """Active listings that the cycle has not seen are delisted."""
    gone = (F.col("status") == "active") & (F.col("crawl_cycle_id") != cycle)
    at = F.lit(now).cast("timestamp")
    return snapshot.withColumns({"delisted_at": F.when(gone, at).otherwise(F.col("delisted_at")), "updated_at": F.when(gone, at).otherwise(F.col("updated_at")), "status": F.when(gone, "delisted").otherwise(F.col("status"))})


def start(cycles: DataFrame, now, resume: bool = True) -> tuple[DataFrame, int, bool]:
    """The cycles with a running one, its id, and whether it goes on from before."""
    last = cycles.where("status = 'running'").agg(F.max("id")).first()[0] if resume else None
    if last is not None:
        return cycles, last, True
    new = (cycles.agg(F.max("id")).first()[0] or 0) + 1
    row = cycles.sparkSession.range(1).select(F.lit(new).cast("long").alias("id"), F.lit(now).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status"), F.lit(None).cast("map<string,bigint>").alias("stats"))
    return cycles.unionByName(row), new, False


def finish(cycles: DataFrame, cycle: int, status: str, stats: dict, now) -> DataFrame:
    mine = F.col("id") == cycle
    known = F.create_map(*(F.lit(x) for k, v in stats.items() for x in (k, int(v)))) if stats else F.lit(None)
    return cycles.withColumns({"status": F.when(mine, status).otherwise(F.col("status")), "finished_at": F.when(mine, F.lit(now).cast("timestamp")).otherwise(F.col("finished_at")), "stats": F.when(mine, known.cast("map<string,bigint>")).otherwise(F.col("stats"))})


def remaining(queries: DataFrame, logs: DataFrame, cycle: int) -> DataFrame:
    """Queries (prefecture, listing_type, is_new) that the cycle has no successful log of; a ban is no success."""
    done = logs.where((F.col("crawl_cycle_id") == cycle) & (F.col("status") == "success"))
    return queries.join(done.select("prefecture", "listing_type", "is_new"), ["prefecture", "listing_type", "is_new"], "left_anti")


def log_rows(counts: DataFrame, pages: DataFrame, cycle: int) -> DataFrame:
    """A log row of each query: pages has prefecture, listing_type, is_new, status (success, failed or banned) and errors by page read."""
    keys = ["prefecture", "listing_type", "is_new"]
    order = F.when(F.max((F.col("status") == "banned").cast("int")) == 1, "banned").when(F.max((F.col("status") == "failed").cast("int")) == 1, "failed").otherwise("success")
    read = pages.groupBy(*keys).agg(F.count("*").alias("total_pages"), F.count_if(F.col("status") != "success").alias("errors"), order.alias("status"))
    names = ["total_items", "new_listings", "updated_listings", "duplicates_skipped"]
    rows = read.join(counts.withColumnRenamed("prefecture_code", "prefecture"), keys, "left")
    return rows.select(F.lit(cycle).cast("long").alias("crawl_cycle_id"), *keys, "total_pages", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names), "errors", "status")


def totals(logs: DataFrame) -> DataFrame:
    """Sums by prefecture, and over all (prefecture null)."""
    names = ["total_items", "new_listings", "updated_listings", "duplicates_skipped", "errors"]
    return logs.rollup("prefecture").agg(*(F.sum(n).alias(n) for n in names))


def status_report(cycles: DataFrame, snapshot: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The n newest cycles with their minutes; and rows, active rows and rows with details by listing type."""
    newest = cycles.orderBy(F.desc("id")).limit(n).withColumn("minutes", S.minutes_between(F.col("started_at"), F.col("finished_at")))
    return newest, snapshot.groupBy("listing_type").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("detail_fetched_at").isNotNull()).alias("detailed"))


def crawl(state: dict[str, DataFrame], found: DataFrame, pages: DataFrame, now, details: DataFrame | None = None, partial: bool = False, threshold: float = 0.5, ceiling: int | None = None, look_up=None) -> dict:
    """One cycle over pages already read: state has cycles, snapshot, history, logs and cache, and comes back as it is afterwards, with stats.

    A ban leaves the cycle running, to be resumed. A partial crawl (some prefectures or types) never delists, and a cycle
    that saw too few of the active listings is suspicious and delists nothing."""
    from .stored import cut

    cycles, cycle, _ = start(state["cycles"], now, resume=True)
    before = state["snapshot"].where("status = 'active'").count()
    rows = below_ceiling(found, ceiling)
    known = state["snapshot"].select(*KEY)
    places, cache = geocoded(rows.join(known, KEY, "left_anti"), state["cache"], look_up)
    places = cut(places)
    snapshot, history, counts = upsert(state["snapshot"], rows, cycle, now, places)
    snapshot, counts = cut(snapshot), cut(counts)
    history = cut(state["history"].unionByName(history))
    fetched = 0
    if details is not None:
        snapshot, got = enrich(snapshot, details, cycle, now)
        snapshot, fetched = cut(snapshot), got.first().fetched
    logs = cut(log_rows(counts, pages, cycle))
    sums = logs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("new_listings", "updated_listings", "duplicates_skipped", "errors"))).first()
    stats = {"new": sums.new_listings, "updated": sums.updated_listings, "duplicates": sums.duplicates_skipped, "errors": sums.errors, "details_fetched": fetched, "delisted": 0}
    seen = snapshot.where(F.col("crawl_cycle_id") == cycle).count()
    status = "running" if not logs.where("status = 'banned'").isEmpty() else "partial" if partial else "suspicious" if seen < before * threshold else "completed_with_errors" if sums.errors else "completed"
    if status.startswith("completed"):
        after = cut(delist(snapshot, cycle, now))
        stats["delisted"] = after.where("status = 'delisted'").count() - snapshot.where("status = 'delisted'").count()
        snapshot = after
    if status != "running":
        cycles = finish(cycles, cycle, status, stats, now)
    return {"cycles": cut(cycles), "snapshot": snapshot, "history": history, "logs": cut(state["logs"].unionByName(logs, allowMissingColumns=True)), "cache": cut(cache), "cycle": cycle, "status": status, "stats": stats, "places": places}


def empty_state(spark) -> dict[str, DataFrame]:
    from ..sinks.tables import SCHEMAS

    none = lambda schema: spark.createDataFrame([], schema)
    return {"cycles": none(SCHEMAS["crawl_cycles"]), "snapshot": none(f"{LISTING}, {DETAILS}"), "history": none(SCHEMAS["price_history"]), "logs": none(SCHEMAS["crawl_logs"]), "cache": none(SCHEMAS["geocode_cache"])}
