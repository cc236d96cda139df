"""Sharding over fixed virtual slots, DataFrame functions only.

Records hash by id and text checksum into VIRTUAL slots. Bytes are summed by slot; a versioned map sends slots to shards: version 1
deals slots in turn, rebalancing edits it by the measured bytes, and each version is stored. Assignments are read from
the stored map. So law `bytes` holds: shards differ by less than a slot of the fullest. Under law `key` slots depend on
doc_id alone and the map on the shard count, and growing by one moves slots only into the new shard. Null text: size 1,
crc of the empty text. Null ids hash like any value; repeated rows all stay; extra columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, shared, texts

VIRTUAL = 4096


def virtual_slot(*keys):
    return F.pmod(F.xxhash64(*(F.coalesce(F.col(k), F.lit(-1)) for k in keys)), F.lit(VIRTUAL)).cast("int")


def slot_map(shards: int, version: int = 1) -> dict:
    """Version 1 for the given count: slots dealt in turn."""
    return {"version": version, "shards": shards, "slots": [v % shards for v in range(VIRTUAL)]}


def grown(m: dict) -> dict:
    """The next version with one more shard: every shard gives the new one an equal part of its slots."""
    n, left, slots = m["shards"], {}, list(m["slots"])
    share = VIRTUAL // (n + 1)
    take = {s: share // n + (s < share % n) for s in range(n)}
    for v, s in enumerate(slots):
        if left.setdefault(s, 0) < take[s]:
            left[s] += 1
            slots[v] = n
    return {"version": m["version"] + 1, "shards": n + 1, "slots": slots}


def rebalanced(m: dict, weights: dict[int, int]) -> dict:
    """The next version: slots go from the fullest to the emptiest shard while one of them is lighter than the gap."""
    slots, held = list(m["slots"]), [[] for _ in range(m["shards"])]
    for v, w in sorted(weights.items()):
        if w > 0:
            insort(held[slots[v]], (w, v))
    load = [sum(w for w, _ in h) for h in held]
    while True:
        hi, lo = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
        gap, fits = load[hi] - load[lo], held[hi]
        # The slot nearest to half the gap; each move lowers the sum of squares, so this ends.
        k = bisect_left(fits, (gap / 2, -1))
        near = [fits[i] for i in (k - 1, k) if 0 <= i < len(fits) and fits[i][0] < gap]
        if not near:
            return {"version": m["version"] + 1, "shards": m["shards"], "slots": slots}
        w, v = min(near, key=lambda x: (abs(x[0] - gap / 2), x))
        held[hi].remove((w, v))
        insort(held[lo], (w, v))
        slots[v], load[hi], load[lo] = lo, load[hi] - w, load[lo] + w


def records(docs: DataFrame, law: str = "bytes") -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row."""
    rows = texts(docs).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", virtual_slot("doc_id") if law == "key" else virtual_slot("doc_id", "text_crc32"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """virtual_slot, rows and bytes of each slot."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def save_map(spark, m: dict, path: str) -> None:
    """Stores a version beside the others; storing it again replaces it."""
    spark.createDataFrame([(m["shards"], v, s) for v, s in enumerate(m["slots"])], "shards int, virtual_slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={m['version']}")


def map_table(spark, path: str, version: int) -> DataFrame:
    """virtual_slot and shard of a stored version."""
    return spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard")


def load_map(spark, path: str, version: int | None = None) -> dict:
    """A stored version, the latest by default."""
    if version is None:
        version = spark.read.parquet(path).agg(F.max("version")).first()[0]
    rows = spark.read.parquet(f"{path}/version={version}").collect()
    return {"version": version, "shards": rows[0].shards, "slots": [r.shard for r in sorted(rows, key=lambda r: r.virtual_slot)]}


def shard(docs: DataFrame, shards: int = 8, law: str = "key", path: str | None = None) -> DataFrame:
    """Each row's shard, its place there (slot, gapless from 0) and, under law `key`, its shard after growth by one.

    The map's versions are stored under path (by default a new folder): 1 as dealt, 2 as rebalanced or grown."""
    spark = docs.sparkSession
    path = path or shared(spark, "slot-map")
    rows = cut(records(docs, law))
    # VIRTUAL rows at most.
    weights = {r.virtual_slot: r.bytes for r in slot_bytes(rows).collect()}
    save_map(spark, slot_map(shards), path)
    first = load_map(spark, path, 1)
    save_map(spark, grown(first) if law == "key" else rebalanced(first, weights), path)
    now, later = map_table(spark, path, 1 if law == "key" else 2), map_table(spark, path, 2).withColumnRenamed("shard", "grown_shard")
    rows = rows.join(F.broadcast(now), "virtual_slot")
    rows = rows.join(F.broadcast(later), "virtual_slot") if law == "key" else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    # Places: offsets of the few thousand virtual slots, then ranks within each slot, so no task sees a whole shard.
    offset = rows.groupBy("shard", "virtual_slot").agg(F.count("*").alias("n")).select("virtual_slot", (F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n")).alias("offset"))
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")))
    return placed.join(F.broadcast(offset), "virtual_slot").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard", "virtual_slot")
