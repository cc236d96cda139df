"""MinHash near-dedup with b-bit signatures.

A document's set holds its distinct word shingles; texts with fewer words have their whole sequence as one shingle,
texts without words an empty set that links with nothing. Rows with equal sets are one class, whatever their ids.
Classes meet in buckets of band keys. Each is first compared with its bucket's most central class, then, while that
merges components, with a few hashed members of that one's component and the most central class outside it; classes that are still in different components are
compared within their buckets, each pair in its first common bucket only, so no link between components is lost.
Candidates pass the packed b-bit estimate (bit counts, corrected for chance collisions) before links are confirmed on
full sets, which travel once for each pair of blocks of a neighbourhood, not once for each pair of documents. Null text
counts as empty; rows with a null doc_id link like others and take the smallest id they reach (null if none), kept
false; repeated rows give repeated rows, rows that share an id but not the text are told apart; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, ship

#: Bands of ROWS minima give candidates; ESTIMATE minima of BITS bits each give estimates, for candidates alone.
ROWS, BANDS, BITS, ESTIMATE = 4, 24, 4, 512
HASHES = ROWS * BANDS
#: The estimate may fall short of the threshold by this much (five standard errors) before a candidate goes.
MARGIN = 0.083
#: Rounds against a few members of the largest neighbours' component before components are compared with each other.
TURNS, CENTRES = 3, 4
#: Bytes and rows of one block of sets.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 256
_rng = np.random.default_rng(7)
MULTS, MASKS = _rng.integers(1, 1 << 32, (ESTIMATE, 1), dtype=np.uint32) | np.uint32(1), _rng.integers(0, 1 << 32, (ESTIMATE, 1), dtype=np.uint32)
U = np.uint64


class Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def shingles(text: str, k: int, memo: Words) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, U(k))
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(31)
    return np.unique(out)


def minima(s: np.ndarray, many: int) -> np.ndarray:
    """The least values of the set under the first `many` hash functions."""
    low = np.full(many, np.iinfo(np.uint32).max, np.uint32)
    short = (s >> U(32)).astype(np.uint32)[None, :]
    mults, masks = MULTS[:many], MASKS[:many]
    for i in range(0, len(s), 512):
        x = short[:, i : i + 512] ^ masks
        x *= mults
        np.minimum(low, x.min(1), out=low)
    return low.astype(np.uint64)


def band_keys(s: np.ndarray) -> np.ndarray:
    low = minima(s, HASHES)
    key = np.arange(BANDS, dtype=np.uint64) + U(1)
    for r in range(ROWS):
        key = (key ^ low[r::ROWS]) * U(0xD6E8FEB86659FD93)
        key ^= key >> U(32)
    return key.view(np.int64)


def planes(s: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed by bit plane."""
    low = minima(s, ESTIMATE)
    bits = np.packbits(((low[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & U(1)).astype(np.uint8), axis=1)
    return np.ascontiguousarray(bits).view(">i8").reshape(-1).astype(np.int64)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a key that tells texts with one doc_id apart."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


LONGS = pa.list_(pa.int64())


def lists(arrays: list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


def parts(batches, rows: int = 500):
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n, set_key and band keys of each row."""

    def run(batches):
        memo, none = Words(), np.zeros(0, np.int64)
        for batch in parts(batches):
            found = [shingles(t, k, memo) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.string()), lists([band_keys(s) if len(s) else none for s in found])],
                names=["doc_id", "text_key", "n", "set_key", "bands"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, text_key long, n long, set_key string, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, n, planes and the full set of the wanted classes (rep, doc_id, text_key)."""
    ids = wanted.select("rep", F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"))
    got = texts(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t"))).select("rep", "text")

    def run(batches):
        memo = Words()
        for batch in parts(batches):
            found = [shingles(t, k, memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array([len(s) for s in found], pa.int64()), lists([planes(s) for s in found]), lists([s.view(np.int64) for s in found])], names=["rep", "n", "planes", "shingles"]
            )

    # Rows repeated with id and text give their class twice; a class is needed once.
    return got.mapInArrow(run, "rep long, n long, planes array<long>, shingles array<long>").dropDuplicates(["rep"])


def similar(a: str, b: str) -> str:
    """SQL of the estimate: share of equal b-bit values, corrected for chance."""
    per = ESTIMATE // 64
    words = [" | ".join(f"({a}[{p * per + w}] ^ {b}[{p * per + w}])" for p in range(BITS)) for w in range(per)]
    equal = f"({ESTIMATE} - " + " - ".join(f"bit_count({w})" for w in words) + f") / {float(ESTIMATE)}"
    return f"(({equal}) - {2.0**-BITS}) / {1 - 2.0**-BITS}"


def confirm(num: int, den: int):
    def run(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Links that join components of this group of pairs; pairs already joined need no test."""
        held, root, out = dict(zip(rows["rep"], rows["shingles"])), {}, []

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
            if (p := find(a)) != (q := find(b)):
                x, y = held[a], held[b]
                i = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if den * i >= num * (len(x) + len(y) - i):
                    root[p] = q
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def block_pair(a: str, b: str) -> Column:
    """One key for a pair of blocks (home and salt), whichever of the two comes first."""
    x, y = (F.struct(F.col("home" + s).alias("home"), F.col("salt" + s).alias("salt")) for s in (a, b))
    return F.xxhash64(F.least(x, y), F.greatest(x, y)).alias("at")


def confirmed(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Links among estimated pairs (a, b, at) that span the pairs' components; full: rep and shingles."""
    used = pairs.select(F.col("at").alias("of"), F.col("a").alias("rep")).union(pairs.select("at", "b")).distinct()
    return pairs.groupBy("at").cogroup(used.join(full.select("rep", "shingles"), "rep").groupBy("of")).applyInPandas(confirm(num, den), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, root: smallest reachable id, by alternating large and small stars; ids without links are absent."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = mark(edges)
    while last[0]:
        two = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = two.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")


def rooted(rows: DataFrame, roots: DataFrame, name: str = "rep", out: str = "root") -> DataFrame:
    """rows with the root of their class; a class without links is its own."""
    return rows.join(roots.select(F.col("id").alias(name), F.col("root").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after further links, which are first drawn between the roots so far."""
    if roots is None:
        return cut(components(links))
    between = rooted(rooted(links, roots, "a", "ra"), roots, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    more = cut(components(between))
    old = rooted(roots.withColumnRenamed("root", "mid"), more, "mid", "root").select("id", "root")
    return cut(old.unionByName(more.join(roots.select("id"), "id", "left_anti")))


def mixed(slots: DataFrame, roots: DataFrame) -> DataFrame:
    """Slots, with roots, of the buckets that hold several components."""
    rows = rooted(slots, roots)
    keys = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    return rows.join(keys, "key", "left_semi")


def classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n, rep; rep null: empty set), and the root of each linked class (id, root)."""
    sig = cut(sets(docs, k))
    reps = sig.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("bands").alias("bands"))
    # The numbers are read back from the written table, so they do not change when a task runs again.
    reps = cut(reps.select("set_key", "first.doc_id", "first.text_key", "bands", F.monotonically_increasing_id().alias("rep")))
    rows = sig.select("doc_id", "text_key", "n", "set_key").join(reps.select("set_key", "rep"), "set_key", "left").drop("set_key")
    slots = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    slots = cut(slots.join(slots.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"))
    # A class of many large buckets is in the middle of its neighbourhood; it stands for all of them.
    slots = cut(slots.join(slots.groupBy("rep").agg(F.sum("m").alias("weight")), "rep").drop("m"))
    centre = slots.groupBy("key").agg(F.max(F.struct("weight", "rep")).alias("c"))
    star = cut(slots.join(centre, "key").select("rep", "c"))
    home = star.groupBy("rep").agg(F.max("c")["rep"].alias("home"))
    full = full_sets(docs, reps.join(home, "rep"), k).join(home, "rep")
    full = cut(full)
    size = full.groupBy("home").agg(F.ceil(F.greatest(F.sum(F.col("n") * 8) / BLOCK_BYTES, F.count("*") / BLOCK_ROWS)).alias("blocks"))
    full = cut(full.join(size, "home").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("blocks"))
    least = num / den - MARGIN

    side = lambda rows, s, names: rows.select(*(F.col(c).alias(c + s) for c in names))
    about = ("rep", "n", "planes", "home", "salt")

    def estimated(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side(full, "x", about), F.col("a") == F.col("repx")).join(side(full, "y", about), F.col("b") == F.col("repy"))
        near = near.where(f"{den} * least(nx, ny) >= {num} * greatest(nx, ny) and {similar('planesx', 'planesy')} >= {least}")
        return cut(near.select("a", "b", block_pair("x", "y")))

    pairs = star.select(F.col("rep").alias("a"), F.col("c.rep").alias("b")).where("a <> b").distinct()
    roots = merged(None, cut(confirmed(estimated(pairs), full, num, den)))
    open_ = cut(mixed(slots, roots))
    for turn in range(TURNS):
        # In each bucket some members of the centre's component and the most central one of another, against all others
        # of other components.
        main = open_.groupBy("key").agg(F.max_by("root", F.struct("weight", "rep")).alias("main"))
        of = open_.join(main, "key")
        some = of.where("root = main").groupBy("key").agg(F.array_distinct(F.array(*(F.min_by(F.struct("rep", "root"), F.xxhash64("rep", F.lit(turn * CENTRES + c))) for c in range(CENTRES)))).alias("some"))
        other = of.where("root <> main").groupBy("key").agg(F.max(F.struct("weight", "rep", "root")).alias("c"))
        met = open_.join(some.join(other, "key"), "key").withColumn("c", F.explode(F.concat("some", F.array(F.struct("c.rep", "c.root")))))
        pairs = met.where("root <> c.root").select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()
        links = cut(confirmed(estimated(pairs), full, num, den))
        if links.isEmpty():
            break
        roots = merged(roots, links)
        open_ = cut(mixed(open_.drop("root"), roots))
    # What is left is compared across components, each pair in its first common bucket.
    rest = open_.select("key", "band", "rep", "root").join(full.select(*about), "rep").join(reps.select("rep", "bands"), "rep")
    rest = cut(rest)
    l, r = side(rest, "x", ("key", "band", "root", "bands", *about)), side(rest, "y", ("key", "root", "bands", *about))
    first = "array_position(zip_with(bandsx, bandsy, (p, q) -> p = q), true) = bandx + 1"
    near = f"repx < repy and rootx <> rooty and {den} * least(nx, ny) >= {num} * greatest(nx, ny) and {similar('planesx', 'planesy')} >= {least} and {first}"
    pairs = l.join(r, F.col("keyx") == F.col("keyy")).where(near)
    links = cut(confirmed(cut(pairs.select(F.col("repx").alias("a"), F.col("repy").alias("b"), block_pair("x", "y"))), full, num, den))
    return rows, roots if links.isEmpty() else merged(roots, links)


def with_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, n, node (the component; null: empty set) of each row."""
    rows, roots = classes(docs, k, num, den)
    return cut(rooted(rows, roots, "rep", "node"))


def near_components(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a link needs den * intersection >= num * union."""
    rows = with_components(docs, k, num, den)
    low = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    out = rows.join(low, "node", "left").withColumn("component_id", F.coalesce("low", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component (the smallest id, then the smallest text key), all rows without words; all columns stay.

    Rows equal in id and text are one document: one of them stays. An id of null comes last.
    """
    rows = with_components(docs, k, num, den).where("node is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = rows.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("many")).where("many > 1")
    both = rows.join(first, "node")
    same = order == F.col("first")
    gone = both.where(~same).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct()
    twice = both.where(same).groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).agg(F.count("*").alias("many")).where("many > 1").select("_d", "_t")
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_t"))
    twice = cut(twice)
    left = docs.join(gone, on, "left_anti")
    if twice.isEmpty():
        return left
    return left.join(twice, on, "left_anti").unionByName(docs.join(twice, on).dropDuplicates(["_d", "_t"]).select(*docs.columns))
