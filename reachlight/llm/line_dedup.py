"""Line dedup by pairwise alignment.

Lines (split further at sentence ends) with a letter or digit are units. Units that stand in several documents are
shared; a run is the shortest stretch of successive shared units, at most GAP units apart, that reaches MIN_BLOCK
words. The document with the smallest id that holds a run is its anchor: the later document loses the run, and each
pair that shares a run, or MIN_BLOCK words of units first seen in one document, is aligned by patience diff over all
units the two share. So pairs grow with the shared runs, not with the square of their groups. Aligned common blocks of
at least MIN_BLOCK words go from the later document. In scripts without spaces two characters count as a word. Null
text and texts without such units stay as they are. Documents are ordered by id, then by the text's hash, a null id
last, and told apart by both; rows equal in both are one document, of which all copies lose the same. Ties go to the
smaller position. Documents that lose every word are dropped; an empty table gives none; other columns stay as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut as stored, ship

#: GAP: units between two of one block that may differ, plus 1. HEAVY: a key with more rows is dealt over SALTS tasks.
MIN_BLOCK, GAP, SALTS, HEAVY = 30, 3, 64, 500
ends = re.compile(r"[.!?](?=[ \t\n])[ \t]*\n?|[。！？][ \t]*\n?|\n").finditer
content = re.compile(r"[^\W_]").search
dense = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]").findall


def units(text: str) -> list[str]:
    """The text in pieces that end with a sentence or a line; they join to the text."""
    stops = [m.end() for m in ends(text)]
    return [text[a:b] for a, b in zip([0, *stops], [*stops, len(text)]) if a < b]


def hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and number of words of each unit with a letter or digit, in the order of `units`."""
    lines, many, low = [], [], text.lower()
    plain = low.isascii()
    for mark in ".!?":
        for gap in " \t":
            low = low.replace(mark + gap, mark + "\n")
    if not plain:
        for mark in "。！？":
            low = low.replace(mark, mark + "\n")
    for u in low.split("\n"):
        w = u.split()
        if w and (w[0][0].isalnum() or content(u)):
            lines.append(xxhash.xxh64_intdigest(" ".join(w)) - (1 << 63) or 1)
            many.append(len(w) if plain or u.isascii() else max(len(w), len(dense(u)) // 2))
    return lines, many


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (own, other) positions that rises in both."""
    tails, where, back = [], [], {}
    for k, (_, o) in enumerate(pairs):
        p = bisect_left(tails, o)
        tails[p : p + 1], where[p : p + 1] = [o], [k]
        back[k] = where[p - 1] if p else -1
    k, out = where[-1] if where else -1, []
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def blocks(line: np.ndarray, pos: np.ndarray, words: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places (of pos) to delete: aligned units in blocks of MIN_BLOCK words. other, at: the earlier document's lines and places.

    The first places of common lines are aligned, then equal neighbours of aligned units, so repeated lines go too.
    """
    none = pos[:0]
    mine, i = np.unique(line, return_index=True)
    theirs, j = np.unique(other, return_index=True)
    _, x, y = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
    if words[np.isin(line, theirs)].sum() < MIN_BLOCK:
        return none
    order = np.argsort(i[x])
    x, y = i[x][order], j[y][order]
    if (np.diff(y) < 0).any():
        x, y = map(np.array, zip(*patience(list(zip(x.tolist(), y.tolist())))))
    if len(mine) < len(line) or len(theirs) < len(other):
        x, y = spread(line, pos, other, at, x.tolist(), y.tolist())
    a, b = pos[x], at[y]
    # A block goes on over GAP - 1 units that differ.
    first = np.flatnonzero(np.concatenate([[True], (np.diff(a) > GAP) | (np.diff(b) > GAP)]))
    size = np.add.reduceat(words[x], first)
    return a[np.repeat(size >= MIN_BLOCK, np.diff([*first, len(a)]))]


def spread(line: np.ndarray, pos: np.ndarray, other: np.ndarray, at: np.ndarray, x: list, y: list) -> tuple[np.ndarray, np.ndarray]:
    """The aligned units with the equal neighbours before and behind each of them."""
    line, pos, other, at = line.tolist(), pos.tolist(), other.tolist(), at.tolist()
    same = lambda p, q, a, b, d: line[p] == other[q] and pos[p] == a + d and at[q] == b + d
    out, low = [], (-1, -1)
    for k, (p, q) in enumerate(zip(x, y)):
        back, d = [], 1
        while p - d > low[0] and q - d > low[1] and same(p - d, q - d, pos[p], at[q], -d):
            back.append((p - d, q - d))
            d += 1
        out += [*back[::-1], (p, q)]
        end, d = (x[k + 1], y[k + 1]) if k + 1 < len(x) else (len(line), len(other)), 1
        while p + d < end[0] and q + d < end[1] and same(p + d, q + d, pos[p], at[q], d):
            out.append((p + d, q + d))
            d += 1
        low = out[-1]
    return tuple(np.array(c) for c in zip(*out))


def slices(batches, rows: int = 500):
    """The batches in small parts, so that few Python values live at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line, pos, words of the units of docs (doc_id, text); pos counts units."""

    def run(batches):
        for batch in slices(batches):
            ids, size, lines, many = batch.column("doc_id").to_numpy(), [], [], []
            for t in batch.column("text").to_pylist():
                h, n = hashes(t)
                size.append(len(h))
                lines += h
                many += n
            size = np.array(size, np.int64)
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            cols = pa.array(np.repeat(ids, size), pa.int64()), pa.array(lines, pa.int64()), pa.array(pos.astype(np.int32)), pa.array(many, pa.int32())
            yield pa.RecordBatch.from_arrays(list(cols), names=["doc_id", "line", "pos", "words"])

    return docs.where("text is not null").mapInArrow(run, "doc_id long, line long, pos int, words int")


def anchored(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands in several documents, with the smallest doc_id that holds it. Rows of common keys are dealt over SALTS tasks on both sides."""
    firsts = rows.groupBy(key).agg(F.min("doc_id").alias("anchor"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("anchor < b")
    firsts = stored(firsts.select(key, "anchor", "n"))
    salted = F.when(F.col("n") > HEAVY, SALTS).otherwise(1)
    heavy = firsts.where(F.col("n") > HEAVY).select(key, F.lit(True).alias("heavy"))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), salted - 1))).drop("n")
    # Keys with more than HEAVY rows are few: at most one in HEAVY rows.
    return rows.join(F.broadcast(heavy), key, "left").withColumn("salt", salt).drop("heavy").join(firsts.hint("shuffle_hash"), [key, "salt"]).drop("salt")


def lists(batch, name: str):
    """The arrays of one list<struct> column, row by row, as numpy arrays by field."""
    col = batch.column(name)
    ends, inner = col.offsets.to_numpy(), col.values
    fields = {f.name: inner.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(inner.type)}
    for a, b in zip(ends[:-1], ends[1:]):
        yield {f: x[a:b] for f, x in fields.items()}


#: Odd, so that powers can be divided out modulo 2**64.
BASE, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs(batches):
    """doc_id, run, pos, last: the shortest runs of shared units from and up to each place; run 0: partners by single units (pos: partner)."""
    up, down = powers(BASE, 1024), powers(BACK, 1024)
    for batch in slices(batches):
        out = []
        for i, x in zip(batch.column("doc_id").to_pylist(), lists(batch, "rows")):
            order = np.argsort(x["pos"], kind="stable")
            line, pos, words = x["line"][order], x["pos"][order], x["words"][order]
            n = len(pos)
            if n > len(up):
                up, down = powers(BASE, 2 * n), powers(BACK, 2 * n)
            top, near = np.concatenate([[0], np.cumsum(words)]), np.concatenate([np.diff(pos) <= GAP, [False]])
            broken = np.flatnonzero(~near)
            stop = broken[np.searchsorted(broken, np.arange(n))]
            place = np.arange(n)
            last, start = np.searchsorted(top, top[:-1] + MIN_BLOCK) - 1, np.searchsorted(top, top[1:] - MIN_BLOCK, "right") - 1
            ahead, behind = last <= stop, start >= 0
            behind[behind] = stop[start[behind]] >= place[behind]
            both = np.unique(np.concatenate([place[ahead] * n + last[ahead], start[behind] * n + place[behind]]))
            a, b = both // max(n, 1), both % max(n, 1)
            # The run's lines as a polynomial, from prefix sums.
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line.view(np.uint64) * up[:n], dtype=np.uint64)])
            run = (total[b + 1] - total[a]) * down[a]
            run = ((run ^ (run >> np.uint64(29))) * np.uint64(BASE) + (b - a).astype(np.uint64)).view(np.int64)
            run[run == 0] = 1
            who, which = np.unique(x["anchor"], return_inverse=True)
            who = who[(np.bincount(which, x["words"]) >= MIN_BLOCK) & (who < i)]
            none = np.zeros(len(who), np.int64)
            out.append((np.full(len(a) + len(who), i), np.concatenate([run, none]), np.concatenate([a, who]), np.concatenate([b, none])))
        cols = [np.concatenate([o[c] for o in out] + [np.zeros(0, np.int64)]).astype(np.int64) for c in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "run", "pos", "last"])


def align(batches):
    """_id, _part: units that go by one pair."""
    for batch in slices(batches):
        ids, out = [], []
        for i, x, y in zip(batch.column("doc_id").to_pylist(), lists(batch, "rows"), lists(batch, "others")):
            p, q = np.argsort(x["pos"], kind="stable"), np.argsort(y["pos"], kind="stable")
            gone = blocks(x["line"][p], x["pos"][p], x["words"][p], y["line"][q], y["pos"][q])
            if len(gone):
                ids.append(i)
                out.append(gone)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["_id", "_part"])


def deletions(docs: DataFrame) -> DataFrame:
    """_id, _gone: the units that each later document loses."""
    shared = anchored(stored(occurrences(docs)), "line")
    # A document's rows are no more than its units. Fewer shared words than a block has give neither runs nor partners.
    shared = shared.groupBy("doc_id").agg(F.collect_list(F.struct("line", "pos", "words", "anchor")).alias("rows"), F.sum("words").alias("total"))
    shared = stored(shared.where(F.col("total") >= MIN_BLOCK).drop("total"))
    found = stored(shared.mapInArrow(runs, "doc_id long, run long, pos long, last long"))
    hits = stored(anchored(found.where("run <> 0"), "run").where("anchor < doc_id"))
    pairs = found.where("run = 0").selectExpr("doc_id", "pos as anchor").unionByName(hits.select("doc_id", "anchor")).distinct()
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # An anchor's units once for each of its salts, so that no task reads all pairs of one anchor.
    others = pairs.select("anchor", "salt").distinct().join(shared.select(F.col("doc_id").alias("anchor"), F.transform("rows", lambda r: F.struct(r["line"].alias("line"), r["pos"].alias("pos"))).alias("others")), "anchor")
    parts = pairs.join(others, ["anchor", "salt"]).join(shared, "doc_id").select("doc_id", "rows", "others").mapInArrow(align, "_id long, _part array<int>")
    # Runs count shared units; their places are looked up in the document's list.
    spans = hits.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "last")).alias("spans")).join(shared, "doc_id").select("doc_id", "rows", "spans")

    def covered(batches):
        for batch in slices(batches):
            ids, out = [], []
            for i, x, s in zip(batch.column("doc_id").to_pylist(), lists(batch, "rows"), lists(batch, "spans")):
                step = np.zeros(len(x["pos"]) + 1, np.int64)
                np.add.at(step, s["pos"], 1)
                np.add.at(step, s["last"] + 1, -1)
                ids.append(i)
                out.append(np.sort(x["pos"])[np.cumsum(step[:-1]) > 0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["_id", "_part"])

    parts = parts.unionAll(spans.mapInArrow(covered, "_id long, _part array<int>"))
    return parts.groupBy("_id").agg(F.array_distinct(F.flatten(F.collect_list("_part"))).alias("_gone"))


def without(text: str, gone: set[int]) -> str:
    """The text without those units; pieces without content go where the units around them went."""
    out, held, k, last, left = [], [], 0, False, False
    for p in units(text):
        if not content(p):
            held.append(p)
            continue
        now = k in gone
        if not (last and now):
            out += held
        if not now:
            out.append(p)
            left = True
        held, last, k = [], now, k + 1
    return "".join(out + held) if left else ""


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a number __row that orders them: the id, or where ids are null or repeated the place by id and text; and the texts of each number once."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = docs.withColumn("__row", F.col("doc_id").cast("long"))
        return rows, rows.select(F.col("__row").alias("doc_id"), "text")
    keys = docs.select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__t")).distinct().orderBy(F.col("__d").asc_nulls_last(), "__t")
    keys = stored(keys.withColumn("__row", F.monotonically_increasing_id()))
    rows = docs.join(keys, docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__t"))).drop("__d", "__t")
    return rows, rows.select(F.col("__row").alias("doc_id"), "text").dropDuplicates(["doc_id"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of the documents, the text without the deleted blocks; documents left without a word are dropped."""
    ship(docs.sparkSession)
    rows, texts = numbered(docs)
    gone = deletions(texts)

    def run(text: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if g is None or t is None else without(t, set(map(int, g))) for t, g in zip(text, gone)], dtype=object)

    # Only texts that lose units go to Python; the filter takes the result and does not compute it again.
    cut = F.pandas_udf(run, "string").asNondeterministic()
    joined = rows.join(gone.hint("shuffle_hash"), F.col("__row") == F.col("_id"), "left")
    some = F.col("_gone").isNotNull()
    done = joined.withColumn("__cut", cut(F.when(some, F.col("text")), "_gone")).withColumn("text", F.when(some, F.col("__cut")).otherwise(F.col("text"))).drop("__cut")
    done = done.where(~some | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*docs.columns)
