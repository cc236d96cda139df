"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters within e edits of a text region shares at least m - q + 1 - q*e q-grams with it, on diagonals
no more than 2e apart. q-grams are counted in overlapping diagonal bands; regions that meet the bound are verified by
banded alignment. Items too short for that bound match exactly, on
word borders. Each region of a text is reported with its traced start; of regions that overlap the one of fewest edits,
then the leftmost. Null and empty texts or items match nothing; items without letters or digits match nothing; repeated
items and rows each report, null ids stay null; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, texts

Q, BUDGET = 6, 0.12
#: Items below this length match exactly.
LEAST_CHARS = 24
#: Most bytes of items that one index holds; more items are taken in further passes.
INDEX_BYTES = 16_000_000
MULT = np.uint64(0x9E3779B97F4A7C15)
squeeze = re.compile(r"[\W_]+").sub
#: The same rule by byte, for texts within Latin-1.
LATIN = bytes(32 if squeeze("", chr(b)) == "" else b for b in range(256))


def normal(text: str | None) -> str:
    low = (text or "").lower()
    try:
        return b" ".join(low.encode("latin-1").translate(LATIN).split()).decode("latin-1")
    except UnicodeEncodeError:
        return squeeze(" ", low).strip()


def grams(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h = (h + c[k : k + n]) * MULT
    return h ^ (h >> np.uint64(29))


class Postings:
    """q-gram hash -> (item, position)."""

    def __init__(self, h: np.ndarray, item: np.ndarray, pos: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.keys, self.first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        # First key of each leading 22 bits, or -1; keys are sorted, so the others of a cell follow it.
        cell, first, run = np.unique((self.keys >> np.uint64(42)).astype(np.int64), return_index=True, return_counts=True)
        self.cell = np.full(1 << 22, -1, np.int32)
        self.cell[cell] = first
        self.steps = int(run.max(initial=1)) - 1

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text, and entries of the postings."""
        k = self.cell[(h >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(k >= 0)
        k, h = k[at], h[at]
        for _ in range(self.steps):
            k = np.minimum(k + (self.keys[k] < h), len(self.keys) - 1)
        ok = self.keys[k] == h
        at, k = at[ok], k[ok]
        many = self.many[k]
        return np.repeat(at, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[k], many)


class Index:
    def __init__(self, items: list[tuple[int, str]]):
        found = [(i, s) for i, s in ((i, normal(t)) for i, t in items) if s]
        self.items = [x for x in found if len(x[1]) >= LEAST_CHARS]
        # Short items by their number of words.
        self.short: dict[int, dict[tuple, list]] = {}
        for i, s in found:
            if len(s) < LEAST_CHARS:
                self.short.setdefault(s.count(" ") + 1, {}).setdefault(tuple(s.split(" ")), []).append(i)
        self.edits = np.array([min(int(BUDGET * len(s)), (len(s) - Q) // Q) for _, s in self.items], np.int64)
        self.bound = np.array([len(s) - Q + 1 - Q * e for (_, s), e in zip(self.items, self.edits.tolist())], np.int64)
        self.longest = max((len(s) for _, s in self.items), default=0)
        parts = [grams(s) for _, s in self.items]
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        pos = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, int)
        self.full = Postings(h, item, pos)
        # An item's most common q-grams, fewer than the bound, wait for the second count; the bound falls by their number.
        _, same, often = np.unique(h, return_inverse=True, return_counts=True)
        order = np.lexsort((-often[same], item))
        start = np.cumsum([0, *(len(p) for p in parts)])[:-1]
        late = np.zeros(len(h), bool)
        late[order] = np.arange(len(h)) - start[item[order]] < (self.bound // 2)[item[order]]
        self.rare, self.rare_bound = Postings(h[~late], item[~late], pos[~late]), self.bound - self.bound // 2

    def bands(self, h: np.ndarray, table: Postings, bound: np.ndarray, only: np.ndarray | None = None):
        """(items, bands) whose hits meet the bound, and all hits (item, place, position, band). A band takes in the hits of its upper neighbour, so that bands overlap."""
        place, flat = table.hits(h)
        item = table.item[flat]
        enough = np.bincount(item, minlength=len(self.items)) >= bound
        enough = (enough if only is None else enough & only)[item]
        if not enough.any():
            none = np.zeros(0, np.int64)
            return none, none, (none, none, none, none)
        item, place, pos = item[enough], place[enough], table.pos[flat[enough]]
        band = np.floor_divide(place - pos, 2 * self.edits[item] + 1)
        wide = len(h) + Q + self.longest + 2
        cell, hits = np.unique(item * wide + band + self.longest + 1, return_counts=True)
        upper, lone = np.zeros(len(cell), np.int64), np.ones(len(cell), bool)
        upper[:-1], lone[1:] = np.where(cell[1:] == cell[:-1] + 1, hits[1:], 0), cell[1:] != cell[:-1] + 1
        cell, hits = np.concatenate([cell, cell[lone] - 1]), np.concatenate([hits + upper, hits[lone]])
        good = np.sort(cell[hits >= bound[cell // wide]])
        return good // wide, good % wide - self.longest - 1, (item, place, pos, band)

    def exact(self, text: str) -> list[tuple[int, int, int, int]]:
        """Short items in the text's normal form."""
        out, words = [], text.split(" ")
        start = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        for n, known in self.short.items():
            for k in range(len(words) - n + 1):
                for i in known.get(tuple(words[k : k + n]), ()):
                    out.append((i, start[k], start[k + n] - 1, 0))
        return out

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of each region, offsets in the normal form of the text."""
        text = normal(text)
        out = self.exact(text) if self.short and text else []
        h = grams(text)
        if not len(h) or not self.items:
            return sorted(out)
        some, _, _ = self.bands(h, self.rare, self.rare_bound)
        if not len(some):
            return sorted(out)
        only = np.zeros(len(self.items), bool)
        only[some] = True
        some, bands, (item, place, pos, band) = self.bands(h, self.full, self.bound, only)
        regions: dict[int, set] = {}
        # Hits by item and band, so that each band looks at its own only.
        by = np.lexsort((band, item))
        item, place, pos, band = item[by], place[by], pos[by], band[by]
        wide = int(band.max(initial=0) - band.min(initial=0)) + 3
        flat = item * wide + band - band.min(initial=0)
        for i, b in zip(some.tolist(), bands.tolist()):
            # Each q-gram of the item, and each place of the text, counts once.
            at = i * wide + b - int(band.min(initial=0))
            x, y = np.searchsorted(flat, [at, at + 2])
            x = max(x, int(np.searchsorted(item, i)))
            if min(len(np.unique(pos[x:y])), len(np.unique(place[x:y]))) < self.bound[i]:
                continue
            s, e = self.items[i][1], int(self.edits[i])
            w = 2 * e + 1
            low, high = max(0, b * w - e), min(len(text), (b + 2) * w + len(s) + e)
            if got := align(s, text[low:high], e):
                regions.setdefault(i, set()).add((got[2], low + got[0], low + got[1]))
        for i, found in regions.items():
            taken = []
            for e, x, y in sorted(found):
                if all(y <= p or x >= q for p, q in taken):
                    taken.append((x, y))
                    out.append((self.items[i][0], x, y, e))
        return sorted(out)


def distances(a: np.ndarray, b: np.ndarray, edits: int, free: bool) -> np.ndarray | None:
    """Edits between a and each beginning of b (free: from any start), or None if all need more; a band of diagonals."""
    step, big = np.arange(len(b) + 1), len(a) + len(b)
    wide = len(b) - len(a) + edits if free else edits
    row = np.zeros(len(b) + 1, np.int64) if free else step.copy()
    for i, c in enumerate(a, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (b != c))
        low, high = max(0, i - edits), min(len(b), i + max(0, wide))
        new[:low], new[high + 1 :] = big, big
        row = np.minimum.accumulate(new - step) + step
        if row.min() > edits:
            return None
    return row


def align(item: str, region: str, edits: int) -> tuple[int, int, int] | None:
    """The item within the region, ends of the region free: (start, end, edits), or None if it needs more edits.

    The leftmost end of fewest edits, and of the starts that give them the one that fits the item's length best."""
    if (p := region.find(item)) >= 0:
        return p, p + len(item), 0
    a, b = (np.frombuffer(x.encode("utf-32-le", "replace"), "<u4") for x in (item, region))
    row = distances(a, b, edits, True)
    if row is None:
        return None
    end, need = int(row.argmin()), int(row.min())
    # Backwards from the end, where the item must start with it.
    back = distances(a[::-1], b[max(0, end - len(a) - edits) : end][::-1], edits, False)
    sizes = np.flatnonzero(back == need)
    return end - int(sizes[np.abs(sizes - len(a)).argmin()]), end, need


#: Indexes that a worker keeps between tasks, by the items' digest.
_kept: dict[str, Index] = {}


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row per document and region of an item found in it.

    Items are taken in passes of INDEX_BYTES at most, one after another, so that the driver and each worker hold the
    items of one pass only."""
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 + int(total) // (INDEX_BYTES // 2)
    if passes == 1:
        return one_pass(docs, bench)
    out = None
    for k in range(passes):
        part = cut(one_pass(docs, bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)))
        out = part if out is None else out.unionAll(part)
    return out


def one_pass(docs: DataFrame, bench: DataFrame) -> DataFrame:
    items = sorted((tuple(r) for r in bench.collect()), key=str)
    mark = hashlib.sha256(repr(items).encode("utf-8", "replace")).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        from reachlight.llm import decontaminate as here

        if mark not in here._kept:
            here._kept.clear()
            here._kept[mark] = here.Index(sent.value)
        index = here._kept[mark]
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for x in index.find(t)]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "end", "edits"])

    return texts(docs).mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows without the leaking ones; all columns stay. Rows of one doc_id go together; null ids are judged as one id."""
    gone = leaks(docs, bench).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__leak")), "left_anti")
