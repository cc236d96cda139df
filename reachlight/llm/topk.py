"""Exact top-k inner products by MaxScore, over shards of vectors.

Dimensions are terms; a shard holds one posting per row and term, kept by term. Per term and shard the least and the
greatest contribution to each query are known. Terms in falling order of their spread are essential until the rest
could not lift a row with least essential contributions to the query's threshold. Essential postings are scored for all
rows; the other terms are probed only for rows whose bound still reaches the threshold; shards whose bound is below it
are skipped. Thresholds rise from shard to shard, and the shards' lists are merged. Queries go out in blocks of bounded
size, one after another; vectors are read in place and never copied or shuffled.

Vectors that are null or hold null or non-finite components take no part; ties go to the smaller id; repeated rows count
as rows, and a query leaves out one row equal to itself in id and vector (its own); fewer than k rows give all. Vectors
of other lengths than the query's are no match. Scores are exact below 2**53. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, ship

#: Rows of a shard; rows that set the first threshold; bytes of queries in one block.
SHARD, FIRST, BLOCK_BYTES = 2048, 256, 4_000_000
#: One in so many pairs left makes probing cheaper than scoring all.
SPARSE = 64


class Best:
    """The best k + 1 rows of each query so far, a query's own row among them."""

    def __init__(self, Q: np.ndarray, ids: np.ndarray, k: int):
        self.Q, self.ids, self.k = Q, ids, k + 1
        self.q, self.id, self.score, self.same = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64, bool))
        self.floor = np.full(len(Q), -np.inf)

    def add(self, X: np.ndarray, xid: np.ndarray) -> None:
        for a, b in [(0, FIRST), *((i, i + SHARD) for i in range(FIRST, len(X), SHARD))]:
            if len(X[a:b]):
                self.shard(np.ascontiguousarray(X[a:b].T), xid[a:b])

    def shard(self, T: np.ndarray, xid: np.ndarray) -> None:
        """T: terms by rows, a term's postings in one line."""
        Q = self.Q
        x, y = Q * T.min(1), Q * T.max(1)
        low, high = np.minimum(x, y), np.maximum(x, y)
        active = np.flatnonzero(high.sum(1) >= self.floor)
        if not len(active):
            return
        order = np.argsort(-(high - low)[active].mean(0), kind="stable")
        low, high, floor, q = low[active][:, order], high[active][:, order], self.floor[active], Q[active][:, order]
        # Most that a row can score whose first e terms contribute their least.
        unseen = np.concatenate([high.sum(1, keepdims=True), high.sum(1, keepdims=True) + np.cumsum(low - high, 1)], 1)
        e = int(np.where((unseen < floor[:, None]).any(1), (unseen < floor[:, None]).argmax(1), len(order)).max())
        part = q[:, :e] @ T[order[:e]]
        # While many rows stay competitive, all are scored on the next terms; then the few that remain are probed.
        while True:
            passed = part >= (floor - high[:, e:].sum(1))[:, None]
            if e >= len(order) or np.count_nonzero(passed) <= part.size // SPARSE:
                break
            part += q[:, e : e + 16] @ T[order[e : e + 16]]
            e = min(e + 16, len(order))
        who, row = np.nonzero(passed)
        score = part[who, row]
        for s in range(e, len(order), 16):
            more = order[s : s + 16]
            score = score + np.einsum("ij,ji->i", q[who, s : s + 16], T[np.ix_(more, row)])
            stays = score + high[who, s + 16 :].sum(1) >= floor[who]
            who, row, score = who[stays], row[stays], score[stays]
        # Of many rows that pass, a partition leaves the best (and their equals).
        who, own = active[who], xid[row] == self.ids[active[who]]
        own[own] = (T[:, row[own]].T == Q[who[own]]).all(1)
        q, id_, score, same = np.concatenate([self.q, who]), np.concatenate([self.id, xid[row]]), np.concatenate([self.score, score]), np.concatenate([self.same, own])
        by = np.lexsort((id_, -score, q))
        q, id_, score, same = q[by], id_[by], score[by], same[by]
        first = np.searchsorted(q, np.arange(len(Q)))
        place = np.arange(len(q)) - first[q]
        top = place < self.k
        self.q, self.id, self.score, self.same = q[top], id_[top], score[top], same[top]
        full = place == self.k - 1
        self.floor[q[full]] = score[full]


def vectors(emb: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    ok = F.expr("embedding is not null and size(embedding) > 0 and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return emb.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrices(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows by terms) of a batch for each length of its vectors."""
    ids, col = batch.column("vec_id").to_numpy(), batch.column("v")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    ends, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    return [(ids[at := np.flatnonzero(size == n)], flat[ends[at][:, None] + np.arange(n)]) for n in np.unique(size).tolist()]


def block_top(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best rows of one bounded block of queries: query (place in the block), query_id, vec_id, score, same."""
    sent = rows.sparkSession.sparkContext.broadcast(matrices(queries.toArrow()))

    def run(batches):
        best = {Q.shape[1]: Best(Q, ids, k) for ids, Q in sent.value}
        for batch in batches:
            for xid, X in matrices(batch):
                if X.shape[1] in best:
                    best[X.shape[1]].add(X, xid)
        for n, b in best.items():
            cols = b.q + (n << 32), b.ids[b.q], b.id, b.score.astype(np.int64), b.same
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["query", "query_id", "vec_id", "score", "same"])

    return rows.mapInArrow(run, "query long, query_id long, vec_id long, score long, same boolean")


def top_k(emb: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose id divides by `every`, against all other rows."""
    ship(emb.sparkSession)
    rows = vectors(emb)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    size = asked.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0
    blocks, out = 1 + int(size) // BLOCK_BYTES, None
    for b in range(blocks):
        part = block_top(rows, asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b), k).withColumn("block", F.lit(b))
        part = cut(part) if blocks > 1 else part
        out = part if out is None else out.unionAll(part)
    by = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    top = out.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1)
    # The first row equal to the query is its own; those behind it move up.
    own = F.min(F.when(F.col("same"), F.col("place"))).over(Window.partitionBy("block", "query"))
    top = top.withColumn("own", F.coalesce(own, F.lit(k + 2))).where("place <> own")
    return top.select("query_id", (F.col("place") - (F.col("place") > F.col("own")).cast("int")).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


SQL = """
with v as (select vec_id, row_number() over () as r, [floor(256 * x::double) for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, q.r, v.vec_id, list_inner_product(q.e, v.e)::bigint as score from v q join v on q.r <> v.r where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (select query_id, vec_id, score, row_number() over (partition by query_id, r order by score desc, vec_id)::int as rank from s) where rank <= 5"""
