"""Whole-table queries against brute force on a small table."""

import datetime
import heapq

from reachlight.plans import queries as Q


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path))


def test_edges_of_all_orders(spark, tmp_path):
    rows = [(k, k % 3 + 1, k * 5 % 61 + 1, k * 11 % 23 + 1) for k in range(1, 240)]
    write(spark, tmp_path / "lineitem.parquet", rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long")
    want, near = {}, {}
    for o, n, p, s in rows:
        b = p % 90 + 1
        if s != b:
            e = min(s, b), max(s, b)
            want[e] = min(want.get(e, 1 << 30), n * 10 + o % 7)
    assert {(r.u, r.v): r.length for r in Q.undirected_edges_whole(spark, tmp_path).collect()} == want
    for source in (1, 5, 9):
        heap = [(0, source)]
        while heap:
            x, n = heapq.heappop(heap)
            if (source, n) not in near:
                near[source, n] = x
                for (u, v), length in want.items():
                    if n in (u, v) and x + length <= 40:
                        heapq.heappush(heap, (x + length, v if n == u else u))
    assert {(r.source, r.node): r.dist for r in Q.bounded_sssp_whole(spark, tmp_path).collect()} == near
    marks = {(b, u, v) for b in (15, 30, 40) for u, v in want for s in (1, 5, 9) if max(near.get((s, u), 99), near.get((s, v), 99)) <= b}
    assert {tuple(r) for r in Q.edge_marking_whole(spark, tmp_path).select("band", "u", "v").collect()} == marks


def test_listing_of_all_orders(spark, tmp_path):
    spark.sql("select id as o_orderkey, id % 4 as o_custkey, cast(id div 3 * 10 as double) as o_totalprice, timestamp'2020-01-05' + make_dt_interval(cast(id * 9 as int)) as o_orderdate from range(1, 24)").write.parquet(str(tmp_path / "orders.parquet"))
    months = {}
    for k in range(1, 24):
        m = (datetime.date(2020, 1, 5) + datetime.timedelta(days=k * 9)).replace(day=1)
        months.setdefault(m, {})[k % 4] = float(k // 3 * 10)
    want, old = set(), {}
    for c, m in enumerate(sorted(months), 1):
        new = months[m]
        for k in old.keys() | new.keys():
            a, b = old.get(k), new.get(k)
            want.add((c, k, a, b, "new" if a is None else "delisted" if b is None else "updated" if a != b else "same"))
        old = new
    assert {(r.cycle, r.o_custkey, r.old_value, r.new_value, r.state) for r in Q.listing_upsert_cycles(spark, tmp_path).collect()} == want
