"""The pool's order is numbered by ranges, never by one task."""

from __future__ import annotations

from tidebar.operators.search import pool_order


def test_pool_order_by_ranges(spark):
    rows = [(f"f{i % 7}", i, i % 9 == 0, (i * 37 % 50) / 10.0 if i % 11 else None, 4.0 + i % 7) for i in range(3000)]
    d = spark.createDataFrame(rows, "family string, id long, representative boolean, mean double, best_mean double").repartition(4)
    out = pool_order(d)
    got = [r.id for r in out.orderBy("place").collect()]
    value = lambda r: r[4] if r[2] else r[3]
    want = sorted(rows, key=lambda r: (not r[2], value(r) is None, -(value(r) or 0), r[1]))
    assert got == [r[1] for r in want] and [r.place for r in out.orderBy("place").collect()] == list(range(1, 3001))
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
