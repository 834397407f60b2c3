"""The interval join against all pairs, and its plan."""

import random

from kakusu.operators.overlaps import overlapping_pairs


def test_pairs_once_at_any_width(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), rng.choice("AB"), (s := rng.randrange(60)), s + rng.randrange(25), "x") for _ in range(120)] + [(3, "A", 0, 900, "x"), (3, "B", 899, 1000, "x"), (3, "B", 900, 901, "x")]
    rows = list(set(rows))
    df = spark.createDataFrame(rows, "doc_id long, entity_type string, start long, end long, _a0 string")
    less = lambda a, b: (a[2], a[3], a[1]) < (b[2], b[3], b[1])
    want = sorted(((a[0], *a[1:4], *b[1:4]) for a in rows for b in rows if a[0] == b[0] and less(a, b) and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]), key=repr)
    for width in (1, 7, 256):
        assert sorted(map(tuple, overlapping_pairs(df, "doc_id", width=width).collect()), key=repr) == want
    assert (3, "A", 0, 900, "B", 899, 1000) in want
    assert overlapping_pairs(df.limit(0), "doc_id").collect() == []
    plan = overlapping_pairs(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
