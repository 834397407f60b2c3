"""Near-duplicates, line dedup and components against brute force."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kakusu.llm import linededup, neardup
from kakusu.llm.common import words_of
from kakusu.llm.graph import components


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    return sorted((str(d), len(sets[i]), str(min((x for x in least[top(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))


def copies(seed=1, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    base = [word() for _ in range(80)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = word()
        out.append((i, " ".join(w)))
    return out


CASES = [(100, "one two three"), (101, "ONE two\tthree"), (102, "one two"), (103, "one two"), (104, ""), (105, None), (106, "  \n"), (107, "x " * 3000), (108, "x " * 2999), (None, "one two"), (103, "one two"), (109, "émile Zola écrit"), (110, "Émile Zola écrit")]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components(spark, k, percent):
    rows = CASES + copies()
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, n long, node string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.link_components(df, shingle=k, percent=percent).collect())
    assert got == brute(rows, k, percent)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = neardup.link_components(df, shingle=3, percent=85)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute(rows, 3, 85)
    assert got.filter("kept <> (doc_id = component_id)").count() == 0


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "z y x w v u")], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [1, 3]
    assert neardup.link_components(df.limit(0)).count() == 0


def test_keep_one_goes_by_rows_not_ids(spark):
    rows = [(3, "a b c d e f g"), (5, "a b c d e f g"), (5, "q r s t u v w"), (None, "a b c d e f g"), (None, "m n o p q r s"), (7, ""), (8, None), (8, None), (9, " "), (10, "x " * 500_000), (11, "X " * 500_000)]
    df = spark.createDataFrame([(d, t, "k", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _kept_id string, component int")
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), (r.text or "-")[:3]) for r in got.collect()) == [("10", "x x"), ("3", "a b"), ("5", "q r"), ("7", "-"), ("8", "-"), ("9", " "), ("None", "m n")]
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(edges).collect()} == {1}
    assert components(edges.limit(0)).count() == 0


def removed(rows):
    """By id and position: a line goes if an earlier one has Jaccard >= 0.8."""
    lines = [(d, p, {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}) for d, t in sorted(rows) for p, line in enumerate(t.split("\n"))]
    out = {}
    for k, (d, p, s) in enumerate(lines):
        if s and any(e and 5 * len(s & e) >= 4 * len(s | e) and (d, p) != (x, y) for x, y, e in lines[:k]):
            out.setdefault(d, []).append(p)
    return out


def test_lines(spark):
    rng = np.random.default_rng(3)
    rows = [(1, "a b c d e\nA b c d e\n\nz"), (2, "a b c d e f\nx\nx y"), (3, "\n\n"), (4, "z"), (5, "")]
    base = [f"w{i}" for i in range(60)]
    for i in range(10, 40):
        w = list(base)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, 60))] = f"e{rng.integers(0, 1000)}"
        rows.append((i, " ".join(w) + "\n" + " ".join(w[:12]) + f"\nown line {i} of this one {i * 7}"))
    df = spark.createDataFrame([(d, t, 0, "n") for d, t in rows], "doc_id long, text string, n long, cls string")
    got = {r.doc_id: list(r.removed) for r in linededup.line_report(df).collect() if r.n_removed}
    assert got == removed(rows)
    texts = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert texts == {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in got.get(d, [])) for d, t in rows}


def test_lines_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "same line here"), (1, "same line here"), (1, "same line here"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in linededup.line_report(df).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 0, 0), ("None", 1, 0)]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_texts_are_not_dealt_to_find_the_wanted_ones(spark, monkeypatch):
    words = [" ".join(f"w{i * 7 + k}" for k in range(30)) for i in range(40)]
    df = spark.createDataFrame([(i if i != 9 else None, words[i // 2] + (" more" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    plans = []
    keep = neardup.keep
    monkeypatch.setattr(neardup, "keep", lambda d: plans.append((d.columns, d._jdf.queryExecution().executedPlan().toString())) or keep(d))
    assert neardup.link_components(df).filter("kept").count() == 30
    plan = next(p for c, p in plans if c == ["node", "shingles"]).split("\n")
    at = next(i for i, line in enumerate(plan) if "MapInPandas" in line)
    assert not any("Join" in line for line in plan[at + 1 : at + 4])


def test_filter_of_hashes_loses_none(spark, monkeypatch):
    for bits in (1 << 12, 1 << 28):
        monkeypatch.setattr(neardup, "LARGEST", bits)
        monkeypatch.setattr(neardup, "SEGMENT", 1 << 12)
        held = np.array([r.h for r in spark.range(500).select(F.xxhash64("id").alias("h")).collect()])
        found = neardup.hash_filter(spark.range(500).select(F.xxhash64("id").alias("h")))
        other = np.array([r.h for r in spark.range(1000, 11000).select(F.xxhash64("id").alias("h")).collect()])
        assert neardup.may_have(found, held).all() and neardup.may_have(found, other).mean() < (0.2 if bits == 1 << 12 else 0.04)
    assert not neardup.may_have(neardup.hash_filter(spark.range(0).select(F.xxhash64("id").alias("h"))), held).any()


def test_ordered_words_are_plain_numbers(spark):
    ranks = F.split(F.lit(",".join(["1"] * linededup.BUCKETS)), ",").cast("array<bigint>")
    rows = spark.createDataFrame([([512, 256],)], "hs array<long>").select(F.filter("hs", F.isnotnull).alias("hs")).select(linededup._tokens(ranks).alias("toks"))
    assert not rows.schema["toks"].dataType.containsNull
    assert rows.first()["toks"] == [(1 << 56) + 1, (1 << 56) + 2]
