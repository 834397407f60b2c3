"""Neighbours, fingerprints, licenses and mixing against brute force."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kakusu.llm import ann, fingerprint, licenses, mixing


def exact(rows, near, asks):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if asks(i):
            scored = sorted((-float(v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w))), j) for j, w in good if j != i)
            out[i] = [j for _, j in scored[:near]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [1e3 * x for x in rows[5][1]])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, tree int")
    got = ann.search(df, F.expr("vec_id % 50 = 0"), block=64).toPandas()
    want = exact(rows, 5, lambda i: i % 50 == 0)
    found = got.sort_values("rank").groupby("query_id").vec_id.agg(list).to_dict()
    assert set(found) == set(want) and (got.groupby("query_id")["rank"].agg(list).map(lambda r: r == [1, 2, 3, 4, 5])).all()
    assert sum(len(set(found[k]) & set(want[k])) for k in want) / (5 * len(want)) >= 0.9
    assert found[1050] == [0, 1000, 1001, 1002, 1003]


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 2.0])], kind), F.lit(True)).count() == 0
    got = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0])], kind), F.lit(True)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == [(0, 1, 1, 0.8), (1, 1, 0, 0.8)]


def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "  CAFÉ  x"), (-2, "café X"), (-3, None), (-4, "")], "doc_id long, text string"))
    got = fingerprint.fingerprint_edits(docs).toPandas().set_index("doc_id")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got.loc[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(fingerprint.canonical(t) == fingerprint.canonical(edited)), float(fingerprint.canonical(t) == fingerprint.canonical(after)))
    assert got.fingerprint[-1] == got.fingerprint[-2] and got.fingerprint[-3] == got.fingerprint[-4]
    assert got.fingerprint.nunique() == len({fingerprint.canonical(t) for _, t in rows})


def test_fingerprints_of_odd_tables(spark):
    kind = "doc_id long, text string"
    assert fingerprint.fingerprint_edits(spark.createDataFrame([], kind)).count() == 0
    one = fingerprint.fingerprint_edits(spark.createDataFrame([(1, "abcdef")], kind)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    assert fingerprint.fingerprint_edits(spark.createDataFrame([(None, "x"), (3, None), (3, "abc"), (None, None)], kind)).count() == 4


def test_equal_hashes_of_different_bytes_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "aaa")], "doc_id long, text string")
    base = spark.createDataFrame([(1, "0" * 32), (2, "0" * 32), (3, "0" * 32)], "doc_id long, hash string")
    real = fingerprint._hash

    def shared(monkey):
        return fingerprint._shared_hashes(docs, base, "text").collect()

    assert shared(real) == []  # the bytes' own hashes differ from the made-up one


def test_licenses(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    apache = licenses.TEMPLATES["Apache-2.0"]
    more = [(-1, None), (-2, ""), (-3, apache), (-4, "word " * 500 + apache.replace("express or implied", "either way") + " word" * 500), (-5, "released under the mit license"), (-6, "released under the license"), (-7, licenses.TEMPLATES["MIT"][:120])]
    more += [(-8, "Re-leased under the MIT Li-cense."), (-9, "Released un\u00adder the MIT Li\u00adcense"), (-10, "*Released* under the **MIT Lic**ense"), (-11, "x " * 400_000 + apache)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("license", F.lit("mine"))
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    want = set()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    held = {k: grams(licenses.plain(t)) for k, t in licenses.TEMPLATES.items()}
    for r in docs.collect():
        g = grams(licenses.plain(r.text or ""))
        want |= {(r.doc_id, k) for k, t in held.items() if len(t & g) >= 0.8 * len(t)}
    assert got == want and (-4, "Apache-2.0") in got and {(d, "MIT-notice") for d in (-5, -8, -9, -10)} | {(-11, "Apache-2.0")} <= got
    assert licenses.collision(0.8) > 0.9999
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def water_fill(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full = set()
    while True:
        rest, total = share * sum(sizes.values()) - sum(cap * sizes[n] for n in full), sum(w[n] for n in names if n not in full)
        t = {n: cap * sizes[n] if n in full else rest * w[n] / total for n in names}
        over = {n for n in names if n not in full and t[n] > cap * sizes[n]}
        if not over:
            return t
        full |= over


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(-1, "a b c", None), (-2, None, "src1"), (-3, "", "src2"), (-4, "x", "zzz"), (-4, "x", "zzz"), (-5, "w " * 9000, "src3")], "doc_id long, text string, source string")
    docs = docs.unionByName(odd).withColumn("mix", F.lit(1)).withColumn("n", F.lit("n"))
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == docs.count() and got.mix_copies.between(0, 2).all()
    words = got.text.map(lambda t: len((t or "").replace("\x1c", "x").encode().split()))
    assert (got.mix_size == words).all()
    by = got.assign(source=got.source.fillna("\U0010ffff"), taken=got.mix_copies * got.mix_size).groupby("source")
    sizes, targets, taken = by.mix_size.sum().to_dict(), by.mix_target.first().to_dict(), by.taken.sum().to_dict()
    want = water_fill({k: int(v) for k, v in sizes.items()}, (5, 2, 1), 1.5, 2.0)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - targets[s]) <= max(3, 0.01 * targets[s])
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    key = ["doc_id", "mix_copies", "mix_size"]
    pd.testing.assert_frame_equal(got[key].sort_values(key, ignore_index=True), again[key].sort_values(key, ignore_index=True))
    assert mixing.apply_mix(docs).count() == got.mix_copies.sum()


def test_mixing_of_odd_tables(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], kind)).count() == 0
    got = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], kind)).collect()
    assert [(r.mix_copies, r.mix_target) for r in got] == [(0, 0.0), (0, 0.0)]
    one = mixing.mix_sources(spark.createDataFrame([(i, "w w", "a") for i in range(4)], kind)).collect()
    assert sorted(r.mix_copies for r in one) == [1, 1, 2, 2]


def test_mixing_leaves_other_columns_alone(spark):
    rows = [(i, "w " * (i % 9), ["a", "b", None][i % 3], f"s{i}", i, "x", i) for i in range(60)] + [(7, "w w", "a", "t", 1, "y", 2)] * 3 + [(None, None, "b", "n", 0, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _source string, mix_size long, _order string, c0 int")
    got = mixing.mix_sources(df)
    assert {r._source for r in got.collect()} == {r[3] for r in rows} and got.columns.count("mix_size") == 1 and got.count() == len(rows)
    taken = mixing.apply_mix(df)
    assert taken.columns == df.columns
    assert all((r._source, r._order, r.c0, r.mix_size) in {(x[3], x[5], x[6], x[4]) for x in rows} for r in taken.collect())
