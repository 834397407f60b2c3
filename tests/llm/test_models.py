"""Language, quality and language-model scores: held-out accuracy, brute force, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kakusu.llm import langid, quality, queries, suffixtree
from kakusu.llm.common import words_of

ODD = [(900001, None), (900002, ""), (900003, "123 !? \n"), (900004, "a" * 60_000), (900004, "a" * 60_000), (None, "the text")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = spark.createDataFrame([(d, t, None, "s", 0, "x") for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score string")
    return spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").withColumn("score", F.lit("x")).unionByName(rows)


def test_language(spark, docs):
    got = langid.identify(docs).toPandas()
    assert len(got) == docs.count()
    own = got[got.doc_id.isin([900001, 900002, 900003])]
    assert set(own.lang_pred) == {"und"}
    held = got[got.lang.notna() & [zlib.crc32(str(int(d)).encode()) % 5 == 0 if d == d else False for d in got.doc_id]]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.lang_score.between(0, 1).all()


def test_language_knows_nothing_without_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).first()[-2:] == ("und", 0.0)
    assert langid.identify(df.limit(0)).count() == 0


def test_family_comes_first():
    x = np.eye(4)[[0, 1, 2, 3] * 5] + 0.01
    m = langid.Identifier(x, np.array(["en", "de", "fr", "xx"] * 5))
    assert m.families.classes == ["germanic", "romance", "xx"] and m.within[0].classes == ["de", "en"]
    assert m.predict(x[:4])[0] == ["en", "de", "fr", "xx"]


def test_quality(spark, sf, docs):
    labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    got = quality.score_quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got.quality_score.between(0, 1).all()
    assert ((got.quality_score >= 0.3).astype(int) == got.quality_predicted).all()
    truth = labels.toPandas().set_index("doc_id").quality
    held = got[[d == d and zlib.crc32(str(int(d)).encode()) % 5 == 0 and d in truth.index for d in got.doc_id]]
    y = truth.loc[held.doc_id.astype(int)].to_numpy()
    s = held.quality_score.to_numpy()
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() > 0.95
    assert (held.quality_predicted.to_numpy()[y == 1] == 1).mean() > 0.97


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(df, labels).first().quality_score == 0.5
    assert quality.score_quality(df.limit(0), labels).count() == 0


def moments(x):
    b = np.hstack([np.ones((len(x), 1)), x])
    return quality.Moments((b.T @ b).ravel())


def test_prior_is_found():
    rng = np.random.default_rng(0)
    pos = rng.normal(2, 1, (3000, 3))
    unl = np.concatenate([rng.normal(2, 1, (2100, 3)), rng.normal(-2, 1, (900, 3))])
    w = quality.separate(moments(pos), moments(unl))
    above = lambda x: ((np.hstack([np.ones((len(x), 1)), x]) @ w)[None, :] > quality._CUTS[:, None]).mean(axis=1)
    assert abs(quality.prior_of_tails(above(pos), above(unl), 3000, 3000) - 0.7) < 0.06


@pytest.mark.parametrize("prior", [0.5, 0.95])
def test_risk_is_non_negative_and_least(prior):
    """The minimum is no worse than the unbiased one and than many others, by the risk computed row by row."""
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1.5, 1, (800, 2)), rng.normal(-1.5, 1, (800, 2))
    p, u = (np.hstack([np.ones((len(x), 1)), x]) for x in (pos[:400], np.concatenate([pos[400:], neg[:400]])))

    def risk(w):
        part = lambda b, sign: ((1 - sign * (b @ w)) ** 2 / 4).mean()
        return prior * part(p, 1) + max(0, part(u, -1) - prior * part(p, -1))

    w = quality.minimise(moments(pos[:400]), moments(np.concatenate([pos[400:], neg[:400]])), prior)
    assert all(risk(w) <= risk(w + d) + 5e-3 for d in rng.normal(0, 0.1, (500, 3)))
    if prior == 0.5:
        assert (1 + p @ w).mean() / 2 > 0.8 and (1 + np.hstack([np.ones((800, 1)), neg]) @ w).mean() / 2 < 0.2


def test_quality_of_odd_rows(spark):
    rows = [(i, "good words in a sentence. " * (i % 7 + 1)) for i in range(60)] + [(i, "$$ !! 99 " * (i % 5 + 1)) for i in range(60, 120)] + [(None, None), (None, ""), (5, "dup"), (5, "dup"), (200, "long text " * 120_000)]
    df = spark.createDataFrame([(d, t, 0.5, "n", 3) for d, t in rows], "doc_id long, text string, quality_score double, quality_predicted string, x int")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] * 2, "doc_id long, quality int")
    got = quality.keep_good(df, labels)
    assert got.columns == df.columns and {r.quality_predicted for r in got.collect()} == {"n"}
    scored = quality.score_quality(df.drop("quality_score"), labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.quality_score <= 1 for r in scored)


def brute_tree(train, depth, least, close):
    """Score of a text by dictionaries of contexts, straight from the definition."""
    after = {}
    for t in train:
        symbols = b"\n" * depth + suffixtree.stream(words_of(t))
        for i in range(depth, len(symbols)):
            for k in range(depth + 1):
                after.setdefault(symbols[i - k : i], Counter())[symbols[i]] += 1
    after = {c: n for c, n in after.items() if not c or sum(n.values()) >= least}

    def p(context, symbol):
        n, up = after[context], p(context[1:], symbol) if context else 1 / 256
        return (n[symbol] + len(n) * up) / (sum(n.values()) + len(n))

    states = set()
    for c, n in after.items():
        total = sum(n.values())
        if len(c) <= close or sum(k * math.log(k / total / p(c[1:], s)) for s, k in n.items()) > len(n) + 2:
            states |= {c[i:] for i in range(len(c) + 1)}

    def log(context, symbol):
        if context not in states:
            return log(context[1:], symbol) if context else math.log10(1 / 256)
        n = after[context]
        if n[symbol]:
            return math.log10(p(context, symbol))
        rest = math.log10(len(n) / (sum(n.values()) + len(n)))
        return rest + (log(context[1:], symbol) if context else math.log10(1 / 256))

    def score(text):
        symbols = b"\n" * depth + suffixtree.stream(words_of(text))
        return sum(log(symbols[i - depth : i], symbols[i]) for i in range(depth, len(symbols)))

    return score


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_scores_as_by_definition(spark, block_bytes):
    rng = np.random.default_rng(4)
    words = ["abra", "cadabra", "été", "the", "thesis", "\u65e5\u672c", "x"]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 40)))) for _ in range(60)] + ["", None, "only here quixotry", "the " * 3000]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 5 + [(3, "another text")]
    got = suffixtree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    score = brute_tree([t or "" for d, t in rows if fold(d)], suffixtree.DEPTH, suffixtree.LEAST, suffixtree.CLOSE)
    key = lambda r: (str(r[0]), round(r[1], 2))
    assert np.allclose(*([x[1] for x in sorted(v, key=key)] for v in ([(r.doc_id, r.score) for r in got], [(d, score(t or "")) for d, t in rows])), rtol=1e-5)


def test_tree_is_a_distribution():
    keys, counts = suffixtree._tally(suffixtree.runs(b"\n" * 4 + b"abra cadabra abracadabra " * 20, 4))
    short = suffixtree.Levels(*suffixtree._tally(keys & suffixtree._low(3), counts), 0, 2, 2)
    tree = suffixtree.Levels(keys, counts, 3, 4, 2, short)
    for context in (b"abra", b"ra c", b"zzzz", b"\n\n\n\n"):
        runs = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], dtype=np.uint64)
        assert math.isclose((10 ** tree.walk(runs)).sum(), 1, rel_tol=1e-4)


def test_rare_contexts_stay_in_a_large_corpus(spark):
    words = "concat_ws(' ', transform(sequence(1, 4000), i -> substr(md5(concat(id, '-', i)), 1, 4)))"
    filler = spark.range(320).selectExpr("id as doc_id", words + " as text")  # over 6 million symbols
    few = spark.createDataFrame([(1000 + i, "quixotry") for i in range(8)], "doc_id long, text string")
    got = suffixtree.score_documents(filler.union(few)).filter("doc_id >= 1000").collect()
    assert len(got) == 8 and all(r.score > -7 for r in got)


def test_scores_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixtree.score_documents(df).count() == 0


def test_queries_have_their_columns(spark, sf):
    wanted = {
        "op2_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op3_quality_pu": {"doc_id", "held_out", "score", "predicted"},
        "op9_suffix_tree_scores": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    }
    for name, columns in wanted.items():
        assert columns <= set(queries.QUERIES[name](spark, sf).columns)


def test_runs_are_asked_in_turns_and_never_kept(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(suffixtree, "keep", lambda df, keep=suffixtree.keep: kept.append(df.columns) or keep(df))
    texts = [(i, f"abra cadabra {i % 7} the thesis {i}") for i in range(40)] + [(3, None), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    scores = [sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in suffixtree.score_documents(df, block_bytes=300, turns=n).collect()) for n in (1, 2, 3)]
    assert scores[0] == scores[1] == scores[2] and not any("bucket" in c for c in kept)  # requests are several times the input
    symbols, sizes = b"\n" * 7 + b"abra cadabra\n" + b"\n" * 6 + b"\n" + b"\n" * 6 + b"thesis\n" + b"\n" * 6, np.array([13, 1, 7])
    each = [suffixtree._Turn(7, 2, 4, k, 2).runs(symbols, sizes)[0].tolist() for k in range(2)]
    assert all(each) and sorted(each[0] + each[1]) == sorted(suffixtree._Turn(7, 2, 4, 0, 1).runs(symbols, sizes)[0].tolist()) and len(each[0] + each[1]) == 21


def test_runs_of_any_depth():
    text = bytes(range(250, 256)) + b"abra cadabra"
    for depth in (0, 3, 7):
        want = [int.from_bytes(text[i - depth : i + 1], "big") for i in range(depth, len(text))]
        assert suffixtree.runs(text, depth).tolist() == want and len(suffixtree.runs(text[:depth], depth)) == 0


def test_numbers_are_ordered_hashed_and_packed_as_they_are():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)[rng.integers(0, 5000, 20000)]
    assert (suffixtree._order(keys) == np.argsort(keys, kind="stable")).all()
    words = [b"a", b"ab", b"b" * suffixtree.PLACES, b"c" * 65, b"c" * 66, "é".encode(), b"ba", b"a"] * 3
    hashes = suffixtree.tabulated(b"\n\n" + b" ".join(words[:5]) + b"\n\n\n" + b" ".join(words[5:]) + b"\n")
    assert len(hashes) == len(words) and [len({hashes[i] for i in range(len(words)) if words[i] == w}) for w in words] == [1] * len(words)
    assert len(set(hashes.tolist())) == len(set(words)) and len(suffixtree.tabulated(b"\n\n")) == 0
    for values in (np.unique(keys), np.ones(1000, dtype=np.int64), np.zeros(3, dtype=np.int64), np.array([-1.5, 0], dtype=np.float32), np.empty(0, dtype=np.uint64)):
        ascending = values.dtype == np.uint64
        assert (suffixtree._loosen(suffixtree._squeeze(values, ascending), values.dtype, ascending) == values).all()
