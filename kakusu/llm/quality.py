"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the other side is all web text, whatever its label. The class prior among that
text is estimated from both, and a linear function g of a fixed non-linear basis minimises the non-negative unbiased risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

with squared loss, so (1 + g) / 2 estimates the probability of being good. Negatives are never used as such. With this loss the
risk depends on both sides' first and second moments of the basis only: Spark sums them over all training rows, without any
sample, and the driver solves for the few weights. Scoring reads every text as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fold_of, fresh, keep, need

#: Units of the basis, and where tails are read to estimate the prior.
UNITS = 64
_CUTS = np.linspace(-2, 2, 401)
_RUN = re.compile(rb"([^\w\s])\1")
_LONE = re.compile(rb"(?:^|\s)[^\w\s\x80-\xff]+(?=\s|$)")
_BYTES = np.arange(256)
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT, _SPACE, _HIGH = (_BYTES >= 48) & (_BYTES <= 57), (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)), _BYTES >= 128
_STOP = np.isin(_BYTES, list(b".,;:?!'\"()-"))
_SIGN = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _STOP)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _STOP, _SIGN, _BYTES == 10, _BYTES == 33, _BYTES == 124]).astype(float).T


def features(text: str | None) -> list[float]:
    """What a text looks like: shares of kinds of characters, repetition, word shape. Zeros for a null or empty text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digit, space, high, stop, sign, line, bang, bar = counts @ _CLASSES / n
    share = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    kinds = len(set(words))
    lines = raw.split(b"\n")
    return [
        np.log1p(n), upper, lower, digit, space, high, stop, sign, line, bang, bar,
        upper / max(1e-9, upper + lower + high),
        float(-(share * np.log(share)).sum()),
        np.log1p(len(words)), kinds / m, np.log1p(kinds) / np.log1p(m),
        sum(map(eq, words, words[1:])) / m,
        sum(map(eq, words, words[2:])) / m,
        len(raw) / m,
        len(_RUN.findall(raw)) / m,
        len(_LONE.findall(raw)) / m,
        len(set(lines)) / len(lines),
        raw.count(b".") / m,
    ]


class Basis:
    """Standardised features, and tanh units of fixed random directions of them."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.axes, self.shift = rng.normal(0, 0.5, (len(mean), UNITS)), rng.normal(0, 1, UNITS)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z / 4, np.tanh(z @ self.axes + self.shift)])


class Scorer:
    """g and with it a score from 0 to 1."""

    def __init__(self, basis: Basis, weights: np.ndarray, prior: float):
        self.basis, self.weights, self.prior = basis, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((1 + self.basis(x) @ self.weights) / 2, 0, 1)


class Moments:
    """Mean of the basis and of its products over some rows."""

    def __init__(self, sums: np.ndarray):
        d = int(np.sqrt(len(sums)))
        self.n, self.second = sums[0], sums.reshape(d, d) / max(1.0, sums[0])  # the basis begins with 1
        self.first = self.second[0]


def _ridge(pos: Moments) -> np.ndarray:
    return max(0.01, 10 / max(1.0, pos.n)) * np.eye(len(pos.first))


def separate(pos: Moments, unl: Moments) -> np.ndarray:
    """Weights that tell the two samples apart by least squares, each with half the weight."""
    return np.linalg.solve((pos.second + unl.second) / 2 + _ridge(pos), (pos.first - unl.first) / 2)


def prior_of_tails(above_pos: np.ndarray, above_unl: np.ndarray, n_pos: float, n_unl: float) -> float:
    """Share of positives among the unlabelled: the least ratio of both tails, with its sampling error."""
    ok = above_pos >= 0.1
    p, u = above_pos[ok], above_unl[ok]
    slack = np.sqrt(u * (1 - u) / n_unl) + np.sqrt(p * (1 - p) / n_pos)
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def minimise(pos: Moments, unl: Moments, prior: float, rounds: int = 60) -> np.ndarray:
    """Weights of least non-negative risk.

    That risk is the greater of the unbiased risk and of its positive part alone, both quadratic and convex. Its minimum is the
    unbiased risk's if the negative part is not below 0 there; else both are equal there, and it minimises a mean of the two,
    whose weight is found by bisection.
    """
    negative = lambda w: (1 + 2 * unl.first @ w + w @ unl.second @ w - prior * (1 + 2 * pos.first @ w + w @ pos.second @ w)) / 4
    ridge = _ridge(pos)

    def least(share: float) -> np.ndarray:
        products = share * unl.second + (1 - share) * prior * pos.second
        return np.linalg.solve(products + ridge, (1 + share) * prior * pos.first - share * unl.first)

    low, high = 0.0, 1.0
    if negative(least(1.0)) < 0:
        for _ in range(rounds):
            low, high = (low, mid) if negative(least(mid := (low + high) / 2)) < 0 else (mid, high)
    return np.round(least(high), 9)


def _summed(rows: DataFrame, vector) -> np.ndarray:
    """Sum of ``vector`` (of a batch's features) over all rows: every task adds up its own first, Spark adds the tasks'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                some = vector(np.frombuffer(b"".join(batch["x"]), dtype=np.float64).reshape(len(batch), -1))
                total = some if total is None else total + some
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    found = rows.select("x").mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # as long as the vector
    return np.array([r["v"] for r in found])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> Scorer | None:
    """Learns from all rows outside fold 0; None if there are fewer than four on either side."""
    train = fold_of(F.col(id_col), folds) != 0
    good = labels.filter((F.col(label_col) == 1) & train).select(F.col(id_col).alias("good_id")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "half": batch["half"], "x": [np.array(features(t)).tobytes() for t in batch["text"]]})

    some = docs.filter(train).select(F.col(id_col).cast("string").alias("doc_id"), F.pmod(F.xxhash64(id_col, text_col), F.lit(2)).alias("half"), F.col(text_col).alias("text"))
    unl = keep(some.mapInPandas(run, "doc_id string, half long, x binary"))
    pos = keep(unl.join(good, F.col("doc_id") == F.col("good_id").cast("string"), "left_semi"))
    try:
        plain = _summed(unl, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
        if not len(plain) or plain[0] < 4 or pos.limit(4).count() < 4:
            return None
        mean, square = plain[1:].reshape(2, -1) / plain[0]
        basis = Basis(mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6)
        products = lambda x: (lambda b: (b.T @ b).ravel())(basis(x))
        u = Moments(_summed(unl, products))
        halves = [_summed(pos.filter(F.col("half") == k), products) for k in (0, 1)]
        if min(map(len, halves)) == 0:
            halves = [h if len(h) else np.zeros(len(basis(mean[None, :])[0]) ** 2) for h in halves]
        p = Moments(halves[0] + halves[1])
        split = halves[0][0] > 1 and halves[1][0] > 1  # the separator learns from one half, tails are read from the other
        w = separate(Moments(halves[0]) if split else p, u)
        above = lambda x: (basis(x) @ w > _CUTS[:, None]).sum(axis=1)
        tail = lambda rows, n: _summed(rows, above) / n
        n_pos = halves[1][0] if split else p.n
        prior = prior_of_tails(tail(pos.filter("half = 1") if split else pos, n_pos), tail(unl, u.n), n_pos, u.n)
        return Scorer(basis, minimise(p, u, prior), prior)
    finally:
        drop(unl)
        drop(pos)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) and ``quality_predicted`` (1 if the score reaches ``threshold``).

    Only the text is scored, as a whole; a null text counts as empty. Without trusted positives every score is 0.5. Repeated rows
    get equal scores, and each counts in training; rows keep their columns (those of the two new names are replaced). Empty
    tables: no rows.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    net = fit(docs, labels, id_col, text_col, label_col, folds)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if net is None or texts.empty:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(net.score(np.array([features(t) for t in texts])))

    return docs.withColumn("quality_score", score(F.col(text_col))).withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all its columns, whatever their names, and repeated rows stay as they are.

    Null and empty texts are scored like any other; without trusted positives nothing is rejected. Empty tables: no rows.
    """
    taken = {c: f"{c}_" for c in ("quality_score", "quality_predicted") if c in docs.columns}
    if taken:  # set the document's own columns aside
        names = dict(zip(taken, fresh(docs, *taken.values())))
        held = docs.withColumnsRenamed(names)
        return keep_good(held, labels, id_col, text_col, **options).withColumnsRenamed({v: k for k, v in names.items()})
    return score_quality(docs, labels, id_col, text_col, **options).filter("quality_predicted = 1").select(*docs.columns)
