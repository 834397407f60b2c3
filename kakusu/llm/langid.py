"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

A text is a bag of hashed runs of one to three letters (case folded, everything else a gap). One set of one-versus-one
machines separates families; for each family with several languages a second set separates these. Training draws a bounded
number of rows for each language by the hash of their id; prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, fresh, need

#: About so many training rows for each language, drawn by hash; and the number of features.
PER_LANGUAGE = 600
_DRAWS = 1 << 30
WIDTH = 4096
#: Families of languages by their codes, fixed values; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "bn", "mr", "gu", "pa", "ne", "ur", "sd"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "sinitic": ("zh", "yue", "wuu"),
    "austronesian": ("id", "ms", "tl", "jv"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_TABLE: list[np.ndarray] = []


def _letters(text: str) -> np.ndarray:
    """Code points of the folded text; what is no letter is one gap (32)."""
    if not _TABLE:
        low = (chr(i).lower()[0] if chr(i).isalpha() else " " for i in range(0xD800))
        high = (chr(i).lower()[0] if chr(i).isalpha() else " " for i in range(0xE000, 0x10000))
        _TABLE.append(np.array([*map(ord, low), *[32] * 0x800, *map(ord, high)], dtype=np.uint32))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(code) and code.max() > 0xFFFF:
        code = np.array([c if c <= 0xFFFF or chr(c).isalpha() else 32 for c in code.tolist()], dtype=np.uint32)
        out = np.where(code <= 0xFFFF, _TABLE[0][np.minimum(code, 0xFFFF)], code)
    else:
        out = _TABLE[0][code]
    out = np.concatenate([[32], out, [32]]).astype(np.uint32)
    return out[np.concatenate([[True], (out[1:] != 32) | (out[:-1] != 32)])]


def bag(text: str | None) -> np.ndarray | None:
    """Square roots of the counts of letter runs, of length 1; None for a text without letters."""
    code = _letters(text) if text else np.empty(0, dtype=np.uint32)
    if len(code) < 3:
        return None
    spread = np.uint32(0x9E3779B1)
    one = code * spread
    two = (one[:-1] ^ (code[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (code[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    x = np.zeros(WIDTH)
    for h in (one, two, three):
        x += np.bincount(h >> np.uint32(20), minlength=WIDTH)
    x = np.sqrt(x)
    return x / np.sqrt((x * x).sum())


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 120) -> np.ndarray:
    """Weights (the last one is the bias) of a squared-hinge linear SVM, by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1 / (1e-3 + 2 * cost * float((weight * (x * x).sum(axis=1)).sum()))
    w = np.zeros(x.shape[1])
    at, before = w, w
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ at))
        w = at - rate * (1e-3 * at - 2 * cost * ((weight * slack * y) @ x))
        at = w + (t - 1) / (t + 2) * (w - before)
        before = w
    return w


class OneVersusOne:
    """Linear machines for all pairs of classes; a class's score is the mean of its machines' probabilities."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = np.zeros((len(self.pairs), x.shape[1] + 1))
        for k, (a, b) in enumerate(self.pairs):
            some = (y == self.classes[a]) | (y == self.classes[b])
            self.weights[k] = linear_svm(x[some], np.where(y[some] == self.classes[a], 1.0, -1.0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)))
        if not self.pairs:
            return out + 1
        p = 1 / (1 + np.exp(-np.clip(4 * (x @ self.weights[:, :-1].T + self.weights[:, -1]), -30, 30)))
        for k, (a, b) in enumerate(self.pairs):
            out[:, a] += p[:, k]
            out[:, b] += 1 - p[:, k]
        return out / (len(self.classes) - 1)


class Identifier:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([_FAMILY.get(c, c) for c in langs])
        self.families = OneVersusOne(x, family)
        self.within = [OneVersusOne(x[family == f], langs[family == f]) for f in self.families.classes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        first = self.families.scores(x)
        chosen = first.argmax(axis=1)
        langs, score = np.empty(len(x), dtype=object), first.max(axis=1)
        for k, machines in enumerate(self.within):
            if (rows := chosen == k).any():
                second = machines.scores(x[rows])
                langs[rows] = np.array(machines.classes, dtype=object)[second.argmax(axis=1)]
                score[rows] *= second.max(axis=1)
        return list(langs), np.clip(score, 0, 1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, per_language: int = PER_LANGUAGE) -> Identifier | None:
    """Learns from rows with a language and letters outside fold 0; None if there are none."""
    train = docs.filter(F.col(lang_col).isNotNull() & (fold_of(F.col(id_col), folds) != 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("lang"), id_col, text_col).alias("h"))
    rows = train.select("lang", "h").distinct()
    share = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))  # one row for each language
    drawn = rows.join(share, "lang").filter(F.pmod("h", F.lit(_DRAWS)) < F.col("share") * _DRAWS).select("h").distinct()
    texts = train.join(F.broadcast(drawn), "h")  # about per_language numbers for each language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            once = batch.drop_duplicates(["lang", "h"])
            rows = [(lang, h, b.astype(np.float16).tobytes()) for lang, h, b in zip(once["lang"], once["h"], map(bag, once["text"])) if b is not None]
            yield pd.DataFrame(rows, columns=["lang", "h", "x"])

    sample = texts.mapInPandas(run, "lang string, h long, x binary").dropDuplicates(["lang", "h"]).orderBy("lang", "x").select("lang", "x").toPandas()
    if sample.empty:
        return None
    x = np.stack([np.frombuffer(b, dtype=np.float16) for b in sample["x"]]).astype(np.float64)
    return Identifier(x, sample["lang"].to_numpy())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1).

    ``und`` with score 0 for texts that are null or have no letter, and for all texts if nothing can be learned. Only the
    text is used for prediction. Equal scores: the family, then the language of smaller name. Repeated rows agree and are
    learned from once. Columns of ``docs`` with the names of the two new ones are replaced. Empty tables: no rows.
    """
    need(docs, id_col, text_col, lang_col)
    model = fit(docs, id_col, text_col, lang_col, folds, per_language)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        for k in range(0, len(texts), 256):
            bags = {k + i: b for i, t in enumerate(texts[k : k + 256]) if (b := bag(t)) is not None}
            if bags and model:
                found, score = model.predict(np.stack(list(bags.values())))
                for i, lang, s in zip(bags, found, score):
                    langs[i], scores[i] = lang, s
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    (p,) = fresh(docs, "_p")
    return docs.withColumn(p, predict(F.col(text_col))).select(*(docs[c] for c in docs.columns if c not in ("lang_pred", "lang_score")), F.col(f"{p}.lang_pred").alias("lang_pred"), F.col(f"{p}.score").alias("lang_score"))
