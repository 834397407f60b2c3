"""Evaluation: precision, recall, F1, acceptance and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Acceptance of each label: least F1 and recall; and of all labels together: least F1. Fixed values.
CRITERIA = (("PERSON", 0.90, 0.85), ("ADDRESS", 0.85, 0.80), ("ORGANIZATION", 0.85, 0.80), ("DATE_OF_BIRTH", 0.80, 0.75), ("BANK_ACCOUNT", 0.80, 0.75))
OVERALL_F1 = 0.88
_KEYS = ["doc_id", "start", "end", "label"]


def ratios(df: DataFrame) -> DataFrame:
    """p, r, f from tp, pred, gold; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    df = df.withColumn("p", ratio("tp", "pred")).withColumn("r", ratio("tp", "gold"))
    return df.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def match_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``label, tp, pred, gold``: exact matches of span and label; both are (doc_id, start, end, label), repeats count once."""
    g = gold.select(*_KEYS).distinct().withColumn("g", F.lit(1))
    p = pred.select(*_KEYS).distinct().withColumn("p", F.lit(1))
    both = g.join(p, _KEYS, "full")
    one = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    return both.groupBy("label").agg(one(F.col("g") * F.col("p")).alias("tp"), one(F.col("p")).alias("pred"), one(F.col("g")).alias("gold"))


def per_type(counts: DataFrame) -> DataFrame:
    return ratios(counts).select("label", "p", "r", "f")


def overall(counts: DataFrame) -> DataFrame:
    """Micro-averaged over all labels."""
    return ratios(counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "pred", "gold")))).select("p", "r", "f")


def criteria(spark) -> DataFrame:
    return spark.createDataFrame(list(CRITERIA), "label string, f1_min double, recall_min double")


def acceptance(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """``label, f, r, f1_min, recall_min, accepted, status``: OK, R_LOW (before FAIL) or FAIL; missing labels score 0."""
    rows = wanted.join(scores.select("label", "f", "r"), "label", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("f", "r")})
    low, short = F.col("r") < F.col("recall_min"), F.col("f") < F.col("f1_min")
    return rows.select("label", "f", "r", "f1_min", "recall_min", (~low & ~short).alias("accepted"), F.when(low, "R_LOW").when(short, "FAIL").otherwise("OK").alias("status"))


def verdict(accepted: DataFrame, total: DataFrame) -> DataFrame:
    """One row ``labels_pass, overall_pass, passed``."""
    labels = accepted.agg(F.coalesce(F.bool_and("accepted"), F.lit(True)).alias("labels_pass")).withColumn("one", F.lit(1))
    whole = total.select((F.col("f") >= OVERALL_F1).alias("overall_pass")).withColumn("one", F.lit(1))
    return labels.join(whole, "one").select("labels_pass", "overall_pass", (F.col("labels_pass") & F.col("overall_pass")).alias("passed"))


def false_positive_rate(p: Column) -> Column:
    return F.when(F.coalesce(p, F.lit(0.0)) > 0, 1 - p).otherwise(F.lit(1.0))


def leakage(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Labels whose recall is below the wanted one, with the shortfall."""
    return acceptance(scores, wanted).filter(F.col("r") < F.col("recall_min")).select("label", "r", "recall_min", (F.col("recall_min") - F.col("r")).alias("shortfall"))


def compare_models(external: DataFrame, scores: DataFrame) -> DataFrame:
    """``external`` (label and one column for each model) with the own F1 as ``own``; 0 for labels without a score."""
    return external.join(scores.select("label", F.col("f").alias("own")), "label", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))


def configured(scores: DataFrame, config: DataFrame) -> DataFrame:
    """Scores of the configured labels only, renamed and in configured order; config: label, title, order."""
    return config.join(scores, "label").orderBy("order")


def max_normalised(df: DataFrame, value_col: str, out: str = "height") -> DataFrame:
    most = df.agg(F.max(value_col).alias("_most")).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(most), "_one").withColumn(out, F.try_divide(F.col(value_col), F.col("_most"))).drop("_one", "_most")
