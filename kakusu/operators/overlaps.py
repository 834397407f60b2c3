"""Pairs of spans that overlap, as an interval join: equal keys and bins, then ranges; each pair once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a bin. A span is joined in each bin that it touches, so a long document is no one task's work.
BIN = 256


def _binned(spans: DataFrame, keys: tuple[str, ...], side: str, width: int) -> DataFrame:
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    fields = [F.col(c).alias(f"{c}_{side}") for c in ("entity_type", "start", "end")]
    some = spans.filter(F.col("end") > F.col("start"))
    return some.select(*(F.col(k).alias(f"_{side}{i}") for i, k in enumerate(keys)), *fields, F.explode(bins).alias(f"_bin_{side}"))


def overlapping_pairs(spans: DataFrame, *keys: str, width: int = BIN) -> DataFrame:
    """``keys`` and ``entity_type``, ``start``, ``end`` of the two spans (``_a``, ``_b``) of each pair with a character in common.

    ``spans`` has a row for each span (keys, entity_type, start, end); its other columns play no part. A pair comes once, the span
    that is less by (start, end, type) first, and is found in the first bin that both touch. Spans of null keys are of one document; equal
    spans of one document (same start, end and type) are no pair; empty spans overlap nothing.
    """
    a, b = _binned(spans, keys, "a", width), _binned(spans, keys, "b", width)
    order = lambda side: F.struct(*(F.col(f"{c}_{side}").alias(c) for c in ("start", "end", "entity_type")))
    on: Column = F.col("_bin_a") == F.col("_bin_b")
    for i in range(len(keys)):
        on &= F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    met = (F.col("start_a") < F.col("end_b")) & (F.col("start_b") < F.col("end_a")) & (order("a") < order("b"))
    first = F.col("_bin_a") == F.floor(F.greatest("start_a", "start_b") / width)
    pairs = a.join(b, on & met & first)
    return pairs.select(*(F.col(f"_a{i}").alias(k) for i, k in enumerate(keys)), *(f"{c}_{side}" for side in "ab" for c in ("entity_type", "start", "end")))
