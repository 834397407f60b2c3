"""Reversible redaction: placeholders, their originals, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import DEFAULT, Catalog
from .anonymize import splice, with_disjoint

MAPPING = "map<string,string>"
_MARK = "\x01"
#: What a placeholder looks like.
SHAPE = r"<[A-Z_]+(?:_\d+)+>"


def placeholder(span: Column, part: Column | None = None) -> Column:
    """<TYPE_start>, or <TYPE_part_start> where several texts share one mapping."""
    place = span["start"].cast("string") if part is None else F.concat_ws("_", part.cast("string"), span["start"].cast("string"))
    return F.concat(F.lit("<"), span["entity_type"], F.lit("_"), place, F.lit(">"))


def mapping_of(spans: Column, part: Column | None = None) -> Column:
    entries = F.transform(spans, lambda s: F.struct(placeholder(s, part).alias("key"), s["text"].alias("value")))
    return F.map_from_entries(entries).cast(MAPPING)


def redact_with_mapping(df: DataFrame, text_col: str = "text", part_col: str | None = None, entities: list[str] | None = None, lang: str | None = "ja", catalog: Catalog = DEFAULT, threshold: float = 0.0) -> DataFrame:
    """Adds ``spans``, ``redacted`` and ``mapping``; overlaps are resolved before the text is spliced."""
    part = F.col(part_col) if part_col else None
    out = with_disjoint(df, text_col, entities, lang, catalog, True, threshold)
    return out.withColumn("redacted", splice(F.col(text_col), F.col("spans"), lambda s: placeholder(s, part))).withColumn("mapping", mapping_of(F.col("spans"), part))


def restore(text: Column, mapping: Column) -> Column:
    """All placeholders that the mapping has become their originals, in one pass: what comes back is never replaced again."""
    plain = F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02b")), F.lit(_MARK), F.lit("\x02a"))  # the mark may be in the text
    clear = lambda p: F.replace(F.replace(p, F.lit("\x02a"), F.lit(_MARK)), F.lit("\x02b"), F.lit("\x02"))
    pieces = F.split(F.regexp_replace(plain, F.lit(SHAPE), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    return F.when(F.coalesce(F.size(mapping), F.lit(0)) <= 0, text).otherwise(F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(mapping, p), clear(p))), ""))


def restore_in_order(text: Column, mapping: Column) -> Column:
    """One placeholder after the other, in the order of the mapping; originals that look like placeholders are replaced too."""
    return F.aggregate(F.map_entries(mapping), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def merge_mappings(df: DataFrame, *keys: str, mapping_col: str = "mapping", order_col: str = "part") -> DataFrame:
    """One mapping for each group: of equal placeholders the one of the last part wins."""
    rows = df.select(*keys, order_col, F.explode(mapping_col).alias("placeholder", "original"))
    last = rows.groupBy(*keys, "placeholder").agg(F.max_by("original", F.struct(order_col, "original")).alias("original"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("placeholder", "original")))).alias(mapping_col))
