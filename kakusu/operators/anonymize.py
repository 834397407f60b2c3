"""Anonymizing: what replaces each span, and the spliced text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import DEFAULT, Catalog
from ..functions.spans import disjoint_spans, no_spans, spans_of

#: Of an entity type: {"type": operator, parameters ...}; nothing or an empty mapping: replace by <TYPE>.
Operators = dict[str, dict]


def _replacement(span: Column, config: dict | None) -> Column:
    kind = (config or {}).get("type", "replace")
    text, size = span["text"], F.char_length(span["text"])
    if kind == "replace":
        value = (config or {}).get("new_value")
        return F.concat(F.lit("<"), span["entity_type"], F.lit(">")) if value is None else F.lit(value)
    if kind == "redact":
        return F.lit("")
    if kind == "mask":
        n = F.least(F.lit(int(config.get("chars_to_mask", 0))), size)
        mask = F.repeat(F.lit(config.get("masking_char", "*")), n)
        if config.get("from_end", False):
            return F.concat(F.substring(text, F.lit(1), size - n), mask)
        return F.concat(mask, F.substring(text, n + 1, size - n))
    if kind == "hash":
        return F.sha2(F.concat(F.lit(config.get("salt", "")), text), 512 if config.get("hash_type") == "sha512" else 256)
    if kind == "encrypt":
        return F.base64(F.aes_encrypt(text.cast("binary"), F.lit(config["key"]).cast("binary"), F.lit("CBC"), F.lit("PKCS")))
    if kind == "keep":
        return text
    if kind == "custom":
        return config["function"](text)
    raise ValueError(f"unknown operator {kind!r}")


def replacement(span: Column, operators: Operators | None) -> Column:
    out = _replacement(span, None)
    for entity, config in (operators or {}).items():
        if config:
            out = F.when(span["entity_type"] == entity, _replacement(span, config)).otherwise(out)
    return out


def operator_name(span: Column, operators: Operators | None) -> Column:
    out = F.lit("replace")
    for entity, config in (operators or {}).items():
        if config:
            out = F.when(span["entity_type"] == entity, F.lit(config.get("type", "replace"))).otherwise(out)
    return out


def splice(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with disjoint, sorted spans replaced: what stands before each span and its replacement, joined once."""
    before = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), by(s)))
    last = F.get(spans, F.size(spans) - 1)["end"]
    rest = F.substring(text, last + 1, F.char_length(text) - last)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)


def with_disjoint(df: DataFrame, text_col: str, entities, lang, catalog: Catalog, context: bool, threshold: float) -> DataFrame:
    """Adds ``spans``: found, then resolved. Two steps, so that the patterns are evaluated once."""
    found = F.coalesce(spans_of(F.col(text_col), entities, lang, catalog, context, threshold), no_spans())
    return df.withColumn("_found", found).withColumn("spans", disjoint_spans(F.col("_found"))).drop("_found")


def redact(df: DataFrame, text_col: str = "text", operators: Operators | None = None, entities: list[str] | None = None, lang: str | None = "ja", catalog: Catalog = DEFAULT, context: bool = True, threshold: float = 0.0) -> DataFrame:
    """Adds ``spans``, ``redacted`` and ``items`` (operator names, in the order of the text). Null text: null, no items."""
    out = with_disjoint(df, text_col, entities, lang, catalog, context, threshold)
    return out.withColumn("redacted", splice(F.col(text_col), F.col("spans"), lambda s: replacement(s, operators))).withColumn("items", F.transform("spans", lambda s: operator_name(s, operators)))


def guard_input(df: DataFrame, text_col: str = "text", image_col: str = "image") -> DataFrame:
    """Adds ``error``: a message for rows with neither text nor image, else null."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return df.withColumn("error", F.when(blank(text_col) & blank(image_col), F.lit("either text or image is required")))
