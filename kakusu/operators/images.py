"""Images in columns: data URLs, and a place for an OCR redactor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType


def data_url_mime(url: Column, default: str = "image/png") -> Column:
    mime = F.regexp_extract(url, r"^data:([^;,]+)", 1)
    return F.when(mime == "", default).otherwise(mime)


def data_url_bytes(url: Column) -> Column:
    """Bytes of a data URL or of plain base64; null if it is neither."""
    return F.try_to_binary(F.substring_index(url, ",", -1), F.lit("base64"))


def to_data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def real_mime(content: Column) -> Column:
    """By the first bytes: PNG, JPEG, GIF or WEBP; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")


def redact_images(df: DataFrame, redactor: Callable[[bytes, tuple[int, int, int]], bytes], content_col: str = "content", fill: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Adds ``redacted`` and ``status``. ``redactor`` (OCR and boxes) runs in Arrow batches; where it fails, no image comes out."""
    schema = StructType([*df.schema.fields, StructField("redacted", BinaryType()), StructField("status", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for content in batch[content_col]:
                try:
                    done.append((redactor(bytes(content), fill), "ok") if content is not None else (None, "no image"))
                except Exception as e:  # fail closed: the row says so, the image is withheld
                    done.append((None, f"failed: {type(e).__name__}"))
            yield batch.assign(redacted=[d[0] for d in done], status=[d[1] for d in done])

    return df.mapInPandas(run, schema)
