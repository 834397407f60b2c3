"""Document fingerprints: canonical exact digests.

A text is made canonical (NFKC, case folded, NFKC again, runs of white space to one space, ends trimmed) and hashed with
128-bit xxhash. Documents that share a hash are then compared by their canonical bytes: Spark groups by hash and bytes, after
a first grouping on the map side, so a large group of copies travels as one row for each task. If different bytes ever share
a hash, their fingerprints get the SHA-256 of these bytes as a suffix.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, need

#: Rows of one range of ids, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1500, 20_000
#: Bits of the filter of repeated hashes: a fixed size; false positives only cost time.
FILTER_BITS = 1 << 23


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def _hash(raw: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(raw)


def _ranges(docs: DataFrame, id_col: str) -> np.ndarray:
    """Where ranges of ids end.

    Ranges go downwards: range 0 has the greatest ids. There are at most MOST_RANGES.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    count = ids.count()
    n = int(min(MOST_RANGES, max(1, count // RANGE_ROWS)))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    return np.unique(np.array(cuts or [], dtype=np.int64))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_chars, edited_sha256``, hashes of canonical texts: own, edited, next.

    The edited text: the last third (rounded down) of the code points replaced by as many of the next document's first ones.
    Next: the following row by descending id (null ids last, equal ids by text); after the last row the first one. Rows are
    dealt into ranges of ids, sorted there, and read in order; the first row of the following range is sent along.
    """
    cuts = _ranges(docs, id_col)
    last = len(cuts)
    at = lambda ids: last - np.searchsorted(cuts, ids, side="left")

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), last, at(ids.fillna(0).to_numpy().astype(np.int64))))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heads = docs.select(F.col(id_col).cast("long").alias("doc_id")).withColumn("range", range_of("doc_id")).groupBy("range").agg(F.max("doc_id").alias("head"), F.count("*").alias("n")).orderBy("range").collect()
    full = [(r["range"], r["head"]) for r in heads]  # at most one for each range
    before = {head: full[k - 1][0] for k, (_, head) in enumerate(full)}

    @F.pandas_udf("array<struct<range: long, guest: int>>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.where(ids.isna(), last, at(ids.fillna(0).to_numpy().astype(np.int64)))
        out = []
        for i, r in zip(ids, own):
            key = None if pd.isna(i) else int(i)
            out.append([{"range": int(r), "guest": 0}] + ([{"range": int(before[key]), "guest": 1}] if key in before else []))
        return pd.Series(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its next one

        def made(row, following):
            doc_id, text, h, raw = row
            n = len(text)
            k = n // 3
            edited = text[: n - k] + following[1][:k]
            c = canonical(edited)
            return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), h, _hash(c), following[2], hashlib.sha256(raw).hexdigest(), hashlib.sha256(c).hexdigest()

        for batch in batches:
            out = []
            for r, guest, doc_id, text in zip(batch["range"], batch["guest"], batch["doc_id"], batch["text"]):
                raw = canonical(text)
                row = (None if pd.isna(doc_id) else int(doc_id), text, _hash(raw), raw)
                if held is not None and held[0] == r:
                    out.append(made(held[1], row))
                    held = None
                if not guest:
                    held = (r, row)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "hash", "edited_hash", "next_hash", "sha", "edited_sha"]).astype({"doc_id": "Int64"})

    placed = rows.withColumn("p", F.explode(places("doc_id"))).select("p.range", "p.guest", "doc_id", "text")
    tasks = int(max(1, min(len(full), max(docs.sparkSession.sparkContext.defaultParallelism * 4, len(full) // 4))))
    dealt = placed.repartition(tasks, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, hash string, edited_hash string, next_hash string, sha string, edited_sha string")


def _shared_hashes(docs: DataFrame, hashes: DataFrame, text_col: str) -> DataFrame:
    """``shared``: hashes that stand for different canonical bytes."""
    again = hashes.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1")
    number = F.conv(F.substring("hash", 1, 12), 16, 10).cast("long")
    words = again.select(F.pmod(number, F.lit(FILTER_BITS)).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 32, dtype=np.int64)  # the whole filter is FILTER_BITS bits, whatever the input
    bits[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    known = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_ = known.value
        for batch in batches:
            out = set()
            for text in batch["text"]:
                raw = canonical(text)
                bit = int((h := _hash(raw))[:12], 16) % FILTER_BITS
                if int(filter_[bit >> 5]) >> (bit & 31) & 1:
                    out.add((h, raw))
            yield pd.DataFrame(list(out), columns=["hash", "raw"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, "hash string, raw binary")
    return texts.groupBy("hash", "raw").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("kinds")).filter("kinds > 1").select(F.col("hash").alias("shared"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row.

    Likeness is 1.0 for equal fingerprints and 0.0 otherwise. Null texts are empty texts. Repeated rows each have a row.
    A single document is followed by itself. Empty tables: no rows.
    """
    need(docs, id_col, text_col)
    base = cut(edited_pairs(docs, id_col, text_col))
    shared = cut(_shared_hashes(docs, base, text_col))
    for name in ("hash", "edited_hash"):
        base = base.join(shared.withColumnRenamed("shared", f"{name}_shared"), F.col(name) == F.col(f"{name}_shared"), "left")
    full = lambda h, sha: F.when(F.col(f"{h}_shared").isNotNull(), F.concat(h, F.lit("-"), sha)).otherwise(F.col(h))
    near = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    out = base.select("doc_id", "n_chars", "edited_sha256", full("hash", "sha").alias("fingerprint"), full("edited_hash", "edited_sha").alias("edited_fingerprint"), near("hash", "next_hash").alias("near_next"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("fingerprint", "edited_fingerprint").alias("near_edited"), "near_next")


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``: the canonical digest of each text (null: of the empty text), 32 hexadecimal digits."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _hash(canonical(t or "")))

    return docs.withColumn("fingerprint", digest(F.col(text_col)))
