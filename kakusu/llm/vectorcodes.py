"""Vector codes by product quantisation; codebooks by Lloyd's rounds that are maintained by what changes.

Vectors become integers, so every sum is exact and no order of adding matters. A table holds each vector's integers and its present
code. A round reads it, assigns every part to the nearest entry of its codebook, and writes the new table; beside it each task
writes, per entry, the sums of parts that came minus those that went. Only these cross the network (64 entries for each part
position and task at most), are added to the running sums, and make the next codebooks. A part that stays where it was moves nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import drop, keep, need

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
_STATE, _DELTA = 0, 1
_KIND = "kind int, vec_id {id}, label {label}, dim int, ints binary, code binary, error long, part int, entry int, sums array<long>, n long"


def bound(dim: int) -> int:
    """Integers are held within this, so that squared distances of a vector of ``dim`` components always fit a long."""
    return isqrt((1 << 62) // max(1, dim)) // 2


class Codebooks:
    """Entries of each part position for vectors of one dimension, and the running sums and counts of what is assigned to them."""

    def __init__(self, first: np.ndarray, parts: int):
        entries, dim = first.shape
        self.entries = first.reshape(entries, parts, dim // parts).transpose(1, 0, 2).copy()
        self.sums = np.zeros(self.entries.shape, dtype=object)
        self.n = np.zeros(self.entries.shape[:2], dtype=object)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries, lower ones first, of vectors cut into parts, and the squared distances."""
        codes, away = np.empty(x.shape[:2], dtype=np.uint8), np.empty(x.shape[:2], dtype=np.int64)
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.float64 if 4 * top * top * x.shape[2] < 1 << 52 else np.int64  # both exact, floating point is faster
        for p, book in enumerate(self.entries):
            a, b = x[:, p].astype(kind), book.astype(kind)
            d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
            codes[:, p] = d.argmin(1)
            away[:, p] = d[np.arange(len(d)), codes[:, p]]
        return codes, away

    def move(self, rows: list) -> None:
        """Adds contributions (part, entry, sums, n) and sets the entries that have parts to floors of their means."""
        for r in rows:
            self.sums[r["part"], r["entry"]] += np.array(r["sums"], dtype=object)
            self.n[r["part"], r["entry"]] += r["n"]
        for p, e in np.argwhere(self.n > 0):
            self.entries[p, e] = self.sums[p, e] // self.n[p, e]

    def digest_text(self) -> str:
        return ",".join(map(str, self.entries.reshape(-1).tolist()))


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 4096]), schema)], schema=schema)


def _integers(schema: pa.Schema, parts: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors that can be coded, as 64-bit integers; without codes yet."""
        for batch in batches:
            out = []
            for an_id, label, vector in zip(*(batch.column(i).to_pylist() for i in range(3))):
                dim = len(vector or ())
                if not dim or dim % parts or None in vector:
                    continue
                x = np.array(vector, dtype=np.float64)
                if np.isfinite(x).all():
                    most = bound(dim)
                    ints = np.clip(np.floor(x * scale), -most, most).astype("<i8")
                    out.append((_STATE, an_id, label, dim, ints.tobytes(), b"", 0, None, None, None, None))
            yield from _batches(out, schema)

    return run


def _round(schema: pa.Schema, parts: int, books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its new code; at the end the task's contributions of parts that moved."""
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), dtype=np.int64)
            ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            raw, old = batch.column("ints").to_pylist(), batch.column("code").to_pylist()
            out = []
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                book = books.value[dim]
                x = np.frombuffer(b"".join(raw[i] for i in at), dtype="<i8").reshape(len(at), parts, dim // parts)
                codes, away = book.assign(x)
                if dim not in sums:
                    sums[dim], counts[dim] = np.zeros(book.entries.shape, dtype=np.int64), np.zeros(book.entries.shape[:2], dtype=np.int64)
                known = np.array([len(old[i]) > 0 for i in at])
                before = np.frombuffer(b"".join(old[i] or bytes(parts) for i in at), dtype=np.uint8).reshape(len(at), parts)
                for p in range(parts):
                    moved = ~known | (before[:, p] != codes[:, p])
                    np.add.at(sums[dim][p], codes[moved, p], x[moved, p])
                    np.add.at(counts[dim][p], codes[moved, p], 1)
                    left = moved & known
                    np.subtract.at(sums[dim][p], before[left, p], x[left, p])
                    np.subtract.at(counts[dim][p], before[left, p], 1)
                errors = away.sum(1)
                out += [(_STATE, ids[i], labels[i], dim, raw[i], codes[k].tobytes(), int(errors[k]), None, None, None, None) for k, i in enumerate(at)]
            yield from _batches(out, schema)
        for dim in sums:
            moves = [(_DELTA, None, None, dim, None, None, None, p, e, s, int(n)) for p, (some, ns) in enumerate(zip(sums[dim], counts[dim])) for e, (s, n) in enumerate(zip(some.tolist(), ns)) if n or any(s)]
            yield from _batches(moves, schema)

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each vector that can be coded.

    Components are floor(``scale`` * x). Vectors are cut into ``parts`` equal consecutive parts; each position's codebook begins
    with that part of the ``entries`` smallest ids (all, if there are fewer; nulls last, of equal ids the smaller integers first),
    and ``rounds`` times parts go to the nearest entry and entries to the floors of their parts' means. ``error`` is the squared
    distance to the code, ``label_error`` its sum over the label's rows (null labels are one label).

    Left out: vectors that are null or empty or hold null or non-finite components, and those whose length ``parts`` does not divide:
    they have no equal parts. Vectors of another length have codebooks of their own. Repeated rows and ids count each. Components
    are held within +-:func:`bound` (134 million, that is x = 524288, at 64 components), so that an error always fits a long. The
    driver holds the codebooks: 64 vectors for each length that occurs. Empty tables: no rows.
    """
    if entries > 256:
        raise ValueError("an entry's index is one byte")
    need(vectors, id_col, vector_col, label_col)
    spark = vectors.sparkSession
    kind = _KIND.format(id=vectors.schema[id_col].dataType.simpleString(), label=vectors.schema[label_col].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(kind))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    state = keep(rows.mapInArrow(_integers(schema, parts, scale), kind))
    books: dict[int, Codebooks] = {}
    for (dim,) in state.select("dim").distinct().collect():
        first = state.filter(F.col("dim") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
        books[dim] = Codebooks(np.stack([np.frombuffer(r["ints"], dtype="<i8") for r in first]), parts)
    for turn in range(rounds + 1):
        sent = spark.sparkContext.broadcast(books)
        new = keep(state.mapInArrow(_round(schema, parts, sent), kind))
        drop(state)
        state = new.filter(F.col("kind") == _STATE)
        state._kept_path = new._kept_path
        if turn == rounds:
            break
        widest = max((d // parts for d in books), default=0)
        sums = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(widest)]
        moved = new.filter(F.col("kind") == _DELTA).groupBy("dim", "part", "entry").agg(F.sum("n").alias("n"), *sums).collect()  # entries of all codebooks
        for dim, book in books.items():
            book.move([{"part": r["part"], "entry": r["entry"], "n": r["n"], "sums": [int(r[f"s{i}"]) for i in range(dim // parts)]} for r in moved if r["dim"] == dim])
    digests = {dim: hashlib.sha256(book.digest_text().encode()).hexdigest() for dim, book in books.items()}
    digest = F.lit(None).cast("string")
    for dim, found in digests.items():
        digest = F.when(F.col("dim") == dim, F.lit(found)).otherwise(digest)
    coded = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", digest.alias("codebooks_sha256"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
