"""Exact deduplication by Grace hashing: partition to files until a bucket fits a table that compares complete contents.

1. Each task of the scan folds its rows into an open-addressing table of bounded size: a record for each distinct content, with the
   ids that have it. A content that a third of all rows have is a record for each task from here on.
2. Records are dealt by a digest into buckets of about ``BUCKET_BYTES`` and settled there: content against content, never by digest
   alone. What doesn't fit a bucket's table is written out and dealt again by another hash, level after level, until all is settled.
   A table takes one content at least, so every level makes progress.
3. Contents with records from very many tasks are merged in shares first (salted by record), so none is one task's work.
4. Ids are joined to what their records became. Contents are not in that join.

Every level is a table in the shared checkpoint folder, so a lost executor costs the tasks that it ran.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import drop, fresh, keep, need

#: Contents that a bucket should hold, and that a table may hold at most, in bytes.
BUCKET_BYTES = 64 << 20
TABLE_BYTES = 192 << 20
#: A content with more records is merged in shares first; so many contents at most can have more than this share of all records.
MANY = 256
MOST_HEAVY = 1 << 18
_ROWS = 4096  # of an Arrow batch that is handed back
_ENTRY = 200  # bytes of an entry besides its content


class OpenTable:
    """Contents by linear probing: a slot holds the number of an entry, an entry its hash and its whole content."""

    def __init__(self):
        self.slots, self.hashes, self.contents, self.bytes = [-1] * 1024, [], [], 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """The entry that has this content, or -1, and the slot where the search ended."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, at
            at = (at + 1) & mask
        return -1, at

    def add(self, h: int, content: bytes, slot: int) -> int:
        entry = self.slots[slot] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + _ENTRY
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for i, other in enumerate(self.hashes):
                at = other & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i
        return entry


def _batches(rows: list[tuple], schema: pa.Schema, bytes_: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """``rows`` as batches of bounded size; ``bytes_`` counts binary fields."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, list)))
        if len(some) == _ROWS or size > bytes_:
            yield _batch(some, schema)
            some, size = [], 0
    if some:
        yield _batch(some, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _later(a, b):
    """The larger id; null is less than any."""
    return b if a is None or (b is not None and b > a) else a


def _records(schema: pa.Schema, table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct contents of a task, each with its ids, the largest id first."""
        made = TaskContext.get().partitionId() << 36
        table, ids = OpenTable(), []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = []
            for content, own in zip(table.contents, ids):
                best = own[0]
                for x in own:
                    best = _later(best, x)
                own.insert(0, own.pop(own.index(best)))
                rows.append((made, xxhash.xxh3_128_digest(content), content, len(content), hashlib.sha256(content).digest(), own, best, len(own)))
                made += 1
            yield from _batches(rows, schema)

        count = 0
        for batch in batches:
            for an_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = raw.lower()  # of bytes: A-Z only
                h = xxhash.xxh3_64_intdigest(content)
                entry, slot = table.find(h, content)
                if entry < 0:
                    entry = table.add(h, content, slot)
                    ids.append([])
                ids[entry].append(an_id)
                count += 1
                if table.bytes + 40 * count > table_bytes:
                    yield from out()
                    table, ids, count = OpenTable(), [], 0
        yield from out()

    return run


_SETTLED, _LEFT = 0, 1


def _settle(schema: pa.Schema, table_bytes: int, partial: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of a bucket with what their content became; those that the table had no room for are handed on as they are.

        Where ``partial``, each content is handed on too, as one record.
        """
        table, found, members = OpenTable(), [], []
        for batch in batches:
            left = []
            for local, digest, content, best, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                h = int.from_bytes(digest[:8], "little")
                entry, slot = table.find(h, content)
                if entry >= 0:
                    other, keeper, count, _ = found[entry]
                    ahead = local < keeper if best == other else _later(other, best) is best
                    found[entry] = (best if ahead else other, local if ahead else keeper, count + n, digest)
                    members[entry].append(local)
                elif table.contents and table.bytes + len(content) > table_bytes:
                    left.append((_LEFT, local, None, None, digest, content, len(content), best, n))
                else:
                    table.add(h, content, slot)
                    found.append((best, local, n, digest))
                    members.append([local])
            yield from _batches(left, schema)
        for (best, keeper, n, digest), content in zip(found, table.contents):
            if partial:
                yield from _batches([(_LEFT, keeper, None, None, digest, content, len(content), best, n)], schema)
        yield from _batches([(_SETTLED, local, keeper, n, None, None, None, best, None) for (best, keeper, n, _), own in zip(found, members) for local in own], schema)

    return run


def _deal(records: DataFrame, level: int, settle, schema: str, bucket_bytes: int, *salt) -> DataFrame:
    """One level: ``records`` dealt into buckets and settled, as a table."""
    spark = records.sparkSession
    whole = records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // bucket_bytes))
    return keep(records.select("local", "digest", "content", "best", "n").repartition(buckets, F.xxhash64(F.lit(level), "digest", *salt)).mapInArrow(settle, schema))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES, many: int = MANY) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Texts are equal if they are identical, byte for byte, after A-Z are lower-cased; null counts as empty. Of equal texts the row of
    the largest id stays (null is less than any id); of several rows with that id one stays, so each class has exactly one kept
    row. Texts of any length count as a whole. Further columns have no part in it. Empty tables: no rows.
    """
    need(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))
    kind = f"local long, digest binary, content binary, size long, sha binary, ids array<{id_type}>, best {id_type}, n long"
    records = keep(rows.mapInArrow(_records(to_arrow_schema(StructType.fromDDL(kind)), table_bytes), kind))
    schema = f"kind int, local long, keeper long, total long, digest binary, content binary, size long, best {id_type}, n long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    settle = _settle(arrow, table_bytes, False)

    settled, tables = [], [records]
    merged = None
    pending = records.select("local", "digest", "content", "size", "best", "n")
    total = records.count()
    limit = max(many, -(-total // MOST_HEAVY))
    heavy = records.groupBy("digest").agg(F.count("*").alias("records")).filter(F.col("records") > limit).select("digest")
    if not heavy.isEmpty():
        heavy = keep(heavy)  # MOST_HEAVY rows at most, as each has more than its share of all records
        shares = pending.join(F.broadcast(heavy), "digest", "left_semi")
        merged = _deal(shares, -1, _settle(arrow, table_bytes, True), schema, bucket_bytes, F.pmod(F.xxhash64("local"), F.lit(1 + total // limit)))
        pending = pending.join(F.broadcast(heavy), "digest", "left_anti").unionByName(merged.filter(F.col("kind") == _LEFT).select("local", "digest", "content", "size", "best", "n"))
        tables += [heavy, merged]
    level = 0
    while True:
        done = _deal(pending, level, settle, schema, bucket_bytes)
        tables.append(done)
        settled.append(done.filter(F.col("kind") == _SETTLED).select("local", "keeper", F.col("total").alias("group_size"), F.col("best").alias("keep_id")))
        pending = done.filter(F.col("kind") == _LEFT).select("local", "digest", "content", "size", "best", "n")
        if pending.isEmpty():
            break
        level += 1
    what = settled[0]
    for more in settled[1:]:
        what = what.unionByName(more)
    if merged is not None:  # records of shares become what their share's record became
        shared = merged.filter(F.col("kind") == _SETTLED).select("local", F.col("keeper").alias("share"))
        own = shared.join(what.withColumnRenamed("local", "share"), "share").drop("share")
        what = what.join(shared.select("local"), "local", "left_anti").unionByName(own)
    named = records.select("local", "sha", "ids").join(what, "local")
    each = named.select("*", F.posexplode("ids").alias("place", "doc_id"))
    kept = (F.col("place") == 0) & (F.col("local") == F.col("keeper"))
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """``docs`` with one row of each class of :func:`classes`, all columns as they are; of repeated ids too one row stays."""
    an_id, sha = fresh(docs, "_kept_id", "_sha")
    stay = classes(docs, id_col, text_col, **sizes).filter("kept").select(F.col("doc_id").alias(an_id), F.col("text_sha256").alias(sha))
    own = F.sha2(F.translate(F.coalesce(docs[text_col], F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256)
    kept = docs.join(stay, docs[id_col].eqNullSafe(F.col(an_id)) & (own == F.col(sha)))
    return kept.dropDuplicates([an_id, sha]).select(*docs.columns)
