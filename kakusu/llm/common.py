"""What the operators of this package share: cutting lineage, word rules, stable folds, and column checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def checkpoint_folder(spark: SparkSession) -> None:
    """Uses the cluster's ``spark.checkpoint.dir``; only a local session without one (tests) gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kakusu-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of what runs inside go when it has run: what follows reads files in the checkpoint folder."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder now and goes on from the files: a lost executor re-reads them. For small data."""
    checkpoint_folder(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.checkpoint(eager=True)


_WRITTEN: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _forget() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already; the folder is the cluster's to clean
            return


def keep(df: DataFrame) -> DataFrame:
    """As :func:`cut`, as a compressed table with statistics in the checkpoint folder; removed when the program ends."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_forget)
    _WRITTEN[path] = spark
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def drop(kept: DataFrame) -> None:
    """Deletes a table of :func:`keep` that nothing reads any more."""
    path = kept._kept_path
    _delete(_WRITTEN.pop(path), path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that begin with ``names`` and that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def need(df: DataFrame, *names: str) -> DataFrame:
    """``df``, after checking that it has each of the columns ``names`` exactly once (other columns are free)."""
    for name in names:
        if sum(c.lower() == name.lower() for c in df.columns) != 1:
            raise ValueError(f"exactly one column {name!r} is needed, there are {df.columns}")
    return df


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def words_of(text: str | None) -> list[bytes]:
    """The words of ``text`` as UTF-8, A-Z lower-cased; bytes.split() and bytes.lower() know ASCII only, as wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Distinct hashes of all runs of ``k`` words, ascending; of the whole sequence if it is shorter, none if it is empty."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i])
    return np.unique(out)
