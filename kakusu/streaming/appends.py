"""A table that takes each batch once.

The rows of a batch lie in a folder of its own. A record of the batch is written after them and says that they count, with how many
rows came, were taken and failed. A batch whose record is there is not taken again; one that was cut off before its record is written
anew over what it left. Readers see batches with records only. Nothing is rewritten when a batch is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: The column that names the batch of a row, as a folder.
BATCH = "append_batch"
_RECORD = "total long, new long, failed long"


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def append_once(rows: DataFrame, path: str, batch: int, valid: Column | None = None) -> dict[str, int]:
    """Adds ``rows`` to the table at ``path`` as batch ``batch``, unless it has that batch; gives its ``total``, ``new`` and ``failed`` rows.

    Rows for which ``valid`` is not true fail: they are counted and not written. Counting is part of the pass that writes. An empty
    batch is recorded as well. ``rows`` must not have a column ``append_batch`` (ValueError).
    """
    if BATCH in (c.lower() for c in rows.columns):
        raise ValueError(f"the column {BATCH} is the table's own")
    spark, record = rows.sparkSession, f"{path}/records/{BATCH}={int(batch)}"
    if _there(spark, f"{record}/_SUCCESS"):
        return spark.read.schema(_RECORD).json(record).first().asDict()
    good = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    seen = Observation(f"append-{int(batch)}")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(good).alias("new"))
    counted.filter(good).write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={int(batch)}")
    counts = {"total": seen.get["total"], "new": seen.get["new"], "failed": seen.get["total"] - seen.get["new"]}
    spark.createDataFrame([tuple(counts.values())], _RECORD).coalesce(1).write.mode("overwrite").json(record)
    return counts


def append_stream(stream: DataFrame, path: str, checkpoint: str, valid: Column | None = None) -> StreamingQuery:
    """Appends what the stream's sources hold now; started again with the same ``checkpoint`` it goes on, and takes no batch twice."""

    def take(rows: DataFrame, batch: int) -> None:
        append_once(rows, path, batch, valid)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records(spark: SparkSession, path: str) -> DataFrame:
    """``append_batch, total, new, failed`` of the batches that count."""
    schema = f"{_RECORD}, {BATCH} long"
    if not _there(spark, f"{path}/records"):
        return spark.createDataFrame([], schema).select(BATCH, "total", "new", "failed")
    return spark.read.schema(schema).json(f"{path}/records").select(BATCH, "total", "new", "failed")


def read_appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the batches that count, with ``append_batch``; none if nothing was appended yet."""
    whole = StructType(list(schema.fields)).add(BATCH, "long")
    if not _there(spark, f"{path}/rows"):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{path}/rows").join(records(spark, path).select(BATCH), BATCH, "left_semi").select(whole.fieldNames())
