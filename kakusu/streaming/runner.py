"""Runs streams to the end of what is there and gives back the sink's table; sinks and checkpoints are in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import detect, explode_spans

#: Typed state with timers needs this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A micro-batch writes down what changed in the state, not all of it.
_STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def shared_place(spark: SparkSession) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; only a local session without one (tests) gets a temporary folder."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="kakusu-stream-")
        atexit.register(shutil.rmtree, shared, True)
    return f"{shared}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """All rows that ``stream`` gives for what its sources hold now, through a Parquet sink at ``place``."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(f"{place}/out")
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def spread(rows: DataFrame, *keys: str, steps: int = 4) -> DataFrame:
    """``rows`` dealt by a hash of ``keys`` over so many parts that each of ``steps`` micro-batches has files for all cores."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), steps * spark.sparkContext.defaultParallelism), *keys)


def replay(rows: DataFrame, through: Callable[[DataFrame], DataFrame], steps: int = 4) -> DataFrame:
    """``rows`` written down and streamed through ``through`` in about ``steps`` micro-batches; the sink's table."""
    spark, place = rows.sparkSession, shared_place(rows.sparkSession)
    rows.write.parquet(f"{place}/in")
    stored = spark.read.schema(rows.schema).parquet(f"{place}/in")
    each = max(1, len(stored.inputFiles()) // steps)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{place}/in")
    return drain(through(stream), place)


def replay_in_order(parts: list[DataFrame], through: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As :func:`replay`, a run of the stream for each of ``parts``: the next one comes when the one before is done, watermark and all."""
    spark, place = parts[0].sparkSession, shared_place(parts[0].sparkSession)
    for part in parts:
        part.write.mode("append").parquet(f"{place}/in")
        out = drain(through(spark.readStream.schema(parts[0].schema).parquet(f"{place}/in")), place)
    return out


def collect_stream(spark: SparkSession, path: str, *keys: str, entities: tuple[str, ...] = ("EMAIL_ADDRESS", "IP_ADDRESS")) -> DataFrame:
    """Spans of the Parquet files at ``path`` through Structured Streaming."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    spans = explode_spans(detect(rows, entities=list(entities), context=False), *keys).select(*keys, "entity_type", F.col("start").cast("long").alias("start"), "text")
    return drain(spans, shared_place(spark))
