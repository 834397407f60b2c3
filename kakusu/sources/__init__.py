"""Readers and writers around Spark's own formats."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATED = "text string, entities array<struct<start:int,end:int,label:string,text:string>>"
SCORES = "ents_p double, ents_r double, ents_f double, ents_per_type map<string,struct<p:double,r:double,f:double>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of annotated documents; a missing file is an empty corpus."""
    try:
        return spark.read.schema(ANNOTATED).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANNOTATED)


def append_annotated(docs: DataFrame, path: str) -> None:
    """Adds a batch; earlier batches are not rewritten."""
    docs.write.mode("append").parquet(path)


def write_splits(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the others' files are not opened."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def read_templates(spark: SparkSession, pattern: str) -> DataFrame:
    """``domain, prompt`` of prompt files, one row for each file."""
    name = F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1)
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("prompt")).select(name.alias("domain"), "prompt")


def render(templates: DataFrame, num_docs: int) -> DataFrame:
    return templates.withColumn("prompt", F.regexp_replace("prompt", r"\{\{\s*num_docs\s*\}\}", str(num_docs)))


def split_batches(raw: DataFrame, separator: str = "---", raw_col: str = "raw") -> DataFrame:
    """One row for each document of a batch; white space around is cut off, blank ones go."""
    parts = F.split(raw_col, rf"\Q{separator}\E", -1)
    return raw.withColumn(raw_col, F.explode(parts)).withColumn(raw_col, F.regexp_replace(raw_col, r"(?U)^\s+|\s+$", "")).filter(F.length(raw_col) > 0)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``label, p, r, f`` in long form, with the row ``overall``."""
    raw = spark.read.schema(SCORES).option("multiLine", True).json(path)
    rows = raw.select(F.explode("ents_per_type").alias("label", "s")).select("label", "s.p", "s.r", "s.f")
    return rows.unionByName(raw.select(F.lit("overall").alias("label"), F.col("ents_p").alias("p"), F.col("ents_r").alias("r"), F.col("ents_f").alias("f")))


def write_scores(scores: DataFrame, path: str) -> None:
    scores.coalesce(1).write.mode("overwrite").json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
