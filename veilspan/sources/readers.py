"""Sources and sinks: files with a size gate, labelled sentences, marked texts, parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import evaluate, ingest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW_GROUP = 128 << 20  # bytes that one task reads at least, as a row group is not split


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is too small to be read by all of them; larger tables are left as they are.

    The rows of a small table lie in one row group, which one task reads, while detection is bound by the CPU.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < ROW_GROUP * cores else df


def files(spark: SparkSession, path: str, max_bytes: int = ingest.MAX_BYTES) -> DataFrame:
    """path, size, support and content; contents over the limit are never read (the filter on length is pushed down)."""
    raw = spark.read.format("binaryFile").load(path)
    small = raw.where(F.col("length") <= max_bytes).select("path", F.col("length").alias("size"), ingest.classify_file(F.col("length"), F.col("content")).alias("support"), "content")
    large = raw.where(F.col("length") > max_bytes).select("path", F.col("length").alias("size"), F.lit("tooLarge").alias("support"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def labelled_sentences(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text and entities of a JSON-lines corpus."""
    return spark.read.schema("text string, entities array<struct<start:int,end:int,category:string>>").json(path).withColumn("doc_id", F.xxhash64("text"))


def marked_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text and gold of files with one marked text each."""
    return evaluate.parse_marked(spark.read.text(path, wholetext=True).select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("marked")))


def write_redacted(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
