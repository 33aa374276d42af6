"""Aligned reads as they arrive: a file-source stream of SAM text, and running counts over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alignments import mapped
from ..sources.alignments import parse_sam


def stream_sam(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """SAM files that appear in a folder, as a stream; ord is not known, as files come in any order."""
    return parse_sam(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def running_reference_counts(stream: DataFrame) -> DataFrame:
    """Mapped reads per reference so far; the state has a row per reference."""
    return stream.where(mapped()).groupBy("ref").agg(F.count("*").alias("reads"))
