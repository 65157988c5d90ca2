"""The stateless operators, and counts with bounded state, on streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmers import parsed_taxid
from ..operators.extract import excluded, strings
from ..sources.text import written


def stream_koutput(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Per-read output as it arrives: status, read_id, taxon, length, lca, line."""
    parts = F.split("value", "\t", -1)
    names = ("status", "read_id", "taxon", "length", "lca")
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).withColumn("value", F.regexp_replace("value", "\r$", ""))
    return rows.where(written(F.col("value"))).select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)], F.col("value").alias("line"))


def filter_stream(rows: DataFrame, wanted: DataFrame, exclude: Iterable[str] | None = None, exclude_mode: str = "substring") -> DataFrame:
    """Rows of a stream whose taxid is in the static table `wanted` and whose k-mer list names no excluded one."""
    exclude = strings(exclude)
    out = rows.withColumn("taxid", parsed_taxid(F.col("taxon"))).join(wanted.select("taxid").distinct(), "taxid", "left_semi")
    return out.where(F.col("lca").isNotNull() & ~excluded(F.col("lca"), exclude, exclude_mode)) if exclude else out


def count_stream(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reads per ancestor, for update or complete mode: the state is one number per taxon."""
    return rows.withColumn("taxid", parsed_taxid(F.col("taxon"))).join(pairs, "taxid").groupBy(F.col("ancestor").alias("taxid")).agg(F.count(F.lit(1)).alias("reads"))
