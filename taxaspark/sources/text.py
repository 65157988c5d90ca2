"""Readers of classification reports, per-read output and joined reads. All read .gz by extension."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KREPORT
from ..session import ship


def written(line: Column) -> Column:
    """Whether a line holds more than ASCII white space."""
    return line.rlike(r"[^\x20\x09\x0A\x0C\x0D]")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, source and line_no, one row per line, without the return of a CRLF. line_no sorts lines as they stand: by file, by
    where a task's part of the file begins, and by the line's place in it."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("source"), at.alias("line_no"))


def read_koutput(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """status, read_id, taxon (a taxid or "name (taxid N)"), length, lca, line: the line itself, and line_no, which sorts lines."""
    parts = F.split("value", "\t", -1)
    names = ("status", "read_id", "taxon", "length", "lca")
    return _lines(spark, path).where(written(F.col("value"))).select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)], F.col("value").alias("line"), "line_no")


def read_ids(koutput: DataFrame) -> DataFrame:
    """Distinct ids that aren't empty, whatever their status."""
    return koutput.where("read_id <> ''").select("read_id").distinct()


def read_koutreads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """taxid, tags, lca, seq, qual; a line of another number of fields is an error."""
    parts = F.split("value", "\t", -1)
    bad = F.raise_error(F.concat(F.lit("five fields expected: "), F.col("value")))
    first = F.when(F.size(parts) == 5, parts[0]).otherwise(bad)
    return _lines(spark, path).where(written(F.col("value"))).select(first.alias("taxid"), *[F.get(parts, i).alias(n) for i, n in enumerate(("tags", "lca", "seq", "qual"), 1)])


def read_parquet(spark: SparkSession, paths: list[str] | dict[str, str]) -> DataFrame:
    """All samples as one frame with a column `sample`: the name given, or the path."""
    named = paths.items() if isinstance(paths, dict) else [(p, p) for p in paths]
    out = None
    for name, p in named:
        df = spark.read.parquet(p).withColumn("sample", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def read_delimited(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def kreport_rows(lines: DataFrame) -> DataFrame:
    """From (source, pos, value): the parsed rows of six- or eight-field reports, without unclassified ones; level is half the name's indent."""
    parts = F.split("value", "\t", -1)
    six, n = F.size(parts) == 6, F.size(parts)
    at = lambda i, j: F.when(six, F.get(parts, i)).otherwise(F.get(parts, j))
    number = lambda c, t: F.trim(c).cast(t)
    only8 = lambda i: F.when(~six, F.trim(F.get(parts, i))).cast("bigint")
    rank = F.when((n == 6) | (n == 8), at(3, 5)).otherwise(F.raise_error(F.concat(F.lit("six or eight fields expected: "), F.col("value"))))
    name = at(5, 7)
    rows = lines.where(written(F.col("value"))).select(
        number(F.get(parts, 0), "double").alias("percents"), number(F.get(parts, 1), "bigint").alias("total_reads"), number(F.get(parts, 2), "bigint").alias("reads"),
        only8(3).alias("minimizer_len"), only8(4).alias("minimizer_n_unique"), rank.alias("rank"), at(4, 6).alias("taxid"), F.regexp_replace(name, "^ +", "").alias("taxon"),
        F.floor((F.length(name) - F.length(F.regexp_replace(name, "^ +", ""))) / 2).cast("int").alias("level"), F.col("pos").cast("bigint").alias("pos"), "source",
    )
    return rows.where(~F.col("rank").startswith("U"))


def lineage(rows: DataFrame) -> DataFrame:
    """Adds ranks, taxids and taxa: the path to each row, itself last, from order and level within a source.

    A row's ancestors are the chain of rows above whose levels rise one by one; a level that jumps has
    none, and rows of a root rank are never ancestors. A report is one group: it has one row per taxon.
    """
    ship(rows.sparkSession)
    names = [c.split()[0] for c in KREPORT.split(", ")]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple] = []
        paths = []
        for level, rank, taxid, taxon in pdf.sort_values("pos")[["level", "rank", "taxid", "taxon"]].itertuples(index=False):
            while stack and stack[-1][0] != level - 1:
                stack.pop()
            me = (level, rank, taxid, taxon)
            paths.append([*stack, me])
            if not rank.startswith("R"):
                stack.append(me)
        pdf = pdf.sort_values("pos")
        for k, c in enumerate(("ranks", "taxids", "taxa"), 1):
            pdf[c] = [[x[k] for x in p] for p in paths]
        for c in ("minimizer_len", "minimizer_n_unique"):
            pdf[c] = pdf[c].astype("Int64")
        return pdf[names]

    return rows.groupBy("source").applyInPandas(scan, KREPORT)


def read_kreport(spark: SparkSession, path: str | list[str], taxonomy: Iterable[str] | None = None) -> DataFrame:
    """A report's rows with their lineage, and with `taxonomy` ("rank__name") only those below or at one of its entries."""
    from ..operators.taxonomy import filter_taxonomy

    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    lines = whole.select("source", F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    out = lineage(kreport_rows(lines))
    return out if taxonomy is None else filter_taxonomy(out, taxonomy, strict=True)


def taxid_of(column: Column) -> Column:
    from ..functions.kmers import parsed_taxid

    return parsed_taxid(column)
