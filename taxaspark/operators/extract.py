"""Filtering per-read output by taxonomy, and reads by the ids that are left."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import parsed_taxid
from .taxonomy import closure, descendants, filter_taxonomy, select_taxa


def strings(values: Iterable[str] | str | None) -> list[str] | None:
    """Without nulls; none at all is the same as not given."""
    if values is None:
        return None
    out = [str(v) for v in ([values] if isinstance(values, str) else values) if v is not None]
    return out or None


def excluded(lca: Column, exclude: list[str], mode: str = "substring") -> Column:
    """Whether the k-mer list names an excluded taxid: as a substring "<taxid>:", as a classifier's filter would search, or as a whole token."""
    ids = "|".join(re.escape(x) for x in exclude)
    if mode == "substring":
        return lca.contains(f"{exclude[0]}:") if len(exclude) == 1 else lca.rlike(f"(?:{ids}):")
    if mode == "token":
        return lca.rlike(rf"(?:^|\s|\|)(?:{ids}):")
    raise ValueError(f"unknown exclude mode {mode}")


def include_set(report: DataFrame, taxonomy: Iterable[str] | None, ranks: list[str] | None, taxa: list[str] | None, taxids: list[str] | None, with_descendants: bool, strict: bool = True) -> DataFrame:
    """The taxids that count: those chosen, with all below them if asked for."""
    below = filter_taxonomy(report, taxonomy, strict) if taxonomy else report
    chosen = select_taxa(below, ranks, taxa, taxids).select("taxid").distinct()
    return descendants(chosen, closure(below)) if with_descendants else chosen


def kractor_koutput(
    report: DataFrame, koutput: DataFrame, taxonomy: Iterable[str] | str | None = None, ranks: Iterable[str] | str | None = None, taxa: Iterable[str] | str | None = None,
    taxids: Iterable[str] | str | None = None, exclude: Iterable[str] | str | None = None, with_descendants: bool = True, exclude_mode: str = "substring", strict: bool = True,
) -> DataFrame:
    """Rows of per-read output whose taxid is included and whose k-mer list names no excluded one. A row without a list fails if anything is excluded.

    `strict`: a taxonomy that matches no row of the report is an error, which takes a job over the report.
    """
    taxonomy, ranks, taxa, taxids, exclude = map(strings, (taxonomy, ranks, taxa, taxids, exclude))
    if not any((taxonomy, ranks, taxa, taxids, exclude)):
        raise ValueError("give one of taxonomy, ranks, taxa, taxids and exclude at least")
    out = koutput.withColumn("_taxid", parsed_taxid(F.col("taxon")))
    if any((taxonomy, ranks, taxa, taxids)):
        wanted = include_set(report, taxonomy, ranks, taxa, taxids, with_descendants, strict)
        out = out.join(wanted.withColumnRenamed("taxid", "_taxid"), "_taxid", "left_semi").select(*out.columns)
    if exclude:
        out = out.where(F.col("lca").isNotNull() & ~excluded(F.col("lca"), exclude, exclude_mode))
    return out.drop("_taxid")


def kractor_reads(koutput: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads, or pairs, whose id is in the per-read output."""
    ids = koutput.where("read_id <> ''").select("read_id")
    key = F.col("r1.id") if "r1" in reads.columns else F.col("id")
    return reads.withColumn("_id", key).join(ids.withColumnRenamed("read_id", "_id"), "_id", "left_semi").drop("_id")
