"""Taxonomy as path columns: filters, the closure of (taxid, ancestor), descendants, rank order."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of rank codes.
RANKS = ("U", "R", "D", "K", "P", "C", "O", "F", "G", "S")


def taxonomy_entries(taxonomy: Iterable[str]) -> list[str]:
    """The entries of the form rank__name; an error if none is."""
    given = [t for t in taxonomy if t is not None]
    good = [t for t in given if "__" in t]
    if given and not good:
        raise ValueError("no valid taxonomy: entries have the form 'rank__name'")
    return good


def in_taxonomy(entries: list[str], ranks: str = "ranks", taxa: str = "taxa") -> Column:
    """Whether the row or one of its ancestors is an entry."""
    named = F.transform(F.arrays_zip(F.col(ranks).alias("r"), F.col(taxa).alias("t")), lambda x: F.concat_ws("__", x["r"], x["t"]))
    return F.arrays_overlap(named, F.array(*map(F.lit, entries)))


def filter_taxonomy(report: DataFrame, taxonomy: Iterable[str], strict: bool = False) -> DataFrame:
    """Rows at or below an entry. `strict`: an error if there are none, a warning for entries that no row has; both run a job."""
    entries = taxonomy_entries(taxonomy)
    if not entries:
        return report
    out = report.where(in_taxonomy(entries))
    if strict:
        found = {r[0] for r in report.select(F.concat_ws("__", "rank", "taxon").alias("e")).where(F.col("e").isin(entries)).distinct().collect()}
        if not found:
            raise ValueError(f"no taxonomic matches for {entries}")
        if missing := [e for e in entries if e not in found]:
            warnings.warn(f"no row of the report matches {missing}", stacklevel=2)
    return out


def closure(report: DataFrame) -> DataFrame:
    """(taxid, ancestor), each taxon its own ancestor; of several rows of one taxid the last counts: of the last report by name,
    the last row. Without row numbers the greatest path counts."""
    order = F.struct(*[c for c in ("source", "pos") if c in report.columns]) if "pos" in report.columns else F.col("taxids")
    last = report.groupBy("taxid").agg(F.max_by("taxids", order).alias("taxids"))
    return last.select("taxid", F.explode(F.array_distinct("taxids")).alias("ancestor"))


def descendants(targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The targets (taxid) and all below them, by the closure read from ancestor to taxid."""
    below = pairs.join(targets.select(F.col("taxid").alias("ancestor")), "ancestor", "left_semi").select("taxid")
    return below.union(targets.select("taxid")).distinct()


def select_taxa(report: DataFrame, ranks: list[str] | None = None, taxa: list[str] | None = None, taxids: list[str] | None = None) -> DataFrame:
    """Rows that meet every criterion given."""
    for column, values in (("rank", ranks), ("taxon", taxa), ("taxid", taxids)):
        if values is not None:
            report = report.where(F.col(column).isin(values))
    return report


def rank_key(rank: Column) -> Column:
    """A struct that sorts rank codes from root to leaf, S1 behind S, unknown codes last."""
    letter = F.substring(rank, 1, 1)
    place = F.array_position(F.array(*map(F.lit, RANKS)), letter)
    known = (F.length(rank) > 1) | (place > 0)
    number = F.when(F.length(rank) == 1, F.lit(0)).otherwise(F.coalesce(F.substring(rank, 2, 20).try_cast("bigint"), F.lit(2**62)))
    return F.struct(F.when(known & (place > 0), place - 1).otherwise(F.lit(10)).alias("place"), F.when(place > 0, number).otherwise(F.lit(0)).alias("number"))


def observed_ranks(report: DataFrame) -> list[str]:
    """Rank codes of the report in order: a few dozen at most."""
    rows = report.select(F.explode("ranks").alias("rank")).distinct().orderBy(rank_key(F.col("rank")), "rank").collect()
    return [r["rank"] for r in rows]


def lineage_columns(report: DataFrame, ranks: list[str] | None = None) -> DataFrame:
    """taxid and one column per rank: the first name of that rank on the path, or null."""
    ranks = observed_ranks(report) if ranks is None else ranks
    at = F.arrays_zip(F.col("ranks").alias("r"), F.col("taxa").alias("t"))

    def first(rank: str) -> Column:
        return F.get(F.filter(at, lambda x: x["r"] == F.lit(rank)), F.lit(0))["t"].alias(rank)

    return report.select("taxid", *map(first, ranks))
