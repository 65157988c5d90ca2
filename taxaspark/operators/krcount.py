"""Counts of reads, UMIs and k-mers per (barcode, taxon), rolled up over the taxonomy.

Reads are parsed once, into items: one that counts the read and its k-mers, one of its UMI and one of each
k-mer. Items are added up per (barcode, taxid, item) before the roll-up, a join with the closure of (taxid,
ancestor), and again after it, since the union of sets does not mind what came twice. So what the join
multiplies is small, and reads, UMIs and k-mers share one scan and its shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import complexity_ok, quality_ok, read_kmers
from ..functions.lists import let
from ..functions.tags import value_of
from .taxonomy import closure, filter_taxonomy, lineage_columns

TAXONOMY = ("D__Bacteria", "D__Fungi", "D__Viruses")


def sound() -> Column:
    """Whether a read is of good quality and isn't made of one letter; each mate on its own."""
    return quality_ok(F.col("qual")) & F.forall(F.split("seq", " "), lambda s: complexity_ok(s))


def _tag(reads: DataFrame, name: str | None, column: Column) -> Column:
    if name is None:
        return F.lit(None).cast("string")
    if dict(reads.dtypes)["tags"].startswith("map"):
        return F.coalesce(F.try_element_at("tags", F.lit(name)), F.raise_error(F.lit(f"no tag {name}")))
    return value_of(column, name)


_READ, _UMI, _KMER = 0, 1, 2


def krcount(
    reads: DataFrame, report: DataFrame, umi_tag: str | None = None, barcode_tag: str | None = None, taxonomy: Iterable[str] | None = TAXONOMY, distinct: str = "exact", strict: bool = True,
) -> DataFrame:
    """barcode, taxid, reads, umi, kmer_total, kmer_unique for each taxon of the report that has reads at or below it.

    `reads` are joined reads (taxid, tags, lca, seq, qual), `tags` a map or as written. Without a tag the barcode is null, and
    the UMIs are 0. `distinct` may be "sketch" for approximate k-mer counts of bounded size. `strict`: a taxonomy that
    matches no row of the report is an error, which takes a job over the report.
    """
    if distinct not in ("exact", "sketch"):
        raise ValueError("`distinct` is exact or sketch")
    pairs = closure(filter_taxonomy(report, taxonomy, strict) if taxonomy else report)
    good = reads.join(pairs.select("taxid").distinct(), "taxid", "left_semi")
    item = lambda tag, value, n: F.struct(F.lit(tag).alias("tag"), value.cast("string").alias("value"), n.cast("bigint").alias("n"))
    umi = _tag(good, umi_tag, F.col("tags"))

    def items(kmers: Column) -> Column:
        own = F.array(item(_READ, F.lit(None), F.size(kmers)), item(_UMI, umi, F.lit(0)))
        return F.concat(F.filter(own, lambda x: (x["tag"] != _UMI) | x["value"].isNotNull()), F.transform(kmers, lambda k: item(_KMER, k, F.lit(0))))

    # reads that aren't sound have no items, and their lists are never parsed
    parsed = F.when(sound(), let(read_kmers(F.col("seq"), F.col("lca")), items if distinct == "exact" else lambda k: F.slice(items(k), 1, 2)))
    rows = good.select("taxid", _tag(good, barcode_tag, F.col("tags")).alias("barcode"), F.explode(parsed).alias("x")).select("taxid", "barcode", "x.*")
    if umi_tag is None:
        rows = rows.where(F.col("tag") != _UMI)
    up = lambda df: df.join(pairs, "taxid").drop("taxid").withColumnRenamed("ancestor", "taxid")
    added = lambda df: df.groupBy("barcode", "taxid", "tag", "value").agg(F.sum("n").alias("n"), F.sum("reads").alias("reads"))
    each = added(up(added(rows.withColumn("reads", F.lit(1)))))
    of = lambda tag, c: F.sum(F.when(F.col("tag") == tag, F.col(c))).cast("bigint")
    many = lambda tag: F.count_if(F.col("tag") == tag)
    out = each.groupBy("barcode", "taxid").agg(of(_READ, "reads").alias("reads"), many(_UMI).alias("umi"), of(_READ, "n").alias("kmer_total"), many(_KMER).alias("kmer_unique"))
    if distinct == "exact":
        return out
    kmers = good.select("taxid", _tag(good, barcode_tag, F.col("tags")).alias("barcode"), F.explode(F.when(sound(), read_kmers(F.col("seq"), F.col("lca")))).alias("kmer"))
    sketched = kmers.groupBy("barcode", "taxid").agg(F.hll_sketch_agg("kmer").alias("s"))
    unique = up(sketched).groupBy("barcode", "taxid").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("kmer_unique"))
    unique = unique.select(F.col("barcode").alias("_b"), F.col("taxid").alias("_t"), "kmer_unique")
    met = out.drop("kmer_unique").join(unique, F.col("barcode").eqNullSafe(F.col("_b")) & (F.col("taxid") == F.col("_t")), "left")
    return met.select("barcode", "taxid", "reads", "umi", "kmer_total", F.coalesce("kmer_unique", F.lit(0)).cast("bigint").alias("kmer_unique"))


@dataclass
class CountTables:
    """One row per taxon of the report in each: its path by rank; reads, k-mers and distinct k-mers by barcode, null where there are none."""

    taxa: DataFrame
    counts: DataFrame
    kmer_total: DataFrame
    kmer_unique: DataFrame


def count_tables(counts: DataFrame, report: DataFrame, barcodes: list[str] | None = None) -> CountTables:
    """The four tables of counts, for few barcodes (all, unless they are given)."""
    taxa = lineage_columns(report)
    tables = [taxa.select("taxid").join(_pivot(counts, value, barcodes), "taxid", "left") for value in ("reads", "kmer_total", "kmer_unique")]
    return CountTables(taxa, *tables)


def _pivot(counts: DataFrame, value: str, barcodes: list[str] | None) -> DataFrame:
    return counts.withColumn("barcode", F.coalesce("barcode", F.lit("all"))).groupBy("taxid").pivot("barcode", barcodes).agg(F.first(value))


def wide(counts: DataFrame, report: DataFrame, value: str = "reads", barcodes: list[str] | None = None) -> DataFrame:
    """One row per taxon of the report, its path by rank, and one column per barcode; for few barcodes. Null where there is nothing."""
    return lineage_columns(report).join(_pivot(counts, value, barcodes), "taxid", "left")
