"""Telling signal from noise: reference quantile test, sample and barcode level correlations, counts."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import binomial_p, cor_tests, p_adjust, quantile_nearest

TAXON = ("d__Bacteria", "d__Fungi", "d__Viruses")


def _named(rank: Column, taxon: Column) -> Column:
    return F.concat_ws("__", F.lower(rank), taxon)


def rpmm(kreports: DataFrame, taxon: Iterable[str] = TAXON, sample: str = "sample") -> DataFrame:
    """sample, taxid, taxa, rpmm: reads of a taxon per million reads of the selected domains, for rows at or below an entry of `taxon` (lower-case rank)."""
    entries = F.array(*map(F.lit, taxon))
    last = lambda c: F.element_at(c, -1)
    rows = kreports.withColumn("_own", F.array_contains(entries, _named(last("ranks"), last("taxa"))))
    total = rows.groupBy(sample).agg(F.sum(F.when(F.col("_own"), F.col("total_reads"))).cast("double").alias("_total"))
    path = F.transform(F.arrays_zip(F.col("ranks").alias("r"), F.col("taxa").alias("t")), lambda x: _named(x["r"], x["t"]))
    below = rows.where(F.arrays_overlap(path, entries))
    return below.join(total, sample).select(sample, "taxid", F.col("taxon").alias("taxa"), (F.col("total_reads") / F.col("_total") * 1_000_000).alias("rpmm"))


@dataclass
class QuantileTest:
    """table: taxid, taxa, rpmm, study. tests: taxid, taxa, pvalue, matched, significant, truly."""

    table: DataFrame
    tests: DataFrame

    def truly(self) -> DataFrame:
        return self.tests.where("truly").select("taxid").distinct()

    def plot_data(self) -> DataFrame:
        """What a density plot by study and taxon shows: truly significant matched taxa, with their p-values, the taxa in order of them."""
        return self.table.join(self.tests.where("significant and matched").select("taxid", "taxa", "pvalue"), ["taxid", "taxa"]).orderBy("pvalue", "taxid")


def quantile_test(values: DataFrame, keys: list[str], value: str, ref: str, p: float = 0.5, alternative: str = "greater") -> DataFrame:
    """Per group pvalue: whether `value` lies beyond `ref` at quantile `p`. Null without a reference. Two-sided values may exceed 1, as twice the smaller tail."""
    if alternative not in ("two.sided", "less", "greater"):
        raise ValueError(f"unknown alternative {alternative}")
    got = values.groupBy(*keys).agg(
        F.count_if(F.col(value) <= F.col(ref)).alias("_t1"), F.count_if(F.col(value) < F.col(ref)).alias("_t2"), F.count(F.lit(1)).alias("_n"), F.max(ref).alias("_ref")
    )
    n = F.when(F.col("_ref").isNotNull(), F.col("_n"))
    return got.select(*keys, binomial_p(F.col("_t1"), F.col("_t2"), n, p, alternative).alias("pvalue"))


def rpmm_quantile(
    kreports: DataFrame, reference: DataFrame, study: str = "current study", taxon: Iterable[str] = TAXON, quantile: float = 0.95, alpha: float = 0.05,
    alternative: str = "greater", drop_unmatched_taxa: bool = True, p: float = 0.5, dedup_reference: bool = False, interpolation: str = "nearest", reference_study: str = "cell lines",
) -> QuantileTest:
    """Taxa whose reads per million lie above the reference's quantile.

    `reference` has taxid and rpmm. It is repeated once per sample that holds the taxid before its quantile is
    taken, unless `dedup_reference`.
    """
    found = rpmm(kreports, taxon)
    held = reference.select("taxid", F.col("rpmm").alias("_ref"))
    matched = found.select("taxid", "taxa").join(held, "taxid").withColumnRenamed("_ref", "rpmm")
    base = held.join(found.select("taxid").distinct(), "taxid", "left_semi").withColumnRenamed("_ref", "rpmm") if dedup_reference else matched
    cut = quantile_nearest(base, ["taxid"], "rpmm", quantile, "ref", interpolation)
    with_ref = found.join(cut, "taxid", "left")
    tests = quantile_test(with_ref, ["taxid", "taxa"], "rpmm", "ref", p, alternative)
    tests = tests.join(cut.select("taxid", F.lit(True).alias("_m")), "taxid", "left").withColumn("matched", F.coalesce("_m", F.lit(False))).drop("_m")
    tests = tests.withColumn("significant", F.coalesce(F.col("pvalue") < alpha, F.lit(False)))
    tests = tests.withColumn("truly", F.col("significant") | (F.lit(not drop_unmatched_taxa) & ~F.col("matched")))
    table = found.select("taxid", "taxa", "rpmm", F.lit(study).alias("study")).unionByName(matched.select("taxid", "taxa", "rpmm", F.lit(reference_study).alias("study")))
    return QuantileTest(table, tests)


def _groups_of(rows: DataFrame, least: int, keys: list[str]) -> DataFrame:
    return rows.withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("_rows") >= least).drop("_rows")


def slsd(kreports: DataFrame, method: str = "spearman", min_reads: int = 3, min_minimizer_n_unique: int = 3, min_samples: int = 3, **test) -> DataFrame:
    """taxid, taxa, r1-r3, p1-p3: correlations over samples of minimizers, distinct minimizers and reads."""
    rows = kreports.where((F.col("total_reads") >= min_reads) & (F.col("minimizer_n_unique") >= min_minimizer_n_unique))
    pairs = {"r1": ("minimizer_len", "minimizer_n_unique", "p1"), "r2": ("minimizer_len", "total_reads", "p2"), "r3": ("total_reads", "minimizer_n_unique", "p3")}
    return cor_tests(_groups_of(rows, min_samples, ["taxid", "taxa"]), ["taxid", "taxa"], pairs, method, **test).select("taxid", "taxa", "r1", "r2", "r3", "p1", "p2", "p3")


def blsd(kmer: DataFrame, method: str = "spearman", min_kmer_len: int = 3, min_cells: int = 3, p_adjust_method: str = "BH", within: list[str] | None = None, **test) -> DataFrame:
    """taxid, taxa, cor, pvalue, padj: correlations over barcodes of k-mers and distinct k-mers. With `within`, each group of these columns is tested by itself, and they come first."""
    keys = [*(within or []), "taxid", "taxa"]
    rows = _groups_of(kmer.where(F.col("kmer_len") >= min_kmer_len), min_cells, keys)
    tested = cor_tests(rows, keys, {"cor": ("kmer_len", "kmer_n_unique", "pvalue")}, method, **test)
    return p_adjust(tested, "pvalue", "padj", p_adjust_method, within)


def taxa_counts(umi: DataFrame, barcode: str = "barcode", sample: str = "sample") -> DataFrame:
    """Distinct UMIs per sample, barcode and taxon."""
    return umi.groupBy(sample, barcode, "taxid").agg(F.count_distinct("umi").alias("counts"))


@dataclass
class Denoised:
    counts: DataFrame
    slsd: DataFrame
    quantile_test: QuantileTest


def slsd_passed(tests: DataFrame, cor_threshold: float = 0, p_threshold: float = 0.05) -> DataFrame:
    """Taxids all of whose correlations are high enough and significant."""
    ok = F.lit(True)
    for k in "123":
        ok = ok & (F.col(f"r{k}") > cor_threshold) & (F.col(f"p{k}") < p_threshold)
    return tests.where(ok).select("taxid").distinct()


def by_sample(frames: DataFrame | dict[str, DataFrame]) -> DataFrame:
    """One frame with a column `sample`, which a frame that isn't given by sample name already has."""
    if isinstance(frames, DataFrame):
        return frames
    return functools.reduce(DataFrame.unionByName, [df.withColumn("sample", F.lit(name)) for name, df in frames.items()])


def denoise_counts(
    kreports: DataFrame, kmers: DataFrame | dict[str, DataFrame], umis: DataFrame | dict[str, DataFrame], reference: DataFrame, taxon: Iterable[str] = TAXON, drop_unmatched_taxa: bool = True,
    quantile: float = 0.95, alpha: float = 0.05, min_reads: int = 3, min_minimizer_n_unique: int = 3, min_samples: int = 3, min_kmer_len: int = 3, min_cells: int = 3,
    cor_threshold: float = 0, p_threshold: float = 0.05, padj_threshold: float = 0.05, study: str = "current study", alternative: str = "greater", p_adjust_method: str = "BH",
    method: str = "spearman", **test,
) -> Denoised:
    """UMI counts of the taxa that pass all three tests, per sample.

    `kmers` and `umis` have a column `sample`, or are given by sample name. All samples are one plan, keyed by sample.
    """
    if isinstance(kmers, dict) and isinstance(umis, dict) and kmers.keys() != umis.keys():
        raise ValueError("`kmers` and `umis` must hold the same samples")
    tested = rpmm_quantile(kreports, reference, study, taxon, quantile, alpha, alternative, drop_unmatched_taxa)
    samples = slsd(kreports, method, min_reads, min_minimizer_n_unique, min_samples, **test)
    passed = slsd_passed(samples, cor_threshold, p_threshold).join(tested.truly(), "taxid", "left_semi")
    cells = blsd(by_sample(kmers), method, min_kmer_len, min_cells, p_adjust_method, ["sample"], **test)
    real = cells.where(F.col("padj") < padj_threshold).select("sample", "taxid").join(passed, "taxid", "left_semi")
    return Denoised(taxa_counts(by_sample(umis).join(real, ["sample", "taxid"], "left_semi")), samples, tested)
