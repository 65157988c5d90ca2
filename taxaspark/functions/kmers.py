"""Read filters and k-mers of classified reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIN_QUAL_BYTE = 53  # Phred 20 at offset 33
COMPLEXITY = 20  # bases of a read that must differ from any one letter
MATES = "|:|"  # between the k-mer lists of two mates
TAXID_PATTERN = r"\(taxid ([^)]*)\)"


def parsed_taxid(field: Column) -> Column:
    """N of "name (taxid N)", or the field itself."""
    return F.coalesce(F.nullif(F.regexp_extract(field, TAXID_PATTERN, 1), F.lit("")), field)


def quality_ok(qual: Column, least: int = MIN_QUAL_BYTE) -> Column:
    """Every quality byte reaches `least`; a space between mates isn't one."""
    return ~F.replace(qual, F.lit(" "), F.lit("")).rlike(f"[\\x00-\\x{least - 1:02x}]")


def complexity_ok(seq: Column, least: int = COMPLEXITY) -> Column:
    """No letter makes up more than length - `least`. Shorter reads than that pass."""
    n = F.length(seq)
    most = F.array_max(F.transform(F.array_distinct(F.split(seq, "")), lambda c: n - F.length(F.replace(seq, c, F.lit("")))))
    return (n < least) | (F.coalesce(most, F.lit(0)) <= n - least)


def mates(column: Column, separator: str) -> Column:
    return F.split(column, separator.replace("|", r"\|"))


def lca_pairs(lca: Column) -> Column:
    """(taxon, n) of "taxon:n taxon:n"; a malformed pair raises when read."""
    one = lambda p: F.struct(F.regexp_extract(p, r"^(.*):", 1).alias("taxon"), F.regexp_extract(p, r":?([^:]*)$", 1).cast("int").alias("n"))
    return F.transform(F.split(F.trim(lca), r"\s+"), one)


def k_of(seq: Column, lca: Column) -> Column:
    """The k that gives as many k-mers as the list counts; an error if none does."""
    total = F.aggregate(lca_pairs(lca), F.lit(0), lambda a, x: a + x["n"])
    k = F.length(seq) + 1 - total
    return F.when((total <= 0) | (k < 1), F.raise_error(F.concat(F.lit("k-mer list doesn't fit the read: "), lca))).otherwise(k)


def kmers(seq: Column, k: Column) -> Column:
    """All runs of k letters."""
    return F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, k))


def read_kmers(seq: Column, lca: Column) -> Column:
    """The k-mers of a read, or of both mates."""
    both = F.arrays_zip(F.split(seq, " ").alias("s"), mates(lca, MATES).alias("l"))
    clean = lambda x: F.trim(x)
    return F.flatten(F.transform(both, lambda m: kmers(m["s"], k_of(m["s"], clean(m["l"])))))
