"""Joining classified reads with their sequences and tags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import parsed_taxid
from ..functions.ranges import TagRanges, extract
from ..functions.tags import described, encode, merged
from .extract import excluded, include_set, strings

TAXONOMY = ("D__Bacteria", "D__Fungi", "D__Viruses")
EXCLUDE = ("9606",)
Tags = TagRanges | Iterable[TagRanges] | None


def classified(report: DataFrame, koutput: DataFrame, taxonomy: Iterable[str] | None = TAXONOMY, exclude: Iterable[str] | None = EXCLUDE, exclude_mode: str = "substring", strict: bool = True) -> DataFrame:
    """read_id, taxid, length, lca of the reads to join; of equal ids the last line counts where the lines are numbered, else the greatest."""
    taxonomy, exclude = strings(taxonomy), strings(exclude)
    rows = koutput.where("status = 'C'").withColumn("taxid", parsed_taxid(F.col("taxon")))
    rows = rows.join(include_set(report, taxonomy, None, None, None, True, strict), "taxid", "left_semi")
    if exclude:
        rows = rows.where(F.col("lca").isNotNull() & ~excluded(F.col("lca"), exclude, exclude_mode))
    value = F.struct("taxid", "length", "lca")
    order = F.col("line_no") if "line_no" in koutput.columns else value
    return rows.groupBy("read_id").agg(F.max_by(value, order).alias("_v")).select("read_id", "_v.taxid", "_v.length", "_v.lca")


def _list(tags: Tags) -> list[TagRanges]:
    return [] if tags is None else [tags] if isinstance(tags, TagRanges) else list(tags)


def _fixed(tags: dict[str, Column]) -> Column:
    if not tags:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)])


def _checked(ok: Column, length: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("the length in the classifier's output doesn't fit the read: "), length)))


def koutreads(
    report: DataFrame, koutput: DataFrame, reads: DataFrame, tag_ranges1: Tags = None, tag_ranges2: Tags = None,
    taxonomy: Iterable[str] | None = TAXONOMY, exclude: Iterable[str] | None = EXCLUDE, exclude_mode: str = "substring", strict: bool = True,
) -> DataFrame:
    """taxid, tags (map), lca, seq, qual of the classified reads.

    Pairs: with two lengths both mates are kept, joined by a space; with one only the second mate is.
    Header tags of the first mate yield to those of the second and these to tags by range.
    """
    chosen = classified(report, koutput, taxonomy, exclude, exclude_mode, strict)
    one, two = _list(tag_ranges1), _list(tag_ranges2)
    parts = F.split(F.col("length"), "[:|]")
    size = lambda i: F.trim(F.get(parts, i)).cast("int")
    if "r1" not in reads.columns:
        if two:
            raise ValueError("tags on the second mate need paired reads")
        met = reads.join(chosen, F.col("id") == F.col("read_id"))
        paired = F.raise_error(F.lit("the classifier's output is of paired reads, but single reads were given"))
        seq = F.when(F.size(parts) > 1, paired).otherwise(_checked(size(0) == F.length("seq"), F.col("length"), F.col("seq")))
        tags = merged(described(F.col("desc")), _fixed({t.tag: extract(F.col("seq"), t.ranges) for t in one}))
        return met.select("taxid", tags.alias("tags"), "lca", seq.alias("seq"), "qual")
    met = reads.join(chosen, F.col("r1.id") == F.col("read_id"))
    s1, s2 = F.col("r1.seq"), F.col("r2.seq")
    both = F.size(parts) > 1
    fits = F.when(both, (size(0) == F.length(s1)) & (size(1) == F.length(s2))).otherwise(size(0) == F.length(s2))
    t1, t2 = ({t.tag: extract(s, t.ranges) for t in tags} for s, tags in ((s1, one), (s2, two)))
    ranged = {k: F.concat(*[t[k] for t in (t1, t2) if k in t]) for k in {**t1, **t2}}
    tags = merged(described(F.col("r1.desc")), described(F.col("r2.desc")), _fixed(ranged))
    mates = lambda c: F.when(both, F.concat_ws(" ", F.col(f"r1.{c}"), F.col(f"r2.{c}"))).otherwise(F.col(f"r2.{c}"))
    return met.select("taxid", tags.alias("tags"), "lca", _checked(fits, F.col("length"), mates("seq")).alias("seq"), mates("qual").alias("qual"))


def encoded(reads: DataFrame) -> DataFrame:
    """With the tag column as it is written."""
    return reads.withColumn("tags", encode(F.col("tags")))
