"""Quality rules with thresholds that follow the corpus.

Counts are taken over each whole text. Fixed base rules come first. Then each document is held
against its own language and source: quantile sketches of four ratios give quartiles, and a document
goes if a ratio lies beyond a fence of `SPREAD` interquartile ranges (and at least a stated distance, since
the quartiles of rare things are equal) outside them. A sketch is a table of counts over bins of equal ratio
(1 + `ACCURACY` wide), so sketches merge by adding and give the same answer however the rows were dealt.
Quartiles of a group of n documents are blended with those of its language, weighing n to `PRIOR`, and those
of the language in the same way with the corpus': there is no size at which the rule changes, and a source
of a few hundred documents is judged by itself, whatever other sources hold.

Null text has no words and fails the base rules. Null language or source is a group of its own.
Repeated rows count each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textnum
from .common import Scratch, bounded_batches, null_join

LEAST_WORDS, MOST_REPEATED = 50, 50
SPREAD = 4.0
ACCURACY = 0.02
#: How many documents of its own a group needs to weigh as much as what it is part of.
PRIOR = 20
#: ratio: (numerator, denominator, distance from the quartiles that is always allowed)
RATIOS = {
    "word_length": ("word_chars", "n_words", 1.0),
    "symbols": ("n_symbols", "n_words", 0.1),
    "dup_lines": ("n_dup_lines", "n_lines", 0.5),
    "repeats": ("n_repeat_words", "n_words", 0.3),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether its row holds it again, and whether it holds it earlier."""
    mixed = textnum.mix(keys ^ textnum.mix(rows.astype(np.uint64), 8))
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    same = s[1:] == s[:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    later[order[1:]] = same
    return again, later


def count_slice(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    per = lambda where: np.diff(np.searchsorted(where, offsets))
    starts, ends = textnum.bounds(data, offsets)
    firsts = np.searchsorted(starts, offsets)
    words = np.diff(firsts)
    chars = np.flatnonzero(~textnum.SPACES[data] & ((data & 0xC0) != 0x80))
    out = {"n_words": words, "word_chars": per(chars), "n_symbols": per(np.flatnonzero(_SYMBOL[data]))}
    # lines
    cuts = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    begin = begin[begin < len(data)]
    stop = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
    ended = (stop > begin) & (stop <= len(data))
    stop = stop - (ended & (data[np.maximum(stop - 1, 0)] == 10))
    filled = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[filled], stop[filled]
    row = np.searchsorted(offsets, begin, "right") - 1
    out["n_lines"] = np.bincount(row, minlength=n)
    _, later = _repeats(textnum.hashes(data, begin, stop, False), row) if len(begin) else (None, np.zeros(0, bool))
    out["n_dup_lines"] = np.bincount(row[later], minlength=n)
    # runs of three words
    hashed = textnum.hashes(data, starts, ends, False)
    keys, runs = textnum.shingles(hashed, firsts, 3, whole_if_short=False)
    covered = np.zeros(len(hashed) + 1, np.int64)
    if len(keys):
        rows = np.repeat(np.arange(n), runs)
        at = np.arange(len(keys)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(firsts[:-1], runs)
        again, _ = _repeats(keys, rows)
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + 3, -1)
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])[firsts])
    return out


def count(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the counts of each text."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"{c} bigint" for c in _COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in textnum.slices(b.column("_text")):
                found = count_slice(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i) for c in keep] + [pa.array(found[c], pa.int64()) for c in _COUNTS], names=[*keep, *_COUNTS])

    return kept.mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def sketches(counted: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ratio, bin, n): the sketch of each ratio; bin 0 holds zero."""
    log = math.log1p(ACCURACY)
    value = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    ratios = F.array(*[F.struct(F.lit(k).alias("ratio"), value(a, b).alias("x")) for k, (a, b, _) in RATIOS.items()])
    one = counted.select(*groups, F.explode(ratios).alias("r"))
    bin_ = F.when(F.col("r.x") <= 0, F.lit(0)).otherwise(F.ceil(F.log("r.x") / log) + 1_000_000).cast("int")
    return one.groupBy(*groups, F.col("r.ratio").alias("ratio"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "ratio", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str], tag: str = "") -> DataFrame:
    """Per group and ratio: docs, q1 and q3, named with the tag."""
    log = math.log1p(ACCURACY)
    w = W.partitionBy(*groups, "ratio")
    at = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    value = F.when(F.col("bin") == 0, 0.0).otherwise(F.exp((F.col("bin") - 1_000_000 - 0.5) * log))
    quart = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, value))
    return at.groupBy(*groups, "ratio").agg(F.max("all").alias(f"{tag}docs"), quart(0.25).alias(f"{tag}q1"), quart(0.75).alias(f"{tag}q3"))


def blended(own: Column, docs: Column, whole: Column) -> Column:
    return (own * docs + whole * PRIOR) / (docs + PRIOR)


def fences(by_source: DataFrame) -> DataFrame:
    """From sketches by lang and source: one row per group, and for each ratio the lowest and highest value allowed."""
    by_lang = merged(by_source, ["lang"])
    levels = null_join(quartiles(by_source, ["lang", "source"]), quartiles(by_lang, ["lang"], "l_"), ["lang", "ratio"])
    levels = null_join(levels, quartiles(merged(by_lang, []), [], "c_"), ["ratio"])
    q = {k: blended(F.col(k), F.col("docs"), blended(F.col(f"l_{k}"), F.col("l_docs"), F.col(f"c_{k}"))) for k in ("q1", "q3")}
    levels = levels.select("lang", "source", "ratio", q["q1"].alias("q1"), q["q3"].alias("q3"))
    aggs = []
    for k, (_, _, far) in RATIOS.items():
        reach = F.greatest(F.lit(far), SPREAD * (F.col("q3") - F.col("q1")))
        aggs += [F.max(F.when(F.col("ratio") == k, F.col("q1") - reach)).alias(f"lo_{k}"), F.max(F.when(F.col("ratio") == k, F.col("q3") + reach)).alias(f"hi_{k}")]
    return levels.groupBy("lang", "source").agg(*aggs)


def judge(counted: DataFrame) -> DataFrame:
    """Adds base_failed and kept to counted rows (with lang and source); reads them twice."""
    names = [f"{e}_{k}" for k in RATIOS for e in ("lo", "hi")]
    by_source = sketches(counted.where(~base_failed()), ["lang", "source"])
    held = null_join(counted, fences(by_source), ["lang", "source"], "left")
    inside = F.lit(True)
    for k, (a, b, _) in RATIOS.items():
        inside = inside & (F.col(a) / F.greatest(F.col(b), F.lit(1))).between(F.col(f"lo_{k}"), F.col(f"hi_{k}"))
    return held.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(*names)


def quality_rules(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    keep = list(dict.fromkeys([*(keep or ["doc_id"]), "lang", "source"]))
    return judge(Scratch(docs.sparkSession).keep(count(docs, keep)))
