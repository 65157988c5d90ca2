"""Mixing sources to target weights, by DataFrame functions only.

Each source's share of the words follows its weight; no source is taken more than `most` times, and
what a capped source leaves goes to the others by weight. Rows get hash-random keys and are put in
key order within their source by ranges; prefix sums of the sizes over these ranges say where the
source's budget ends. A budget above the source's size takes whole epochs first.

Null or empty texts have size 0 and are never taken. A null source is a source of its own, last in
order. Repeated rows count each and get keys of their own by their number among equal ones. An empty
table gives an empty result. Columns other than id, text and source are ignored by `plan_mix`, and kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import GAP, WORD, Scratch, copy_numbers, hash_key, null_join, prefix_sums, words_of

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """From (source, source_size): adds target. One row per source, so windows over all of it stay small.

    With the sources in order of cap / weight, those that end at their cap come first: source i is
    capped if the level that the sources from i on would get, once those before it hold their caps,
    reaches its own cap / weight.
    """
    n = len(weights)
    nth = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % n + 1).cast("int"))
    at = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    every = W.partitionBy(F.lit(0))
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    at = (
        at.withColumn("total", F.sum("source_size").over(every) * share)
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_from"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    # the first source that isn't capped sets the level of all the rest
    at = at.withColumn("rest", F.min(F.when(~F.col("capped"), F.struct("caps_before", "level"))).over(every)["level"])
    return at.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, epochs (whole takes), taken (words, repeats counted).

    The taken words of a source are its target, rounded: the row at the end of the budget is taken in part.
    Words are counted once, and the plan is made on the written sizes.
    """
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("_rid"))
    return _plan(Scratch(docs.sparkSession).keep(sized), ["doc_id", "size"], weights, share, most, seed).drop("_rid")


def _plan(sized: DataFrame, names: list[str], weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """`names`: what tells rows apart; equal rows get keys apart by their number among each other."""
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    same = ["source", *names]
    keyed = copy_numbers(sized, same, "_rid", "_copy").withColumn("_key", hash_key(*names, "_copy", seed=seed))
    placed = null_join(prefix_sums(keyed, ["source"], ["_key", *names, "_copy"], "size", "_before"), by_source, ["source"])
    budget = F.round("target").cast("long")
    whole = F.greatest(F.col("source_size"), F.lit(1))
    left = F.pmod(budget, whole)
    epochs = F.when(F.col("source_size") > 0, ((budget - left) / whole)).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before")))
    return placed.withColumn("epochs", epochs).withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("_key", "_copy", "_before")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed rows, with the columns of `docs`: each row as often as it is taken, the last of a budget cut after its last taken word."""
    names, text = docs.columns, F.col("_row.text")
    # rows are numbered and written; the plan is made on ids and sizes, and the texts are shuffled once, to meet it by number
    rows = docs.select(F.struct(*names).alias("_row")).select("_row", words_of(text).alias("size"), F.monotonically_increasing_id().alias("_rid"))
    rows = Scratch(docs.sparkSession).keep(rows.withColumn("_hash", F.xxhash64(text)))
    sized = rows.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), "size", "_hash", "_rid")
    planned = _plan(sized, ["doc_id", "size", "_hash"], weights, share, most, seed).where("taken > 0").select("_rid", "epochs", "taken")
    met = rows.select("_row", "size", "_rid").join(planned, "_rid")
    part = F.col("taken") - F.col("epochs") * F.col("size")
    takes = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when((part > 0), F.array(part)).otherwise(F.array().cast("array<bigint>")))
    taken = met.select("_row", "size", F.explode(takes).alias("_words"))
    pieces = F.regexp_extract_all(text, F.lit(GAP + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), "")
    short = F.col("_words") < F.col("size")
    out = {c: F.col("_row")[c] for c in names}
    out["text"] = F.when(short, cut).otherwise(text)
    if "n_chars" in out:
        out["n_chars"] = F.when(short, F.length(cut).cast("long")).otherwise(out["n_chars"]).cast(dict(docs.dtypes)["n_chars"])
    return taken.select(*[v.alias(k) for k, v in out.items()])
