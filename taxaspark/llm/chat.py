"""Chat formatting by quotation linking, by DataFrame functions only.

Lines that begin with ">" marks are quotations, one level per mark. A run of lines of one level is a
quoted passage. Passages and their lines are normalised (blanks collapsed, case folded) and hashed,
and so are each message's own lines, paragraphs and whole text. A quoted hash is joined to the latest
earlier message of the conversation that holds it as its own, at every level. Of the lowest level that
has such a message, the one that accounts for most quoted characters is the parent, or else the message
before; the links of all levels come out beside it.

Conversations come out in reply order: a message is followed by its first answer with all that answers it, then
by its second, and so on (`position`). The order is that of a walk around the reply tree, whose steps are
ranked by doubling their jumps: as many joins as the conversation's length has binary digits, however
deep it goes, and only for conversations in which someone answers another message than the last. Messages have
neither quotations nor the line that announces them.

Long conversations and lines that all messages share don't meet in one task: the latest earlier holder is
found over distinct turns, by grouped maxima over ranges of turns and then within a range, and joined back in parts.

Null or empty text gives an empty message, a null turn comes before all others, null conversations
are one conversation. Messages of equal turns keep the order of the table; they don't answer each other, and the
last of them is answered. Repeated rows stay, one position each. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, copy_numbers, let, null_join, salted_join

RANGE = 64
#: A line that announces a quotation.
ANNOUNCES = r"(?i)^\s*(on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*$"
_FIRST = -(2**62)
_LINKS = "array<struct<level: bigint, turn: bigint, chars: bigint>>"


def _norm(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def parse(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds lines: array of (depth, body) of each line of the text."""
    marks = lambda x: F.regexp_extract(x, r"^((?:\x20?>)*)", 1)
    line = lambda x: F.struct(F.length(F.regexp_replace(marks(x), " ", "")).alias("depth"), F.regexp_replace(x, r"^(?:\x20?>)+\x20?", "").alias("body"))
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r", "")
    return messages.withColumn("lines", F.transform(F.split(clean, "\n", -1), line))


def own_text() -> Column:
    """The lines of level 0, but for those that announce a quotation, without blank lines around."""
    quoted_next = lambda i: F.coalesce(F.get("lines", i + 1)["depth"], F.lit(0)) > 0
    own = F.filter("lines", lambda x, i: (x["depth"] == 0) & ~(quoted_next(i) & x["body"].rlike(ANNOUNCES)))
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def passages() -> Column:
    """(depth, body) of each run of quoted lines of one level."""
    depth = lambda i: F.get("lines", i)["depth"]
    changes = F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | (x["depth"] != depth(i - 1)), i)), lambda i: i.isNotNull())

    def runs(at: Column) -> Column:
        body = lambda i, k: F.array_join(F.transform(F.slice("lines", i + 1, F.coalesce(F.get(at, k + 1), F.size("lines")) - i), lambda x: x["body"]), " ")
        return F.filter(F.transform(at, lambda i, k: F.struct(depth(i).alias("depth"), F.when(depth(i) > 0, body(i, k)).alias("body"))), lambda r: r["depth"] > 0)

    return let(changes, runs)


def latest_before(rows: DataFrame, keys: list[str], at: str, source: str, out: str) -> DataFrame:
    """Adds the largest `at` below the row's own among rows of the same keys for which `source` holds; null if none."""
    each = rows.groupBy(*keys, at).agg(F.max(source).alias("_s"), F.count(F.lit(1)).alias("_n")).withColumn("_range", F.floor(F.col(at) / RANGE).cast("bigint"))
    each = Scratch(rows.sparkSession).keep(each)
    mine = F.when(F.col("_s"), F.col(at))
    tops = each.groupBy(*keys, "_range").agg(F.max(mine).alias("_top"))
    tops = tops.withColumn("_before", F.max("_top").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    near = each.withColumn("_near", F.max(mine).over(W.partitionBy(*keys, "_range").orderBy(at).rowsBetween(W.unboundedPreceding, -1)))
    found = null_join(near, tops, [*keys, "_range"]).select(*keys, at, F.coalesce("_near", "_before").alias(out))
    return salted_join(rows, found, [*keys, at], each.select(*keys, at, "_n"))


def positions(rows: DataFrame, key: str, at: str, row: str, out: str) -> DataFrame:
    """Adds the row's place, from 0, within its key by `at` and then in order of `row`, a monotonically_increasing_id."""
    each = rows.groupBy(key, at).agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", F.floor(F.col(at) / RANGE).cast("bigint"))
    each = Scratch(rows.sparkSession).keep(each)
    sizes = each.groupBy(key, "_range").agg(F.sum("_n").alias("_all"))
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_all").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    near = each.withColumn("_near", F.coalesce(F.sum("_n").over(W.partitionBy(key, "_range").orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = null_join(near, sizes, [key, "_range"]).select(key, at, (F.col("_base") + F.col("_near")).alias("_first"))
    put = salted_join(copy_numbers(rows, [key, at], row, "_copy"), base, [key, at], each.select(key, at, "_n"))
    return put.withColumn(out, (F.col("_first") + F.col("_copy")).cast("bigint")).drop("_first", "_copy")


def reply_order(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """From _id, conv_id, _at, place (by turn) and _parent (an _at): _id and position, in order of a walk around the reply tree.

    The walk enters and leaves each message. It enters a message after leaving the one that answers the same message
    before it, or else after entering the message that is answered; it leaves a message after leaving its last answer, or
    else after entering it. `upto` counts the messages entered before a step and after the step `back`.
    """
    own = placed.groupBy("conv_id").agg(F.min("_id").alias("_conv"), F.count(F.lit(1)).alias("_n"))
    own = scratch.keep(own)
    rows = salted_join(placed, own.drop("_n"), ["conv_id"], own.drop("_conv")).select("_id", "_conv", "_at", "_parent", "place")
    rows = scratch.keep(rows)
    above = rows.groupBy("_conv", "_at").agg(F.max("place").alias("_above")).withColumnRenamed("_at", "_parent")
    answers = rows.groupBy("_conv", "_parent").agg(F.count(F.lit(1)).alias("_n"))
    tree = salted_join(rows, above, ["_conv", "_parent"], answers, "left").drop("_at", "_parent")
    tree = scratch.keep(latest_before(tree.withColumn("_true", F.lit(True)), ["_conv", "_above"], "place", "_true", "_before"))
    last = tree.where("_above is not null").groupBy("_conv", F.col("_above").alias("place")).agg(F.max("place").alias("_last"))
    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    into = tree.select("_conv", enter("place").alias("step"), F.coalesce(leave("_before"), enter("_above")).alias("back"))
    out = tree.join(last, ["_conv", "place"], "left").select("_conv", leave("place").alias("step"), F.coalesce(leave("_last"), enter("place")).alias("back"))
    steps = into.unionByName(out).withColumn("upto", F.when(F.col("back") % 2 == 0, 1).otherwise(0).cast("bigint"))
    steps = scratch.keep(steps)
    while steps.where("back is not null").limit(1).count():
        there = steps.select("_conv", F.col("step").alias("back"), F.col("back").alias("_back"), F.col("upto").alias("_upto"))
        met = steps.where("back is not null").join(there, ["_conv", "back"]).select("_conv", "step", F.col("_back").alias("back"), (F.col("upto") + F.col("_upto")).alias("upto"))
        before, steps = steps, scratch.keep(met.unionByName(steps.where("back is null")))
        scratch.drop(before)
    entered = steps.where("step % 2 = 0").select("_conv", (F.col("step") / 2).cast("bigint").alias("place"), F.col("upto").alias("position"))
    return rows.select("_id", "_conv", "place").join(entered, ["_conv", "place"]).select("_id", "position")


def link(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, position (in reply order), parent_turn, quotes (whether a quotation names the parent), links (level, turn and characters of each message quoted), n_quoted, levels, message, formatted."""
    scratch = Scratch(messages.sparkSession)
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    parsed = parsed.select(
        F.monotonically_increasing_id().alias("_id"), "conv_id", "turn", "role", F.coalesce(F.col("turn").cast("bigint"), F.lit(_FIRST)).alias("_at"),
        own_text().alias("message"), passages().alias("_passages"), F.filter("lines", lambda x: x["depth"] > 0).alias("_quoted"),
    )
    parsed = scratch.keep(parsed)
    quoting = parsed.where(F.size("_quoted") > 0)
    # only conversations in which something is quoted need an index of their messages
    some = parsed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("_quoted")).alias("_most")).where("_most > 0")
    some = scratch.keep(some)
    indexed = salted_join(parsed.select("conv_id", "_at", "message"), some.select("conv_id", F.lit(True).alias("_some")), ["conv_id"], some.select("conv_id", "_n"))
    parts = F.concat(F.array("message"), F.split("message", r"\n\s*\n"), F.split("message", "\n"))
    originals = indexed.select("conv_id", "_at", F.explode(F.array_distinct(F.filter(F.transform(parts, _norm), lambda x: F.length(x) > 0))).alias("_x"))
    originals = originals.select("conv_id", "_at", F.xxhash64("_x").alias("_hash"), F.lit(True).alias("_source"), F.lit(None).cast("bigint").alias("_id"), F.lit(0).alias("_size"), F.lit(0).alias("_level"))
    quoted = quoting.select("_id", "conv_id", "_at", F.explode(F.concat("_passages", "_quoted")).alias("_q"))
    quoted = quoted.withColumn("_x", _norm(F.col("_q.body"))).where("_x <> ''").select("conv_id", "_at", F.xxhash64("_x").alias("_hash"), F.lit(False).alias("_source"), "_id", F.length("_x").alias("_size"), F.col("_q.depth").alias("_level"))
    met = latest_before(scratch.keep(originals.unionByName(quoted)), ["conv_id", "_hash"], "_at", "_source", "_to").where("not _source and _to is not null")
    votes = met.groupBy("_id", "_level", "_to").agg(F.sum("_size").alias("_weight"))
    one = F.struct(F.col("_level").cast("bigint").alias("level"), F.when(F.col("_to") != _FIRST, F.col("_to")).alias("turn"), F.col("_weight").alias("chars"))
    votes = votes.groupBy("_id").agg(F.max(F.struct(-F.col("_level"), "_weight", "_to")).alias("_best"), F.array_sort(F.collect_list(one)).alias("_links"))
    # order and parents are found on ids and turns; the messages' text is joined to them once
    named = parsed.select("_id", "conv_id", "_at", F.lit(True).alias("_true"))
    placed = positions(latest_before(named, ["conv_id"], "_at", "_true", "_last"), "conv_id", "_at", "_id", "place")
    placed = placed.join(votes.select("_id", F.col("_best._to").alias("_linked"), "_links"), "_id", "left").withColumn("_parent", F.coalesce("_linked", "_last"))
    placed = scratch.keep(placed.select("_id", "conv_id", "_at", "place", "_parent", "_linked", "_last", "_links"))
    # where all answer the last message, the order is that of turns
    branched = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.coalesce(F.col("_linked") != F.col("_last"), F.lit(False))).alias("_any")).where("_any")
    branched = scratch.keep(branched.select("conv_id", "_n", F.lit(True).alias("_some")))
    moved = placed.select("_id", F.lit(None).cast("bigint").alias("position")).limit(0)
    if branched.limit(1).count():
        moved = reply_order(salted_join(placed.select("_id", "conv_id", "_at", "place", "_parent"), branched.drop("_n"), ["conv_id"], branched.drop("_some")).drop("_some"), scratch)
    placed = placed.join(moved, "_id", "left").select("_id", F.coalesce("position", "place").alias("position"), "_parent", "_linked", "_links")
    return parsed.join(placed, "_id").select(
        "conv_id", "turn", "role", "position", F.when(F.col("_parent") != _FIRST, F.col("_parent")).alias("parent_turn"), F.col("_linked").isNotNull().alias("quotes"),
        F.coalesce("_links", F.array().cast(_LINKS)).alias("links"),
        F.size("_quoted").cast("bigint").alias("n_quoted"), F.coalesce(F.array_max(F.transform("_quoted", lambda x: x["depth"])), F.lit(0)).cast("bigint").alias("levels"),
        "message", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("message"), F.lit("\n")).alias("formatted"),
    )
