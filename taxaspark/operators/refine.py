"""Cutting reads and lifting parts of them into tags: one projection compiled from the actions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import Action, RangeLike, cut_out, extra_actions, extract, ub_action
from ..functions.tags import describe

Actions = Action | RangeLike | Iterable[Action | RangeLike] | None


def actions_of(umi: Action | RangeLike | None, barcode: Action | RangeLike | None, extra: Actions) -> list[Action]:
    found = [a for a in (ub_action(umi, "UMI"), ub_action(barcode, "BARCODE")) if a is not None]
    return found + extra_actions(extra)


def _tags(seq: Column, actions: list[Action]) -> dict[str, Column]:
    """Of actions with one tag the last counts. Tags are read before anything is cut."""
    return {a.tag: extract(seq, a.ranges) for a in actions if a.tag is not None}


def _cut(seq: Column, qual: Column, actions: list[Action]) -> tuple[Column, Column]:
    ranges = tuple(r for a in actions if a.cut for r in a.ranges)
    if not ranges:
        return seq, qual
    return cut_out(seq, seq, ranges), cut_out(qual, seq, ranges)


def seq_refine(
    reads: DataFrame, umi_action1: Action | RangeLike | None = None, umi_action2: Action | RangeLike | None = None,
    barcode_action1: Action | RangeLike | None = None, barcode_action2: Action | RangeLike | None = None,
    extra_actions1: Actions = None, extra_actions2: Actions = None,
) -> DataFrame:
    """Reads (id, desc, seq, sep, qual), or pairs (r1, r2), after the actions.

    A tag of both mates is their values joined, and both mates' descriptions get all tags.
    """
    one, two = actions_of(umi_action1, barcode_action1, extra_actions1), actions_of(umi_action2, barcode_action2, extra_actions2)
    if not one and not two:
        raise ValueError("no sequence actions: give one at least")
    paired = "r1" in reads.columns
    if not paired:
        if two:
            raise ValueError("actions on the second mate need paired reads")
        tags = _tags(F.col("seq"), one)
        seq, qual = _cut(F.col("seq"), F.col("qual"), one)
        desc = describe(F.col("desc"), tags) if tags else F.col("desc")
        return reads.withColumns({"desc": desc, "seq": seq, "qual": qual})
    t1, t2 = _tags(F.col("r1.seq"), one), _tags(F.col("r2.seq"), two)
    tags = {k: F.concat(*[t[k] for t in (t1, t2) if k in t]) for k in {*t1, *t2}}
    out = {}
    for r, actions in (("r1", one), ("r2", two)):
        seq, qual = _cut(F.col(f"{r}.seq"), F.col(f"{r}.qual"), actions)
        desc = describe(F.col(f"{r}.desc"), tags) if tags else F.col(f"{r}.desc")
        out[r] = F.struct(F.col(f"{r}.id").alias("id"), desc.alias("desc"), seq.alias("seq"), F.col(f"{r}.sep").alias("sep"), qual.alias("qual"))
    return reads.withColumns(out)
