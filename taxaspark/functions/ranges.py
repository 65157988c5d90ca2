"""Positions in reads: ranges, what to do with them, and the Column expressions they compile to.

Ranges are given 1-based and inclusive, as users count bases. A set of ranges is put in order and
checked when it is made, so a plan holds only constant slices.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeqRange:
    """From `start` to `end`, both 1-based and included; a missing one reaches to the end of the read."""

    start: int | None = None
    end: int | None = None

    def __post_init__(self):
        for name in ("start", "end"):
            v = getattr(self, name)
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 1):
                raise ValueError(f"`{name}` must be a whole number of 1 or more")
        if self.start is None and self.end is None:
            raise ValueError("one of `start` and `end` must be given")
        if self.start is not None and self.end is not None and self.start > self.end:
            raise ValueError(f"`start` ({self.start}) lies behind `end` ({self.end})")

    @property
    def lo(self) -> int:
        """0-based start."""
        return (self.start or 1) - 1

    @property
    def kind(self) -> str:
        return "to" if self.start is None else "from" if self.end is None else "span"

    def __str__(self) -> str:
        return f"{self.start or ''}-{self.end or ''}"

    @property
    def ranges(self) -> tuple[SeqRange, ...]:
        return (self,)


@dataclass(frozen=True)
class SeqRanges:
    ranges: tuple[SeqRange, ...]

    def __str__(self) -> str:
        return f"<{len(self.ranges)} ranges: {', '.join(map(str, self.ranges))}>"


RangeLike = SeqRange | SeqRanges


def seq_range(start: int | None = None, end: int | None = None) -> SeqRange:
    return SeqRange(start, end)


def combine(*ranges: RangeLike) -> SeqRanges:
    """All ranges as one flat set; anything else, actions included, is refused."""
    flat: list[SeqRange] = []
    for r in ranges:
        if not isinstance(r, (SeqRange, SeqRanges)):
            raise TypeError(f"only ranges can be combined, not {type(r).__name__}")
        flat += r.ranges
    return SeqRanges(tuple(flat))


def ordered(ranges: RangeLike) -> tuple[SeqRange, ...]:
    """Open-started ranges first, then spans by start, open-ended ones last."""
    rank = {"to": 0, "span": 1, "from": 2}
    return tuple(sorted(ranges.ranges, key=lambda r: (rank[r.kind], r.lo, r.end or 0)))


def disjoint(ranges: RangeLike) -> tuple[SeqRange, ...]:
    """In order; an error if two overlap. Touching is allowed."""
    out = ordered(ranges)
    for kind in ("to", "from"):
        if sum(r.kind == kind for r in out) > 1:
            raise ValueError(f"more than one range is open at its {'start' if kind == 'to' else 'end'}")
    for a, b in zip(out, out[1:], strict=False):
        if a.end is None or b.lo < a.end:
            raise ValueError(f"ranges {a} and {b} overlap")
    return out


@dataclass(frozen=True)
class Action:
    """What to do with ranges of a read: record them under a tag, cut them out, or both."""

    ranges: tuple[SeqRange, ...]
    tag: str | None
    cut: bool


@dataclass(frozen=True)
class TagRanges:
    tag: str
    ranges: tuple[SeqRange, ...]


def _tag_name(tag: str) -> str:
    if not isinstance(tag, str) or not tag:
        raise ValueError("a tag must be a string that isn't empty")
    return tag


def embed(tag: str, ranges: RangeLike) -> Action:
    return Action(disjoint(combine(ranges)), _tag_name(tag), False)


def trim(ranges: RangeLike) -> Action:
    return Action(ordered(combine(ranges)), None, True)


def embed_trim(tag: str, ranges: RangeLike) -> Action:
    return Action(disjoint(combine(ranges)), _tag_name(tag), True)


def tag(name: str, ranges: RangeLike) -> TagRanges:
    return TagRanges(_tag_name(name), disjoint(combine(ranges)))


def ub_action(action: Action | RangeLike | None, name: str) -> Action | None:
    """For a UMI or barcode, bare ranges mean: record under `name` and cut."""
    if action is None or isinstance(action, Action):
        return action
    return embed_trim(name, action)


def extra_actions(actions: Action | RangeLike | Iterable[Action | RangeLike] | None) -> list[Action]:
    """Bare ranges mean: cut."""
    if actions is None:
        return []
    if isinstance(actions, (Action, SeqRange, SeqRanges)):
        actions = [actions]
    return [a if isinstance(a, Action) else trim(a) for a in actions]


def _within(seq: Column, ranges: Iterable[SeqRange], value: Column) -> Column:
    """`value`, or an error if a range doesn't lie in the read. The check is part of the value, so it can't be pruned."""
    bad = F.lit(False)
    for r in ranges:
        bad = bad | (F.length(seq) < r.end if r.end is not None else F.length(seq) <= r.lo)
    text = ", ".join(map(str, ranges))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"range out of bounds: {text} of a read of length "), F.length(seq).cast("string")))).otherwise(value)


def slice_of(seq: Column, lo: int, hi: int | None) -> Column:
    return F.substring(seq, lo + 1, 2**31 - 1 - lo if hi is None else hi - lo)


def extract(seq: Column, ranges: tuple[SeqRange, ...]) -> Column:
    """The ranges of `seq`, joined in order."""
    return _within(seq, ranges, F.concat(*[slice_of(seq, r.lo, r.end) for r in ranges]))


def kept_slices(ranges: Iterable[SeqRange]) -> list[tuple[int, int | None]]:
    """What cutting the union of the ranges leaves, as 0-based half-open slices."""
    out: list[tuple[int, int | None]] = []
    at = 0
    for r in sorted(ranges, key=lambda r: r.lo):
        if r.lo > at:
            out.append((at, r.lo))
        if r.end is None:
            return out
        at = max(at, r.end)
    return [*out, (at, None)]


def cut_out(value: Column, seq: Column, ranges: tuple[SeqRange, ...]) -> Column:
    """`value` (the read or its qualities) without the union of the ranges, in original coordinates."""
    keep = kept_slices(ranges)
    return _within(seq, ranges, F.concat(*[slice_of(value, a, b) for a, b in keep]) if keep else F.lit(""))
