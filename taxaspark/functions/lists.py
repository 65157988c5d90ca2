"""Small list and string helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def gather(values: Column, places: Column) -> Column:
    """The elements at 0-based places; null where there is none."""
    return F.transform(places, lambda i: F.get(values, i))


def get(values: Column, place: int) -> Column:
    """The element at a 0-based place, from the end if negative; null where there is none."""
    return F.get(values, F.lit(place)) if place >= 0 else F.get(values, F.size(values) + place)


def first(values: Column) -> Column:
    return get(values, 0)


def last(values: Column) -> Column:
    return get(values, -1)


def contains_any(values: Column, wanted: Iterable[str]) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def text_contains_any(text: Column, wanted: Iterable[str]) -> Column:
    """Whether one of the strings occurs in the text."""
    return text.rlike("|".join(map(re.escape, wanted)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
