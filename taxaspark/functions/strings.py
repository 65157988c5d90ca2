"""String helpers under the names users of string libraries know. Patterns are regular expressions, unless `fixed`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(pattern: str, fixed: bool) -> str:
    return re.escape(pattern) if fixed else pattern


def detect(text: Column, pattern: str, fixed: bool = False, negate: bool = False) -> Column:
    found = text.contains(pattern) if fixed else text.rlike(pattern)
    return ~found if negate else found


def which(values: Column, pattern: str, fixed: bool = False) -> Column:
    """The 0-based places of an array whose string matches."""
    return F.filter(F.transform(values, lambda x, i: F.when(detect(x, pattern, fixed), i)), lambda i: i.isNotNull())


def subset(values: Column, pattern: str, fixed: bool = False) -> Column:
    return F.filter(values, lambda x: detect(x, pattern, fixed))


def replace(text: Column, pattern: str, by: str, fixed: bool = False) -> Column:
    """The first match only."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{_pattern(pattern, fixed)})", "$1" + by.replace("\\", "\\\\").replace("$", "\\$"))


def replace_all(text: Column, pattern: str, by: str, fixed: bool = False) -> Column:
    return F.replace(text, F.lit(pattern), F.lit(by)) if fixed else F.regexp_replace(text, pattern, by)


def remove(text: Column, pattern: str, fixed: bool = False) -> Column:
    return replace(text, pattern, "", fixed)


def remove_all(text: Column, pattern: str, fixed: bool = False) -> Column:
    return replace_all(text, pattern, "", fixed)


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def split(text: Column, pattern: str, fixed: bool = False) -> Column:
    return F.split(text, _pattern(pattern, fixed), -1)


def count(text: Column, pattern: str, fixed: bool = False) -> Column:
    return F.regexp_count(text, F.lit(_pattern(pattern, fixed))).cast("bigint")


def trim(text: Column, side: str = "both") -> Column:
    """Without white space at the `left`, the `right` or `both` ends."""
    ends = {"left": r"^\s+", "right": r"\s+$", "both": r"^\s+|\s+$"}
    if side not in ends:
        raise ValueError(f"unknown side {side}")
    return F.regexp_replace(text, ends[side], "")
