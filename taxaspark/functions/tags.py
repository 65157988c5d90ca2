"""Tags in read descriptions and in the tag column of joined reads."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks around the tags of a description.
TAG_PREFIX, TAG_SUFFIX = "MIRE{", "}"


def describe(desc: Column, tags: dict[str, Column]) -> Column:
    """The description followed by the block of tags, by name."""
    parts = [p for k in sorted(tags) for p in (F.lit(k), tags[k])]
    return F.concat_ws(" ", desc, F.concat(F.lit(TAG_PREFIX), F.concat_ws(":", *parts), F.lit(TAG_SUFFIX)))


def described(desc: Column) -> Column:
    """The tags of the first block of a description; of equal names the later wins, a name without value is ignored."""
    block = F.regexp_extract(F.coalesce(desc, F.lit("")), f"{re.escape(TAG_PREFIX)}([^}}]*){re.escape(TAG_SUFFIX)}", 1)
    parts = F.split(block, ":", -1)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.get(parts, i * 2).alias("key"), F.get(parts, i * 2 + 1).alias("value")))
    return F.when(F.size(parts) < 2, F.create_map().cast("map<string,string>")).otherwise(later_wins(pairs))


def later_wins(pairs: Column) -> Column:
    """A map from (key, value) structs in which the last of equal keys stays, whatever the session's policy."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i")))
    last = F.filter(numbered, lambda p: ~F.exists(numbered, lambda q: (q["key"] == p["key"]) & (q["i"] > p["i"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def merged(*maps: Column) -> Column:
    """Maps as one; later ones win."""
    return later_wins(F.concat(*[F.map_entries(m) for m in maps]))


def encode(tags: Column) -> Column:
    """NAME:VALUE, by name, with spaces between."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")


def decode(column: Column) -> Column:
    """The map behind encode()."""
    none = F.create_map().cast("map<string,string>")
    return F.when(F.coalesce(column, F.lit("")) == "", none).otherwise(later_wins(F.transform(F.split(column, " "), _pair)))


def _pair(p: Column) -> Column:
    return F.struct(F.substring_index(p, ":", 1).alias("key"), F.regexp_extract(p, r"^[^:]*:(.*)$", 1).alias("value"))


def value_of(column: Column, name: str) -> Column:
    """The value under a name in an encoded column; an error if it isn't there."""
    found = F.get(F.filter(F.split(F.coalesce(column, F.lit("")), " "), lambda p: p.startswith(f"{name}:")), F.lit(0))
    return F.when(found.isNull(), F.raise_error(F.lit(f"no tag {name}"))).otherwise(F.substring(found, len(name) + 2, 2**31 - 1))
