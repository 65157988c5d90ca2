"""URL filtering by host and path rules: a sort-merge range join over reversed hosts.

A rule names a host and a path. It covers the host and its subdomains, for urls whose path starts
with the rule's. The reversed host ("net.example.") turns "host and subdomains" into an interval of
keys, since every covered key starts with the rule's. Rules and urls are one table, dealt out by key
range and sorted, a rule before the keys that it covers; a sweep keeps the stack of intervals that are
open at the current key. Intervals nest or are disjoint, so the stack is the chain of rules over one host.
The path decides among them, and the longest fitting rule (host and path together) wins.

Ranges are cut by hashes of the urls within a key, so a hot host is spread. An interval may reach over
several ranges: the ranges' first and last keys are gathered, and each rule is written once to every range that its
interval meets, so every sweep has the rules open at its first key. However many rules there are, they are
rows: no list of them is held anywhere but the stack.

Of rules with the same host and path, "block" outweighs "allow" and other verdicts, and of those the last in
code-point order counts. Hosts of rules are lower-cased as those of urls are. Null or odd urls: without "://"
host and path are empty and no rule fits. Repeated rows and pages with equal urls are judged alike. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where there is no "://"."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def reversed_key(host: Column) -> Column:
    """"a.example.net" becomes "net.example.a."; the empty host becomes "."."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _swept(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows come by range and key, rules before urls of one key. Every range brings the rules that are open at its start."""
    stack: list[tuple[str, dict[str, tuple[str, str]]]] = []  # (key, {path: (rule, verdict)}), each key a prefix of the next
    chain: list[tuple[int, str, str, str]] | None = None  # the rules over the current key, longest first
    at, key = None, None
    for b in batches:
        out: list[tuple[int, str | None, str]] = []
        columns = (b.column(c).to_pylist() for c in ("_range", "_key", "_path", "_rule", "_verdict"))
        for i, (range_, k, path, rule, verdict) in enumerate(zip(*columns, strict=True)):
            if range_ != at:
                at, stack, key = range_, [], None
            if k != key:
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                key, chain = k, None
            if rule is not None:
                if not stack or stack[-1][0] != k:
                    stack.append((k, {}))
                stack[-1][1][path] = (rule, verdict)
                continue
            if chain is None:
                chain = sorted(((len(r), r, p, v) for _, paths in stack for p, (r, v) in paths.items()), reverse=True)
            best = next(((r, v) for _, r, p, v in chain if path.startswith(p)), None)
            out.append((i, *(best or (None, default))))
        if out:
            rows = b.take(pa.array([i for i, _, _ in out]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("_host"), rows.column("_path"), pa.array([r for _, r, _ in out], pa.string()), pa.array([v for _, _, v in out], pa.string())],
                names=["_id", "_host", "_path", "_rule", "_verdict"],
            )


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = RULES, url: str = "url", id_col: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """One row per page: id, host, path, rule (null where none fits), verdict. `rules`: (host, path, verdict), or a table of these columns."""
    spark = pages.sparkSession
    bounded_batches(spark)
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    judged = with_host_and_path(pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url")), "_url")
    judged = judged.select("_id", F.col("host").alias("_host"), F.col("path").alias("_path"), reversed_key(F.col("host")).alias("_key"), F.xxhash64("_url", "_id").alias("_spread"))
    # ranges: keys and, within a key, hashes; what a range holds is written, so its bounds and its rows agree
    ranged = Scratch(spark).keep(judged.repartitionByRange("_key", "_spread").sortWithinPartitions("_key").withColumn("_range", F.spark_partition_id()))
    bounds = ranged.groupBy("_range").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
    low = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ruled = table.select(reversed_key(low).alias("_key"), F.col("path").alias("_path"), F.concat(low, "path").alias("_rule"), F.col("verdict").alias("_verdict"))
    ruled = ruled.groupBy("_key", "_path", "_rule").agg(F.max(F.struct((F.col("_verdict") == "block").alias("b"), "_verdict"))["_verdict"].alias("_verdict"))
    # an interval [key, key + last code point) meets the ranges that begin below its end and end at or above its start;
    # one row per range on the other side, sorted: the array is looked up, not joined
    ends = bounds.agg(F.array_sort(F.collect_list(F.struct("_range", "_lo", "_hi"))).alias("_ends"))
    over = lambda x: (x["_hi"] >= F.col("_key")) & ((x["_lo"] < F.col("_key")) | x["_lo"].startswith(F.col("_key")))
    put = ruled.join(F.broadcast(ends)).withColumn("_range", F.explode(F.transform(F.filter("_ends", over), lambda x: x["_range"]))).drop("_ends")
    names = ["_range", "_key", "_path", "_rule", "_verdict", "_id", "_host"]
    kind = dict(judged.dtypes)["_id"]
    none = F.lit(None).cast("string")
    rows = ranged.select("_range", "_key", "_path", none.alias("_rule"), none.alias("_verdict"), "_id", "_host").unionByName(put.select(*names[:5], F.lit(None).cast(kind).alias("_id"), none.alias("_host")))
    swept = rows.repartition("_range").sortWithinPartitions("_range", "_key", F.col("_rule").asc_nulls_last())
    found = swept.mapInArrow(lambda b: _swept(b, default), f"_id {kind}, _host string, _path string, _rule string, _verdict string")
    return found.toDF(id_col, "host", "path", "rule", "verdict")
