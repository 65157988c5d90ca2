"""Tables, shared scratch space and distributed prefix sums for the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import shared_folder, ship

#: A word is a run of characters outside these six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables in the shared folder: they cut lineage and survive the loss of executors.

    What isn't dropped earlier is deleted when the session's Python process ends, or by `drop_all`.
    """

    _open: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        Scratch._open[self.root] = spark

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later plan reads."""
        _delete(self.spark, df.scratch_path)

    @classmethod
    def roots(cls) -> set[str]:
        """The folders of the operators run so far."""
        return set(cls._open)

    @classmethod
    def drop_all(cls, but: set[str] = frozenset()) -> None:
        """Deletes the tables of all operators run so far, but for the folders `but`: their lazy results can't be read any more."""
        for root, spark in list(cls._open.items()):
            if root not in but:
                if spark.sparkContext._jsc is not None:
                    _delete(spark, root)
                del cls._open[root]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(Scratch.drop_all)
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds by bytes what a Python worker is sent at once, and sends workers this code. No result depends on the bound, and
    the number of rows of a batch stays as the session has it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def words_of(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(*cols: Column, seed: int = 0) -> Column:
    """A uniform 63-bit key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def copy_numbers(df: DataFrame, keys: list[str], row: str, out: str) -> DataFrame:
    """Adds `out`: the number, from 0, of each row among those of equal `keys`. `row` is a monotonically_increasing_id.

    The copies in a partition of the input are numbered together, and then follow those of the partitions
    before: a third of all rows may be equal, and the numbers are the same however rows were dealt.
    """
    put = df.withColumn("_part", F.shiftright(row, 33))
    sizes = put.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # partitions that begin a group need no base
    sizes = sizes.withColumn("_base", F.sum("_n").over(before)).where("_base is not null").drop("_n")
    near = put.withColumn("_near", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(row)) - 1)
    return null_join(near, sizes, [*keys, "_part"], "left").withColumn(out, (F.coalesce("_base", F.lit(0)) + F.col("_near")).cast("bigint")).drop("_base", "_near", "_part")


def prefix_sums(df: DataFrame, group: list[str], order: list[str], amount: str, out: str, rows_per_slice: int = 500) -> DataFrame:
    """Adds `out`: the sum of `amount` over earlier rows of the group, by `order`, whose first column is a hash_key.

    A group is cut into slices of the key of about `rows_per_slice` rows, or the square root of its
    rows if that is more: however large a group is, its rows and its slice totals are both dealt out
    evenly. Slice totals are summed up first.
    """
    sized = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    sliced = null_join(df, sized, group).withColumn("_slices", F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.greatest(F.lit(float(rows_per_slice)), F.sqrt("_rows")))).cast("long"))
    # the high 31 bits of the key, scaled: monotone in the key
    sliced = sliced.withColumn("_slice", F.shiftrightunsigned(F.shiftrightunsigned(F.col(order[0]), 32) * F.col("_slices"), 31)).drop("_rows", "_slices")
    totals = sliced.groupBy(*group, "_slice").agg(F.sum(amount).alias("_total"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*group, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = sliced.withColumn("_inner", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return null_join(inner, totals, [*group, "_slice"]).withColumn(out, F.col("_base") + F.col("_inner")).drop("_base", "_inner", "_slice")


def null_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on which nulls meet; keeps the left keys."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int = 0, chunk: int = 128) -> Column:
    """For each place of an array of longs, all values before it combined. Arrays are taken in chunks, so the steps grow with
    the length and not with its square (up to `chunk` squared values)."""
    first = F.lit(zero).cast("bigint")
    fold = lambda a, b: combine(a, b)

    def scan(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda c: F.slice(a, c * chunk + 1, F.lit(chunk)))
        within = lambda p, base: F.transform(p, lambda _, i: F.aggregate(F.slice(p, F.lit(1), i), base, fold))
        spread = lambda ps, totals: F.flatten(F.transform(ps, lambda p, c: let(F.aggregate(F.slice(totals, F.lit(1), c), first, fold), lambda base: within(p, base))))
        whole = let(parts, lambda ps: let(F.transform(ps, lambda p: F.aggregate(p, first, fold)), lambda totals: spread(ps, totals)))
        return F.when(F.size(a) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(values, scan)


#: A key that more rows hold than this is dealt to several tasks.
HOT = 100_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner", hot: int = HOT) -> DataFrame:
    """An equi-join on which nulls meet, of many left rows with one right row a key. `counts` has the keys and `_n`, the left rows of each.

    Keys of more than `hot` rows are few (rows / hot at most) and sent to all tasks; their left rows are dealt to
    so many parts, and their right row is written once for each part.
    """
    parts = counts.where(F.col("_n") > hot).select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    one = F.coalesce("_parts", F.lit(1))
    put = lambda df: null_join(df, F.broadcast(parts), keys, "left")
    left = put(left).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), one).cast("int")).drop("_parts")
    right = put(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return null_join(left, right, [*keys, "_salt"], how).drop("_salt")
