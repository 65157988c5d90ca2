"""The domain's tables, derived from the driver's: a taxonomy of regions, nations and customers, classified reads from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def folder(self, name: str) -> str:
        return new_folder(self.spark, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def taxonomy(self) -> DataFrame:
        """taxid, rank, taxon, ranks, taxids, taxa, reads, total_reads: a report of the orders placed."""
        r = self.table("region").select("r_regionkey", "r_name", F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("rid"))
        n = self.table("nation").select("n_nationkey", "n_name", "n_regionkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("nid"))
        c = self.table("customer").select("c_custkey", "c_name", "c_nationkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("cid"))
        rn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        rnc = c.join(rn, F.col("c_nationkey") == F.col("n_nationkey"))
        row = lambda *levels: [
            F.col(levels[-1][1]).alias("taxid"), F.lit(levels[-1][0]).alias("rank"), F.col(levels[-1][2]).alias("taxon"),
            F.array(*[F.lit(x[0]) for x in levels]).alias("ranks"), F.array(*[F.col(x[1]) for x in levels]).alias("taxids"), F.array(*[F.col(x[2]) for x in levels]).alias("taxa"),
        ]
        d, p, s = ("D", "rid", "r_name"), ("P", "nid", "n_name"), ("S", "cid", "c_name")
        return r.select(*row(d)).unionByName(rn.select(*row(d, p))).unionByName(rnc.select(*row(d, p, s)))

    def report(self) -> DataFrame:
        """The taxonomy with reads (orders of the taxon itself) and total_reads (with all below)."""
        from ..operators.taxonomy import closure

        tax = self.taxonomy()
        own = self.table("orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("taxid")).agg(F.count(F.lit(1)).alias("reads"))
        total = own.join(closure(tax), "taxid").groupBy(F.col("ancestor").alias("taxid")).agg(F.sum("reads").alias("total_reads"))
        out = tax.join(own, "taxid", "left").join(total, "taxid", "left")
        return out.withColumn("reads", F.coalesce("reads", F.lit(0))).withColumn("total_reads", F.coalesce("total_reads", F.lit(0)))

    def koutput(self) -> DataFrame:
        items = self.table("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey", "l_quantity").alias("x"))
        lists = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        pair = lambda x: F.concat(F.lit("c"), x["l_suppkey"].cast("string"), F.lit(":"), x["l_quantity"].cast("bigint").cast("string"))
        lists = lists.select("l_orderkey", F.array_join(F.transform("xs", pair), " ").alias("lca"))
        orders = self.table("orders")
        return orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.when(F.col("o_orderstatus") == "F", "U").otherwise("C").alias("status"), F.col("o_orderkey").cast("string").alias("read_id"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("taxon"), F.lit("32").alias("length"), "lca",
        )

    def reads(self) -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        return self.table("orders").select(key.alias("id"), F.col("o_orderpriority").alias("desc"), dna(key).alias("seq"), F.lit("+").alias("sep"), quality(key).alias("qual"))

    def pairs(self) -> DataFrame:
        """Both mates of the reads: the second is the complement."""
        second = F.struct("id", "desc", F.translate("seq", "ACGT", "TGCA").alias("seq"), "sep", "qual")
        return self.reads().select(F.struct("id", "desc", "seq", "sep", "qual").alias("r1"), second.alias("r2"))

    def koutput_lines(self) -> DataFrame:
        """Per-read output as written: taxa with even numbers have a name, and a line without a list ends at its length."""
        number = F.regexp_extract("taxon", "([0-9]+)$", 1).cast("bigint")
        named = F.when(number % 2 == 0, F.concat(F.lit("some name (taxid "), F.col("taxon"), F.lit(")"))).otherwise(F.col("taxon"))
        return self.koutput().select("read_id", F.concat_ws("\t", "status", "read_id", named, "length", "lca").alias("line"))

    def koutreads(self) -> DataFrame:
        """Joined reads of orders; the k-mer list counts 25 k-mers of 8 letters, the tags are 1 and 4 letters of the read."""
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        key = F.col("o_orderkey").cast("string")
        seq = dna(key)
        taxid = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
        tags = F.concat(F.lit("BARCODE:"), F.substring(seq, 1, 1), F.lit(" UMI:"), F.substring(seq, 2, 4))
        return o.select(taxid.alias("taxid"), tags.alias("tags"), F.concat(taxid, F.lit(":20 0:5")).alias("lca"), seq.alias("seq"), quality(key).alias("qual"))

    def kreports(self) -> DataFrame:
        """Measures per month and brand."""
        rows = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return rows.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("sample"), F.col("p_brand").alias("taxid")).agg(
            F.count(F.lit(1)).alias("total_reads"), F.sum("l_quantity").cast("bigint").alias("minimizer_len"), F.count_distinct("l_partkey").alias("minimizer_n_unique")
        ).withColumn("taxa", F.col("taxid"))

    def kmer(self) -> DataFrame:
        """Measures per user and event type."""
        return self.table("events").groupBy(F.col("user_id").alias("barcode"), F.col("event_type").alias("taxid")).agg(
            F.count(F.lit(1)).alias("kmer_len"), F.count_distinct(F.floor("value")).alias("kmer_n_unique")
        ).withColumn("taxa", F.col("taxid"))


def dna(key: Column) -> Column:
    return F.translate(F.md5(key.cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


def quality(key: Column) -> Column:
    return F.translate(F.md5(F.concat(F.lit("q"), key).cast("binary")), "0123456789abcdef", "#56789:;<=>?@ABC")
