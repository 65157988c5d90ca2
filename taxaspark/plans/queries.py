"""Queries over the driver's tables, one or more per operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kmers, lists, stats, strings, tags
from ..functions.ranges import combine, embed, embed_trim, ordered, seq_range, tag, trim
from ..operators import denoise, taxonomy
from ..operators.classify import kraken2
from ..operators.extract import kractor_koutput, kractor_reads
from ..operators.koutreads import classified, encoded, koutreads
from ..operators.krcount import count_tables, krcount, wide
from ..operators.refine import seq_refine
from ..session import configure
from ..sources import sinks
from ..sources.fastq import checked_pair, pair_mates, read_fastq
from ..sources.text import kreport_rows, lineage, read_delimited, read_koutput, read_koutreads, read_kreport, read_parquet
from ..streaming import count_stream, filter_stream, stream_koutput
from .driver_views import Views, dna

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Views that the SQL of the queries shares.
WITH = r"""
WITH tax AS (
  SELECT 'r' || r_regionkey AS taxid, 'D' AS rank, r_name AS taxon, 'r' || r_regionkey AS path, 'D' AS ranks, r_name AS taxa, r_name AS region, 'r' || r_regionkey AS rid, NULL AS nid, NULL AS cid FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'P', n_name, 'r' || r_regionkey || ',n' || n_nationkey, 'D,P', r_name || ',' || n_name, r_name, 'r' || r_regionkey, 'n' || n_nationkey, NULL
    FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || c_custkey, 'S', c_name, 'r' || r_regionkey || ',n' || n_nationkey || ',c' || c_custkey, 'D,P,S', r_name || ',' || n_name || ',' || c_name, r_name, 'r' || r_regionkey, 'n' || n_nationkey, 'c' || c_custkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
clo AS (SELECT taxid, rid AS ancestor FROM tax UNION ALL SELECT taxid, nid FROM tax WHERE nid IS NOT NULL UNION ALL SELECT taxid, cid FROM tax WHERE cid IS NOT NULL),
lists AS (SELECT l_orderkey, string_agg('c' || l_suppkey || ':' || CAST(l_quantity AS BIGINT), ' ' ORDER BY l_linenumber, l_suppkey, l_quantity) AS lca FROM lineitem GROUP BY l_orderkey),
kout AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'U' ELSE 'C' END AS status, CAST(o_orderkey AS VARCHAR) AS read_id, 'c' || o_custkey AS taxon, lca FROM orders LEFT JOIN lists ON o_orderkey = l_orderkey),
rd AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS descr, translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq,
  translate(md5('q' || CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', '#56789:;<=>?@ABC') AS qual, o_custkey FROM orders),
krep AS (SELECT strftime(l_shipdate, '%Y-%m') AS sample, p_brand AS taxid, count(*) AS total_reads, CAST(sum(l_quantity) AS BIGINT) AS minimizer_len, count(DISTINCT l_partkey) AS minimizer_n_unique
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
cells AS (SELECT user_id AS barcode, event_type AS taxid, count(*) AS kmer_len, count(DISTINCT floor(value)) AS kmer_n_unique FROM events GROUP BY 1, 2)
"""


def _t_p(r: str, n: str) -> str:
    """SQL: the two-sided p-value of a correlation by Student's t of n - 2 degrees, whose distribution is a finite sum."""
    d, c = f"({n} - 2)", f"(1 - {r} * {r})"
    even = f"abs({r}) * list_sum(list_transform(range(0, {d} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow({c}, k)))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(0, ({d} - 1) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow({c}, k + 0.5))), 0))"
    return f"CASE WHEN {d} < 1 THEN NULL WHEN abs({r}) >= 1 THEN 0 WHEN {d} % 2 = 0 THEN greatest(0.0, 1 - {even}) ELSE greatest(0.0, 1 - {odd}) END"


def _series_p(r: str, n: str) -> str:
    """SQL: the two-sided p-value of Spearman's rho without ties for n > 9, by the published series at the even sum of squared differences."""
    s = f"round((pow({n}, 3) - {n}) * (1 - {r}) / 6)"
    b = f"(1.0 / {n})"

    def upper(s: str) -> str:
        x = f"((6 * ({s} - 1) / {n} / (pow({n}, 2) - 1.0) - 1) * sqrt({n} - 1))"
        y = f"pow({x}, 2)"
        # the fixed values of functions.stats.rho_upper
        u = f"{x} * {b} * (0.2274 + {b} * (0.2531 + 0.1745 * {b}) + {y} * (-0.0758 + {b} * (0.1033 + 0.3932 * {b}) - {y} * {b} * (0.0879 + 0.0151 * {b} - {y} * (0.0072 - 0.0831 * {b} + {y} * {b} * (0.0131 - 4.6e-04 * {y})))))"
        normal = f"(0.5 - exp(-{y} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1500), lambda k: {x} * exp(k * ln(greatest({y}, 1e-300)) - k * ln(2) - lgamma(k + 1.5) + lgamma(1.5)))))"
        return f"least(1.0, greatest(0.0, {u} / exp({y} / 2) + {normal}))"

    most = f"(pow({n}, 3) - {n}) / 6"
    return f"least(1.0, 2 * CASE WHEN {s} > {most} THEN {upper(s)} ELSE 1 - {upper(f'({s} + 2)')} END)"


def _rho_p(r: str, n: str, ties: str) -> str:
    """SQL: p-value of Spearman's rho for 9 < n < 1290, and for any n with ties."""
    return f"CASE WHEN {ties} OR {n} >= 1290 THEN {_t_p(r, n)} ELSE {_series_p(r, n)} END"


def query(sql: str | None = None, shared: bool = True):
    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(Views(configure(spark), sf_dir))
        if sql:
            _SQL[name] = (WITH if shared else "") + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _path(df: DataFrame) -> DataFrame:
    return df.select("taxid", "rank", "taxon", *[F.array_join(c, ",").alias(c) for c in ("ranks", "taxids", "taxa")])


@query("SELECT taxid, rank, taxon, ranks, path AS taxids, taxa FROM tax")
def taxonomy_lineage(v: Views) -> DataFrame:
    return _path(v.taxonomy())


@query("SELECT taxid, ancestor FROM clo")
def taxonomy_closure(v: Views) -> DataFrame:
    return taxonomy.closure(v.taxonomy())


@query("SELECT taxid, rank, taxon FROM tax WHERE region IN ('ASIA', 'EUROPE')")
def taxonomy_filter(v: Views) -> DataFrame:
    return taxonomy.filter_taxonomy(v.taxonomy(), ["D__ASIA", "D__EUROPE", "not an entry"]).select("taxid", "rank", "taxon")


@query("SELECT DISTINCT taxid FROM clo WHERE ancestor IN ('r1', 'n3', 'c7')")
def taxonomy_descendants(v: Views) -> DataFrame:
    tax = v.taxonomy()
    return taxonomy.descendants(taxonomy.select_taxa(tax, taxids=["r1", "n3", "c7"]).select("taxid"), taxonomy.closure(tax))


@query("SELECT taxid, rank, taxon FROM tax WHERE rank IN ('D', 'P') AND taxid IN ('r0', 'n1', 'c1')")
def taxonomy_select(v: Views) -> DataFrame:
    return taxonomy.select_taxa(v.taxonomy(), ranks=["D", "P"], taxids=["r0", "n1", "c1"]).select("taxid", "rank", "taxon")


@query(
    """, own AS (SELECT taxon AS taxid, count(*) AS reads FROM kout GROUP BY 1), total AS (SELECT ancestor AS taxid, sum(reads) AS total_reads FROM own JOIN clo USING (taxid) GROUP BY 1)
SELECT taxid, CAST(coalesce(reads, 0) AS BIGINT) AS reads, CAST(coalesce(total_reads, 0) AS BIGINT) AS total_reads FROM tax LEFT JOIN own USING (taxid) LEFT JOIN total USING (taxid)"""
)
def kreport_clade_counts(v: Views) -> DataFrame:
    return v.report().select("taxid", "reads", "total_reads")


@query("SELECT 'k' AS source, taxid, rank, taxon, ranks, path AS taxids, taxa FROM tax WHERE rank <> 'S'")
def kreport_parse(v: Views) -> DataFrame:
    """The taxonomy above customers written as lines of a report, then parsed."""
    tax = v.taxonomy().where("rank <> 'S'")
    level = F.size("taxids") - 1
    line = F.concat_ws("\t", F.lit(" 1.50"), F.lit("10"), F.lit("2"), "rank", "taxid", F.concat(F.repeat(F.lit("  "), level), F.col("taxon")))
    # regions and nations, in preorder; their number doesn't grow with the data
    lines = tax.select(F.lit("k").alias("source"), F.array_join("taxids", ",").alias("p"), line.alias("value"))
    order = F.array_sort(F.collect_list(F.struct("p", "value")))
    numbered = lines.groupBy("source").agg(order.alias("xs")).select("source", F.posexplode(F.transform("xs", lambda x: x["value"])).alias("pos", "value"))
    return lineage(kreport_rows(numbered)).select("source", "taxid", "rank", "taxon", *[F.array_join(c, ",").alias(c) for c in ("ranks", "taxids", "taxa")])


@query("SELECT status, read_id, taxon, lca FROM kout WHERE taxon IN (SELECT taxid FROM tax WHERE rank = 'S' AND region = 'ASIA')")
def kractor_koutput_ranks(v: Views) -> DataFrame:
    return kractor_koutput(v.taxonomy(), v.koutput(), taxonomy=["D__ASIA"], ranks=["S"]).select("status", "read_id", "taxon", "lca")


@query("SELECT status, read_id, taxon, lca FROM kout WHERE taxon IN (SELECT taxid FROM clo WHERE ancestor IN ('n3', 'c7'))")
def kractor_koutput_taxids(v: Views) -> DataFrame:
    return kractor_koutput(v.taxonomy(), v.koutput(), taxids=["n3", "c7"]).select("status", "read_id", "taxon", "lca")


@query("SELECT status, read_id, taxon, lca FROM kout WHERE taxon IN ('n3', 'c7')")
def kractor_koutput_no_descendants(v: Views) -> DataFrame:
    return kractor_koutput(v.taxonomy(), v.koutput(), taxids=["n3", "c7"], with_descendants=False).select("status", "read_id", "taxon", "lca")


@query("SELECT status, read_id, taxon, lca FROM kout WHERE lca IS NOT NULL AND NOT contains(lca, '9:') AND NOT contains(lca, 'c12:') AND taxon IN (SELECT taxid FROM clo WHERE ancestor = 'r2')")
def kractor_koutput_exclude(v: Views) -> DataFrame:
    return kractor_koutput(v.taxonomy(), v.koutput(), taxids=["r2"], exclude=["9", "c12"]).select("status", "read_id", "taxon", "lca")


@query("SELECT status, read_id, taxon, lca FROM kout WHERE lca IS NOT NULL AND NOT regexp_matches(' ' || lca, ' (c9|c12):')")
def kractor_koutput_exclude_token(v: Views) -> DataFrame:
    return kractor_koutput(v.taxonomy(), v.koutput(), exclude=["c9", "c12"], exclude_mode="token").select("status", "read_id", "taxon", "lca")


@query("SELECT id, seq, qual FROM rd WHERE id IN (SELECT read_id FROM kout WHERE taxon IN (SELECT taxid FROM clo WHERE ancestor = 'n5'))")
def kractor_reads_semi(v: Views) -> DataFrame:
    return kractor_reads(kractor_koutput(v.taxonomy(), v.koutput(), taxids=["n5"]), v.reads()).select("id", "seq", "qual")


@query(
    """SELECT taxon AS taxid, 'BARCODE:' || substr(seq, 1, 4) || ' UMI:' || substr(seq, 5, 6) AS tags, lca, seq, qual FROM kout JOIN rd ON read_id = id
WHERE status = 'C' AND lca IS NOT NULL AND NOT contains(lca, 'c9:') AND taxon IN (SELECT taxid FROM clo WHERE ancestor = 'r2')"""
)
def koutreads_join(v: Views) -> DataFrame:
    found = koutreads(v.taxonomy(), v.koutput(), v.reads(), [tag("BARCODE", seq_range(1, 4)), tag("UMI", seq_range(5, 10))], taxonomy=["D__ASIA"], exclude=["c9"])
    return encoded(found)


@query("SELECT id, descr || ' MIRE{BARCODE:' || substr(seq, 1, 4) || ':UMI:' || substr(seq, 6, 3) || substr(seq, 20) || '}' AS descr, seq, qual FROM rd")
def seq_refine_embed(v: Views) -> DataFrame:
    out = seq_refine(v.reads(), umi_action1=embed("UMI", combine(seq_range(20), seq_range(6, 8))), barcode_action1=embed("BARCODE", seq_range(None, 4)))
    return out.select("id", F.col("desc").alias("descr"), "seq", "qual")


@query("SELECT id, descr, substr(seq, 4, 5) || substr(seq, 15) AS seq, substr(qual, 4, 5) || substr(qual, 15) AS qual FROM rd")
def seq_refine_trim(v: Views) -> DataFrame:
    out = seq_refine(v.reads(), extra_actions1=[trim(combine(seq_range(9, 12), seq_range(None, 3))), seq_range(11, 14)])
    return out.select("id", F.col("desc").alias("descr"), "seq", "qual")


@query("SELECT id, descr || ' MIRE{UMI:' || substr(seq, 1, 6) || '}' AS descr, substr(seq, 7) AS seq, substr(qual, 7) AS qual FROM rd")
def seq_refine_embed_trim(v: Views) -> DataFrame:
    return seq_refine(v.reads(), umi_action1=seq_range(1, 6)).select("id", F.col("desc").alias("descr"), "seq", "qual")


@query(
    """, mates AS (SELECT id, descr, seq, qual, translate(seq, 'ACGT', 'TGCA') AS seq2 FROM rd)
SELECT id, descr || ' MIRE{UMI:' || substr(seq, 1, 3) || substr(seq2, 30) || '}' AS descr, substr(seq, 4) AS seq1, substr(seq2, 1, 29) AS seq2 FROM mates"""
)
def seq_refine_paired(v: Views) -> DataFrame:
    out = seq_refine(v.pairs(), umi_action1=embed_trim("UMI", seq_range(1, 3)), umi_action2=seq_range(30))
    return out.select("r2.id", F.col("r2.desc").alias("descr"), F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"))


@query("SELECT id, substr(seq, 1, 4) AS barcode, substr(seq, 5, 6) AS umi FROM rd")
def tags_decode(v: Views) -> DataFrame:
    out = seq_refine(v.reads(), umi_action1=embed("UMI", seq_range(5, 10)), barcode_action1=embed("BARCODE", seq_range(1, 4)))
    column = tags.encode(tags.described(F.col("desc")))
    return out.select("id", tags.value_of(column, "BARCODE").alias("barcode"), tags.decode(column)["UMI"].alias("umi"))


@query("SELECT id FROM rd WHERE NOT contains(qual, '#')")
def quality_filter(v: Views) -> DataFrame:
    return v.reads().where(kmers.quality_ok(F.col("qual"))).select("id")


@query("SELECT id FROM rd WHERE greatest(32 - length(replace(seq, 'A', '')), 32 - length(replace(seq, 'C', '')), 32 - length(replace(seq, 'G', '')), 32 - length(replace(seq, 'T', ''))) <= 12")
def complexity_filter(v: Views) -> DataFrame:
    return v.reads().where(kmers.complexity_ok(F.col("seq"))).select("id")


@query(""", runs AS (SELECT seq, unnest(range(1, 26)) AS i FROM rd) SELECT substr(seq, CAST(i AS INTEGER), 8) AS kmer, count(*) AS n FROM runs GROUP BY 1""")
def kmer_extract(v: Views) -> DataFrame:
    found = v.koutreads().select(F.explode(kmers.read_kmers(F.col("seq"), F.col("lca"))).alias("kmer"))
    return found.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = """, good AS (SELECT 'n' || c_nationkey AS taxid, seq FROM rd JOIN customer ON o_custkey = c_custkey WHERE NOT contains(qual, '#')
  AND greatest(32 - length(replace(seq, 'A', '')), 32 - length(replace(seq, 'C', '')), 32 - length(replace(seq, 'G', '')), 32 - length(replace(seq, 'T', ''))) <= 12),
up AS (SELECT ancestor AS taxid, substr(seq, 1, 1) AS barcode, substr(seq, 2, 4) AS umi, seq FROM good JOIN clo USING (taxid)),
a AS (SELECT barcode, taxid, count(*) AS reads, count(DISTINCT umi) AS umi, CAST(25 * count(*) AS BIGINT) AS kmer_total FROM up GROUP BY 1, 2),
runs AS (SELECT barcode, taxid, seq, unnest(range(1, 26)) AS i FROM up),
b AS (SELECT barcode, taxid, count(DISTINCT substr(seq, CAST(i AS INTEGER), 8)) AS kmer_unique FROM runs GROUP BY 1, 2)
"""


@query(_COUNTS + "SELECT barcode, taxid, reads, umi, kmer_total, kmer_unique FROM a JOIN b USING (barcode, taxid)")
def krcount_long(v: Views) -> DataFrame:
    return krcount(v.koutreads(), v.taxonomy(), "UMI", "BARCODE", taxonomy=None)


@query(
    _COUNTS + """SELECT a.taxid, max(t.region) AS region, max(CASE WHEN t.rank = 'P' THEN t.taxon END) AS nation,
max(CASE WHEN barcode = 'A' THEN reads END) AS n_a, max(CASE WHEN barcode = 'C' THEN reads END) AS n_c, max(CASE WHEN barcode = 'G' THEN reads END) AS n_g, max(CASE WHEN barcode = 'T' THEN reads END) AS n_t
FROM a JOIN tax t ON a.taxid = t.taxid GROUP BY 1"""
)
def krcount_wide(v: Views) -> DataFrame:
    counts = krcount(v.koutreads(), v.taxonomy(), "UMI", "BARCODE", taxonomy=None)
    table = wide(counts, v.taxonomy().where("rank <> 'S'"), "reads", list("ACGT"))
    return table.select("taxid", F.col("D").alias("region"), F.col("P").alias("nation"), *[F.col(c).alias(f"n_{c.lower()}") for c in "ACGT"])


@query(
    _COUNTS + """, v AS (SELECT taxid, barcode, reads, kmer_total, kmer_unique FROM a JOIN b USING (barcode, taxid))
SELECT t.taxid, max(t.region) AS region, """ + ", ".join(f"CAST(coalesce(max(CASE WHEN barcode = '{c}' THEN {x} END), -1) AS BIGINT) AS {n}_{c.lower()}" for n, x in (("n", "reads"), ("t", "kmer_total"), ("u", "kmer_unique")) for c in "ACGT") + """
FROM tax t LEFT JOIN v ON v.taxid = t.taxid GROUP BY 1"""
)
def krcount_tables(v: Views) -> DataFrame:
    """All four tables, one beside the other: every taxon of the report has a row; -1 stands for null here."""
    found = count_tables(krcount(v.koutreads(), v.taxonomy(), "UMI", "BARCODE", taxonomy=None), v.taxonomy(), list("ACGT"))
    out = found.taxa.select("taxid", F.col("D").alias("region"))
    for n, table in (("n", found.counts), ("t", found.kmer_total), ("u", found.kmer_unique)):
        out = out.join(table.select("taxid", *[F.coalesce(F.col(c), F.lit(-1)).alias(f"{n}_{c.lower()}") for c in "ACGT"]), "taxid")
    return out


@query(
    """SELECT rank, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS place FROM (SELECT rank, min(CASE rank WHEN 'D' THEN 2 WHEN 'P' THEN 4 ELSE 9 END) AS k FROM tax GROUP BY rank)"""
)
def rank_order(v: Views) -> DataFrame:
    from pyspark.sql import Window as W

    ranks = v.taxonomy().select(F.explode("ranks").alias("rank")).distinct()
    return ranks.select("rank", F.row_number().over(W.orderBy(taxonomy.rank_key(F.col("rank")))).cast("bigint").alias("place"))


@query(
    """, own AS (SELECT taxon AS taxid, count(*) AS reads FROM kout GROUP BY 1), total AS (SELECT ancestor AS taxid, sum(reads) AS n FROM own JOIN clo USING (taxid) GROUP BY 1)
SELECT taxid, taxon AS taxa, round(coalesce(n, 0) / (SELECT sum(n) FROM total WHERE taxid IN (SELECT taxid FROM tax WHERE rank = 'D' AND taxon IN ('ASIA', 'EUROPE'))) * 1000000, 6) AS rpmm
FROM tax LEFT JOIN total USING (taxid) WHERE region IN ('ASIA', 'EUROPE')"""
)
def rpmm(v: Views) -> DataFrame:
    report = v.report().withColumn("sample", F.lit("one"))
    return denoise.rpmm(report, ["d__ASIA", "d__EUROPE"]).select("taxid", "taxa", F.round("rpmm", 6).alias("rpmm"))


@query("""SELECT taxid, xs[CAST(round((len(xs) - 1) * 0.95) AS INTEGER) + 1] AS q FROM (SELECT taxid, list_sort(list(total_reads)) AS xs FROM krep GROUP BY taxid)""")
def quantile_nearest(v: Views) -> DataFrame:
    return stats.quantile_nearest(v.kreports(), ["taxid"], "total_reads", 0.95, "q")


@query(
    """, ref AS (SELECT taxid, avg(total_reads) AS r FROM krep GROUP BY 1), t AS (SELECT taxid, count(*) AS n, count(*) FILTER (WHERE total_reads <= r) AS t1 FROM krep JOIN ref USING (taxid) GROUP BY 1),
x AS (SELECT taxid, n, t1, unnest(range(0, t1 + 1)) AS i FROM t)
SELECT taxid, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))), 6) AS pvalue FROM x GROUP BY taxid"""
)
def quantile_test(v: Views) -> DataFrame:
    rows = v.kreports()
    ref = rows.groupBy("taxid").agg(F.avg("total_reads").alias("ref"))
    return denoise.quantile_test(rows.join(ref, "taxid"), ["taxid"], "total_reads", "ref").select("taxid", F.round("pvalue", 6).alias("pvalue"))


_SLSD = """, kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY taxid) AS m FROM krep WHERE total_reads >= 3 AND minimizer_n_unique >= 3) WHERE m >= 3),
ranked AS (SELECT taxid, """ + ", ".join(
    f"rank() OVER (PARTITION BY taxid ORDER BY {c}) + (count(*) OVER (PARTITION BY taxid, {c}) - 1) / 2.0 AS {a}" for c, a in (("minimizer_len", "x"), ("minimizer_n_unique", "y"), ("total_reads", "z"))
) + """ FROM kept)
"""


@query(_SLSD + "SELECT taxid, round(corr(x, y), 6) AS r1, round(corr(x, z), 6) AS r2, round(corr(z, y), 6) AS r3 FROM ranked GROUP BY taxid")
def slsd_corr(v: Views) -> DataFrame:
    return denoise.slsd(v.kreports()).select("taxid", *[F.round(c, 6).alias(c) for c in ("r1", "r2", "r3")])


#: Coefficients and p-values of the sample test, before rounding.
_SLSD_P = _SLSD.rstrip() + """, coef AS (SELECT taxid, corr(x, y) AS r1, corr(x, z) AS r2, corr(z, y) AS r3, CAST(count(*) AS BIGINT) AS n, count(DISTINCT x) AS dx, count(DISTINCT y) AS dy, count(DISTINCT z) AS dz FROM ranked GROUP BY taxid),
tested AS (SELECT taxid, """ + ", ".join(f"CASE WHEN isfinite({r}) THEN {r} END AS {r}" for r in ("r1", "r2", "r3")) + ", " + ", ".join(f"CASE WHEN isfinite({r}) THEN {_rho_p(r, 'n', t)} END AS {p}" for r, t, p in (("r1", "least(dx, dy) < n", "p1"), ("r2", "least(dx, dz) < n", "p2"), ("r3", "least(dz, dy) < n", "p3"))) + " FROM coef)\n"


@query(_SLSD_P + "SELECT taxid, taxid AS taxa, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("r1", "r2", "r3", "p1", "p2", "p3")) + " FROM tested")
def slsd(v: Views) -> DataFrame:
    return denoise.slsd(v.kreports()).select("taxid", "taxa", *[F.round(c, 6).alias(c) for c in ("r1", "r2", "r3", "p1", "p2", "p3")])


@query(
    """, kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY taxid) AS m FROM cells WHERE kmer_len >= 3) WHERE m >= 3),
ranked AS (SELECT taxid, rank() OVER (PARTITION BY taxid ORDER BY kmer_len) + (count(*) OVER (PARTITION BY taxid, kmer_len) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY taxid ORDER BY kmer_n_unique) + (count(*) OVER (PARTITION BY taxid, kmer_n_unique) - 1) / 2.0 AS y FROM kept)
SELECT taxid, round(corr(x, y), 6) AS cor FROM ranked GROUP BY taxid"""
)
def blsd_corr(v: Views) -> DataFrame:
    return denoise.blsd(v.kmer()).select("taxid", F.round("cor", 6).alias("cor"))


def _blsd(cells: str, within: str = "") -> str:
    """SQL of the barcode test over a view of taxid, kmer_len and kmer_n_unique: view `adjusted`."""
    keys = f"{within}taxid"
    every = f"PARTITION BY {within.rstrip(', ')}" if within else ""
    return f""", held AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS m FROM {cells} WHERE kmer_len >= 3) WHERE m >= 3),
placed AS (SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY kmer_len) + (count(*) OVER (PARTITION BY {keys}, kmer_len) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY {keys} ORDER BY kmer_n_unique) + (count(*) OVER (PARTITION BY {keys}, kmer_n_unique) - 1) / 2.0 AS b FROM held),
cors AS (SELECT {keys}, corr(a, b) AS cor, CAST(count(*) AS BIGINT) AS n, least(count(DISTINCT a), count(DISTINCT b)) < count(*) AS ties FROM placed GROUP BY ALL),
ps AS (SELECT {keys}, cor, CASE WHEN isfinite(cor) THEN {_rho_p('cor', 'n', 'ties')} END AS pvalue FROM cors),
numbered AS (SELECT *, count(pvalue) OVER ({every}) AS tests, row_number() OVER ({every} ORDER BY pvalue NULLS LAST) AS i FROM ps),
adjusted AS (SELECT {keys}, cor, pvalue, CASE WHEN pvalue IS NOT NULL THEN least(1.0, min(pvalue * tests / i) OVER ({every} ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS padj FROM numbered)
"""


@query(_blsd("cells") + "SELECT taxid, taxid AS taxa, round(cor, 6) AS cor, round(pvalue, 6) AS pvalue, round(padj, 6) AS padj FROM adjusted")
def blsd(v: Views) -> DataFrame:
    return denoise.blsd(v.kmer()).select("taxid", "taxa", *[F.round(c, 6).alias(c) for c in ("cor", "pvalue", "padj")])


@query(
    """, p AS (SELECT p_partkey AS k, (p_retailprice % 100) / 101.0 AS p FROM part), r AS (SELECT k, p, count(*) OVER () AS n, row_number() OVER (ORDER BY p, k) AS i FROM p)
SELECT k, round(least(1.0, min(p * n / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS padj FROM r"""
)
def p_adjust_bh(v: Views) -> DataFrame:
    rows = v.table("part").select(F.col("p_partkey").alias("k"), ((F.col("p_retailprice") % 100) / 101).alias("p"))
    return stats.p_adjust(rows, "p", "padj", "BH").select("k", F.round("padj", 6).alias("padj"))


@query(
    _SLSD_P.rstrip() + """, s AS (SELECT taxid FROM tested WHERE least(r1, r2, r3) > 0.3 AND greatest(p1, p2, p3) < 0.01)
SELECT strftime(l_shipdate, '%Y') AS sample, l_returnflag AS barcode, p_brand AS taxid, count(DISTINCT l_suppkey) AS counts FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_brand IN (SELECT taxid FROM s) GROUP BY 1, 2, 3"""
)
def denoise_gates(v: Views) -> DataFrame:
    umi = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.date_format("l_shipdate", "yyyy").alias("sample"), F.col("l_returnflag").alias("barcode"), F.col("p_brand").alias("taxid"), F.col("l_suppkey").alias("umi"))
    return denoise.taxa_counts(umi.join(denoise.slsd_passed(denoise.slsd(v.kreports()), 0.3, 0.01), "taxid", "left_semi"))


#: The quantile test of brands against an even share of all, with one reference value a month.
_RPMM = """, total AS (SELECT sample, sum(total_reads) AS t FROM krep GROUP BY 1), even AS (SELECT 1e6 / count(DISTINCT taxid) AS r FROM krep),
shares AS (SELECT taxid, count(*) AS n, count(*) FILTER (WHERE total_reads / t * 1e6 <= r) AS t1 FROM krep JOIN total USING (sample), even GROUP BY 1),
tails AS (SELECT taxid, n, t1, list_sum(list_transform(range(0, t1 + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)))) AS pvalue FROM shares)
"""


@query(
    _RPMM + """SELECT taxid, taxid AS taxa, round(pvalue, 6) AS pvalue, true AS matched, pvalue < 0.05 AS significant, pvalue < 0.05 AS truly FROM tails
UNION ALL SELECT 'All', 'All', NULL, false, false, true"""
)
def rpmm_quantile(v: Views) -> DataFrame:
    """The whole test: a row of all brands together has no reference, so it is unmatched and kept."""
    reports, even = _brand_reports(v)
    found = denoise.rpmm_quantile(reports, even, taxon=["d__All"], drop_unmatched_taxa=False).tests
    return found.select("taxid", "taxa", F.round("pvalue", 6).alias("pvalue"), "matched", "significant", "truly")


@query(
    _RPMM.rstrip() + """, wide AS (SELECT taxid, rpmm, study FROM (SELECT taxid, total_reads / t * 1e6 AS rpmm, 'current study' AS study FROM krep JOIN total USING (sample)
  UNION ALL SELECT taxid, r, 'cell lines' FROM krep, even)) SELECT taxid, taxid AS taxa, round(rpmm, 4) AS rpmm, study, round(pvalue, 6) AS pvalue FROM wide JOIN tails USING (taxid) WHERE pvalue < 0.05"""
)
def rpmm_plot_data(v: Views) -> DataFrame:
    """What a density plot of the significant brands shows."""
    reports, even = _brand_reports(v)
    return denoise.rpmm_quantile(reports, even, taxon=["d__All"]).plot_data().select("taxid", "taxa", F.round("rpmm", 4).alias("rpmm"), "study", F.round("pvalue", 6).alias("pvalue"))


def _brand_reports(v: Views) -> tuple[DataFrame, DataFrame]:
    """Monthly reports of brands below one domain, and an even share of all brands as the reference."""
    path = lambda x: F.array(F.lit("D"), F.lit("S")) if x == "ranks" else F.array(F.lit("All"), F.col("taxid"))
    rows = v.kreports().withColumns({"ranks": path("ranks"), "taxids": path("taxids"), "taxon": F.col("taxid")}).withColumn("taxa", path("taxa"))
    top = rows.groupBy("sample").agg(F.sum("total_reads").alias("total_reads")).select("sample", F.lit("All").alias("taxid"), "total_reads", F.array(F.lit("D")).alias("ranks"), F.array(F.lit("All")).alias("taxids"), F.lit("All").alias("taxon"), F.array(F.lit("All")).alias("taxa"))
    brands = rows.select("taxid").distinct()
    even = brands.crossJoin(brands.agg((F.lit(1e6) / F.count(F.lit(1))).alias("rpmm")))
    return rows.unionByName(top, allowMissingColumns=True), even


@query(
    _SLSD_P.rstrip() + _RPMM.rstrip() + """, sold AS (SELECT strftime(l_shipdate, '%Y') AS sample, p_brand AS taxid, l_suppkey, l_partkey, l_returnflag, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
shops AS (SELECT sample, taxid, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS kmer_len, count(DISTINCT l_partkey) AS kmer_n_unique FROM sold GROUP BY 1, 2, 3)"""
    + _blsd("shops", "sample, ").rstrip() + """, real AS (SELECT sample, taxid FROM adjusted WHERE padj < 0.05 AND taxid IN (SELECT taxid FROM tested WHERE least(r1, r2, r3) > 0 AND greatest(p1, p2, p3) < 0.05) AND taxid IN (SELECT taxid FROM tails WHERE pvalue < 0.05))
SELECT sample, l_returnflag AS barcode, taxid, count(DISTINCT l_suppkey) AS counts FROM sold SEMI JOIN real USING (sample, taxid) GROUP BY ALL"""
)
def denoise_counts(v: Views) -> DataFrame:
    """All three tests over brands, at the operator's own thresholds: months are samples of the reports, years of
    shipping are libraries, suppliers their cells; the reference is an even share of all brands."""
    reports, even = _brand_reports(v)
    sold = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("sample", F.date_format("l_shipdate", "yyyy"))
    cells = sold.groupBy("sample", F.col("l_suppkey").alias("barcode"), F.col("p_brand").alias("taxid")).agg(
        F.sum("l_quantity").cast("bigint").alias("kmer_len"), F.count_distinct("l_partkey").alias("kmer_n_unique")
    ).withColumn("taxa", F.col("taxid"))
    umi = sold.select("sample", F.col("l_returnflag").alias("barcode"), F.col("p_brand").alias("taxid"), F.col("l_suppkey").alias("umi"))
    return denoise.denoise_counts(reports, cells, umi, even, taxon=["d__All"]).counts.select("sample", "barcode", "taxid", "counts")


@query("SELECT id, seq AS seq1, translate(seq, 'ACGT', 'TGCA') AS seq2 FROM rd")
def pair_zip(v: Views) -> DataFrame:
    a = v.reads().select(F.col("id").cast("bigint").alias("record_no"), F.struct("id", "seq").alias("r1"))
    b = v.reads().select(F.col("id").cast("bigint").alias("record_no"), F.struct("id", F.translate("seq", "ACGT", "TGCA").alias("seq")).alias("r2"))
    met = a.join(b, "record_no", "full_outer").select(checked_pair(F.col("r1"), F.col("r2"), F.col("r1")).alias("r1"), "r2")
    return met.select("r1.id", F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"))


@query(
    """SELECT taxid, 'current' AS study FROM (SELECT DISTINCT taxid FROM krep WHERE sample < '1995' EXCEPT SELECT taxid FROM krep WHERE total_reads > 40)
UNION ALL SELECT DISTINCT taxid, 'reference' FROM cells"""
)
def sample_union(v: Views) -> DataFrame:
    rows = v.kreports()
    left = rows.where("sample < '1995'").select("taxid").distinct().subtract(rows.where("total_reads > 40").select("taxid"))
    return left.select("taxid", F.lit("current").alias("study")).unionByName(v.kmer().select("taxid", F.lit("reference").alias("study")).distinct())


@query(
    """SELECT ancestor AS taxid, count(*) AS reads FROM kout JOIN clo ON taxon = taxid WHERE status = 'C' AND lca IS NOT NULL AND NOT contains(lca, 'c9:')
AND taxid IN (SELECT taxid FROM tax WHERE region IN ('ASIA', 'EUROPE')) GROUP BY 1"""
)
def clade_reads(v: Views) -> DataFrame:
    """Classified reads of chosen domains, without an excluded taxon, per taxon with all below it."""
    tax = v.taxonomy()
    rows = kractor_koutput(tax, v.koutput(), taxonomy=["D__ASIA", "D__EUROPE"], exclude=["c9"]).where("status = 'C'")
    pairs = taxonomy.closure(tax)
    own = rows.groupBy(kmers.parsed_taxid(F.col("taxon")).alias("taxid")).agg(F.count(F.lit(1)).alias("reads"))
    return own.join(pairs, "taxid").groupBy(F.col("ancestor").alias("taxid")).agg(F.sum("reads").alias("reads"))


@query("SELECT id, descr, seq, qual FROM rd")
def fastq_scan(v: Views) -> DataFrame:
    """Reads written as FASTQ and read back, in byte ranges smaller than a file."""
    path = v.folder("reads")
    sinks.write_fastq(v.reads(), path)
    return read_fastq(v.spark, path, 1 << 20).select("id", F.col("desc").alias("descr"), "seq", "qual")


@query("SELECT id, descr, seq, qual FROM rd")
def fastq_scan_gzip(v: Views) -> DataFrame:
    path = v.folder("reads")
    sinks.write_fastq(v.reads(), path, level=1)
    return read_fastq(v.spark, path).select("id", F.col("desc").alias("descr"), "seq", "qual")


@query("SELECT id, seq AS seq1, translate(seq, 'ACGT', 'TGCA') AS seq2 FROM rd")
def fastq_pairs(v: Views) -> DataFrame:
    """Mates written to two folders, read back and met by their record numbers."""
    one, two = v.folder("r1"), v.folder("r2")
    sinks.write_fastq_pairs(v.pairs(), one, two)
    met = pair_mates(read_fastq(v.spark, one, 1 << 20), read_fastq(v.spark, two, 1 << 19))
    return met.select("r1.id", F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"))


_NAMED = "CASE WHEN CAST(substr(taxon, 2) AS BIGINT) % 2 = 0 THEN 'some name (taxid ' || taxon || ')' ELSE taxon END"


@query(f"SELECT status, read_id, {_NAMED} AS taxon, '32' AS length, lca FROM kout")
def koutput_scan(v: Views) -> DataFrame:
    """Per-read output written with returns and blank lines, and read back."""
    path = v.folder("out")
    sinks.write_koutput(v.koutput_lines().select(F.concat("line", F.lit("\r\n \t")).alias("line")), path)
    return read_koutput(v.spark, path).select("status", "read_id", "taxon", "length", "lca")


@query(f"SELECT read_id, {_NAMED} AS taxon, lca FROM kout WHERE taxon IN (SELECT taxid FROM clo WHERE ancestor IN ('n3', 'c8')) AND lca IS NOT NULL AND NOT contains(lca, 'c9:')")
def koutput_filter_file(v: Views) -> DataFrame:
    """From file to file: taxids out of names, filtered, written as compressed lines, and read again."""
    path, kept = v.folder("out"), v.folder("kept")
    sinks.write_koutput(v.koutput_lines(), path, level=9)
    sinks.write_koutput(kractor_koutput(v.taxonomy(), read_koutput(v.spark, path), taxids=["n3", "c8"], exclude=["c9"]), kept)
    return read_koutput(v.spark, kept).select("read_id", "taxon", "lca")


@query("SELECT read_id, 'c' || ((CAST(substr(taxon, 2) AS BIGINT) + 1) // 2) AS taxid FROM kout WHERE status = 'C' AND 'c' || ((CAST(substr(taxon, 2) AS BIGINT) + 1) // 2) IN (SELECT taxid FROM tax)")
def koutput_last_line(v: Views) -> DataFrame:
    """Of two lines of one read id the later one counts, whichever is greater."""
    number = F.regexp_extract("taxon", "([0-9]+)$", 1).cast("bigint")
    half = F.concat(F.lit("c"), F.floor((number + 1) / 2).cast("string"))
    lines = v.koutput().select("read_id", "status", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("taxon").alias("t")), F.struct(F.lit(1).alias("k"), half.alias("t")))).alias("x"))
    lines = lines.repartition("read_id").sortWithinPartitions("x.k").select(F.concat_ws("\t", "status", "read_id", "x.t", F.lit("32"), F.lit("0:1")).alias("line"))
    path = v.folder("out")
    sinks.write_koutput(lines, path)
    return classified(v.taxonomy(), read_koutput(v.spark, path), None, None).select("read_id", "taxid")


@query("SELECT taxon AS taxid, 'UMI:' || substr(seq, 5, 6) AS tags, lca, seq, qual FROM kout JOIN rd ON read_id = id WHERE status = 'C' AND lca IS NOT NULL AND NOT contains(lca, 'c9:') AND taxon IN (SELECT taxid FROM clo WHERE ancestor = 'r1')")
def koutreads_file(v: Views) -> DataFrame:
    """Joined reads written and read back."""
    path = v.folder("koutreads")
    region = v.table("region").where("r_regionkey = 1").select(F.concat(F.lit("D__"), "r_name")).first()[0]
    sinks.write_koutreads(encoded(koutreads(v.taxonomy(), v.koutput(), v.reads(), tag("UMI", seq_range(5, 10)), taxonomy=[region], exclude=["c9"])), path, level=6)
    return read_koutreads(v.spark, path)


_PAIRED = """, mates AS (SELECT taxon AS taxid, seq, translate(seq, 'ACGT', 'TGCA') AS seq2, qual, substr(descr, 1, 1) AS prio FROM kout JOIN rd ON read_id = id
  WHERE status = 'C' AND taxon IN (SELECT taxid FROM tax))
"""


@query(
    _PAIRED + """SELECT taxid, 'BARCODE:' || substr(seq, 1, 4) || substr(seq2, 30) || ' KIND:' || prio || ' UMI:' || substr(seq2, 1, 3) AS tags, taxid || ':25 |:| 0:25' AS lca, seq || ' ' || seq2 AS seq, qual || ' ' || qual AS qual FROM mates"""
)
def koutreads_paired(v: Views) -> DataFrame:
    """Tags of the first mate's header yield to the second's, and these to tags by range; a tag of both mates is their values joined."""
    return encoded(_paired(v)).select("taxid", "tags", "lca", "seq", "qual")


@query(
    _PAIRED + """, runs AS (SELECT taxid, seq, seq2, unnest(range(1, 26)) AS i FROM mates)
SELECT kmer, count(*) AS n FROM (SELECT substr(seq, CAST(i AS INTEGER), 8) AS kmer FROM runs UNION ALL SELECT substr(seq2, CAST(i AS INTEGER), 8) FROM runs) GROUP BY 1"""
)
def kmer_extract_paired(v: Views) -> DataFrame:
    found = _paired(v).select(F.explode(kmers.read_kmers(F.col("seq"), F.col("lca"))).alias("kmer"))
    return found.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def _paired(v: Views) -> DataFrame:
    kind = F.concat(F.lit("KIND:"), F.substring("desc", 1, 1))
    first = F.struct("id", F.concat(F.lit("x "), F.lit(tags.TAG_PREFIX + "UMI:A:KIND:old"), F.lit(tags.TAG_SUFFIX)).alias("desc"), "seq", "sep", "qual")
    second = F.struct("id", F.concat(F.lit(tags.TAG_PREFIX), kind, F.lit(":UMI:B" + tags.TAG_SUFFIX)).alias("desc"), F.translate("seq", "ACGT", "TGCA").alias("seq"), "sep", "qual")
    pairs = v.reads().select(first.alias("r1"), second.alias("r2"))
    out = v.koutput().withColumns({"length": F.lit("32:32"), "lca": F.concat(F.col("taxon"), F.lit(":25 |:| 0:25"))})
    one, two = tag("BARCODE", seq_range(1, 4)), [tag("BARCODE", seq_range(30)), tag("UMI", seq_range(1, 3))]
    return koutreads(v.taxonomy(), out, pairs, one, two, taxonomy=None, exclude=None)


@query("SELECT id, descr || ' MIRE{UMI:' || substr(seq, 9, 4) || '}' AS descr FROM rd")
def seq_refine_same_tag(v: Views) -> DataFrame:
    """Of two actions of one tag the last counts."""
    out = seq_refine(v.reads(), umi_action1=embed("UMI", seq_range(1, 6)), extra_actions1=[embed("UMI", seq_range(9, 12))])
    return out.select("id", F.col("desc").alias("descr"))


@query(
    """SELECT taxid, rank, taxon, ranks, path AS taxids, taxa, CAST(10 * length(path) AS BIGINT) AS total_reads, CAST(length(path) AS BIGINT) AS reads, CAST(length(taxon) AS BIGINT) AS minimizer_len, CAST(1 AS BIGINT) AS minimizer_n_unique FROM tax"""
)
def kreport_file(v: Views) -> DataFrame:
    """The whole taxonomy as a report of eight fields in preorder, with an unclassified row, written and read back."""
    tax = v.taxonomy().withColumn("p", F.array_join("taxids", ","))
    n = F.length("p")
    line = F.concat_ws("\t", F.lit(" 1.50"), (n * 10).cast("string"), n.cast("string"), F.length("taxon").cast("string"), F.lit("1"), "rank", "taxid", F.concat(F.repeat(F.lit("  "), F.size("taxids") - 1), F.col("taxon")))
    lost = v.spark.range(1).select(F.lit("").alias("p"), F.lit("  0.10\t5\t5\t0\t0\tU\t0\tunclassified").alias("line"))
    path = v.folder("report")
    # a report is one file with a line per taxon
    sinks.write_lines(tax.select("p", line.alias("line")).unionByName(lost).repartition(1).sortWithinPartitions("p"), F.col("line"), path, level=6)
    return _path(read_kreport(v.spark, path)).join(read_kreport(v.spark, path).select("taxid", "total_reads", "reads", "minimizer_len", "minimizer_n_unique"), "taxid")


@query("SELECT taxid, rank, taxon FROM tax WHERE taxon IN ('ASIA', 'NATION_5', 'Customer#000000007')")
def taxonomy_select_taxa(v: Views) -> DataFrame:
    return taxonomy.select_taxa(v.taxonomy(), taxa=["ASIA", "NATION_5", "Customer#000000007", "nobody"]).select("taxid", "rank", "taxon")


@query(
    """SELECT strftime(l_shipdate, '%Y') AS sample, p_brand AS taxid, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE strftime(l_shipdate, '%Y') IN ('1993', '1995') GROUP BY 1, 2"""
)
def parquet_samples(v: Views) -> DataFrame:
    """Samples written as Parquet and read as one frame."""
    rows = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.date_format("l_shipdate", "yyyy").alias("year"), F.col("p_brand").alias("taxid"))
    paths = {year: v.folder(f"year{year}") for year in ("1993", "1995")}
    for year, path in paths.items():
        sinks.write_parquet(rows.where(F.col("year") == year).select("taxid"), path)
    return read_parquet(v.spark, paths).groupBy("sample", "taxid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS taxid, p_size AS size, p_name AS name FROM part")
def delimited_scan(v: Views) -> DataFrame:
    """A table with a header and blanks between fields, written and read back."""
    path = v.folder("table")
    v.table("part").select(F.col("p_partkey").alias("taxid"), F.col("p_size").alias("size"), F.col("p_name").alias("name")).write.csv(path, sep=" ", header=True, quoteAll=True)
    back = read_delimited(v.spark, path)
    return back.select(F.col("taxid").cast("bigint").alias("taxid"), F.col("size").cast("int").alias("size"), "name")


@query(
    """SELECT p_partkey AS k, w[2] AS second, w[-1] AS last, w[1] AS first, w[1] || '|' || coalesce(w[4], '-') AS gathered, list_has_any(w, ['red', 'blue', 'steel']) AS any_word,
  regexp_matches(p_type, 'TIN|BRASS') AS any_text FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)"""
)
def list_helpers(v: Views) -> DataFrame:
    w = F.split("p_name", " ")
    gathered = F.array_join(F.transform(lists.gather(w, F.array(F.lit(0), F.lit(3))), lambda x: F.coalesce(x, F.lit("-"))), "|")
    return v.table("part").select(
        F.col("p_partkey").alias("k"), lists.get(w, 1).alias("second"), lists.last(w).alias("last"), lists.first(w).alias("first"), gathered.alias("gathered"),
        lists.contains_any(w, ["red", "blue", "steel"]).alias("any_word"), lists.text_contains_any(F.col("p_type"), ["TIN", "BRASS"]).alias("any_text"),
    )


@query(
    r"""SELECT p_partkey AS k, regexp_matches(p_name, 'e[rl]') AS detected, regexp_replace(p_name, '[aeiou]', '_') AS first_replaced, regexp_replace(p_name, '[aeiou]', '_', 'g') AS all_replaced,
  replace(p_brand, '#', '') AS removed, CASE WHEN regexp_matches(p_brand, '[0-9]+') THEN regexp_extract(p_brand, '[0-9]+') END AS extracted, array_to_string(regexp_extract_all(p_name, '[a-z]e'), ',') AS every,
  CAST(len(regexp_extract_all(p_name, 'l')) AS BIGINT) AS n, array_to_string(list_filter(string_split(p_name, ' '), lambda x: contains(x, 'e')), ',') AS kept, trim('  ' || p_name || ' ') AS trimmed FROM part"""
)
def string_helpers(v: Views) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return v.table("part").select(
        F.col("p_partkey").alias("k"), strings.detect(name, "e[rl]").alias("detected"), strings.replace(name, "[aeiou]", "_").alias("first_replaced"), strings.replace_all(name, "[aeiou]", "_").alias("all_replaced"),
        strings.remove_all(brand, "#", fixed=True).alias("removed"), strings.extract(brand, "[0-9]+").alias("extracted"), F.array_join(strings.extract_all(name, "[a-z]e"), ",").alias("every"),
        strings.count(name, "l", fixed=True).alias("n"), F.array_join(strings.subset(strings.split(name, " ", fixed=True), "e", fixed=True), ",").alias("kept"),
        strings.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
    )


_RULES: list[tuple[str, Callable[[], object], str]] = [
    ("one range", lambda: seq_range(2, 5), "2-5"),
    ("open start", lambda: seq_range(None, 4), "-4"),
    ("open end", lambda: seq_range(7), "7-"),
    ("several", lambda: combine(seq_range(9), seq_range(1, 3)), "<2 ranges: 9-, 1-3>"),
    ("in order", lambda: " ".join(map(str, ordered(combine(seq_range(9), seq_range(5, 6), seq_range(None, 3))))), "-3 5-6 9-"),
    ("no end at all", lambda: seq_range(), "ValueError"),
    ("behind its end", lambda: seq_range(5, 4), "ValueError"),
    ("below one", lambda: seq_range(0, 4), "ValueError"),
    ("no whole number", lambda: seq_range(1.5), "ValueError"),
    ("an action among ranges", lambda: combine(trim(seq_range(1, 2))), "TypeError"),
    ("overlapping tags", lambda: embed("UMI", combine(seq_range(1, 4), seq_range(4, 6))), "ValueError"),
    ("touching tags", lambda: len(embed("UMI", combine(seq_range(1, 4), seq_range(5, 6))).ranges), "2"),
    ("two open ends", lambda: embed("UMI", combine(seq_range(5), seq_range(7))), "ValueError"),
    ("overlapping cuts", lambda: len(trim(combine(seq_range(1, 4), seq_range(3, 6))).ranges), "2"),
    ("an empty tag", lambda: tag("", seq_range(1)), "ValueError"),
    ("a level too high", lambda: sinks.gzip_options(13), "ValueError"),
    ("no criterion", lambda: kractor_koutput(None, None), "ValueError"),
    ("no entry of a taxonomy", lambda: taxonomy.taxonomy_entries(["Bacteria"]), "ValueError"),
    ("no action", lambda: seq_refine(None), "ValueError"),
    ("no output", lambda: sinks.write_fastq_pairs(None, None, None), "ValueError"),
    ("the classifier's command", lambda: " ".join(kraken2(["a#.fq", "b#.fq"], "--quick", db="d", program="prog", threads=2, run=False)), "prog --threads 2 --report ./kraken_report.txt --output ./kraken_output.txt --classified-out ./classified.fq --db d --paired --quick a#.fq b#.fq"),
    ("three files", lambda: kraken2(["a", "b", "c"], run=False), "ValueError"),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(n.replace("'", "''"), w) for n, _, w in _RULES) + ") AS rules(rule, outcome)", shared=False)
def argument_rules(v: Views) -> DataFrame:
    """What ranges, actions, filters and sinks make of arguments: how they print, or the error they raise."""

    def outcome(f: Callable[[], object]) -> str:
        try:
            return str(f())
        except (TypeError, ValueError) as e:
            return type(e).__name__

    return v.spark.createDataFrame([(n, outcome(f)) for n, f, _ in _RULES], "rule string, outcome string")


@query("SELECT ancestor AS taxid, count(*) AS reads FROM kout JOIN clo ON taxon = taxid WHERE taxon IN (SELECT taxid FROM clo WHERE ancestor = 'r2') AND lca IS NOT NULL AND NOT contains(lca, 'c9:') GROUP BY 1")
def stream_counts(v: Views) -> DataFrame:
    """Per-read output as a stream of files: filtered and counted per ancestor until all that is there is read."""
    path, state = v.folder("out"), v.folder("state")
    sinks.write_koutput(v.koutput_lines(), path)
    pairs = taxonomy.closure(v.taxonomy())
    wanted = pairs.where("ancestor = 'r2'").select("taxid")
    counted = count_stream(filter_stream(stream_koutput(v.spark, path), wanted, ["c9"]), pairs)
    name = f"counts_{uuid.uuid4().hex}"
    running = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    return v.spark.table(name)


__all__ = ["queries", "oracle_sql", "dna"]
