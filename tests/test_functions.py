import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxaspark.functions import kmers, stats, tags
from taxaspark.functions.ranges import SeqRanges, combine, cut_out, disjoint, embed, extract, kept_slices, ordered, seq_range, tag, trim
from taxaspark.operators import taxonomy


def test_range_checks():
    for bad in ((None, None), (0, 3), (5, 4), (1.5, 2), (True, 2)):
        with pytest.raises(ValueError):
            seq_range(*bad)
    assert str(combine(seq_range(2, 4), seq_range(9))) == "<2 ranges: 2-4, 9->"
    with pytest.raises(TypeError):
        combine(trim(seq_range(1, 2)))
    with pytest.raises(ValueError):
        embed("", seq_range(1))


def test_range_order_and_overlap():
    a, b, c = seq_range(9), seq_range(None, 2), seq_range(3, 5)
    assert ordered(combine(a, c, b)) == (b, c, a)
    assert disjoint(combine(a, c, b)) == (b, c, a)  # touching is fine
    for bad in (combine(seq_range(1, 5), seq_range(5, 8)), combine(seq_range(None, 2), seq_range(None, 4)), combine(seq_range(7), seq_range(9))):
        with pytest.raises(ValueError):
            tag("T", bad)
    assert trim(combine(seq_range(1, 5), seq_range(4, 8))).cut  # cutting takes the union


@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 6)), min_size=1, max_size=4))
def test_kept_slices_are_the_complement(spans):
    ranges = [seq_range(a, a + n) for a, n in spans]
    read = "".join(chr(65 + i) for i in range(20))
    gone = {i for r in ranges for i in range(r.lo, r.end)}
    assert "".join(read[a:b] for a, b in kept_slices(ranges)) == "".join(c for i, c in enumerate(read) if i not in gone)


def test_extract_and_cut(spark):
    df = spark.createDataFrame([("GATTTGGGG", "IIIIIIIII")], "seq string, qual string")
    r = ordered(combine(seq_range(4), seq_range(None, 2)))
    assert df.select(extract(F.col("seq"), r)).first()[0] == "GATTGGGG"
    assert df.select(cut_out(F.col("seq"), F.col("seq"), r)).first()[0] == "T"
    for bad in (seq_range(10), seq_range(None, 10), seq_range(8, 10)):
        with pytest.raises(Exception, match="out of bounds"):
            df.select(extract(F.col("seq"), bad.ranges)).collect()


def test_tags(spark):
    rows = [("d MIRE{UMI:AC:B:G} MIRE{X:Y}",), ("MIRE{foo}",), ("MIRE{A:1:A:2}",), ("MIRE{A:}",), (None,), ("none",)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(tags.described(F.col("d"))).collect()]
    assert got == [{"UMI": "AC", "B": "G"}, {}, {"A": "2"}, {"A": ""}, {}, {}]
    one = spark.createDataFrame([({"UMI": "AC", "XUMI": "T"},)], "m map<string,string>")
    assert one.select(tags.encode(F.col("m"))).first()[0] == "UMI:AC XUMI:T"
    column = tags.encode(F.col("m"))
    assert one.select(tags.decode(column), tags.value_of(column, "UMI"), tags.value_of(column, "XUMI")).first() == ({"UMI": "AC", "XUMI": "T"}, "AC", "T")
    with pytest.raises(Exception, match="no tag MI"):
        one.select(tags.value_of(column, "MI")).collect()
    described = one.select(tags.describe(F.lit("x"), {"B": F.lit("1"), "A": F.lit("2")}), tags.describe(F.lit(None), {"A": F.lit("2")})).first()
    assert tuple(described) == ("x MIRE{A:2:B:1}", "MIRE{A:2}")
    merged = one.select(tags.merged(F.col("m"), F.create_map(F.lit("UMI"), F.lit("G")))).first()[0]
    assert merged == {"UMI": "G", "XUMI": "T"}


def test_read_filters(spark):
    rows = [("A" * 20, "I" * 20), ("ACGT" * 5, "5" * 20), ("ACGT" * 5, "4" + "5" * 19), ("ACGT", "IIII"), ("A" * 19, "I" * 19), ("ACGTA" * 5, "55 55")]
    got = spark.createDataFrame(rows, "s string, q string").select(kmers.complexity_ok(F.col("s")), kmers.quality_ok(F.col("q"))).collect()
    assert [r[0] for r in got] == [False, False, False, True, True, False]
    assert [r[1] for r in got] == [True, True, False, True, True, True]
    far = spark.createDataFrame([("ACGT" * 10,)], "s string")
    assert far.select(kmers.complexity_ok(F.col("s"))).first()[0]


def test_kmers(spark):
    df = spark.createDataFrame([("ACGTA", "1:2 0:1"), ("ACGT GGG", "1:2 |:| A:1")], "s string, l string")
    assert [r[0] for r in df.select(kmers.read_kmers(F.col("s"), F.col("l"))).collect()] == [["ACG", "CGT", "GTA"], ["ACG", "CGT", "GGG"]]
    for bad in ("1:9", "1:0"):
        with pytest.raises(Exception, match="doesn't fit"):
            df.limit(1).select(kmers.read_kmers(F.col("s"), F.lit(bad))).collect()
    names = spark.createDataFrame([("kraken:(taxid 123)",), ("456",), ("Some name (taxid 9606)",)], "t string")
    assert [r[0] for r in names.select(kmers.parsed_taxid(F.col("t"))).collect()] == ["123", "456", "9606"]


def test_distributions():
    assert stats.binom_cdf(3, 10) == pytest.approx(0.171875)
    assert stats.binom_cdf(-1, 5) == 0 and stats.binom_cdf(5, 5) == 1
    assert 2 * stats.t_upper(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert 2 * stats.t_upper(1, 1) == pytest.approx(0.5)
    assert stats.spearman_p(0.8, 5, False) == pytest.approx(2 * 8 / 120)
    assert stats.spearman_p(-1, 3, False) == pytest.approx(1 / 3)
    # the series agrees with counting where both are known
    assert stats.spearman_p(0.5, 12, False) == pytest.approx(0.1013, abs=2e-3)
    assert stats.kendall([1, 2, 3, 4, 5], [1, 3, 2, 5, 4])[1] == pytest.approx(28 / 120)
    assert stats.pearson_p(0.0, 10) == pytest.approx(1)
    assert math.isnan(stats.kendall([1, 1, 1], [1, 2, 3])[0])


def test_correlations_with_ties(spark):
    rows = [("a", x, y) for x, y in ((1, 2), (2, 2), (3, 9), (4, 10))] + [("b", x, 4 - x) for x in (1, 2, 3)]
    got = {r["k"]: r for r in stats.cor_tests(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], {"r": ("x", "y", "p")}).collect()}
    assert got["a"]["r"] == pytest.approx(0.9486832980505138)
    assert got["a"]["p"] == pytest.approx(0.05131670194948623)
    assert (got["b"]["r"], got["b"]["p"]) == (pytest.approx(-1), pytest.approx(1 / 3))
    for method in ("pearson", "kendall"):
        assert stats.cor_tests(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], {"r": ("x", "y", "p")}, method).count() == 2
    with pytest.raises(ValueError):
        stats.cor_tests(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], {}, "other")


def test_p_adjust(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.005, 0.5))] + [(9, None)], "i int, p double")
    want = {
        "BH": [0.025, 0.05, 0.05, 0.025, 0.5], "bonferroni": [0.05, 0.2, 0.15, 0.025, 1], "holm": [0.04, 0.09, 0.09, 0.025, 0.5],
        "hochberg": [0.04, 0.08, 0.08, 0.025, 0.5], "none": [0.01, 0.04, 0.03, 0.005, 0.5], "hommel": [0.04, 0.08, 0.06, 0.025, 0.5],
        "BY": [0.025 * 137 / 60, 0.05 * 137 / 60, 0.05 * 137 / 60, 0.025 * 137 / 60, 1],
    }
    for method, values in want.items():
        got = [r["padj"] for r in stats.p_adjust(df, "p", "padj", method).orderBy("i").collect()]
        assert got[:5] == pytest.approx(values), method
        assert got[5] is None or math.isnan(got[5])


@settings(max_examples=60)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_hommel_bounds(ps):
    out = stats.hommel(ps)
    assert all(p - 1e-12 <= q <= 1 for p, q in zip(ps, out, strict=True))


def test_quantile_nearest(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)], "k string, x double")
    q = lambda i: stats.quantile_nearest(df, ["k"], "x", 0.95, "q", i).first()["q"]
    assert (q("nearest"), q("lower"), q("higher"), q("linear")) == (10, 9, 10, pytest.approx(9.55))


def test_rank_order(spark):
    df = spark.createDataFrame([(r,) for r in ("S1", "S", "G", "X", "R2", "R1", "D", "U", "R", "S10", "X1", "K")], "r string")
    assert [r[0] for r in df.orderBy(taxonomy.rank_key(F.col("r")), "r").collect()] == ["U", "R", "R1", "R2", "D", "K", "G", "S", "S1", "S10", "X", "X1"]
    assert isinstance(combine(seq_range(1)), SeqRanges)


def test_lists(spark):
    from taxaspark.functions import lists

    df = spark.createDataFrame([(["a", "b", "c"], "x.y")], "v array<string>, t string")
    v, t = F.col("v"), F.col("t")
    got = df.select(
        lists.gather(v, F.array(F.lit(2), F.lit(0), F.lit(9))), lists.get(v, 1), lists.get(v, 7), lists.first(v), lists.last(v), lists.get(v, -4),
        lists.contains_any(v, ["q", "c"]), lists.text_contains_any(t, ["q", "."]), lists.text_contains_any(t, ["xy"]),
    ).first()
    assert tuple(got) == (["c", "a", None], "b", None, "a", "c", None, True, True, False)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=30))
def test_concordance_matches_all_pairs(rows):
    x, y = [a for a, _ in rows], [b for _, b in rows]
    sign = lambda a, b: (a > b) - (a < b)
    assert stats.concordance(x, y) == sum(sign(x[i], x[j]) * sign(y[i], y[j]) for i in range(len(x)) for j in range(i))


def test_small_tails():
    assert stats.binom_cdf(0, 200, 0.5) == pytest.approx(0.5**200)
    assert stats.binom_upper(200, 200, 0.5) == pytest.approx(0.5**200)
    assert stats.binom_upper(3, 10) == pytest.approx(1 - stats.binom_cdf(2, 10))


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace as Space

    from taxaspark.session import shared_folder

    assert shared_folder(spark)
    for master, ok in (("local[4]", True), ("spark://host:7077", False), ("local-cluster[2,1,512]", False)):
        sc = Space(master=master, getConf=lambda: Space(get=lambda k: None), getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
        fake = Space(sparkContext=sc, conf=Space(get=lambda k, d: None))
        if ok:
            assert shared_folder(fake).startswith("file://")
        else:
            with pytest.raises(ValueError):
                shared_folder(fake)


@pytest.mark.parametrize("method", ["BH", "BY", "holm", "hochberg", "bonferroni"])
def test_p_adjust_matches_sorting(spark, method):
    import random

    rnd = random.Random(7)
    rows = [(g, rnd.choice([None, 0.0, 1.0, 0.05, rnd.random(), rnd.random() ** 8])) for g in ("a", "b", None) for _ in range(60)] + [("c", rnd.random()) for _ in range(1500)]
    got = stats.p_adjust(spark.createDataFrame(rows, "g string, pvalue double"), method=method, within=["g"]).collect()

    def plain(ps):
        order = sorted(range(len(ps)), key=lambda i: ps[i])
        n, out = len(ps), [0.0] * len(ps)
        q = sum(1 / i for i in range(1, n + 1)) if method == "BY" else 1
        values = [{"bonferroni": ps[i] * n, "holm": ps[i] * (n - k + 1), "hochberg": ps[i] * (n - k + 1)}.get(method, q * ps[i] * n / k) for k, i in enumerate(order, 1)]
        for k, i in enumerate(order):
            out[i] = min(1, max(values[: k + 1]) if method == "holm" else values[k] if method == "bonferroni" else min(values[k:]))
        return out

    for g in ("a", "b", None, "c"):
        mine = sorted(((r["pvalue"], r["padj"]) for r in got if r["g"] == g and r["pvalue"] is not None))
        ps = [p for x, p in rows if x == g and p is not None]
        assert mine == [(p, pytest.approx(v, rel=1e-9)) for p, v in sorted(zip(ps, plain(ps), strict=True))]
    assert len(got) == len(rows) and all((r["pvalue"] is None) == (r["padj"] is None) for r in got)
