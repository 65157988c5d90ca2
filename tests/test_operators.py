import gzip

import pytest
from pyspark.sql import functions as F

from taxaspark.functions import strings
from taxaspark.functions.ranges import combine, embed, embed_trim, seq_range, tag, trim
from taxaspark.operators import denoise, taxonomy
from taxaspark.operators.classify import kraken2
from taxaspark.operators.extract import kractor_koutput, kractor_reads
from taxaspark.operators.koutreads import classified, encoded, koutreads
from taxaspark.operators.krcount import krcount, wide
from taxaspark.operators.refine import seq_refine
from taxaspark.sources import sinks
from taxaspark.sources.fastq import numbered, pair_mates, read_fastq
from taxaspark.sources.text import read_ids, read_koutput, read_koutreads, read_kreport, read_parquet

REPORT = """  1.00\t10\t10\t0\t0\tU\t0\tunclassified
 99.00\t990\t1\t5000\t900\tR\t1\troot
 99.00\t989\t2\t5000\t900\tR1\t131567\t  cellular organisms
 90.00\t900\t3\t4000\t800\tD\t2\t    Bacteria
 80.00\t800\t4\t3000\t700\tP\t1224\t      Pseudomonadota
 10.00\t100\t4\t3000\t70\tP\t1239\t      Bacillota
  5.00\t50\t4\t300\t70\tG\t1301\t          Streptococcus

  9.00\t89\t3\t4000\t80\tD\t2759\t    Eukaryota
"""


@pytest.fixture()
def report(spark, tmp_path):
    (tmp_path / "report.txt").write_text(REPORT)
    return read_kreport(spark, str(tmp_path / "report.txt"))


def paths(report):
    return {r["taxid"]: list(r["taxids"]) for r in report.collect()}


def test_kreport_lineage(spark, tmp_path, report):
    want = {"1": ["1"], "131567": ["131567"], "2": ["2"], "1224": ["2", "1224"], "1239": ["2", "1239"], "1301": ["1301"], "2759": ["2759"]}
    assert paths(report) == want
    six = "".join("\t".join(x for i, x in enumerate(line.split("\t")) if i not in (3, 4)) + "\r\n" for line in REPORT.splitlines())
    with gzip.open(tmp_path / "six.txt.gz", "wt", newline="") as f:
        f.write(six)
    got = read_kreport(spark, str(tmp_path / "six.txt.gz"))
    assert paths(got) == want and got.where("minimizer_len is not null").count() == 0
    with pytest.raises(Exception, match="six or eight"):
        (tmp_path / "bad.txt").write_text("a\tb\n")
        read_kreport(spark, str(tmp_path / "bad.txt")).collect()


def test_taxonomy(spark, tmp_path, report):
    assert {r["taxid"] for r in read_kreport(spark, str(tmp_path / "report.txt"), ["D__Bacteria"]).collect()} == {"2", "1224", "1239"}
    with pytest.raises(ValueError, match="no valid"):
        taxonomy.filter_taxonomy(report, ["Bacteria"])
    with pytest.raises(ValueError, match="no taxonomic"):
        taxonomy.filter_taxonomy(report, ["D__Nothing"], strict=True)
    with pytest.warns(UserWarning, match="D__Fungi"):
        taxonomy.filter_taxonomy(report, ["D__Bacteria", "D__Fungi"], strict=True)
    pairs = {tuple(r) for r in taxonomy.closure(report).collect()}
    assert ("1224", "2") in pairs and ("1301", "1301") in pairs and ("1301", "2") not in pairs
    below = taxonomy.descendants(report.where("taxid = '2'").select("taxid"), taxonomy.closure(report))
    assert {r[0] for r in below.collect()} == {"2", "1224", "1239"}
    assert taxonomy.observed_ranks(report) == ["R", "R1", "D", "P", "G"]
    rows = {r["taxid"]: r for r in taxonomy.lineage_columns(report).collect()}
    assert (rows["1224"]["D"], rows["1224"]["P"], rows["1224"]["G"]) == ("Bacteria", "Pseudomonadota", None)


KOUTPUT = [
    "U\tr0\t0\t8\t0:1", "C\tr1\tBacteria (taxid 2)\t8\t2:1", "C\tr2\t1224\t8\t9606:1", "C\tr3\tHuman (taxid 9606)\t8\t9606:1", "C\tr4\t1239\t8\t19606:1",
    "C\tr5\t1224\t8", "C\tr1\t1224\t8\t2:1", "C\t\t2\t8\t2:1",
]


@pytest.fixture()
def koutput(spark, tmp_path):
    (tmp_path / "out.txt").write_text("\r\n".join(KOUTPUT) + "\n")
    return read_koutput(spark, str(tmp_path / "out.txt"))


def test_koutput_filter(spark, tmp_path, report, koutput):
    ids = lambda **k: sorted(r["read_id"] for r in kractor_koutput(report, koutput, **k).collect())
    assert ids(taxids=["2"]) == ["", "r1", "r1", "r2", "r4", "r5"]
    assert ids(taxids=["2"], with_descendants=False) == ["", "r1"]
    assert ids(taxids=["2"], exclude=["9606"]) == ["", "r1", "r1"]  # as a substring, 19606 goes too; so does a line without list
    assert ids(taxids=["2"], exclude=["9606"], exclude_mode="token") == ["", "r1", "r1", "r4"]
    assert ids(exclude=["2"]) == ["r0", "r2", "r3", "r4"]
    assert ids(ranks="P", taxa=["Bacillota"]) == ["r4"]
    assert ids(taxonomy="D__Bacteria") == ["", "r1", "r1", "r2", "r4", "r5"]
    with pytest.raises(ValueError, match="at least"):
        ids(taxids=[None])
    sinks.write_koutput(kractor_koutput(report, koutput, taxids=["1239"]), str(tmp_path / "kept"), level=4)
    assert [r["line"] for r in read_koutput(spark, str(tmp_path / "kept")).collect()] == [KOUTPUT[4]]
    assert {r[0] for r in read_ids(koutput).collect()} == {f"r{i}" for i in range(6)}


def fastq(path, reads, end="\n"):
    text = "".join(f"@{i}{end}{s}{end}+{end}{q}{end}" for i, s, q in reads)
    data = text.encode()
    path.write_bytes(gzip.compress(data) if str(path).endswith(".gz") else data)


def test_fastq_source(spark, tmp_path):
    reads = [(f"s{i} d{i}" if i % 2 else f"s{i}", "ACGT" * (1 + i % 3), "@+I!" * (1 + i % 3)) for i in range(300)]
    fastq(tmp_path / "a.fq", reads, "\r\n")
    want = [(i.split()[0], i.split()[1] if " " in i else None, s, q) for i, s, q in reads]
    for size in (1 << 20, 997, 64):
        got = numbered(read_fastq(spark, str(tmp_path / "a.fq"), size)).orderBy("record_no").select("id", "desc", "seq", "qual").collect()
        assert [tuple(r) for r in got] == want, size
    (tmp_path / "b.fq.gz").write_bytes(b"".join(gzip.compress(f"\n@x{i}\tt\nA\n+\nI\n".encode()) for i in range(3)))  # a member per record
    assert [r["id"] for r in read_fastq(spark, str(tmp_path / "b.fq.gz")).collect()] == ["x0", "x1", "x2"]
    (tmp_path / "empty.fq").write_text("")
    assert read_fastq(spark, str(tmp_path / "empty.fq")).count() == 0
    for text, error in (("seq1\nATGC\n+\n!!!!\n", "invalid head"), ("@s\nATGC\n+\n", "incomplete"), ("@s\nATGC\n+\n!!\n", "unequal length"), ("@s\nATGC\n-\n!!!!\n", "invalid separator")):
        (tmp_path / "bad.fq").write_text(text)
        with pytest.raises(Exception, match=error):
            read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_refine_and_write(spark, tmp_path):
    fastq(tmp_path / "a.fq", [("SEQ_ID", "GATTTGGGG", "IIIIIIIII"), ("SEQ_ID2", "TTACAGGGA", "IIIIIIIII")])
    reads = read_fastq(spark, str(tmp_path / "a.fq"))
    out = seq_refine(reads, umi_action1=embed("UMI", combine(seq_range(4), seq_range(None, 2))))
    assert [r["desc"] for r in out.orderBy("id").collect()] == ["MIRE{UMI:GATTGGGG}", "MIRE{UMI:TTCAGGGA}"]
    cut = seq_refine(reads, barcode_action1=seq_range(1, 2), extra_actions1=[seq_range(2, 4), trim(seq_range(9))]).orderBy("id").first()
    assert (cut["desc"], cut["seq"], cut["qual"]) == ("MIRE{BARCODE:GA}", "TGGG", "IIII")
    sinks.write_fastq(out, str(tmp_path / "o"), single=True)
    again = read_fastq(spark, str(tmp_path / "o")).orderBy("id").first()
    assert (again["id"], again["desc"], again["seq"]) == ("SEQ_ID", "MIRE{UMI:GATTGGGG}", "GATTTGGGG")
    with pytest.raises(ValueError):
        seq_refine(reads)
    with pytest.raises(ValueError):
        seq_refine(reads, umi_action2=seq_range(1))
    with pytest.raises(ValueError, match="compression"):
        sinks.write_fastq(out, str(tmp_path / "p"), level=13)


def test_pairs(spark, tmp_path):
    fastq(tmp_path / "1.fq.gz", [("SEQ_ID1", "ACGT", "IIII"), ("SEQ_ID2", "TGCA", "IIII")])
    fastq(tmp_path / "2.fq.gz", [("SEQ_ID1", "TTAA", "IIII"), ("SEQ_ID2", "AATT", "IIII")])
    one, two = (read_fastq(spark, str(tmp_path / f"{k}.fq.gz")) for k in (1, 2))
    pairs = pair_mates(one, two)
    out = seq_refine(pairs, umi_action1=embed("UMI", combine(seq_range(4), seq_range(None, 2))), umi_action2=embed_trim("UMI", seq_range(1, 1)))
    got = [(r["r1"]["desc"], r["r2"]["desc"], r["r2"]["seq"]) for r in out.orderBy("record_no").collect()]
    assert got == [("MIRE{UMI:ACTT}",) * 2 + ("TAA",), ("MIRE{UMI:TGAA}",) * 2 + ("ATT",)]
    sinks.write_fastq_pairs(out, str(tmp_path / "o1"), None)
    with pytest.raises(ValueError):
        sinks.write_fastq_pairs(out, None, None)
    fastq(tmp_path / "3.fq.gz", [("SEQ_ID1", "TTAA", "IIII"), ("OTHER", "AATT", "IIII"), ("X", "A", "I")])
    three = read_fastq(spark, str(tmp_path / "3.fq.gz"))
    with pytest.raises(Exception, match="ids of mates differ|different numbers"):
        pair_mates(one, three).collect()
    ids = spark.createDataFrame([("SEQ_ID2",), ("SEQ_ID2",), ("",)], "read_id string")
    assert [r["id"] for r in kractor_reads(ids, one).collect()] == ["SEQ_ID2"]  # single reads are filtered too
    assert [r["r1"]["id"] for r in kractor_reads(ids, pairs).collect()] == ["SEQ_ID2"]


def test_koutreads_and_counts(spark, tmp_path, report):
    a, b = "ACGTACGTACGGTTCAGATCCATGACCAGGTTACATGCAT", "TTGACCATGGACCATTTGACCAGTACAGGCATTAACCGGA"
    reads = spark.createDataFrame([("r1", "MIRE{BARCODE:X:UMI:U1}", a, "+", "I" * 40), ("r2", None, b, "+", "I" * 40), ("r9", None, b, "+", "I" * 40)], "id string, desc string, seq string, sep string, qual string")
    out = spark.createDataFrame([("C", "r1", "a (taxid 1224)", "40", "1224:7"), ("C", "r2", "2", "40", "2:5 0:2"), ("U", "r9", "2", "40", "2:7")], "status string, read_id string, taxon string, length string, lca string")
    joined = koutreads(report, out, reads, tag("BARCODE", seq_range(1, 2)), taxonomy=["D__Bacteria"])
    got = {r["taxid"]: r["tags"] for r in joined.collect()}
    assert got == {"1224": {"BARCODE": "AC", "UMI": "U1"}, "2": {"BARCODE": "TT"}}  # tags by range win
    sinks.write_koutreads(encoded(joined), str(tmp_path / "k"))
    back = read_koutreads(spark, str(tmp_path / "k"))
    counts = {(r["barcode"], r["taxid"]): tuple(r)[2:] for r in krcount(back, report, None, "BARCODE", ["D__Bacteria"]).collect()}
    assert counts == {("AC", "1224"): (1, 0, 7, 7), ("AC", "2"): (1, 0, 7, 7), ("TT", "2"): (1, 0, 7, 7)}
    one = {r["taxid"]: tuple(r)[2:] for r in krcount(back, report, taxonomy=None, distinct="sketch").collect()}
    assert one == {"1224": (1, 0, 7, 7), "2": (2, 0, 14, 14)}
    table = {r["taxid"]: r for r in wide(krcount(back, report, None, "BARCODE", ["D__Bacteria"]), report).collect()}
    assert (table["2"]["AC"], table["2"]["TT"], table["1239"]["AC"], table["1224"]["P"]) == (1, 1, None, "Pseudomonadota")
    with pytest.raises(Exception, match="no tag UMI"):
        krcount(back, report, "UMI", taxonomy=None).collect()
    with pytest.raises(Exception, match="doesn't fit the read"):
        koutreads(report, out.withColumn("length", F.lit("39")), reads, taxonomy=None).collect()
    with pytest.raises(Exception, match="paired"):
        koutreads(report, out.withColumn("length", F.lit("40:40")), reads, taxonomy=None).collect()
    (tmp_path / "short.txt").write_text("a\tb\n")
    with pytest.raises(Exception, match="five fields"):
        read_koutreads(spark, str(tmp_path / "short.txt")).collect()


def test_paired_koutreads(spark, report):
    half = lambda s: F.struct(F.lit("r1").alias("id"), F.lit(None).cast("string").alias("desc"), F.lit(s).alias("seq"), F.lit("+").alias("sep"), F.lit("I" * len(s)).alias("qual"))
    a, b = "ACGTACGTACGGTTCAGATCCATGACCAGGTTACATGCAT", "TTGACCATGGACCATTTGACCAGTACAGGCATTAACCGGA"
    pairs = spark.range(1).select(half(a).alias("r1"), half(b).alias("r2"))
    out = lambda length, lca: spark.createDataFrame([("C", "r1", "2", length, lca)], "status string, read_id string, taxon string, length string, lca string")
    for length in ("40|40", "40:40"):
        joined = koutreads(report, out(length, "2:7 |:| 2:7"), pairs, taxonomy=None)
        assert joined.first()["seq"] == f"{a} {b}"
        row = krcount(encoded(joined), report, taxonomy=None).first()
        assert (row["reads"], row["kmer_total"], row["kmer_unique"]) == (1, 14, 14)
    assert koutreads(report, out("40", "2:7"), pairs, taxonomy=None).first()["seq"] == b  # only the second mate was classified


def test_low_quality_rows_never_raise(spark, report):
    rows = [("2", "", "broken", "ACGT" * 6, "!" * 24), ("2", "", "2:4", "ACGTACGTACGGTTCAGATCCATGACCAGGTTACATGCAT", "I" * 40)]
    reads = spark.createDataFrame(rows, "taxid string, tags string, lca string, seq string, qual string")
    assert krcount(reads, report, taxonomy=None).first()["reads"] == 1


def frames(spark):
    rows = []
    for s in range(6):
        rows.append((f"s{s}", "2", "Bacteria", 1000, ["D"], ["2"], ["Bacteria"], 500, 50))
        rows.append((f"s{s}", "7", "A x", 10 + s, ["D", "S"], ["2", "7"], ["Bacteria", "A x"], 20 + s, 5 + s))
        rows.append((f"s{s}", "8", "B y", 500, ["D", "S"], ["2", "8"], ["Bacteria", "B y"], 60 - s, 5 + s))
        rows.append((f"s{s}", "9", "Human", 5, ["D"], ["9"], ["Eukaryota"], 9, 9))
    return spark.createDataFrame(rows, "sample string, taxid string, taxon string, total_reads int, ranks array<string>, taxids array<string>, taxa array<string>, minimizer_len int, minimizer_n_unique int")


def test_rpmm_and_quantile_test(spark):
    got = {(r["sample"], r["taxid"]): r["rpmm"] for r in denoise.rpmm(frames(spark), ["d__Bacteria"]).collect()}
    assert got["s0", "7"] == 10_000 and got["s1", "2"] == 1e6 and len(got) == 18
    reference = spark.createDataFrame([("7", 1.0), ("7", 9.0), ("2", 1e9)], "taxid string, rpmm double")
    tested = denoise.rpmm_quantile(frames(spark), reference, taxon=["d__Bacteria"])
    rows = {r["taxid"]: r for r in tested.tests.collect()}
    assert rows["7"]["pvalue"] == pytest.approx(0.5**6) and rows["7"]["truly"]
    assert rows["2"]["pvalue"] == pytest.approx(1) and not rows["2"]["significant"]
    assert rows["8"]["pvalue"] is None and not rows["8"]["matched"] and not rows["8"]["truly"]
    assert tested.table.where("study = 'cell lines'").count() == 6 * 2 + 6
    kept = denoise.rpmm_quantile(frames(spark), reference, taxon=["d__Bacteria"], drop_unmatched_taxa=False).truly()
    assert {r[0] for r in kept.collect()} == {"7", "8"}
    assert {r["taxid"] for r in tested.plot_data().collect()} == {"7"}
    two = denoise.quantile_test(spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0)], "k string, x double, ref double"), ["k"], "x", "ref", alternative="two.sided").first()
    assert two["pvalue"] == pytest.approx(1.5)  # twice the smaller tail isn't cut at 1
    with pytest.raises(ValueError):
        denoise.quantile_test(spark.range(1), ["id"], "id", "id", alternative="other")


def test_denoise(spark, tmp_path):
    flat = frames(spark).withColumn("taxa", F.element_at("taxa", -1))
    by_sample = {r["taxid"]: r for r in denoise.slsd(flat).collect()}
    assert by_sample["7"]["r1"] == pytest.approx(1) and by_sample["7"]["p1"] == pytest.approx(2 / 720)
    assert by_sample["8"]["r1"] == pytest.approx(-1) and by_sample["8"]["r2"] is None
    kmer = spark.createDataFrame([("7", "A x", 3 + i, 2 + i) for i in range(8)] + [("8", "B y", 3 + i, (i * 5) % 8) for i in range(8)] + [("5", "C", 9, 9)], "taxid string, taxa string, kmer_len int, kmer_n_unique int")
    cells = {r["taxid"]: r for r in denoise.blsd(kmer).collect()}
    assert set(cells) == {"7", "8"} and cells["7"]["padj"] < 0.05
    umi = spark.createDataFrame([("7", "c1", "u1"), ("7", "c1", "u1"), ("7", "c1", "u2"), ("8", "c1", "u1")], "taxid string, barcode string, umi string")
    reference = spark.createDataFrame([("7", 1.0)], "taxid string, rpmm double")
    kreports = frames(spark)
    out = denoise.denoise_counts(kreports, {"s": kmer}, {"s": umi}, reference, taxon=["d__Bacteria"])
    assert out.slsd.count() and [tuple(r) for r in out.counts.collect()] == [("s", "c1", "7", 2)]
    umi.write.parquet(str(tmp_path / "u"))
    assert read_parquet(spark, {"a": str(tmp_path / "u"), "b": str(tmp_path / "u")}).groupBy("sample").count().count() == 2


def test_classifier_command():
    got = kraken2(["a.fq", "b.fq"], "--quick", db="d", threads=2, odir="o", program="kraken2", run=False)
    assert got == ["kraken2", "--threads", "2", "--report", "o/kraken_report.txt", "--output", "o/kraken_output.txt", "--classified-out", "o/classified.fq", "--db", "d", "--paired", "--quick", "a.fq", "b.fq"]
    with pytest.raises(ValueError):
        kraken2([], run=False)


def test_streams(spark, tmp_path, report):
    from taxaspark.streaming import count_stream, filter_stream, stream_koutput

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(KOUTPUT) + "\n")
    rows = filter_stream(stream_koutput(spark, str(tmp_path / "in")), report.where("taxid in ('2', '1224')"), exclude=["9606"])
    q = count_stream(rows, taxonomy.closure(report).persist()).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r["taxid"]: r["reads"] for r in spark.table("counts").collect()} == {"2": 3, "1224": 1}


def test_gzip_levels_differ(spark, tmp_path):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1)
    size = {}
    for level in (1, 9, 12):
        sinks.write_lines(rows, F.concat("x", F.lit("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaabcabcabc"), "x"), str(tmp_path / f"l{level}"), level)
        size[level] = sum(f.stat().st_size for f in (tmp_path / f"l{level}").glob("*.gz"))
    assert size[1] > size[9] == size[12] > 0


def test_last_line_counts_in_file_order(spark, tmp_path, report):
    lines = [f"C\tr{i}\t{t}\t8\t2:1" for t in ("2", "1224", "1239", "2") for i in range(500)] + ["C\tr7\t1224\t8\t2:1"]
    (tmp_path / "out.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # many parts of the file
        got = {r["read_id"]: r["taxid"] for r in classified(report, read_koutput(spark, str(tmp_path / "out.txt")), None, None).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"r{i}": "1224" if i == 7 else "2" for i in range(500)}


def test_taxonomy_without_a_match(spark, report, koutput):
    reads = spark.createDataFrame([], "taxid string, tags string, lca string, seq string, qual string")
    for run in (
        lambda strict: kractor_koutput(report, koutput, taxonomy="D__Nothing", strict=strict),
        lambda strict: classified(report, koutput, ["D__Nothing"], None, strict=strict),
        lambda strict: krcount(reads, report, taxonomy=["D__Nothing"], strict=strict),
    ):
        assert run(False).count() == 0
        with pytest.raises(ValueError, match="no taxonomic matches"):
            run(True)


def test_paths_of_several_reports(spark):
    rows = [("a", 5, "9", ["1", "9"]), ("b", 2, "9", ["2", "9"]), ("b", 1, "8", ["8"])]
    found = taxonomy.closure(spark.createDataFrame(rows, "source string, pos long, taxid string, taxids array<string>"))
    assert {tuple(r) for r in found.collect()} == {("9", "2"), ("9", "9"), ("8", "8")}


def test_string_helpers(spark):
    row = spark.createDataFrame([("a.b.c 12", ["x1", "y", "x2"])], "t string, xs array<string>")
    t, xs = F.col("t"), F.col("xs")
    got = row.select(
        strings.detect(t, ".", fixed=True), strings.detect(t, "z", negate=True), strings.which(xs, "^x"), strings.subset(xs, "x"), strings.replace(t, ".", "$1", fixed=True), strings.remove(t, r"\."), strings.remove_all(t, ".", fixed=True),
        strings.extract(t, "([0-9])([0-9])", 2), strings.extract(t, "q"), strings.extract_all(t, "[a-c]"), strings.split(t, ".", fixed=True), strings.count(t, ".", fixed=True), strings.trim(F.lit(" q "), "left"), strings.trim(F.lit(" q "), "right"),
    ).first()
    assert list(got) == [True, True, [0, 2], ["x1", "x2"], "a$1b.c 12", "ab.c 12", "abc 12", "2", None, ["a", "b", "c"], ["a", "b", "c 12"], 2, "q ", " q"]
    with pytest.raises(ValueError):
        strings.trim(t, "middle")
