import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from taxaspark.plans import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "taxaspark"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "taxaspark/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(queries.queries())), "False"], said.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["clade_reads", "koutreads_join", "krcount_tables", "fastq_pairs", "koutput_last_line", "koutreads_paired", "kreport_file", "stream_counts", "argument_rules", "slsd", "blsd", "denoise_counts"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    # SQL has no p-values of exact tests, which samples of 9 and fewer without ties take
    folder = DATA.replace("0.001", "0.01") if name in ("slsd", "blsd", "denoise_counts") else DATA
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    got, want = entry.queries()[name](spark, folder).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_plan_prunes_and_pushes_down(spark):
    plan = queries.queries()["kractor_koutput_taxids"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line and "o_orderkey" in line)
    assert "o_totalprice" not in scan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_flagship(spark, monkeypatch):
    assert entry.entry(spark).count() > 0


def test_denoise_counts_matches_plain_version(spark):
    import math
    from collections import defaultdict

    import numpy as np

    load = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    sold = load("lineitem").join(load("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = sold.select(F.date_format("l_shipdate", "yyyy-MM"), "p_brand", "l_suppkey", "l_partkey", "l_returnflag", F.col("l_quantity").cast("double")).collect()

    def ranks(x):
        x = np.array(x, float)
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    def test(x, y):
        """Spearman's correlation and its two-sided p-value by the t distribution, added up."""
        n = len(x)
        with np.errstate(all="ignore"):
            r = np.corrcoef(ranks(x), ranks(y))[0, 1]
        if not abs(r) <= 1:
            return r, math.nan
        t = abs(r) * math.sqrt((n - 2) / max(1 - r * r, 1e-12))
        at = np.linspace(0, t, 20_001)
        c = math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2)) / math.sqrt((n - 2) * math.pi)
        return r, 1 - 2 * np.trapezoid(c * (1 + at * at / (n - 2)) ** (-(n - 1) / 2), at)

    def measures(key):
        held = defaultdict(list)
        for r in rows:
            held[key(r)].append(r)
        return {k: (sum(r[5] for r in x), len({r[3] for r in x}), len(x)) for k, x in held.items()}

    months, brands = measures(lambda r: (r[0], r[1])), {r[1] for r in rows}
    total, passed = defaultdict(int), set()
    for (m, _), x in months.items():
        total[m] += x[2]
    for b in brands:
        own = [(m, *x) for (m, k), x in months.items() if k == b]
        low = sum(x[3] / total[x[0]] * 1e6 <= 1e6 / len(brands) for x in own)
        few = sum(math.comb(len(own), k) for k in range(low + 1)) / 2 ** len(own)  # as few months at or below an even share
        kept = [x for x in own if x[3] >= 3 and x[2] >= 3]
        gates = [test([x[i] for x in kept], [x[j] for x in kept]) for i, j in ((1, 2), (1, 3), (3, 2))] if len(kept) >= 3 else [(0, 1)]
        if few < 0.05 and all(r > 0 and p < 0.05 for r, p in gates):
            passed.add(b)
    cells, want = measures(lambda r: (r[0][:4], r[1], r[2])), defaultdict(set)
    for year in {k[0] for k in cells}:
        ps = {}
        for b in brands:
            kept = [x for k, x in cells.items() if k[:2] == (year, b) and x[0] >= 3]
            if len(kept) >= 3:
                ps[b] = test([x[0] for x in kept], [x[1] for x in kept])[1]
        order, least = sorted((b for b in ps if ps[b] == ps[b]), key=ps.get), 1.0
        real = set()
        for i in range(len(order), 0, -1):
            least = min(least, ps[order[i - 1]] * len(order) / i)
            if least < 0.05:
                real.add(order[i - 1])
        for r in rows:
            if r[0][:4] == year and r[1] in real & passed:
                want[year, r[4], r[1]].add(r[2])
    got = {tuple(r)[:3]: r["counts"] for r in entry.queries()["denoise_counts"](spark, DATA).collect()}
    assert got == {k: len(x) for k, x in want.items()}
    assert got and len({k[2] for k in got}) < len(brands)
