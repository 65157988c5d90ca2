"""Rank correlation tests, adjusted p-values, quantiles and binomial tests on grouped rows.

Coefficients and ranks are window and aggregate expressions. Only the p-value of a correlation, one
number per group, needs special functions: it is computed from (r, n, ties) in a pandas UDF, or for
Kendall's exact test by counting.
"""

from __future__ import annotations

import collections
import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# --- distributions ---------------------------------------------------------------------------


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by a continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_upper(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _sided(upper: float, lower: float, alternative: str) -> float:
    if alternative == "greater":
        return upper
    if alternative == "less":
        return lower
    return min(1.0, 2 * min(upper, lower))


@functools.lru_cache(maxsize=64)
def _rho_exact(n: int) -> tuple[list[int], list[int]]:
    """How many permutations of n have each sum of squared rank differences, for small n."""
    counts: dict[tuple[int, int], int] = {(0, 0): 1}
    for i in range(n):
        nxt: dict[tuple[int, int], int] = {}
        for (used, s), c in counts.items():
            for j in range(n):
                if not used >> j & 1:
                    key = (used | 1 << j, s + (i - j) ** 2)
                    nxt[key] = nxt.get(key, 0) + c
        counts = nxt
    total: dict[int, int] = {}
    for (_, s), c in counts.items():
        total[s] = total.get(s, 0) + c
    return sorted(total), [total[s] for s in sorted(total)]


def rho_upper(s: float, n: int) -> float:
    """P(S >= s) for the sum of squared rank differences: by counting up to n = 9, then by the Edgeworth series of Best and Roberts (1975)."""
    if n <= 1 or s <= 0:
        return 1.0
    most = n * (n * n - 1) / 3
    if s > most:
        return 0.0
    if n <= 9:
        sums, counts = _rho_exact(n)
        return sum(c for v, c in zip(sums, counts, strict=True) if v >= s - 1e-9) / math.factorial(n)
    b = 1.0 / n
    x = (6 * (s - 1) * b / (n * n - 1.0) - 1) * math.sqrt(1 / b - 1)
    y = x * x
    # The coefficients of the published series.
    u = x * b * (0.2274 + b * (0.2531 + 0.1745 * b) + y * (-0.0758 + b * (0.1033 + 0.3932 * b) - y * b * (0.0879 + 0.0151 * b - y * (0.0072 - 0.0831 * b + y * b * (0.0131 - 4.6e-04 * y)))))
    return min(1.0, max(0.0, u / math.exp(y / 2) + normal_upper(x)))


@functools.lru_cache(maxsize=64)
def _inversions(n: int) -> list[int]:
    """How many permutations of n have each number of inversions."""
    out = [1]
    for k in range(2, n + 1):
        out = [sum(out[max(0, i - k + 1) : i + 1]) for i in range(len(out) + k - 1)]
    return out


def spearman_p(r: float, n: int, ties: bool, alternative: str = "two.sided", exact: bool | None = None, continuity: bool = False) -> float:
    exact = (n < 1290) if exact is None else exact
    if not exact or ties:
        if continuity:
            r -= math.copysign(1, r) / ((n * n - 1) * n / 6) if r else 0
        if n < 3:
            return math.nan
        t = r * math.sqrt((n - 2) / max(1 - r * r, 0)) if abs(r) < 1 else math.copysign(math.inf, r)
        return _sided(t_upper(t, n - 2), t_upper(-t, n - 2), alternative)
    s = round((n**3 - n) * (1 - r) / 6)
    # large s means negative association; s is even, so the lower tail is 1 - P(S >= s + 2)
    negative, positive = rho_upper(s, n), 1 - rho_upper(s + 2, n)
    if alternative == "greater":
        return positive
    if alternative == "less":
        return negative
    return min(1.0, 2 * (negative if s > (n**3 - n) / 6 else positive))


def pearson_p(r: float, n: int, alternative: str = "two.sided") -> float:
    if n < 3:
        return math.nan
    t = r * math.sqrt((n - 2) / max(1 - r * r, 0)) if abs(r) < 1 else math.copysign(math.inf, r)
    return _sided(t_upper(t, n - 2), t_upper(-t, n - 2), alternative)


def concordance(x: list[float], y: list[float]) -> int:
    """Pairs in the same order on both sides less those in opposite order, in n log n steps: with the rows by x and then y,
    opposite pairs are the inversions of y, counted while merging."""
    n = len(x)
    order = sorted(range(n), key=lambda i: (x[i], y[i]))
    ys = [y[i] for i in order]
    tied = lambda keys: sum(c * (c - 1) // 2 for c in collections.Counter(keys).values())
    comparable = n * (n - 1) // 2 - tied(x) - tied(y) + tied(zip(x, y, strict=True))
    swaps, width = 0, 1
    while width < n:
        merged: list[float] = []
        for a in range(0, n, 2 * width):
            left, right = ys[a : a + width], ys[a + width : a + 2 * width]
            i = 0
            for v in right:
                while i < len(left) and left[i] <= v:
                    merged.append(left[i])
                    i += 1
                swaps += len(left) - i
                merged.append(v)
            merged += left[i:]
        ys, width = merged, 2 * width
    return comparable - 2 * swaps


def kendall(x: list[float], y: list[float], alternative: str = "two.sided", exact: bool | None = None, continuity: bool = False) -> tuple[float, float]:
    """tau-b and its p-value: by counting inversions below 50 rows without ties, else by the normal approximation."""
    n = len(x)
    score = concordance(x, y)
    tied = lambda v: [c for c in pd.Series(v).value_counts() if c > 1]
    tx, ty = tied(x), tied(y)
    pairs = n * (n - 1) / 2
    bottom = math.sqrt((pairs - sum(t * (t - 1) / 2 for t in tx)) * (pairs - sum(t * (t - 1) / 2 for t in ty)))
    if not bottom:
        return math.nan, math.nan
    tau = score / bottom
    if (n < 50 if exact is None else exact) and not tx and not ty:
        q = round((tau + 1) * pairs / 2)
        counts, total = _inversions(n), math.factorial(n)
        lower, upper = sum(counts[: q + 1]) / total, sum(counts[q:]) / total
        if alternative == "two.sided":
            return tau, min(1.0, 2 * (upper if q > pairs / 2 else lower))
        return tau, upper if alternative == "greater" else lower
    v = lambda t, f: sum(f(k) for k in t)
    v0 = n * (n - 1) * (2 * n + 5) - v(tx, lambda k: k * (k - 1) * (2 * k + 5)) - v(ty, lambda k: k * (k - 1) * (2 * k + 5))
    v1 = v(tx, lambda k: k * (k - 1)) * v(ty, lambda k: k * (k - 1)) / (2 * n * (n - 1))
    v2 = v(tx, lambda k: k * (k - 1) * (k - 2)) * v(ty, lambda k: k * (k - 1) * (k - 2)) / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0
    sd = math.sqrt(v0 / 18 + v1 + v2)
    z = (score - math.copysign(1, score) if continuity and score else score) / sd if sd else math.nan
    return tau, _sided(normal_upper(z), normal_upper(-z), alternative)


def binom_cdf(k: int, n: int, p: float = 0.5) -> float:
    """P(X <= k)."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return beta_inc(n - k, k + 1, 1 - p)


def binom_upper(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k), by its own tail: small ones don't vanish beside 1."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    return beta_inc(k, n - k + 1, p)


# --- columns ---------------------------------------------------------------------------------


def average_rank(keys: list[str], x: str) -> Column:
    """Ranks in which equal values share their mean."""
    same = W.partitionBy(*keys, x)
    return F.rank().over(W.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(same) - 1) / 2


def correlations(rows: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]], method: str = "spearman") -> DataFrame:
    """Per group: n, and for each name its coefficient and <name>_ties, whether either side has equal values."""
    names = sorted({c for xy in pairs.values() for c in xy})
    out = rows.select(*keys, *names)
    for c in names:
        out = out.withColumn(f"_v_{c}", average_rank(keys, c) if method == "spearman" else F.col(c).cast("double"))
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_distinct(c).alias(f"_d_{c}") for c in names]
    for name, (x, y) in pairs.items():
        spread = F.stddev_pop(f"_v_{x}") * F.stddev_pop(f"_v_{y}")  # 0 if either side is constant, which corr() raises for
        aggs.append(F.try_divide(F.covar_pop(f"_v_{x}", f"_v_{y}"), spread).alias(name))
    got = out.groupBy(*keys).agg(*aggs)
    for name, (x, y) in pairs.items():
        got = got.withColumn(f"{name}_ties", (F.col(f"_d_{x}") < F.col("n")) | (F.col(f"_d_{y}") < F.col("n")))
    return got.drop(*[f"_d_{c}" for c in names])


def p_value(method: str, alternative: str = "two.sided", exact: bool | None = None, continuity: bool = False):
    """A pandas UDF (r, n, ties) -> p."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        def one(a: float, b: int, t: bool) -> float | None:
            if a is None or math.isnan(a):
                return None
            a = max(-1.0, min(1.0, a))
            v = spearman_p(a, int(b), bool(t), alternative, exact, continuity) if method == "spearman" else pearson_p(a, int(b), alternative)
            return None if math.isnan(v) else v

        return pd.Series([one(a, b, t) for a, b, t in zip(r, n, ties, strict=True)], dtype="float64")

    return p


def cor_tests(rows: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str, str]], method: str = "spearman", alternative: str = "two.sided", exact: bool | None = None, continuity: bool = False) -> DataFrame:
    """Per group, for each (coefficient name: (x, y, p-value name)), the coefficient and its p-value."""
    if method not in ("spearman", "pearson", "kendall"):
        raise ValueError(f"unknown method {method}")
    if alternative not in ("two.sided", "less", "greater"):
        raise ValueError(f"unknown alternative {alternative}")
    if method == "kendall":
        names = sorted({c for x, y, _ in pairs.values() for c in (x, y)})
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema] + [f"{a} double, {p} double" for a, (_, _, p) in pairs.items()])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = {k: [pdf[k].iloc[0]] for k in keys}
            for a, (x, y, p) in pairs.items():
                r, v = kendall(pdf[x].tolist(), pdf[y].tolist(), alternative, exact, continuity)
                out[a], out[p] = [r], [v]
            return pd.DataFrame(out)

        return rows.select(*keys, *names).groupBy(*keys).applyInPandas(run, schema)
    got = correlations(rows, keys, {a: (x, y) for a, (x, y, _) in pairs.items()}, method)
    p = p_value(method, alternative, exact, continuity)
    return got.select(*keys, *list(pairs), *[p(F.col(a), F.col("n"), F.col(f"{a}_ties")).alias(v) for a, (_, _, v) in pairs.items()])


def p_adjust(rows: DataFrame, p: str = "pvalue", out: str = "padj", method: str = "BH", within: list[str] | None = None) -> DataFrame:
    """Adjusts for multiple tests over all rows, or within groups; null p-values stay null and don't count.

    Equal p-values have equal results, so distinct ones are ranked, with their numbers. They are dealt to slices of nearly equal
    logarithm: ranks, and least or greatest values so far, come from within a slice and from the totals of the slices before
    or behind it, so no task holds more than a slice or the totals (about 10^6 at most) of a group.
    """
    keys = within or []
    if method == "none":
        return rows.withColumn(out, F.col(p))
    if method == "hommel":
        return _hommel(rows, p, out, keys)
    if method not in ("bonferroni", "BH", "fdr", "BY", "hochberg", "holm"):
        raise ValueError(f"unknown method {method}")
    if "_slice" in rows.columns or "_p" in rows.columns:
        raise ValueError("columns _slice and _p are used inside")
    slice_ = F.floor(F.log2(F.greatest(F.col("_p"), F.lit(5e-324))) * 1024).cast("bigint")
    each = rows.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_slice", slice_)
    totals = each.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_t"))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier, later = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1), group.orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_n", F.sum("_t").over(group)).withColumn("_base", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t")
    inner = W.partitionBy(*keys, "_slice")
    each = _beside(each, totals, [*keys, "_slice"])
    each = each.withColumn("_upto", F.col("_base") + F.sum("_c").over(inner.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)))
    n, upto = F.col("_n"), F.col("_upto")
    value = {
        "bonferroni": F.col("_p") * n, "BH": F.col("_p") * n / upto, "fdr": F.col("_p") * n / upto, "hochberg": F.col("_p") * (n - upto + 1), "holm": F.col("_p") * (n - upto + F.col("_c")),
        "BY": F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i) * F.col("_p") * n / upto,
    }[method]
    if method == "BY":
        # beyond 1000 the harmonic sum by its expansion, to 16 digits
        rest = lambda m: F.log(m) + 1 / (2 * m) - 1 / (12 * m * m)
        big = F.when(n > 1000, rest(n.cast("double")) - rest(F.lit(1000.0))).otherwise(0.0)
        value = value + big * F.col("_p") * n / upto
    each = each.withColumn("_v", value)
    if method != "bonferroni":
        up, best = (earlier, F.max) if method == "holm" else (later, F.min)
        order = F.col("_p").asc() if method == "holm" else F.col("_p").desc()
        ends = each.groupBy(*keys, "_slice").agg(best("_v").alias("_end")).withColumn("_beyond", best("_end").over(up)).drop("_end")
        each = _beside(each, ends, [*keys, "_slice"]).withColumn("_v", best("_v").over(inner.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
        pick = F.greatest if method == "holm" else F.least
        each = each.withColumn("_v", pick("_v", "_beyond"))
    each = each.select(*keys, "_p", F.least(F.lit(1.0), F.col("_v")).alias(out))
    return _beside(rows.withColumn("_p", F.col(p)), each, [*keys, "_p"], "left").drop("_p")


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on which nulls meet; keeps the left keys."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def hommel(ps: list[float]) -> list[float]:
    n = len(ps)
    order = sorted(range(n), key=lambda i: ps[i])
    p = [ps[i] for i in order]
    if n < 2:
        return list(ps)
    q = pa = [min(n * p[i] / (i + 1) for i in range(n))] * n
    for j in range(n - 1, 1, -1):
        first, last = range(n - j + 1), range(n - j + 1, n)
        q1 = min(j * p[i] / k for k, i in enumerate(last, 2))
        q = [0.0] * n
        for i in first:
            q[i] = min(j * p[i], q1)
        for i in last:
            q[i] = q[n - j]
        pa = [max(a, b) for a, b in zip(pa, q, strict=True)]
    out = [0.0] * n
    for k, i in enumerate(order):
        out[i] = min(1.0, max(pa[k], p[k]))
    return out


def _hommel(rows: DataFrame, p: str, out: str, keys: list[str]) -> DataFrame:
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{out} double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        there = pdf[p].notna()
        pdf[out] = float("nan")
        pdf.loc[there, out] = hommel(pdf.loc[there, p].tolist())
        return pdf

    return rows.groupBy(*keys).applyInPandas(run, schema)


def quantile_nearest(rows: DataFrame, keys: list[str], x: str, q: float, out: str, interpolation: str = "nearest") -> DataFrame:
    """Per group, the value at the rank nearest to q (or between the two around it, if `linear`), by windows: no group is collected."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    if interpolation == "linear":
        return rows.groupBy(*keys).agg(F.percentile(x, q).alias(out))
    w = W.partitionBy(*keys)
    at = {"nearest": F.round((F.col("_n") - 1) * q), "lower": F.floor((F.col("_n") - 1) * q), "higher": F.ceil((F.col("_n") - 1) * q)}[interpolation] + 1
    there = rows.where(F.col(x).isNotNull()).withColumn("_n", F.count(x).over(w)).withColumn("_i", F.row_number().over(w.orderBy(x)))
    return there.where(F.col("_i") == at).groupBy(*keys).agg(F.max(x).alias(out))


def binomial_p(at_most: Column, below: Column, n: Column, p: float, alternative: str) -> Column:
    """The test of a quantile from counts of values up to and below the reference."""

    @F.pandas_udf("double")
    def run(t1: pd.Series, t2: pd.Series, m: pd.Series) -> pd.Series:
        def one(a: int, b: int, c: int) -> float:
            less, greater = binom_upper(int(b), int(c), p), binom_cdf(int(a), int(c), p)
            return less if alternative == "less" else greater if alternative == "greater" else 2 * min(less, greater)

        return pd.Series([one(a, b, c) if pd.notna(c) else None for a, b, c in zip(t1, t2, m, strict=True)], dtype="float64")

    return run(at_most, below, n)
