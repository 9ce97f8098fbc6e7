"""Adjustment of p-values, tests between groups of samples, correlations and clustering of samples.

Adjusted values are windows over the family of tests. Tests work on one number a sample, so their groups are small; they run
in pandas inside groups of the family, and tails come from the incomplete beta and gamma functions below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship


def adjust(df: DataFrame, method: str, by: Sequence[str] = (), p: str = "p", name: str = "p_adjusted") -> DataFrame:
    """p-values adjusted in each family: none, bonferroni, holm, hochberg, bh, by or hommel."""
    if method == "hommel":
        cols = df.columns

        def run(pdf):
            x = pdf[p].to_numpy(float)
            return pdf[cols].assign(**{name: hommel(x)})

        return _groups(df, by).applyInPandas(run, df.withColumn(name, F.lit(0.0)).schema)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(part)
    up = part.orderBy(F.col(p).asc())
    i = F.row_number().over(up)
    to_here = up.rowsBetween(Window.unboundedPreceding, 0)
    from_here = up.rowsBetween(0, Window.unboundedFollowing)
    one = F.lit(1.0)
    ranked = df.withColumn("_i", i).withColumn("_n", n)
    q = {
        "none": F.col(p),
        "bonferroni": F.least(one, F.col(p) * F.col("_n")),
        "holm": F.least(one, F.max(F.col(p) * (F.col("_n") - F.col("_i") + 1)).over(to_here)),
        "hochberg": F.least(one, F.min(F.col(p) * (F.col("_n") - F.col("_i") + 1)).over(from_here)),
        "bh": F.least(one, F.min(F.col(p) * F.col("_n") / F.col("_i")).over(from_here)),
        "by": F.least(one, F.min(F.col(p) * F.col("_n") / F.col("_i") * F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k)).over(from_here)),
    }[method]
    return ranked.withColumn(name, q).drop("_i", "_n")


def _groups(df: DataFrame, by: Sequence[str]):
    """df grouped for pandas; all of it without columns to group by."""
    ship(df.sparkSession)
    return df.groupBy(*by) if by else df.withColumn("_all", F.lit(0)).groupBy("_all")


def hommel(p: np.ndarray) -> np.ndarray:
    n = len(p)
    order = np.argsort(p)
    s = p[order]
    i = np.arange(1, n + 1)
    q = np.full(n, (n * s / i).min())
    best = q.copy()
    for m in range(n - 1, 1, -1):
        low, high = np.arange(n - m + 1), np.arange(n - m + 1, n)
        q1 = (m * s[high] / np.arange(2, m + 1)).min()
        q[low] = np.minimum(m * s[low], q1)
        q[high] = q[n - m]
        best = np.maximum(best, q)
    out = np.empty(n)
    out[order] = np.minimum(1, np.maximum(best, s))
    return out


def holm_selection(df: DataFrame, alpha: float = 0.05, p: str = "p") -> DataFrame:
    """The tests that Holm's step-down procedure rejects."""
    return adjust(df, "holm", p=p).where(F.col("p_adjusted") <= alpha).drop("p_adjusted")


def _betainc(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, h = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d) if 1 + num * d else 1e300
        c = 1 + num / c if c else 1e300
        h *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (h - 1)


def _t_tail(t: float, df: float) -> float:
    return _betainc(df / 2, 0.5, df / (df + t * t))


def _f_tail(f: float, d1: float, d2: float) -> float:
    return _betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _chi2_tail(x: float, k: float) -> float:
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank().to_numpy()


def t_test(x, y, paired: bool = False) -> float:
    """Two-sided: Welch's test, or the paired test."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if paired:
        d = x - y
        se = d.std(ddof=1) / math.sqrt(len(d))
        return _t_tail(d.mean() / se, len(d) - 1) if se else 1.0
    vx, vy = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
    if vx + vy == 0:
        return 1.0
    return _t_tail((x.mean() - y.mean()) / math.sqrt(vx + vy), (vx + vy) ** 2 / (vx**2 / (len(x) - 1) + vy**2 / (len(y) - 1)))


def wilcoxon(x, y, paired: bool = False) -> float:
    """Two-sided rank-sum test, or signed-rank test, by the normal approximation with ties and continuity corrected."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if paired:
        d = (x - y)[x != y]
        n, r = len(d), _ranks(np.abs(d))
        stat, mean = r[d > 0].sum(), n * (n + 1) / 4
        ties = pd.Series(np.abs(d)).value_counts().to_numpy()
        var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    else:
        n, m = len(x), len(y)
        r = _ranks(np.concatenate([x, y]))
        stat, mean = r[:n].sum() - n * (n + 1) / 2, n * m / 2
        ties = pd.Series(np.concatenate([x, y])).value_counts().to_numpy()
        var = n * m / 12 * ((n + m + 1) - (ties**3 - ties).sum() / ((n + m) * (n + m - 1)))
    if var <= 0:
        return 1.0
    z = max(0.0, abs(stat - mean) - 0.5) / math.sqrt(var)
    return math.erfc(z / math.sqrt(2))


def anova(groups) -> float:
    groups = [np.asarray(g, float) for g in groups]
    n, k = sum(map(len, groups)), len(groups)
    mean = np.concatenate(groups).mean()
    between, within = sum(len(g) * (g.mean() - mean) ** 2 for g in groups), sum(((g - g.mean()) ** 2).sum() for g in groups)
    return 1.0 if within == 0 and between == 0 else 0.0 if within == 0 else _f_tail(between / (k - 1) / (within / (n - k)), k - 1, n - k)


def kruskal_wallis(groups) -> float:
    sizes = [len(g) for g in groups]
    every = np.concatenate([np.asarray(g, float) for g in groups])
    r, n = _ranks(every), len(every)
    parts = np.split(r, np.cumsum(sizes)[:-1])
    h = 12 / (n * (n + 1)) * sum(p.sum() ** 2 / len(p) for p in parts) - 3 * (n + 1)
    ties = pd.Series(every).value_counts().to_numpy()
    scale = 1 - (ties**3 - ties).sum() / (n**3 - n)
    return 1.0 if scale == 0 else _chi2_tail(h / scale, len(groups) - 1)


def kolmogorov_smirnov(x, y) -> float:
    """Two-sided two-sample test by the limiting distribution."""
    x, y = np.sort(np.asarray(x, float)), np.sort(np.asarray(y, float))
    every = np.concatenate([x, y])
    d = np.abs(np.searchsorted(x, every, "right") / len(x) - np.searchsorted(y, every, "right") / len(y)).max()
    lam = d * math.sqrt(len(x) * len(y) / (len(x) + len(y)))
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


TESTS = {"t": t_test, "wilcoxon": wilcoxon, "ks": lambda x, y, paired=False: kolmogorov_smirnov(x, y)}


def pairwise(df: DataFrame, value: str, group: str, method: str = "wilcoxon", by: Sequence[str] = (), reference: str | None = None, paired_by: str | None = None) -> DataFrame:
    """(by, group_1, group_2, p): a test for each pair of groups, or of each group with the reference, inside each family.
    df has one row a sample."""
    names = list(by)

    def run(pdf):
        out, test = [], TESTS[method]
        groups = sorted(pdf[group].dropna().unique())
        pairs = [(reference, g) for g in groups if g != reference] if reference is not None else [(a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]]
        for a, b in pairs:
            x, y = (pdf[pdf[group] == g].dropna(subset=[value]) for g in (a, b))
            if paired_by:
                both = x.merge(y, on=paired_by)
                x, y = both[f"{value}_x"], both[f"{value}_y"]
            else:
                x, y = x[value], y[value]
            p = test(x, y, paired=bool(paired_by)) if min(len(x), len(y)) > 1 else float("nan")
            out.append([*pdf[names].iloc[0], a, b, p])
        return pd.DataFrame(out, columns=[*names, "group_1", "group_2", "p"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), "group_1 string", "group_2 string", "p double"])
    return _groups(df, names).applyInPandas(run, schema)


def across(df: DataFrame, value: str, group: str, method: str = "kruskal", by: Sequence[str] = ()) -> DataFrame:
    """(by, p): one test over all groups, anova or kruskal."""
    names = list(by)

    def run(pdf):
        groups = [g[value].dropna().to_numpy() for _, g in pdf.groupby(group)]
        p = (anova if method == "anova" else kruskal_wallis)(groups) if len(groups) > 1 else float("nan")
        return pd.DataFrame([[*pdf[names].iloc[0], p]], columns=[*names, "p"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), "p double"])
    return _groups(df, names).applyInPandas(run, schema)


def linkage(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Average-linkage clustering by Euclidean distance: the merges (a, b, distance), new clusters numbered on from n."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)).astype(float)
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    for k in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        out.append((ids[i], ids[j], float(d[i, j])))
        d[i] = d[:, i] = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        ids[i], size[i] = n + k, size[i] + size[j]
    return out


def cluster_samples(matrix: DataFrame, sample: str = "sample") -> DataFrame:
    """(step, left, right, distance) of the clustering of the rows of a small sample-by-feature table."""

    def run(pdf):
        pdf = pdf.sort_values(sample)
        merges = linkage(pdf.drop(columns=[sample, "_all"]).to_numpy(float))
        names = dict(enumerate(pdf[sample].astype(str)))
        rows = []
        for k, (a, b, d) in enumerate(merges):
            rows.append((k, names[a], names[b], d))
            names[len(pdf) + k] = f"({names[a]},{names[b]})"
        return pd.DataFrame(rows, columns=["step", "left", "right", "distance"])

    return _groups(matrix, []).applyInPandas(run, "step int, left string, right string, distance double")
