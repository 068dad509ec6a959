"""Association and information measures as aggregates; closed forms stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corr(x: str | Column, y: str | Column) -> Column:
    """Correlation of the pairs without nulls; null where one side is constant, at which the built-in aggregate raises."""
    x, y = ((F.col(c) if isinstance(c, str) else c).cast("double") for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """r, n and t of the test against 0."""
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), corr(x, y).alias("r"))
    return out.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def partial_correlation(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    c = df.groupBy(*by).agg(corr(x, y).alias("xy"), corr(x, z).alias("xz"), corr(y, z).alias("yz"))
    return c.select(*by, F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("r"))


def point_biserial(df: DataFrame, by: list[str], x: str, flag: Column) -> DataFrame:
    return df.groupBy(*by).agg(corr(F.col(x), flag.cast("double")).alias("r"))


def average_ranks(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(x)
    same = Window.partitionBy(*by, x)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(corr("_rx", "_ry").alias("rho"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, o, ra, rb, n): the table's cells that are not empty with their marginals."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    ra, rb, n = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("rb")), cells.agg(F.sum("o").alias("n"))
    return cells.join(ra, cells["a"].eqNullSafe(ra["a"])).drop(ra["a"]).join(rb, cells["b"].eqNullSafe(rb["b"])).drop(rb["b"]).crossJoin(F.broadcast(n))  # one row


def categorical(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, g, phi, Cramer's V of two labels; empty cells need no rows: chi2 = n (sum o^2 / (ra rb) - 1)."""
    t = contingency(df, a, b).agg(
        (F.max("n") * (F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))) - 1)).alias("chi2"), (2 * F.sum(F.col("o") * F.log(F.col("o") * F.col("n") / (F.col("ra") * F.col("rb"))))).alias("g"),
        F.max("n").alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"),
    )
    small = F.least(F.col("r"), F.col("c")) - 1
    return t.select("n", "chi2", "g", F.sqrt(F.col("chi2") / F.col("n")).alias("phi"), F.when(small > 0, F.sqrt(F.col("chi2") / (F.col("n") * small))).alias("v"))


def theils_u(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of the entropy of ``a`` that ``b`` explains."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    h = lambda col: F.log2(F.sum(col)) - F.sum(F.col(col) * F.log2(col)) / F.sum(col)
    ha = cells.groupBy("a").agg(F.sum("c").alias("k")).agg(h("k").alias("ha"))
    hb = cells.groupBy("b").agg(F.sum("c").alias("k")).agg(h("k").alias("hb"))
    hab = cells.agg(h("c").alias("hab"))
    return ha.crossJoin(hb).crossJoin(hab).select(F.when(F.col("ha") > 0, (F.col("ha") - (F.col("hab") - F.col("hb"))) / F.col("ha")).otherwise(1.0).alias("u"))


def histogram_nmi(df: DataFrame, x: str, y: str, bins: int = 8) -> DataFrame:
    """MI / sqrt(HxHy) in bits over equal-width bins, the last one closed. Fewer than 50 rows or a constant raise."""
    lim = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("rows"))
    bad = (F.col("rows") < 50) | (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    lim = lim.where(F.when(bad, F.raise_error(F.lit("too few rows or constant input")).cast("boolean")).otherwise(True))
    cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1))
    cells = df.crossJoin(F.broadcast(lim)).groupBy(cell(x, "x0", "x1").alias("a"), cell(y, "y0", "y1").alias("b")).agg(F.count("*").alias("c"))
    h = lambda col: F.log2(F.sum(col)) - F.sum(F.col(col) * F.log2(col)) / F.sum(col)
    hx, hy = (cells.groupBy(k).agg(F.sum("c").alias("k")).agg(h("k").alias(f"h{k}")) for k in ("a", "b"))
    return hx.crossJoin(hy).crossJoin(cells.agg(h("c").alias("hab"))).select(((F.col("ha") + F.col("hb") - F.col("hab")) / F.sqrt(F.col("ha") * F.col("hb"))).alias("nmi"))


def lagged(df: DataFrame, by: list[str], order: str, x: str, y: str, lags: list[int]) -> DataFrame:
    """Cross-correlation of x(t) with y(t + k), a row a lag (k > 0: x leads); each needs 3 pairs. One sort for all lags."""
    w = Window.partitionBy(*by).orderBy(order)
    wide = df.select(*by, F.col(x).alias("_x"), *[F.lead(y, k).over(w).alias(f"_y{i}") if k >= 0 else F.lag(y, -k).over(w).alias(f"_y{i}") for i, k in enumerate(lags)])
    parts = [F.struct(F.lit(k).alias("lag"), F.count(f"_y{i}").alias("pairs"), corr("_x", f"_y{i}").alias("r")) for i, k in enumerate(lags)]
    return wide.groupBy(*by).agg(F.array(*parts).alias("_p")).select(*by, F.inline("_p")).where("pairs >= 3")


def autocorrelation(df: DataFrame, by: list[str], order: str, x: str, lags: list[int]) -> DataFrame:
    return lagged(df, by, order, x, x, lags)


def copula_tails(df: DataFrame, by: list[str], x: str, y: str, q: float = 0.10) -> DataFrame:
    """Lower and upper tail dependence and Blomqvist's beta of the pseudo-observations rank / (n + 1). Ties raise."""
    n = F.count("*").over(Window.partitionBy(*by))

    def place(c: str) -> Column:
        w = Window.partitionBy(*by).orderBy(c)
        return F.when(F.lag(c).over(w) == F.col(c), F.raise_error(F.lit(f"ties in {c}")).cast("int")).otherwise(F.row_number().over(w)) / (n + 1)

    u, v = place(x), place(y)
    d = df.select(*by, u.alias("u"), v.alias("v"))
    both = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), (both((F.col("u") <= q) & (F.col("v") <= q)) / q).alias("lower"), (both((F.col("u") > 1 - q) & (F.col("v") > 1 - q)) / q).alias("upper"),
        (4 * both((F.col("u") <= 0.5) & (F.col("v") <= 0.5)) - 1).alias("beta"),
    )


def granger_lag1(df: DataFrame, order: str, x: str, y: str, by: list[str]) -> DataFrame:
    """F test that x(t-1) helps y(t) beside y(t-1): both fits by the normal equations' sums, per group."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.select(*by, F.col(y).cast("double").alias("t"), F.lag(y).over(w).cast("double").alias("a"), F.lag(x).over(w).cast("double").alias("b")).where("a is not null and b is not null")
    s = d.groupBy(*by).agg(F.count("*").alias("n"), *[F.covar_pop(p, q).alias(f"c{p}{q}") for p, q in ("ta", "tb", "ab")], *[F.var_pop(p).alias(f"v{p}") for p in "tab"])
    rr = F.col("n") * (F.col("vt") - F.col("cta") ** 2 / F.col("va"))
    det = F.col("va") * F.col("vb") - F.col("cab") ** 2
    explained = (F.col("cta") ** 2 * F.col("vb") - 2 * F.col("cta") * F.col("ctb") * F.col("cab") + F.col("ctb") ** 2 * F.col("va")) / det
    ru = F.col("n") * (F.col("vt") - explained)
    return s.where(F.col("n") >= 4).select(*by, "n", rr.alias("rss_restricted"), ru.alias("rss_unrestricted"), ((rr - ru) / (ru / (F.col("n") - 3))).alias("f"))


def outcome_agreement(df: DataFrame, by: list[str], outcome: str) -> DataFrame:
    """Agreeing pairs over all pairs, at least 3 outcomes; consistent from 0.75."""
    counts = df.groupBy(*by, outcome).agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("p"))
    out = counts.where("n >= 3").select(*by, "n", (F.col("p") / (F.col("n") * (F.col("n") - 1))).alias("agreement"))
    return out.withColumn("consistent", F.col("agreement") >= 0.75)


def kendall(df: DataFrame, by: list[str], x: str, y: str, most: int = 20_000) -> DataFrame:
    """tau-b over the distinct (x, y) cells of each group: cells are counted first, so ties cost nothing; a group with more
    than ``most`` cells raises, as concordance is a count over pairs of cells."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    size = F.count("*").over(Window.partitionBy(*by))
    cells = cells.withColumn("_n", size).where(F.when(F.col("_n") > most, F.raise_error(F.lit("too many cells")).cast("boolean")).otherwise(True)).drop("_n")
    other = cells.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("c").alias("c2"))
    sign = F.signum(F.col("x2") - F.col("x")) * F.signum(F.col("y2") - F.col("y"))
    s = cells.join(other, by).groupBy(*by).agg((F.sum(sign * F.col("c") * F.col("c2")) / 2).alias("s"))
    ties = lambda col: cells.groupBy(*by, col).agg(F.sum("c").alias("k")).groupBy(*by).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(f"t{col}"), F.sum("k").alias("n"))
    j = s.join(ties("x"), by).join(ties("y").drop("n"), by)
    all_ = F.col("n") * (F.col("n") - 1) / 2
    return j.select(*by, "n", (F.col("s") / F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty")))).alias("tau"))


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("r")) for a, b in pairs])
    return df.agg(parts.alias("_p")).select(F.inline("_p"))


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Confidence interval of a correlation by Fisher's transform; null below four pairs."""
    a, half = F.atanh(r), F.lit(z) / F.sqrt(n - 3)
    return F.when(n > 3, F.tanh(a - half)), F.when(n > 3, F.tanh(a + half))


def gaussian_cmi_bits(r: Column) -> Column:
    """Conditional mutual information of Gaussians in bits, from the partial correlation."""
    return -0.5 * F.log2(1 - r * r)


def partial_correlation_many(df: DataFrame, x: str, y: str, controls: list[str]) -> float:
    """Partial correlation given several columns, from the precision matrix; the correlations are one aggregation."""
    names = [x, y, *controls]
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    got = df.dropna(subset=names).agg(*[corr(names[i], names[j]) for i, j in pairs]).first()
    m = np.eye(len(names))
    for (i, j), r in zip(pairs, got):
        m[i, j] = m[j, i] = r
    p = np.linalg.inv(m)
    return float(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]))


def cross_correlation(df: DataFrame, by: list[str], order: str, x: str, y: str, most: int) -> DataFrame:
    """(by, lag, n, r) for lags of -most..most; at a positive lag ``x`` leads. Lags of fewer than three pairs are left out."""
    w = Window.partitionBy(*by).orderBy(order)
    cols = [F.struct(F.lit(k).alias("lag"), F.col(x).cast("double").alias("a"), F.lead(F.col(y).cast("double"), k).over(w).alias("b")) for k in range(-most, most + 1)]
    pairs = df.select(*by, *[c.alias(f"_{i}") for i, c in enumerate(cols)]).select(*by, F.explode(F.array(*[f"_{i}" for i in range(len(cols))])).alias("p"))
    got = pairs.select(*by, "p.*").where("a is not null and b is not null").groupBy(*by, "lag").agg(F.count("*").alias("n"), corr("a", "b").alias("r"))
    return got.where("n >= 3")


def correlation_peak(profile: DataFrame, by: list[str]) -> DataFrame:
    """The lag of the largest absolute correlation; ties: more pairs, then the smaller absolute lag."""
    return profile.groupBy(*by).agg(F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), "n", -F.abs("lag"))).alias("p")).select(*by, "p.lag", "p.r")


def granger(df: DataFrame, by: list[str], order: str, x: str, y: str, lags: int) -> DataFrame:
    """(by, n, f, df1, df2): F test that ``lags`` values of x help y beside its own; the normal equations' sums are additive,
    so a group is one row of sums. Groups of fewer than 3 * lags + 2 rows are left out; a singular design gives null."""
    w = Window.partitionBy(*by).orderBy(order)
    names = ["one", *[f"y{k}" for k in range(1, lags + 1)], *[f"x{k}" for k in range(1, lags + 1)]]
    cols = [F.lag(F.col(c).cast("double"), k).over(w).alias(f"{n}{k}") for n, c in (("y", y), ("x", x)) for k in range(1, lags + 1)]
    rows = df.select(*by, F.col(y).cast("double").alias("t"), F.lit(1.0).alias("one"), *cols).dropna()
    pairs = [(a, b) for i, a in enumerate([*names, "t"]) for b in [*names, "t"][: i + 1]]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("s"))

    @F.pandas_udf("double")
    def test(n: pd.Series, s: pd.Series) -> pd.Series:
        size = len(names) + 1
        out = []
        for count, values in zip(n, s):
            m = np.zeros((size, size))
            m[np.tril_indices(size)] = values
            m = m + m.T - np.diag(np.diag(m))

            def rss(k: int, m=m) -> float:
                return float(m[-1, -1] - m[-1, :k] @ np.linalg.lstsq(m[:k, :k], m[:k, -1], rcond=None)[0])

            free, left = count - size + 1, rss(size - 1)
            singular = np.linalg.matrix_rank(m[:-1, :-1]) < size - 1
            out.append(None if singular or left <= 0 or free <= 0 else (rss(1 + lags) - left) / lags / (left / free))
        return pd.Series(out, dtype=float)

    got = sums.where(F.col("n") + lags >= 3 * lags + 2)
    return got.select(*by, "n", test("n", "s").alias("f"), F.lit(lags).alias("df1"), (F.col("n") - 2 * lags - 1).alias("df2"))


def linear_cka(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(cka): |X'Y|^2 / (|X'X| |Y'Y|) of centred column sets; one aggregation of the covariances."""
    every = [*left, *right]
    cov = {(a, b): F.covar_pop(a, b) for a in every for b in every}
    total = lambda p, q: sum((cov[a, b] * cov[a, b] for a in p for b in q), F.lit(0.0))
    return df.dropna(subset=every).agg((total(left, right) / F.sqrt(total(left, left) * total(right, right))).alias("cka"))
