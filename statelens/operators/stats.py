"""Rank and contingency tests. Rows are aggregated to histograms first; windows run over distinct values only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SIGNIFICANT = 0.05


def midranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, ties, midrank): mean rank of each distinct value within by."""
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("midrank", F.coalesce(F.sum("ties").over(w), F.lit(0)) + (F.col("ties") + 1) / 2)


def rank_groups(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, group, n, rank_sum, total, tie_sum): rank sums of each group from the joint ranking within by."""
    return _rank_groups(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group, value).agg(F.count("*").alias("_n")), by, group, value)


def _rank_groups(h: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by, value)
    # the ranking runs over (value, group) counts: as many rows as distinct values times groups
    ties = h.withColumn("ties", F.sum("_n").over(w))
    before = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(*by, value).orderBy(group)
    ties = ties.withColumn("rank", F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("ties") + 1) / 2)
    ties = ties.withColumn("t3", F.when(F.row_number().over(first) == 1, F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")).otherwise(0.0))
    g = ties.groupBy(*by, group).agg(F.sum("_n").alias("n"), F.sum(F.col("rank") * F.col("_n")).alias("rank_sum"), F.sum("t3").alias("t3"))
    all_ = Window.partitionBy(*by)
    return g.withColumn("total", F.sum("n").over(all_)).withColumn("tie_sum", F.sum("t3").over(all_)).drop("t3")


def chi2_sf_even(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared for an even number of degrees of freedom: a finite series."""
    half = x / 2
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest((df / 2).cast("int"), F.lit(1))), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), lambda a, k: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * half / k).alias("t")))
    return F.exp(-half) * terms["s"]


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * lead
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-squared; only result rows get here."""
    return pd.Series([None if pd.isna(a) or pd.isna(k) or k < 1 else _gamma_q(k / 2, a / 2) for a, k in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; only result rows get here."""
    return pd.Series([None if pd.isna(a) else math.erfc(abs(a) / math.sqrt(2)) for a in z], dtype="float64")


def kruskal_wallis(df: DataFrame, by: list[str], group: str, value: str, any_df: bool = True) -> DataFrame:
    """(by, groups, n, h, df, p): tie-corrected H; null where fewer than two groups or all values are tied."""
    return _kruskal(rank_groups(df, by, group, value), by, group, any_df)


def _kruskal(g: DataFrame, by: list[str], group: str, any_df: bool = True) -> DataFrame:
    # summed in the groups' order: h is what is left of two numbers as large as n, and another order changes its last digits
    terms = F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), (F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("t"))))
    k = g.groupBy(*by).agg(F.count("*").alias("groups"), F.max("total").alias("n"), F.max("tie_sum").alias("ties"), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x["t"]).alias("s"))
    n = F.col("n").cast("double")
    c = 1 - F.col("ties") / (n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / c
    k = k.withColumn("h", F.when((F.col("groups") >= 2) & (c > 0), h)).withColumn("df", (F.col("groups") - 1).cast("long"))
    p = chi2_sf("h", F.col("df").cast("double")) if any_df else chi2_sf_even(F.col("h"), F.col("df"))
    return k.select(*by, "groups", "n", "h", "df", p.alias("p"))


def dunn(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, group_a, group_b, z): pairwise differences of mean ranks over their tie-corrected deviation, a < b."""
    return _dunn(rank_groups(df, by, group, value), by, group)


def _dunn(g: DataFrame, by: list[str], group: str) -> DataFrame:
    g = g.withColumn("mean", F.col("rank_sum") / F.col("n"))
    a = g.select(*by, F.col(group).alias("group_a"), F.col("n").alias("na"), F.col("mean").alias("ma"), "total", "tie_sum")
    b = g.select(*by, F.col(group).alias("group_b"), F.col("n").alias("nb"), F.col("mean").alias("mb"))
    n = F.col("total").cast("double")
    var = n * (n + 1) / 12 - F.col("tie_sum") / (12 * (n - 1))
    pairs = a.join(b, by).where("group_a < group_b")
    z = (F.col("ma") - F.col("mb")) / F.sqrt(var * (1 / F.col("na") + 1 / F.col("nb")))
    return pairs.select(*by, "group_a", "group_b", F.when(var > 0, z).alias("z"))


def holm(tests: DataFrame, family: list[str], p: str = "p", order: list[str] = ()) -> DataFrame:
    """tests with p_holm: step-down adjusted within a family."""
    w = Window.partitionBy(*family).orderBy(p, *order)
    raw = F.least(F.lit(1.0), F.col(p) * (F.count(p).over(Window.partitionBy(*family)) - F.row_number().over(w) + 1))
    return tests.withColumn("_a", raw).withColumn("p_holm", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")


def gated(posthoc: DataFrame, tests: DataFrame, keys: list[str], alpha: float = SIGNIFICANT) -> DataFrame:
    """Post-hoc rows whose overall test is significant."""
    return posthoc.join(tests.where(F.col("p") < alpha).select(*keys), keys, "left_semi")


def chi_square(df: DataFrame, by: list[str], row: str, column: str) -> DataFrame:
    """(by, chi2, df, n) of the independence of two categorical columns; empty cells count with their expectation."""
    return _chi_square(df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*by, row, column).agg(F.count("*").alias("o")), by, row, column)


def _chi_square(c: DataFrame, by: list[str], row: str, column: str) -> DataFrame:
    c = c.withColumn("r", F.sum("o").over(Window.partitionBy(*by, row))).withColumn("k", F.sum("o").over(Window.partitionBy(*by, column)))
    c = c.withColumn("n", F.sum("o").over(Window.partitionBy(*by)))
    # sum (o - e)^2 / e = sum o^2 / e - n, and empty cells add nothing to the first sum
    e = F.col("r") * F.col("k") / F.col("n")
    out = c.groupBy(*by).agg(
        (F.sum(F.col("o") * F.col("o") / e) - F.max("n")).alias("chi2"),
        ((F.countDistinct(row) - 1) * (F.countDistinct(column) - 1)).alias("df"), F.max("n").alias("n"),
    )
    return out


#: Tables that one step of the exact test weighs.
STEP = 1 << 16


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of the table (a, b), (c, d): what all tables with its margins weigh that are no likelier than it.

    Weights are relative to the likeliest table; each follows from the one before, outwards until they are 0 as doubles.
    So the work grows with the root of the counts, and no table of any weight is left out.
    """
    n1, n2, m = a + b, c + d, a + c
    lo, hi = max(0, m - n2), min(n1, m)
    mode = min(hi, max(lo, (n1 + 1) * (m + 1) // (n1 + n2 + 2)))

    def walk(steps, ratio):
        out, last = [], 1.0
        for at in range(0, steps, STEP):
            out.append(last * np.cumprod(ratio(np.arange(at, min(steps, at + STEP), dtype=np.float64))))
            last = out[-1][-1]
            if last == 0:
                break
        return np.concatenate(out) if out else np.zeros(0)

    up = walk(hi - mode, lambda k: (n1 - mode - k) * (m - mode - k) / ((mode + k + 1) * (n2 - m + mode + k + 1)))
    down = walk(mode - lo, lambda k: (mode - k) * (n2 - m + mode - k) / ((n1 - mode + k + 1) * (m - mode + k + 1)))
    weight = np.concatenate([down[::-1], [1.0], up])
    prob = weight / weight.sum()
    at = a - (mode - len(down))
    seen = prob[at] if 0 <= at < len(prob) else 0.0
    return min(1.0, float(prob[prob <= seen + 1e-12].sum()))


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact p; only result rows get here."""
    return pd.Series([None if any(map(pd.isna, t)) else _fisher(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype="float64")


def fisher_pairs(counts: DataFrame, by: list[str], group: str) -> DataFrame:
    """(by, group_a, group_b, odds_ratio, p): two-sided exact test for each pair of groups of (valid, invalid) counts."""
    a = counts.select(*by, F.col(group).alias("group_a"), F.col("valid").alias("a"), F.col("invalid").alias("b"))
    b = counts.select(*by, F.col(group).alias("group_b"), F.col("valid").alias("c"), F.col("invalid").alias("d"))
    joined = a.join(b, by) if by else a.join(b, F.col("group_a") < F.col("group_b"))
    pairs = joined.where("group_a < group_b")
    bc = F.col("b") * F.col("c")
    odds = F.when(bc == 0, F.when(F.col("a") * F.col("d") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.col("a") * F.col("d") / bc)
    return pairs.select(*by, "group_a", "group_b", odds.alias("odds_ratio"), fisher_two_sided("a", "b", "c", "d").alias("p"))


#: Degrees of freedom up to which the battery states a p-value.
MOST_DF = 3


def battery(rows: DataFrame, by: list[str], group: str, syntax: str, strict: str, count: str) -> DataFrame:
    """Every test of how a group (a method) matters, for each value of by (a model) at once: (by, metric, test, group_a, group_b,
    statistic, df, p, p_adjusted, significant).

    Syntax validity over all rows, structural validity and the violation count over the syntax-valid ones: chi-squared and
    pairwise exact tests of both flags, Kruskal-Wallis of the count, and Dunn's pairs of it with Holm's adjustment within
    by. All of them read one histogram, made in one pass. An overall test of more than MOST_DF degrees of freedom has
    no p; counts that are all tied have a statistic of 0.
    """
    value = lambda name, x: F.struct(F.lit(name).alias("metric"), x.cast("long").alias("value"))
    seen = F.array(value("syntax validity", F.col(syntax)), F.when(F.col(syntax), value("structural validity", F.col(strict))), F.when(F.col(syntax), value("violation count", F.col(count))))
    # counted before the metrics multiply the rows
    rows = rows.where(F.col(group).isNotNull()).groupBy(*by, group, syntax, strict, count).agg(F.count("*").alias("_o"))
    x = rows.select(*by, group, "_o", F.explode(F.array_compact(seen)).alias("x")).select(*by, group, "_o", "x.*").where("value is not null")
    h = x.groupBy(*by, "metric", group, "value").agg(F.sum("_o").alias("o"))
    keys, is_flag = [*by, "metric"], F.col("metric") != "violation count"
    null = lambda kind: F.lit(None).cast(kind)

    def overall(df, test, statistic):
        p = F.when(F.col("df").between(1, MOST_DF), chi2_sf(statistic, F.col("df").cast("double")))
        return df.select(*keys, F.lit(test).alias("test"), null("string").alias("group_a"), null("string").alias("group_b"), statistic.alias("statistic"), F.col("df").cast("long").alias("df"), p.alias("p"), null("double").alias("p_adjusted"))

    groups = h.where(is_flag).groupBy(*keys).agg((F.countDistinct(group) - 1).alias("df"))
    chi = overall(_chi_square(h.where(is_flag), keys, group, "value").drop("df").join(groups, keys), "chi-squared", F.col("chi2"))
    ranked = _rank_groups(h.where(~is_flag).withColumnRenamed("o", "_n"), keys, group, "value")
    kw = overall(_kruskal(ranked, keys, group), "Kruskal-Wallis", F.coalesce("h", F.lit(0.0)))
    counts = h.where(is_flag).groupBy(*keys, group).agg(F.sum(F.when(F.col("value") == 1, F.col("o")).otherwise(0)).alias("valid"), F.sum(F.when(F.col("value") == 0, F.col("o")).otherwise(0)).alias("invalid"))
    fisher = fisher_pairs(counts, keys, group).select(*keys, F.lit("exact pair").alias("test"), "group_a", "group_b", F.col("odds_ratio").alias("statistic"), null("long").alias("df"), "p", null("double").alias("p_adjusted"))
    pairs = _dunn(ranked, keys, group).withColumn("p", normal_two_sided("z"))
    posthoc = holm(pairs, keys, order=["group_a", "group_b"]).select(*keys, F.lit("Dunn pair").alias("test"), "group_a", "group_b", F.col("z").alias("statistic"), null("long").alias("df"), "p", F.col("p_holm").alias("p_adjusted"))
    every = chi.unionByName(kw).unionByName(fisher).unionByName(posthoc)
    return every.withColumn("significant", F.coalesce("p_adjusted", "p") < SIGNIFICANT)


def p_text(p: Column) -> Column:
    """A p-value as text: <1e-8 below that, else eight decimals without trailing zeros."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", p), "0+$", ""), r"\.$", "")
    return F.when(p.isNull(), "").when(p < 1e-8, "<1e-8").otherwise(plain)


def significance(p: Column, alpha: float = SIGNIFICANT) -> Column:
    return F.when(p.isNull(), "").when(p < alpha, "significant").otherwise("not significant")
