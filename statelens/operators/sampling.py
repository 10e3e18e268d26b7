"""Seeded sampling and splitting that never sorts a whole stratum in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelens.functions.small import times

BUCKETS = 4096


def seeded(seed: int, *columns):
    """The hash that orders rows: md5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def ranked(df: DataFrame, strata: list[str], key, name: str = "rank") -> DataFrame:
    """df with the rank (from 1) of key, a hex hash, within the strata. Rows are ranked inside hash buckets; the
    counts of the buckets before (a small aggregate) give the rest.
    """
    d = df.withColumn("_k", key).withColumn("_b", F.conv(F.substring("_k", 1, 3), 16, 10).cast("int") % BUCKETS)
    n = d.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_k"))
    return d.withColumn("_i", inner).join(n, [*strata, "_b"]).withColumn(name, F.col("_before") + F.col("_i")).drop("_k", "_b", "_i", "_before")


def quota(n, fraction: float):
    """Rows of a stratum of n to take: the rounded share, one at least, and not all unless the share is all."""
    take = F.greatest(F.bround(n * F.lit(fraction)), F.lit(1.0))
    return F.when((F.lit(fraction) < 1) & (n > 1), F.least(take, n - 1)).otherwise(F.least(take, n)).cast("long")


def stratified_split(cases: DataFrame, key: str, stratum: str, fraction: float, seed: int) -> DataFrame:
    """cases with role ``test`` or ``pool``."""
    counts = cases.groupBy(stratum).agg(F.count("*").alias("_n")).withColumn("_take", quota(F.col("_n"), fraction))
    r = ranked(cases, [stratum], seeded(seed, key)).join(counts, stratum)
    return r.withColumn("role", F.when(F.col("rank") <= F.col("_take"), "test").otherwise("pool")).drop("rank", "_n", "_take")


def split_report(split: DataFrame, stratum: str) -> DataFrame:
    """(stratum, total, test, pool)."""
    return split.groupBy(stratum).agg(F.count("*").alias("total"), F.count_if(F.col("role") == "test").alias("test"), F.count_if(F.col("role") == "pool").alias("pool"))


def balanced_subset(cases: DataFrame, key: str, stratum: str, order: list[str], size: int, seed: int) -> DataFrame:
    """``size`` cases taken in rounds over the listed strata, in their order; cases of other strata are never taken. All cases,
    of whatever stratum, where there are no more than that; none for a size of 0.
    """
    if size <= 0:
        return cases.limit(0)
    if len(cases.limit(size + 1).select(key).collect()) <= size:  # size + 1 keys at most
        return cases
    r = ranked(cases.where(F.col(stratum).isin(*order)), [stratum], seeded(seed, key)).where(F.col("rank") <= size)
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(stratum))
    return r.withColumn("_s", at).orderBy("rank", "_s").limit(size).drop("rank", "_s")


def pick_examples(targets: DataFrame, pool: DataFrame, key: str, stratum: str, k: int, seed: int) -> DataFrame:
    """(target, example, position): k examples for each target, never itself: one of each stratum first, then from all.

    The pool is numbered by hash within strata and over all; a target's own hash says where it starts to read,
    so the examples come by equi-join instead of a comparison of all targets with all of the pool.
    """
    by_stratum = ranked(pool.select(F.col(key).alias("example"), stratum), [stratum], seeded(seed, "example"), "i")
    overall = ranked(pool.select(F.col(key).alias("example")).withColumn("_all", F.lit(1)), ["_all"], seeded(seed, "example"), "i").drop("_all")
    sizes = by_stratum.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(stratum)))
    start = F.conv(F.substring(seeded(seed, "target"), 1, 8), 16, 10).cast("long")
    t = targets.select(F.col(key).alias("target")).withColumn("start", start)
    wanted = times(t, sizes) if k > 1 else None  # one row for each stratum
    fill = times(t, pool.agg(F.count("*").alias("n"))).select("target", "start", "n", F.explode(F.sequence(F.lit(0), F.lit(2 * k))).alias("step"))
    fill = fill.withColumn("i", (F.col("start") + F.col("step")) % F.col("n") + 1).join(overall, "i").select("target", "example", (1000 + F.col("step")).alias("o"))
    out = fill
    if wanted is not None:
        first = wanted.select("target", "start", "n", stratum, "place", F.explode(F.array(F.lit(0), F.lit(1))).alias("step")).withColumn("i", (F.col("start") + F.col("step")) % F.col("n") + 1)
        out = first.join(by_stratum, [stratum, "i"]).select("target", "example", (F.col("step") * 500 + F.col("place")).alias("o"), stratum).where("target <> example")
        best = F.row_number().over(Window.partitionBy("target", stratum).orderBy("o"))
        out = out.withColumn("_r", best).where("_r = 1").select("target", "example", F.col("o") % 500).toDF("target", "example", "o").union(fill)
    out = out.where("target <> example").groupBy("target", "example").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("o", "example"))
    return out.withColumn("position", place).where(F.col("position") <= k).drop("o")


def leakage(test: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Keys that are in both, which must be none."""
    return test.select(key).intersect(pool.select(key))


def split_faults(listed: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """(key, fault) of a split's lists (key, role): ids that are listed both as test and as pool, and pool ids that no case has. A
    sound split has none; an id may have both faults.
    """
    test, pool = (listed.where(F.col("role") == r) for r in ("test", "pool"))
    both = leakage(test, pool, key).withColumn("fault", F.lit("in test and pool"))
    return both.union(missing(pool.distinct(), cases, key).withColumn("fault", F.lit("no such case")))


def case_range(cases: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Cases whose numeric prefix lies in a range."""
    return cases.where(F.regexp_extract(F.col(key).cast("string"), "([0-9]+)", 1).try_cast("long").between(low, high))


def missing(wanted: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Wanted keys that no case has."""
    return wanted.select(key).join(cases.select(key), key, "left_anti")
