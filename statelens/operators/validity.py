"""Validity rates, violation counts and their distributions by any keys, and the shaping of report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.functions.small import times


def pass_rates(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(keys, total, valid, invalid, percent) of a boolean flag."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("valid"))
    return g.withColumn("invalid", F.col("total") - F.col("valid")).withColumn("percent", T.ratio(100.0 * F.col("valid"), "total"))


def pass_rates_with_total(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """pass_rates by one key, with a TOTAL row."""
    g = rows.rollup(key).agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("valid"), F.grouping(key).alias("_t"))
    return g.select(F.when(F.col("_t") == 1, "TOTAL").otherwise(F.col(key)).alias(key), "total", "valid")


def dense_rates(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """pass_rates over the full grid of the keys' values, zero rows included; the grid is small, rows are aggregated first."""
    rates = pass_rates(rows, keys, flag)
    grid = rates.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = times(grid, rates.select(k).distinct())
    return grid.join(rates, keys, "left").fillna(0)


def count_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, median, max, zeros) of a count."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"), F.count_if(F.col(value) == 0).alias("zeros"))


def kind_distribution(violations: DataFrame, population: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, count, total, percent): rows with the kind over all rows of the keys."""
    n = violations.groupBy(*keys, "kind").agg(F.count("*").alias("count"))
    total = population.groupBy(*keys).agg(F.count("*").alias("total"))
    return n.join(total, keys).withColumn("percent", 100.0 * F.col("count") / F.col("total"))


# The system types that are reported, and the beginnings of methods that belong to an ablation.
SYSTEM_TYPES = ("embedded_system", "software_system")
ABLATIONS = ("RAG [", "RAG + Validation [", "RAG + Repair [")


def without_ablations(rows: DataFrame) -> DataFrame:
    return rows.where(~reduce(lambda a, b: a | b, [F.col("method").startswith(x) for x in ABLATIONS]))


def rates_by_system_type(rows: DataFrame, cases: DataFrame, flag: str) -> DataFrame:
    """(model, method, system_type, total, valid, invalid, percent) of the test cases of each system type, percent to two places.

    rows: model, method, case_id and the flag, ablations left out; cases: case_id, split, system_type. All models and methods
    of the rows come with every type, zero rows included; the grid is small, rows are aggregated first.
    """
    rows = without_ablations(rows)
    kinds = cases.where((F.col("split") == "test") & F.col("system_type").isin(*SYSTEM_TYPES)).groupBy("case_id").agg(F.max("system_type").alias("system_type"))
    n = rows.join(kinds, "case_id", "left").groupBy("model", "method", "system_type").agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("valid"))
    grid = times(n.select("model").distinct(), n.select("method").distinct()).select("*", F.explode(F.array(*map(F.lit, SYSTEM_TYPES))).alias("system_type"))
    full = grid.join(n, ["model", "method", "system_type"], "left").fillna(0, ["total", "valid"])
    return full.withColumn("invalid", F.col("total") - F.col("valid")).withColumn("percent", F.round(T.ratio(100.0 * F.col("valid"), "total"), 2))


def kind_deltas(kinds: DataFrame, population: DataFrame, keys: list[str], group: str, target: str, groups: list[str]) -> DataFrame:
    """The target group against each other listed group, for each value of keys and every kind that occurs anywhere: counts,
    totals, frequencies and their difference to two places, and what the target does to the kind.

    kinds: keys, group, kind, a row for each issue; population: keys, group, a row for each diagram. Without diagrams of the
    target or of the reference there are no rows. Issues are aggregated first; the grid is keys times groups times kinds.
    """
    listed_ = F.col(group).isin(*groups)
    n = kinds.where(listed_).groupBy(*keys, group, "kind").agg(F.count("*").alias("n"))
    total = population.where(listed_).groupBy(*keys, group).agg(F.count("*").alias("total"))
    full = times(total, n.select("kind").distinct()).join(n, [*keys, group, "kind"], "left").fillna(0, ["n"]).withColumn("share", F.round(T.ratio(100.0 * F.col("n"), "total"), 2))
    side = lambda name: [F.col("n").alias(f"{name}_count"), F.col("total").alias(f"{name}_total"), F.col("share").alias(f"{name}_percent")]
    a = full.where(F.col(group) == target).select(*keys, "kind", *side("target"))
    b = full.where(F.col(group) != target).select(*keys, "kind", F.col(group).alias("reference"), *side("reference"))
    out = a.join(b, [*keys, "kind"]).withColumn("delta", F.round(F.col("target_percent") - F.col("reference_percent"), 2))
    t, r, d = F.col("target_count"), F.col("reference_count"), F.col("delta")
    status = F.when((t == 0) & (r > 0), "eliminated_by_target").when((t > 0) & (r == 0), "introduced_by_target").when(d < 0, "mitigated_by_target").when(d > 0, "increased_by_target").otherwise("unchanged")
    return out.withColumn("status", status)


def top_kinds(distribution: DataFrame, n: int) -> DataFrame:
    """The n most frequent kinds over all groups, ties by name."""
    return distribution.groupBy("kind").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "kind").limit(n)


def cases_per_group(rows: DataFrame, keys: list[str], number: str, width: int = 1000) -> DataFrame:
    """(keys, part, n, cases): the case numbers of each group as lists in order, one list for each ``width`` numbers, so that
    no row grows with the group.
    """
    part = F.floor(F.col(number) / width)
    g = rows.groupBy(*keys, part.alias("part")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(number)).alias("c"))
    return g.select(*keys, "part", "n", F.array_join("c", ", ").alias("cases"))


def composition(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, change, mean, total): mean of each change column and the sum of the means within keys."""
    m = rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns]).unpivot(keys, columns, "change", "mean")
    return m.withColumn("total", F.sum("mean").over(Window.partitionBy(*keys)))


def wide(rows: DataFrame, index: list[str], column: str, cell: str, values: list) -> DataFrame:
    """One row for each index with a column of cells for each of the values."""
    return rows.groupBy(*index).pivot(column, values).agg(F.first(cell))


def long(rows: DataFrame, index: list[str], pattern: str = "|") -> DataFrame:
    """Columns named ``method | model`` back to rows, with percent, n and median parsed out of the cell."""
    cells = [c for c in rows.columns if pattern in c]
    out = rows.unpivot(index, cells, "method_model", "cell").where("cell is not null and cell <> ''")
    part = lambda p: F.regexp_extract("cell", p, 1).try_cast("double")
    return out.select(
        *index, F.split_part("method_model", F.lit(" | "), F.lit(1)).alias("method"), F.split_part("method_model", F.lit(" | "), F.lit(2)).alias("model"), "cell",
        part(r"^([0-9.]+)%").alias("percent"), part(r"n=([0-9]+)").alias("n"), part(r"^([0-9.]+) \(n=").alias("median"),
    )


def median_parts(cell):
    """(median, n) of a cell ``3.5 (n=12)`` or, with a spread in the brackets, ``3.5 (IQR 1), n=12``; nulls for a blank one and for
    any other form.
    """
    get = lambda i: F.regexp_extract(cell, r"^\s*([0-9]+(?:\.[0-9]+)?)\s+(?:\(n=([0-9]+)\)|\([^)]+\),\s*n=([0-9]+))\s*$", i)
    return F.struct(get(1).try_cast("double").alias("median"), F.coalesce(F.nullif(get(2), F.lit("")), get(3)).try_cast("long").alias("n"))


def percent_cell(valid, total):
    """``55.56% (n=15/27)``, blank for no rows."""
    return F.when(total == 0, "").otherwise(F.format_string("%.2f%% (n=%d/%d)", 100.0 * valid / total, valid, total))


def median_cell(median, n):
    """``3.5 (n=12)``, the number in its shortest form, blank for no scores."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", median.cast("double")), "0+$", ""), r"\.$", "")
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").otherwise(F.concat(short, F.format_string(" (n=%d)", n)))


def preferred(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows sorted by a fixed order of known labels, the others alphabetically behind."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return rows.orderBy(F.when(pos == 0, 1_000_000).otherwise(pos), column)
