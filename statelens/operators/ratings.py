"""Human ratings: descriptives, closest rater pairs and agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelens.functions import text as T


def as_score(x: str):
    """int(float(x)) of a text, null where that fails."""
    return F.col(x).try_cast("double").try_cast("int")


def long_form(ratings: DataFrame, keys: list[str], criteria: list[str]) -> DataFrame:
    """(keys, criterion, score), missing scores dropped."""
    return ratings.select(*keys, *criteria).unpivot(keys, criteria, "criterion", "score").where("score is not null")


def descriptives(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median, mean, q1, q3, iqr, score_1_count .. score_5_count), quartiles exact with linear interpolation."""
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = scores.groupBy(*keys).agg(F.count("*").alias("n"), q.alias("q"), F.avg("score").alias("mean"), *[F.count_if(F.col("score") == s).alias(f"score_{s}_count") for s in range(1, 6)])
    return g.select(*keys, "n", F.col("q")[1].alias("median"), "mean", F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), *[f"score_{s}_count" for s in range(1, 6)])


def distribution(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, count, n, percent) with a row for each score of 1 to 5."""
    wide = scores.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("score") == s).alias(str(s)) for s in range(1, 6)])
    out = wide.unpivot([*keys, "n"], ["1", "2", "3", "4", "5"], "score", "count")
    return out.select(*keys, F.col("score").cast("int").alias("score"), "count", "n", T.ratio(100.0 * F.col("count"), "n").alias("percent"))


def closest_pairs(ratings: DataFrame, item: str, rater: str, criteria: list[str]) -> DataFrame:
    """(item, rater_a, rater_b, <criterion>_a, <criterion>_b ...): the two raters of each item that differ least.

    Order: mean absolute difference, difference of the means, greatest difference, then the raters. Rows that
    lack any score are left out. Raters of one item are few (they are paired within the item).
    """
    ok = ratings.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in criteria])).select(item, rater, *criteria)
    a = ok.select(item, F.col(rater).alias("rater_a"), *[F.col(c).alias(f"{c}_a") for c in criteria])
    b = ok.select(item, F.col(rater).alias("rater_b"), *[F.col(c).alias(f"{c}_b") for c in criteria])
    pairs = a.join(b, item).where("rater_a < rater_b")
    diffs = [F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in criteria]
    total = sum(diffs[1:], diffs[0])
    signed = [F.col(f"{c}_a") - F.col(f"{c}_b") for c in criteria]
    overall = F.abs(sum(signed[1:], signed[0]))
    best = F.row_number().over(Window.partitionBy(item).orderBy(total, overall, F.greatest(*diffs), "rater_a", "rater_b"))
    return pairs.withColumn("_r", best).where("_r = 1").drop("_r")


def pair_scores(pairs: DataFrame, item: str, criteria: list[str]) -> DataFrame:
    """(item, criterion, a, b) from closest_pairs."""
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b")) for c in criteria])).alias("x")
    return pairs.select(item, both).select(item, "x.*")


def disagreement(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean_a, mean_b, mean_abs_diff, share_2) of paired scores, and the pooled and paired effect sizes."""
    d = F.abs(F.col("a") - F.col("b"))
    g = scores.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("mean_abs_diff"),
        F.avg((d >= 2).cast("double")).alias("share_2"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"),
        F.avg(F.col("a") - F.col("b")).alias("md"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd"),
    )
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    g = g.withColumn("cohens_d", F.when(pooled == 0, 0.0).otherwise((F.col("mean_a") - F.col("mean_b")) / pooled))
    g = g.withColumn("d_z", F.when(F.col("sd") == 0, 0.0).otherwise(F.col("md") / F.col("sd")))
    return g.drop("va", "vb", "md", "sd")


def kappa(scores: DataFrame, keys: list[str], weights: str = "quadratic", categories: int = 5) -> DataFrame:
    """(keys, kappa): 1 - observed / expected weighted disagreement; both come from the table of score pairs."""
    far = F.abs(F.col("a") - F.col("b")) / (categories - 1)
    w = {"none": (F.col("a") != F.col("b")).cast("double"), "linear": far, "quadratic": far * far}[weights]
    n = scores.groupBy(*keys, "a", "b").agg(F.count("*").alias("_n"))
    observed = n.groupBy(*keys).agg((F.sum(w * F.col("_n")) / F.sum("_n")).alias("o"))
    ma, mb = n.groupBy(*keys, "a").agg(F.sum("_n").alias("ca")), n.groupBy(*keys, "b").agg(F.sum("_n").alias("cb"))
    expected = ma.join(mb, keys).groupBy(*keys).agg((F.sum(w * F.col("ca") * F.col("cb")) / F.sum(F.col("ca") * F.col("cb"))).alias("e"))
    return observed.join(expected, keys).select(*keys, F.when(F.col("e") == 0, 1.0).otherwise(1 - F.col("o") / F.col("e")).alias("kappa"))


def case_prefix(number):
    """``case_07_`` for a case number 7, "7" or "7.0"; null for what is no number."""
    return F.format_string("case_%02d_", number.cast("string").try_cast("double").try_cast("long"))


def with_case(ratings: DataFrame, cases: DataFrame, number: str = "case_number") -> DataFrame:
    """ratings with the case_id and complexity of the only case whose id starts with the number's prefix; others are left out."""
    c = cases.withColumn("_n", F.regexp_extract("case_id", "^(case_[0-9]+_)", 1)).where("_n <> ''")
    c = c.withColumn("_c", F.count("*").over(Window.partitionBy("_n"))).where("_c = 1").drop("_c")
    r = ratings.withColumn("_p", case_prefix(F.col(number))).where(F.col(number).cast("string").try_cast("double").isNotNull())
    return r.join(c, F.col("_p") == F.col("_n")).drop("_n", "_p")


# Names of methods in rating sheets that stand for others, and what a repaired diagram's name tells.
METHOD_NAMES = {
    "rag examples only": "RAG [examples only]", "rag example only": "RAG [examples only]", "rag plantuml/rules only": "RAG [rules only]", "rag rules only": "RAG [rules only]", "rag theory only": "RAG [theory only]",
    "rag state-rules/theory only": "RAG [theory only]",
}
REPAIRED_NAMES = (("rag_repair", "RAG + Repair"), ("few_shot_repair", "Few-shot + Repair"))


def method_name(method, diagram_name):
    """A rated method by one name: sheets' names mapped, repairs told apart by the diagram's name."""
    raw = F.trim(F.coalesce(method, F.lit("")))
    low = F.lower(F.coalesce(diagram_name, F.lit("")))
    repaired = raw
    for mark, name in reversed(REPAIRED_NAMES):
        repaired = F.when(F.contains(low, F.lit(mark)), name).otherwise(repaired)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in METHOD_NAMES.items() for x in kv]), F.lower(raw))
    return F.when(raw == "Repair", repaired).otherwise(F.coalesce(known, raw))


def rated_cases(sources: dict[str, DataFrame], cases: DataFrame, criteria: list[str]) -> DataFrame:
    """(source, case_id, complexity, model, method, diagram_name, criterion, score) of all sources' ratings of known cases.

    A source: case_number, model, method, diagram_name and the criteria. cases: case_id, complexity.
    """
    every = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias("source"), "case_number", F.trim("model").alias("model"), method_name(F.col("method"), F.col("diagram_name")).alias("method"), "diagram_name", *[F.col(c).cast("string").try_cast("double").alias(c) for c in criteria])
        every = one if every is None else every.unionByName(one)
    return long_form(with_case(every, cases), ["source", "case_id", "complexity", "model", "method", "diagram_name"], criteria)


def overall(scores: DataFrame) -> DataFrame:
    """Paired scores with a copy of every row under the criterion ``overall``."""
    return scores.unionByName(scores.withColumn("criterion", F.lit("overall")))
