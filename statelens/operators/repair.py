"""What repair attempts change: graph differences, violation deltas, acceptance and remaining populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.operators.graph import counted
from statelens.operators.validity import median_cell, percent_cell, wide


def paired_stages(diagrams: DataFrame, meta: DataFrame | None = None, kind: str = "repair") -> DataFrame:
    """(run_id, case_id, run_index, initial_id, final_id) of runs with a first and a final diagram, and with metadata if that is given.

    Of runs whose id names ``kind``, repair runs if nothing else is said; of all runs if it is empty. diagrams: diagram_id, run_id,
    case_id, run_index, stage. Both ends come from one pass: a run's stages meet in one group.
    """
    run = ["run_id", "case_id", "run_index"]
    at = lambda stage: F.max(F.when(F.col("stage") == stage, F.col("diagram_id")))
    named = diagrams.where(F.contains("run_id", F.lit(kind))) if kind else diagrams
    pairs = named.where(F.col("stage").isin("initial", "final")).groupBy(*run).agg(at("initial").alias("initial_id"), at("final").alias("final_id"))
    pairs = pairs.where("initial_id is not null and final_id is not null")
    return pairs if meta is None else pairs.join(meta.select(*run), run, "left_semi")


def review_manifest(detail: DataFrame, most: int, root: str = "review") -> DataFrame:
    """detail's rows of up to ``most`` attempted repairs, with the case's number and the folder they are reviewed in.

    detail: model, method, case_id, attempted, ...
    """
    slug = F.btrim(F.regexp_replace(F.lower("model"), "[^a-z0-9]+", "_"), F.lit("_"))
    rows = detail.where(F.col("attempted").between(0, most))
    return rows.withColumn("case_number", F.regexp_extract("case_id", "([0-9]+)", 1)).withColumn("review_folder", F.concat_ws("/", F.lit(root), slug, F.concat(F.lit("iteration_"), F.col("attempted").cast("string")), "case_id"))


def graph_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts of added and deleted states, transitions and edges, of relabelled edges, and their total, from graph rows."""
    a = before.select(key, F.transform("states", lambda s: s["state"]).alias("s0"), F.col("edges").alias("e0"))
    b = after.select(key, F.transform("states", lambda s: s["state"]).alias("s1"), F.col("edges").alias("e1"))
    j = a.join(b, key)
    pairs = lambda c: F.array_distinct(F.transform(c, lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"))))
    labels = lambda c, p: F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda e: (e["src"] == p["src"]) & (e["dst"] == p["dst"])), lambda e: e["event"])))
    gone = lambda x, y: F.size(F.array_except(x, y)).cast("long")
    j = j.withColumn("p0", pairs("e0")).withColumn("p1", pairs("e1"))
    changed = F.size(F.filter(F.array_intersect("p0", "p1"), lambda p: labels("e0", p) != labels("e1", p))).cast("long")
    out = j.select(
        key, gone("s1", "s0").alias("added_states"), gone("s0", "s1").alias("deleted_states"), gone("e1", "e0").alias("added_transitions"), gone("e0", "e1").alias("deleted_transitions"),
        gone("p1", "p0").alias("added_edges"), gone("p0", "p1").alias("deleted_edges"), changed.alias("relabelled_edges"),
    )
    parts = [F.col(c) for c in ("added_states", "deleted_states", "added_edges", "deleted_edges", "relabelled_edges")]
    return out.withColumn("total_change", sum(parts[1:], parts[0]))


def violation_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Issue counts before and after, reduction, new and eliminated kinds, and improved, worsened or unchanged.

    Every issue counts, so that one broken node less of several is an improvement; lines that only list states don't.
    """
    kinds = lambda df, n: df.select(key, F.array_distinct(counted(F.col("violations"))).alias(f"k{n}"), F.size(counted(F.col("violations"))).cast("long").alias(f"n{n}"))
    j = kinds(before, 0).join(kinds(after, 1), key)
    status = F.when(F.col("n1") < F.col("n0"), "improved").when(F.col("n1") > F.col("n0"), "worsened").otherwise("unchanged")
    line = lambda c: F.array_join(F.array_sort(c), ",")
    return j.select(
        key, F.col("n0").alias("before"), F.col("n1").alias("after"), (F.col("n0") - F.col("n1")).alias("reduction"), T.ratio(100.0 * (F.col("n0") - F.col("n1")), "n0").alias("reduction_percent"),
        line(F.array_except("k1", "k0")).alias("new_kinds"), line(F.array_except("k0", "k1")).alias("eliminated_kinds"), status.alias("status"),
    )


def accepted(attempts: DataFrame, key: str, attempt: str, score: str) -> DataFrame:
    """attempts with ``accepted``: the first always, a later one iff its score is below every one before."""
    w = Window.partitionBy(key).orderBy(attempt).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(score).over(w)
    return attempts.withColumn("accepted", best.isNull() | (F.col(score) < best))


def iteration_counts(marked: DataFrame, key: str, attempt: str) -> DataFrame:
    """(key, attempted, repaired): greatest repair attempt, and the greatest accepted one or else the attempted."""
    g = marked.groupBy(key).agg(F.max(attempt).alias("attempted"), F.max(F.when(F.col("accepted") & (F.col(attempt) > 0), F.col(attempt))).alias("a"))
    return g.select(key, "attempted", F.coalesce("a", "attempted").alias("repaired"))


def recorded_iterations(attempts: DataFrame, repairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attempted, repaired) of the runs in repairs (keys, files): the greatest repair attempt on record, or where none is
    the number of repaired files; and the greatest accepted one, or else the attempted.
    """
    r = attempts.where("stage = 'repair'").groupBy(*keys).agg(F.max("attempt").alias("a"), F.max(F.when(F.col("accepted"), F.col("attempt"))).alias("b"))
    j = repairs.join(r, keys, "left").withColumn("attempted", F.coalesce("a", F.col("files").cast("int")))
    return j.select(*keys, "attempted", F.coalesce("b", "attempted").alias("repaired"))


def attempt_counts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, syntax_valid, strict_valid)."""
    return attempts.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("syntax_valid").alias("syntax_valid"), F.count_if("strict_valid").alias("strict_valid"))


def remaining(counts: DataFrame, keys: list[str], attempt: str, total) -> DataFrame:
    """counts with the population still invalid before each attempt: the total less all valid ones before, 0 at least."""
    w = Window.partitionBy(*keys).orderBy(attempt).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), total - F.coalesce(F.sum("strict_valid").over(w), F.lit(0)))
    return counts.withColumn("denominator", left).withColumn("percent", T.ratio(100.0 * F.col("strict_valid"), left))


# What an iteration's columns are called.
ITERATIONS = ("Repair at zero iterations", "Repair at once", "Repair at two iterations", "Repair at three iterations", "Repair at four iterations", "Repair at five iterations")


def iteration_cells(attempts: DataFrame, repairs: DataFrame, ratings: DataFrame, criteria: list[str]) -> DataFrame:
    """(evaluation_group, metric, iteration, model, cell): validity and ratings of each iteration and model, as text.

    attempts: model, attempt, syntax_valid, strict_valid, of all recorded attempts. repairs: model, case_number, attempted,
    syntax_valid, strict_valid, of all final diagrams. ratings: model, case_number and the criteria, of repaired diagrams.
    What an iteration is measured against is what was left before it: all first answers less the final diagrams that are
    valid after fewer attempts. Syntax is counted on the attempts, in the last iteration on the final diagrams. Ratings
    count where a valid final diagram of their model and case took as many attempts. Models with a valid one have rows.
    """
    last = len(ITERATIONS) - 1
    models = repairs.where("strict_valid").select("model").distinct()
    grid = models.select("model", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("iteration"))
    at = attempts.groupBy("model", F.col("attempt").cast("int").alias("iteration")).agg(F.count("*").alias("tried"), F.count_if("syntax_valid").alias("tried_syntax"))
    end = repairs.groupBy("model", F.col("attempted").cast("int").alias("iteration")).agg(F.count_if("syntax_valid").alias("syntax"), F.count_if("strict_valid").alias("strict"))
    t = grid.join(at, ["model", "iteration"], "left").join(end, ["model", "iteration"], "left").fillna(0)
    w = Window.partitionBy("model").orderBy("iteration")
    first = F.first("tried").over(w)
    left = F.greatest(F.lit(0), first - F.coalesce(F.sum("strict").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("left", left).withColumn("counted", F.when(F.col("iteration") == last, F.col("syntax")).otherwise(F.col("tried_syntax")))
    cell = lambda metric, n: F.struct(F.lit(metric).alias("metric"), percent_cell(n, F.col("left")).alias("cell"))
    auto = t.select(F.lit("Automatic (accuracy)").alias("evaluation_group"), "model", "iteration", F.explode(F.array(cell("Structural validity", F.col("strict")), cell("Syntactic validity", F.col("counted")))).alias("c"))
    auto = auto.select("evaluation_group", "c.metric", "iteration", "model", "c.cell")
    done = repairs.where("strict_valid").select("model", "case_number", F.col("attempted").cast("int").alias("iteration")).distinct()
    said = ratings.join(done, ["model", "case_number"]).select("model", "iteration", *criteria).unpivot(["model", "iteration"], criteria, "criterion", "score").where("score is not null")
    human = said.groupBy("criterion", "iteration", "model").agg(F.median("score").alias("m"), F.count("*").alias("n"))
    names = {c: c.replace("_", " ").capitalize() for c in criteria}
    every = grid.select("*", F.explode(F.array(*map(F.lit, criteria))).alias("criterion")).join(human, ["criterion", "iteration", "model"], "left")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("criterion"))
    return auto.union(every.select(F.lit("Human (Likert scale 1-5)"), label, "iteration", "model", median_cell(F.col("m"), F.col("n"))))


def iteration_table(cells: DataFrame, models: list[str], iterations: list[int]) -> DataFrame:
    """One row for each metric, a column for each iteration and model; blank where there is nothing."""
    column = F.concat_ws(" | ", F.element_at(F.array(*map(F.lit, ITERATIONS)), F.col("iteration") + 1), F.lower("model"))
    names = [f"{ITERATIONS[i]} | {m.lower()}" for i in iterations for m in models]
    return wide(cells.where(F.col("iteration").isin(*iterations)).withColumn("column", column), ["evaluation_group", "metric"], "column", "cell", names).fillna("", names)


def repair_summary(detail: DataFrame, keys: list[str], changes: list[str]) -> DataFrame:
    """What repairs did, for each value of keys: counts and rates in percent, recoveries out of the invalid first diagrams, mean
    and median issues and reductions, mean iterations and mean of each change column.

    detail: before, after, reduction, new_kinds, attempted, repaired, total_change and the change columns. A diagram is valid
    without issues; a repair that brings in a new kind is a regression, whatever else it mends.
    """
    bad, good = F.col("before") > 0, F.col("after") == 0
    n = {"initially_invalid": bad, "successful": good, "recovered": bad & good, "improved": F.col("after") < F.col("before"), "worsened": F.col("after") > F.col("before"), "regressed": F.col("new_kinds") != ""}
    g = detail.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in n.items()], *[F.avg(c).alias(f"mean_{c}") for c in ("before", "after", "reduction", "attempted", "repaired", *changes, "total_change")],
        F.median("reduction").alias("median_reduction"), F.median("total_change").alias("median_total_change"),
    )
    rate = lambda k, of: T.ratio(100.0 * F.col(k), of)
    return g.withColumns({f"{k}_percent": rate(k, "n") for k in ("successful", "improved", "worsened", "regressed")}).withColumn("recovered_percent", rate("recovered", "initially_invalid"))


def new_kind_distribution(detail: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, count, percent) of the kinds that a repair brought in, over the repairs of the keys."""
    total = detail.groupBy(*keys).agg(F.count("*").alias("total"))
    n = detail.where("new_kinds <> ''").select(*keys, F.explode(F.split("new_kinds", ",")).alias("kind")).groupBy(*keys, "kind").agg(F.count("*").alias("count"))
    return n.join(total, keys).select(*keys, "kind", "count", (100.0 * F.col("count") / F.col("total")).alias("percent"))
