"""Scores of predicted graphs against gold graphs, and summaries of the scores."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from statelens.functions import text as T


#: Least similarity of two events that are matched.
LEAST_SIMILAR = 0.55


def set_prf(pred: DataFrame, gold: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """by columns with n_pred, n_gold, tp, fp, fn, precision, recall and f1 of the distinct keys; zero where a denominator is.

    One shuffle: rows are dealt by ``by``, which also clusters (by, keys).
    """
    both = pred.select(*by, *keys, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*by, *keys, F.lit(0).alias("p"), F.lit(1).alias("g")))
    each = both.repartition(*by).groupBy(*by, *keys).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    n = each.groupBy(*by).agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(F.col("p") * F.col("g")).alias("tp"))
    n = n.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gold") - F.col("tp"))
    return with_prf(n)


def with_prf(n: DataFrame) -> DataFrame:
    """n (n_pred, n_gold, tp) with precision, recall and f1."""
    n = n.withColumn("precision", T.ratio("tp", "n_pred")).withColumn("recall", T.ratio("tp", "n_gold"))
    return n.withColumn("f1", T.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def relaxed_states(states: DataFrame) -> DataFrame:
    """states with state as its relaxed key, empty keys dropped."""
    return states.withColumn("state", T.state_key("state")).where("state <> ''")


def relaxed_transitions(transitions: DataFrame) -> DataFrame:
    """transitions with src and dst as relaxed keys (empty ones kept)."""
    return transitions.withColumn("src", T.state_key("src")).withColumn("dst", T.state_key("dst"))


@lru_cache(1 << 16)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-blocks ratio of two strings; a worker computes it once for each pair of strings that it remembers."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(ArrayType(DoubleType()))
def sequence_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same for two arrays of strings, place by place."""
    return pd.Series([[_ratio(x, y) for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)])


def _similarity(ta, tb, ratio):
    j = T.jaccard(ta, tb)
    full = j if ratio is None else 0.7 * j + 0.3 * ratio
    return F.when((F.size(ta) == 0) & (F.size(tb) == 0), F.lit(1.0)).when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.7)).otherwise(full)


def event_similarity(a, b, sequence: bool = True):
    """1 where both events have no tokens, 0.7 where one has none, else 0.7 Jaccard + 0.3 sequence ratio (or Jaccard alone)."""
    ta, tb = T.event_tokens(a), T.event_tokens(b)
    return _similarity(ta, tb, sequence_ratio(F.array_join(ta, " "), F.array_join(tb, " ")) if sequence else None)


def _semantic(edges):
    """A graph's distinct transitions by source, target and event, with relaxed ends and event tokens."""
    one = lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.coalesce(e["event"], F.lit("")).alias("event"))
    more = lambda e: F.struct(T.state_key(e["src"]).alias("src"), T.state_key(e["dst"]).alias("dst"), F.array_join(T.event_tokens(e["event"]), " ").alias("said"))
    return F.transform(F.array_sort(F.array_distinct(F.transform(edges, one))), more)


def _once(df: DataFrame, columns: dict) -> DataFrame:
    """df with columns that are computed once for each row, however often they are used."""
    rest = df.columns
    return df.select(*rest, F.explode(F.array(F.struct(*[x.alias(c) for c, x in columns.items()]))).alias("_once")).select(*rest, "_once.*")


def with_matches(df: DataFrame, pred: str, gold: str, threshold: float = LEAST_SIMILAR, sequence: bool = True) -> DataFrame:
    """df with tp and sims: how many transitions of two graphs match one to one, and the sum of their similarities.

    pred and gold are columns of ``_semantic``. Transitions of equal relaxed ends are candidates; they are taken by falling
    similarity, then in the order of the predicted and of the gold ones, whose places are free. A graph's candidates stay in
    its row: nothing is shuffled, and Python compares each two texts of events once.
    """
    same = lambda x: F.filter(F.transform(gold, lambda g, i: F.struct(g.alias("g"), i.alias("go"))), lambda y: (y["g"]["src"] == x["src"]) & (y["g"]["dst"] == x["dst"]))
    cands = F.flatten(F.transform(pred, lambda x, i: F.transform(same(x), lambda y: F.struct(i.alias("po"), y["go"].alias("go"), x["said"].alias("a"), y["g"]["said"].alias("b")))))
    df = _once(df, {"_c": cands})
    said = lambda x: F.filter(F.split(x, " "), lambda t: t != "")
    if sequence:
        df = df.withColumn("_r", sequence_ratios(F.transform("_c", lambda c: c["a"]), F.transform("_c", lambda c: c["b"])))
        scored = F.zip_with("_c", "_r", lambda c, r: F.struct((-_similarity(said(c["a"]), said(c["b"]), r)).alias("neg"), c["po"].alias("po"), c["go"].alias("go")))
    else:
        scored = F.transform("_c", lambda c: F.struct((-_similarity(said(c["a"]), said(c["b"]), None)).alias("neg"), c["po"].alias("po"), c["go"].alias("go")))
    start = F.struct(F.array().cast("array<int>").alias("ps"), F.array().cast("array<int>").alias("gs"), F.lit(0).cast("long").alias("tp"), F.lit(0.0).alias("sims"))

    def take(acc, x):
        free = ~F.array_contains(acc["ps"], x["po"]) & ~F.array_contains(acc["gs"], x["go"])
        return F.when(free, F.struct(F.array_append(acc["ps"], x["po"]).alias("ps"), F.array_append(acc["gs"], x["go"]).alias("gs"), (acc["tp"] + 1).alias("tp"), (acc["sims"] - x["neg"]).alias("sims"))).otherwise(acc)

    done = F.aggregate(F.array_sort(F.filter(scored, lambda x: -x["neg"] >= threshold)), start, take)
    rest = [c for c in df.columns if c not in ("_c", "_r")]
    return df.select(*rest, F.explode(F.array(done)).alias("_m")).select(*rest, "_m.tp", "_m.sims")


def semantic_prf(pred: DataFrame, gold: DataFrame, by: list[str], sequence: bool = True) -> DataFrame:
    """by columns with n_pred, n_gold, tp, precision, recall, f1 and mean similarity of greedily matched transitions.

    pred and gold: by columns, src, event, dst as they are written; both sides of a graph meet in one group.
    """
    edge = F.struct("src", "event", "dst")
    none = F.lit(None).cast("struct<src:string,event:string,dst:string>")
    both = pred.select(*by, edge.alias("p"), none.alias("g")).union(gold.select(*by, none, edge))
    g = _once(both.groupBy(*by).agg(F.collect_set("p").alias("p"), F.collect_set("g").alias("g")), {"_p": _semantic("p"), "_g": _semantic("g")})
    out = with_matches(g, "_p", "_g", sequence=sequence).withColumns({"n_pred": F.size("_p").cast("long"), "n_gold": F.size("_g").cast("long")})
    return with_prf(out.drop("p", "g", "_p", "_g")).withColumn("mean_similarity", T.ratio("sims", "tp"))


def complexity(n):
    """simple up to 6 states, medium up to 14, else complex."""
    return F.when(n <= 6, "simple").when(n <= 14, "medium").otherwise("complex")


def score_runs(pred: DataFrame, gold: DataFrame, sequence: bool = True) -> DataFrame:
    """All scores of each predicted graph whose case has a gold graph.

    pred (diagram_id, case_id, run_index, states, edges) and gold (case_id, states, edges; one row for each case) are graph
    rows: after the join by case every score is an expression on the row. The semantic one compares the events of
    transitions with equal ends, and matches each once, in descending similarity.
    """
    ends = lambda e: (T.state_key(e["src"]).alias("src"), T.state_key(e["dst"]).alias("dst"))
    sem = "semantic_transition"

    def sets(tag):
        """The graph's distinct states, transitions, relaxed states, relaxed transitions, and transitions to be matched."""
        return {
            f"{tag}_state": F.array_distinct(F.transform("states", lambda s: s["state"])), f"{tag}_transition": F.array_distinct("edges"),
            f"{tag}_relaxed_state": F.array_distinct(F.filter(F.transform("states", lambda s: T.state_key(s["state"])), lambda k: k != "")),
            f"{tag}_relaxed_transition": F.array_distinct(F.transform("edges", lambda e: F.struct(*ends(e)))), f"{tag}_{sem}": _semantic("edges"),
        }

    p = _once(pred.select("diagram_id", "case_id", "run_index", "states", "edges"), sets("p")).drop("states", "edges")
    out = p.join(_once(gold.select("case_id", "states", "edges"), sets("g")).drop("states", "edges"), "case_id")
    c, tags = F.col, ("state", "transition", "relaxed_state", "relaxed_transition")
    for t in (*tags, sem):
        out = out.withColumns({f"{t}_n_pred": F.size(f"p_{t}"), f"{t}_n_gold": F.size(f"g_{t}")})
    out = out.withColumns({f"{t}_tp": F.size(F.array_intersect(f"p_{t}", f"g_{t}")) for t in tags})
    out = with_matches(out, f"p_{sem}", f"g_{sem}", sequence=sequence).withColumnRenamed("tp", f"{sem}_tp").drop(*[f"{x}_{t}" for x in "pg" for t in (*tags, sem)])
    for t in (*tags, sem):
        out = out.withColumns({f"{t}_fp": c(f"{t}_n_pred") - c(f"{t}_tp"), f"{t}_fn": c(f"{t}_n_gold") - c(f"{t}_tp"), f"{t}_precision": T.ratio(f"{t}_tp", f"{t}_n_pred"), f"{t}_recall": T.ratio(f"{t}_tp", f"{t}_n_gold")})
        out = out.withColumn(f"{t}_f1", T.ratio(2 * c(f"{t}_precision") * c(f"{t}_recall"), c(f"{t}_precision") + c(f"{t}_recall"))).withColumn(f"{t}_hallucination_rate", T.ratio(f"{t}_fp", f"{t}_n_pred"))
        if "transition" in t:
            out = out.withColumn(f"missing_{t}_rate", T.ratio(f"{t}_fn", f"{t}_n_gold"))
    return (
        out.withColumn(f"{sem}_mean_similarity", T.ratio("sims", f"{sem}_tp")).drop("sims")
        .withColumn("overall_f1", (c("state_f1") + c("transition_f1")) / 2)
        .withColumn("overall_relaxed_f1", (c("relaxed_state_f1") + c("relaxed_transition_f1")) / 2)
        .withColumn("overall_semantic_f1", (c("relaxed_state_f1") + c("semantic_transition_f1")) / 2)
        .withColumn("weighted_relaxed_f1", 0.7 * c("relaxed_state_f1") + 0.3 * c("relaxed_transition_f1"))
        .withColumn("weighted_semantic_f1", 0.7 * c("relaxed_state_f1") + 0.3 * c("semantic_transition_f1"))
        .withColumn("complexity", complexity(c("state_n_gold")))
    )


def summarise(metrics: DataFrame, keys: list[str], columns: list[str], flags: tuple = ()) -> DataFrame:
    """Row count, means of the columns (a missing value counts as 0) and rates of the flags for each of the keys' values."""
    rates = [(F.count_if(F.col(c)) / F.count("*")).alias(f"{c}_rate") for c in flags]
    return metrics.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(c, F.lit(0.0))).alias(f"mean_{c}") for c in columns], *rates)


def summarise_sets(metrics: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """The same over several grouping sets in one pass."""
    every = list(dict.fromkeys(k for s in sets for k in s))
    return metrics.groupingSets([[F.col(k) for k in s] for s in sets], *every).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def stability(metrics: DataFrame, case_keys: list[str], columns: list[str]) -> DataFrame:
    """Population deviation of the columns over the repeated runs of a case (0 for one run) and the number of runs."""
    return metrics.groupBy(*case_keys).agg(F.count("*").alias("runs"), *[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"std_{c}") for c in columns])


def config_stability(metrics: DataFrame, config: list[str], case: list[str], columns: list[str]) -> DataFrame:
    """Summary by config joined to the mean over its cases of their deviations."""
    per = stability(metrics, config + case, columns)
    means = per.groupBy(*config).agg(*[F.avg(f"std_{c}").alias(f"mean_std_{c}") for c in columns])
    return summarise(metrics, config, columns).join(means, config)


def metric_table(rows: DataFrame, select: list[str], percent: dict[str, str], family: str | None, ids: list[str] | None, sort: str, descending: bool, limit: int | None) -> DataFrame:
    """Rows with percentages of ratios added, filtered by a substring of run_id or a list, sorted with the missing last
    ascending and first descending, and cut to the limit.
    """
    for name, source in percent.items():
        rows = rows.withColumn(name, 100 * F.col(source))
    if family:
        rows = rows.where(F.contains("run_id", F.lit(family)))
    if ids:
        rows = rows.where(F.col("run_id").isin(*ids))
    key = F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()
    rows = rows.orderBy(key, *[F.col(c) for c in select if c != sort])
    return (rows.limit(limit) if limit else rows).select(*select)
