"""Pooling candidate graphs of a case: votes, gold-free scores, consensus and diverse selection.

Works on the graph rows of ``graph.rules``: diagram_id, case_id, model, states, edges, inits, finals, ...
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.operators.elements import parse_graphs
from statelens.operators.graph import to_text
from statelens.operators.scoring import score_runs

# The weights of the final score and the penalties of the structural one.
WEIGHTS = {"structural": 0.35, "coverage": 0.30, "consensus": 0.20, "quality": 0.15}
KIND_PENALTIES = {"orphan_states": 0.08, "invalid_choice_node": 0.08, "invalid_choice_guards": 0.04, "invalid_fork_node": 0.04, "invalid_join_node": 0.04, "invalid_history_state": 0.04}


def eligible(pool: DataFrame, least: int, models: list | None = None) -> DataFrame:
    """Cases with enough candidates and, if asked for, all the required models."""
    g = pool.groupBy("case_id").agg(F.count("*").alias("n"), F.collect_set("model").alias("models"))
    g = g.where(F.col("n") >= least)
    for m in models or []:
        g = g.where(F.array_contains("models", m))
    return pool.join(g.select("case_id"), "case_id", "left_semi")


def votes(pool: DataFrame, threshold: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(votes, kept): (case_id, kind, a, b, c, votes) of states, transitions and finals, one vote for each candidate and
    element, and those with a majority (n // 2 + 1, or the threshold).
    """
    blank = F.lit("")
    item = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))
    items = F.concat(
        F.transform("states", lambda s: item("state", s["state"], blank, blank)),
        F.transform(F.array_distinct("edges"), lambda e: item("transition", e["src"], e["event"], e["dst"])),
        F.transform("finals", lambda s: item("final", s, blank, blank)),
    )
    n = pool.groupBy("case_id").agg(F.count("*").alias("n"))
    v = pool.select("case_id", F.explode(items).alias("i")).groupBy("case_id", "i.kind", "i.a", "i.b", "i.c").agg(F.count("*").alias("votes"))
    need = F.floor(F.col("n") / 2) + 1 if threshold is None else F.lit(threshold)
    return v, v.join(n, "case_id").where(F.col("votes") >= need).drop("n")


def plurality_initial(pool: DataFrame) -> DataFrame:
    """(case_id, initial, votes): the initial state with most votes, ties by name; ambiguous candidates have no vote."""
    v = pool.where("initial_state is not null").groupBy("case_id", F.col("initial_state").alias("initial")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy("case_id").orderBy(F.desc("votes"), "initial")
    return v.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def voted_states(kept: DataFrame, initial: DataFrame) -> DataFrame:
    """(case_id, state): voted states, the initial one and the ends of voted transitions."""
    k = lambda kind: kept.where(F.col("kind") == kind)
    s = k("state").select("case_id", F.col("a").alias("state")).union(initial.select("case_id", "initial"))
    return s.union(k("transition").select("case_id", "a")).union(k("transition").select("case_id", "c")).distinct()


def voted_finals(kept: DataFrame, states: DataFrame) -> DataFrame:
    return kept.where("kind = 'final'").select("case_id", F.col("a").alias("state")).join(states, ["case_id", "state"], "left_semi")


def voted_graphs(pool: DataFrame, threshold: int | None = None) -> DataFrame:
    """Graph rows (diagram_id, case_id, run_index, states, edges, inits, finals, errors) of the votes: one for each case of the
    pool, without elements where nothing has enough votes. The initial state and the ends of transitions are states, and
    final states must be. One more group by case reassembles the flat votes.
    """
    kept, initial = votes(pool, threshold)[1], plurality_initial(pool)
    none = F.lit("")
    rows = kept.select("case_id", "kind", "a", "b", "c").union(initial.select("case_id", F.lit("initial"), "initial", none, none)).union(pool.select("case_id", F.lit("case"), none, none, none).distinct())
    of = lambda kind, value: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, value)))
    edge = F.struct(F.col("a").alias("src"), F.col("b").alias("event"), F.col("c").alias("dst"))
    g = rows.groupBy("case_id").agg(of("state", F.col("a")).alias("named"), of("transition", edge).alias("edges"), of("initial", F.col("a")).alias("inits"), of("final", F.col("a")).alias("ends"))
    names = F.array_sort(F.array_distinct(F.concat("named", "inits", F.flatten(F.transform("edges", lambda e: F.array(e["src"], e["dst"]))))))
    state = lambda n: F.struct(n.alias("state"), F.lit(False).alias("is_explicit"), F.lit(False).alias("is_composite"), F.lit(False).alias("is_history"), F.array().cast("array<string>").alias("stereotypes"))
    return g.select(
        F.concat(F.lit("voted/"), F.col("case_id").cast("string")).alias("diagram_id"), "case_id", F.lit(1).cast("long").alias("run_index"), F.transform(names, state).alias("states"), "edges", "inits",
        F.array_intersect("ends", names).alias("finals"), F.array().cast("array<string>").alias("errors"),
    )


def ensemble_scores(pool: DataFrame, gold: DataFrame, threshold: int | None = None) -> DataFrame:
    """All scores of each case's voted diagram against its gold graph, with candidate_count and vote_threshold.

    The voted graph is written as a diagram and read again, as what is stored is the diagram: a state that no
    transition, start or end names isn't in it.
    """
    text = to_text(voted_graphs(pool, threshold)).withColumn("case_id", F.substring_index("diagram_id", "/", -1).cast(pool.schema["case_id"].dataType)).withColumn("run_index", F.lit(1).cast("long"))
    n = pool.groupBy("case_id").agg(F.count("*").alias("candidate_count"))
    need = F.floor(F.col("candidate_count") / 2) + 1 if threshold is None else F.lit(threshold)
    return score_runs(parse_graphs(text), gold).join(n.withColumn("vote_threshold", need.cast("long")), "case_id")


def vote_report(v: DataFrame, kind: str, n: int) -> DataFrame:
    """The n elements of a kind with most votes in each case, ties by name."""
    w = Window.partitionBy("case_id").orderBy(F.desc("votes"), "a", "b", "c")
    return v.where(F.col("kind") == kind).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _clamp(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def structural_score(syntax=None):
    """1 less the penalties of a graph row's rules, between 0 and 1; transitions are counted once each."""
    syntax = F.lit(True) if syntax is None else syntax
    n, m = F.size("states"), F.size(F.array_distinct("edges"))
    pen = lambda ok, p: F.when(ok, F.lit(p)).otherwise(0.0)
    kinds = F.transform("violations", lambda v: v["kind"])
    p = pen(~syntax, 0.5) + pen(F.col("initial_state").isNull(), 0.15) + pen(F.size("finals") == 0, 0.15) + pen(n == 0, 0.2) + pen(m == 0, 0.2)
    p = p + F.least(F.lit(0.25), 0.25 * F.size("unreachable") / F.greatest(n, F.lit(1))) + F.least(F.lit(0.10), 0.10 * F.col("n_dup") / F.greatest(m, F.lit(1)))
    for kind, x in KIND_PENALTIES.items():
        p = p + pen(F.array_contains(kinds, kind), x)
    return _clamp(1 - p)


def quality_score():
    """1 less the penalties for size, sparsity, density, missing labels and ends. Transitions are counted once each, but labels
    are missing out of all of them.
    """
    n, m = F.size("states").cast("double"), F.size(F.array_distinct("edges")).cast("double")
    pen = lambda ok, p: F.when(ok, p).otherwise(0.0)
    kinds = F.transform("violations", lambda v: v["kind"])
    need = F.greatest(n - 1, F.lit(1.0))
    unlabelled = F.size(F.filter("edges", lambda e: F.trim(F.coalesce(e["event"], F.lit(""))) == "")) / F.greatest(F.size("edges"), F.lit(1))
    p = F.when(n < 3, 0.25).when(n > 30, F.least(F.lit(0.25), (n - 30) / 80)).otherwise(0.0)
    p = p + F.when(m < need, F.least(F.lit(0.2), (need - m) / F.greatest(n, F.lit(5.0)) * 0.2)).when((n > 0) & (m > 3 * n), F.least(F.lit(0.15), (m - 3 * n) / 100)).otherwise(0.0)
    p = p + pen(unlabelled > 0.6, F.least(F.lit(0.15), (unlabelled - 0.6) * 0.3)) + pen(F.col("initial_state").isNull(), 0.1) + pen(F.size("finals") == 0, 0.1)
    p = p + pen(F.array_contains(kinds, "orphan_states"), 0.08) + pen(F.array_contains(kinds, "invalid_choice_node"), 0.08)
    return _clamp(1 - p)


def _key(x):
    return F.array_join(T.concepts(x), " ")


def similarity_keys(pool: DataFrame) -> DataFrame:
    """pool with the distinct state and transition keys of each candidate: their concept tokens."""
    s = F.array_distinct(F.filter(F.transform("states", lambda x: _key(x["state"])), lambda k: k != ""))
    t = F.filter(F.transform("edges", lambda e: F.struct(_key(e["src"]).alias("s"), _key(F.coalesce(e["event"], F.lit(""))).alias("e"), _key(e["dst"]).alias("d"))), lambda k: (k["s"] != "") & (k["d"] != ""))
    return pool.withColumn("sk", s).withColumn("tk", F.array_distinct(t))


def pairwise_similarity(pool: DataFrame) -> DataFrame:
    """(case_id, a, b, similarity) of two candidates of one case, a < b: 0.6 Jaccard of states + 0.4 of transitions."""
    k = similarity_keys(pool)
    a = k.select("case_id", F.col("diagram_id").alias("a"), F.col("sk").alias("sa"), F.col("tk").alias("ta"))
    b = k.select("case_id", F.col("diagram_id").alias("b"), F.col("sk").alias("sb"), F.col("tk").alias("tb"))
    return a.join(b, "case_id").where("a < b").select("case_id", "a", "b", (0.6 * T.jaccard("sa", "sb") + 0.4 * T.jaccard("ta", "tb")).alias("similarity"))


def consensus(pool: DataFrame) -> DataFrame:
    """(case_id, diagram_id, consensus): mean similarity to the other candidates, 1 for a single one."""
    p = pairwise_similarity(pool)
    both = p.select("case_id", F.col("a").alias("diagram_id"), "similarity").union(p.select("case_id", "b", "similarity"))
    m = both.groupBy("case_id", "diagram_id").agg(F.avg("similarity").alias("consensus"))
    return pool.select("case_id", "diagram_id").join(m, ["case_id", "diagram_id"], "left").fillna(1.0, ["consensus"])


def requirement_items(requirements: DataFrame) -> DataFrame:
    """(key, item, tokens) of requirement texts (key, text): numbered or bulleted lines that have tokens.

    Where there is none, the lines that are neither are joined by spaces and cut into sentences: a sentence may run over
    lines. Null and blank texts have no items.
    """
    pattern = r"^\s*(?:[0-9]+[).]|[-*])\s+(.*\S)\s*$"
    kept = lambda x: F.size(x["tokens"]) > 0
    told = lambda x: F.struct(x.alias("chunk"), T.concepts(x).alias("tokens"))
    lines = F.split("text", r"\r\n?|\n")
    listed = F.filter(F.transform(lines, lambda x: told(F.regexp_extract(x, pattern, 1))), kept)
    rest = F.array_join(F.filter(F.transform(F.filter(lines, lambda x: ~x.rlike(pattern)), lambda x: F.trim(F.regexp_replace(x, "\t", " "))), lambda x: x != ""), " ")
    chunks = F.filter(F.transform(F.split(rest, r"(?<=[.!?])\s+"), told), kept)
    r = requirements.select("key", F.explode(F.array(F.struct(listed.alias("listed"), chunks.alias("chunks")))).alias("x"))
    items = F.when(F.size("x.listed") > 0, F.col("x.listed")).otherwise(F.col("x.chunks"))
    return r.select("key", F.posexplode(items).alias("item", "i")).select("key", "item", "i.tokens")


def candidate_tokens(g: DataFrame):
    """Expression: the concept tokens of a graph row's states, ends, events and transitions."""
    said = F.concat(F.transform("states", lambda s: s["state"]), F.col("finals"), F.flatten(F.transform("edges", lambda e: F.array(e["src"], F.coalesce(e["event"], F.lit("")), e["dst"]))))
    return T.concepts(F.array_join(said, " "))


def coverage(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, items, covered, coverage) of each candidate (key, tokens). An item is covered by enough hits or a ratio of 0.35;
    without any item nothing is.
    """
    j = candidates.select("key", F.col("tokens").alias("have")).join(items, "key", "left")
    hits, n = F.size(F.array_intersect("tokens", "have")), F.size("tokens")
    j = j.withColumn("ratio", hits / n).withColumn("ok", (hits >= F.when(n <= 2, 1).otherwise(2)) | (hits / n >= 0.35))
    g = j.groupBy("key").agg(F.count("item").alias("items"), F.count_if("ok").alias("covered"), F.avg(F.least(F.lit(1.0), F.col("ratio") / 0.45)).alias("part"))
    return g.select("key", "items", "covered", F.when(F.col("items") == 0, 0.0).otherwise(_clamp(0.65 * F.col("covered") / F.col("items") + 0.35 * F.col("part"))).alias("coverage"))


def final_ranks(scored: DataFrame) -> DataFrame:
    """scored (case_id, diagram_id, structural, coverage, consensus, quality) with final and rank within the case."""
    f = sum(F.col(k) * w for k, w in WEIGHTS.items())
    # nine decimals decide: sums of the same parts in another order are ties
    w = Window.partitionBy("case_id").orderBy(*[F.round(c, 9).desc() for c in ("final", "coverage", "structural", "quality")], "diagram_id")
    return scored.withColumn("final", f).withColumn("rank", F.row_number().over(w))


def diverse(ranked: DataFrame, k: int) -> DataFrame:
    """(case_id, diagram_id, selection, adjusted): up to k rounds of final - 0.2 * greatest similarity to the chosen
    + 0.03 for a new model, texts never twice. ranked: case_id, diagram_id, model, text, final, rank, sk, tk.

    A case's candidates are few (one for each model, strategy and run), so a case is one group.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        sk = [frozenset(x) for x in pdf["sk"]]
        tk = [frozenset((t["s"], t["e"], t["d"]) for t in x) for x in pdf["tk"]]
        jac = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        left, chosen, seen, out = list(range(len(pdf))), [], set(), []
        rows = pdf[["diagram_id", "model", "text", "final"]].to_dict("records")
        while left and len(chosen) < k:
            best, top = None, float("-inf")
            for i in left:
                if rows[i]["text"] in seen:
                    continue
                score = rows[i]["final"]
                if chosen:
                    score -= 0.2 * max(0.6 * jac(sk[i], sk[j]) + 0.4 * jac(tk[i], tk[j]) for j in chosen)
                    score += 0.03 * (rows[i]["model"] not in {rows[j]["model"] for j in chosen})
                score = round(score, 9)  # sums in another order are ties, which the rank decides
                if score > top:
                    best, top = i, score
            if best is None:
                break
            left.remove(best)
            seen.add(rows[best]["text"])
            chosen.append(best)
            out.append((pdf["case_id"].iloc[0], rows[best]["diagram_id"], len(chosen), top))
        return pd.DataFrame(out, columns=["case_id", "diagram_id", "selection", "adjusted"])

    kind = ranked.schema["case_id"].dataType.simpleString()
    return ranked.groupBy("case_id").applyInPandas(choose, f"case_id {kind}, diagram_id string, selection int, adjusted double")


def legacy(pool: DataFrame, k: int) -> DataFrame:
    """The first k candidates with different texts by (syntax_valid, fewest errors, distinct transitions, states)."""
    order = [F.desc("syntax_valid"), F.asc("error_count"), F.desc("transition_count"), F.desc("state_count"), F.asc("diagram_id")]
    one = pool.withColumn("_t", F.row_number().over(Window.partitionBy("case_id", "text").orderBy(*order))).where("_t = 1").drop("_t")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where(F.col("rank") <= k)
