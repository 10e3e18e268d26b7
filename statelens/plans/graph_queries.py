"""Queries over event graphs: rules, validation, scores and summaries (groups C, D, E)."""

from __future__ import annotations

import difflib

from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.operators import graph as G
from statelens.operators import scoring as S
from statelens.plans import bindings as B

METRICS = ("semantic_transition_f1", "semantic_transition_mean_similarity", "overall_semantic_f1", "weighted_semantic_f1", "transition_hallucination_rate", "relaxed_state_hallucination_rate", "relaxed_transition_hallucination_rate", "missing_relaxed_transition_rate", "state_f1", "transition_f1", "relaxed_state_f1", "relaxed_transition_f1", "overall_f1", "overall_relaxed_f1", "weighted_relaxed_f1", "state_hallucination_rate", "missing_transition_rate")


def _ruled(spark, sf):
    return G.rules(B.graph_rows(spark, sf))


def _pred_gold(spark, sf):
    el = B.event_graphs(spark, sf)
    return B.of_runs(el, "run_index > 0"), B.of_runs(el, "run_index = 0")


def _paired(spark, sf, name):
    """Predicted rows of an element table, and the gold rows under the prediction's diagram_id."""
    pred, gold = _pred_gold(spark, sf)
    ids = pred.diagrams.join(gold.diagrams.select("case_id", F.col("diagram_id").alias("gold_id")), "case_id").select("diagram_id", "gold_id")
    g = getattr(gold, name).withColumnRenamed("diagram_id", "gold_id").join(ids, "gold_id").drop("gold_id")
    return getattr(pred, name).join(ids.select("diagram_id"), "diagram_id", "left_semi"), g


def c1_violations(spark, sf):
    return G.violations(_ruled(spark, sf))


def c3_duplicate_transitions(spark, sf):
    return _ruled(spark, sf).where("n_dup > 0").select("diagram_id", F.col("n_dup").cast("long").alias("n_dup"))


def c4_degrees(spark, sf):
    el = B.event_graphs(spark, sf)
    one = lambda df, s, i, o: df.select("diagram_id", F.col(s).alias("state"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    rows = one(el.initials, "target", 1, 0).union(one(el.finals, "state", 0, 1)).union(one(el.transitions, "dst", 1, 0)).union(one(el.transitions, "src", 0, 1))
    return rows.groupBy("diagram_id", "state").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def c5_unreachable_states(spark, sf):
    """Reachability from the run's third state on, so that some states are out of reach."""
    el = B.event_graphs(spark, sf)
    third = B.steps(spark, sf).where("line_no = 3").select("diagram_id", "line_no", F.col("state").alias("target"))
    g = G.rules(G.graphs(G.Elements(el.diagrams, el.states, el.transitions, third, el.finals)))
    return g.select("diagram_id", F.explode("unreachable").alias("state"))


def c11_validation(spark, sf):
    return G.validation(_ruled(spark, sf)).select("diagram_id", "warning_count", "initial_state", "duplicate_transition_count", F.size("unreachable_states").cast("long").alias("n_unreachable"), "state_count", "transition_count", "strict_valid", "score")


def c12_violation_kinds(spark, sf):
    return G.countable(c1_violations(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("diagram_id").alias("diagrams"))


def d2_state_prf(spark, sf):
    return S.set_prf(*_paired(spark, sf, "states"), ["diagram_id"], ["state"])


def d3_transition_prf(spark, sf):
    return S.set_prf(*_paired(spark, sf, "transitions"), ["diagram_id"], ["src", "event", "dst"])


def d4_relaxed_state_prf(spark, sf):
    p, g = _paired(spark, sf, "states")
    return S.set_prf(S.relaxed_states(p), S.relaxed_states(g), ["diagram_id"], ["state"])


def d5_relaxed_transition_prf(spark, sf):
    p, g = _paired(spark, sf, "transitions")
    return S.set_prf(S.relaxed_transitions(p), S.relaxed_transitions(g), ["diagram_id"], ["src", "dst"])


def d6_event_tokens(spark, sf):
    el = B.event_graphs(spark, sf)
    return el.transitions.select("event").distinct().select("event", F.array_join(T.event_tokens("event"), " ").alias("tokens"))


def d7_event_similarity(spark, sf):
    """Every two events of different transitions between equal ends: no pair is formed without a key."""
    t = B.event_graphs(spark, sf).transitions.select("src", "dst", "event").distinct()
    pairs = t.withColumnRenamed("event", "a").join(t.withColumnRenamed("event", "b"), ["src", "dst"]).where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(S.event_similarity("a", "b"), 9).alias("similarity"))


def d8_semantic_prf(spark, sf):
    p, g = _paired(spark, sf, "transitions")
    out = S.semantic_prf(p, g, ["diagram_id"])
    return out.select("diagram_id", "n_pred", "n_gold", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "mean_similarity")])


def _metrics(spark, sf):
    g = B.graph_rows(spark, sf)
    return S.score_runs(g.where("run_index > 0"), g.where("run_index = 0"))


def d13_score_runs(spark, sf):
    return _metrics(spark, sf).select("diagram_id", "case_id", "run_index", "complexity", *[F.round(c, 9).alias(c) for c in METRICS])


def _syntax(spark, sf):
    return B.graph_rows(spark, sf).select("diagram_id", (F.col("case_id") % 5 != 0).alias("syntax_valid"))


def e1_summary_by_config(spark, sf):
    """All means, and the rates of diagrams whose syntax passed (all but every fifth case) and that are without issues too."""
    v = G.validation(_ruled(spark, sf), _syntax(spark, sf)).select("diagram_id", F.col("syntax_valid"), "strict_valid")
    return S.summarise(_metrics(spark, sf).join(v, "diagram_id"), ["run_index"], list(METRICS), ("syntax_valid", "strict_valid"))


def e2_summary_by_complexity(spark, sf):
    return S.summarise_sets(_metrics(spark, sf), [["run_index"], ["run_index", "complexity"]], list(METRICS[8:12]))


def e3_case_stability(spark, sf):
    return S.stability(_metrics(spark, sf), ["case_id"], ["overall_f1", "overall_relaxed_f1"])


def e4_config_stability(spark, sf):
    m = _metrics(spark, sf).withColumn("config", F.col("run_index") % 2)
    return S.config_stability(m, ["config"], ["case_id"], ["overall_f1", "overall_relaxed_f1"])


def e5_metric_table(spark, sf):
    m = e1_summary_by_config(spark, sf).withColumn("run_id", F.concat(F.lit("run_"), F.col("run_index").cast("string")))
    return S.metric_table(m, ["run_id", "n", "mean_state_f1", "relaxed_percent"], {"relaxed_percent": "mean_relaxed_state_f1"}, "run_", None, "mean_state_f1", True, 3)


def e6_complexity_map(spark, sf):
    return _metrics(spark, sf).groupBy("case_id").agg(F.min_by("complexity", "run_index").alias("complexity"))


PAIRED = f"""{B.VG},
ids as (select p.diagram_id, q.diagram_id as gold_id, p.case_id, p.run_index from diagrams p join diagrams q on p.case_id = q.case_id and q.run_index = 0 where p.run_index > 0)"""


def _prf(cols, src, expr):
    names = ", ".join(cols)
    exprs = ", ".join(f"{e} as {c}" for e, c in zip(expr, cols, strict=True))
    return f"""select diagram_id, sum(p) as n_pred, sum(g) as n_gold, sum(p * g) as tp from (
  select diagram_id, {names}, max(p) as p, max(g) as g from (
    select i.diagram_id, {exprs}, 1 as p, 0 as g from {src} t join ids i on t.diagram_id = i.diagram_id
    union all select i.diagram_id, {exprs}, 0 as p, 1 as g from {src} t join ids i on t.diagram_id = i.gold_id) group by all) group by diagram_id"""


def _with(inner):
    return f"""select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from (
select diagram_id, cast(n_pred as bigint) as n_pred, cast(n_gold as bigint) as n_gold, cast(tp as bigint) as tp, cast(n_pred - tp as bigint) as fp, cast(n_gold - tp as bigint) as fn,
case when n_pred = 0 then 0.0 else tp / n_pred end as precision, case when n_gold = 0 then 0.0 else tp / n_gold end as recall from ({inner}))"""


_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
PRF = {
    "state": _with(_prf(["state"], "states", ["t.state"])),
    "transition": _with(_prf(["src", "event", "dst"], "transitions", ["t.src", "t.event", "t.dst"])),
    "relaxed_state": _with(_prf(["state"], "states", [_KEY.format("t.state")])),
    "relaxed_transition": _with(_prf(["src", "dst"], "transitions", [_KEY.format("t.src"), _KEY.format("t.dst")])),
}
_LABELS = [f"{e} k{i}" for e in ("click", "error", "purchase", "signup", "view") for i in range(4)]


def _sim(a: str, b: str) -> float:
    """The similarity of two labels, from first principles."""
    x, y = (sorted({T.EVENT_SYNONYMS.get(w, w) for w in e.split()}) for e in (a, b))
    j = len({*x} & {*y}) / len({*x} | {*y})
    return 0.7 * j + 0.3 * difflib.SequenceMatcher(None, " ".join(x), " ".join(y)).ratio()


_SIMS = ", ".join(f"('{a}', '{b}', {_sim(a, b)!r}::double)" for a in _LABELS for b in _LABELS)
#: Greedy one-to-one matches of each predicted run: walks its candidates in order and keeps those whose ends are both free.
MATCHED = f"""sims as (select * from (values {_SIMS}) v(pe, ge, sim)),
pt as (select *, row_number() over (partition by diagram_id order by s, d, pe) as po from (select distinct i.diagram_id, t.src as s, t.dst as d, {_KEY.format("t.src")} as src, {_KEY.format("t.dst")} as dst, event as pe from transitions t join ids i on t.diagram_id = i.diagram_id)),
gt as (select *, row_number() over (partition by diagram_id order by s, d, ge) as go from (select distinct i.diagram_id, t.src as s, t.dst as d, {_KEY.format("t.src")} as src, {_KEY.format("t.dst")} as dst, event as ge from transitions t join ids i on t.diagram_id = i.gold_id)),
cand as (select pt.diagram_id, po, go, sim, row_number() over (partition by pt.diagram_id order by sim desc, po, go) as rn from pt join gt on pt.diagram_id = gt.diagram_id and pt.src = gt.src and pt.dst = gt.dst join sims on sims.pe = pt.pe and sims.ge = gt.ge where sim >= 0.55),
walk as (select diagram_id, 0::bigint as rn, []::bigint[] as ps, []::bigint[] as gs, 0::bigint as tp, 0.0::double as sims from ids
  union all select w.diagram_id, c.rn, case when free then list_append(ps, po) else ps end, case when free then list_append(gs, go) else gs end, tp + case when free then 1 else 0 end, w.sims + case when free then sim else 0 end
  from walk w join (select * from cand) c on c.diagram_id = w.diagram_id and c.rn = w.rn + 1, lateral (select not list_contains(w.ps, c.po) and not list_contains(w.gs, c.go) as free)),
sm as (select diagram_id, max(tp) as tp, max(sims) as sims from walk group by 1),
sn as (select diagram_id, (select count(*) from pt where pt.diagram_id = ids.diagram_id) as n_pred, (select count(*) from gt where gt.diagram_id = ids.diagram_id) as n_gold from ids),
se as (select diagram_id, n_pred, n_gold, tp, case when n_pred = 0 then 0.0 else tp / n_pred end as precision, case when n_gold = 0 then 0.0 else tp / n_gold end as recall, case when tp = 0 then 0.0 else sims / tp end as mean_similarity from sn join sm using (diagram_id)),
sf as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from se)"""
_Z = lambda t, c: f"coalesce({t}.{c}, 0)"
SCORED = f"""with recursive {PAIRED}, {MATCHED},
s as ({PRF["state"]}), t as ({PRF["transition"]}), rs as ({PRF["relaxed_state"]}), rt as ({PRF["relaxed_transition"]}),
m as (select i.diagram_id, i.case_id, i.run_index, case when {_Z("s", "n_gold")} <= 6 then 'simple' when {_Z("s", "n_gold")} <= 14 then 'medium' else 'complex' end as complexity,
  {_Z("s", "f1")} as state_f1, {_Z("t", "f1")} as transition_f1, {_Z("rs", "f1")} as relaxed_state_f1, {_Z("rt", "f1")} as relaxed_transition_f1,
  ({_Z("s", "f1")} + {_Z("t", "f1")}) / 2 as overall_f1, ({_Z("rs", "f1")} + {_Z("rt", "f1")}) / 2 as overall_relaxed_f1,
  cast(0.7 as double) * {_Z("rs", "f1")} + cast(0.3 as double) * {_Z("rt", "f1")} as weighted_relaxed_f1,
  case when {_Z("s", "n_pred")} = 0 then 0.0 else s.fp / s.n_pred end as state_hallucination_rate,
  case when {_Z("t", "n_gold")} = 0 then 0.0 else t.fn / t.n_gold end as missing_transition_rate,
  case when {_Z("t", "n_pred")} = 0 then 0.0 else t.fp / t.n_pred end as transition_hallucination_rate, case when {_Z("rs", "n_pred")} = 0 then 0.0 else rs.fp / rs.n_pred end as relaxed_state_hallucination_rate,
  case when {_Z("rt", "n_pred")} = 0 then 0.0 else rt.fp / rt.n_pred end as relaxed_transition_hallucination_rate, case when {_Z("rt", "n_gold")} = 0 then 0.0 else rt.fn / rt.n_gold end as missing_relaxed_transition_rate,
  sf.f1 as semantic_transition_f1, sf.mean_similarity as semantic_transition_mean_similarity, ({_Z("rs", "f1")} + sf.f1) / 2 as overall_semantic_f1, cast(0.7 as double) * {_Z("rs", "f1")} + cast(0.3 as double) * sf.f1 as weighted_semantic_f1
  from ids i join sf using (diagram_id) left join s using (diagram_id) left join t using (diagram_id) left join rs using (diagram_id) left join rt using (diagram_id))
"""
_means = lambda cols: ", ".join(f"avg({c}) as mean_{c}" for c in cols)
DEG = f"""with {B.VG}, deg as (select diagram_id, state, cast(sum(i) as bigint) as n_in, cast(sum(o) as bigint) as n_out from (
select diagram_id, target as state, 1 as i, 0 as o from initials union all select diagram_id, state, 0, 1 from finals
union all select diagram_id, dst, 1, 0 from transitions union all select diagram_id, src, 0, 1 from transitions) group by 1, 2)"""
#: Issues as a validator lists them, one for each broken node; a group of the list, then states by name, then the node's rules.
_RULES = f"""{DEG},
dup as (select diagram_id, count(*) - count(distinct (src, event, dst)) as n from transitions group by 1),
iss as (select diagram_id, 4 as g, '' as st, 0 as k, 'duplicate_transitions' as kind, 'duplicate_transitions_detected (' || n || ')' as issue from dup where n > 0
union all select diagram_id, 7, state, 1, 'invalid_choice_node', 'choice_node_without_outgoing_transitions (' || state || ')' from states s where stereo = 'choice' and not exists (select 1 from transitions t where t.diagram_id = s.diagram_id and t.src = s.state)
union all select diagram_id, 7, state, 2, 'invalid_choice_guards', 'choice_node_without_guarded_outgoing_transitions (' || state || ')' from states s where stereo = 'choice' and exists (select 1 from transitions t where t.diagram_id = s.diagram_id and t.src = s.state and not starts_with(trim(t.event), '['))
union all select diagram_id, 7, state, 3, 'invalid_fork_node', 'fork_without_multiple_outgoing_branches (' || state || ')' from states join deg using (diagram_id, state) where stereo = 'fork' and n_out < 2
union all select diagram_id, 7, state, 4, 'invalid_join_node', 'join_without_multiple_incoming_branches (' || state || ')' from states join deg using (diagram_id, state) where stereo = 'join' and n_in < 2
union all select diagram_id, 8, '', 0, 'invalid_history_state', 'history_state_used_without_composite_state' from states group by 1 having bool_or(state = 'view_3') and not bool_or(state = 'signup_3')),
viol as (select diagram_id, row_number() over (partition by diagram_id order by g, st, k) as pos, kind, issue from iss)"""
QUERIES = {f.__name__: f for f in (c1_violations, c3_duplicate_transitions, c4_degrees, c5_unreachable_states, c11_validation, c12_violation_kinds, d2_state_prf, d3_transition_prf, d4_relaxed_state_prf, d5_relaxed_transition_prf, d6_event_tokens, d7_event_similarity, d8_semantic_prf, d13_score_runs, e1_summary_by_config, e2_summary_by_complexity, e3_case_stability, e4_config_stability, e5_metric_table, e6_complexity_map)}
ORACLES = {
    "c1_violations": f"{_RULES} select * from viol",
    "c3_duplicate_transitions": f"{_RULES} select diagram_id, cast(n as bigint) as n_dup from dup where n > 0",
    "c4_degrees": f"{DEG} select * from deg",
    "c5_unreachable_states": f"""with recursive {B.VG}, start as (select diagram_id, state from o where line_no = 3),
seen as (select diagram_id, state from start union select t.diagram_id, t.dst from transitions t join seen on t.diagram_id = seen.diagram_id and t.src = seen.state)
select diagram_id, state from states where diagram_id in (select diagram_id from start) and (diagram_id, state) not in (select diagram_id, state from seen)""",
    "c11_validation": f"""{_RULES}, w as (select diagram_id, count(*) as n from viol group by 1)
select d.diagram_id, cast(coalesce(w.n, 0) as bigint) as warning_count, i.target as initial_state, cast(coalesce(dup.n, 0) as bigint) as duplicate_transition_count, cast(0 as bigint) as n_unreachable,
(select count(*) from states s where s.diagram_id = d.diagram_id) as state_count, (select count(distinct (src, event, dst)) from transitions t where t.diagram_id = d.diagram_id) as transition_count,
coalesce(w.n, 0) = 0 as strict_valid, cast(coalesce(w.n, 0) as bigint) as score from diagrams d left join w using (diagram_id) left join dup using (diagram_id) left join initials i using (diagram_id)""",
    "c12_violation_kinds": f"{_RULES} select kind, count(*) as n, count(distinct diagram_id) as diagrams from viol group by kind",
    "d2_state_prf": f"with {PAIRED} {PRF['state']}",
    "d3_transition_prf": f"with {PAIRED} {PRF['transition']}",
    "d4_relaxed_state_prf": f"with {PAIRED} {PRF['relaxed_state']}",
    "d5_relaxed_transition_prf": f"with {PAIRED} {PRF['relaxed_transition']}",
    "d7_event_similarity": f"""with {B.VG}, t as (select distinct src, dst, event from transitions), sims as (select * from (values {_SIMS}) v(a, b, sim))
select distinct a, b, round(sim, 9) as similarity from (select x.event as a, y.event as b from t x join t y on x.src = y.src and x.dst = y.dst and x.event < y.event) join sims using (a, b)""",
    "d8_semantic_prf": f"with recursive {PAIRED}, {MATCHED} select diagram_id, n_pred, n_gold, tp, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, round(mean_similarity, 9) as mean_similarity from sf where n_pred + n_gold > 0",
    "d6_event_tokens": f"""with {B.VG}, ev as (select distinct event from transitions)
select event, array_to_string(list_sort(list_transform(string_split(event, ' '), lambda x: case x when 'error' then 'fail' when 'purchase' then 'payment' when 'view' then 'access' else x end)), ' ') as tokens from ev""",
    "d13_score_runs": f"{SCORED} select diagram_id, case_id, run_index, complexity, {', '.join(f'round({c}, 9) as {c}' for c in METRICS)} from m",
    "e1_summary_by_config": f"""{SCORED}, {_RULES.split(B.VG, 1)[1].lstrip(", ")}, bad as (select distinct diagram_id from viol)
select run_index, count(*) as n, {_means(METRICS)}, count(*) filter (case_id % 5 <> 0) / count(*) as syntax_valid_rate, count(*) filter (case_id % 5 <> 0 and bad.diagram_id is null) / count(*) as strict_valid_rate from m left join bad on bad.diagram_id = m.diagram_id group by 1""",
    "e2_summary_by_complexity": f"{SCORED} select run_index, complexity, count(*) as n, {_means(METRICS[8:12])} from m group by grouping sets ((run_index), (run_index, complexity))",
    "e3_case_stability": f"{SCORED} select case_id, count(*) as runs, stddev_pop(overall_f1) as std_overall_f1, stddev_pop(overall_relaxed_f1) as std_overall_relaxed_f1 from m group by 1",
    "e4_config_stability": f"""{SCORED}, per as (select run_index % 2 as config, case_id, stddev_pop(overall_f1) as a, stddev_pop(overall_relaxed_f1) as b from m group by 1, 2)
select m.*, s.mean_std_overall_f1, s.mean_std_overall_relaxed_f1 from (select run_index % 2 as config, count(*) as n, {_means(["overall_f1", "overall_relaxed_f1"])} from m group by 1) m
join (select config, avg(a) as mean_std_overall_f1, avg(b) as mean_std_overall_relaxed_f1 from per group by 1) s using (config)""",
    "e5_metric_table": f"{SCORED} select 'run_' || cast(run_index as varchar) as run_id, count(*) as n, avg(state_f1) as mean_state_f1, 100 * avg(relaxed_state_f1) as relaxed_percent from m group by 1 order by 3 desc limit 3",
    "e6_complexity_map": f"{SCORED} select case_id, min_by(complexity, run_index) as complexity from m group by 1",
}
