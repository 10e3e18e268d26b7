"""Further queries: manifests and gates, guidance, per-complexity tables, iteration tables, ensemble scores, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.operators import elements as E
from statelens.operators import ensemble as I
from statelens.operators import graph as G
from statelens.operators import prompts as H
from statelens.operators import ratings as M
from statelens.operators import repair as J
from statelens.operators import requirements as O
from statelens.operators import sampling as S
from statelens.operators import validity as K
from statelens.plans import bindings as B
from statelens.plans import graph_queries as GQ
from statelens.plans import rating_queries as RQ
from statelens.plans import sample_queries as SQ
from statelens.plans import text_queries as TQ
from statelens.sources import files as A


def a15_manifest(spark, sf):
    """The split of the users' cases, the run matrix and the settings of an experiment, as sections of a manifest."""
    d = B.graph_rows(spark, sf).where("run_index = 0").select("case_id", F.when(F.size("states") <= 6, "simple").when(F.size("states") <= 14, "medium").otherwise("complex").alias("complexity"))
    split = S.stratified_split(d, "case_id", "complexity", 0.35, 42)
    settings = {"runs_per_case": 1, "few_shot_count": 3, "rag_mode": "lexical", "rag_domain_hints": ["b", "a"]}
    return A.manifest(split, A.run_matrix(TQ._models(spark, sf), A.strategies(spark), "t"), settings, 40)


def c12_issue_kinds(spark, sf):
    """Issue texts made of event types and rule names, classified."""
    e = B.table(spark, sf, "events")
    names = F.array(*[F.lit(p.strip("^").replace("[0-9]+", "12")) for p, _ in G.ISSUE_KINDS], F.lit("Odd thing!"), F.lit(" "))
    issue = F.concat(F.element_at(names, (F.col("event_id") % 18 + 1).cast("int")), F.when(F.col("event_id") % 18 < 16, F.concat(F.lit(" "), F.col("event_type"))).otherwise(""))
    return G.countable(e.select(G.issue_kind(issue).alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


def c16_guidance(spark, sf):
    """Advice for parsed texts in its order: start, end, reach and broken nodes."""
    r = G.rules(E.parse_graphs(B.rich_texts(spark, sf)))
    return r.select("diagram_id", F.array_join(H.guidance(F.transform("violations", lambda v: v["issue"])), "\n").alias("advice"))


def _complex(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.when(F.col("n_chars") <= 800, "simple").when(F.col("n_chars") <= 2500, "medium").otherwise("complex").alias("complexity"))
    return B.validity(spark, sf).join(d, "case_id")


def k9_validity_by_complexity(spark, sf):
    return K.pass_rates(_complex(spark, sf).where("syntax_valid"), ["complexity", "method"], "strict_valid")


def k11_dense_by_complexity(spark, sf):
    return K.dense_rates(_complex(spark, sf), ["complexity", "method"], "syntax_valid")


def k13_run_summary(spark, sf):
    return K.pass_rates(B.validity(spark, sf).withColumn("run_id", F.concat_ws("__", "model", "method")), ["run_id"], "syntax_valid")


def k16_change_composition(spark, sf):
    d = SQ.j2_graph_diff(spark, sf).withColumn("model", F.col("case_id") % 4)
    return K.composition(d, ["model"], ["added_states", "deleted_states", "added_edges", "deleted_edges", "relabelled_edges"])


def _rated(spark, sf):
    """Ratings of known cases from two sheets: the main one, where method R is a repair of three kinds, and one of an ablation."""
    o = B.table(spark, sf, "orders")
    cases = o.select(F.concat(F.format_string("case_%02d_", "o_orderkey"), "o_orderstatus").alias("case_id"), F.when(F.col("o_totalprice") < 1e5, "simple").when(F.col("o_totalprice") < 3e5, "medium").otherwise("complex").alias("complexity"))
    r, k = B.ratings(spark, sf), F.col("item_id") % 3
    number = F.when(F.col("item_id") % 50 == 7, "none").otherwise(F.concat(F.col("item_id").cast("string"), F.when(F.col("item_id") % 2 == 0, ".0").otherwise("")))
    main = r.where("method <> 'N'").withColumns({"case_number": number, "method": F.when(F.col("method") == "R", "Repair").otherwise(" Few-shot "), "diagram_name": F.when(k == 0, "x_RAG_repair_1").when(k == 1, "few_shot_repair").otherwise("plain")})
    second = r.where("method = 'N'").withColumns({"case_number": number, "method": F.when(k == 0, "RAG rules only").when(k == 1, "rag state-rules/theory only").otherwise("RAG"), "diagram_name": F.lit(None).cast("string")})
    return M.rated_cases({"main": main, "ablation": second}, cases, RQ.C)


def m5_ratings_by_complexity(spark, sf):
    return _rated(spark, sf).groupBy("source", "complexity", "method", "criterion").agg(F.count("*").alias("responses"), F.countDistinct("case_id").alias("diagrams"), F.median("score").alias("median"))


def m11_overall_disagreement(spark, sf):
    s = M.overall(M.pair_scores(RQ._pairs(spark, sf), "item_id", RQ.C))
    return M.disagreement(s, ["criterion"]).select("criterion", "n", "mean_abs_diff", "share_2", "d_z")


def m13_quality_by_model(spark, sf):
    d = M.descriptives(RQ._scores(spark, sf).where("criterion = 'correctness'"), ["model"])
    return d.select(F.when(F.col("model") == "O", "Open").otherwise("Final").alias("label"), "n", "median", "q1", "q3")


def n2_table_variant(spark, sf):
    r = K.pass_rates(B.validity(spark, sf), ["model", "method"], "syntax_valid").withColumn("cell", K.percent_cell(F.col("valid"), F.col("total")))
    return K.wide(r.where(F.col("method").isin("de", "es")), ["model"], "method", "cell", ["de", "es"])


def n7_compact_table(spark, sf):
    auto = K.pass_rates(_complex(spark, sf), ["complexity"], "strict_valid").select("complexity", F.lit("strict validity").alias("metric"), F.round("percent", 6).alias("value"))
    human = m5_ratings_by_complexity(spark, sf).groupBy("complexity", F.col("criterion").alias("metric")).agg(F.round(F.avg("median"), 6).alias("value"))
    mean = human.groupBy("complexity").agg(F.round(F.avg("value"), 6).alias("value")).select("complexity", F.lit("human average").alias("metric"), "value")
    return K.wide(auto.union(human).union(mean), ["metric"], "complexity", "value", ["simple", "medium", "complex"])


def j9_iteration_table(spark, sf):
    """Users as cases, two models; an attempt is valid with few issues. Ratings of method R are those of repaired diagrams."""
    model = F.when(F.col("case_id") % 2 == 0, "F").otherwise("O")
    m = SQ._marked(spark, sf).withColumn("model", model).withColumn("syntax_valid", F.col("score") <= 3).withColumn("strict_valid", F.col("score") <= 2)
    it = J.iteration_counts(m, "case_id", "attempt")
    end = m.join(it, "case_id").where("attempt = repaired").select("model", F.col("case_id").cast("string").alias("case_number"), "attempted", "syntax_valid", "strict_valid")
    r = B.ratings(spark, sf).where("method = 'R'").withColumn("case_number", F.col("item_id").cast("string"))
    return J.iteration_table(J.iteration_cells(m, end, r, RQ.C), ["F", "O"], [0, 2, 3, 4, 5])


def i16_ensemble_scores(spark, sf):
    s = I.ensemble_scores(TQ._pool(spark, sf), B.graph_rows(spark, sf).where("run_index = 0"))
    return s.select("diagram_id", "case_id", "run_index", "candidate_count", "vote_threshold", "complexity", *[F.round(c, 9).alias(c) for c in GQ.METRICS])


def h1_requirement_fallback(spark, sf):
    c = B.table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("a"), F.min(F.when(F.col("role") == "user", F.col("text"))).alias("b"), F.min(F.when(F.col("role") == "assistant", F.col("text"))).alias("c"))
    return c.select("conv_id", H.requirement(F.when(F.col("conv_id") % 2 == 0, F.lit("  ")).otherwise(F.col("a")), F.col("b"), F.col("c")).alias("requirement"))


def h6_base_runs(spark, sf):
    """Repair jobs and what they start from: first answers of two strategies exist, tagged where they retrieved."""
    d = B.graph_rows(spark, sf).select("case_id", "run_index", "diagram_id")
    had = F.when(F.col("case_id") % 2 == 0, "open__m__zero_shot").otherwise("open__m__rag__rules")
    first = d.join(TQ._texts(spark, sf), "diagram_id").where("run_index <> 1").select(had.alias("run_id"), "case_id", "run_index", F.lit("final").alias("stage"), "text")
    wanted = F.element_at(F.array(*map(F.lit, ("open__m__zero_shot_validation_generator_critic_repair", "open__m__rag_validation_generator_critic_repair__rules", "open__m__rag_structural_validation__rules", "open__m__few_shot_validation_generator_critic_repair"))), (F.col("case_id") % 4 + 1).cast("int"))
    jobs = d.where("run_index > 0").select(wanted.alias("run_id"), "case_id", "run_index")
    return H.with_base(jobs, first).select("run_id", "case_id", "run_index", "base_run_id", "base_strategy", F.md5("base_text").alias("base_md5"))


def h8_extraction_prompts(spark, sf):
    return H.extraction_prompts(TQ._actions(spark, sf)).select("key", F.md5("prompt").alias("prompt_md5"))


def h8_rewriting_prompts(spark, sf):
    c = O.capabilities(TQ._actions(spark, sf)).select("key", "pos", F.col("clause").alias("requirement"), F.concat(F.lit("see "), F.col("pos").cast("string")).alias("evidence_quote"))
    return H.rewriting_prompts(c).select("key", F.md5("prompt").alias("prompt_md5"))


def h8_review_prompts(spark, sf):
    d = TQ._actions(spark, sf)
    return H.review_prompts(d, O.shall(O.capabilities(d))).select("key", F.md5("prompt").alias("prompt_md5"))


def o12_potential_missing(spark, sf):
    d = TQ._actions(spark, sf)
    # one more sentence in each text, so that some have no counterpart among the requirements
    a = O.capabilities(d.withColumn("text", F.concat("text", F.lit(" Editors view archived calendars."))))
    return O.best_overlap(a, O.shall(O.capabilities(d)), "clause", "requirement").where("best < 0.2").select("key", F.col("pos").cast("long").alias("pos"), F.round("best", 6).alias("best"))


def o13_potential_hallucinations(spark, sf):
    """Rewritten requirements and an invented one, which shares a word or two with some texts."""
    d = TQ._actions(spark, sf)
    odd = d.select("key", F.lit(-1).alias("pos"), F.concat(F.lit("The system shall brew coffee in "), T.words("text")[F.lit(0)], F.lit(".")).alias("requirement"))
    r = O.shall(O.capabilities(d)).union(odd)
    return O.best_overlap(r, O.capabilities(d), "requirement", "clause").where("best < 0.12").select("key", F.col("pos").cast("long").alias("pos"), F.round("best", 6).alias("best"))


def o17_normalised_answers(spark, sf):
    d = TQ._actions(spark, sf)
    a = d.select("key", F.when(F.col("key") % 2 == 0, F.array(F.lit("To view lists"), F.lit("view  lists."), F.lit(" "))).alias("requirements"))
    f = O.capabilities(d).withColumnRenamed("clause", "requirement")
    return H.normalised_answers(a, f).select("key", F.col("pos").cast("long").alias("pos"), "requirement")


def o17_rewritten_answers(spark, sf):
    """Answers with plain and nested items, in fences or bare, blank ones and ones that don't parse; extracted clauses stand in."""
    d = TQ._actions(spark, sf)
    k = F.col("key") % 4
    items = F.lit('{"rewritten_requirements": ["view lists", {"rewritten_requirement": " Users can pay ", "x": 1}, "", {"other": 2}, "View  lists."]}')
    text = F.when(k == 0, items).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), items, F.lit("\n```"))).when(k == 2, F.lit('{"rewritten_requirements": [" ", {"x": 1}]}')).otherwise(F.lit("no answer"))
    a = d.select("key", H.answer_items(text, "rewritten_requirements", "rewritten_requirement").alias("rewritten"))
    out = H.normalised_rewrites(a, O.capabilities(d).withColumnRenamed("clause", "requirement"))
    return out.select("key", F.col("pos").cast("long").alias("pos"), "requirement")


def o14_relaxed_verdicts(spark, sf):
    """Jobs of which some failed, some have no requirements, some a repeated one, and some many remarks of the reviewer."""
    d = TQ._actions(spark, sf)
    k = F.col("key")
    r = O.shall(O.capabilities(d.where("key % 6 <> 1")))
    r = r.union(r.where("key % 6 = 2 and pos > 0").withColumn("pos", F.col("pos") + 1000))
    some = lambda n: F.when(n > 0, F.array_repeat(F.lit("x"), n.cast("int")))
    review = F.struct(some(k % 3).alias("missing_requirements"), some(k % 5).alias("hallucinations"), F.array(F.lit("a"), F.lit("b")).alias("duplicates"), F.lit(None).cast("array<string>").alias("ambiguities"))
    j = d.select("key", F.when(k % 11 == 0, "timeout").otherwise(" ").alias("extraction_error"), F.lit(None).cast("string").alias("rewriting_error"), F.when(k % 6 != 3, review).alias("review"))
    return O.relaxed_verdict(r, j)


def o18_job_status(spark, sf):
    return TQ.o14_audit(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


_CX = f"with {B.VV}, c as (select v.*, case when d.n_chars <= 800 then 'simple' when d.n_chars <= 2500 then 'medium' else 'complex' end as complexity from v join documents d on v.case_id = d.doc_id)"
_RATED = f"""{RQ._R}, cs as (select s.*, case when o_totalprice < 1e5 then 'simple' when o_totalprice < 3e5 then 'medium' else 'complex' end as complexity, case when s.method = 'N' then 'ablation' else 'main' end as source,
case s.method when 'A' then 'Few-shot' when 'R' then (['RAG + Repair', 'Few-shot + Repair', 'Repair'])[item_id % 3 + 1] else (['RAG [rules only]', 'RAG [theory only]', 'RAG'])[item_id % 3 + 1] end as named from s join orders on o_orderkey = item_id where item_id % 50 <> 7),
med as (select source, complexity, named as method, criterion, count(*) as responses, count(distinct item_id) as diagrams, median(score) as median from cs group by all)"""
ORACLES = {
    "k9_validity_by_complexity": f"{_CX} select complexity, method, {RQ._RATE.format(f='strict_valid')} from c where syntax_valid group by 1, 2",
    "k11_dense_by_complexity": f"""{_CX}, a as (select complexity, method, {RQ._RATE.format(f='syntax_valid')} from c group by 1, 2)
select x.complexity, y.method, coalesce(total, 0) as total, coalesce(valid, 0) as valid, coalesce(invalid, 0) as invalid, coalesce(percent, 0) as percent from (select distinct complexity from c) x cross join (select distinct method from c) y left join a using (complexity, method)""",
    "k13_run_summary": f"with {B.VV} select model || '__' || method as run_id, {RQ._RATE.format(f='syntax_valid')} from v group by 1",
    "k16_change_composition": f"""{SQ._DIFF}, m as (select case_id % 4 as model, avg(added_states) as added_states, avg(deleted_states) as deleted_states, avg(added_edges) as added_edges, avg(deleted_edges) as deleted_edges, avg(relabelled_edges) as relabelled_edges from diffs group by 1),
u as (unpivot m on added_states, deleted_states, added_edges, deleted_edges, relabelled_edges into name change value mean) select model, change, mean, sum(mean) over (partition by model) as total from u""",
    "m5_ratings_by_complexity": f"{_RATED} select * from med",
    "m11_overall_disagreement": f"""{RQ._PAIRS}, al as (select * from ps union all select item_id, 'overall', a, b from ps) select criterion, count(*) as n, avg(abs(a - b)) as mean_abs_diff, avg(case when abs(a - b) >= 2 then 1.0 else 0.0 end) as share_2, case when stddev_samp(a - b) = 0 then 0.0 else avg(a - b) / stddev_samp(a - b) end as d_z from al group by 1""",
    "m13_quality_by_model": f"{RQ._R} select case when model = 'O' then 'Open' else 'Final' end as label, count(*) as n, quantile_cont(score, 0.5) as median, quantile_cont(score, 0.25) as q1, quantile_cont(score, 0.75) as q3 from s where criterion = 'correctness' group by 1",
    "n2_table_variant": f"""with {B.VV}, c as (select model, method, printf('%.2f%% (n=%d/%d)', 100.0 * count(*) filter (syntax_valid) / count(*), count(*) filter (syntax_valid), count(*)) as cell from v where method in ('de', 'es') group by 1, 2)
select model, max(cell) filter (method = 'de') as de, max(cell) filter (method = 'es') as es from c group by 1""",
    "n7_compact_table": f"""{_RATED}, {_CX[5:]}, rows_ as (select complexity, 'strict validity' as metric, round(100.0 * count(*) filter (strict_valid) / count(*), 6) as value from c group by 1
union all select complexity, criterion, round(avg(median), 6) from med group by 1, 2
union all select complexity, 'human average', round(avg(v), 6) from (select complexity, criterion, round(avg(median), 6) as v from med group by 1, 2) group by 1)
select metric, max(value) filter (complexity = 'simple') as simple, max(value) filter (complexity = 'medium') as medium, max(value) filter (complexity = 'complex') as complex from rows_ group by 1""",
    "h1_requirement_fallback": "select conv_id, coalesce(case when conv_id % 2 = 0 then null else nullif(trim(max(text) filter (role = 'system')), '') end, nullif(trim(min(text) filter (role = 'user')), ''), nullif(trim(min(text) filter (role = 'assistant')), '')) as requirement from conversations group by 1",
}
_REQ = "('the', 'a', 'an', 'and', 'or', 'of', 'to', 'in', 'on', 'for', 'with', 'by', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'that', 'this', 'these', 'those', 'it', 'its', 'as', 'at', 'from', 'into', 'than', 'then', 'if', 'when', 'while', 'can', 'will', 'shall', 'should', 'would', 'could', 'may', 'might', 'must', 'not', 'no', 'so', 'such', 'their', 'his', 'her', 'our', 'your', 'they', 'them', 'he', 'she', 'we', 'you', 'i')"
_TK = f"list_distinct(list_filter(regexp_extract_all(lower({{x}}), '[a-z0-9]+'), lambda t: length(t) > 2 and t not in {_REQ}))"
_BY = "case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end"
#: Capability clauses (caps) and their requirements (rq) of the action texts.
_RQ2 = f"""{TQ._CAP}, c2 as (select key, pos, {TQ._CLEAN.replace('sentence', 'clause')} as clause from caps), lf as (select key, pos, clause, lower(clause) as low, {TQ._LF} as l from c2),
{TQ._SHALL[TQ._SHALL.index('sh as (select'):]}, r1 as (select key, pos, {TQ._PERIOD} as requirement from sh), r2 as (select *, {TQ._CANON.replace('sentence', 'requirement')} as c from r1),
rq as (select key, pos, requirement from r2 where c <> '' qualify row_number() over (partition by key, c order by pos) = 1),
ct as (select key, pos, {_TK.format(x='clause')} as t from caps), qt as (select key, pos, {_TK.format(x='requirement')} as t from rq)"""
_BEST = lambda l, r: f"select l.key, l.pos, coalesce(max({_BY.format(a='l.t', b='r.t')}), 0.0) as best from {l} l left join {r} r on l.key = r.key group by 1, 2"  # noqa: E731, E741
_AUDIT = f"""{_RQ2}, du as (select key, count(*) as n from (select key, pos, min(pos) over (partition by key, c) as f from (select key, pos, {TQ._CANON.replace('sentence', 'requirement')} as c from rq)) where pos > f group by 1),
am as (select key, count(*) as n from rq where {' or '.join(f"contains(lower(requirement), '{t}')" for t in ("etc", "and so on", "user friendly", "easy to use", "efficient", "quickly", "some", "many", "appropriate", "suitable", "as needed"))} group by 1),
mi as (select key, count(*) as n from ({_BEST('ct', 'qt')}) where best < 0.2 group by 1), ha as (select key, count(*) as n from ({_BEST('qt', 'ct')}) where best < 0.12 group by 1),
au as (select doc_id as key, coalesce(du.n, 0) as duplicates, coalesce(am.n, 0) as ambiguities, coalesce(mi.n, 0) as missing, coalesce(ha.n, 0) as hallucinations from documents d left join du on du.key = doc_id left join am on am.key = doc_id left join mi on mi.key = doc_id left join ha on ha.key = doc_id where text is not null),
av as (select *, case when duplicates + ambiguities + missing + hallucinations > 0 then 'needs_review' else 'pass' end as verdict from au)"""
_ACTION = "text || ' However, managers view the ' || source || ' list. Users can select ' || lang || ' and cancel. Users can select ' || lang || ' and cancel.'"
ORACLES |= {
    "o14_audit": f"{_AUDIT} select * from av",
    "o18_job_status": f"{_AUDIT} select verdict, count(*) as n from av group by 1",
    "o12_potential_missing": f"""{_RQ2}, more as (select key, max(pos) + 1 as pos, {_TK.format(x="'Editors view archived calendars'")} as t from sr group by 1), every as (select * from ct union all select * from more)
select key, pos, round(best, 6) as best from ({_BEST('every', 'qt')}) where best < 0.2""",
    "o13_potential_hallucinations": f"""{_RQ2}, odd as (select doc_id as key, -1 as pos, {_TK.format(x="'The system shall brew coffee in ' || regexp_extract_all(lower(" + _ACTION + "), '[a-z][a-z0-9_]+')[1] || '.'")} as t from documents where text is not null), every as (select * from qt union all select * from odd)
select key, cast(pos as bigint) as pos, round(best, 6) as best from ({_BEST('every', 'ct')}) where best < 0.12""",
    "o17_normalised_answers": f"{TQ._CAP} select key, pos, clause as requirement from caps where key % 2 <> 0 union all select doc_id, 0, 'view lists' from documents where text is not null and doc_id % 2 = 0",
    "o16_structured_document": f"""{_RQ2}, dn as (select key, string_agg(rn || '. ' || requirement, chr(10) order by rn) as l from (select key, requirement, row_number() over (partition by key order by pos) as rn from rq where key % 5 <> 0 and key % 7 <> 0) group by 1),
sm as (select key, case when key % 7 = 0 then '' else coalesce(array_to_string(list_slice(list_filter(s, lambda x: not contains(lower(x), 'figure')), 1, 3), ' '), '') end as sm from f),
hh as (select doc_id as key, case when doc_id % 7 = 0 then [] else list_filter([{', '.join(f"'{a}'" for a in T.ACTORS)}], lambda a: regexp_matches(lower({_ACTION}), '(^|[^a-z0-9_])' || a || '([^a-z0-9_]|$)')) end as h from documents where text is not null),
aa as (select key, coalesce(array_to_string(list_filter(h, lambda a: not (right(a, 1) = 's' and list_contains(h, left(a, length(a) - 1)))), ', '), '') as a from hh)
select key, concat_ws(chr(10), case key % 4 when 0 then 'Web Shop App' when 1 then 'case_' || key || '_' else 'Portal ' || key end || ' - Polished Requirement Specification', '', 'Overview',
 case when sm = '' then 'Overview is not explicitly stated in the source text.' when regexp_matches(sm, '[.!?]$') then sm else sm || '.' end, '', 'Operational Context',
 case when a = '' then 'Primary actors are not explicitly stated in the source text.' else 'Primary actors include ' || a || '.' end, '', 'Functional Requirements', coalesce(l, '1. The system shall provide the capabilities described in the source requirement text.'), '') as document
from sm join aa using (key) left join dn using (key)""",
    "o17_rewritten_answers": f"""{_RQ2} select key, pos, requirement from rq where key % 4 >= 2 union all select doc_id, 0, 'The system shall view lists.' from documents where text is not null and doc_id % 4 < 2
union all select doc_id, 1, 'The system shall allow users can pay.' from documents where text is not null and doc_id % 4 < 2""",
    "o14_relaxed_verdicts": f"""{_RQ2}, nr as (select key, count(*) as n, count(*) filter (pos > 0) as later from rq where key % 6 <> 1 group by 1),
jb as (select doc_id as key, coalesce(n, 0) as n, case when doc_id % 6 = 2 then coalesce(later, 0) else 0 end as duplicates, case when doc_id % 6 = 3 then 0 else doc_id % 3 + doc_id % 5 + 2 end as review_issues from documents left join nr on nr.key = doc_id where text is not null)
select key, duplicates, review_issues, case when key % 11 = 0 or n = 0 or duplicates > 0 or review_issues >= 6 then 'needs_review' else 'pass' end as verdict from jb""",
    "h8_extraction_prompts": f"select doc_id as key, md5('List the functional requirements of the text, each with a short quote that shows it. Invent nothing. Answer as JSON: functional_requirements, a list of requirement and evidence_quote.' || chr(10) || chr(10) || 'Text:' || chr(10) || {_ACTION}) as prompt_md5 from documents where text is not null",
    "h8_rewriting_prompts": f"""{TQ._CAP} select key, md5('Rewrite each requirement to begin with "The system shall". Keep their number, order and meaning. Answer as JSON: rewritten_requirements, a list of source_requirement and rewritten_requirement.' || chr(10) || chr(10) || '{{"functional_requirements":[' || string_agg('{{"requirement":' || to_json(clause) || ',"evidence_quote":"see ' || pos || '"}}', ',' order by pos) || ']}}') as prompt_md5 from caps group by 1""",
    "h8_review_prompts": f"""{_RQ2}, pj as (select key, '{{"rewritten_requirements":[' || string_agg(cast(to_json(requirement) as varchar), ',' order by pos) || ']}}' as j from rq group by 1)
select key, md5('Check the requirements against the text. Answer as JSON: missing_requirements, hallucinations, duplicates, ambiguities, and overall_assessment, pass or needs_review.' || chr(10) || chr(10) || 'Text:' || chr(10) || {_ACTION} || chr(10) || chr(10) || j) as prompt_md5 from pj join documents on doc_id = key""",
    "c12_issue_kinds": """select kind, count(*) as n from (select case event_id % 18 when 0 then 'missing_initial_state' when 1 then 'multiple_initial_states' when 2 then 'missing_final_state' when 3 then 'duplicate_transitions' when 4 then 'unreachable_states' when 6 then 'orphan_states'
 when 8 then 'invalid_choice_node' when 9 then 'invalid_choice_guards' when 10 then 'invalid_fork_node' when 11 then 'invalid_join_node' when 12 then 'invalid_history_state' when 13 then 'parse_warning' when 14 then 'plantuml_syntax_error' when 15 then 'plantuml_check_unavailable' when 16 then 'odd_thing' when 17 then 'unknown' end as kind from events) where kind is not null group by 1""",
}
_IDS = GQ.PAIRED[GQ.PAIRED.index("ids as (") :]
#: The scores' SQL over what the voted diagrams say: only states that a start, an end or a transition names.
_VOTED = f"""{TQ._POOL}, {TQ._EL}, vtr as (select case_id, a as src, b as event, c as dst from kept where kind = 'transition'), vall as (select case_id, a as state from kept where kind = 'state' union select case_id, initial from init union select case_id, src from vtr union select case_id, dst from vtr),
vfi as (select case_id, a as state from kept where kind = 'final' and (case_id, a) in (select case_id, state from vall)), vsee as (select case_id, initial as state from init union select case_id, src from vtr union select case_id, dst from vtr union select case_id, state from vfi),
vstates as (select diagram_id, state from states union all select 'voted/' || case_id, state from vsee), vtransitions as (select diagram_id, src, event, dst from transitions union all select 'voted/' || case_id, src, event, dst from vtr),
ids as (select 'voted/' || pn.case_id as diagram_id, q.diagram_id as gold_id, pn.case_id, 1::bigint as run_index from pn join diagrams q on q.case_id = pn.case_id and q.run_index = 0)"""
_VSCORED = GQ.SCORED.replace(GQ.PAIRED, _VOTED).replace("from states t join ids", "from vstates t join ids").replace("from transitions t join ids", "from vtransitions t join ids")
ORACLES["i16_ensemble_scores"] = f"{_VSCORED} select diagram_id, m.case_id, run_index, pn.n as candidate_count, pn.n // 2 + 1 as vote_threshold, complexity, {', '.join(f'round({c}, 9) as {c}' for c in GQ.METRICS)} from m join pn on pn.case_id = m.case_id"
_ITER = ["Repair at zero iterations", "Repair at once", "Repair at two iterations", "Repair at three iterations", "Repair at four iterations", "Repair at five iterations"]
_PC = "case when {d} = 0 then '' else printf('%.2f%% (n=%d/%d)', 100.0 * {n} / {d}, {n}, {d}) end"
ORACLES["j9_iteration_table"] = f"""{SQ._AT}, {B.VR.strip()}, m as (select case when case_id % 2 = 0 then 'F' else 'O' end as model, *, score <= 3 as syntax, score <= 2 as strict from mk),
it as (select case_id, max(attempt) as attempted, coalesce(max(attempt) filter (accepted and attempt > 0), max(attempt)) as repaired from m group by 1),
en as (select m.*, attempted from m join it using (case_id) where attempt = repaired), gr as (select model, unnest(range(6)) as i from (select distinct model from en where strict)),
t as (select gr.model, gr.i, (select count(*) from m where m.model = gr.model and attempt = i) as tried, (select count(*) from m where m.model = gr.model and attempt = i and syntax) as tsyn,
 (select count(*) from en where en.model = gr.model and attempted = i and syntax) as syn, (select count(*) from en where en.model = gr.model and attempted = i and strict) as str from gr),
l as (select *, cast(greatest(0, max(tried) filter (i = 0) over (partition by model) - coalesce(sum(str) over (partition by model order by i rows between unbounded preceding and 1 preceding), 0)) as bigint) as d from t),
du as (select distinct model, case_id, attempted as i from en where strict),
sc as (unpivot (select r.model, i, {', '.join(RQ.C)} from r join du on du.model = r.model and du.case_id = r.item_id where method = 'R') on {', '.join(RQ.C)} into name criterion value score),
hu as (select model, i, criterion, median(score) as md, count(*) as n from sc group by 1, 2, 3),
ce as (select 'Automatic (accuracy)' as evaluation_group, 'Structural validity' as metric, i, model, {_PC.format(n='str', d='d')} as cell from l
 union all select 'Automatic (accuracy)', 'Syntactic validity', i, model, {_PC.format(n='case when i = 5 then syn else tsyn end', d='d')} from l
 union all select 'Human (Likert scale 1-5)', x.label, gr.i, gr.model, coalesce(regexp_replace(regexp_replace(printf('%.6f', md), '0+$', ''), '[.]$', '') || ' (n=' || n || ')', '') from gr
  cross join (values ('completeness', 'Completeness'), ('correctness', 'Correctness'), ('understandability', 'Understandability'), ('terminology_alignment', 'Terminology alignment')) x(criterion, label) left join hu on hu.model = gr.model and hu.i = gr.i and hu.criterion = x.criterion)
select evaluation_group, metric, {', '.join(f"""coalesce(max(cell) filter (i = {i} and model = '{m}'), '') as "{_ITER[i]} | {m.lower()}" """ for i in (0, 2, 3, 4, 5) for m in "FO")} from ce group by 1, 2"""
_NL2 = "chr(10) || chr(10)"
_TEXTED = TQ.ORACLES["b17_graph_to_text"].split(B.VG, 1)[1].lstrip(", ")
#: Which advice a kind of issue gives, and where it stands among those of one issue; written out here for the SQL alone.
_GUIDE = (
    ("parse_warning", 1, "A line from [*] to [*] says nothing: let it leave the last state instead."), ("multiple_initial_states", 1, "Only one line may start the whole diagram at [*]."),
    ("multiple_initial_states", 2, "Where a second one stands inside a composite state, start that line at the composite state instead; no choice is needed."),
    ("multiple_initial_states", 3, "Mend several starts by changing arrows alone: no state is new, nothing else moves."), ("missing_initial_state", 1, "Start the first state of the life cycle from [*]."),
    ("missing_final_state", 1, "Let a state in which the process is over lead to [*]."), ("orphan_states", 1, "Tie lone states into the flow as the requirement says, or leave them out."),
    ("unreachable_states", 1, "Lead a path from the start to every state that can''t be reached, through a choice or its predecessor."), ("duplicate_transitions", 1, "Write each transition once, labels joined."),
    ("invalid_choice_node", 1, "A choice leads to two states or more."), ("invalid_choice_guards", 1, "Every arrow that leaves a choice has its [guard]."), ("invalid_fork_node", 1, "A fork opens two branches or more."),
    ("invalid_join_node", 1, "A join closes two branches or more."), ("invalid_history_state", 1, "A history mark belongs into a composite state, or goes."),
)
_ADVICE = f"gu as (select * from (values {', '.join(f"('{k}', {i}, '{t}')" for k, i, t in _GUIDE)}) v(kind, n, a)), ga as (select diagram_id, a, min(pos * 10 + n) as place from {{v}} join gu using (kind) group by 1, 2)"
ORACLES["a15_manifest"] = f"""with {B.VG}, c as (select case_id, case when count(*) <= 6 then 'simple' when count(*) <= 14 then 'medium' else 'complex' end as complexity from states join diagrams using (diagram_id) where run_index = 0 group by 1),
n as (select complexity, case when count(*) > 1 then least(greatest(round_even(count(*) * 0.35::double, 0), 1), count(*) - 1) else 1 end as take from c group by 1),
r as (select *, row_number() over (partition by complexity order by md5('42:' || case_id)) as rank from c), sp as (select case_id, case when rank <= take then 'test_case_ids' else 'rag_case_ids' end as section from r join n using (complexity)),
so0 as (select *, count(*) over (partition by section) as n from sp), so as (select *, cast('0x' || left(md5(cast(case_id as varchar)), 8) as bigint) % greatest(1, ceil(n / 40))::bigint as part from so0),
st as (select * from (values ('zero_shot', 'zero_shot', false, false, false), ('few_shot', 'few_shot', false, false, false), ('zero_shot_validation_generator_critic_repair', 'zero_shot_validation_generator_critic_repair', false, true, true), ('few_shot_validation_generator_critic_repair', 'few_shot_validation_generator_critic_repair', false, true, true),
 ('rag__t', 'rag', true, false, false), ('rag_structural_validation__t', 'rag_structural_validation', true, true, false), ('rag_validation_generator_critic_repair__t', 'rag_validation_generator_critic_repair', true, true, true)) v(k, strategy, r, v, e)),
cf as (select 'local__' || source || '__' || k as run_id, '{{"model_group":"local","model_label":"' || source || '","strategy":"' || strategy || '","use_rag":' || r || ',"use_structural_validation":' || v || ',"use_ensemble":' || e || ',"run_id":"local__' || source || '__' || k || '","baseline_subset_only":false}}' as j
 from (select distinct source from documents where source is not null) cross join st), co0 as (select *, count(*) over () as n from cf), co as (select *, cast('0x' || left(md5(run_id), 8) as bigint) % greatest(1, ceil(n / 40))::bigint as part from co0)
select section, cast(part as bigint) as part, n, '[' || string_agg('"' || case_id || '"', ',' order by case_id) || ']' as payload from so group by 1, 2, 3
union all select 'configs', cast(part as bigint), n, '[' || string_agg(j, ',' order by run_id) || ']' from co group by 2, 3
union all select 'settings', 0, 4, '{{"few_shot_count": 3, "rag_domain_hints": ["a", "b"], "rag_mode": "lexical", "runs_per_case": 1}}'"""
ORACLES["c16_guidance"] = f"""with recursive {TQ._RICH_RULES}, {_ADVICE.format(v='rv')}, gl as (select diagram_id, string_agg(a, chr(10) order by place) as l from ga group by 1)
select diagram_id, coalesce(l, 'Mend what is listed and keep what the requirement means.') as advice from diagrams left join gl using (diagram_id)"""
ORACLES["h3_generation_prompts"] = f"""with rq as (select doc_id as case_id, 'all' as s, text, row_number() over (order by md5('42:' || doc_id)) as rank from documents where text is not null), nq as (select least(greatest(round_even(count(*) * 0.35::double, 0), 1), count(*) - 1) as take from rq),
te as (select rq.* from rq, nq where rank <= take), po as (select rq.* from rq, nq where rank > take), {SQ.picks('te', 'po', 2)},
ex as (select target, string_agg('Requirement of example ' || position || ':' || chr(10) || text || {_NL2} || 'Diagram of example ' || position || ':' || chr(10) || '@startuml' || chr(10) || '[*] --> S' || example || chr(10) || '@enduml', {_NL2} order by position) as e from pk join rq on rq.case_id = example group by 1),
b as (select te.case_id, 'Draw one state machine for the requirement below. Answer with a single diagram block between @startuml and @enduml.' || {_NL2} as head, 'Requirement:' || chr(10) || text as req, e, text from te left join ex on target = case_id)
select case_id, 'local__' || m || '__' || strategy as run_id, strategy, case strategy when 'zero_shot' then head || req when 'few_shot' then head || e || {_NL2} || req else head || req || {_NL2} || 'Context, to support the requirement:' || chr(10) || text || {_NL2} || 'Answer with the diagram only.' end as prompt
from b cross join (values ('m1'), ('m2')) u(m) cross join (values ('zero_shot'), ('few_shot'), ('rag')) v(strategy)"""
ORACLES["h4_repair_prompts"] = f"""{GQ._RULES}, {_TEXTED.split('select i.diagram_id', 1)[0].rstrip()}, tx as (select i.diagram_id{_TEXTED.split('select i.diagram_id', 1)[1]}),
iss2 as (select diagram_id, string_agg('- ' || issue, chr(10) order by pos) as l from viol group by 1), {_ADVICE.format(v='viol')}, adv as (select diagram_id, string_agg('- ' || a, chr(10) order by place) as l from ga group by 1)
select d.diagram_id, 'Repair the diagram.' || {_NL2} || 'Requirement:' || chr(10) || 'Follow the flow.' || {_NL2} || 'Diagram:' || chr(10) || text || {_NL2} || 'Issues:' || chr(10) || coalesce(iss2.l, '- none') || {_NL2} || 'Advice:' || chr(10) || coalesce(adv.l, '- Mend what is listed and keep what the requirement means.') as prompt
from diagrams d join tx using (diagram_id) left join iss2 using (diagram_id) left join adv using (diagram_id) where run_index > 0"""
_SEL = TQ._LEGACY("case when x.dups = 0 then 0 else 1 end")
ORACLES["h5_stacked_prompts"] = f"""{_SEL[: _SEL.rindex('select case_id')]}, sl as ({_SEL[_SEL.rindex('select case_id') :]}), {_TEXTED.split('select i.diagram_id', 1)[0].rstrip().replace('t as (', 't2 as (', 1)}, tx as (select i.diagram_id{_TEXTED.split('select i.diagram_id', 1)[1].replace('left join t ', 'left join t2 as t ')}),
ln as (select case_id, rank, case when case_id % 3 = 0 then replace(text, chr(10) || '@enduml', repeat(chr(10) || chr(39) || ' remark', 400) || chr(10) || '@enduml') else text end as t from sl join tx using (diagram_id)),
cu as (select case_id, rank, case when length(t) <= 2600 then t else rtrim(left(t, 2568), ' ' || chr(10)) || chr(10) || '@enduml' end as t from ln),
nd as (select case_id, string_agg('Handle ' || state || '.', ' ' order by state) as req from diagrams join states using (diagram_id) where run_index = 0 group by 1),
pr as (select case_id, 'Answer the requirement with one state machine, given the candidates below. Take the candidate that fits best as it is, and change of it only what the syntax, a rule of state machines or a missing part of the requirement demands. Join no two candidates, and add nothing else.'
  || {_NL2} || 'Requirement:' || chr(10) || any_value(req) || {_NL2} || string_agg('Candidate ' || rank || ':' || chr(10) || t, {_NL2} order by rank) || {_NL2} || 'Answer with the diagram only.' as prompt from cu join nd using (case_id) group by 1)
select case_id, length(prompt)::int as length, md5(prompt) as prompt_md5 from pr"""
ORACLES["h6_base_runs"] = f"""with {B.VG}, {_TEXTED.split('select i.diagram_id', 1)[0].rstrip()}, tx as (select i.diagram_id{_TEXTED.split('select i.diagram_id', 1)[1]}),
jb as (select case_id, run_index, diagram_id, case_id % 4 as k, case_id % 4 < 2 and run_index <> 1 as has from diagrams where run_index > 0)
select ['open__m__zero_shot_validation_generator_critic_repair', 'open__m__rag_validation_generator_critic_repair__rules', 'open__m__rag_structural_validation__rules', 'open__m__few_shot_validation_generator_critic_repair'][k + 1] as run_id, case_id, run_index,
case when has then case k when 0 then 'open__m__zero_shot' else 'open__m__rag__rules' end end as base_run_id, case when has then case k when 0 then 'zero_shot' else 'rag' end end as base_strategy, case when has then md5(text) end as base_md5 from jb join tx using (diagram_id)"""
_S = lambda x: f"(select similarity from jac where (a = c.diagram_id and b = {x}) or (b = c.diagram_id and a = {x}))"
ORACLES["i14_diverse_selection"] = f"""{TQ._FINAL}, {_TEXTED.split('select i.diagram_id', 1)[0].rstrip().replace('t as (', 't2 as (', 1)}, tx as (select i.diagram_id{_TEXTED.split('select i.diagram_id', 1)[1].replace('left join t ', 'left join t2 as t ')}),
c as (select fr.*, text, 'm' || cast(split_part(diagram_id, '/', 2) as int) % 3 as model, row_number() over (partition by case_id order by round(final, 9) desc, round(coverage, 9) desc, round(structural, 9) desc, round(quality, 9) desc, diagram_id) as rank from fr join tx using (diagram_id)),
s1 as (select case_id, diagram_id, text, model, round(final, 9) as adjusted from c where rank = 1),
s2 as (select c.case_id, c.diagram_id, c.text, c.model, round(final - 0.2::double * {_S('s1.diagram_id')} + case when c.model <> s1.model then 0.03::double else 0 end, 9) as adj from c join s1 using (case_id) where c.text <> s1.text and c.diagram_id <> s1.diagram_id qualify row_number() over (partition by c.case_id order by adj desc, rank) = 1),
s3 as (select c.case_id, c.diagram_id, round(final - 0.2::double * greatest({_S('s1.diagram_id')}, {_S('s2.diagram_id')}) + case when c.model <> s1.model and c.model <> s2.model then 0.03::double else 0 end, 9) as adj3 from c join s1 using (case_id) join s2 using (case_id)
 where c.text not in (s1.text, s2.text) and c.diagram_id not in (s1.diagram_id, s2.diagram_id) qualify row_number() over (partition by c.case_id order by adj3 desc, rank) = 1)
select case_id, diagram_id, 1 as selection, adjusted from s1 union all select case_id, diagram_id, 2, adj from s2 union all select case_id, diagram_id, 3, adj3 from s3"""
ORACLES = {k: v for k, v in ORACLES.items() if v}
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "achijkmno" and n[1:2].isdigit()}
