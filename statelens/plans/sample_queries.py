"""Queries for sampling, retrieval and repair (groups F, G, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.operators import graph as G
from statelens.operators import repair as J
from statelens.operators import retrieval as R
from statelens.operators import sampling as S
from statelens.plans import bindings as B
from statelens.plans import text_queries as TQ
from statelens.plans.graph_queries import _RULES

SEED = 42


def _cases(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "n_chars")
    return d.select("case_id", F.when(F.col("n_chars") <= 800, "simple").when(F.col("n_chars") <= 2500, "medium").otherwise("complex").alias("complexity"))


def f1_stratified_split(spark, sf):
    return S.stratified_split(_cases(spark, sf), "case_id", "complexity", 0.35, SEED)


def f2_split_report(spark, sf):
    return S.split_report(f1_stratified_split(spark, sf), "complexity")


def f3_balanced_subset(spark, sf):
    return S.balanced_subset(_cases(spark, sf), "case_id", "complexity", ["simple", "medium", "complex"], 50, SEED)


def f4_examples_per_target(spark, sf):
    s = f1_stratified_split(spark, sf)
    return S.pick_examples(s.where("role = 'test'"), s.where("role = 'pool'"), "case_id", "complexity", 4, SEED).select("target", "example", F.col("position").cast("long").alias("position"))


def f5_leakage(spark, sf):
    """The lists of a split, into whose pool every ninth test case and ids of no case have come."""
    s = f1_stratified_split(spark, sf).select("case_id", "role")
    wrong = s.where("role = 'test' and case_id % 9 = 0").select("case_id", F.lit("pool"))
    unknown = s.where("role = 'pool' and case_id % 10 = 0").select(F.col("case_id") + 10_000_000, "role")
    return S.split_faults(s.union(wrong).union(unknown), _cases(spark, sf), "case_id")


def f6_case_range(spark, sf):
    return S.case_range(_cases(spark, sf), "case_id", 100, 5000).groupBy("complexity").agg(F.count("*").alias("n"))


def _docs(spark, sf):
    return B.table(spark, sf, "documents").select(F.format_string("%08d_domain_%s_rules", "doc_id", "source").alias("name"), F.col("text").alias("content"), F.col("lang").alias("source_type"), "source").withColumn("name", F.concat_ws("/", F.split_part("name", F.lit("_"), F.lit(1)), F.concat(F.lit("domain_"), "source", F.lit("_rules")))).drop("source")


def _queries(spark, sf):
    """Benchmark items; every third names a business domain in its text, every fourth gives one as a hint."""
    say = F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" Payment of an Order"))).otherwise(F.col("text"))
    hint = F.concat(F.lit(" Src"), (F.col("item_id") % 20).cast("string"), F.lit(" "))
    return B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), say.alias("text"), F.when(F.col("item_id") % 4 == 0, F.array(hint, F.lit(" "))).alias("domains"))


def _library(spark, sf):
    """Documents as rules, theory and examples by language; Spanish ones are in no known category, German ones have no token of any query."""
    d = B.table(spark, sf, "documents")
    kind = F.when(F.col("lang") == "en", "plantuml_rule").when(F.col("lang") == "fr", "state_diagram_theory").when(F.col("lang") == "de", "dataset_example").otherwise("reference")
    text = F.when(F.col("lang") == "de", F.regexp_replace("text", "[a-zA-Z]", "1")).when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" payment inventory"))).otherwise(F.col("text"))
    name = F.concat(F.format_string("%08d", "doc_id"), F.lit("/domain_"), "source", F.lit("_rules.md"))
    return d.select(name.alias("name"), text.alias("content"), kind.alias("source_type"))


def g1_lexical_top(spark, sf):
    """Best documents of each category; examples share nothing with any query and come by the fallback."""
    top = R.retrieve(_queries(spark, sf), _library(spark, sf), 3)
    return top.select("query", "name", "source_type", "score", "lexical", "title", "domain", "token_count", F.col("rank").cast("long").alias("rank"))


def g2_query_domains(spark, sf):
    return _queries(spark, sf).select("query", F.array_join(F.array_sort(R.query_domains(F.col("text"), F.col("domains"))), ",").alias("domains"))


def g2_domains(spark, sf):
    d = _library(spark, sf)
    return d.select("name", F.array_join(F.array_sort(R.doc_domains(F.col("name"), T.words("content"))), ",").alias("domains")).groupBy("domains").agg(F.count("*").alias("n"))


def g4_plain_top(spark, sf):
    """Without a known category the best of all documents."""
    d = _library(spark, sf).where("source_type = 'reference'")
    top = R.retrieve(_queries(spark, sf), d, 3)
    return top.select("query", "name", "score", F.col("rank").cast("long").alias("rank"))


def g5_source_types(spark, sf):
    """Categories from path prefixes and front matter."""
    d = B.table(spark, sf, "documents")
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("dataset_examples/", "plantuml_rules/", "state_diagram_theory/", "other/", "other/")]), (F.col("doc_id") % 5 + 1).cast("int"))
    front = F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("---\nsource_type: kind/"), "lang", F.lit("  \n---\n"), "text")).otherwise(F.col("text"))
    return d.select(R.source_type(F.concat(prefix, F.col("doc_id").cast("string")), front).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def g6_vector_top(spark, sf):
    v = B.table(spark, sf, "embeddings")
    out = R.nearest(v, v.where("vec_id % 50 = 0"), 3, "label")
    return out.select("query_id", "category", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def g6_vector_fallback(spark, sf):
    """No vector has the wanted category: all answer."""
    v = B.table(spark, sf, "embeddings")
    out = R.nearest_in(v, v.where("vec_id % 50 = 0"), 3, "label", [-5])
    return out.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _cases_with_text(spark, sf):
    """Documents as cases with a titled requirement of two lines and a diagram."""
    d = B.table(spark, sf, "documents").where("text is not null")
    title = F.concat(F.lit("\n Shop "), "source", F.when(F.col("doc_id") % 2 == 0, " — polished").otherwise(" - polished"), F.lit("\n"))
    return d.select(
        F.concat(F.lit("case_"), F.col("doc_id").cast("string"), F.lit("_web_shop")).alias("case_id"), F.lit("simple").alias("complexity"), F.col("text").alias("raw_requirement"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(title, F.replace("text", F.lit(". "), F.lit(".\n")))).alias("structured_requirement"), F.concat(F.lit("@startuml\n[*] --> A : "), "source", F.lit("\n@enduml")).alias("gold_text"),
    )


def g9_example_documents(spark, sf):
    return R.example_documents(_cases_with_text(spark, sf)).select("name", F.md5("content").alias("content_md5"), "source_type")


def g10_case_documents(spark, sf):
    docs = R.with_case_documents(_library(spark, sf), _cases_with_text(spark, sf))
    return docs.select("name", F.md5("content").alias("content_md5"), "source_type")


def g7_snippets(spark, sf):
    """Snippets of example documents, and of the library's by their category."""
    d = R.example_documents(_cases_with_text(spark, sf)).union(_library(spark, sf))
    return d.select("name", F.md5(R.snippet(F.col("source_type"), F.col("content"), 1200)).alias("snippet_md5"))


def g8_trace(spark, sf):
    d = _library(spark, sf)
    t = R.trace(R.retrieve(_queries(spark, sf), d, 3), d, 1200)
    return t.select("query", "name", "source_type", "score", "lexical", "title", "domain", F.col("clipped_chars").cast("long").alias("clipped_chars"))


def g8_contexts(spark, sf):
    d = _library(spark, sf)
    c = R.contexts(R.trace(R.retrieve(_queries(spark, sf), d, 3), d, 1200))
    return c.select("query", "n_docs", F.md5("context").alias("context_md5"))


def _ruled(spark, sf):
    return G.rules(B.graph_rows(spark, sf))


def j1_paired_stages(spark, sf):
    """Runs of every kind with a first and a final diagram, and metadata."""
    r = TQ._runs(spark, sf)
    meta = r.where("case_id % 10 <> 0").select("run_id", "case_id", "run_index").distinct()
    return J.paired_stages(r, meta, kind="").select("run_id", "case_id", "initial_id", "final_id")


def n8_review_manifest(spark, sf):
    d = j4_iteration_counts(spark, sf).join(j3_violation_delta(spark, sf), "case_id").withColumn("model", F.concat(F.lit("Model "), (F.col("case_id") % 4).cast("string"), F.lit("!")))
    d = d.select("model", F.lit("Repair").alias("method"), F.concat(F.lit("case_"), F.col("case_id").cast("string")).alias("case_id"), "attempted", "repaired", F.col("before").alias("initial_violations"), F.col("after").alias("final_violations"))
    return J.review_manifest(d, 4)


def j2_graph_diff(spark, sf):
    r = _ruled(spark, sf)
    return J.graph_diff(r.where("run_index = 0"), r.where("run_index = 1"), "case_id")


def j3_violation_delta(spark, sf):
    r = _ruled(spark, sf)
    return J.violation_delta(r.where("run_index = 0"), r.where("run_index = 1"), "case_id")


def _attempts(spark, sf):
    r = _ruled(spark, sf)
    v = G.validation(r).select("diagram_id", "syntax_valid", "strict_valid", "score")
    return v.join(r.select("diagram_id", "case_id", F.col("run_index").alias("attempt")), "diagram_id")


def _marked(spark, sf):
    return J.accepted(_attempts(spark, sf), "case_id", "attempt", "score")


def j4_iteration_counts(spark, sf):
    return J.iteration_counts(_marked(spark, sf), "case_id", "attempt")


CHANGES = ["added_states", "deleted_states", "added_transitions", "deleted_transitions", "relabelled_edges"]


def j5_repair_summary(spark, sf):
    d = j2_graph_diff(spark, sf).join(j3_violation_delta(spark, sf), "case_id").join(j4_iteration_counts(spark, sf), "case_id").withColumn("model", F.col("case_id") % 4)
    return J.repair_summary(d, ["model"], CHANGES)


def j6_new_kinds(spark, sf):
    return J.new_kind_distribution(j3_violation_delta(spark, sf).withColumn("model", F.col("case_id") % 4), ["model"])


def j7_attempt_counts(spark, sf):
    return J.attempt_counts(_attempts(spark, sf), ["attempt"])


def j8_remaining_population(spark, sf):
    a = _attempts(spark, sf).withColumn("model", F.col("case_id") % 4)
    total = a.groupBy("model").agg(F.countDistinct("case_id").alias("cases"))
    c = J.attempt_counts(a, ["model", "attempt"]).join(total, "model")
    return J.remaining(c, ["model"], "attempt", F.col("cases")).select("model", "attempt", "strict_valid", "denominator", "percent")


def j10_valid_elsewhere(spark, sf):
    a = _attempts(spark, sf)
    return a.where("attempt = 1").join(a.where("attempt = 0 and score <= 3").select("case_id"), "case_id", "left_semi").select("case_id", "score")


def j11_accept_if_better(spark, sf):
    return _marked(spark, sf).select("case_id", "attempt", "score", "accepted")


def j12_before_after(spark, sf):
    a = _attempts(spark, sf).withColumn("model", F.col("case_id") % 4)
    p = a.groupBy("model").agg(F.avg(F.when(F.col("attempt") == 0, F.col("strict_valid").cast("double"))).alias("before"), F.avg(F.when(F.col("attempt") == 1, F.col("strict_valid").cast("double"))).alias("after"))
    return p.withColumn("change", 100 * (F.col("after") - F.col("before")))


_CASES = "c as (select doc_id as case_id, case when n_chars <= 800 then 'simple' when n_chars <= 2500 then 'medium' else 'complex' end as complexity from documents)"
_SPLIT = f"""with {_CASES}, n as (select complexity, count(*) as n from c group by 1),
t as (select complexity, case when n > 1 then least(greatest(round_even(n * 0.35::double, 0), 1), n - 1) else least(greatest(round_even(n * 0.35::double, 0), 1), n) end as take from n),
r as (select *, row_number() over (partition by complexity order by md5('{SEED}:' || case_id)) as rank from c),
sp as (select case_id, complexity, case when rank <= take then 'test' else 'pool' end as role from r join t using (complexity))"""
_AT = f"""{_RULES}, w as (select diagram_id, count(*) as n from viol group by 1),
att as (select d.diagram_id, d.case_id, d.run_index as attempt, cast(coalesce(w.n, 0) as bigint) as score, coalesce(w.n, 0) = 0 as strict_valid from diagrams d left join w using (diagram_id)),
mk as (select *, coalesce(score < min(score) over (partition by case_id order by attempt rows between unbounded preceding and 1 preceding), true) as accepted from att)"""
_DELTA = f"""{_AT}, k as (select d.case_id, d.run_index, coalesce(list(v.kind) filter (v.kind is not null), []) as kinds from diagrams d left join viol v using (diagram_id) where d.run_index in (0, 1) group by 1, 2),
delta as (select a.case_id, cast(len(a.kinds) as bigint) as before, cast(len(b.kinds) as bigint) as after, cast(len(a.kinds) - len(b.kinds) as bigint) as reduction,
case when len(a.kinds) = 0 then 0.0 else 100.0 * (len(a.kinds)::bigint - len(b.kinds)::bigint) / len(a.kinds) end as reduction_percent,
coalesce(array_to_string(list_sort(list_distinct(list_filter(b.kinds, lambda x: not list_contains(a.kinds, x)))), ','), '') as new_kinds, coalesce(array_to_string(list_sort(list_distinct(list_filter(a.kinds, lambda x: not list_contains(b.kinds, x)))), ','), '') as eliminated_kinds,
case when len(b.kinds) < len(a.kinds) then 'improved' when len(b.kinds) > len(a.kinds) then 'worsened' else 'unchanged' end as status from k a join k b on a.case_id = b.case_id and a.run_index = 0 and b.run_index = 1)"""
_DIFF = f"""with {B.VG}, x as (select a.case_id, a.diagram_id as i0, b.diagram_id as i1 from diagrams a join diagrams b on a.case_id = b.case_id and a.run_index = 0 and b.run_index = 1),
lab as (select diagram_id, src, dst, array_to_string(list_sort(list(distinct event)), ';') as l from transitions group by 1, 2, 3),
el as (select diagram_id, 's' as t, state as a, '' as b, '' as c from states union all select distinct diagram_id, 't', src, dst, event from transitions union all select diagram_id, 'e', src, dst, l from lab),
p as (select case_id, t, a, b, case when t = 't' then c else '' end as c, max(case when diagram_id = i0 then 1 else 0 end) as o, max(case when diagram_id = i1 then 1 else 0 end) as n, count(distinct c) as labels from el join x on el.diagram_id in (x.i0, x.i1) group by 1, 2, 3, 4, 5),
diff as (select case_id, count(*) filter (t = 's' and n > o) as added_states, count(*) filter (t = 's' and n < o) as deleted_states, count(*) filter (t = 't' and n > o) as added_transitions, count(*) filter (t = 't' and n < o) as deleted_transitions,
count(*) filter (t = 'e' and n > o) as added_edges, count(*) filter (t = 'e' and n < o) as deleted_edges, count(*) filter (t = 'e' and n = 1 and o = 1 and labels > 1) as relabelled_edges from p group by 1),
diffs as (select *, added_states + deleted_states + added_edges + deleted_edges + relabelled_edges as total_change from diff)"""
_TERMS = "['accounts', 'admin', 'inventory', 'logistic', 'logistics', 'order', 'payment', 'authentication', 'employee', 'employees', 'customer', 'customers', 'healthcare', 'covid', 'textile', 'marketplace', 'device', 'recommendation']"
_W = "list_distinct(regexp_extract_all(lower({x}), '[a-z][a-z0-9_]+'))"
_LIB = f"""q0 as (select item_id as query, case when item_id % 3 = 0 then text || ' Payment of an Order' else text end as text, case when item_id % 4 = 0 then ['src' || (item_id % 20)] else [] end as hint from benchmark),
q as (select query, {_W.format(x='text')} as t, list_distinct(list_concat(list_intersect({_W.format(x='text')}, {_TERMS}), hint)) as dom from q0),
d0 as (select printf('%08d', doc_id) || '/domain_' || source || '_rules.md' as name, case when lang = 'de' then regexp_replace(text, '[a-zA-Z]', '1', 'g') when doc_id % 5 = 0 then text || ' payment inventory' else text end as content,
  case lang when 'en' then 'plantuml_rule' when 'fr' then 'state_diagram_theory' when 'de' then 'dataset_example' else 'reference' end as source_type, source from documents),
d as (select *, {_W.format(x='content')} as t, {_W.format(x="regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')")} as tt, list_distinct(list_concat([source], list_intersect({_W.format(x='content')}, {_TERMS}))) as dom from d0),
s as (select query, name, source_type, content, cast(len(list_intersect(q.t, d.t)) as bigint) as lexical, cast(len(list_intersect(q.t, d.tt)) as bigint) as title, cast(len(list_intersect(q.dom, d.dom)) as bigint) as domain, cast(len(d.t) as bigint) as token_count from q cross join d),
r as (select *, lexical + 2 * title + 3 * domain as score from s)"""
_LEX = f"""with {_LIB},
top as (select *, row_number() over (partition by query, source_type order by score desc, domain desc, title desc, lexical desc, token_count desc, name) as rank, max(score) over (partition by query, source_type) as best from r where source_type <> 'reference'
 qualify (score > 0 or best = 0) and rank <= case when source_type = 'dataset_example' then 3 else 2 end)"""
_TRIM = "trim({x}, ' ' || chr(9) || chr(10) || chr(13))"
_CLIP = f"case when length(x) <= n then x when {_TRIM.format(x='regexp_extract(left(x, n), chr(40) || chr(63) || chr(115) || chr(41) || chr(94) || chr(40) || chr(46) || chr(42) || chr(41) || chr(10), 1)')} <> '' then {_TRIM.format(x='regexp_extract(left(x, n), chr(40) || chr(63) || chr(115) || chr(41) || chr(94) || chr(40) || chr(46) || chr(42) || chr(41) || chr(10), 1)')} else {_TRIM.format(x='left(x, n)')} end"
_SNIP = f"""sn0 as (select name, source_type, {_TRIM.format(x='content')} as x, case when source_type in ('plantuml_rule', 'state_diagram_theory') then 800 else 1200 end as n from d),
sn as (select name, source_type, case when source_type = 'dataset_example' then 'Requirement of an example:' || chr(10) || chr(10) || chr(10) || 'Its diagram:' || chr(10) else {_CLIP} end as snippet from sn0)"""
_CT = """ct as (select 'case_' || doc_id || '_web_shop' as case_id, text, case when doc_id % 3 = 0 then '' else chr(10) || ' Shop ' || source || case when doc_id % 2 = 0 then ' — polished' else ' - polished' end || chr(10) || replace(text, '. ', '.' || chr(10)) end as st, '@startuml' || chr(10) || '[*] --> A : ' || source || chr(10) || '@enduml' as gold,
 doc_id % 3 = 0 as bare, 'Shop ' || source as dom, 'Shop ' || source || case when doc_id % 2 = 0 then ' — polished' else ' - polished' end as title from documents where text is not null)"""
_EXAMPLE = f"""'---' || chr(10) || 'source_type: dataset_example' || chr(10) || 'case_id: ' || case_id || chr(10) || 'domain: ' || case when bare then 'case_' || split_part(case_id, '_', 2) || '_web_shop' else dom end || chr(10) || 'complexity: simple' || chr(10) || 'split_role: rag_train' || chr(10) || '---' || chr(10) || chr(10) || '# ' || case when bare then case_id else title end
 || chr(10) || chr(10) || '## Requirement' || chr(10) || chr(10) || {_TRIM.format(x='st')} || chr(10) || chr(10) || '## Reference PlantUML' || chr(10) || chr(10) || '```plantuml' || chr(10) || gold || chr(10) || chr(10) || '```' || chr(10)"""
ORACLES = {
    "f1_stratified_split": f"{_SPLIT} select * from sp",
    "f2_split_report": f"{_SPLIT} select complexity, count(*) as total, count(*) filter (role = 'test') as test, count(*) filter (role = 'pool') as pool from sp group by 1",
    "f3_balanced_subset": f"{_SPLIT} select case_id, complexity from r order by rank, list_position(['simple', 'medium', 'complex'], complexity) limit 50",
    "f5_leakage": f"{_SPLIT} select case_id, 'in test and pool' as fault from sp where role = 'test' and case_id % 9 = 0 union all select case_id + 10000000, 'no such case' from sp where role = 'pool' and case_id % 10 = 0",
    "f6_case_range": f"with {_CASES} select complexity, count(*) as n from c where case_id between 100 and 5000 group by 1",
    "g1_lexical_top": f"{_LEX} select query, name, source_type, score, lexical, title, domain, token_count, rank from top",
    "g2_domains": f"with {_LIB} select array_to_string(list_sort(dom), ',') as domains, count(*) as n from d group by 1",
    "g2_query_domains": f"with {_LIB} select query, array_to_string(list_sort(dom), ',') as domains from q",
    "g4_plain_top": f"with {_LIB} select query, name, score, row_number() over (partition by query order by score desc, domain desc, title desc, lexical desc, token_count desc, name) as rank from r where source_type = 'reference' qualify rank <= 3 and (score > 0 or max(score) over (partition by query) = 0)",
    "g5_source_types": "select case doc_id % 5 when 0 then 'dataset_example' when 1 then 'plantuml_rule' when 2 then 'state_diagram_theory' when 3 then 'reference' else 'kind/' || lang end as kind, count(*) as n from documents group by 1",
    "g6_vector_fallback": """with d as (select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as distance from embeddings q join embeddings v on q.vec_id % 50 = 0)
select query_id, vec_id, round(distance, 6) as distance, row_number() over (partition by query_id order by distance, vec_id) as rank from d qualify rank <= 3""",
    "g6_vector_top": """with d as (select q.vec_id as query_id, cast(v.label as bigint) as category, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as distance from embeddings q join embeddings v on q.vec_id % 50 = 0)
select query_id, category, vec_id, round(distance, 6) as distance, row_number() over (partition by query_id, category order by distance, vec_id) as rank from d qualify rank <= 3""",
    "g7_snippets": f"""with {_LIB}, {_SNIP}, {_CT}, cx as (select 'dataset_examples/' || case_id || '.md' as name, {_TRIM.format(x='st')} as x, 400 as n, gold from ct)
select name, md5(snippet) as snippet_md5 from sn union all select name, md5('Requirement of an example:' || chr(10) || {_CLIP} || chr(10) || chr(10) || 'Its diagram:' || chr(10) || gold) from cx""",
    "g8_trace": f"{_LEX}, {_SNIP} select query, name, top.source_type, score, lexical, title, domain, length(snippet) as clipped_chars from top join sn using (name)",
    "g8_contexts": f"{_LEX}, {_SNIP} select query, count(*) as n_docs, md5(string_agg(snippet, chr(10) || chr(10) order by list_position(['plantuml_rule', 'state_diagram_theory', 'dataset_example'], top.source_type), rank)) as context_md5 from top join sn using (name) group by 1",
    "g9_example_documents": f"with {_CT} select 'dataset_examples/' || case_id || '.md' as name, md5({_EXAMPLE}) as content_md5, 'dataset_example' as source_type from ct",
    "g10_case_documents": f"""with {_LIB}, {_CT} select name, md5(content) as content_md5, source_type from d union all
select case_id || '.txt', md5('Case ID: ' || case_id || chr(10) || 'Complexity: simple' || chr(10) || chr(10) || 'Requirement:' || chr(10) || case when st = '' then text else st end || chr(10) || chr(10) || 'Reference PlantUML:' || chr(10) || gold || chr(10)), 'reference' from ct""",
    "j1_paired_stages": f"with {TQ._RUNS} select a.run_id, a.case_id, a.diagram_id as initial_id, b.diagram_id as final_id from rs a join rs b on a.case_id = b.case_id and a.run_index = 0 and b.run_index = 1 where a.case_id % 10 <> 0",
    "j2_graph_diff": f"{_DIFF} select * from diffs",
    "j3_violation_delta": f"{_DELTA} select * from delta",
    "j4_iteration_counts": f"{_AT} select case_id, max(attempt) as attempted, coalesce(max(attempt) filter (accepted and attempt > 0), max(attempt)) as repaired from mk group by 1",
    "j6_new_kinds": f"{_DELTA}, m as (select case_id % 4 as model, * from delta), t as (select model, count(*) as n from m group by 1), e as (select model, unnest(string_split(new_kinds, ',')) as kind from m where new_kinds <> '') select model, kind, count(*) as count, 100.0 * count(*) / any_value(n) as percent from e join t using (model) group by 1, 2",
    "j7_attempt_counts": f"{_AT} select attempt, count(*) as total, count(*) as syntax_valid, count(*) filter (strict_valid) as strict_valid from att group by 1",
    "j8_remaining_population": f"""{_AT}, m as (select case_id % 4 as model, * from att), t as (select model, count(distinct case_id) as cases from m group by 1), c as (select model, attempt, count(*) filter (strict_valid) as strict_valid from m group by 1, 2),
l as (select model, attempt, strict_valid, cast(greatest(0, cases - coalesce(sum(strict_valid) over (partition by model order by attempt rows between unbounded preceding and 1 preceding), 0)) as bigint) as denominator from c join t using (model))
select *, case when denominator = 0 then 0.0 else 100.0 * strict_valid / denominator end as percent from l""",
    "j10_valid_elsewhere": f"{_AT} select case_id, score from att where attempt = 1 and case_id in (select case_id from att where attempt = 0 and score <= 3)",
    "j11_accept_if_better": f"{_AT} select case_id, attempt, score, accepted from mk",
    "j12_before_after": f"{_AT}, p as (select case_id % 4 as model, avg(cast(strict_valid as int)) filter (attempt = 0) as before, avg(cast(strict_valid as int)) filter (attempt = 1) as after from att group by 1) select *, 100 * (after - before) as change from p",
}
_START = "cast('0x' || left(md5('42:' || {x}), 8) as bigint)"


def picks(test: str, pool: str, k: int) -> str:
    """CTEs up to pk (target, example, position) for tables of test and pool cases (case_id, s)."""
    return f"""bs as (select case_id as example, s, row_number() over (partition by s order by md5('42:' || case_id)) as i from {pool}), ov as (select case_id as example, row_number() over (order by md5('42:' || case_id)) as i from {pool}),
sz as (select s, count(*) as n, row_number() over (order by s) as place from bs group by 1), tg as (select case_id as target, {_START.format(x='case_id')} as start from {test}),
f1 as (select target, example, sz.s, step * 500 + place as o from tg cross join sz cross join (values (0), (1)) v(step) join bs on bs.s = sz.s and bs.i = (start + step) % n + 1 where target <> example),
f2 as (select target, example, o % 500 as o from f1 qualify row_number() over (partition by target, s order by o) = 1),
f3 as (select target, example, 1000 + step as o from tg cross join (select unnest(range({2 * k + 1})) as step) join ov on ov.i = (start + step) % (select count(*) from {pool}) + 1),
pk as (select target, example, row_number() over (partition by target order by min(o), example) as position from (select * from f2 union all select * from f3) where target <> example group by 1, 2 qualify position <= {k})"""


ORACLES["f4_examples_per_target"] = f"{_SPLIT}, te as (select case_id, complexity as s from sp where role = 'test'), po as (select case_id, complexity as s from sp where role = 'pool'), {picks('te', 'po', 4)} select target, example, position from pk"
ORACLES["n8_review_manifest"] = f"""{_DELTA}, it as (select case_id, max(attempt) as attempted, coalesce(max(attempt) filter (accepted and attempt > 0), max(attempt)) as repaired from mk group by 1)
select 'Model ' || case_id % 4 || '!' as model, 'Repair' as method, 'case_' || case_id as case_id, attempted, repaired, before as initial_violations, after as final_violations, cast(it.case_id as varchar) as case_number, 'review/model_' || it.case_id % 4 || '/iteration_' || attempted || '/case_' || it.case_id as review_folder
from it join delta using (case_id) where attempted <= 4"""
_PCT = lambda k, of: f"case when {of} = 0 then 0.0 else 100.0 * {k} / {of} end as {k}_percent"
ORACLES["j5_repair_summary"] = f"""{_DELTA}, {_DIFF.split(B.VG + ',', 1)[1]}, it as (select case_id, max(attempt) as attempted, coalesce(max(attempt) filter (accepted and attempt > 0), max(attempt)) as repaired from mk group by 1),
js as (select case_id % 4 as model, count(*) as n, count(*) filter (before > 0) as initially_invalid, count(*) filter (after = 0) as successful, count(*) filter (before > 0 and after = 0) as recovered, count(*) filter (after < before) as improved, count(*) filter (after > before) as worsened,
count(*) filter (new_kinds <> '') as regressed, {', '.join(f'avg({c}) as mean_{c}' for c in ("before", "after", "reduction", "attempted", "repaired", *CHANGES, "total_change"))}, median(reduction) as median_reduction, median(total_change) as median_total_change from delta join diffs using (case_id) join it using (case_id) group by 1)
select *, {', '.join(_PCT(k, 'n') for k in ("successful", "improved", "worsened", "regressed"))}, {_PCT('recovered', 'initially_invalid')} from js"""
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "fgjn" and n[1:2].isdigit()}
