"""Queries over texts, prompts, ensembles and parsed diagrams (groups A, B, H, I, O, Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.operators import elements as E
from statelens.operators import ensemble as I
from statelens.operators import graph as G
from statelens.operators import prompts as H
from statelens.operators import requirements as O
from statelens.operators import sampling as S
from statelens.plans import bindings as B
from statelens.plans.graph_queries import _RULES
from statelens.sources import files as A


def _texts(spark, sf):
    return G.to_text(B.graph_rows(spark, sf))


def b17_graph_to_text(spark, sf):
    return _texts(spark, sf)


def b12_parsed_transitions(spark, sf):
    """The transitions of the rendered graphs, parsed again."""
    return E.parse(_texts(spark, sf)).transitions.select("diagram_id", "src", "event", "dst")


def b9_parsed_states(spark, sf):
    return E.parse(_texts(spark, sf)).states.select("diagram_id", "state", "is_explicit")


def b15_parsed_ends(spark, sf):
    el = E.parse(_texts(spark, sf))
    return el.initials.select("diagram_id", F.col("target").alias("state"), F.lit("initial").alias("kind")).union(el.finals.select("diagram_id", "state", F.lit("final")))


def b18_element_export(spark, sf):
    g = B.graph_rows(spark, sf)
    return g.select("diagram_id", F.array_join(F.transform("states", lambda s: s["state"]), ",").alias("states"), F.size(F.array_distinct("edges")).cast("long").alias("n_transitions"), F.array_join("inits", ",").alias("initials"), F.array_join("finals", ",").alias("finals"))


def b1_answer_blocks(spark, sf):
    """Model answers with fences around the rendered graphs, cleaned."""
    t = _texts(spark, sf).withColumn("text", F.concat(F.lit("Sure!\n```plantuml\n"), F.col("text"), F.lit("\n```\nDone.")))
    return t.select("diagram_id", E.boundaries(F.col("text")).alias("text"))


def _rich(spark, sf):
    return E.parse(B.rich_texts(spark, sf))


def b9_rich_states(spark, sf):
    """States of texts that use the whole diagram language: declared, described, composite, history, stereotypes (B4 to B11, B13, B14)."""
    return _rich(spark, sf).states.select("diagram_id", "state", "is_explicit", "is_composite", "is_history", F.array_join("stereotypes", ",").alias("stereotypes"))


def b12_rich_transitions(spark, sf):
    return _rich(spark, sf).transitions.select("diagram_id", "src", "event", "dst")


def b15_rich_ends(spark, sf):
    el = _rich(spark, sf)
    ends = el.initials.select("diagram_id", F.col("target").alias("state"), F.lit("initial").alias("kind")).union(el.finals.select("diagram_id", "state", F.lit("final")))
    return ends.union(el.errors.select("diagram_id", F.lit("[*]"), F.regexp_replace("issue", "^candidate_line_[0-9]+: ", "")))


def c1_rich_violations(spark, sf):
    """All rules over parsed texts: missing and double initial states, missing final states, orphans, unreachable states, parse errors."""
    return G.violations(G.rules(E.parse_graphs(B.rich_texts(spark, sf))))


def c11_rich_validation(spark, sf):
    v = G.validation(G.rules(E.parse_graphs(B.rich_texts(spark, sf))))
    return v.select("diagram_id", "warning_count", "initial_state", "duplicate_transition_count", F.array_join("unreachable_states", ", ").alias("unreachable"), "state_count", "transition_count", "strict_valid", "score")


def _pool(spark, sf):
    g = G.rules(B.graph_rows(spark, sf).where("run_index > 0"))
    return g.withColumn("model", F.concat(F.lit("m"), (F.col("run_index") % 3).cast("string")))


def i2_eligible(spark, sf):
    return I.eligible(_pool(spark, sf), 3, ["m1", "m2"]).select("case_id", "diagram_id", "model")


def i3_votes(spark, sf):
    return I.votes(_pool(spark, sf))[1]


def i4_initial_vote(spark, sf):
    return I.plurality_initial(_pool(spark, sf))


def i5_voted_states(spark, sf):
    p = _pool(spark, sf)
    return I.voted_states(I.votes(p)[1], I.plurality_initial(p))


def i6_vote_report(spark, sf):
    return I.vote_report(I.votes(_pool(spark, sf))[0], "state", 5).select("case_id", F.col("a").alias("state"), "votes", F.col("rank").cast("long").alias("rank"))


def i7_structural_scores(spark, sf):
    return _pool(spark, sf).select("diagram_id", F.round(I.structural_score(), 9).alias("structural"))


def i12_quality_scores(spark, sf):
    return _pool(spark, sf).select("diagram_id", F.round(I.quality_score(), 9).alias("quality"))


def i10_pairwise_similarity(spark, sf):
    return I.pairwise_similarity(_pool(spark, sf)).withColumn("similarity", F.round("similarity", 9))


def i11_consensus(spark, sf):
    return I.consensus(_pool(spark, sf)).withColumn("consensus", F.round("consensus", 9))


def _turns(spark, sf):
    c = B.table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return c.where("role = 'user' and next_role = 'assistant'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text", "answer")


def _listed_turns(spark, sf):
    """The users' turns: every third as a numbered list of its sentences under a heading, the others cut over lines after commas."""
    t = _turns(spark, sf)
    n = F.substring_index("key", "/", 1).cast("long") % 3
    lines = F.transform(T.sentences("text"), lambda x, i: F.concat(F.when(i % 2 == 0, F.concat(F.lit(" "), (i + 1).cast("string"), F.lit(") "))).otherwise("- "), x, F.lit(" ")))
    listed = F.array_join(F.concat(F.array(F.lit("Heading of users"), F.lit("* of the")), lines), "\n")
    return t.select("key", F.when(n == 0, listed).otherwise(F.regexp_replace("text", ", ", ",\n ")).alias("text"), F.concat("answer", F.lit(" signin verified")).alias("answer"))


def i8_requirement_items(spark, sf):
    return I.requirement_items(_listed_turns(spark, sf)).select("key", F.col("item").cast("long").alias("item"), F.array_join("tokens", " ").alias("tokens"))


def i9_requirement_coverage(spark, sf):
    t = _listed_turns(spark, sf)
    out = I.coverage(I.requirement_items(t.select("key", "text")), t.select("key", T.concepts("answer").alias("tokens")))
    return out.withColumn("coverage", F.round("coverage", 9))


def _coverage(spark, sf, pool):
    """How far each candidate covers its case's requirement: a sentence for each state of the gold run."""
    handle = F.transform("states", lambda s: F.concat(F.lit("Handle "), F.replace(s["state"], F.lit("_"), F.lit(" ")), F.lit(".")))
    need = B.graph_rows(spark, sf).where("run_index = 0").select("case_id", F.array_join(handle, " ").alias("text"))
    have = pool.select("case_id", F.col("diagram_id").alias("key"), I.candidate_tokens(pool).alias("tokens"))
    items = I.requirement_items(have.select("case_id", "key").join(need, "case_id"))
    return I.coverage(items, have).select(F.col("key").alias("diagram_id"), "coverage")


def _ranked(spark, sf):
    p = _pool(spark, sf)
    scored = p.select("case_id", "diagram_id", I.structural_score().alias("structural"), I.quality_score().alias("quality"))
    scored = scored.join(I.consensus(p), ["case_id", "diagram_id"]).join(_coverage(spark, sf, p), "diagram_id")
    return I.final_ranks(scored)


def i13_final_ranks(spark, sf):
    return _ranked(spark, sf).select("case_id", "diagram_id", F.round("final", 9).alias("final"), F.col("rank").cast("long").alias("rank"))


def i14_diverse_selection(spark, sf):
    k = I.similarity_keys(_pool(spark, sf)).select("diagram_id", "model", "sk", "tk")
    return I.diverse(_ranked(spark, sf).join(k, "diagram_id").join(_texts(spark, sf), "diagram_id"), 3)


def _legacy(spark, sf, errors):
    """The first two candidates of each case, given how many errors each has."""
    p = _pool(spark, sf).withColumn("syntax_valid", F.col("n_dup") == 0).withColumn("error_count", errors).withColumn("transition_count", F.size(F.array_distinct("edges"))).withColumn("state_count", F.size("states"))
    return I.legacy(p.join(_texts(spark, sf), "diagram_id"), 2).select("case_id", "diagram_id", F.col("rank").cast("long").alias("rank"))


def i15_legacy_selection(spark, sf):
    """Every issue that the rules find is an error."""
    return _legacy(spark, sf, F.size("violations"))


def _requirements(spark, sf):
    return B.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text").where("text is not null")


def o2_sentences(spark, sf):
    return O.sentence_rows(_requirements(spark, sf)).select("key", F.col("pos").cast("long").alias("pos"), "sentence")


def o3_clean_clauses(spark, sf):
    s = O.sentence_rows(_requirements(spark, sf))
    return s.select("key", F.col("pos").cast("long").alias("pos"), T.clean_clause("sentence").alias("clause"))


def o5_ordered_distinct(spark, sf):
    return O.ordered_distinct(O.sentence_rows(_requirements(spark, sf)), "sentence").select("key", F.col("pos").cast("long").alias("pos"))


def _actions(spark, sf):
    """The invented prose names no capabilities: sentences made of each row's source and language follow its text."""
    say = F.concat(F.col("text"), F.lit(" However, managers view the "), F.col("source"), F.lit(" list. Users can select "), F.col("lang"), F.lit(" and cancel. Users can select "), F.col("lang"), F.lit(" and cancel."))
    return B.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("key"), say.alias("text"))


def o6_capabilities(spark, sf):
    return O.capabilities(_actions(spark, sf)).select("key", F.col("pos").cast("long").alias("pos"), "clause")


def o7_shall(spark, sf):
    s = O.sentence_rows(_actions(spark, sf)).withColumn("requirement", T.to_shall("sentence"))
    return s.select("key", F.col("pos").cast("long").alias("pos"), "requirement")


def o8_actors(spark, sf):
    d = _requirements(spark, sf).withColumn("text", F.concat(F.col("text"), F.when(F.col("key") % 3 == 0, " Customers and a customer.").when(F.col("key") % 3 == 1, " Job seekers.").otherwise("")))
    return O.actors(d).select("key", F.array_join("actors", ",").alias("actors"))


def o10_duplicates(spark, sf):
    d = O.duplicates(O.sentence_rows(_requirements(spark, sf)), "sentence")
    return d.select("key", F.col("first").cast("long").alias("first"), F.col("duplicate").cast("long").alias("duplicate"))


def o11_ambiguities(spark, sf):
    a = O.ambiguities(O.sentence_rows(_requirements(spark, sf)), "sentence")
    return a.select("key", F.col("pos").cast("long").alias("pos"), F.array_join("terms", ",").alias("terms"))


def o14_audit(spark, sf):
    d = _actions(spark, sf)
    return O.audit(d, O.shall(O.capabilities(d)))


def o15_summary(spark, sf):
    return O.summary(_requirements(spark, sf))


def o16_structured_document(spark, sf):
    """Documents under case names of several forms; every fifth has no requirements, every seventh no text."""
    k = F.col("key")
    name = F.when(k % 4 == 0, F.concat(F.lit("case_"), k.cast("string"), F.lit("_web_SHOP  app_"))).when(k % 4 == 1, F.concat(F.lit("case_"), k.cast("string"), F.lit("_"))).otherwise(F.concat(F.lit("portal_"), k.cast("string")))
    d = _actions(spark, sf).withColumn("case_name", name).withColumn("text", F.when(k % 7 == 0, "").otherwise(F.col("text")))
    return O.structured(d, O.shall(O.capabilities(d.where("key % 5 <> 0"))))


def q1_stems(spark, sf):
    return _requirements(spark, sf).select("key", F.size(T.stems("text")).cast("long").alias("n_stems"), F.md5(F.array_join(F.array_sort(T.stems("text")), " ")).alias("stems_md5"))


def _numbered(spark, sf):
    """Turns as numbered requirements: a line for each sentence of the user's text, and lines without a number."""
    t = _turns(spark, sf)
    lines = F.transform(T.sentences("text"), lambda x, i: F.concat(F.lit(" "), (i + 1).cast("string"), F.lit(". "), x, F.lit("  ")))
    return t.select("key", F.array_join(F.concat(F.array(F.lit("Requirements"), F.lit("1) no number")), lines), "\n").alias("text"))


def q2_numbered_requirements(spark, sf):
    return O.numbered(_numbered(spark, sf)).select("key", F.col("pos").cast("long").alias("pos"), "requirement")


def _rated(spark, sf):
    """The gold runs as rated diagrams: requirements about their states and one thing more."""
    g = B.graph_rows(spark, sf).where("run_index < 3")
    say = F.transform("states", lambda s: F.concat(F.lit("The system shall handle "), F.replace(s["state"], F.lit("_"), F.lit(" ")), F.lit(" when available.")))
    extra = F.when(F.col("case_id") % 2 == 0, F.array(F.lit("The system shall print yearly invoices."), F.lit("The system shall archive printed ledgers."))).otherwise(F.array().cast("array<string>"))
    items = g.select(F.col("diagram_id").alias("key"), F.posexplode(F.concat(say, extra)).alias("pos", "requirement"))
    return O.heuristic_ratings(items, G.to_text(g).select(F.col("diagram_id").alias("key"), "text"))


def q3_heuristic_ratings(spark, sf):
    return _rated(spark, sf).select("key", "completeness", "terminology", "correctness", "understandability", "covered", "total", "coverage_percent", "terminology_percent")


def q7_rating_sheet(spark, sf):
    d = B.event_graphs(spark, sf).diagrams
    m = d.select(F.col("diagram_id").alias("key"), "case_id", F.concat_ws("__", F.concat(F.lit("m"), (F.col("case_id") % 3).cast("string")), F.concat(F.lit("run"), F.col("run_index").cast("string")), F.lit("x")).alias("label"))
    return O.rating_sheet(_rated(spark, sf), m)


def o1_normalised(spark, sf):
    """Texts with carriage returns, a hyphenated line break, trailing blanks and blank lines put in, normalised."""
    d = _requirements(spark, sf)
    rough = F.concat(F.lit(" A"), F.lit("\r"), F.regexp_replace("text", r"\. ", ".\n"), F.lit("  \nhyphen-\n ated\n\n\n\nend\u200bed \n"))
    return d.select("key", F.md5(O.normalise(rough)).alias("normal_md5"))


def h2_prompt_ready(spark, sf):
    """Texts with a title and the line in two forms, and texts where that line has a colon, which makes it none."""
    k = F.col("key") % 4
    line = F.when(k == 0, "Functional Requirements").when(k == 1, "\t functional requirements ").when(k == 2, "Functional Requirements:").otherwise("none")
    d = _requirements(spark, sf).withColumn("text", F.concat(F.lit("\n Title "), F.col("key").cast("string"), F.lit(" \r\nIntro\n"), line, F.lit("\n"), "text", F.lit(" \n\n")))
    return d.select("key", F.md5(H.prompt_ready(F.col("text"))).alias("ready_md5"))


def h3_generation_prompts(spark, sf):
    """Prompts for the test cases: three strategies, two models, examples with their diagrams, the case's own text as context."""
    cases = _requirements(spark, sf).select(F.col("key").alias("case_id"), F.col("text").alias("requirement"))
    models = spark.createDataFrame([("local", "m1"), ("local", "m2")], "model_group string, model_label string")
    kinds = spark.createDataFrame([("zero_shot", False), ("few_shot", False), ("rag", True)], "strategy string, use_rag boolean")
    role = S.stratified_split(cases.select("case_id", F.lit("all").alias("s")), "case_id", "s", 0.35, 42)
    picked = S.pick_examples(role.where("role = 'test'"), role.where("role = 'pool'"), "case_id", "s", 2, 42)
    drawn = cases.select(F.col("case_id").alias("example"), F.struct("requirement", F.concat(F.lit("@startuml\n[*] --> S"), F.col("case_id").cast("string"), F.lit("\n@enduml")).alias("diagram")).alias("x"))
    shown = picked.join(drawn, "example").groupBy(F.col("target").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("position", "x"))).alias("x"))
    examples = shown.select("case_id", F.transform("x", lambda x: x["x"]).alias("examples"))
    context = cases.select("case_id", F.col("requirement").alias("context"))
    return H.generation_prompts(cases.join(role.where("role = 'test'").select("case_id"), "case_id", "left_semi"), A.run_matrix(models, kinds), examples, context)


def h4_repair_prompts(spark, sf):
    p = _pool(spark, sf).join(_texts(spark, sf), "diagram_id").select("diagram_id", F.lit("Follow the flow.").alias("requirement"), "text", F.transform("violations", lambda v: v["issue"]).alias("issues"))
    return H.repair_prompts(p)


def h5_stacked_prompts(spark, sf):
    """The two candidates of each case, made long by a remark in every third, under what the case's gold run says."""
    top = _legacy(spark, sf, F.when(F.col("n_dup") == 0, 0).otherwise(1)).join(_texts(spark, sf), "diagram_id")
    long = F.concat(F.substring_index("text", "\n@enduml", 1), F.repeat(F.lit("\n' remark"), 400), F.lit("\n@enduml"))
    need = B.graph_rows(spark, sf).where("run_index = 0").select("case_id", F.concat(F.lit(" "), F.array_join(F.transform("states", lambda s: F.concat(F.lit("Handle "), s["state"], F.lit("."))), " "), F.lit("\n")).alias("requirement"))
    p = H.stacked_prompts(top.withColumn("text", F.when(F.col("case_id") % 3 == 0, long).otherwise(F.col("text"))).join(need, "case_id"))
    return p.select("case_id", F.length("prompt").alias("length"), F.md5("prompt").alias("prompt_md5"))


def h7_answer_json(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" ok"))).alias("text"))
    return e.select("event_id", H.answer_json(F.col("text"), "k int")["k"].alias("k"))


def _models(spark, sf):
    return B.table(spark, sf, "documents").where("source is not null").select(F.lit("local").alias("model_group"), F.col("source").alias("model_label")).distinct()


def a12_run_matrix(spark, sf):
    """Every source as a model with all strategies, a tag on those that retrieve, and a baseline run."""
    base = spark.createDataFrame([("api", "gpt4o", "zero_shot")], "model_group string, model_label string, strategy string")
    return A.run_matrix(_models(spark, sf), A.strategies(spark), " Rules & Theory! ", base).select("run_id", "strategy", "use_rag", "use_structural_validation", "use_ensemble", "baseline_subset_only")


def _runs(spark, sf):
    """Runs as stored diagrams: run ids of four families and three strategies; first, repair and final stages."""
    d = B.graph_rows(spark, sf).select("case_id", "run_index", "diagram_id")
    family = F.element_at(F.array(*[F.lit(x) for x in ("Qwen2-7b", "llama3", "DeepSeek-r1", "mistral")]), (F.col("case_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("few_shot"), F.lit("rag"), F.lit("rag_repair")), (F.col("case_id") % 3 + 1).cast("int"))
    stage = F.when(F.col("run_index") == 0, "initial").when(F.col("run_index") == 1, "final").otherwise("repair")
    return d.select("diagram_id", F.concat_ws("__", F.lit("local"), family, kind).alias("run_id"), F.col("case_id"), F.lit(1).alias("run_index"), stage.alias("stage"), F.greatest(F.lit(0), F.col("run_index") - 1).alias("attempt"))


def i1_candidate_pools(spark, sf):
    """Candidate pools by listed run ids and by prefix and strategy."""
    r = _runs(spark, sf)
    listed = A.pool_of_runs(r, r.where("run_id like '%Qwen%' or run_id like '%mistral%'").select("run_id").distinct())
    by_name = A.pool_of_strategy(r, {"qwen": "local__Qwen2-7b", "llama": "local__llama3", "deepseek": ""}, "rag")
    return listed.select(F.lit("listed").alias("pool"), "run_id", "diagram_id", "model").union(by_name.select(F.lit("strategy"), "run_id", "diagram_id", "model"))


#: Second parts and methods of run ids: labelled ones, tagged ones, unknown ones.
_TAGS = ("qwen25_7b_instruct", "qwen25_14b_instruct", "mistral", "llama31_8b_instruct", "llama31_70b_instruct", "deepseek_r1_8b", "deepseek_r1_14b", "other")
_METHODS = (
    "zero_shot", "one_shot", "few_shot", "rag", "zero_shot_validation_generator_critic_repair", "one_shot_validation_generator_critic_repair", "few_shot_validation_generator_critic_repair", "rag_structural_validation",
    "rag_validation_generator_critic_repair", "rag__rules_and_theory", "rag_structural_validation__rules_only", "rag_validation_generator_critic_repair__a__b", "zero_shot__tag", "chain", "rag_other__x",
)


def a14_decoded_runs(spark, sf):
    """Run ids made of models and methods by document, decoded; and ids of two parts."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    k = F.col("doc_id")
    run_id = F.when(k % 31 == 0, F.concat_ws("__", F.lit("x"), "source")).otherwise(F.concat_ws("__", "source", pick(_TAGS, k), pick(_METHODS, k)))
    r = B.table(spark, sf, "documents").where("source is not null").select(run_id.alias("run_id")).groupBy("run_id").agg(F.count("*").alias("n"))
    return r.select("run_id", "n", A.decode_run_id(F.col("run_id")).alias("d")).select("run_id", "n", "d.model", "d.method")


def a10_pending(spark, sf):
    d, lab = B.table(spark, sf, "documents").select("doc_id"), B.table(spark, sf, "labels").select("doc_id")
    return A.pending(d, lab, ["doc_id"])


_POOL = f"{B.VG}, pool as (select * from diagrams where run_index > 0), pn as (select case_id, count(*) as n from pool group by 1)"
_EL = """el as (select case_id, diagram_id, 'state' as kind, state as a, '' as b, '' as c from pool join states using (diagram_id)
union all select distinct case_id, diagram_id, 'transition', src, event, dst from pool join transitions using (diagram_id) union all select case_id, diagram_id, 'final', state, '', '' from pool join finals using (diagram_id)),
vt as (select case_id, kind, a, b, c, count(*) as votes from el group by all), kept as (select vt.* from vt join pn using (case_id) where votes >= n // 2 + 1),
ini as (select case_id, target as initial, count(*) as votes from pool join initials using (diagram_id) group by 1, 2), init as (select * from ini qualify row_number() over (partition by case_id order by votes desc, initial) = 1)"""
#: Concept tokens, their words written out for the SQL alone.
_STOP = "'a about after all allow allows an and are as at available be between by can complete completed current different do does during each enable enables end ensure for from if in into is it of on or process provide provides related shall should support supports system that the their then to use user users when where whether with'"
_SAME = """case when t in ('authenticate', 'authenticated', 'authentication', 'signin', 'sign', 'logged') then 'login' when t = 'signout' then 'logout' when t in ('register', 'registered') then 'registration'
 when t in ('validate', 'validated', 'validating', 'verify', 'verified', 'verification') then 'validation' when t in ('pay', 'paid', 'payments') then 'payment' when t in ('purchases', 'buy') then 'purchase' when t in ('choose', 'chosen', 'selected') then 'select'
 when t in ('display', 'show', 'shown', 'read') then 'view' when t = 'finished' then 'finish' when t in ('failure', 'failed', 'fails', 'invalid') then 'fail' when t in ('cancelled', 'canceled') then 'cancel' else t end"""
_TOK = "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= 2 and not list_contains(string_split(" + _STOP + ", ' '), t)), lambda t: " + _SAME + ")))"
_SIM = f"""{_POOL}, sk as (select case_id, diagram_id, list(distinct array_to_string({_TOK.format(x="replace(state, '_', ' ')")}, ' ')) as s from pool join states using (diagram_id) group by 1, 2),
tk as (select case_id, diagram_id, list(distinct array_to_string({_TOK.format(x='src')}, ' ') || '|' || array_to_string({_TOK.format(x='event')}, ' ') || '|' || array_to_string({_TOK.format(x='dst')}, ' ')) as t from pool join transitions using (diagram_id) group by 1, 2),
k as (select sk.case_id, sk.diagram_id, s, coalesce(t, []) as t from sk left join tk using (diagram_id)),
jac as (select a.case_id, a.diagram_id as a, b.diagram_id as b, 0.6::double * len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) + 0.4::double * case when len(a.t) + len(b.t) = 0 then 1.0 else len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) end as similarity from k a join k b on a.case_id = b.case_id and a.diagram_id < b.diagram_id)"""
_SQUEEZE = r"trim(regexp_replace({x}, '[ \t\r\n\f\x0B]+', ' ', 'g'))"
_SENT = rf"""with d as (select doc_id as key, string_split(regexp_replace({_SQUEEZE.format(x='text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) as s from documents where text is not null),
f as (select key, list_filter(s, lambda x: x <> '') as s from d),
sr as (select key, unnest(range(len(s))) as pos, unnest(s) as sentence from f)"""
_CANON = r"trim(regexp_replace(lower(sentence), '[\s_-]+', ' ', 'g'), ' .')"
ORACLES = {
    "b12_parsed_transitions": f"with {B.VG} select distinct diagram_id, src, event, dst from transitions",
    "b9_parsed_states": f"with {B.VG} select diagram_id, state, false as is_explicit from states",
    "b15_parsed_ends": f"with {B.VG} select diagram_id, target as state, 'initial' as kind from initials union all select diagram_id, state, 'final' from finals",
    "b17_graph_to_text": f"""with {B.VG}, t as (select diagram_id, string_agg(src || ' --> ' || dst || ' : ' || event, chr(10) order by src, event, dst) as l from (select distinct diagram_id, src, event, dst from transitions) group by 1)
select i.diagram_id, concat_ws(chr(10), '@startuml', '[*] --> ' || i.target, t.l, f.state || ' --> [*]', '@enduml') as text from initials i join finals f using (diagram_id) left join t using (diagram_id)""",
    "b18_element_export": f"""with {B.VG} select d.diagram_id, (select string_agg(state, ',' order by state) from states s where s.diagram_id = d.diagram_id) as states,
(select count(*) from (select distinct src, event, dst from transitions t where t.diagram_id = d.diagram_id)) as n_transitions, i.target as initials, f.state as finals from diagrams d join initials i using (diagram_id) join finals f using (diagram_id)""",
    "i2_eligible": f"with {_POOL}, m as (select *, 'm' || cast(run_index % 3 as varchar) as model from pool), ok as (select case_id from m group by 1 having count(*) >= 3 and bool_or(model = 'm1') and bool_or(model = 'm2')) select case_id, diagram_id, model from m where case_id in (select case_id from ok)",
    "i3_votes": f"with {_POOL}, {_EL} select * from kept",
    "i4_initial_vote": f"with {_POOL}, {_EL} select * from init",
    "i5_voted_states": f"with {_POOL}, {_EL} select case_id, a as state from kept where kind = 'state' union select case_id, initial from init union select case_id, a from kept where kind = 'transition' union select case_id, c from kept where kind = 'transition'",
    "i6_vote_report": f"with {_POOL}, {_EL} select case_id, a as state, votes, row_number() over (partition by case_id order by votes desc, a) as rank from vt where kind = 'state' qualify rank <= 5",
    "i8_requirement_items": None,
    "o2_sentences": f"{_SENT} select * from sr",
    "o5_ordered_distinct": f"{_SENT}, c as (select key, pos, {_CANON} as c from sr) select key, min(pos) as pos from c where c <> '' group by key, c",
    "o10_duplicates": f"{_SENT}, c as (select key, pos, {_CANON} as c from sr), m as (select key, pos, min(pos) over (partition by key, c) as first from c) select key, first, pos as duplicate from m where pos > first",
    "o11_ambiguities": f"""{_SENT}, h as (select key, pos, array_to_string(list_filter([{', '.join(f"'{t}'" for t in T.AMBIGUOUS_TERMS)}], lambda t: contains(lower(sentence), t)), ',') as terms from sr) select * from h where terms <> ''""",
    "o15_summary": f"{_SENT} select key, coalesce(array_to_string(list_slice(list_filter(s, lambda x: not contains(lower(x), 'figure')), 1, 3), ' '), '') as summary from f",
    "h7_answer_json": "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
    "a12_run_matrix": """with s as (select * from (values ('zero_shot', false, false, false), ('few_shot', false, false, false), ('zero_shot_validation_generator_critic_repair', false, true, true), ('few_shot_validation_generator_critic_repair', false, true, true),
('rag', true, false, false), ('rag_structural_validation', true, true, false), ('rag_validation_generator_critic_repair', true, true, true)) v(strategy, use_rag, use_structural_validation, use_ensemble))
select 'local__' || m.source || '__' || strategy || case when use_rag then '__rules_theory' else '' end as run_id, s.*, false as baseline_subset_only from (select distinct source from documents where source is not null) m cross join s
union all select 'api__gpt4o__zero_shot', 'zero_shot', false, false, false, true""",
    "a14_decoded_runs": """with d as (select doc_id, source, ['Qwen 2.5 7B Instruct', 'Qwen 2.5 14B Instruct', 'Mistral', 'Llama 3.1 8B Instruct', 'Llama 3.1 70B Instruct', 'DeepSeek R1 8B', 'DeepSeek R1 14B', 'other'][doc_id % 8 + 1] as model,
  ['qwen25_7b_instruct', 'qwen25_14b_instruct', 'mistral', 'llama31_8b_instruct', 'llama31_70b_instruct', 'deepseek_r1_8b', 'deepseek_r1_14b', 'other'][doc_id % 8 + 1] as m,
  ['zero_shot', 'one_shot', 'few_shot', 'rag', 'zero_shot_validation_generator_critic_repair', 'one_shot_validation_generator_critic_repair', 'few_shot_validation_generator_critic_repair', 'rag_structural_validation', 'rag_validation_generator_critic_repair',
   'rag__rules_and_theory', 'rag_structural_validation__rules_only', 'rag_validation_generator_critic_repair__a__b', 'zero_shot__tag', 'chain', 'rag_other__x'][doc_id % 15 + 1] as k,
  ['Zero-shot', 'One-shot', 'Few-shot', 'RAG', 'Zero-shot + Repair', 'One-shot + Repair', 'Few-shot + Repair', 'RAG + Validation', 'RAG + Repair',
   'RAG [rules and theory]', 'RAG + Validation [rules only]', 'RAG + Repair [a  b]', 'zero_shot__tag', 'chain', 'rag_other__x'][doc_id % 15 + 1] as method from documents where source is not null)
select case when doc_id % 31 = 0 then 'x__' || source else source || '__' || m || '__' || k end as run_id, count(*) as n, case when doc_id % 31 = 0 then 'x__' || source else model end as model, case when doc_id % 31 = 0 then 'unknown' else method end as method from d group by all""",
    "a10_pending": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "i10_pairwise_similarity": f"with {_SIM} select case_id, a, b, round(similarity, 9) as similarity from jac",
    "i11_consensus": f"with {_SIM}, u as (select case_id, a as diagram_id, similarity from jac union all select case_id, b, similarity from jac) select pool.case_id, pool.diagram_id, round(coalesce(avg(similarity), 1.0), 9) as consensus from pool left join u using (diagram_id) group by 1, 2",
    "h2_prompt_ready": r"""with t as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as end_, regexp_replace(text, '[ \t\n\r]+$', '') as body from documents where text is not null)
select doc_id as key, md5(case when doc_id % 4 < 2 then 'Title ' || doc_id || chr(10) || chr(10) || trim(case when doc_id % 4 = 0 then 'Functional Requirements' else 'functional requirements ' end || chr(10) || body, ' ' || chr(10))
 else trim('Title ' || doc_id || ' ' || chr(13) || chr(10) || 'Intro' || chr(10) || case when doc_id % 4 = 2 then 'Functional Requirements:' else 'none' end || chr(10) || body, ' ' || chr(10)) end) as ready_md5 from t""",
    "b1_answer_blocks": None,
}
_ACT = _SENT.replace("x='text'", "x='text'").replace("from documents where text is not null", "from (select doc_id, text || ' However, managers view the ' || source || ' list. Users can select ' || lang || ' and cancel. Users can select ' || lang || ' and cancel.' as text from documents where text is not null)")
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(sentence, '(?i)\(figures?[^)]*\)', '', 'g')), '([A-Za-z0-9_])\.([0-9]+)\.', '\1. ', 'g'),
 '(?i)^(however|hence|furthermore|therefore|moreover|in addition|on one hand|on the other hand|as a result|before it|next|then|if instead)\s*,?\s*', ''), '(?i)^to\s+', ''), ' :-')"""
_CAP = f"""{_ACT}, cl as (select key, pos, {_CLEAN} as clause from sr), cap as (select key, pos, clause, {_CANON.replace("sentence", "clause")} as c from cl
 where clause <> '' and not contains(lower(clause), 'figure') and regexp_matches(lower(clause), '(^|[^a-z0-9_])({"|".join(T.CAPABILITY_VERBS)})([^a-z0-9_]|$)')), caps as (select key, pos, clause from cap where c <> '' qualify row_number() over (partition by key, c order by pos) = 1)"""
_LF = "case when regexp_matches(left(clause, 2), '^[A-Z]') and not regexp_matches(left(clause, 2), '^[A-Z]([A-Z]|[^A-Za-z])$') then lower(left(clause, 1)) || substr(clause, 2) else clause end"
_PERIOD = "case when x = '' or regexp_matches(x, '[.!?]$') then x else x || '.' end"
_SHALL = f"""{_ACT}, cl as (select key, pos, {_CLEAN} as clause from sr), lf as (select key, pos, clause, lower(clause) as low, {_LF} as l from cl),
sh as (select key, pos, trim(case when clause = '' then '' when starts_with(low, 'the system shall') then clause
 when regexp_matches(low, '^(allow|allows|enable|enables|support|supports|provide|provides|manage|manages|monitor|monitors|track|tracks|detect|detects|verify|verifies|register|registers|log|logs|view|views|create|creates|update|updates|cancel|cancels|search|searches|order|orders|select|selects)([^a-z0-9_]|$)') then 'The system shall ' || l
 when regexp_matches(low, '^(user|users|customer|customers|patient|patients|admin|administrator|driver|citizen|student)([^a-z0-9_]|$)') then 'The system shall allow ' || l
 when regexp_matches(low, '(^|[^a-z0-9_])(is|are|will be|shall be)([^a-z0-9_]|$)') then 'The system shall ensure that ' || l else 'The system shall support ' || l end) as x from lf)"""
ORACLES |= {
    "o3_clean_clauses": f"{_SENT} select key, pos, {_CLEAN} as clause from sr",
    "o6_capabilities": f"{_CAP} select * from caps",
    "o7_shall": f"{_SHALL} select key, pos, {_PERIOD} as requirement from sh",
    "i8_requirement_items": None,
}
_TURN = "with tn as (select conv_id || '/' || turn as key, role, text, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)), u as (select key, text, answer from tn where role = 'user' and next_role = 'assistant')"
_ITEMS = rf"""{_TURN}, sn as (select key, text, answer || ' signin verified' as answer, list_filter(string_split(regexp_replace({_SQUEEZE.format(x='text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from u),
-- a listed turn has its sentences as items; others are cut at their own sentence ends, whatever lines they stand on
ch as (select key, answer, list_filter(case when split_part(key, '/', 1)::bigint % 3 = 0 and len(list_filter(s, lambda x: len({_TOK.format(x='x')}) > 0)) > 0 then s when split_part(key, '/', 1)::bigint % 3 = 0 then ['Heading of users'] else list_transform(string_split(regexp_replace(regexp_replace(replace(text, ', ', ',' || chr(10) || ' '), '\s*\n\s*', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x) end, lambda x: len({_TOK.format(x='x')}) > 0) as c from sn),
it as (select key, answer, unnest(range(len(c))) as item, unnest(list_transform(c, lambda x: {_TOK.format(x='x')})) as t from ch)"""
ORACLES["i8_requirement_items"] = f"{_ITEMS} select key, item, array_to_string(t, ' ') as tokens from it"
ORACLES["i9_requirement_coverage"] = f"""{_ITEMS}, h as (select key, len(t) as n, len(list_intersect(t, {_TOK.format(x='answer')})) as k from it),
hc as (select key, count(*) as items, count(*) filter (k >= (case when n <= 2 then 1 else 2 end) or k / n >= 0.35) as covered, round(0.65::double * count(*) filter (k >= (case when n <= 2 then 1 else 2 end) or k / n >= 0.35) / count(*) + 0.35::double * avg(least(1.0, k / n / 0.45::double)), 9) as coverage from h group by 1)
select key, coalesce(items, 0) as items, coalesce(covered, 0) as covered, coalesce(coverage, 0.0) as coverage from u left join hc using (key)"""
_FACTS = f"""{_RULES}, ks as (select diagram_id, list(kind) as kinds from viol group by 1),
x as (select d.diagram_id, coalesce(k.kinds, []) as kinds, (select count(*) from states s where s.diagram_id = d.diagram_id) as n, (select count(distinct (src, event, dst)) from transitions t where t.diagram_id = d.diagram_id) as m, coalesce(dup.n, 0) as dups
from diagrams d left join ks k using (diagram_id) left join dup using (diagram_id) where d.run_index > 0)"""
_HAS = lambda kind, p: f"case when list_contains(kinds, '{kind}') then {p}::double else 0 end"
ORACLES["i7_structural_scores"] = f"""{_FACTS} select diagram_id, round(greatest(0, least(1, 1 - (case when m = 0 then 0.2::double else 0 end + least(0.1::double, 0.1::double * dups / greatest(m, 1)) + {' + '.join(_HAS(k, v) for k, v in I.KIND_PENALTIES.items())}))), 9) as structural from x"""
ORACLES["i12_quality_scores"] = f"""{_FACTS} select diagram_id, round(greatest(0, least(1, 1 - (case when n < 3 then 0.25::double when n > 30 then least(0.25::double, (n - 30) / 80) else 0 end
+ case when m < greatest(n - 1, 1) then least(0.2::double, (greatest(n - 1, 1) - m) / greatest(n, 5) * 0.2::double) when m > 3 * n then least(0.15::double, (m - 3 * n) / 100) else 0 end + {_HAS('orphan_states', 0.08)} + {_HAS('invalid_choice_node', 0.08)}))), 9) as quality from x"""
ORACLES["o8_actors"] = f"""with d as (select doc_id as key, lower(text || case when doc_id % 3 = 0 then ' Customers and a customer.' when doc_id % 3 = 1 then ' Job seekers.' else '' end) as low from documents where text is not null),
h as (select key, list_filter([{', '.join(f"'{a}'" for a in T.ACTORS)}], lambda a: regexp_matches(low, '(^|[^a-z0-9_])' || a || '([^a-z0-9_]|$)')) as h from d)
select key, coalesce(array_to_string(list_filter(h, lambda a: not (right(a, 1) = 's' and list_contains(h, left(a, length(a) - 1)))), ','), '') as actors from h"""
ORACLES["q1_stems"] = f"""with w as (select doc_id as key, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda t: length(t) > 2 and t not in ({', '.join(f"'{x}'" for x in T.RATING_STOPWORDS)})) as w from documents where text is not null),
s as (select key, list_sort(list_distinct(list_transform(w, lambda t: case when length(t) > 5 and right(t, 3) = 'ing' then left(t, length(t) - 3) when length(t) > 5 and right(t, 2) in ('ed', 'es') then left(t, length(t) - 2) when length(t) > 5 and right(t, 1) = 's' then left(t, length(t) - 1) else t end))) as s from w)
select key, cast(len(s) as bigint) as n_stems, md5(array_to_string(s, ' ')) as stems_md5 from s"""
ORACLES["b1_answer_blocks"] = ORACLES["b17_graph_to_text"].replace("'@enduml') as text", "'@enduml') || chr(10) as text")
ORACLES |= {
    "b9_rich_states": f"with {B.VG}, {B.VRICH} select diagram_id, state, is_explicit, is_composite, is_history, coalesce(stereo, '') as stereotypes from rst",
    "b12_rich_transitions": f"with {B.VG}, {B.VRICH} select diagram_id, src, event, dst from rt",
    "b15_rich_ends": f"with {B.VG}, {B.VRICH} select diagram_id, state, 'initial' as kind from rin union all select diagram_id, state, 'final' from rfi union all select diagram_id, '[*]', 'invalid [*] -> [*] transition' from rn where c = 3",
}
_RICH_RULES = f"""{B.VG}, {B.VRICH},
deg as (select diagram_id, state, sum(i) as n_in, sum(o) as n_out from (select diagram_id, state, 1 as i, 0 as o from rin union all select diagram_id, state, 0, 1 from rfi union all select diagram_id, dst, 1, 0 from rt union all select diagram_id, src, 0, 1 from rt) group by 1, 2),
s as (select rst.*, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out from rst left join deg using (diagram_id, state)),
one as (select diagram_id, min(state) as state from rin group by 1 having count(*) = 1),
seen as (select diagram_id, state from one union select rt.diagram_id, rt.dst from rt join seen on rt.diagram_id = seen.diagram_id and rt.src = seen.state),
far as (select s.diagram_id, string_agg(s.state, ', ' order by s.state) as l from s join one using (diagram_id) where (s.diagram_id, s.state) not in (select diagram_id, state from seen) group by 1),
lone as (select diagram_id, string_agg(state, ', ' order by state) as l from s where is_explicit and n_in + n_out = 0 group by 1),
dups as (select diagram_id, count(*) - count(distinct (src, event, dst)) as n from rt group by 1),
at3 as (select diagram_id, 13 + (select count(*) from states x where x.diagram_id = rn.diagram_id and stereo is not null and state not in ('purchase_3', 'error_0')) + (select 2 * count(*) from states x where x.diagram_id = rn.diagram_id and state = 'signup_3')
  + (select count(*) from states x where x.diagram_id = rn.diagram_id and state = 'view_1') as line from rn where c = 3),
two as (select i.diagram_id, a.name || ', ' || b.name as l from initials i join finals f using (diagram_id) join nm a on a.state = i.target join nm b on b.state = f.state join rn using (diagram_id) where c = 2),
iss as (select diagram_id, 0 as g, '' as st, 0 as k, 'parse_warning' as kind, 'candidate_line_' || line || ': invalid [*] -> [*] transition' as issue from at3
  union all select diagram_id, 1, '', 0, 'missing_initial_state', 'missing_initial_state_transition ([*] --> state)' from rn where c = 1
  union all select diagram_id, 1, '', 0, 'multiple_initial_states', 'multiple_initial_state_transitions (' || l || ')' from two
  union all select diagram_id, 2, '', 0, 'missing_final_state', 'missing_final_state_transition (state --> [*])' from rn where c = 4
  union all select diagram_id, 3, '', 0, 'duplicate_transitions', 'duplicate_transitions_detected (' || n || ')' from dups where n > 0
  union all select diagram_id, 4, '', 0, 'unreachable_states', 'unreachable_states_detected' from far union all select diagram_id, 4, '', 1, 'unreachable_state_detail', 'unreachable: ' || l from far
  union all select diagram_id, 5, '', 0, 'orphan_states', 'orphan_states_detected' from lone union all select diagram_id, 5, '', 1, 'orphan_state_detail', 'orphan: ' || l from lone
  union all select diagram_id, 6, state, 0, 'invalid_choice_node', 'choice_node_without_outgoing_transitions (' || state || ')' from s where stereo = 'choice' and not exists (select 1 from rt where rt.diagram_id = s.diagram_id and rt.src = s.state)
  union all select diagram_id, 6, state, 1, 'invalid_choice_guards', 'choice_node_without_guarded_outgoing_transitions (' || state || ')' from s where stereo = 'choice' and exists (select 1 from rt where rt.diagram_id = s.diagram_id and rt.src = s.state)
  union all select diagram_id, 6, state, 2, 'invalid_fork_node', 'fork_without_multiple_outgoing_branches (' || state || ')' from s where stereo = 'fork' and n_out < 2
  union all select diagram_id, 6, state, 3, 'invalid_join_node', 'join_without_multiple_incoming_branches (' || state || ')' from s where stereo = 'join' and n_in < 2
  union all select diagram_id, 7, '', 0, 'invalid_history_state', 'history_state_used_without_composite_state' from s group by 1 having bool_or(is_history) and not bool_or(is_composite)),
rv as (select diagram_id, row_number() over (partition by diagram_id order by g, st, k) as pos, kind, issue from iss)"""
ORACLES |= {
    "c1_rich_violations": f"with recursive {_RICH_RULES} select * from rv",
    "c11_rich_validation": f"""with recursive {_RICH_RULES}, w as (select diagram_id, count(*) as n from rv group by 1)
select rn.diagram_id, coalesce(w.n, 0) as warning_count, one.state as initial_state, cast(coalesce(dups.n, 0) as bigint) as duplicate_transition_count, coalesce(far.l, '') as unreachable,
(select count(*) from s where s.diagram_id = rn.diagram_id) as state_count, (select count(distinct (src, event, dst)) from rt where rt.diagram_id = rn.diagram_id) as transition_count, coalesce(w.n, 0) = 0 as strict_valid, coalesce(w.n, 0) as score
from rn left join w using (diagram_id) left join one using (diagram_id) left join far using (diagram_id) left join dups using (diagram_id)""",
    "q2_numbered_requirements": rf"""{_TURN}, sn as (select key, list_filter(string_split(regexp_replace({_SQUEEZE.format(x='text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from u)
select key, unnest(range(len(s))) as pos, unnest(list_transform(s, lambda x: trim(x))) as requirement from sn""",
    "o1_normalised": r"""select doc_id as key, md5(trim(regexp_replace(regexp_replace(' A' || chr(10) || replace(text, '. ', '.' || chr(10)) || '  ' || chr(10) || 'hyphenated' || chr(10) || chr(10) || chr(10) || chr(10) || 'end ed ' || chr(10), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) as normal_md5 from documents where text is not null""",
}
_RUNS = f"""{B.VG}, rs as (select diagram_id, case_id, run_index, 'local__' || (['Qwen2-7b', 'llama3', 'DeepSeek-r1', 'mistral'])[case_id % 4 + 1] || '__' || (['few_shot', 'rag', 'rag_repair'])[case_id % 3 + 1] as run_id from diagrams)"""
ORACLES["i1_candidate_pools"] = f"""with {_RUNS} select 'listed' as pool, run_id, diagram_id, case when run_id like '%Qwen%' then 'qwen' else run_id end as model from rs where run_index = 1 and (run_id like '%Qwen%' or run_id like '%mistral%')
union all select 'strategy', run_id, diagram_id, case when run_id like '%Qwen%' then 'qwen' else 'llama' end from rs where run_index = 1 and run_id in ('local__Qwen2-7b__rag', 'local__llama3__rag')"""
_STEM = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9]+'), lambda t: length(t) > 2 and t not in ('a', 'about', 'access', 'after', 'all', 'allow', 'allows', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'can', 'complete', 'do', 'for', 'from', 'if', 'in', 'into', 'is', 'it', 'of', 'on', 'or', 'shall', 'system', 'the', 'their', 'to', 'user', 'users', 'when', 'with')), lambda t: case when length(t) > 5 and right(t, 3) = 'ing' then left(t, length(t) - 3) when length(t) > 5 and right(t, 2) in ('ed', 'es') then left(t, length(t) - 2) when length(t) > 5 and right(t, 1) = 's' then left(t, length(t) - 1) else t end))"
ORACLES["q1_stems"] = f"""with s as (select doc_id as key, list_sort({_STEM.format(x='text')}) as s from documents where text is not null)
select key, cast(len(s) as bigint) as n_stems, md5(array_to_string(s, ' ')) as stems_md5 from s"""
#: Ratings from the runs, not from their texts: a drawn run has one start and one end, its states are its names.
_SHEET = rf"""{B.VG}, gd as (select * from diagrams where run_index < 3),
it as (select diagram_id as key, 'The system shall handle ' || replace(state, '_', ' ') || ' when available.' as q from states join gd using (diagram_id)
  union all select diagram_id, unnest(['The system shall print yearly invoices.', 'The system shall archive printed ledgers.']) from gd where case_id % 2 = 0),
hv as (select diagram_id as key, {_STEM.format(x="string_agg(replace(w, '_', ' '), ' ')")} as have, count(*) filter (k = 's') as states from (select diagram_id, state as w, 's' as k from states join gd using (diagram_id) union all select diagram_id, event, 't' from transitions join gd using (diagram_id)) group by 1),
ar as (select diagram_id as key, 2 + (select count(*) from (select distinct src, event, dst from transitions t where t.diagram_id = gd.diagram_id)) as arrows from gd),
tk as (select key, {_STEM.format(x='q')} as t from it),
sc as (select key, any_value(states) as states, count(*) as total, count(*) filter (len(list_intersect(t, have)) / len(t) >= 0.25 or len(list_intersect(t, have)) >= 3) as covered, list_distinct(flatten(list(t))) as every, any_value(have) as have, count(*) filter (contains(array_to_string(t, ' '), 'available')) as cues from tk join hv using (key) group by 1),
r0 as (select *, covered / total as cr, len(list_intersect(every, have)) / len(every) as tr from sc join ar using (key)),
r1 as (select *, 1 + (cr >= 0.35)::int + (cr >= 0.55)::int + (cr >= 0.75)::int + (cr >= 0.9)::int as completeness, 1 + (tr >= 0.2)::int + (tr >= 0.34)::int + (tr >= 0.48)::int + (tr >= 0.62)::int as terminology from r0),
rd as (select *, greatest(1, 5 - (arrows < greatest(3, total // 2))::int - case when completeness <= 2 then 2 when completeness = 3 then 1 else 0 end) as correctness, 5 - (states > 22)::int - (arrows < 2)::int as understandability from r1 join (select diagram_id as key, case_id, run_index from gd) g2 using (key))"""
ORACLES["q3_heuristic_ratings"] = f"with {_SHEET} select key, completeness, terminology, correctness, understandability, covered, total, round(100 * cr, 1) as coverage_percent, round(100 * tr, 1) as terminology_percent from rd"
_OF = lambda c: f"([{', '.join(repr(x) for x in O.SCALE[c])}])[{c}]"
ORACLES["q7_rating_sheet"] = f"""with {_SHEET} select key, case_id, 'm' || (case_id % 3) as model, 'run' || run_index || '__x' as method, completeness, correctness, understandability, terminology, covered, total, round(100 * cr, 1) as coverage_percent, round(100 * tr, 1) as terminology_percent,
'It models ' || {_OF('completeness')} || ': ' || covered || ' of ' || total || '.' as why_completeness,
case when correctness = 5 then 'The flow is sound.' else 'In the flow, ' || coalesce(nullif(array_to_string(list_filter([case when arrows < 3 then 'there are hardly any transitions' end], lambda x: x is not null), '; '), ''), 'some behaviour is not connected') || '.' end as why_correctness,
case when understandability = 5 then 'It reads well.' else 'To a reader, ' || case when states > 22 then 'it has many states' else 'parts are hard to follow' end || '.' end as why_understandability, 'It uses ' || {_OF('terminology')} || '.' as why_terminology from rd"""
_LEGACY = lambda errors: f"""{_FACTS}, t as (select diagram_id, string_agg(src || '>' || dst || ':' || event, chr(10) order by src, event, dst) as l from (select distinct diagram_id, src, event, dst from transitions) group by 1),
p as (select d.case_id, d.diagram_id, concat_ws(chr(10), i.target, t.l, f.state) as text, x.m, x.n, x.dups = 0 as valid, {errors} as errors from diagrams d join x using (diagram_id) join initials i using (diagram_id) join finals f using (diagram_id) left join t using (diagram_id)),
one as (select * from p qualify row_number() over (partition by case_id, text order by valid desc, errors, m desc, n desc, diagram_id) = 1)
select case_id, diagram_id, row_number() over (partition by case_id order by valid desc, errors, m desc, n desc, diagram_id) as rank from one qualify rank <= 2"""  # noqa: E731
ORACLES["i15_legacy_selection"] = _LEGACY("len(x.kinds)")
_FINAL = f"""{_FACTS}, {_SIM.split(B.VG, 1)[1].lstrip(', ')}, u as (select case_id, a as diagram_id, similarity from jac union all select case_id, b, similarity from jac),
co as (select pool.case_id, pool.diagram_id, coalesce(avg(similarity), 1.0) as consensus from pool left join u using (diagram_id) group by 1, 2),
st as ({ORACLES["i7_structural_scores"].split(_FACTS, 1)[1].replace("round(", "(", 1).replace(", 9) as structural", ") as structural")}),
ql as ({ORACLES["i12_quality_scores"].split(_FACTS, 1)[1].replace("round(", "(", 1).replace(", 9) as quality", ") as quality")}),
need as (select case_id, {_TOK.format(x="'handle ' || replace(state, '_', ' ')")} as t from diagrams join states using (diagram_id) where run_index = 0),
said as (select case_id, diagram_id, {_TOK.format(x="string_agg(w, ' ')")} as h from (select case_id, diagram_id, state as w from pool join states using (diagram_id) union all select case_id, diagram_id, event from pool join transitions using (diagram_id)) group by 1, 2),
hh as (select diagram_id, len(t) as n, len(list_intersect(t, h)) as k from need join said using (case_id)),
cv as (select diagram_id, least(1, greatest(0, 0.65::double * count(*) filter (k >= (case when n <= 2 then 1 else 2 end) or k / n >= 0.35) / count(*) + 0.35::double * avg(least(1.0, k / n / 0.45::double)))) as coverage from hh group by 1),
fr as (select co.case_id, co.diagram_id, 0.35::double * structural + 0.30::double * coverage + 0.20::double * consensus + 0.15::double * quality as final, coverage, structural, quality from co join st using (diagram_id) join ql using (diagram_id) join cv using (diagram_id))"""
ORACLES["i13_final_ranks"] = f"{_FINAL} select case_id, diagram_id, round(final, 9) as final, row_number() over (partition by case_id order by round(final, 9) desc, round(coverage, 9) desc, round(structural, 9) desc, round(quality, 9) desc, diagram_id) as rank from fr"
ORACLES = {k: v for k, v in ORACLES.items() if v}
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "abchioq" and n[1:2].isdigit()}
