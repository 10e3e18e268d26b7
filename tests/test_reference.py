"""Operators against hand-made cases and published figures."""

import math

import pytest
from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.operators import elements as E
from statelens.operators import ensemble as I
from statelens.operators import graph as G
from statelens.operators import prompts as H
from statelens.operators import ratings as M
from statelens.operators import repair as J
from statelens.operators import sampling as S
from statelens.operators import scoring as D
from statelens.operators import stats as L
from statelens.plans import report_queries as RQ
from statelens.plans import text_queries as TQ
from statelens.sources import files as A

F1 = '@startuml\n[*] --> A\nstate "Alpha" as A\nA --> B : go\nB --> [*]\n@enduml'
F2 = "@startuml\n[*] --> A\n[*] --> B\nA --> B : x\nA --> B : x\nstate Lost\n@enduml"
F3 = "@startuml\ntitle T\nnote left of A\n  X --> Y\nend note\nnote right of A : short\n[*] --> A\nA --> B : user's choice\nA -> C\nstate D : text\nE : text\nB --> [*]\n@enduml"
F4 = "@startuml\nstate c <<choice>>\nstate f <<fork>>\n[*] --> c\nc --> f : [ok]\nc --> Z : retry\nf --> Z\nZ[H] --> [*]\n@enduml"
F5 = "Sure!\n```plantuml\n@startuml\n[*] --> A\nA --> [*]\n@enduml\n```\nDone."


@pytest.fixture(scope="module")
def parsed(spark):
    d = spark.createDataFrame([("F1", F1), ("F2", F2), ("F3", F3), ("F4", F4), ("F5", F5), ("F6", None), ("F7", "")], "diagram_id string, text string")
    el = E.parse(d)
    return el, G.rules(G.graphs(el)).cache()


def kinds(ruled, d):
    return [r.issue for r in G.violations(ruled).where(F.col("diagram_id") == d).orderBy("pos").collect()]


def states(el, d):
    return {r.state for r in el.states.where(F.col("diagram_id") == d).collect()}


def test_alias_order(parsed):
    el, ruled = parsed
    assert states(el, "F1") == {"A", "Alpha", "B"}
    assert [(r.src, r.event, r.dst) for r in el.transitions.where("diagram_id = 'F1'").collect()] == [("Alpha", "go", "B")]
    assert kinds(ruled, "F1") == ["unreachable_states_detected", "unreachable: Alpha, B"]


def test_multiple_initial(parsed):
    assert kinds(parsed[1], "F2") == ["multiple_initial_state_transitions (A, B)", "missing_final_state_transition (state --> [*])", "duplicate_transitions_detected (1)", "orphan_states_detected", "orphan: Lost"]


def test_notes_and_ignored_lines(parsed):
    el, ruled = parsed
    assert states(el, "F3") == {"A", "B", "E"}
    assert [(r.src, r.event, r.dst) for r in el.transitions.where("diagram_id = 'F3'").collect()] == [("A", "user", "B")]
    assert kinds(ruled, "F3") == ["unreachable_states_detected", "unreachable: E", "orphan_states_detected", "orphan: E"]


def test_pseudo_states(parsed):
    el, ruled = parsed
    assert kinds(ruled, "F4") == ["choice_node_without_guarded_outgoing_transitions (c)", "fork_without_multiple_outgoing_branches (f)", "history_state_used_without_composite_state"]
    assert [r.state for r in el.finals.where("diagram_id = 'F4'").collect()] == ["Z"]


def test_answers_and_empty_texts(parsed):
    assert kinds(parsed[1], "F5") == []
    for d in ("F6", "F7"):
        assert kinds(parsed[1], d) == ["missing_initial_state_transition ([*] --> state)", "missing_final_state_transition (state --> [*])"]


def test_issue_list(spark):
    """One issue for each broken node and each parse error, in order; transitions count once, issues each."""
    text = "\n\n@startuml\n\nstate z <<choice>>\nstate b <<choice>>\nstate j <<join>>\n[*] --> [*]\nA --> [H]\n[*] --> A\nA --> z : go\nA --> z : go\nA --> b\nz --> j\nA --> A\n@enduml trailing"
    r = G.rules(E.parse_graphs(spark.createDataFrame([("x", text), ("y", "[*] --> [*]\n@startuml\nA -> B")], "diagram_id string, text string")))
    assert kinds(r, "x") == [
        "candidate_line_6: invalid [*] -> [*] transition", "candidate_line_7: empty src/dst in transition", "missing_final_state_transition (state --> [*])", "duplicate_transitions_detected (1)",
        "choice_node_without_outgoing_transitions (b)", "join_without_multiple_incoming_branches (j)", "choice_node_without_guarded_outgoing_transitions (z)", "history_state_used_without_composite_state",
    ]
    assert kinds(r, "y")[0] == "candidate_line_2: invalid [*] -> [*] transition"
    v = {x.diagram_id: x for x in G.validation(r, spark.createDataFrame([("y", False)], "diagram_id string, syntax_valid boolean")).collect()}
    assert (v["x"].warning_count, v["x"].score, v["x"].transition_count, v["x"].duplicate_transition_count) == (8, 8, 4, 1)
    assert v["y"].score == 1103 and not v["y"].strict_valid
    advice = r.select("diagram_id", H.guidance(F.transform("violations", lambda x: x["issue"])).alias("a"))
    got = {x.diagram_id: x.a for x in advice.collect()}
    known = [t for _, texts in H.GUIDANCE for t in texts]
    assert [known.index(t) for t in got["x"]] == [0, 14, 5, 8, 9, 12, 10, 13] and len(known) == 15
    assert spark.range(1).select(H.guidance(F.array(F.lit("odd"))).alias("a")).first().a == [H.OTHERWISE]


def test_broken_choices_count_one_by_one(spark):
    """Two choice nodes without exits and one duplicate: three warnings, two transitions; one node less is progress."""
    bad = "@startuml\nstate c1 <<choice>>\nstate c2 <<choice>>\n[*] --> A\nA --> c1\nA --> c1\nA --> c2\nc1 --> [*]\n@enduml"
    less = bad.replace("state c2 <<choice>>\n", "")
    r = G.rules(E.parse_graphs(spark.createDataFrame([(0, bad), (1, less)], "diagram_id long, text string")))
    v = {x.diagram_id: x for x in G.validation(r).collect()}
    assert (v[0].warning_count, v[0].transition_count, v[1].score) == (3, 2, 2)
    d = J.violation_delta(r.where("diagram_id = 0").withColumn("k", F.lit(1)), r.where("diagram_id = 1").withColumn("k", F.lit(1)), "k").first()
    assert (d.before, d.after, d.status, d.new_kinds, d.eliminated_kinds) == (3, 2, "improved", "", "")


def test_set_prf(spark):
    p = spark.createDataFrame([("x", k) for k in "abc"], "d string, k string")
    g = spark.createDataFrame([("x", k) for k in "bcd"] + [("y", "a")], "d string, k string")
    r = {x.d: x for x in D.set_prf(p, g, ["d"], ["k"]).collect()}
    assert (r["x"].tp, r["x"].fp, r["x"].fn) == (2, 1, 1) and math.isclose(r["x"].f1, 2 / 3)
    assert (r["y"].precision, r["y"].recall, r["y"].f1) == (0, 0, 0)


def test_event_similarity(spark):
    d = spark.createDataFrame([("", ""), ("go", ""), ("the user logs", "logs"), ("login", "signin")], "a string, b string")
    got = [r[0] for r in d.select(D.event_similarity("a", "b")).collect()]
    assert got == [1.0, 0.7, 1.0, 1.0]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_greedy_matches_brute_force(spark, seed):
    """Names that relax to the same ends stay transitions of their own and go in the order of their names."""
    import difflib
    import random

    rng = random.Random(seed)
    words = ["open door", "close door", "open gate", "pay bill", "send bill now", "retry", "", "the"]
    names = ["a", "A", "b", "B ", "b!"]
    pred, gold = ([("d", i, rng.choice(names), rng.choice(words), rng.choice(names)) for i in range(25)] for _ in range(2))
    schema = "d string, line_no long, src string, event string, dst string"
    got = D.semantic_prf(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema), ["d"]).first()
    tok = lambda e: sorted({T.EVENT_SYNONYMS.get(w, w) for w in e.split() if w != "the"})
    key = lambda n: "".join(c for c in n.lower() if c.isalnum())

    def sim(x, y):
        x, y = tok(x), tok(y)
        if not x or not y:
            return 1.0 if x == y else 0.7
        return 0.7 * len({*x} & {*y}) / len({*x} | {*y}) + 0.3 * difflib.SequenceMatcher(None, " ".join(x), " ".join(y)).ratio()

    p, g = (sorted({(s, t, e) for _, _, s, e, t in rows}) for rows in (pred, gold))
    cand = [(-sim(a[2], b[2]), i, j) for i, a in enumerate(p) for j, b in enumerate(g) if (key(a[0]), key(a[1])) == (key(b[0]), key(b[1])) and sim(a[2], b[2]) >= 0.55]
    used_i, used_j, total = set(), set(), 0.0
    for x, i, j in sorted(cand):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            total -= x
    assert (got.n_pred, got.n_gold, got.tp) == (len(p), len(g), len(used_i)) and math.isclose(got.mean_similarity, total / len(used_i))
    assert len({(key(s), key(t), e) for s, t, e in p}) < len(p)


def test_split_counts(spark):
    d = spark.createDataFrame([(i, "a") for i in range(5)] + [(9, "b")], "case_id long, c string")
    r = {x.c: (x.test, x.pool) for x in S.split_report(S.stratified_split(d, "case_id", "c", 0.5, 1), "c").collect()}
    assert r == {"a": (2, 3), "b": (1, 0)}


def test_ranked_is_a_permutation(spark):
    d = spark.range(500).withColumn("s", F.col("id") % 2)
    r = S.ranked(d, ["s"], S.seeded(7, "id")).collect()
    for s in (0, 1):
        ids = sorted((x.rank, x.id) for x in r if x.s == s)
        assert [i for i, _ in ids] == list(range(1, 251))
        import hashlib

        assert [i for _, i in ids] == sorted([x for x in range(500) if x % 2 == s], key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())


def test_examples_never_show_the_target(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(12)], "k long, s string")
    r = S.pick_examples(d, d, "k", "s", 3, 5).collect()
    assert len(r) == 36 and all(x.target != x.example for x in r)
    by = {}
    for x in r:
        by.setdefault(x.target, {})[x.position] = x.example % 2
    assert all({p[1], p[2]} == {0, 1} for p in by.values())


def test_midranks_and_holm(spark):
    r = L.midranks(spark.createDataFrame([(v,) for v in (1, 2, 2, 3)], "v int"), [], "v").orderBy("v").collect()
    assert [x.midrank for x in r] == [1, 2.5, 4]
    h = L.holm(spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03)], "f string, p double"), ["f"])
    assert [round(x.p_holm, 9) for x in h.orderBy("p").collect()] == [0.03, 0.06, 0.06]


def test_published_chi_square(spark):
    rows = [(m, ok) for m, a, b in (("few", 24, 3), ("rag", 23, 4), ("zero", 16, 11)) for ok, n in ((True, a), (False, b)) for _ in range(n)]
    r = L.chi_square(spark.createDataFrame(rows, "m string, ok boolean"), [], "m", "ok").withColumn("p", L.chi2_sf("chi2", F.col("df").cast("double"))).withColumn("p2", L.chi2_sf_even(F.col("chi2"), F.col("df"))).first()
    assert round(r.chi2, 6) == 8.142857 and r.df == 2 and round(r.p, 8) == 0.01705301 and math.isclose(r.p, r.p2, rel_tol=1e-12)
    rows = [(m, ok) for m, a, b in (("a", 4, 23), ("b", 3, 22 + 2), ("c", 11, 16), ("d", 1, 26)) for ok, n in ((True, a), (False, b)) for _ in range(n)]
    r = L.chi_square(spark.createDataFrame(rows, "m string, ok boolean"), [], "m", "ok").withColumn("p", L.chi2_sf("chi2", F.col("df").cast("double"))).first()
    assert r.df == 3 and 0 < r.p < 0.01


def test_fisher(spark):
    c = spark.createDataFrame([("a", 3, 1), ("b", 1, 3)], "g string, valid long, invalid long")
    r = L.fisher_pairs(c, [], "g").first()
    assert math.isclose(r.p, 34 / 70, rel_tol=1e-9) and r.odds_ratio == 9.0


def test_p_text(spark):
    d = spark.createDataFrame([(0.05,), (1e-9,), (None,), (1.0,)], "p double").select(L.p_text(F.col("p")))
    assert [r[0] for r in d.collect()] == ["0.05", "<1e-8", "", "1"]


def test_percentiles(spark):
    s = spark.createDataFrame([("c", v) for v in (3, 4, 5, 5)], "k string, score int")
    r = M.descriptives(s, ["k"]).first()
    assert (r.q1, r.median, r.q3, r.iqr, r.score_5_count) == (3.75, 4.5, 5.0, 1.25, 2)


def test_closest_pair_and_kappa(spark):
    r = spark.createDataFrame([(1, 1, 5, 5), (1, 2, 1, 2), (1, 3, 4, 5), (2, 1, 3, None), (2, 2, 3, 3)], "item int, rater int, a int, b int")
    p = M.closest_pairs(r, "item", "rater", ["a", "b"]).collect()
    assert [(x["item"], x.rater_a, x.rater_b) for x in p] == [(1, 1, 3)]
    s = spark.createDataFrame([("c", 1, 1), ("c", 2, 2), ("c", 5, 5)], "c string, a int, b int")
    assert M.kappa(s, ["c"]).first().kappa == 1.0


def test_accept_and_remaining(spark):
    a = spark.createDataFrame([("c", i, s) for i, s in enumerate((4, 5, 3, 3))], "c string, attempt int, score int")
    assert [r.accepted for r in J.accepted(a, "c", "attempt", "score").orderBy("attempt").collect()] == [True, False, True, False]
    n = spark.createDataFrame([("m", i, v) for i, v in enumerate((8, 6, 0))], "m string, attempt int, strict_valid int")
    assert [r.denominator for r in J.remaining(n, ["m"], "attempt", F.lit(27)).orderBy("attempt").collect()] == [27, 19, 13]


def test_majority_threshold(spark, parsed):
    g = parsed[1].where("diagram_id in ('F1', 'F3', 'F5')").withColumn("case_id", F.lit(1)).withColumn("model", F.col("diagram_id"))
    kept = I.votes(g)[1]
    assert {(r.kind, r.a) for r in kept.collect()} == {("state", "A"), ("state", "B"), ("final", "B")}
    assert I.plurality_initial(g).first().initial == "A"


def test_diverse_skips_equal_texts(spark, parsed):
    g = I.similarity_keys(parsed[1].where("diagram_id in ('F1', 'F3', 'F5')"))
    g = g.select("diagram_id", "sk", "tk", F.lit(1).alias("case_id"), F.col("diagram_id").alias("model"), F.when(F.col("diagram_id") == "F5", "u").otherwise("t").alias("text"), F.when(F.col("diagram_id") == "F1", 0.9).otherwise(0.5).alias("final"), F.expr("case diagram_id when 'F1' then 1 when 'F3' then 2 else 3 end").alias("rank"))
    assert [r.diagram_id for r in I.diverse(g, 3).orderBy("selection").collect()] == ["F1", "F5"]


def test_clauses(spark):
    d = spark.createDataFrame([("However, users can pay (Figure 2).",), ("To view the list -",), ("Allow login",), ("Carts are kept",), ("AB go",), ("",)], "t string")
    got = [r[0] for r in d.select(T.to_shall("t")).collect()]
    assert got == ["The system shall allow users can pay .", "The system shall view the list.", "The system shall allow login.", "The system shall ensure that carts are kept.", "The system shall support AB go.", ""]


def test_actors_and_guidance(spark):
    from statelens.operators import requirements as O

    d = spark.createDataFrame([(1, "Customers and a customer meet job seekers."), (2, "")], "key int, text string")
    assert [r.actors for r in O.actors(d).orderBy("key").collect()] == [["customer", "job seekers"], []]


def test_answer_json(spark):
    d = spark.createDataFrame([('{"k": 1}',), ('x ```json\n{"k": 2}\n``` y',), ('so {"k": 3} ok',), ("none",), (None,)], "t string")
    got = [r[0] for r in d.select(H.answer_json(F.col("t"), "k int")["k"]).collect()]
    assert got == [1, 2, 3, None, None]


def test_sources(spark, tmp_path):
    case = tmp_path / "dataset" / "case_1_shop"
    case.mkdir(parents=True)
    (case / "raw_requirement.txt").write_text(" buy \n")
    (case / "diagram.puml").write_text(F1)
    run = tmp_path / "runs" / "g__m__few_shot" / "case_1_shop"
    run.mkdir(parents=True)
    for n in ("run_01.puml", "run_01.initial.puml", "run_01.repair_02.puml"):
        (run / n).write_text(F1)
    c = A.read_cases(spark, str(tmp_path / "dataset")).first()
    assert (c.case_id, c.raw_requirement, c.structured_requirement, c.missing_inputs) == ("case_1_shop", "buy", None, ["structured_requirement"])
    d = A.read_diagrams(spark, str(tmp_path / "runs"))
    assert {(r.stage, r.attempt, r.run_index) for r in d.collect()} == {("final", 0, 1), ("initial", 0, 1), ("repair", 2, 1)}
    assert A.finals(d).count() == 1 and A.with_tokens(d, ["few", "g__"]).count() == 3 and A.with_tokens(d, ["rag"]).count() == 0
    assert A.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert {r.a for r in A.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()} == {1, 2}
    ids = ["a__mistral__rag_structural_validation", "a__m__rag__tag", "a__m__rag_validation_generator_critic_repair__x_y", "a__m__rag_structural_validation__x", "a__m__one_shot", "a__m__few_shot__x", "odd", "a__m"]
    got = spark.createDataFrame([(i,) for i in ids], "r string").select(A.decode_run_id(F.col("r")).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in got] == [
        ("Mistral", "RAG + Validation"), ("m", "RAG [tag]"), ("m", "RAG + Repair [x y]"), ("m", "RAG + Validation [x]"), ("m", "One-shot"), ("m", "few_shot__x"), ("odd", "unknown"), ("a__m", "unknown"),
    ]


def test_run_matrix_tags_retrieval_only(spark):
    m = spark.createDataFrame([("open", "mistral")], "model_group string, model_label string")
    tagged = {r.run_id for r in A.run_matrix(m, A.strategies(spark), "_Rules only!").collect()}
    assert "open__mistral__rag__rules_only" in tagged and "open__mistral__zero_shot" in tagged and len(tagged) == 7
    decoded = A.run_matrix(m, A.strategies(spark), "x").select(A.decode_run_id(F.col("run_id"))["method"].alias("m"), "use_rag").collect()
    assert all(r.m.endswith("[x]") == r.use_rag for r in decoded)
    assert {r.run_id for r in A.run_matrix(m, A.strategies(spark), " - ").collect()} == {f"open__mistral__{s[0]}" for s in A.STRATEGIES}


def test_prompt_parts(spark):
    d = spark.createDataFrame([("\n Title \nIntro\nFunctional Requirements\n1. a\n",), ("Title\nFunctional Requirements:\nx ",), (" \n",), (None,), ("functional requirements\na",)], "t string")
    assert [r[0] for r in d.select(H.prompt_ready(F.col("t"))).collect()] == ["Title\n\nFunctional Requirements\n1. a", "Title\nFunctional Requirements:\nx", "", None, "functional requirements\n\nfunctional requirements\na"]
    long = "@startuml\n" + "A --> B : x\n" * 300 + "@enduml"
    c = spark.createDataFrame([(1, 2, "@startuml\nA --> B\n@enduml", " need \n"), (1, 1, long, " need \n")], "case_id int, rank int, text string, requirement string")
    p = H.stacked_prompts(c).first().prompt
    first = p.split("Candidate 1:\n")[1].split("\n\nCandidate 2:")[0]
    assert "Requirement:\nneed\n\nCandidate 1:" in p and len(first) <= 2600 and first.endswith("\n@enduml") and first.startswith("@startuml\nA --> B : x") and "Candidate 2:\n@startuml\nA --> B\n@enduml" in p
    jobs = spark.createDataFrame([(r, "c", 1) for r in ("o__m__zero_shot_validation_generator_critic_repair", "o__m__rag_structural_validation", "o__m__rag_validation_generator_critic_repair__t", "o__m__one_shot_validation_generator_critic_repair")], "run_id string, case_id string, run_index int")
    have = spark.createDataFrame([("o__m__zero_shot", "c", 1, "final", "Z"), ("o__m__rag__t", "c", 1, "final", "R"), ("o__m__rag_structural", "c", 1, "final", "X"), ("o__m__one_shot", "c", 2, "final", "O")], "run_id string, case_id string, run_index int, stage string, text string")
    got = {r.run_id[6:]: (r.base_run_id, r.base_strategy, r.base_text) for r in H.with_base(jobs, have).collect()}
    assert got == {
        "zero_shot_validation_generator_critic_repair": ("o__m__zero_shot", "zero_shot", "Z"), "rag_structural_validation": (None, None, None), "rag_validation_generator_critic_repair__t": ("o__m__rag__t", "rag", "R"),
        "one_shot_validation_generator_critic_repair": (None, None, None),
    }


def test_round_trip(spark, parsed):
    el = parsed[0]
    again = E.parse(G.to_text(G.graphs(el)))
    for a, b in ((el.transitions, again.transitions),):
        rows = lambda df: {(r.diagram_id, r.src, r.event, r.dst) for r in df.collect()}
        assert rows(a) == rows(b)


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_prompts_and_missing_requirements_take_all_texts(spark, sf):
    texts = {r.key: r.text for r in TQ._requirements(spark, sf).collect()}
    prompts = TQ.h3_generation_prompts(spark, sf).collect()
    n = len({r.case_id for r in prompts})
    assert len(prompts) == 6 * n and abs(n - 0.35 * len(texts)) <= 1 and max(map(len, texts.values())) > 1500
    for r in prompts:
        assert "Requirement:\n" + texts[r.case_id] in r.prompt and (r.strategy != "rag" or "to support the requirement:\n" + texts[r.case_id] in r.prompt)
        assert r.strategy != "few_shot" or ("Diagram of example 2:\n@startuml" in r.prompt and r.prompt.endswith("Requirement:\n" + texts[r.case_id]))
    missing = RQ.o12_potential_missing(spark, sf)
    assert {r.key for r in missing.collect()} == set(texts)


def test_concepts_and_requirement_items(spark):
    d = spark.createDataFrame([("The user can sign in",), ("Authenticated users PAY for purchases; view_10 x",), (None,), ("of the",)], "t string")
    assert [r[0] for r in d.select(T.concepts("t")).collect()] == [["login"], ["10", "login", "payment", "purchase", "view"], None, []]
    rows = [
        ("listed", "Title line\n 1) Users can sign in.\n - of the\n* Buy a book. Read it.\n2.no space"), ("prose", "A guest signs\n  the form and\nleaves. It rains!\n\nThe end"), ("blank", " \n"), ("null", None), ("stop", "1. of the\nfree text here\r\nand there"),
    ]
    got = {}
    for r in I.requirement_items(spark.createDataFrame(rows, "key string, text string")).orderBy("key", "item").collect():
        got.setdefault(r.key, []).append(r.tokens)
    assert got == {"listed": [["login"], ["book", "purchase", "view"]], "prose": [["form", "guest", "leaves", "signs"], ["rains"]], "stop": [["free", "here", "text", "there"]]}
    c = I.coverage(I.requirement_items(spark.createDataFrame(rows, "key string, text string")), spark.createDataFrame([("listed", ["login"]), ("blank", ["x"]), ("stop", [])], "key string, tokens array<string>"))
    got = {r.key: (r.items, r.covered, round(r.coverage, 6)) for r in c.collect()}
    assert got == {"listed": (2, 1, round(0.65 / 2 + 0.35 * 0.5, 6)), "blank": (0, 0, 0.0), "stop": (1, 0, 0.0)}


def test_file_round_trips(spark):
    """Names with odd characters, texts with line ends of any kind, empty texts, broken and empty metadata."""
    from statelens.sources import shared

    rows = [("a b/ü=%41+", "run_01.puml", "x\r\ny\n"), ("a:b", "run_02.initial.puml", ""), ("c", "run_03.repair_07.puml", None), ("c", "other.txt", "\n\n")]
    d = spark.createDataFrame(rows, "case_id string, file string, text string")
    root = shared.write_texts(d, shared.folder(spark), ["case_id", "file"])
    back = shared.read_texts(spark, root, ["case_id", "file"])
    assert {tuple(r) for r in back.collect()} == {(a, b, c or "") for a, b, c in rows}
    got = A.diagrams_of(back.withColumn("run_id", F.lit("r")))
    assert {(r.run_index, r.stage, r.attempt) for r in got.collect()} == {(1, "final", 0), (2, "initial", 0), (3, "repair", 7)}
    meta = [("ok", '{\n "status": "ok",\n "attempt_artifacts": [{"stage": "repair", "attempt": 2, "accepted": true}, {"stage": "x", "attempt": 9}, {"stage": "repair"}]}'), ("bad", '{"status": "ok", '), ("list", "[1"), ("empty", ""), ("none", "{}"), ("failed", '{"status": "error"}')]
    root = shared.write_texts(spark.createDataFrame(meta, "k string, text string"), shared.folder(spark), ["k"])
    m = shared.read_metadata(spark, root, A.METADATA, ["k"])
    assert {r.k: (r.status, r.malformed) for r in m.collect()} == {"ok": ("ok", False), "bad": (None, True), "list": (None, True), "empty": (None, True), "none": (None, False), "failed": ("error", False)}
    kept = A.status_gate(spark.createDataFrame([(k,) for k, _ in meta] + [("unknown",)], "k string"), m, ["k"])
    assert {r.k for r in kept.collect()} == {"ok", "unknown"}
    a = A.attempts(m, ["k"])
    assert [(r.k, r.stage, r.attempt, r.accepted, r.strict_valid) for r in a.collect()] == [("ok", "repair", 2, True, False)]
    files = spark.createDataFrame([("ok", 5), ("none", 3), ("failed", 0)], "k string, files long")
    assert {r.k: (r.attempted, r.repaired) for r in J.recorded_iterations(a, files, ["k"]).collect()} == {"ok": (2, 2), "none": (3, 3), "failed": (0, 0)}


def test_voted_graphs(spark):
    """A majority of three; what only the vote names isn't in the diagram; ambiguous starts have no vote."""
    texts = ["@startuml\n[*] --> A\nA --> B : go\nB --> [*]\nstate Lone\n@enduml", "@startuml\n[*] --> A\nA --> B : go\nA --> C\nC --> [*]\nstate Lone\n@enduml", "@startuml\n[*] --> A\n[*] --> B\nB --> A : back\n@enduml", "@startuml\n@enduml"]
    d = spark.createDataFrame([(f"{c}/{i}", c, f"m{i}", t) for c, ts in ((1, texts[:3]), (2, texts[3:])) for i, t in enumerate(ts)], "diagram_id string, case_id long, model string, text string")
    pool = G.rules(E.parse_graphs(d))
    v = {r.case_id: r for r in I.voted_graphs(pool).collect()}
    assert [s.state for s in v[1].states] == ["A", "B", "Lone"] and [tuple(e) for e in v[1].edges] == [("A", "go", "B")] and v[1].inits == ["A"] and v[1].finals == []
    assert (v[2].states, v[2].edges, v[2].inits) == ([], [], [])
    gold = E.parse_graphs(d.where("diagram_id = '1/0'"))
    s = I.ensemble_scores(pool, gold).collect()
    assert [(r.case_id, r.candidate_count, r.vote_threshold, r.state_n_pred, r.state_tp, r.transition_f1) for r in s] == [(1, 3, 2, 2, 2, 1.0)]
    few = {r.case_id: r for r in I.voted_graphs(pool, 1).collect()}
    assert [x.state for x in few[1].states] == ["A", "B", "C", "Lone"] and few[1].finals == ["B", "C"]


def test_battery_on_published_counts(spark):
    """Syntax-valid counts 24/3, 23/4, 16/11 give 8.142857 with p 0.01705301; tied counts and one method don't break it."""
    rows = [("a", m, i < v, i < 2, 1) for m, v, n in (("few", 24, 27), ("rag", 23, 27), ("zero", 16, 27)) for i in range(n)] + [("b", "few", True, False, 3)] * 4
    t = L.battery(spark.createDataFrame(rows, "model string, method string, syntax boolean, strict boolean, faults int"), ["model"], "method", "syntax", "strict", "faults").collect()
    got = {(r.model, r.metric, r.test, r.group_a, r.group_b): r for r in t}
    chi = got["a", "syntax validity", "chi-squared", None, None]
    assert math.isclose(chi.statistic, 8.142857, abs_tol=1e-6) and chi.df == 2 and math.isclose(chi.p, 0.01705301, abs_tol=1e-8) and chi.significant
    kw = got["a", "violation count", "Kruskal-Wallis", None, None]
    assert (kw.statistic, kw.df, kw.significant) == (0.0, 2, False)
    assert got["b", "violation count", "Kruskal-Wallis", None, None].p is None
    fisher = got["a", "syntax validity", "exact pair", "few", "zero"]
    assert math.isclose(fisher.statistic, 24 * 11 / (3 * 16)) and 0 < fisher.p < 0.05
    assert sum(r.test == "Dunn pair" for r in t) == 3 and len(t) == 6 + 6 + 3


def test_iteration_cells(spark):
    a = spark.createDataFrame([("M", 0, True, False)] * 3 + [("M", 0, False, False), ("M", 1, True, True), ("M", 1, False, False)], "model string, attempt int, syntax_valid boolean, strict_valid boolean")
    r = spark.createDataFrame([("M", "1", 0, True, True), ("M", "2", 1, True, True), ("M", "3", 1, True, False), ("M", "4", 5, True, False), ("N", "1", 0, True, False)], "model string, case_number string, attempted int, syntax_valid boolean, strict_valid boolean")
    s = spark.createDataFrame([("M", "1", 4), ("M", "1", 5), ("M", "2", None), ("M", "3", 1)], "model string, case_number string, correctness int")
    t = {x.metric: x for x in J.iteration_table(J.iteration_cells(a, r, s, ["correctness"]), ["M"], [0, 1, 5]).collect()}
    cells = lambda m: [t[m][f"{J.ITERATIONS[i]} | m"] for i in (0, 1, 5)]
    assert cells("Structural validity") == ["25.00% (n=1/4)", "33.33% (n=1/3)", "0.00% (n=0/2)"]
    assert cells("Syntactic validity") == ["75.00% (n=3/4)", "33.33% (n=1/3)", "50.00% (n=1/2)"]
    assert cells("Correctness") == ["4.5 (n=2)", "", ""]


def test_kind_deltas(spark):
    from statelens.operators import validity as K

    v = spark.createDataFrame([("m", x, k) for x, ks in (("t", "aab"), ("r", "aac")) for k in ks], "model string, method string, kind string")
    n = spark.createDataFrame([("m", "t")] * 3 + [("m", "r")] * 2 + [("m", "other"), ("n", "t")], "model string, method string")
    got = {(r.model, r.reference, r.kind): (r.target_percent, r.reference_percent, r.delta, r.status) for r in K.kind_deltas(v, n, ["model"], "method", "t", ["t", "r"]).collect()}
    assert got == {("m", "r", "a"): (66.67, 100.0, -33.33, "mitigated_by_target"), ("m", "r", "b"): (33.33, 0.0, 33.33, "introduced_by_target"), ("m", "r", "c"): (0.0, 50.0, -50.0, "eliminated_by_target")}
