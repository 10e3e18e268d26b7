"""Prompt tables: batch-inference input as data, and the parsing of answers. The wording of the templates is our own."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.functions.small import times
from statelens.operators.elements import boundaries
from statelens.operators.requirements import ordered_distinct

TASK = "Draw one state machine for the requirement below. Answer with a single diagram block between @startuml and @enduml."
CLOSE = "Answer with the diagram only."
# The marks that an issue's lower-cased text is searched for, in their order. The advice is in our own words.
GUIDANCE = (
    (("invalid [*]",), ("A line from [*] to [*] says nothing: let it leave the last state instead.",)),
    (("multiple_initial_state_transitions",), (
        "Only one line may start the whole diagram at [*].",
        "Where a second one stands inside a composite state, start that line at the composite state instead; no choice is needed.",
        "Mend several starts by changing arrows alone: no state is new, nothing else moves.",
    )),
    (("missing_initial_state_transition",), ("Start the first state of the life cycle from [*].",)),
    (("missing_final_state_transition",), ("Let a state in which the process is over lead to [*].",)),
    (("orphan",), ("Tie lone states into the flow as the requirement says, or leave them out.",)),
    (("unreachable",), ("Lead a path from the start to every state that can't be reached, through a choice or its predecessor.",)),
    (("duplicate_transitions",), ("Write each transition once, labels joined.",)),
    (("choice_node_without_outgoing",), ("A choice leads to two states or more.",)),
    (("choice_node_without_guarded",), ("Every arrow that leaves a choice has its [guard].",)),
    (("fork_without_multiple_outgoing",), ("A fork opens two branches or more.",)),
    (("join_without_multiple_incoming",), ("A join closes two branches or more.",)),
    (("history_state_used_without_composite_state",), ("A history mark belongs into a composite state, or goes.",)),
    (("plantuml_syntax_error", "empty src/dst"), ("Make the syntax right before all else, and answer with the diagram alone.",)),
)
OTHERWISE = "Mend what is listed and keep what the requirement means."


def requirement(preferred, raw, structured):
    """The first of the three that isn't blank."""
    full = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(full(preferred), full(raw), full(structured))


_WHITE = " \t\n\r\f\x0b"


def prompt_ready(text):
    """The title (the first line that isn't blank), a blank line and the part from the line ``functional requirements`` on, all
    trimmed; the whole text, trimmed, without such a line. Null stays null.
    """
    strip = lambda x: F.btrim(x, F.lit(_WHITE))
    lines = F.split(strip(text), "\r\n?|\n")
    at = F.array_position(F.transform(lines, lambda x: F.lower(strip(x))), "functional requirements")
    body = strip(F.array_join(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.size(lines)), "\n"))
    # the text is trimmed, so its first line isn't blank
    return F.when(at == 0, strip(text)).when(at > 0, F.concat_ws("\n\n", strip(lines[0]), body))


def generation_prompts(cases: DataFrame, configs: DataFrame, examples: DataFrame, contexts: DataFrame) -> DataFrame:
    """(case_id, run_id, strategy, prompt): zero_shot and few_shot have templates of their own, all else the general one.

    configs is a dimension, whose size is checked; examples: case_id, examples (array of requirement, diagram); contexts:
    case_id, context. A context follows the requirement, which comes first then.
    """
    j = times(cases.join(examples, "case_id", "left").join(contexts, "case_id", "left"), configs.select("run_id", "strategy", "use_rag"))
    number = lambda i: (i + 1).cast("string")
    one = lambda x, i: F.concat(F.lit("Requirement of example "), number(i), F.lit(":\n"), x["requirement"], F.lit("\n\nDiagram of example "), number(i), F.lit(":\n"), x["diagram"])
    shown = F.coalesce(F.nullif(F.array_join(F.transform("examples", one), "\n\n"), F.lit("")), F.lit("There are no examples."))
    head, req = F.lit(TASK), F.concat(F.lit("Requirement:\n"), F.col("requirement"))
    context = F.when(F.col("use_rag") & (F.coalesce("context", F.lit("")) != ""), F.concat(F.lit("Context, to support the requirement:\n"), "context"))
    prompt = (
        F.when(F.col("strategy") == "zero_shot", F.concat_ws("\n\n", head, req))
        .when(F.col("strategy") == "few_shot", F.concat_ws("\n\n", head, shown, req, context))
        .otherwise(F.concat_ws("\n\n", head, req, context, F.lit(CLOSE)))
    )
    return j.select("case_id", "run_id", "strategy", prompt.alias("prompt"))


def guidance(issues):
    """Advice for an array of issue texts: rule by rule for each issue in turn, every advice where it first comes up; the
    default where no rule holds.
    """

    def of(issue):
        low = F.lower(issue)
        rule = lambda marks, texts: F.when(reduce(or_, [F.contains(low, F.lit(m)) for m in marks]), F.array(*map(F.lit, texts)))
        return F.flatten(F.array_compact(F.array(*[rule(m, t) for m, t in GUIDANCE])))

    hits = F.array_distinct(F.flatten(F.transform(issues, of)))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(OTHERWISE)))


def repair_prompts(candidates: DataFrame) -> DataFrame:
    """(diagram_id, prompt) from diagram_id, requirement, text and issues (array)."""
    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    parts = F.concat_ws("\n\n", F.lit("Repair the diagram."), F.concat(F.lit("Requirement:\n"), "requirement"), F.concat(F.lit("Diagram:\n"), "text"), F.concat(F.lit("Issues:\n"), F.coalesce(F.nullif(bullets(F.col("issues")), F.lit("")), F.lit("- none"))), F.concat(F.lit("Advice:\n"), bullets(guidance(F.col("issues")))))
    return candidates.select("diagram_id", parts.alias("prompt"))


STACK_TASK = (
    "Answer the requirement with one state machine, given the candidates below. Take the candidate that fits best as it is, and change of it only what the syntax, a rule of state machines or a missing "
    "part of the requirement demands. Join no two candidates, and add nothing else."
)


def clipped(text, limit: int):
    """A diagram's cleaned text; a longer one than ``limit`` is cut 32 characters before it, right-trimmed, and closed again."""
    whole = F.btrim(boundaries(text), F.lit(_WHITE))
    cut = F.rtrim(F.regexp_replace(F.substring(whole, 1, limit - 32), "[ \\t\\n\\r]+$", ""))
    return F.when(F.length(whole) <= limit, whole).when(cut.endswith("@enduml"), cut).otherwise(F.concat(cut, F.lit("\n@enduml")))


def stacked_prompts(chosen: DataFrame, limit: int = 2600) -> DataFrame:
    """(case_id, prompt) of up to k candidates in rank order, each clipped, under their case's requirement.

    chosen: case_id, rank, text, requirement (the same in all rows of a case).
    """
    g = chosen.groupBy("case_id").agg(F.first("requirement").alias("requirement"), F.array_sort(F.collect_list(F.struct("rank", clipped(F.col("text"), limit).alias("t")))).alias("c"))
    body = F.array_join(F.transform("c", lambda x, i: F.concat(F.lit("Candidate "), (i + 1).cast("string"), F.lit(":\n"), x["t"])), "\n\n")
    return g.select("case_id", F.concat_ws("\n\n", F.lit(STACK_TASK), F.concat(F.lit("Requirement:\n"), F.btrim(F.coalesce("requirement", F.lit("")), F.lit(_WHITE))), body, F.lit(CLOSE)).alias("prompt"))


#: What a repair run's id holds where its base run has only the strategy; runs that only validate have no base.
REPAIRED = r"__(zero_shot|one_shot|few_shot|rag)_validation_generator_critic_repair"


def base_run(run_id):
    """(base_run_id, base_strategy) of a repair run, nulls for any other: its id with the strategy alone, tags kept."""
    base = F.when(run_id.rlike(REPAIRED), F.regexp_replace(run_id, REPAIRED, "__$1"))
    return F.struct(base.alias("base_run_id"), F.nullif(F.regexp_extract(run_id, REPAIRED, 1), F.lit("")).alias("base_strategy"))


def with_base(jobs: DataFrame, diagrams: DataFrame) -> DataFrame:
    """jobs (run_id, case_id, run_index, ...) with base_run_id, base_strategy and base_text: the final diagram of the same case
    and run index that a repair run starts from; all null where there is none, and a first answer is to be generated.
    """
    have = diagrams.where("stage = 'final'").select(F.col("run_id").alias("base_run_id"), "case_id", "run_index", F.col("text").alias("base_text"))
    j = jobs.select("*", base_run(F.col("run_id")).alias("_b")).select(*jobs.columns, "_b.*").join(have, ["base_run_id", "case_id", "run_index"], "left")
    found = lambda c: F.when(F.col("base_text").isNotNull(), F.col(c)).alias(c)
    return j.select(*jobs.columns, found("base_run_id"), found("base_strategy"), "base_text")


def answer_json(text, schema: str):
    """The first that parses: the whole text, a fenced block, from the first brace to the last."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.ltrim(x).startswith("{"), F.from_json(x, schema))
    return F.coalesce(valid(text), valid(fence), valid(braces))


def extraction_prompts(docs: DataFrame) -> DataFrame:
    """(key, prompt): asks for a text's functional requirements, each with a quote, as JSON."""
    ask = "List the functional requirements of the text, each with a short quote that shows it. Invent nothing. Answer as JSON: functional_requirements, a list of requirement and evidence_quote."
    return docs.select("key", F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Text:\n"), "text")).alias("prompt"))


def _payload(rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
    g = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("r"))
    item = (lambda x: x[fields[0]]) if len(fields) == 1 else (lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return g.select("key", F.to_json(F.struct(F.transform("r", item).alias(name))).alias("payload"))


def rewriting_prompts(extracted: DataFrame) -> DataFrame:
    """(key, prompt): asks for extracted requirements (key, pos, requirement, evidence_quote) in "The system shall" form."""
    ask = 'Rewrite each requirement to begin with "The system shall". Keep their number, order and meaning. Answer as JSON: rewritten_requirements, a list of source_requirement and rewritten_requirement.'
    return _payload(extracted, "functional_requirements", ["requirement", "evidence_quote"]).select("key", F.concat_ws("\n\n", F.lit(ask), "payload").alias("prompt"))


def review_prompts(docs: DataFrame, rewritten: DataFrame) -> DataFrame:
    """(key, prompt): asks to check rewritten requirements (key, pos, requirement) against their text."""
    ask = "Check the requirements against the text. Answer as JSON: missing_requirements, hallucinations, duplicates, ambiguities, and overall_assessment, pass or needs_review."
    p = _payload(rewritten, "rewritten_requirements", ["requirement"])
    return docs.join(p, "key").select("key", F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Text:\n"), "text"), "payload").alias("prompt"))


def answer_items(text, name: str, field: str):
    """The texts of an answer's list: its items, or the field of those that are objects; null where nothing parses to an object
    or the name isn't there. Blank items stay blank.
    """
    items = answer_json(text, f"`{name}` array<string>")[name]
    return F.transform(items, lambda x: F.trim(F.when(F.ltrim(x).startswith("{"), F.coalesce(F.get_json_object(x, f"$.{field}"), F.lit(""))).otherwise(F.coalesce(x, F.lit("")))))


def normalised_answers(answers: DataFrame, fallback: DataFrame) -> DataFrame:
    """(key, pos, requirement): answered requirements cleaned and each once, or the extracted ones where none is left.

    answers: key, requirements (array, null where the answer didn't parse); fallback: key, pos, requirement.
    """
    a = answers.select("key", F.posexplode("requirements").alias("pos", "raw")).withColumn("requirement", T.clean_clause("raw"))
    a = ordered_distinct(a, "requirement").select("key", "pos", "requirement")
    return a.unionByName(fallback.select("key", "pos", "requirement").join(a.select("key").distinct(), "key", "left_anti"))


def normalised_rewrites(answers: DataFrame, extracted: DataFrame) -> DataFrame:
    """(key, pos, requirement): rewritten requirements in "The system shall" form and each once, or the extracted ones in that
    form where none is left.

    answers: key, rewritten (array, null where the answer didn't parse); extracted: key, pos, requirement.
    """
    a = answers.select("key", F.posexplode("rewritten").alias("pos", "raw")).where("trim(raw) <> ''").withColumn("requirement", T.to_shall("raw")).where("requirement <> ''")
    rest = extracted.join(a.select("key").distinct(), "key", "left_anti").withColumn("requirement", T.to_shall("requirement")).where("requirement <> ''")
    return ordered_distinct(a.select("key", "pos", "requirement").unionByName(rest.select("key", "pos", "requirement")), "requirement").select("key", "pos", "requirement")
