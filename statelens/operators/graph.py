"""Diagram graphs: element tables, structural rules and validation, one shuffle per step.

``Elements`` are flat tables keyed by diagram_id; ``graphs`` nests them into a row for each diagram, and
the rules are expressions on that row. A diagram is bounded by its own text, so its arrays are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Elements:
    """diagrams(diagram_id, ...), states(diagram_id, state, is_explicit, is_composite, is_history, stereotypes),
    transitions(diagram_id, line_no, src, event, dst), initials(diagram_id, line_no, target), finals(diagram_id, state),
    errors(diagram_id, line_no, issue).
    """

    diagrams: DataFrame
    states: DataFrame
    transitions: DataFrame
    initials: DataFrame
    finals: DataFrame
    errors: DataFrame | None = None


# Issue text prefixes and their kinds, in order.
ISSUE_KINDS = (
    (r"^missing_initial_state_transition", "missing_initial_state"),
    (r"^multiple_initial_state_transitions", "multiple_initial_states"),
    (r"^missing_final_state_transition", "missing_final_state"),
    (r"^duplicate_transitions_detected", "duplicate_transitions"),
    (r"^unreachable_states_detected", "unreachable_states"),
    (r"^unreachable:", "unreachable_state_detail"),
    (r"^orphan_states_detected", "orphan_states"),
    (r"^orphan:", "orphan_state_detail"),
    (r"^choice_node_without_outgoing_transitions", "invalid_choice_node"),
    (r"^choice_node_without_guarded_outgoing_transitions", "invalid_choice_guards"),
    (r"^fork_without_multiple_outgoing_branches", "invalid_fork_node"),
    (r"^join_without_multiple_incoming_branches", "invalid_join_node"),
    (r"^history_state_used_without_composite_state", "invalid_history_state"),
    (r"^candidate_line_[0-9]+:", "parse_warning"),
    (r"^plantuml_syntax_error", "plantuml_syntax_error"),
    (r"^plantuml_command_not_found", "plantuml_check_unavailable"),
)
DETAIL_KINDS = ("unreachable_state_detail", "orphan_state_detail")


def issue_kind(issue):
    """The kind of an issue's text; unknown texts become a slug."""
    clean = F.trim(issue)
    slug = F.btrim(F.regexp_replace(F.lower(clean), "[^a-z0-9]+", "_"), F.lit("_"))
    out = F.when(slug == "", "unknown").otherwise(slug)
    for pattern, kind in reversed(ISSUE_KINDS):
        out = F.when(clean.rlike(pattern), kind).otherwise(out)
    return out


def countable(violations: DataFrame) -> DataFrame:
    """Violations without the kinds that only detail another."""
    return violations.where(~F.col("kind").isin(*DETAIL_KINDS))


def graphs(el: Elements) -> DataFrame:
    """One row for each diagram: states, edges and inits (lists in line order, duplicates kept), finals, errors (issue texts)."""
    kinds = {
        "s": "struct<state:string,is_explicit:boolean,is_composite:boolean,is_history:boolean,stereotypes:array<string>>", "e": "struct<line_no:bigint,src:string,event:string,dst:string>",
        "i": "struct<line_no:bigint,target:string>", "f": "string", "x": "struct<line_no:bigint,issue:string>",
    }

    def part(df, key=None, expr=None):
        return df.select("diagram_id", *[F.expr(f"cast({expr if k == key else 'null'} as {t})").alias(k) for k, t in kinds.items()])

    parts = [
        part(el.diagrams), part(el.states, "s", "struct(state, is_explicit, is_composite, is_history, stereotypes)"), part(el.transitions, "e", "struct(line_no, src, event, dst)"),
        part(el.initials, "i", "struct(line_no, target)"), part(el.finals, "f", "state"),
    ]
    if el.errors is not None:
        parts.append(part(el.errors, "x", "struct(line_no, issue)"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    g = rows.groupBy("diagram_id").agg(
        F.array_sort(F.collect_set("s")).alias("states"), F.array_sort(F.collect_list("e")).alias("lines"),
        F.transform(F.array_sort(F.collect_list("i")), lambda i: i["target"]).alias("inits"), F.array_sort(F.collect_set("f")).alias("finals"), F.transform(F.array_sort(F.collect_list("x")), lambda x: x["issue"]).alias("errors"),
    )
    return g.withColumn("edges", F.transform("lines", lambda e: F.struct(e["src"].alias("src"), e["event"].alias("event"), e["dst"].alias("dst")))).drop("lines")


def reachable(edges, start, rounds):
    """Expression: the states that the edges reach from start in at most ``rounds`` steps; it rests once a step adds none."""
    more = lambda seen: F.array_union(seen, F.transform(F.filter(edges, lambda e: F.array_contains(seen, e["src"])), lambda e: e["dst"]))

    def step(acc, _):
        grown = F.transform(F.array(more(acc["seen"])), lambda m: F.struct(m.alias("seen"), (F.size(m) == F.size(acc["seen"])).alias("done")))
        return F.when(acc["done"], acc).otherwise(F.get(grown, F.lit(0)))

    begin = F.struct(F.array(start).alias("seen"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), begin, step, lambda acc: acc["seen"])


def rules(g: DataFrame) -> DataFrame:
    """g with ``violations`` (array of kind, issue), duplicate count, initial_state, unreachable and orphan states.

    An entry is one issue, in the order in which a validator reports them: parse errors by line, ends, duplicates, what can't
    be reached and what is connected with nothing (each with a line that lists the states), then the broken nodes by state.
    """
    names = F.transform("states", lambda s: s["state"])
    into = lambda s: F.size(F.filter("inits", lambda i: i == s["state"])) + F.size(F.filter("edges", lambda e: e["dst"] == s["state"]))
    out = lambda s: F.array_contains("finals", s["state"]).cast("int") + F.size(F.filter("edges", lambda e: e["src"] == s["state"]))
    leaving = lambda s: F.filter("edges", lambda e: e["src"] == s["state"])
    one = F.size("inits") == 1
    history = F.col("history") if "history" in g.columns else F.exists("states", lambda s: s["is_history"])
    g = (
        g.withColumn("n_dup", F.size("edges") - F.size(F.array_distinct("edges")))
        .withColumn("initial_state", F.when(one, F.try_element_at("inits", F.lit(1))))
        .withColumn("unreachable", F.when(one, F.array_sort(F.array_except(names, reachable(F.col("edges"), F.get("inits", F.lit(0)), F.size("states"))))).otherwise(F.array().cast("array<string>")))
        .withColumn("orphans", F.array_sort(F.transform(F.filter("states", lambda s: s["is_explicit"] & (into(s) == 0) & (out(s) == 0)), lambda s: s["state"])))
    )
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    entry = lambda kind, issue: F.struct(F.lit(kind).alias("kind"), issue.alias("issue"))
    when = lambda ok, kind, issue: F.when(ok, entry(kind, issue))
    of_diagram = F.array(
        when(F.size("inits") == 0, "missing_initial_state", F.lit("missing_initial_state_transition ([*] --> state)")),
        when(F.size("inits") > 1, "multiple_initial_states", text("multiple_initial_state_transitions (", F.array_join("inits", ", "), ")")),
        when(F.size("finals") == 0, "missing_final_state", F.lit("missing_final_state_transition (state --> [*])")),
        when(F.col("n_dup") > 0, "duplicate_transitions", text("duplicate_transitions_detected (", F.col("n_dup"), ")")),
        when(F.size("unreachable") > 0, "unreachable_states", F.lit("unreachable_states_detected")),
        when(F.size("unreachable") > 0, "unreachable_state_detail", text("unreachable: ", F.array_join("unreachable", ", "))),
        when(F.size("orphans") > 0, "orphan_states", F.lit("orphan_states_detected")),
        when(F.size("orphans") > 0, "orphan_state_detail", text("orphan: ", F.array_join("orphans", ", "))),
    )

    def of_state(s):
        is_a = lambda kind: F.array_contains(s["stereotypes"], kind)
        open_ = F.exists(leaving(s), lambda e: ~F.ltrim(F.coalesce(e["event"], F.lit(""))).startswith("["))
        return F.array(
            when(is_a("choice") & (F.size(leaving(s)) == 0), "invalid_choice_node", text("choice_node_without_outgoing_transitions (", s["state"], ")")),
            when(is_a("choice") & open_, "invalid_choice_guards", text("choice_node_without_guarded_outgoing_transitions (", s["state"], ")")),
            when(is_a("fork") & (out(s) < 2), "invalid_fork_node", text("fork_without_multiple_outgoing_branches (", s["state"], ")")),
            when(is_a("join") & (into(s) < 2), "invalid_join_node", text("join_without_multiple_incoming_branches (", s["state"], ")")),
        )

    marked = F.array_sort(F.filter("states", lambda s: F.size(s["stereotypes"]) > 0))
    past = when(history & ~F.exists("states", lambda s: s["is_composite"]), "invalid_history_state", F.lit("history_state_used_without_composite_state"))
    errors = F.transform("errors", lambda x: entry("parse_warning", x))
    return g.withColumn("violations", F.concat(errors, F.array_compact(F.concat(of_diagram, F.flatten(F.transform(marked, of_state)), F.array(past)))))


def violations(ruled: DataFrame) -> DataFrame:
    """(diagram_id, pos, kind, issue): a row for each issue, in order from 1."""
    return ruled.select("diagram_id", F.posexplode("violations").alias("pos", "v")).select("diagram_id", (F.col("pos") + 1).cast("long").alias("pos"), "v.kind", "v.issue")


def counted(violations_):
    """Expression: the kinds of an array of violations that count, those that only detail another left out."""
    return F.transform(F.filter(violations_, lambda v: ~v["kind"].isin(*DETAIL_KINDS)), lambda v: v["kind"])


def repair_score(syntax_valid, warnings, errors=None):
    """1000 for an invalid diagram, 100 for each error (one, where only validity is known) and 1 for each warning."""
    errors = F.when(syntax_valid, 0).otherwise(1) if errors is None else errors
    return (F.when(syntax_valid, 0).otherwise(1000) + 100 * errors + warnings).cast("long")


def validation(ruled: DataFrame, syntax: DataFrame | None = None) -> DataFrame:
    """One row for each diagram: flags, numbers of issues, of states and of distinct transitions, initial state, unreachable
    states and the repair score. syntax: (diagram_id, syntax_valid); valid where absent.
    """
    v = ruled.select(
        "diagram_id", F.size("violations").cast("long").alias("warning_count"), "initial_state", F.col("n_dup").cast("long").alias("duplicate_transition_count"),
        F.col("unreachable").alias("unreachable_states"), F.size("states").cast("long").alias("state_count"), F.size(F.array_distinct("edges")).cast("long").alias("transition_count"),
    )
    v = v.join(syntax, "diagram_id", "left") if syntax is not None else v.withColumn("syntax_valid", F.lit(True))
    v = v.withColumn("syntax_valid", F.coalesce("syntax_valid", F.lit(True)))
    return v.withColumn("strict_valid", F.col("syntax_valid") & (F.col("warning_count") == 0)).withColumn("score", repair_score(F.col("syntax_valid"), F.col("warning_count")))


def to_text(g: DataFrame) -> DataFrame:
    """(diagram_id, text): initial, sorted distinct transitions, sorted finals; names that aren't identifiers are quoted."""
    quote = lambda s: F.when(s.rlike("^[A-Za-z_][A-Za-z0-9_.-]*$"), s).otherwise(F.concat(F.lit('"'), s, F.lit('"')))
    lines = F.concat(
        F.array(F.lit("@startuml")),
        F.transform("inits", lambda i: F.concat(F.lit("[*] --> "), quote(i))),
        F.transform(F.array_sort(F.array_distinct("edges")), lambda e: F.concat(quote(e["src"]), F.lit(" --> "), quote(e["dst"]), F.when(F.coalesce(e["event"], F.lit("")) == "", "").otherwise(F.concat(F.lit(" : "), e["event"])))),
        F.transform("finals", lambda s: F.concat(quote(s), F.lit(" --> [*]"))),
        F.array(F.lit("@enduml")),
    )
    return g.select("diagram_id", F.array_join(lines, "\n").alias("text"))
