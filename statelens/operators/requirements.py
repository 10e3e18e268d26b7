"""Requirement texts: sentences, capability clauses, actors, rewriting, audits and rule-based ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelens.functions import text as T


def capable(x):
    """Whether a lower-case clause has a capability verb as a whole word."""
    return F.arrays_overlap(F.regexp_extract_all(x, F.lit("([a-z0-9_]+)"), F.lit(1)), F.array(*[F.lit(v) for v in T.CAPABILITY_VERBS]))



def normalise(x):
    """CR to LF, zero-width space to space, hyphenated line breaks joined, trailing blanks and runs of blank lines cut."""
    x = F.regexp_replace(F.regexp_replace(x, "\r", "\n"), "​", " ")
    x = F.regexp_replace(x, r"([A-Za-z0-9_])-\s*\n\s*([A-Za-z0-9_])", "$1$2")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(key, pos, sentence)."""
    return docs.select("key", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


def ordered_distinct(rows: DataFrame, column: str) -> DataFrame:
    """The first row of each canonical key within a document, blank keys dropped."""
    r = rows.withColumn("_c", T.canonical(column)).where("_c <> ''")
    w = Window.partitionBy("key", "_c").orderBy("pos")
    return r.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_c", "_r")


def capabilities(docs: DataFrame) -> DataFrame:
    """(key, pos, clause): cleaned sentences with a capability verb and no "figure", each once."""
    # cleaning takes words away and adds none, unless it joins what stood around a reference: most sentences need none
    may = lambda s: capable(F.lower(s)) | F.contains(F.lower(s), F.lit("(figure"))
    # cleaned and tested inside the array: what explode gives is not computed again by the conditions above it
    fit = lambda c: (F.length(c["clause"]) > 0) & ~F.contains(F.lower(c["clause"]), F.lit("figure")) & capable(F.lower(c["clause"]))
    some = F.filter(F.transform(T.sentences("text"), lambda s, i: F.struct(i.alias("pos"), s.alias("s"))), lambda x: may(x["s"]))
    clauses = F.transform(some, lambda x: F.struct(x["pos"].alias("pos"), T.clean_clause(x["s"]).alias("clause")))
    return ordered_distinct(docs.select("key", F.inline(F.filter(clauses, fit))), "clause").select("key", "pos", "clause")


def shall(clauses: DataFrame) -> DataFrame:
    """(key, pos, requirement): the clauses in "The system shall" form, each once."""
    return ordered_distinct(clauses.withColumn("requirement", T.to_shall("clause")), "requirement").select("key", "pos", "requirement")


def actors(docs: DataFrame) -> DataFrame:
    """docs' key with the actors named as whole words, in lexicon order; a plural beside its singular is dropped."""
    low = F.lower("text")
    # the plain search comes first: most terms are in few texts
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a)) & low.rlike(rf"(^|[^a-z0-9_]){a}([^a-z0-9_]|$)"), F.lit(a)) for a in T.ACTORS]))
    d = docs.select("key", hits.alias("h"))
    singular = F.filter("h", lambda a: ~(a.endswith("s") & F.array_contains(F.col("h"), F.substring(a, F.lit(1), F.length(a) - 1))))
    return d.select("key", singular.alias("actors"))


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """(key, first, duplicate): later rows whose canonical key occurred before."""
    r = rows.withColumn("_c", T.canonical(column))
    first = F.min("pos").over(Window.partitionBy("key", "_c"))
    return r.withColumn("first", first).where("pos > first").select("key", "first", F.col("pos").alias("duplicate"))


def ambiguities(rows: DataFrame, column: str) -> DataFrame:
    """(key, pos, terms): ambiguous terms contained in a row."""
    hits = F.filter(F.array(*[F.lit(t) for t in T.AMBIGUOUS_TERMS]), lambda t: F.contains(F.lower(column), t))
    return rows.select("key", "pos", hits.alias("terms")).where(F.size("terms") > 0)


def best_overlap(left: DataFrame, right: DataFrame, column_l: str, column_r: str) -> DataFrame:
    """(key, pos, best): greatest Jaccard of each left row's tokens with a right row of its document, 0 without one.

    Rows of one document are compared; tokens are distinct words of over two characters without stopwords.
    """
    tokens = lambda c: T.alnum(c, T.REQUIREMENT_STOPWORDS, 3)
    l = left.select("key", "pos", tokens(column_l).alias("lt"))  # noqa: E741
    r = right.groupBy("key").agg(F.collect_list(tokens(column_r)).alias("rt"))
    j = l.join(r, "key", "left")
    sim = lambda t: F.when((F.size(t) == 0) | (F.size("lt") == 0), F.lit(0.0)).otherwise(T.jaccard("lt", t))
    return j.select("key", "pos", F.coalesce(F.array_max(F.transform("rt", sim)), F.lit(0.0)).alias("best"))


def audit(docs: DataFrame, rewritten: DataFrame) -> DataFrame:
    """(key, duplicates, ambiguities, missing, hallucinations, verdict) of rewritten requirements against their texts."""
    actions = capabilities(docs)
    n = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    missing = best_overlap(actions, rewritten, "clause", "requirement").where("best < 0.2")
    odd = best_overlap(rewritten, actions, "requirement", "clause").where("best < 0.12").join(actions.select("key").distinct(), "key", "left_semi")
    out = docs.select("key")
    for df, name in ((duplicates(rewritten, "requirement"), "duplicates"), (ambiguities(rewritten, "requirement"), "ambiguities"), (missing, "missing"), (odd, "hallucinations")):
        out = out.join(n(df, name), "key", "left")
    out = out.fillna(0)
    total = F.col("duplicates") + F.col("ambiguities") + F.col("missing") + F.col("hallucinations")
    return out.withColumn("verdict", F.when(total > 0, "needs_review").otherwise("pass"))


def summary(docs: DataFrame, n: int = 3) -> DataFrame:
    """(key, summary): the first sentences without "figure"."""
    s = F.filter(T.sentences("text"), lambda x: ~F.contains(F.lower(x), F.lit("figure")))
    return docs.select("key", F.array_join(F.slice(s, 1, n), " ").alias("summary"))


#: Issues of a review from which a document needs one.
MANY_ISSUES = 6


def relaxed_verdict(rewritten: DataFrame, jobs: DataFrame) -> DataFrame:
    """(key, duplicates, review_issues, verdict) of each job by the moderate gate: a job failed, without requirements, with repeated
    ones, or with many issues in its review needs a look; single remarks of the reviewer don't count.

    jobs: key, extraction_error, rewriting_error (texts, null or blank where there was none) and review, a struct of the arrays
    missing_requirements, hallucinations, duplicates and ambiguities, each of which may be null, as may be the struct.
    """
    n = rewritten.groupBy("key").agg(F.count("*").alias("_n"))
    d = duplicates(rewritten, "requirement").groupBy("key").agg(F.count("*").alias("duplicates"))
    j = jobs.join(n, "key", "left").join(d, "key", "left").fillna(0, ["_n", "duplicates"])
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(F.col(f"review.{c}")), F.lit(0)))
    issues = size("missing_requirements") + size("hallucinations") + size("duplicates") + size("ambiguities")
    failed = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    look = failed("extraction_error") | failed("rewriting_error") | (F.col("_n") == 0) | (F.col("duplicates") > 0) | (issues >= MANY_ISSUES)
    return j.select("key", "duplicates", issues.cast("long").alias("review_issues"), F.when(look, "needs_review").otherwise("pass").alias("verdict"))


def case_title(name):
    """A case's title from its id: the number cut off, words between underscores capitalised; the id itself without any word."""
    words = F.trim(F.replace(F.regexp_replace(name, r"^case_[0-9]+_", ""), F.lit("_"), F.lit(" ")))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    return F.when(words == "", name).otherwise(F.array_join(F.transform(F.filter(F.split(words, r"\s+"), lambda w: w != ""), capital), " "))


# The lines of a structured requirement text that other jobs look for, and what stands where nothing is known.
TITLE_END, HEADINGS = " - Polished Requirement Specification", ("Overview", "Operational Context", "Functional Requirements")
NO_OVERVIEW, ACTORS, NO_ACTORS = "Overview is not explicitly stated in the source text.", "Primary actors include ", "Primary actors are not explicitly stated in the source text."
NO_REQUIREMENT = "1. The system shall provide the capabilities described in the source requirement text."


def structured(docs: DataFrame, requirements: DataFrame) -> DataFrame:
    """(key, document) of texts (key, case_name, text): title, overview, actors and the numbered requirements (key, pos,
    requirement), under their headings and with a line of its own where a part has nothing.
    """
    r = requirements.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "requirement"))).alias("r"))
    lines = F.transform("r", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["requirement"]))
    d = docs.select("key", "case_name").join(summary(docs), "key").join(actors(docs), "key").join(r, "key", "left")
    over = F.when(F.coalesce("summary", F.lit("")) == "", NO_OVERVIEW).otherwise(T.ensure_period("summary"))
    who = F.when(F.coalesce(F.size("actors"), F.lit(0)) > 0, F.concat(F.lit(ACTORS), F.array_join("actors", ", "), F.lit("."))).otherwise(F.lit(NO_ACTORS))
    blank = F.lit("")
    parts = F.concat(
        F.array(F.concat(case_title(F.col("case_name")), F.lit(TITLE_END)), blank, F.lit(HEADINGS[0]), over, blank, F.lit(HEADINGS[1]), who, blank, F.lit(HEADINGS[2])),
        F.when(F.col("r").isNull(), F.array(F.lit(NO_REQUIREMENT))).otherwise(lines), F.array(blank),
    )
    return d.select("key", F.array_join(parts, "\n").alias("document"))


def band(x, cuts):
    """1 + the number of ascending cuts that x reaches."""
    return sum(((x >= c).cast("int") for c in cuts), F.lit(1))


def numbered(docs: DataFrame) -> DataFrame:
    """(key, pos, requirement): the lines "1. text" in order, trimmed."""
    lines = F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.regexp_extract(x, r"^\s*[0-9]+\.\s+(.*\S)\s*$", 1))
    return docs.select("key", F.posexplode(F.filter(lines, lambda x: x != "")).alias("pos", "requirement"))


def diagram_words(text):
    """A diagram's text without markers, title, punctuation and keywords."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?i)@startuml|@enduml|title\s+.*", " "), r"['\"{}\[\]():;/_\-]+", " ")
    return F.regexp_replace(body, r"(?i)\b(state|as|entry|exit|do)\b", " ")


def named_states(text):
    """How many states a diagram's text shows: its state lines, or the different ends of its arrows if those are more."""
    ends = F.concat(*[F.regexp_extract_all(text, F.lit(r"(?m)^[^\S\n]*([^\n:]+?)[^\S\n]*-->[^\S\n]*([^\n:]+)"), F.lit(i)) for i in (1, 2)])
    bare = F.transform(ends, lambda x: F.btrim(F.trim(F.regexp_replace(x, r"\[\*\]|\[.+?\]", "")), F.lit('"')))
    return F.greatest(F.regexp_count(text, F.lit(r"(?m)^\s*state\s+")), F.size(F.array_distinct(F.filter(bare, lambda x: x != ""))))


def heuristic_ratings(items: DataFrame, diagrams: DataFrame) -> DataFrame:
    """(key, the four ratings of 1 to 5, covered, total, coverage_percent, terminology_percent, and the facts behind them).

    items: key, pos, requirement; diagrams: key, text. A requirement is covered by a quarter of its stems or three of
    them. A diagram without requirements has a coverage of 0.
    """
    d = diagrams.select(
        "key", T.stems(diagram_words(F.col("text"))).alias("have"), F.regexp_count("text", F.lit("-->")).alias("arrows"), F.col("text").rlike(r"\[\*\]\s*-->").alias("starts"), F.col("text").rlike(r"-->\s*\[\*\]").alias("ends"),
        F.regexp_count("text", F.lit(r"-->[^\n]*\[[^\]]+\]")).alias("guards"), named_states(F.col("text")).alias("states"),
        F.regexp_count("text", F.lit(r"\b[JLFRC][0-9]+\b")).alias("terse"), F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 120)).alias("long_lines"),
    )
    tokens = items.select("key", T.stems("requirement").alias("t"), F.regexp_count(F.lower("requirement"), F.lit(r"\b(if|choose|choice|either|fail|failed|valid|invalid|available|not available)\b")).alias("cues"))
    # a diagram's requirements are those of one case: a short list
    g = tokens.groupBy("key").agg(F.collect_list("t").alias("ts"), F.sum("cues").alias("cues"))
    g = d.join(g, "key", "left").withColumn("ts", F.coalesce("ts", F.array().cast("array<array<string>>"))).fillna(0, ["cues"])

    def met(t):
        hits = F.size(F.array_intersect(t, "have"))
        return (F.size(t) > 0) & ((hits / F.size(t) >= 0.25) | (hits >= 3))

    g = g.withColumn("n", F.size("ts")).withColumn("covered", F.size(F.filter("ts", met))).withColumn("all", F.array_distinct(F.flatten("ts")))
    g = g.withColumn("coverage", T.ratio("covered", "n")).withColumn("shared", T.ratio(F.size(F.array_intersect("all", "have")), F.size("all")))
    g = g.withColumn("completeness", band(F.col("coverage"), (0.35, 0.55, 0.75, 0.90))).withColumn("terminology", band(F.col("shared"), (0.20, 0.34, 0.48, 0.62)))
    less = lambda ok, n=1: F.when(ok, n).otherwise(0)
    correct = 5 - less(~F.col("starts")) - less(~F.col("ends")) - less(F.col("arrows") < F.greatest(F.lit(3), F.floor(F.col("n") / 2)))
    correct = correct - F.when(F.col("completeness") <= 2, 2).when(F.col("completeness") == 3, 1).otherwise(0) - less((F.col("cues") >= 2) & (F.col("guards") == 0))
    clear = 5 - less(F.col("states") > 22) - less(F.col("states") > 35) - less(F.col("terse") >= 3) - less(F.col("long_lines") >= 3) - less(F.col("arrows") < 2)
    clamp = lambda x: F.greatest(F.lit(1), F.least(F.lit(5), x)).cast("int")
    return g.select(
        "key", F.col("completeness").cast("int").alias("completeness"), F.col("terminology").cast("int").alias("terminology"), clamp(correct).alias("correctness"), clamp(clear).alias("understandability"),
        F.col("covered").cast("long").alias("covered"), F.col("n").cast("long").alias("total"), F.round(100 * F.col("coverage"), 1).alias("coverage_percent"), F.round(100 * F.col("shared"), 1).alias("terminology_percent"),
        "arrows", "starts", "ends", "guards", "cues", "states", "terse", "long_lines",
    )


# Fixed order: reasons of a deduction, the first ones are named. The wording is our own.
FLOW = (("not starts", "no start is shown"), ("not ends", "no end is shown"), ("cues >= 2 and guards = 0", "branches carry no guards"), ("arrows < 3", "there are hardly any transitions"))
READING = (("states > 22", "it has many states"), ("terse >= 3", "node names are abbreviated"), ("long_lines >= 3", "labels are very long"))
SCALE = {"completeness": ("hardly any of the requirements", "part of the requirements", "the main requirements", "nearly all requirements", "all requirements that matter"), "terminology": ("other words than the requirements", "few words of the requirements", "some words of the requirements", "mostly the words of the requirements", "the words of the requirements")}


def rating_sheet(ratings: DataFrame, manifest: DataFrame) -> DataFrame:
    """ratings (key, ...) with the manifest's case_id and label, model and method (the label before and after its first
    ``__``), and a sentence for each rating. manifest: key, case_id, label; diagrams that it lacks are left out.
    """
    held = lambda rules: F.array_compact(F.array(*[F.when(F.expr(c), F.lit(t)) for c, t in rules]))
    told = lambda rules, otherwise: F.coalesce(F.nullif(F.array_join(F.slice(held(rules), 1, 2), "; "), F.lit("")), F.lit(otherwise))
    scale = lambda c: F.element_at(F.array(*[F.lit(x) for x in SCALE[c]]), F.col(c))
    parts = F.split("label", "__", 2)
    return ratings.join(manifest.select("key", "case_id", "label"), "key").select(
        "key", "case_id", parts[0].alias("model"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("method"), "completeness", "correctness", "understandability", "terminology", "covered", "total", "coverage_percent", "terminology_percent",
        F.format_string("It models %s: %d of %d.", scale("completeness"), "covered", "total").alias("why_completeness"),
        F.when(F.col("correctness") == 5, "The flow is sound.").otherwise(F.concat(F.lit("In the flow, "), told(FLOW, "some behaviour is not connected"), F.lit("."))).alias("why_correctness"),
        F.when(F.col("understandability") == 5, "It reads well.").otherwise(F.concat(F.lit("To a reader, "), told(READING, "parts are hard to follow"), F.lit("."))).alias("why_understandability"),
        F.format_string("It uses %s.", scale("terminology")).alias("why_terminology"),
    )
