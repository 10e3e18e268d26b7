"""String and token expressions: the named tokenizers, cleanup chains and set ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statelens.functions.lexicon import (  # noqa: F401
    ACTORS, AMBIGUOUS_TERMS, CAPABILITY_VERBS, CONCEPT_STOPWORDS, CONCEPT_SYNONYMS, CONNECTIVES, DOMAIN_TERMS, EVENT_STOPWORDS, EVENT_SYNONYMS, RATING_STOPWORDS, REQUIREMENT_STOPWORDS, SHALL_ACTORS, SHALL_COPULAS, SHALL_VERBS,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x) -> Column:
    """Retrieval tokenizer: distinct lower-case ASCII words of a letter and one or more word characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z][a-z0-9_]+)"), F.lit(1)))


def alnum(x, stopwords=(), least: int = 1) -> Column:
    """Distinct lower-case runs of a-z and 0-9 of ``least`` characters that aren't stopwords."""
    out = F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z0-9]+)"), F.lit(1))
    if stopwords:
        out = F.filter(out, lambda t: ~t.isin(*stopwords))
    return F.array_distinct(F.filter(out, lambda t: F.length(t) >= least) if least > 1 else out)


def event_tokens(x) -> Column:
    """Canonical event tokens: stopwords dropped, synonyms mapped, sorted and distinct."""
    synonyms = F.create_map(*[F.lit(v) for kv in EVENT_SYNONYMS.items() for v in kv])
    raw = F.filter(F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: ~t.isin(*EVENT_STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(raw, lambda t: F.coalesce(F.try_element_at(synonyms, t), t))))


def concepts(x) -> Column:
    """Concept tokens: runs of two or more of a-z and 0-9 that aren't stopwords, synonyms mapped, sorted and distinct."""
    synonyms = F.create_map(*[F.lit(v) for kv in CONCEPT_SYNONYMS.items() for v in kv])
    raw = F.filter(F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: (F.length(t) >= 2) & ~t.isin(*CONCEPT_STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(raw, lambda t: F.coalesce(F.try_element_at(synonyms, t), t))))


def stems(x) -> Column:
    """Rating tokenizer: letters-first words of over two characters, stopwords dropped, one suffix cut off long ones."""
    raw = F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z][a-z0-9]+)"), F.lit(1))
    raw = F.filter(raw, lambda t: (F.length(t) > 2) & ~t.isin(*RATING_STOPWORDS))

    def cut(t):
        long = F.length(t) > 5
        short = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
        return F.when(long & t.endswith("ing"), short(3)).when(long & t.endswith("ed"), short(2)).when(long & t.endswith("es"), short(2)).when(long & t.endswith("s"), short(1)).otherwise(t)

    return F.array_distinct(F.transform(raw, cut))


def jaccard(a, b, both_empty: float = 1.0) -> Column:
    """Intersection over union of two arrays of distinct values; both_empty where neither has any."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ratio(num, den, empty=0.0) -> Column:
    """num / den as double, ``empty`` where den is 0 or null."""
    num, den = _c(num), _c(den)
    return F.when(F.coalesce(den, F.lit(0)) == 0, F.lit(empty)).otherwise(num / den)


def state_key(x) -> Column:
    """Relaxed name: lower case, a-z and 0-9 only."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def squeeze(x) -> Column:
    """Runs of ASCII white space as one space, trimmed."""
    return F.trim(F.regexp_replace(_c(x), r"[ \t\r\n\f\x0B]+", " "))


def canonical(x) -> Column:
    """Comparison key of a clause: lower case, runs of space, underscore and hyphen as one space, outer spaces and dots cut."""
    return F.btrim(F.regexp_replace(F.lower(_c(x)), r"[\s_-]+", " "), F.lit(" ."))


def sentences(x) -> Column:
    """Sentences of a text: split after . ! or ? with white space; blank ones dropped."""
    return F.filter(F.split(squeeze(x), r"(?<=[.!?]) "), lambda s: F.length(s) > 0)


def clean_clause(x) -> Column:
    """A clause without figure references, leading connectives, a leading "to" and outer space, colons and hyphens."""
    c = squeeze(x)
    c = F.trim(F.regexp_replace(c, r"(?i)\(figures?[^)]*\)", ""))
    c = F.regexp_replace(c, r"([A-Za-z0-9_])\.([0-9]+)\.", "$1. ")
    c = F.regexp_replace(c, rf"(?i)^({'|'.join(CONNECTIVES)})\s*,?\s*", "")
    c = F.regexp_replace(c, r"(?i)^to\s+", "")
    return F.btrim(c, F.lit(" :-"))


def lower_first(x) -> Column:
    """The first letter in lower case, unless the first two are both capitals."""
    x = _c(x)
    head = F.substring(x, 1, 2)
    return F.when(head.rlike("^[A-Z]") & ~head.rlike("^[A-Z]([A-Z]|[^A-Za-z])$"), F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))).otherwise(x)


def ensure_period(x) -> Column:
    """A closing full stop where the text ends in none of . ! ?"""
    x = F.trim(_c(x))
    return F.when((F.length(x) == 0) | x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, F.lit(".")))


def to_shall(x) -> Column:
    """A requirement in "The system shall" form, by its leading verb, actor or copula."""
    # the cleaned clause is bound once: it is used in every branch
    return F.get(F.transform(F.array(clean_clause(x)), _shall), F.lit(0))


def _shall(req: Column) -> Column:
    low = F.lower(req)
    one_of = "|".join
    say = lambda head: ensure_period(F.concat(F.lit(head), lower_first(req)))
    return (
        F.when(F.length(req) == 0, "")
        .when(low.startswith("the system shall"), ensure_period(req))
        .when(low.rlike(rf"^({one_of(SHALL_VERBS)})([^a-z0-9_]|$)"), say("The system shall "))
        .when(low.rlike(rf"^({one_of(SHALL_ACTORS)})([^a-z0-9_]|$)"), say("The system shall allow "))
        .when(low.rlike(rf"(^|[^a-z0-9_])({one_of(SHALL_COPULAS)})([^a-z0-9_]|$)"), say("The system shall ensure that "))
        .otherwise(say("The system shall support "))
    )
