"""Diagram text to graph rows and element tables: one expression on each text, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.operators.graph import Elements

# The line forms of the diagram language.
ID = r"[A-Za-z_][A-Za-z0-9_]*"
TAIL = r"(?:\s+<<([^>]+)>>)?\s*(?:\{\s*\}|\{)?\s*$"
ALIAS = rf'^state\s+"([^"]+)"\s+as\s+({ID}){TAIL}'
ALIAS_REVERSE = rf'^state\s+({ID})\s+as\s+"([^"]+)"{TAIL}'
STATE = rf'^state\s+("[^"]+"|[A-Za-z_][A-Za-z0-9_\-\.]*){TAIL}'
END = r'(\[\*\]|\[H\]|\[H\*\]|"[^"]+"|[^\s:]+)'
TRANSITION = rf"^{END}\s*(?:-(?:left|right|up|down|l|r|u|d)?->|-->)\s*{END}(?:\s*:\s*(.*))?\s*$"


def block(text):
    """The diagram inside a model's answer: fence lines dropped, from the first start marker to the last end marker, else all of it."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: ~F.trim(x).startswith("```"))
    clean = F.trim(F.array_join(lines, "\n"))
    inner = F.regexp_extract(clean, r"(?s)(@startuml.*@enduml)", 1)
    return F.when(inner != "", inner).otherwise(clean)


def boundaries(text):
    """The block with one start marker first and one end marker last, lines right-trimmed; blank lines between stay."""
    lines = F.transform(F.split(block(text), "\n"), lambda x: F.rtrim(x))
    inner = F.filter(lines, lambda x: ~F.lower(F.trim(x)).isin("@startuml", "@enduml"))
    body = F.when(block(text) == "", F.array().cast("array<string>")).otherwise(inner)
    return F.array_join(F.concat(F.array(F.lit("@startuml")), body, F.array(F.lit("@enduml"), F.lit(""))), "\n")


def name(x):
    """A name without its quotes, runs of white space as one space."""
    x = F.trim(x)
    return T.squeeze(F.when(x.rlike('^".*"$') & (F.length(x) >= 2), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def _let(value, f):
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _kept_lines(text):
    """(line_no, line) outside of notes, without comments, markers and lines that say nothing; the start marker is line 1."""
    lines = F.transform(F.split(boundaries(F.coalesce(text, F.lit(""))), "\n"), lambda r, i: F.struct((i + 1).cast("long").alias("line_no"), F.trim(F.substring_index(F.regexp_replace(r, "\t", " "), "'", 1)).alias("line")))

    def step(acc, x):
        line, low = x["line"], F.lower(x["line"])
        note = low.startswith("note ") | (low == "note on link")
        opens = note & ~F.contains(low, F.lit("end note")) & ~low.rlike(r"^note\s+.+\s*:\s*")
        says = ~note & (line != "") & ~line.startswith("@") & ~line.isin("}", "--", "||") & ~line.rlike("^(skinparam|hide|title|left to right direction)")
        inside = F.when(opens, True).when(low == "end note", False).otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), F.when(~acc["inside"] & says, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<line_no:bigint,line:string>>").alias("kept"))
    return F.aggregate(lines, start, step, lambda acc: acc["kept"])


HISTORY = r"\s*\[H\*?\]$"


def _read(x):
    """What a line says: kind, declared names, ends, event."""
    line = x["line"]
    get = lambda pattern, i: F.regexp_extract(line, pattern, i)
    part = F.trim(F.substring_index(line, ":", 1))
    is_transition = line.rlike(TRANSITION)
    described = F.contains(line, F.lit(":")) & ~is_transition & (part != "") & ~F.contains(part, F.lit(" ")) & ~part.startswith("note")
    kind = F.when(described, "description").when(line.rlike(ALIAS), "alias").when(line.rlike(ALIAS_REVERSE), "reverse").when(line.rlike(STATE), "state").when(is_transition, "transition")
    of = lambda k, value: F.when(kind == k, value)
    stereo = F.coalesce(of("alias", get(ALIAS, 3)), of("reverse", get(ALIAS_REVERSE, 3)), of("state", get(STATE, 2)))
    return F.struct(
        x["line_no"].alias("line_no"), kind.alias("kind"), F.coalesce(of("alias", get(ALIAS, 2)), of("reverse", get(ALIAS_REVERSE, 1))).alias("alias"),
        F.coalesce(of("alias", name(get(ALIAS, 1))), of("reverse", name(get(ALIAS_REVERSE, 2)))).alias("label"), of("state", name(get(STATE, 1))).alias("named"), of("description", name(part)).alias("described"),
        of("transition", name(get(TRANSITION, 1))).alias("s0"), of("transition", name(get(TRANSITION, 2))).alias("d0"), of("transition", T.squeeze(get(TRANSITION, 3))).alias("event"),
        F.nullif(F.lower(T.squeeze(stereo)), F.lit("")).alias("stereo"), (~(kind == "description") & line.endswith("{")).alias("composite"),
    )


def _graph(rows):
    """The graph of read lines: a name declared above a line stands for its label there, the latest declaration wins."""
    bare = lambda x: F.when(x.isin("[H]", "[H*]"), "").otherwise(F.regexp_replace(x, HISTORY, ""))
    flagged = lambda x: x.rlike(r"\[H\*?\]$")
    star = F.lit("[*]")

    def with_names(known):
        resolve = lambda x, at: F.coalesce(F.try_element_at(F.filter(known, lambda d: (d["alias"] == x) & (d["line_no"] < at)), F.lit(-1))["label"], x)

        def arrow(r):
            ends = (resolve(bare(r["s0"]), r["line_no"]).alias("src"), resolve(bare(r["d0"]), r["line_no"]).alias("dst"))
            past = F.when(flagged(r["s0"]), bare(r["s0"])).when(flagged(r["d0"]), bare(r["d0"]))
            return F.struct(*ends, r["event"].alias("event"), resolve(past, r["line_no"]).alias("past"), r["line_no"].alias("line_no"))

        node = lambda state, x=False, m=None, h=False, stereo=None: F.struct(state.alias("state"), F.lit(x).alias("x"), (F.lit(False) if m is None else m).alias("m"), F.lit(h).alias("h"), (F.lit(None).cast("string") if stereo is None else stereo).alias("stereo"))
        declared = lambda r: node(F.coalesce(r["label"], r["named"], resolve(r["described"], r["line_no"])), True, r["composite"], stereo=r["stereo"])
        arrows = F.transform(F.filter(rows, lambda r: r["kind"] == "transition"), arrow)
        return _let(arrows, lambda t: _let(F.filter(F.concat(
            F.transform(F.filter(rows, lambda r: r["kind"] != "transition"), declared), F.transform(t, lambda e: node(e["src"])), F.transform(t, lambda e: node(e["dst"])), F.transform(F.filter(t, lambda e: e["past"].isNotNull()), lambda e: node(e["past"], h=True)),
        ), lambda n: (n["state"] != star) & (n["state"] != "")), lambda found: built(t, found)))

    def built(t, found):
        merge = lambda n: _let(F.filter(found, lambda f: f["state"] == n), lambda fs: F.struct(
            n.alias("state"), F.exists(fs, lambda f: f["x"]).alias("is_explicit"), F.exists(fs, lambda f: f["m"]).alias("is_composite"), F.exists(fs, lambda f: f["h"]).alias("is_history"),
            F.array_sort(F.array_distinct(F.array_compact(F.transform(fs, lambda f: f["stereo"])))).alias("stereotypes"),
        ))
        empty = lambda e: (e["src"] == "") | (e["dst"] == "")
        plain = lambda e: (e["src"] != star) & (e["dst"] != star)
        at = lambda e, what: F.concat(F.lit("candidate_line_"), e["line_no"].cast("string"), F.lit(f": {what}"))
        wrong = lambda e: F.when((e["src"] == star) & (e["dst"] == star), at(e, "invalid [*] -> [*] transition")).when(empty(e) & plain(e), at(e, "empty src/dst in transition"))
        return F.struct(
            F.transform(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["state"]))), merge).alias("states"),
            F.transform(F.filter(t, lambda e: plain(e) & ~empty(e)), lambda e: F.struct(e["src"].alias("src"), e["event"].alias("event"), e["dst"].alias("dst"))).alias("edges"),
            F.transform(F.filter(t, lambda e: (e["src"] == star) & (e["dst"] != star)), lambda e: e["dst"]).alias("inits"),
            F.array_sort(F.array_distinct(F.transform(F.filter(t, lambda e: (e["dst"] == star) & (e["src"] != star)), lambda e: e["src"]))).alias("finals"),
            F.array_compact(F.transform(t, wrong)).alias("errors"), F.exists(t, lambda e: e["past"].isNotNull()).alias("history"),
        )

    return _let(F.filter(rows, lambda r: r["alias"].isNotNull()), with_names)


def parse_graphs(diagrams: DataFrame) -> DataFrame:
    """diagrams (diagram_id, text, ...) without the text, as graph rows: states, edges and inits in line order, finals, errors, history.

    All of it is one expression on the text: nothing is shuffled. Null and empty texts give a graph without elements.
    """
    g = _let(F.filter(F.transform(_kept_lines(F.col("text")), _read), lambda r: r["kind"].isNotNull()), _graph)
    rest = [c for c in diagrams.columns if c != "text"]
    # explode keeps the optimiser from computing the graph once for each of its fields
    return diagrams.select(*rest, F.explode(F.array(g)).alias("g")).select(*rest, "g.*")


def parse(diagrams: DataFrame) -> Elements:
    """Elements of (diagram_id, text, ...), from graph rows."""
    g = parse_graphs(diagrams.select("diagram_id", "text"))
    edges = g.select("diagram_id", F.posexplode("edges").alias("p", "e")).select("diagram_id", (F.col("p") + 1).cast("long").alias("line_no"), "e.src", "e.event", "e.dst")
    each = lambda c, alias: g.select("diagram_id", F.explode(c).alias(alias))
    starts = g.select("diagram_id", F.posexplode("inits").alias("p", "target")).select("diagram_id", (F.col("p") + 1).cast("long").alias("line_no"), "target")
    errors = g.select("diagram_id", F.explode("errors").alias("issue")).select("diagram_id", F.regexp_extract("issue", "_([0-9]+):", 1).cast("long").alias("line_no"), "issue")
    return Elements(diagrams, each("states", "s").select("diagram_id", "s.*"), edges, starts, each("finals", "state"), errors)
