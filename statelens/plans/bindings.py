"""How the driver's tables become the engine's tables, and the same rules as DuckDB SQL.

Event graphs: a user's events of one week of the month are one run of that user's diagram. Run 0 is the
gold graph, the others are predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statelens.operators.graph import Elements

STEREOTYPES = {"_0": "choice", "_1": "fork", "_2": "join"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of runs: diagram_id, case_id, run_index, line_no, state, dst, event."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(
        F.col("user_id").alias("case_id"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("long").alias("run_index"), "ts", "event_id",
        F.concat_ws("_", "event_type", F.floor(k / 25).cast("string")).alias("state"), F.concat(F.col("event_type"), F.lit(" k"), (k % 4).cast("string")).alias("label"),
    )
    w = Window.partitionBy("case_id", "run_index").orderBy("ts", "event_id")
    e = e.withColumn("line_no", F.row_number().over(w).cast("long")).withColumn("dst", F.lead("state").over(w)).withColumn("event", F.lead("label").over(w))
    return e.withColumn("diagram_id", F.concat_ws("/", F.col("case_id").cast("string"), F.col("run_index").cast("string"))).drop("ts", "event_id", "label")


def event_graphs(spark: SparkSession, sf_dir: str) -> Elements:
    """The graphs of all runs as element tables."""
    s = steps(spark, sf_dir)
    end = F.substring("state", -2, 2)
    kind = F.when(end == "_0", "choice").when(end == "_1", "fork").when(end == "_2", "join")
    states = s.select("diagram_id", "state").distinct().select(
        "diagram_id", "state", F.lit(True).alias("is_explicit"), (F.col("state") == "signup_3").alias("is_composite"), (F.col("state") == "view_3").alias("is_history"),
        F.array_compact(F.array(kind)).alias("stereotypes"),
    )
    return Elements(
        diagrams=s.select("diagram_id", "case_id", "run_index").distinct(),
        states=states,
        transitions=s.where("dst is not null").select("diagram_id", "line_no", F.col("state").alias("src"), "event", "dst"),
        initials=s.where("line_no = 1").select("diagram_id", "line_no", F.col("state").alias("target")),
        finals=s.where("dst is null").select("diagram_id", "state"),
    )


def graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of all runs as graph rows (see operators.graph.graphs) with case_id and run_index: one shuffle by run."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(
        F.col("user_id").alias("case_id"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("long").alias("run_index"),
        F.struct("ts", "event_id", F.concat_ws("_", "event_type", F.floor(k / 25).cast("string")).alias("state"), F.concat(F.col("event_type"), F.lit(" k"), (k % 4).cast("string")).alias("label")).alias("s"),
    )
    # dealt out by number: what follows costs time by the row, and merging small partitions would leave it to a few tasks
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "case_id", "run_index")
    g = e.groupBy("case_id", "run_index").agg(F.array_sort(F.collect_list("s")).alias("s"))
    end = lambda n: F.substring(n, -2, 2)
    kind = lambda n: F.array_compact(F.array(F.when(end(n) == "_0", "choice").when(end(n) == "_1", "fork").when(end(n) == "_2", "join")))
    node = lambda n: F.struct(n.alias("state"), F.lit(True).alias("is_explicit"), (n == "signup_3").alias("is_composite"), (n == "view_3").alias("is_history"), kind(n).alias("stereotypes"))
    names = F.array_sort(F.array_distinct(F.transform("s", lambda x: x["state"])))
    follow = F.transform(F.slice(F.col("s"), F.lit(2), F.size("s")), lambda x, i: F.struct(F.get(F.col("s"), i)["state"].alias("src"), x["label"].alias("event"), x["state"].alias("dst")))
    return g.select(
        F.concat_ws("/", F.col("case_id").cast("string"), F.col("run_index").cast("string")).alias("diagram_id"), "case_id", "run_index", F.transform(names, node).alias("states"),
        F.array(F.get("s", F.lit(0))["state"]).alias("inits"), F.array(F.element_at("s", -1)["state"]).alias("finals"), F.array().cast("array<string>").alias("errors"), follow.alias("edges"),
    )


#: Labels of declared names in the rich texts.
LABELS = {"purchase_3": "Purchase Three", "error_0": "Error Zero"}


def rich_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diagram_id, case_id, run_index, text): the runs as diagram texts that use the whole language.

    Notes, comments, noise lines, both kinds of alias, stereotypes, a composite, a described state and history marks are in all
    texts that have the states for them. By case_id modulo 5: 0 declares a state that nothing leads to, 1 has no initial state, 2
    has two, 3 joins start and end directly, 4 has no final state.
    """
    g = graph_rows(spark, sf_dir).withColumn("c", F.col("case_id") % 5)
    has = lambda n: F.exists("states", lambda s: s["state"] == n)
    lines = lambda *x: F.array(*[F.lit(y) if isinstance(y, str) else y for y in x])
    when = lambda ok, *x: F.when(ok, lines(*x)).otherwise(F.array().cast("array<string>"))
    marked = F.filter("states", lambda s: (F.size(s["stereotypes"]) > 0) & ~s["state"].isin(*LABELS))
    edge = lambda e: F.concat(e["src"], F.when(e["src"].endswith("_2"), " -down-> ").otherwise(" --> "), e["dst"], F.when(e["dst"] == "view_3", "[H]").otherwise(""), F.lit(" : "), e["event"], F.lit(" ' a remark --> nowhere"))
    first, last = F.get("inits", F.lit(0)), F.get("finals", F.lit(0))
    text = F.concat(
        lines("@startuml", F.concat(F.lit("title Run of "), F.col("case_id").cast("string")), "skinparam monochrome true", "hide empty description", "left to right direction"),
        lines("note left of view_0", "  ghost --> phantom : never", "end note", "note right of view_0 : short"),
        lines('state "Purchase Three" as purchase_3', 'state error_0 as "Error Zero"'),
        F.transform(marked, lambda s: F.concat(F.lit("state "), s["state"], F.lit(" <<"), F.get(s["stereotypes"], F.lit(0)), F.lit(">>"))),
        when(has("signup_3"), "state signup_3 {", "}"), when(has("view_1"), "view_1 : shows a page"), when(F.col("c") == 0, "state lonely"),
        when(F.col("c") != 1, F.concat(F.lit("[*] --> "), first)), when(F.col("c") == 2, F.concat(F.lit("[*] --> "), last)), when(F.col("c") == 3, "[*] --> [*]"),
        F.transform("edges", edge), when(F.col("c") != 4, F.concat(last, F.lit(" --> [*]"))), lines("--", "||", "@enduml"),
    )
    return g.select("diagram_id", "case_id", "run_index", F.array_join(text, "\n").alias("text"))


def of_runs(el: Elements, condition: str) -> Elements:
    """The elements of the diagrams that meet a condition."""
    d = el.diagrams.where(condition)
    keep = lambda df: df.join(d.select("diagram_id"), "diagram_id", "left_semi")
    return Elements(d, keep(el.states), keep(el.transitions), keep(el.initials), keep(el.finals))


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity rows: run of a model (source) and method (lang), syntax_valid and strict_valid."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("case_id"), F.col("source").alias("model"), F.col("lang").alias("method"),
        (F.col("toxic") == 0).alias("syntax_valid"), ((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("strict_valid"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: an item's raters with four scores of 1 to 5, method and model."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.row_number().over(w).cast("long").alias("rater"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("model"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("completeness"), (F.round(F.col("l_discount") * 100).cast("int") % 5 + 1).alias("correctness"),
        (F.round(F.col("l_tax") * 100).cast("int") % 5 + 1).alias("understandability"), ((F.col("l_linenumber") - 1) % 5 + 1).cast("int").alias("terminology_alignment"),
    )


CRITERIA = ("completeness", "correctness", "understandability", "terminology_alignment")

VG = """
g as (select user_id as case_id, (extract(day from ts) - 1) // 7 as run_index, ts, event_id, cast(json_extract_string(props, '$.k') as int) as k, event_type from events where user_id is not null),
o as (select cast(case_id as varchar) || '/' || cast(run_index as varchar) as diagram_id, case_id, run_index, row_number() over w as line_no,
      event_type || '_' || cast(k // 25 as varchar) as state, lead(event_type || '_' || cast(k // 25 as varchar)) over w as dst, lead(event_type || ' k' || cast(k % 4 as varchar)) over w as event
      from g window w as (partition by case_id, run_index order by ts, event_id)),
diagrams as (select distinct diagram_id, case_id, run_index from o),
states as (select distinct diagram_id, state, case when right(state, 2) = '_0' then 'choice' when right(state, 2) = '_1' then 'fork' when right(state, 2) = '_2' then 'join' end as stereo from o),
transitions as (select diagram_id, line_no, state as src, event, dst from o where dst is not null),
initials as (select diagram_id, state as target from o where line_no = 1),
finals as (select diagram_id, state from o where dst is null)"""

#: What the rich texts say, derived from the runs and not from the texts.
VRICH = """
rn as (select *, case_id % 5 as c from diagrams),
nm as (select distinct state, case state when 'purchase_3' then 'Purchase Three' when 'error_0' then 'Error Zero' else state end as name from states),
rt as (select t.diagram_id, line_no, a.name as src, event, b.name as dst, t.dst = 'view_3' as into_history from transitions t join nm a on a.state = t.src join nm b on b.state = t.dst),
rin as (select i.diagram_id, nm.name as state from initials i join rn using (diagram_id) join nm on nm.state = i.target where c <> 1
        union all select f.diagram_id, nm.name from finals f join rn using (diagram_id) join nm using (state) where c = 2),
rfi as (select f.diagram_id, nm.name as state from finals f join rn using (diagram_id) join nm using (state) where c <> 4),
rdecl as (select diagram_id, unnest(['Purchase Three', 'Error Zero']) as state, null as stereo, false as comp from rn
          union all select diagram_id, state, stereo, false from states where stereo is not null and state not in ('purchase_3', 'error_0')
          union all select diagram_id, state, null, true from states where state = 'signup_3'
          union all select diagram_id, state, null, false from states where state = 'view_1'
          union all select diagram_id, 'lonely', null, false from rn where c = 0),
rall as (select diagram_id, state, true as x, stereo, comp, false as h from rdecl union all select diagram_id, state, false, null, false, false from rin union all select diagram_id, state, false, null, false, false from rfi
         union all select diagram_id, src, false, null, false, false from rt union all select diagram_id, dst, false, null, false, into_history from rt),
rst as (select diagram_id, state, bool_or(x) as is_explicit, bool_or(comp) as is_composite, bool_or(h) as is_history, max(stereo) as stereo from rall group by 1, 2)"""

VV = """
v as (select l.doc_id as case_id, d.source as model, d.lang as method, l.toxic = 0 as syntax_valid, l.toxic = 0 and l.quality = 1 as strict_valid
      from labels l join documents d using (doc_id))"""

VR = """
r as (select l_orderkey as item_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as rater,
      l_returnflag as method, l_linestatus as model, cast(ceil(l_quantity / 10) as int) as completeness, cast(round(l_discount * 100) as int) % 5 + 1 as correctness,
      cast(round(l_tax * 100) as int) % 5 + 1 as understandability, cast((l_linenumber - 1) % 5 + 1 as int) as terminology_alignment from lineitem)"""
