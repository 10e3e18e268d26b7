"""Reading and writing the corpus: case folders, run folders, documents, tolerant JSON lines, sinks and manifests."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelens.functions.small import times

KINDS = {"raw_requirement.txt": "raw_requirement", "structured_requirement.txt": "structured_requirement", "diagram.puml": "gold_text"}


def _texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    d = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return d.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))


def cases_of(texts: DataFrame) -> DataFrame:
    """(case_id, raw_requirement, structured_requirement, gold_text, missing_inputs) of texts (case_id, file, text), trimmed."""
    t = texts.where(F.col("case_id").startswith("case_")).select("case_id", "file", F.btrim("text", F.lit(" \n\r\t")).alias("text"))
    wide = t.groupBy("case_id").pivot("file", list(KINDS)).agg(F.first("text")).withColumnsRenamed(KINDS)
    return wide.withColumn("missing_inputs", F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in KINDS.values()])))


def read_cases(spark: SparkSession, root: str) -> DataFrame:
    """The cases of the folders case_*."""
    t = reduce(lambda a, b: a.union(b), [_texts(spark, root, k) for k in KINDS])
    return cases_of(t.select(F.regexp_extract("path", r"/(case_[^/]+)/[^/]+$", 1).alias("case_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "text"))


def diagrams_of(texts: DataFrame) -> DataFrame:
    """(diagram_id, run_id, case_id, run_index, stage, attempt, text) of texts (run_id, case_id, file, text) whose file is
    run_NN[.initial|.repair_KK].puml; others are left out.
    """
    get = lambda i: F.regexp_extract("file", r"^run_([0-9]+)(?:\.(initial|repair)(?:_([0-9]+))?)?\.puml$", i)
    t = texts.where(get(1) != "").select("run_id", "case_id", get(1).cast("int").alias("run_index"), F.when(get(2) == "", "final").otherwise(get(2)).alias("stage"), F.coalesce(get(3).try_cast("int"), F.lit(0)).alias("attempt"), "text")
    return t.select(F.concat_ws("/", "run_id", "case_id", F.col("run_index").cast("string"), "stage", F.col("attempt").cast("string")).alias("diagram_id"), "*")


def read_diagrams(spark: SparkSession, root: str) -> DataFrame:
    """The diagrams of runs/<run_id>/<case_id>/run_NN[.initial|.repair_KK].puml."""
    get = lambda i: F.regexp_extract("path", r"/([^/]+)/([^/]+)/([^/]+)$", i)
    return diagrams_of(_texts(spark, root, "run_*.puml").select(get(1).alias("run_id"), get(2).alias("case_id"), get(3).alias("file"), "text"))


def finals(diagrams: DataFrame) -> DataFrame:
    return diagrams.where("stage = 'final'")


def with_tokens(diagrams: DataFrame, tokens: list[str]) -> DataFrame:
    """Runs whose id contains every token."""
    return reduce(lambda d, t: d.where(F.contains("run_id", F.lit(t))), tokens, diagrams)


def docs_of(texts: DataFrame) -> DataFrame:
    """(name, content) of texts (name, text) whose name ends in .md, without manifests."""
    return texts.where(F.col("name").endswith(".md") & ~F.col("name").endswith("manifest.md")).select("name", F.col("text").alias("content"))


def read_docs(spark: SparkSession, root: str) -> DataFrame:
    """The documents *.md below root; the name is the path from root on."""
    name = F.regexp_replace("path", "^.*" + re.escape(root.rstrip("/").replace("file://", "")) + "/", "")
    return docs_of(_texts(spark, root, "*.md").select(name.alias("name"), "text"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all strings; no rows where the file is missing."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def status_gate(diagrams: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Diagrams without a metadata row, or whose status is ok; a row that has no status or didn't parse shuts its diagram out."""
    return diagrams.join(meta.where("status is null or status <> 'ok'").select(*keys), keys, "left_anti")


#: Fixed order: the first that a run id contains names its model family.
FAMILIES = ("qwen", "llama", "deepseek", "gpt")


def model_family(run_id):
    """The model family in a run id, else the run id."""
    out = run_id
    for name in reversed(FAMILIES):
        out = F.when(F.contains(F.lower(run_id), F.lit(name)), name).otherwise(out)
    return out


def pool_of_runs(diagrams: DataFrame, run_ids: DataFrame) -> DataFrame:
    """Final diagrams of the runs listed in run_ids (run_id), with ``model``, their family."""
    return finals(diagrams).join(run_ids.select("run_id"), "run_id", "left_semi").withColumn("model", model_family(F.col("run_id")))


def pool_of_strategy(diagrams: DataFrame, prefixes: dict[str, str], strategy: str) -> DataFrame:
    """Final diagrams of the runs ``prefix__strategy``, with ``model``, the name that the prefix stands for; empty prefixes are left out."""
    names = {f"{prefix}__{strategy}": model for model, prefix in prefixes.items() if prefix}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.lit(None).cast("map<string,string>")
    return finals(diagrams).where(F.col("run_id").isin(*names)).withColumn("model", F.try_element_at(known, F.col("run_id")))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys have no output yet."""
    return work.join(done.select(*keys), keys, "left_anti")


# The strategies of a run matrix with what they use, and the labels of models and methods.
STRATEGIES = (
    ("zero_shot", False, False, False), ("few_shot", False, False, False), ("zero_shot_validation_generator_critic_repair", False, True, True), ("few_shot_validation_generator_critic_repair", False, True, True),
    ("rag", True, False, False), ("rag_structural_validation", True, True, False), ("rag_validation_generator_critic_repair", True, True, True),
)
STRATEGY_SCHEMA = "strategy string, use_rag boolean, use_structural_validation boolean, use_ensemble boolean"
MODEL_LABELS = {
    "qwen25_7b_instruct": "Qwen 2.5 7B Instruct", "qwen25_14b_instruct": "Qwen 2.5 14B Instruct", "mistral": "Mistral", "llama31_8b_instruct": "Llama 3.1 8B Instruct", "llama31_70b_instruct": "Llama 3.1 70B Instruct",
    "deepseek_r1_8b": "DeepSeek R1 8B", "deepseek_r1_14b": "DeepSeek R1 14B",
}
METHOD_LABELS = {
    "zero_shot": "Zero-shot", "one_shot": "One-shot", "few_shot": "Few-shot", "rag": "RAG", "zero_shot_validation_generator_critic_repair": "Zero-shot + Repair", "one_shot_validation_generator_critic_repair": "One-shot + Repair",
    "few_shot_validation_generator_critic_repair": "Few-shot + Repair", "rag_structural_validation": "RAG + Validation", "rag_validation_generator_critic_repair": "RAG + Repair",
}
#: The methods whose runs may carry the tag of a document subset.
TAGGED = ("rag", "rag_structural_validation", "rag_validation_generator_critic_repair")


def normal_tag(tag):
    """A tag in lower case, whatever is no letter or digit as one underscore, none at its ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(tag)), "[^a-z0-9]+", "_"), F.lit("_"))


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATEGIES, STRATEGY_SCHEMA)


def run_matrix(models: DataFrame, strategies: DataFrame, tag: str = "", baseline: DataFrame | None = None) -> DataFrame:
    """Every model (model_group, model_label, ...) with every strategy (strategy, use_rag, ...; a dimension, whose size is
    checked) and run_id, its parts joined; the tag of a document subset follows in runs that retrieve.

    baseline: (model_group, model_label, strategy, ...) of runs on the baseline subset alone, which come besides.
    """
    label = normal_tag(F.lit(tag))
    run_id = F.concat_ws("__", "model_group", "model_label", "strategy", F.when(F.col("use_rag") & (label != ""), label))
    out = times(models, strategies).withColumn("run_id", run_id).withColumn("baseline_subset_only", F.lit(False))
    if baseline is None:
        return out
    one = baseline.withColumn("run_id", F.concat_ws("__", "model_group", "model_label", "strategy")).withColumn("baseline_subset_only", F.lit(True))
    flags = [c for c, t in strategies.dtypes if t == "boolean"]
    return out.unionByName(one, allowMissingColumns=True).fillna(False, flags)


def one_shot_ids(configs: DataFrame, examples: int) -> DataFrame:
    """run_id with __few_shot as __one_shot where one example is shown; others stay."""
    return configs.withColumn("run_id", F.regexp_replace("run_id", "__few_shot", "__one_shot")) if examples == 1 else configs


def _label(x, labels: dict):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), x), x)


def decode_run_id(run_id):
    """(model, method): labels of a run id's second part and of all that follows; fewer than three parts give the id itself
    and ``unknown``. A method that is not known as a whole is the longest tagged method that it starts with, and its tag.
    """
    p = F.split(run_id, "__")
    method = F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(1))), "__")
    tag = F.replace(F.regexp_extract(method, "^[^_]+(?:_[^_]+)*?__(.*)$", 1), F.lit("_"), F.lit(" "))
    tagged = F.lit(None).cast("string")
    for name in sorted(TAGGED, key=len):
        tagged = F.when(method.startswith(f"{name}__"), F.concat(F.lit(f"{METHOD_LABELS[name]} ["), tag, F.lit("]"))).otherwise(tagged)
    known = F.try_element_at(F.create_map(*[F.lit(v) for kv in METHOD_LABELS.items() for v in kv]), method)
    return F.when(F.size(p) < 3, F.struct(run_id.alias("model"), F.lit("unknown").alias("method"))).otherwise(F.struct(_label(p[1], MODEL_LABELS).alias("model"), F.coalesce(known, tagged, method).alias("method")))


#: What is read of a run's metadata: its status and the artefacts of its attempts.
METADATA = "status string, attempt_artifacts array<struct<stage:string,attempt:int,accepted:boolean,validation:struct<valid:boolean>,strict_state_diagram_valid:boolean>>"


def attempts(meta: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stage, attempt, accepted, syntax_valid, strict_valid): first answers and repairs that have a number, from METADATA."""
    a = meta.select(*keys, F.explode("attempt_artifacts").alias("a")).where("a.stage in ('initial', 'repair') and a.attempt >= 0")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return a.select(*keys, "a.stage", "a.attempt", yes(F.col("a.accepted")).alias("accepted"), yes(F.col("a.validation.valid")).alias("syntax_valid"), yes(F.col("a.strict_state_diagram_valid")).alias("strict_valid"))


def explode_attempts(meta: DataFrame) -> DataFrame:
    """One row for each attempt of attempt_artifacts."""
    return meta.withColumn("a", F.explode("attempt_artifacts")).select(*[c for c in meta.columns if c != "attempt_artifacts"], "a.*")


def manifest(split: DataFrame, configs: DataFrame, settings: dict, width: int = 1000) -> DataFrame:
    """(section, part, n, payload) of an experiment: the ids of its test and pool cases, its run configurations and its settings,
    as JSON. A section is dealt into parts of about ``width`` entries, so that no row grows with the experiment; n counts
    the section. Lists among the settings are sorted.
    """

    def section(rows, order):
        # by hash: no section is numbered in one task
        n = rows.groupBy("section").agg(F.count("*").alias("n"))
        part = F.conv(F.substring(F.md5(F.col(order).cast("string")), 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1), F.ceil(F.col("n") / width))
        g = rows.join(n, "section").groupBy("section", part.cast("long").alias("part"), "n").agg(F.array_sort(F.collect_list(F.struct(order, "entry"))).alias("e"))
        return g.select("section", "part", "n", F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["entry"]), ","), F.lit("]")).alias("payload"))

    role = F.when(F.col("role") == "test", "test_case_ids").otherwise("rag_case_ids")
    cases = section(split.select(role.alias("section"), "case_id", F.concat(F.lit('"'), F.col("case_id").cast("string"), F.lit('"')).alias("entry")), "case_id")
    runs = section(configs.select(F.lit("configs").alias("section"), "run_id", F.to_json(F.struct(*configs.columns)).alias("entry")), "run_id")
    plain = {k: sorted(v) if isinstance(v, (list, set, tuple)) else v for k, v in sorted(settings.items())}
    given = split.sparkSession.createDataFrame([("settings", 0, len(plain), json.dumps(plain))], "section string, part long, n long, payload string")
    return cases.union(runs).union(given)


def subsets(docs: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(subset, name, ...): documents under each named subset that lists their group."""
    names = [F.when(F.col("group").isin(*gs), F.lit(s)) for s, gs in groups.items()]
    return docs.withColumn("subset", F.explode(F.array_compact(F.array(*names))))


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple = ()) -> None:
    """Overwrites path; csv has a header."""
    w = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    (w.option("header", True) if kind == "csv" else w).format(kind).save(path)
