"""Lexical and vector retrieval of context documents, snippets and context assembly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelens.functions import text as T
from statelens.functions.small import times

QUERY_BLOCK = 4096
#: Queries in a block of the lexical search, and documents that answer them at once.
LEXICAL_BLOCK, SLICE = 16_384, 2000


def source_type(name, content):
    """From the path prefix, else the front matter's key, else ``reference``."""
    front = F.regexp_extract(content, r"(?m)^source_type:\s*([A-Za-z0-9_\-/]+)\s*$", 1)
    return F.when(name.startswith("dataset_examples/"), "dataset_example").when(name.startswith("plantuml_rules/"), "plantuml_rule").when(name.startswith("state_diagram_theory/"), "state_diagram_theory").when(front != "", front).otherwise("reference")


def name_domain(name):
    """X of a file name domain_X_rules."""
    return F.regexp_extract(F.lower(name), r"(?:^|/)domain_(.+?)_rules(?:\.[a-z]+)?$", 1)


def domain_terms(tokens):
    """The tokens that name a domain."""
    return F.array_intersect(tokens, F.array(*[F.lit(t) for t in T.DOMAIN_TERMS]))


def query_domains(text, hints=None):
    """Domains of a query: the terms in its text, and explicit hints (an array), trimmed and lower-cased."""
    found = domain_terms(T.words(text))
    if hints is None:
        return found
    clean = F.filter(F.transform(F.coalesce(hints, F.array().cast("array<string>")), lambda h: F.lower(F.trim(h))), lambda h: h != "")
    return F.array_distinct(F.concat(found, clean))


def doc_domains(name, tokens):
    """Domains of a document: its name's, and the terms among its tokens."""
    return F.array_distinct(F.filter(F.concat(F.array(name_domain(name)), domain_terms(tokens)), lambda x: x != ""))


ORDER = ("score", "domain", "title", "lexical", "token_count")
SCORED = "query long, name string, source_type string, lexical long, title long, domain long, token_count long, score long"


def _blocks(rows, size: int):
    """Lists of at most size rows of a table that is read once, partition by partition."""
    block = []
    for r in rows:
        block.append(r)
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block


def lexical_top(queries: DataFrame, docs: DataFrame, limits: dict[str, int] | None, default: int | None, block: int = LEXICAL_BLOCK) -> DataFrame:
    """(query, name, source_type, lexical, title, domain, token_count, score, rank): the best documents of each query and
    category, by score (shared tokens, twice those with the name, three times the domains), domain, title, lexical, token
    count (all descending) and name.

    A category gives ``limits`` documents, others ``default`` (None: nothing). Without limits there are no categories: the
    best ``default`` of all. Documents that share nothing come only where a query's category has none that does: they
    are the same for all such queries, the longest of the category, and are found once.
    queries: query (long), text, domains (array of hints); docs: name, content, source_type. Queries go out in blocks of a
    fixed size, as postings of their tokens; every batch of documents answers with its own best ones of what they hit, so
    the work follows the tokens that both sides share, and no token joins the two sides.
    """
    d = docs.select("name", "source_type", T.words("content").alias("tokens"), T.words(F.regexp_replace("name", "[^A-Za-z0-9]+", " ")).alias("title"))
    d = d.withColumn("domains", doc_domains(F.col("name"), F.col("tokens")))
    wanted = _limit(limits, default)
    d = d.where(wanted > 0)
    q = queries.select("query", T.words("text").alias("tokens"), query_domains(F.col("text"), F.col("domains")).alias("domains"))
    out = docs.sparkSession.createDataFrame([], SCORED)
    for rows in _blocks(q.toLocalIterator(), block):
        out = out.union(_scored(d, rows, limits, default))
    group = ["query", "source_type"] if limits is not None else ["query"]
    best = lambda df, w: df.withColumn("rank", F.row_number().over(w.orderBy(*[F.desc(c) for c in ORDER], "name"))).where(F.col("rank") <= wanted)
    hits = best(out, Window.partitionBy(*group))
    zero = [F.lit(0).cast("long").alias(c) for c in ("lexical", "title", "domain")]
    long = d.select("name", "source_type", *zero, F.size("tokens").cast("long").alias("token_count"), F.lit(0).cast("long").alias("score"))
    long = best(long, Window.partitionBy(*group[1:]))
    rest = times(q.select("query"), long).join(hits.select(*group).distinct(), group, "left_anti")
    return hits.unionByName(rest)


def _limit(limits, default):
    out = F.lit(default or 0)
    for kind, n in (limits or {}).items():
        out = F.when(F.col("source_type") == kind, n).otherwise(out)
    return out


def _scored(docs: DataFrame, queries: list, limits, default) -> DataFrame:
    """Each batch's best documents, of those that share something, of each query of one block."""

    def postings(column):
        out: dict = {}
        for j, r in enumerate(queries):
            for t in r[column]:
                out.setdefault(t, []).append(j)
        return {t: np.array(x, np.int64) for t, x in out.items()}

    shared = docs.sparkSession.sparkContext.broadcast((np.array([r["query"] for r in queries]), postings("tokens"), postings("domains")))  # one block

    def run(batches):
        ids, tokens, domains = shared.value

        def count(column, index):
            """(document * queries + query, shared tokens) of what the documents hit."""
            hits = [(i, index[t]) for i, x in enumerate(column.to_pylist()) for t in x if t in index]
            if not hits:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            return np.unique(np.concatenate([h for _, h in hits]) + np.repeat([i * len(ids) for i, _ in hits], [len(h) for _, h in hits]), return_counts=True)

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                get = {c: part.column(part.schema.get_field_index(c)) for c in part.schema.names}
                counts = [count(get["tokens"], tokens), count(get["title"], tokens), count(get["domains"], domains)]
                pair = np.unique(np.concatenate([k for k, _ in counts]))
                if not len(pair):
                    continue
                lexical, title, domain = (np.zeros(len(pair), np.int64) for _ in range(3))
                for into, (k, n) in zip((lexical, title, domain), counts, strict=True):
                    into[np.searchsorted(pair, k)] = n
                i, j = np.divmod(pair, len(ids))
                score, size = lexical + 2 * title + 3 * domain, np.array([len(x) for x in get["tokens"]])
                name, kinds = np.array(get["name"].to_pylist(), object), np.array(get["source_type"].to_pylist(), object)
                by_name = np.empty(len(name), np.int64)
                by_name[np.argsort(name, kind="stable")] = np.arange(len(name))
                kind, which = np.unique(kinds.astype(str), return_inverse=True)
                most = np.array([(limits or {}).get(k, default) or 0 for k in kind]) if limits is not None else np.full(len(kind), default or 0)
                group = j * len(kind) + which[i] if limits is not None else j
                order = np.lexsort((by_name[i], -size[i], -lexical, -title, -domain, -score, group))
                g = group[order]
                rank = np.arange(len(g)) - np.searchsorted(g, g)
                keep = order[rank < most[which[i[order]]]]
                i, j = i[keep], j[keep]
                cols = [ids[j], name[i], kinds[i], lexical[keep], title[keep], domain[keep], size[i], score[keep]]
                types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in SCORED.split(", ")])

    return docs.mapInArrow(run, SCORED)


#: The categories that contexts are made of, in their order; examples are limited by the caller.
CATEGORIES = (("plantuml_rule", 2), ("state_diagram_theory", 2), ("dataset_example", None))


def retrieve(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """lexical_top() by the known categories where documents have any; the best k of all documents otherwise."""
    limits = {name: n or k for name, n in CATEGORIES}
    if docs.where(F.col("source_type").isin(*limits)).isEmpty():
        return lexical_top(queries, docs, None, k)
    return lexical_top(queries, docs, limits, None)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, category: str | None = None) -> DataFrame:
    """(query_id, category, vec_id, distance, rank): the k nearest vectors by squared L2 of each query and category.

    Queries go out in blocks; each batch of vectors answers with its own k best of each, so the shuffle moves
    k rows for each query, category and batch. A matrix product finds the candidates; their distances are exact.
    """
    spark = vectors.sparkSession
    v = vectors.select("vec_id", (F.col(category) if category else F.lit(0)).cast("long").alias("category"), "embedding").where("embedding is not null")
    q = queries.select(F.col("vec_id").alias("query_id"), "embedding").where("embedding is not null")
    out = None
    for rows in _blocks(q.toLocalIterator(), QUERY_BLOCK):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)))

        def run(batches, shared=shared):
            ids, m = shared.value
            norms = (m**2).sum(1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                vid, cat = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                for c in np.unique(cat):
                    at = np.flatnonzero(cat == c)
                    near = norms[:, None] - 2 * (m @ x[at].T) + (x[at] ** 2).sum(1)[None, :]
                    n = min(k, len(at))
                    # rounding may move a distance by far less than this; ties are all kept
                    bar = np.partition(near, n - 1, axis=1)[:, n - 1 : n] + 1e-9 * (1 + norms[:, None] + np.abs(near).max())
                    i, j = np.nonzero(near <= bar)
                    d = ((x[at[j]] - m[i]) ** 2).sum(1)
                    order = np.lexsort((vid[at[j]], d, i))
                    i, j, d = i[order], j[order], d[order]
                    first = np.searchsorted(i, np.arange(len(ids)))
                    keep = np.arange(len(i)) - first[i] < n
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i[keep]]), pa.array(np.full(int(keep.sum()), int(c))), pa.array(vid[at[j[keep]]]), pa.array(d[keep])], ["query_id", "category", "vec_id", "distance"])

        part = v.mapInArrow(run, "query_id long, category long, vec_id long, distance double")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, category long, vec_id long, distance double, rank int")
    w = Window.partitionBy("query_id", "category").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_in(vectors: DataFrame, queries: DataFrame, k: int, category: str, wanted: list[int]) -> DataFrame:
    """nearest() within the wanted categories; over all vectors (category 0) where none of them has a vector."""
    some = vectors.where(F.col(category).isin(*wanted))
    return nearest(vectors, queries, k) if some.isEmpty() else nearest(some, queries, k, category)


def clip_lines(x, limit):
    """At most ``limit`` characters, cut at the last line break within if there is one; trimmed."""
    x = F.btrim(x, F.lit(" \t\n\r\f\x0b"))
    limit = limit if hasattr(limit, "cast") else F.lit(limit)
    head = F.substring(x, F.lit(1), limit)
    clean = lambda y: F.btrim(y, F.lit(" \t\n\r\f\x0b"))
    cut = clean(F.regexp_extract(head, r"(?s)^(.*)\n", 1))
    return F.when(F.length(x) <= limit, x).otherwise(F.when(cut != "", cut).otherwise(clean(head)))


def body(content):
    """A document without its front matter (between the first two ``---``)."""
    x = F.btrim(content, F.lit(" \t\n\r"))
    return F.when(x.rlike(r"(?s)^---.*?---"), F.btrim(F.regexp_replace(x, r"(?s)^---.*?---", ""), F.lit(" \t\n\r"))).otherwise(x)


def section(content, heading: str):
    """The lines below the heading ``## heading`` up to the next ``## ``, trimmed; empty without it."""
    return F.btrim(F.regexp_extract(F.concat(F.lit("\n"), F.regexp_replace(content, "\r\n?", "\n")), rf"(?is)\n[ \t]*##\s+{heading}[ \t]*(?:\n(.*?))?(?=\n## |\z)", 1), F.lit(" \t\n"))


def diagram_code(content):
    """The diagram in a document: its fenced block, or from the first start marker to the last end marker; else empty."""
    fence, plain = r"(?is)```plantuml\s*(.*?)```", r"(?s)(@startuml.*@enduml)"
    return F.btrim(F.when(content.rlike(fence), F.regexp_extract(content, fence, 1)).otherwise(F.regexp_extract(content, plain, 1)), F.lit(" \t\n\r"))


def snippet(kind, content, limit: int):
    """What a document of a category gives to a context: examples their requirement and diagram, rules and theory 800
    characters at most, others ``limit``; all cut between lines. The labels are our own.
    """
    b = body(content)
    need, code = clip_lines(section(b, "Requirement"), min(650, limit // 3)), diagram_code(b)
    cut = F.length(code) > 5000
    example = F.concat(F.lit("Requirement of an example:\n"), need, F.when(cut, "\n\nPart of its diagram:\n").otherwise("\n\nIts diagram:\n"), F.when(cut, clip_lines(code, 5000)).otherwise(code))
    return F.when(kind == "dataset_example", example).when(kind.isin("plantuml_rule", "state_diagram_theory"), clip_lines(b, min(limit, 800))).otherwise(clip_lines(b, limit))


def trace(chosen: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """chosen with each document's snippet and its length: what went into each query's context, and why."""
    d = docs.select("name", snippet(F.col("source_type"), F.col("content"), limit).alias("snippet"))
    return chosen.join(d, "name").withColumn("clipped_chars", F.length("snippet"))


def contexts(traced: DataFrame) -> DataFrame:
    """(query, context, n_docs): snippets joined in the order of categories and ranks."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c, _ in CATEGORIES]), F.col("source_type")), F.lit(0))
    g = traced.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "source_type", "rank", "snippet"))).alias("s"))
    return g.select("query", F.array_join(F.transform("s", lambda x: x["snippet"]), "\n\n").alias("context"), F.size("s").cast("long").alias("n_docs"))


def example_documents(pool: DataFrame) -> DataFrame:
    """(name, content, source_type) of pool cases (case_id, complexity, structured_requirement, gold_text) as example documents.

    The title is the requirement's first line with text; the domain what stands before its first dash, or the case's name.
    """
    lines = F.filter(F.transform(F.split("structured_requirement", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    title = F.coalesce(F.try_element_at(lines, F.lit(1)), F.col("case_id"))
    before = F.when(F.contains(title, F.lit("—")), F.substring_index(title, "—", 1)).otherwise(F.substring_index(title, "-", 1))
    own = F.initcap(F.replace(F.regexp_replace("case_id", r"^case_[0-9]+_", ""), F.lit("_"), F.lit(" ")))
    domain = F.coalesce(F.nullif(F.trim(F.replace(before, F.lit("Polished Requirement Specification"), F.lit(""))), F.lit("")), own)
    front = F.concat_ws("\n", F.lit("---"), F.lit("source_type: dataset_example"), F.concat(F.lit("case_id: "), "case_id"), F.concat(F.lit("domain: "), domain), F.concat(F.lit("complexity: "), "complexity"), F.lit("split_role: rag_train"), F.lit("---"))
    trim = lambda c: F.btrim(F.col(c), F.lit(" \t\n\r"))
    text = F.concat(front, F.lit("\n\n# "), title, F.lit("\n\n## Requirement\n\n"), trim("structured_requirement"), F.lit("\n\n## Reference PlantUML\n\n```plantuml\n"), trim("gold_text"), F.lit("\n\n```\n"))
    return pool.select(F.concat(F.lit("dataset_examples/"), "case_id", F.lit(".md")).alias("name"), text.alias("content"), F.lit("dataset_example").alias("source_type"))


def with_case_documents(docs: DataFrame, pool: DataFrame) -> DataFrame:
    """docs (name, content, source_type) and the pool's cases as further, uncategorised documents."""
    need = F.coalesce(F.nullif(F.col("structured_requirement"), F.lit("")), F.col("raw_requirement"))
    text = F.concat(F.lit("Case ID: "), "case_id", F.lit("\nComplexity: "), "complexity", F.lit("\n\nRequirement:\n"), need, F.lit("\n\nReference PlantUML:\n"), "gold_text", F.lit("\n"))
    return docs.select("name", "content", "source_type").union(pool.select(F.concat("case_id", F.lit(".txt")), text, source_type(F.concat("case_id", F.lit(".txt")), text)))
