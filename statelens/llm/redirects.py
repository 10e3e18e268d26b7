"""Operator 12: URL filters whose decisions hold for all aliases of a URL.

Rules (allow or block a host with its subdomains, under a path) are matched first; the longest fitting rule is a URL's
own, and its verdict stands. URLs without a rule follow their aliases: redirects and canonical links are the edges of a
graph, its connected components are found in a distributed way, and what holds for one URL of a component holds for
all: blocked where some alias is blocked by a rule, unless some alias is explicitly allowed. All else is allowed.

Edges come from a table of redirects (src, dst), if given, and from the pages: links with rel=canonical and refreshes
that name a URL, outside of comments, scripts and other raw elements. Relative targets are resolved against the page's
base. Targets need not be pages. For telling URLs apart, scheme, default ports, fragment and the host's case don't
count, and an empty path is /.

A null URL, or one without ://, has empty host and path, no rule and no aliases: it is allowed. Null and empty pages
have no edges; targets that can't be resolved make none. Repeated rows are judged each, alike. An empty table gives an
empty one. Columns named like a new one get a leading underscore. Rules are a policy written by people: they are part of
the plan and MAX_RULES at most.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.llm.common import aside, components, staged

MAX_RULES = 10_000
TAKEN = ("host", "path", "rule", "verdict")
# Where HTML holds no tags.
RAW = "script|style|template|noscript|textarea|title|iframe|xmp"
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?:{RAW})(?=[\s/>])[^>]*>|<(link|meta|base)((?=[\s/])(?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S | re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])|\Z", re.I) for name in RAW.split("|")}
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
REFRESH = re.compile(r"""\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?(["']?)(.*?)\1\s*""", re.I | re.S)


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host, its subdomains included, for paths that start with path."""

    allow: bool
    host: str
    path: str


def host(url):
    """The lower-cased (A-Z) host: what follows the first :// up to a slash, question mark or hash."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _after_host(url):
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)


def path(url):
    """What follows the host, up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(_after_host(url), r"(?s)^([^?#]*)", 1), F.lit(""))


def identity(url):
    """16 bytes that tell URLs apart; null without a host."""
    tail = F.regexp_extract(_after_host(url), r"(?s)^([^#]*)", 1)
    whole = F.concat(F.regexp_replace(host(url), r":(80|443)$", ""), F.when(tail.startswith("/"), "").otherwise(F.lit("/")), tail)
    return F.when(host(url) != "", F.unhex(F.md5(whole)))


def own_rule(rules: list[Rule], h, p):
    """The longest rule that fits (longer hosts before shorter ones, then allow): size, host_size, allow, rule; or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit into a plan")
    by_host: dict = {}
    for r in rules:
        by_host.setdefault(r.host, []).append({"size": len(r.host) + len(r.path), "host_size": len(r.host), "allow": r.allow, "rule": r.host + r.path, "path": r.path})
    kind = "struct<size:int,host_size:int,allow:boolean,rule:string,path:string>"
    if not rules:
        return F.lit(None).cast(kind)
    table = F.from_json(F.lit(json.dumps(by_host)), f"map<string,array<{kind}>>")
    labels = F.split(h, r"\.", -1)
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.array_compact(F.transform(suffixes, lambda s: F.try_element_at(table, s)))), lambda r: p.startswith(r["path"]))
    return F.array_max(fitting)


def targets(url: str, page: str) -> list[str]:
    """The URLs that a page names as its canonical address or refreshes to."""
    out, base, at = [], url, 0
    while m := TAG.search(page, at):
        at = m.end()
        tag = (m[1] or "").lower()
        if not tag:
            if not m[0].startswith("<!--"):
                name = re.match(r"[a-z]+", m[0][1:].lower())[0]
                at = RAW_END[name].search(page, at).start()
            continue
        attrs = {}
        for a in ATTRIBUTE.finditer(m[2]):
            attrs.setdefault(a[1].lower(), unescape(a[2].strip("\"'") if a[2][:1] in "\"'" else a[2]).strip())
        if tag == "base" and attrs.get("href"):
            base = attrs["href"] if base is url else base
        elif tag == "link" and "canonical" in attrs.get("rel", "").lower().split() and attrs.get("href"):
            out.append(attrs["href"])
        elif tag == "meta" and attrs.get("http-equiv", "").lower() == "refresh":
            to = REFRESH.fullmatch(attrs.get("content", ""))
            out += [to[2].strip()] if to and to[2].strip() else []
    found = []
    for t in out:
        try:
            t = urljoin(urljoin(url, base), t)
        except ValueError:  # brackets that hold no address
            continue
        if "://" in t and t not in found:
            found.append(t)
    return found


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): an edge for each canonical link and refresh of the pages."""

    def run(batches):
        for b in batches:
            pairs = [(u, t) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in targets(u, h)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs, strict=True)], ["src", "dst"])

    some = pages.where(F.contains("url", F.lit("://")) & F.col("html").rlike("(?i)canonical|http-equiv"))
    return some.select("url", "html").mapInArrow(run, "src string, dst string")


def blocked_aliases(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(node): the identity of every URL whose component has a blocked URL and no allowed one."""
    e = edges.select(identity(F.col("src")).alias("u"), identity(F.col("dst")).alias("v")).where("u is not null and v is not null")
    ends = edges.select(F.col("src").alias("url")).union(edges.select(F.col("dst").alias("url")))
    verdict = own_rule(rules, host(F.col("url")), path(F.col("url")))["allow"]
    ruled = ends.select(identity(F.col("url")).alias("node"), verdict.alias("allow")).where("node is not null and allow is not null").distinct()
    parts = components(e)
    known = parts.join(ruled, "node").groupBy("component").agg(F.bool_or("allow").alias("allow")).where("not allow")
    return parts.join(known.select("component"), "component").select("node")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """pages (url, html, ...) without html, with host, path, rule (host and path of its own rule, or null) and verdict."""
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst").where("src is not null and dst is not null"))
    edges = staged(edges.distinct())
    names = aside(pages.columns, TAKEN)
    url = F.col("url")
    rest = [c for c in pages.columns if c != "html"]
    out = pages.select(*[F.col(c).alias(names.get(c, c)) for c in rest], host(url).alias("host"), path(url).alias("path"))
    r = "__own_rule"
    out = out.withColumn(r, own_rule(rules, F.col("host"), F.col("path")))
    own = F.when(F.col(r)["allow"], "allow").when(~F.col(r)["allow"], "block")
    if edges.isEmpty():
        return out.select("*", F.col(r)["rule"].alias("rule"), F.coalesce(own, F.lit("allow")).alias("verdict")).drop(r)
    # URLs with a rule of their own ask no alias: their key is null and meets nothing
    out = out.withColumn("__node", F.when(F.col(r).isNull(), identity(url)))
    by_alias = staged(blocked_aliases(edges, rules)).distinct().withColumnRenamed("node", "__blocked")
    out = out.join(by_alias, F.col("__node") == F.col("__blocked"), "left")
    verdict = F.coalesce(own, F.when(F.col("__blocked").isNotNull(), "block").otherwise("allow"))
    return out.select(*[names.get(c, c) for c in rest], "host", "path", F.col(r)["rule"].alias("rule"), verdict.alias("verdict"))


def oracle(rules: list[Rule]) -> str:
    """DuckDB SQL of query op12; it reads canonical links that are absolute and hold their rel before their href."""
    values = ", ".join(f"({r.allow}, '{r.host}', '{r.path}')" for r in rules)
    return rf"""
with recursive rules as (select * from (values {values}) v(allow, rh, rp)),
seen as (select page_id, url, unnest(list_prepend(null, regexp_extract_all(html, '<link[^>]*rel="?canonical"?[^>]*href="([^"]+://[^"]*)"', 1))) as dst from pages),
urls as (select distinct url from (select url from seen union all select dst from seen) where url is not null),
cut as (select url, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from urls),
part as (select url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as tail from cut),
fit as (select url, allow, rh || rp as rule, row_number() over (partition by url order by len(rh || rp) desc, len(rh) desc, allow desc) as n from part join rules on ends_with('.' || host, '.' || rh) and starts_with(path, rp)),
own as (select p.*, case when host <> '' then regexp_replace(host, ':(80|443)$', '') || case when starts_with(tail, '/') then '' else '/' end || tail end as node, rule, allow from part p left join fit on fit.url = p.url and n = 1),
edge as (select a.node as u, b.node as v from seen s join own a on a.url = s.url join own b on b.url = s.dst where a.node is not null and b.node is not null),
both_ways as (select u, v from edge union select v, u from edge),
reach as (select u as node, u as other from both_ways union select r.node, e.v from reach r join both_ways e on e.u = r.other),
alias as (select r.node, bool_or(allow) as ok, bool_or(not allow) as no from reach r join own on own.node = r.other where allow is not null group by 1)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, case when allow is not null then case when allow then 'allow' else 'block' end when coalesce(no, false) and not coalesce(ok, false) then 'block' else 'allow' end as verdict
from pages left join own using (url) left join alias using (node)"""
