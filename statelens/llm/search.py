"""Operator 13: ranked lexical search over all documents by Block-Max MaxScore.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Documents are indexed in shards of bounded
text, each a row that holds all its postings: within a shard, documents are numbered by length, so that the postings of
a block of ``BLOCK`` have nearly equal lengths and one pair (highest frequency, least length) bounds their scores well.
Postings are byte-packed gaps and frequencies; the bounds lie outside of them.

A query's lists are taken by falling bound, those of repeated terms once. While the lists not yet taken could lift an
unseen document to the k-th best score, a list is essential and all its documents are candidates. The others only add to
candidates: a candidate goes once its score, its block's bound and the bounds of the rest stay below the k-th best; only
blocks that some candidate still needs are decoded. A task keeps one heap of k for each query over all its shards, so
thresholds carry on from shard to shard; the tasks' heaps are merged by rank. Results are exact: ties at the threshold
are never cut off, equal scores go by doc_id.

Queries are searched in blocks of ``QUERY_CHARS`` code points; a block goes out with its terms' weights, all documents
answer it in one pass over the staged index. Weights need how many documents hold a term: counted from the index, for
the block's terms.

Null and empty texts, and texts without a term, are no documents and no queries. Repeated rows count and rank each for
themselves; a null doc_id ranks behind others of its score, a null item_id is answered like others. Empty tables give no
rows. Further columns are ignored. Texts are indexed whole; a text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelens.llm.common import LARGE_ROWS, LOWER, small_batches, staged, text_chunks, word_spans

SHARD_BYTES = 4 << 20
#: Shards that a task sees at once, however many its part of the index has.
SHARDS = 2
BLOCK = 128
QUERY_CHARS = 1_000_000
# What is no letter, digit or non-ASCII character, and the same as an expression.
NOT_TERM = np.zeros(256, bool)
NOT_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = {
    "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "terms": pa.list_(pa.binary()), "df": pa.list_(pa.int64()), "first": pa.list_(pa.int32()), "last": pa.list_(pa.int32()),
    "top_tf": pa.list_(pa.int32()), "widths": pa.list_(pa.int32()), "postings": pa.binary(), "n_docs": pa.int64(), "n_terms": pa.int64(),
}
DDL = "doc_ids array<long>, lengths array<long>, terms array<binary>, df array<long>, first array<int>, last array<int>, top_tf array<int>, widths array<int>, postings binary, n_docs long, n_terms long"


def _width(x):
    return np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4))


def build(ids: list, buf: np.ndarray, offs: np.ndarray):
    """A shard's row from the texts' bytes, or None without any term."""
    low = LOWER[buf]
    starts, ends, per = word_spans(low, offs, NOT_TERM)
    if not len(starts):
        return None
    held = np.flatnonzero(per)
    by_length = held[np.argsort(per[held], kind="stable")]
    number = np.zeros(len(per), np.int64)
    number[by_length] = np.arange(len(by_length))
    size = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(size.tobytes()), pa.py_buffer(low[~NOT_TERM[low]].tobytes())]).dictionary_encode()
    key = words.indices.to_numpy().astype(np.int64) * len(by_length) + np.repeat(number, per)
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(new, len(key)))
    term, doc = np.divmod(key[new], len(by_length))
    df = np.bincount(term, minlength=len(words.dictionary))
    begin = np.cumsum(df) - df
    pos = np.arange(len(term)) - begin[term]
    head = pos % BLOCK == 0
    gap = np.where(head, 0, np.diff(doc, prepend=0))
    w_gap, w_tf = _width(np.maximum.reduceat(gap, begin)), _width(np.maximum.reduceat(tf, begin))
    place = np.cumsum(df * (w_gap + w_tf)) - df * (w_gap + w_tf)
    out = np.zeros(int((df * (w_gap + w_tf)).sum()), np.uint8)
    for values, width, at in ((gap, w_gap, place), (tf, w_tf, place + df * w_gap)):
        w = width[term]
        for k in range(4):
            some = np.flatnonzero(w > k)
            out[at[term[some]] + pos[some] * w[some] + k] = values[some] >> (8 * k) & 255
    blocks = np.flatnonzero(head)
    last = np.append(blocks[1:] - 1, len(doc) - 1)
    row = {
        "doc_ids": [ids[i] for i in by_length], "lengths": per[by_length], "terms": words.dictionary, "df": df, "first": doc[blocks], "last": doc[last], "top_tf": np.maximum.reduceat(tf, blocks),
        "widths": w_gap * 8 + w_tf, "postings": out.tobytes(), "n_docs": len(by_length), "n_terms": len(starts),
    }
    return pa.RecordBatch.from_arrays([pa.array([row[c]], t) if c != "terms" else pa.ListArray.from_arrays(pa.array([0, len(row[c])], pa.int32()), row[c].cast(pa.binary())) for c, t in FIELDS.items()], list(FIELDS))


class Shard:
    """A shard's row, opened for a block of queries: only the terms that they hold, their lists decoded on demand."""

    def __init__(self, batch, i: int, terms: pa.Array, n: int, total: int):
        get = lambda c: batch.column(list(FIELDS).index(c))[i]
        array = lambda c: get(c).values.to_numpy(zero_copy_only=False)
        ids = get("doc_ids").values
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        df = array("df")
        #: What a document's length costs: 25 for none, 100 for the mean length.
        self.cost = 100 - 75 + (75 * array("lengths") * n) // total
        self.df, self.width = df, array("widths")
        self.blocks = np.concatenate([[0], np.cumsum(-(-df // BLOCK))])
        self.place = np.concatenate([[0], np.cumsum(df * ((self.width >> 3) + (self.width & 7)))])
        self.first, self.last = array("first").astype(np.int64), array("last").astype(np.int64)
        self.bound = self.part(array("top_tf").astype(np.int64), self.first)
        self.postings = get("postings").as_buffer()
        at = pc.index_in(terms, value_set=get("terms").values)
        self.at = at.fill_null(-1).to_numpy()
        held = np.flatnonzero(self.at >= 0)
        self.top = np.zeros(len(self.at), np.int64)
        for q in held:
            t = self.at[q]
            self.top[q] = self.bound[self.blocks[t] : self.blocks[t + 1]].max()
        self.lists: dict = {}
        self.decoded: dict = {}

    def part(self, tf, doc):
        return (1_000_000_000 * tf) // (1000 * tf + 8 * self.cost[doc])

    def _raw(self, t, lo, hi):
        """Gaps and frequencies of a list's postings lo to hi."""
        w_gap, w_tf, n = int(self.width[t]) >> 3, int(self.width[t]) & 7, int(self.df[t])
        read = lambda at, w: np.frombuffer(self.postings, np.dtype(f"<u{w}"), hi - lo, at + lo * w).astype(np.int64)
        return read(int(self.place[t]), w_gap), read(int(self.place[t]) + n * w_gap, w_tf)

    def whole(self, q):
        """(documents, parts) of a term's list."""
        if q not in self.lists:
            t = self.at[q]
            gap, tf = self._raw(t, 0, int(self.df[t]))
            first, last = self.first[self.blocks[t] : self.blocks[t + 1]], self.last[self.blocks[t] : self.blocks[t + 1]]
            gap[::BLOCK] = first - np.concatenate([[0], last[:-1]])
            doc = np.cumsum(gap)
            self.lists[q] = doc, self.part(tf, doc)
        return self.lists[q]

    def block(self, q, b):
        """(documents, parts) of a block of a term's list."""
        if (q, b) not in self.decoded:
            t = self.at[q]
            gap, tf = self._raw(t, b * BLOCK, min((b + 1) * BLOCK, int(self.df[t])))
            doc = np.cumsum(gap) + self.first[self.blocks[t] + b]
            self.decoded[q, b] = doc, self.part(tf, doc)
        return self.decoded[q, b]


def _kth(score, k):
    return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


def best(shard: Shard, query: list[tuple[int, int]], floor: int, k: int, seen: list | None = None):
    """(documents, scores) of a shard that may belong to the k best, those of floor at least; query: (term, weight).

    seen, if given, is told the blocks that non-essential lists decode.
    """
    lists = sorted(((int(shard.top[q]) * w, q, w) for q, w in query if shard.at[q] >= 0 and w > 0), reverse=True)
    rest = sum(b for b, _, _ in lists)
    score = np.zeros(len(shard.ids), np.int64)
    floor, taken, most = max(floor, 1), 0, 0
    for b, q, w in lists:  # essential: without this list and the ones after it, a new document could not reach the floor
        if rest < floor:
            break
        doc, part = shard.whole(q)
        score[doc] += w * part
        taken, rest = taken + 1, rest - b
        most = max(most, int(score[doc].max()))
        if rest < most:
            floor = max(floor, _kth(score, k))
    docs = np.flatnonzero((score + rest >= floor) & (score > 0))
    mine = score[docs]
    for b, q, w in lists[taken:]:
        if not len(docs):
            break
        rest -= b
        t = shard.at[q]
        lo, hi = shard.blocks[t], shard.blocks[t + 1]
        at = np.searchsorted(shard.last[lo:hi], docs)
        within = at < hi - lo
        bound = np.where(within, shard.bound[lo + np.minimum(at, hi - lo - 1)], 0) * w
        bound[within & (docs < shard.first[lo + np.minimum(at, hi - lo - 1)])] = 0
        keep = mine + bound + rest >= floor
        docs, mine, at, bound = docs[keep], mine[keep], at[keep], bound[keep]
        for x in np.unique(at[bound > 0]):
            if seen is not None:
                seen.append((q, int(x)))
            doc, part = shard.block(q, int(x))
            some = np.flatnonzero((at == x) & (bound > 0))
            slot = np.minimum(np.searchsorted(doc, docs[some]), len(doc) - 1)
            mine[some] += np.where(doc[slot] == docs[some], part[slot] * w, 0)
        floor = max(floor, _kth(mine, k))
        keep = mine + rest >= floor
        docs, mine = docs[keep], mine[keep]
    keep = mine >= floor
    return docs[keep], mine[keep]


class Index:
    """All documents' postings in shards, staged in the shared folder: ``search`` answers any number of query tables."""

    def __init__(self, docs: DataFrame):
        def run(batches):
            for b in batches:
                ids = b.column(0).to_pylist()
                for lo, buf, offs in text_chunks(b.column(1), SHARD_BYTES):
                    row = build(ids[lo : lo + len(offs) - 1], buf, offs)
                    if row is not None:
                        yield row

        self.shards = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DDL), options=LARGE_ROWS)
        stats = self.shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        self.n, self.total = stats[0] or 0, stats[1] or 0

    def held(self, terms: list[bytes]) -> dict[bytes, int]:
        """How many documents hold each of these terms."""
        sent = self.shards.sparkSession.sparkContext.broadcast(terms)

        def run(batches):
            wanted, n = pa.array(sent.value, pa.binary()), np.zeros(len(sent.value), np.int64)
            for b in batches:
                for i in range(b.num_rows):
                    at = pc.index_in(wanted, value_set=b.column(0)[i].values).fill_null(-1).to_numpy()
                    n[at >= 0] += b.column(1)[i].values.to_numpy()[at[at >= 0]]
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"t": pa.array(some), "n": pa.array(n[some])})

        with small_batches(self.shards.sparkSession, SHARDS):
            rows = self.shards.select("terms", "df").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()  # a row for each term of the block at most
        return {terms[r.t]: r.n for r in rows}

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """item_id, rank, doc_id, score: the k best documents of each query (item_id, text), those of a score above 0."""
        spark = self.shards.sparkSession
        size = queries.agg(F.sum(F.length("text"))).first()[0] or 0
        blocks = max(1, -(-size // QUERY_CHARS))
        part = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        found = [self._block([(r.item_id, r.text) for r in part.where(F.col("b") == i).collect()], k) for i in range(blocks)] if self.n else []  # QUERY_CHARS each, about
        out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        for f in found:
            out = out.union(f)
        return out

    def _block(self, items: list[tuple], k: int) -> DataFrame:
        asked = [(i, Counter(x.encode() for x in TERM.findall((t or "").translate(str.maketrans(UPPER, LOWERED))))) for i, t in sorted(items, key=str)]
        terms = sorted({x for _, c in asked for x in c})
        held = self.held(terms)
        number = {x: i for i, x in enumerate(terms)}
        weight = lambda x: math.floor(1000 * math.log((2 * self.n + 2) / (2 * held[x] + 1)))
        plan = [(i, [(number[x], weight(x) * n) for x, n in c.items() if x in held]) for i, c in asked]
        sent = self.shards.sparkSession.sparkContext.broadcast((terms, plan))
        n, total = self.n, self.total

        def run(batches):
            terms, plan = sent.value
            wanted = pa.array(terms, pa.binary())
            heaps = [[] for _ in plan]
            for b in batches:
                for i in range(b.num_rows):
                    shard = Shard(b, i, wanted, n, total)
                    for q, (_, query) in enumerate(plan):
                        heap = heaps[q]
                        docs, score = best(shard, query, heap[-1][0] if len(heap) == k else 0, k)
                        order = np.lexsort((shard.ids[docs], shard.no_id[docs], -score))[:k]
                        got = [(int(score[o]), bool(shard.no_id[docs[o]]), int(shard.ids[docs[o]])) for o in order]
                        heaps[q] = sorted(heap + got, key=lambda x: (-x[0], x[1], x[2]))[:k]
            rows = [(q, plan[q][0], None if none else d, s) for q, heap in enumerate(heaps) for s, none, d in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["q", "item_id", "doc_id", "score"])

        with small_batches(self.shards.sparkSession, SHARDS):
            best_of_tasks = staged(self.shards.mapInArrow(run, "q long, item_id long, doc_id long, score long"))
        w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return best_of_tasks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select doc_id, {_TERMS} as ts from documents),
s as (select count(*) as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
q as (select item_id, unnest({_TERMS}) as t from benchmark),
o as (select doc_id, n, t from (select doc_id, len(ts)::bigint as n, unnest(ts) as t from d) where t in (select t from q)),
p as (select doc_id, n, t, count(*)::bigint as tf from o group by doc_id, n, t),
w as (select t, floor(1000 * ln((2 * s.n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s group by t, s.n),
x as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * s.n) // s.l))))::bigint as score from q join w using (t) join p using (t), s group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from x where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10"""
