"""Operator 7: benchmark decontamination with suffix arrays over the training text.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A benchmark item's windows
are its runs of 13 consecutive words, or the whole item if it is shorter. Documents are taken in shards;
each shard's words become ids of the benchmark's vocabulary and its suffixes are sorted into a suffix
array, sparse in that only suffixes whose first three words begin some test suffix are kept. Every window is
binary-searched in it for all its occurrences; every kept suffix is also laid beside its neighbours among the
sorted test suffixes, which gives each document's longest verbatim match (three words at least) and its place. The
bytes of the words inside occurrences are compared before they count. A document is contaminated when at least a
twentieth of its words, and one at least, lie inside occurring windows.

The benchmark is the query set: it is searched in blocks of ``BLOCK_CHARS`` code points, each broadcast on
its own, so its size needs no bound; all documents are searched for every block in one pass, in steps of ``HELD`` blocks
whose arrays a task builds once.

Null and empty texts and items have no words and match nothing; an empty benchmark contaminates nothing;
a repeated item or document counts each for itself; items without an id are searched but not listed. Columns
named like a new one get a leading underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.llm.common import LOWER, aside, text_chunks, word_hashes, word_spans

WINDOW = 13
BLOCK_CHARS = 4_000_000
SHARD_BYTES = 2 << 20
#: Blocks whose arrays one step of a task holds built.
HELD = 2
#: Words of the shortest match that is reported as the longest.
LEAST = 3
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
KIND = "array<struct<start:bigint,end:bigint>>"


def _key(rows: np.ndarray, fill=None, lengths=None):
    """Rows of ids as fixed-width byte strings that sort as the rows do; beyond lengths every byte is fill."""
    b = rows.astype(">u4").view(np.uint8).reshape(len(rows), 4 * rows.shape[1])
    if fill is not None:
        b = b.copy()
        b[np.arange(b.shape[1])[None, :] >= 4 * lengths[:, None]] = fill
    return b.view(f"S{b.shape[1]}").ravel()


def _leads(rows: np.ndarray, n: int) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for k in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k].astype(np.uint64)
    return key


class TestSuffixes:
    """A block of benchmark items: vocabulary (sorted word hashes, with each word's bytes) and all suffixes as rows of the
    ids of their first ``window`` words, 0 beyond their item's end; those that are windows come again with their lengths.
    """

    def __init__(self, items: list[tuple], window: int):
        data = [(t or "").encode() for _, t in items]
        self.buf = LOWER[np.frombuffer(b"".join(data), np.uint8)]
        starts, ends, per = word_spans(self.buf, np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64), NOT_WORD)
        h = word_hashes(self.buf, starts, ends)
        self.vocabulary, first, ids = np.unique(h, return_index=True, return_inverse=True)
        self.word_start, self.word_size = starts[first], (ends - starts)[first]
        self.names = [None if k is None else str(k) for k, _ in items]
        n = np.repeat(per, per)
        owner = np.repeat(np.arange(len(per)), per)
        offset = np.arange(len(ids)) - np.repeat(np.cumsum(per) - per, per)
        steps = np.arange(window)
        padded = np.concatenate([ids + 1, np.zeros(window, np.int64)]).astype(np.int32)
        rows = np.where(steps[None, :] < (n - offset)[:, None], padded[np.arange(len(ids))[:, None] + steps[None, :]], 0).astype(np.int32)
        whole = (n - offset >= window) | ((n < window) & (offset == 0))
        self.rows, self.owner, self.offset, self.lengths = rows[whole], owner[whole], offset[whole], np.minimum(n, window)[whole]
        # windows shorter than LEAST need shorter leads
        self.lead = int(min(LEAST, self.lengths.min())) if len(self.rows) else 0
        self.leads = np.unique(_leads(rows[n - offset >= self.lead], self.lead)) if len(self.rows) else np.zeros(0, np.uint64)
        keys = _key(rows)
        order = np.argsort(keys, kind="stable")
        self.keys, self.sorted, self.of = keys[order], rows[order], owner[order]


def suffix_array(ids: np.ndarray, doc: np.ndarray, t: TestSuffixes, window: int):
    """(positions in suffix order, their first ``window`` ids, those as sortable keys); no suffix reads beyond its document."""
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(window, np.int64)]).astype(np.int32)
    key = _leads(np.stack([padded[k : n + k] for k in range(t.lead)], 1), t.lead)
    slot = np.minimum(np.searchsorted(t.leads, key), max(0, len(t.leads) - 1))
    at = np.flatnonzero((ids > 0) & (t.leads[slot] == key)) if len(t.leads) else np.zeros(0, np.int64)
    docs = np.concatenate([doc, np.full(window, -1, np.int64)])
    steps = at[:, None] + np.arange(window)[None, :]
    rows = np.where(docs[steps] == docs[at][:, None], padded[steps], 0).astype(np.int32)
    keys = _key(rows)
    order = np.argsort(keys, kind="stable")
    return at[order], rows[order], keys[order]


def search(ids: np.ndarray, doc: np.ndarray, t: TestSuffixes, window: int):
    """(position, window number) of every occurrence of every window of the block in the shard, and
    (position, words, item number) of each kept suffix's longest match among the test suffixes, up to ``window`` words.
    """
    none = np.zeros(0, np.int64)
    if not len(t.rows) or not len(ids):
        return none, none, none, none, none
    at, rows, keys = suffix_array(ids, doc, t, window)
    lo = np.searchsorted(keys, _key(t.rows, 0, t.lengths), "left")
    hi = np.searchsorted(keys, _key(t.rows, 255, t.lengths), "right")
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    after = np.searchsorted(t.keys, keys)
    best, item = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for beside in (np.maximum(after - 1, 0), np.minimum(after, len(t.keys) - 1)):
        same = np.cumprod((rows == t.sorted[beside]) & (rows > 0), axis=1).sum(1) if len(at) else none
        item = np.where(same > best, t.of[beside], item)
        best = np.maximum(best, same)
    return at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(which))], which, at, best, item


def equal_words(buf, starts, ends, ids, t: TestSuffixes) -> np.ndarray:
    """Whether each word is, byte by byte, the word of the vocabulary that its id names."""
    size = ends - starts
    ok = size == t.word_size[ids - 1]
    same = np.flatnonzero(ok)
    if len(same):
        n = size[same]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = buf[np.repeat(starts[same], n) + step] == t.buf[np.repeat(t.word_start[ids[same] - 1], n) + step]
        ok[same] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return ok


def _runs(start, end):
    """Merged, sorted half-open intervals."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    first = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(first)
    return start[at], end[np.concatenate([at[1:] - 1, [len(end) - 1]])]


def _shard(buf, offs, t: TestSuffixes, window: int):
    """For one shard and block: words of each row, and for rows with matches (row, hit words, items, longest, its start, its item)."""
    starts, ends, per = word_spans(buf, offs, NOT_WORD)
    h = word_hashes(buf, starts, ends)
    slot = np.minimum(np.searchsorted(t.vocabulary, h), max(0, len(t.vocabulary) - 1))
    ids = np.where(t.vocabulary[slot] == h, slot + 1, 0) if len(t.vocabulary) else np.zeros(len(h), np.int64)
    doc, base = np.repeat(np.arange(len(per)), per), np.cumsum(per) - per
    while True:
        pos, which, at, best, item = search(ids, doc, t, window)
        s, e = _runs(pos, pos + t.lengths[which])
        covered = np.repeat(s - np.cumsum(e - s) + (e - s), e - s) + np.arange(int((e - s).sum()))
        good = equal_words(buf, starts[covered], ends[covered], ids[covered], t) if len(covered) else np.ones(0, bool)
        if good.all():
            break
        ids[covered[~good]] = 0  # words whose hashes collide with a test word's
    out: dict = {}
    near = np.flatnonzero(best >= LEAST)
    if len(near):  # the longest of each row, the first of equal ones
        order = near[np.lexsort((at[near], -best[near], doc[at[near]]))]
        head = np.concatenate([[True], np.diff(doc[at[order]]) != 0])
        for i in order[head]:
            d = int(doc[at[i]])
            out[d] = [None, set(), int(best[i]), int(at[i] - base[d]), t.names[item[i]]]
    if len(pos):
        # windows of one item on one diagonal that follow each other are one verbatim match
        owner, diagonal = t.owner[which], pos - t.offset[which]
        line = np.lexsort((pos, diagonal, owner))
        q, g, o = pos[line], diagonal[line], owner[line]
        brk = np.flatnonzero((np.diff(q) != 1) | (np.diff(g) != 0) | (np.diff(o) != 0) | (np.diff(doc[q]) != 0)) + 1
        edges = np.concatenate([[0], brk, [len(q)]])
        first, last = edges[:-1], edges[1:] - 1
        size = q[last] + t.lengths[which][line][last] - q[first]
        for i in np.lexsort((q[first], -size)):
            d = int(doc[q[first[i]]])
            row = out.setdefault(d, [None, set(), 0, 0, None])
            if size[i] > row[2]:
                row[2:] = [int(size[i]), int(q[first[i]] - base[d]), t.names[o[first[i]]]]
        for i in np.unique(doc[pos] * len(t.names) + owner):
            name = t.names[i % len(t.names)]
            if name is not None:
                out[int(i // len(t.names))][1].add(name)
        for d in np.unique(doc[s]):
            mine = doc[s] == d if len(s) < 64 else slice(*np.searchsorted(doc[s], [d, d + 1]))
            out[int(d)][0] = (s[mine] - base[d], e[mine] - base[d])
    return per, out


#: Columns that annotate() adds.
TAKEN = ("n_words", "spans", "items", "longest", "longest_start", "longest_item", "n_hit", "contaminated")


ADDED = {"n_words": "long", "spans": KIND, "items": "array<string>", "longest": "long", "longest_start": "long", "longest_item": "string"}
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(old: list, row) -> None:
    """Adds what another block found in a document."""
    if old[0] is not None and row[0] is not None:
        old[0] = _runs(np.concatenate([old[0][0], row[0][0]]), np.concatenate([old[0][1], row[0][1]]))
    else:
        old[0] = old[0] or row[0]
    old[1] |= row[1]
    if (-row[2], row[3]) < (-old[2], old[3]):
        old[2:] = row[2:]


def _step(shared: list, text: str, out: list[str], first: bool, window: int):
    """A function for mapInArrow that searches some blocks and adds to what steps before it found."""

    def run(batches):
        blocks = [TestSuffixes(s.value, window) for s in shared]
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            n_words, found = np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            if not first:
                for i, (spans, items, n, start, item) in enumerate(zip(*(get(c).to_pylist() for c in list(ADDED)[1:]), strict=True)):
                    if n or spans:
                        runs = (np.array([x["start"] for x in spans], np.int64), np.array([x["end"] for x in spans], np.int64)) if spans else None
                        found[i] = [runs, set(items), n, start or 0, item]
            for lo, buf, offs in text_chunks(get(text), SHARD_BYTES):
                low = LOWER[buf]
                for t in blocks:
                    per, hits = _shard(low, offs, t, window)
                    n_words[lo : lo + len(per)] = per
                    for d, row in hits.items():
                        if found[lo + d] is None:
                            found[lo + d] = row
                        else:
                            _merge(found[lo + d], row)
            got = [x or [None, (), 0, 0, None] for x in found]
            spans = [[{"start": int(x), "end": int(y)} for x, y in zip(*g[0], strict=True)] if g[0] is not None else [] for g in got]
            new = [pa.array(n_words), pa.array(spans, SPANS), pa.array([sorted(g[1]) for g in got], pa.list_(pa.string()))]
            new += [pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] if g[2] else None for g in got], pa.int64()), pa.array([g[4] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*map(get, out), *new], [*out, *ADDED])

    return run


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with n_words, spans (word intervals inside occurring windows), items (sorted ids), longest (words of the longest
    verbatim match), longest_start (its first word's number in the document), longest_item, n_hit and contaminated.
    """
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    added = ADDED
    names = aside(docs.columns, TAKEN)  # clashing columns step aside
    docs = docs.withColumnsRenamed(names)
    part = benchmark.select("item_id", "text").withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(sorted(((r["item_id"], r["text"]) for r in part.where(F.col("b") == k).collect()), key=str)) for k in range(blocks)]  # BLOCK_CHARS each, plus one item
    keep = [c for c in docs.columns if keep_text or c != text]
    null = lambda c: F.lit(None).cast(added[c]).alias(c)
    df = docs
    for lo in range(0, blocks, HELD):
        # a step holds the arrays of its own blocks, built once in a task; steps follow each other in one stage
        last = lo + HELD >= blocks
        names_in = [c for c in df.columns if c not in added]
        out = [c for c in names_in if not last or c in keep]
        df = df.mapInArrow(_step(shared[lo : lo + HELD], text, out, lo == 0, window), docs.select(*out, *map(null, added)).schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return df.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op7."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest", "longest_start", "longest_item",
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, as they are."""
    kept = annotate(docs, benchmark, window, keep_text=True).where("not contaminated")
    names = aside(docs.columns, TAKEN)
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select item_id, least(len(ws), {WINDOW}) as l, ws, unnest(generate_series(1, greatest(1, len(ws) - {WINDOW - 1}))) as j from i where len(ws) > 0),
wins as (select distinct item_id, l, array_to_string(ws[j : j + l - 1], ' ') as s from win),
pos as (select doc_id, ws, l, unnest(generate_series(1, len(ws) - l + 1)) as p from w, (select distinct l from wins) where len(ws) >= l),
hit as (select pos.doc_id, pos.p, pos.l, wins.item_id from pos join wins on pos.l = wins.l and array_to_string(pos.ws[p : p + pos.l - 1], ' ') = wins.s),
covered as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(generate_series(p, p + l - 1)) as q from hit) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hit where item_id is not null) group by doc_id),
-- longest matches: equal runs of three words lie on a diagonal as far as the texts agree
br as (select row_number() over () as r, ws from i), bg as (select r, p, array_to_string(ws[p : p + {LEAST - 1}], ' ') as g from (select r, ws, unnest(generate_series(1, len(ws) - {LEAST - 1})) as p from br)),
dg as (select doc_id, p, g from (select doc_id, p, array_to_string(ws[p : p + {LEAST - 1}], ' ') as g from (select doc_id, ws, unnest(generate_series(1, len(ws) - {LEAST - 1})) as p from w)) where g in (select g from bg)),
dia as (select doc_id, r, dg.p - bg.p as d, dg.p as p from dg join bg using (g)),
isl as (select doc_id, min(p) - 1 as start, count(*) + {LEAST - 1} as n from (select *, p - row_number() over (partition by doc_id, r, d order by p) as k from dia) group by doc_id, r, d, k union all select doc_id, p - 1, l from hit where l < {LEAST}),
lng as (select doc_id, max(n) as longest, min(start) filter (n = m) as longest_start from (select *, max(n) over (partition by doc_id) as m from isl) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated, cast(coalesce(longest, 0) as bigint) as longest, cast(longest_start as bigint) as longest_start
from w left join covered using (doc_id) left join items using (doc_id) left join lng using (doc_id)"""
