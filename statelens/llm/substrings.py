"""Operator 8: removal of repeated byte strings, by a sparse suffix array sorted with hashed comparisons.

A string of ``SPAN`` bytes that starts at two places, in one document or two, is removed from both. Beside
this rule the operator names passages: runs of bytes that strings of ``SHORT`` bytes with a second place
cover, if they hold ``WORDS`` words or more. Both rules share one search.

Every window of SHORT bytes has one anchor, its least hashed ``GRAM``-byte gram (leftmost if tied), so equal
windows have equal anchors at equal distances, and so do equal windows of SPAN bytes, which begin with one.
An anchor answers for the consecutive windows that chose it; their bytes, up to SPAN from the last window's
start, are its context.

1. Each text gives its anchors: hash of the gram, 128-bit digest of the context. Anchors whose gram has one
   place only are dropped. Equal contexts settle all their windows by counting, however many copies there are.
2. The other contexts (one of each kind) are fetched. The suffixes that start at their anchors are sorted:
   prefix polynomial hashes and binary search give the common extension of two suffixes, so a comparison
   costs a logarithm of their length, in a bottom-up mergesort. Windows at one distance from the anchor are
   equal where the extensions to the right reach far enough and the hashes to the left agree; the bytes of
   every match are compared before it counts.
   A gram with more than HOT different contexts is never gathered: its windows are split into blocks of
   neighbouring distances, and digests of a block's whole bytes and of the bytes that all its windows
   share are counted; only blocks with a partner go on to the next, finer level. Here too bytes decide: whole blocks
   with a partner are grouped once more by their bytes before they count.
3. Each text's covered bytes are cut out. Texts that occur twice as a whole (equal SHA-256) are repeats as a whole.

Null is the empty text. Shorter texts than the spans keep everything. Repeated rows count as places of their
own; a null doc_id is a document like any other. Longer texts than PIECE bytes are read in overlapping pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.llm.common import BYTE_HASH, MULTIPLIER, discard, mix, powers, staged, text_chunks

SPAN, SHORT, GRAM, WORDS = 400, 240, 80, 50
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
PIECE = 1 << 20
SORT_BYTES = 2 << 20
#: Different contexts of one gram that one task sorts.
HOT = 4096
#: Windows in the blocks of each level for grams beyond that.
LEVELS = (80, 20, 5, 1)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class Hashes:
    """Prefix polynomial hashes of some bytes: of(i, n) hashes the n bytes from i, for arrays of i and n."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_HASH[buf] * powers(n)[:n], out=self.prefix[1:])
        self.unshift = powers(n + 1, INVERSE)

    def of(self, start, n):
        return (self.prefix[start + n] - self.prefix[start]) * self.unshift[start]


def anchors(buf: np.ndarray, offs: np.ndarray, short: int = SHORT, gram: int = GRAM, span: int = SPAN, stop: int | None = None):
    """(row, anchor, first window, last window, context's end, gram hash) arrays; positions count from each row's start.

    Windows start before ``stop`` (of the buffer) only, if given.
    """
    n, w = len(buf), short - gram + 1
    size = np.diff(offs)
    z = np.zeros(0, np.int64)
    if not (size >= short).any():
        return z, z, z, z, z, z.astype(np.uint64)
    h = Hashes(buf)
    ends = np.repeat(offs[1:], size)
    at = np.arange(n)
    grams = np.full(n, TOP)
    whole = np.flatnonzero(at + gram <= ends)
    grams[whole] = mix(h.of(whole, gram))
    # order by 36 bits of the hash, then by position; a chunk is shorter than 2^28
    key = np.where(grams == TOP, TOP, (grams & ~np.uint64((1 << 28) - 1)) | at.astype(np.uint64))
    blocks = -(-(n + w) // w)
    padded = np.full(blocks * w, TOP)
    padded[:n] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(at + short <= ends)
    if stop is not None:
        starts = starts[starts < stop]
    if not len(starts):
        return z, z, z, z, z, z.astype(np.uint64)
    anchor = (np.minimum(behind[starts], ahead[starts + w - 1]) & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    i = np.flatnonzero(new)
    a, lo, hi = anchor[i], starts[i], starts[np.concatenate([i[1:] - 1, [len(starts) - 1]])]
    row = np.searchsorted(offs, a, side="right") - 1
    base = offs[row]
    return row, a - base, lo - base, hi - base, np.minimum(hi + span, offs[row + 1]) - base, grams[a]


def pack(a, lo, hi, end):
    """An anchor's place as one number: position, bytes before it, windows, bytes behind the last window's start."""
    return (a << 32) | ((a - lo) << 22) | ((hi - lo) << 12) | (end - hi)


def unpack(at):
    """(anchor, first window, last window, context's end) of pack()."""
    a = at >> 32
    lo = a - ((at >> 22) & 1023)
    hi = lo + ((at >> 12) & 1023)
    return a, lo, hi, hi + (at & 4095)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sha, k1, k2): null texts made empty; k1 and k2 are 120 bits of the SHA-256."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    bits = lambda i: F.conv(F.substring("sha", i, 15), 16, 10).cast("long")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", sha).withColumns({"k1": bits(1), "k2": bits(16)})


ANCHOR = "k1 long, k2 long, at long, gram long, c1 long, c2 long"


def _anchors(docs: DataFrame, short: int, gram: int, span: int) -> DataFrame:
    def found(buf, offs, p, stop, k1, k2):
        row, a, lo, hi, end, g = anchors(buf, offs, short, gram, span, stop)
        raw, base = buf.tobytes(), offs[row] if len(row) else row
        heads = np.stack([a - lo, hi - lo], 1).astype("<i4").tobytes()
        ctx = [hashlib.blake2b(raw[s:e], digest_size=16, key=heads[8 * i : 8 * i + 8]).digest() for i, (s, e) in enumerate(zip((base + lo).tolist(), (base + end).tolist(), strict=True))]
        c = np.frombuffer(b"".join(ctx), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row], k2[row], pack(a + p, lo + p, hi + p, end + p), g.view(np.int64), c[:, 0], c[:, 1])], ["k1", "k2", "at", "gram", "c1", "c2"])

    def run(batches):
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for r, buf, offs in text_chunks(b.column(2)):
                n = len(offs) - 1
                if n > 1 or len(buf) <= PIECE:
                    yield found(buf, offs, 0, None, k1[r : r + n], k2[r : r + n])
                else:
                    for p in range(0, len(buf), PIECE):
                        piece = buf[p : p + PIECE + span]
                        yield found(piece, np.array([0, len(piece)]), p, PIECE, k1[r : r + 1], k2[r : r + 1])

    return docs.select("k1", "k2", "text").mapInArrow(run, ANCHOR)


def common_extension(h: Hashes, i, j, most):
    """Length of the longest common prefix of the suffixes at i and j, up to most: binary search over hashes."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64).copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = h.of(i, mid) == h.of(j, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_sort(buf: np.ndarray, h: Hashes, start, end, group) -> np.ndarray:
    """The order of the suffixes buf[start:end] by (group, bytes): bottom-up mergesort with hashed comparisons.

    Each level finds, for all elements at once, their rank in the neighbouring run by binary search.
    """
    n = len(start)
    size = end - start

    def before(x, y, tie):
        """Whether suffix x sorts before y; equal ones do if tie."""
        most = np.minimum(size[x], size[y])
        same = group[x] == group[y]
        e = np.zeros(len(x), np.int64)
        if same.any():
            e[same] = common_extension(h, start[x[same]], start[y[same]], most[same])
        cut = np.where(e < most, e, 0)
        byte = np.where(e < most, buf[np.minimum(start[x] + cut, len(buf) - 1)].astype(np.int64) - buf[np.minimum(start[y] + cut, len(buf) - 1)], size[x] - size[y])
        byte = np.where(same, byte, group[x] - group[y])
        return (byte < 0) | (tie & (byte == 0))

    order, width = np.argsort(group, kind="stable"), 1
    while width < n:
        at = np.arange(n)
        run = at // width
        mate = run ^ 1
        lo, hi = np.minimum(mate * width, n), np.minimum((mate + 1) * width, n)
        first, left, right = (run & 1) == 0, lo.copy(), hi.copy()
        while (todo := np.flatnonzero(left < right)).size:
            mid = (left[todo] + right[todo]) // 2
            # an element of the right run goes behind equal ones of the left run
            less = before(order[mid], order[at[todo]], ~first[todo])
            left[todo] = np.where(less, mid + 1, left[todo])
            right[todo] = np.where(less, right[todo], mid)
        place = (run // 2) * 2 * width + (at - run * width) + (left - lo)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, width * 2
    return order


def equal_windows(buf, start, anchor, end, lead, group, spans=(SPAN,)) -> list[tuple]:
    """For each span (context, first distance, last distance) of the windows that equal another context's.

    Context i is buf[start:end] with its anchor at ``anchor``; its windows start t bytes before the anchor for
    t from lead to anchor - start, as far as the context holds them. Contexts of one group have equal grams.
    """
    h = Hashes(buf)
    order = suffix_sort(buf, h, anchor, end, group)
    x, y = order[:-1], order[1:]
    ext = np.where(group[x] == group[y], common_extension(h, anchor[x], anchor[y], np.minimum(end[x] - anchor[x], end[y] - anchor[y])), -1)
    return [_windows(buf, h, order, ext, anchor, np.maximum(lead, anchor - (end - span)), anchor - start, group, span) for span in spans]


def _windows(buf, h: Hashes, order, ext, anchor, lead, t_high, group, span: int):
    """equal_windows() for one span, given the suffix order and the common extensions of its neighbours."""
    none = np.zeros(0, np.int64)
    hits_i, hits_t, hits_j = [], [], []
    for t in range(int(max(0, lead.min(initial=1 << 40))), int(t_high.max(initial=-1)) + 1):
        cls = np.concatenate([[0], np.cumsum(ext < span - t)])
        at = np.flatnonzero((lead[order] <= t) & (t <= t_high[order]))
        if len(at) < 2:
            continue
        i = order[at]
        key = mix(h.of(anchor[i] - t, np.full(len(i), t)) + mix(cls[at].astype(np.uint64)))
        by = np.argsort(key, kind="stable")
        k = key[by]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        pos = np.flatnonzero(head)
        n = np.diff(np.concatenate([pos, [len(k)]]))
        many = np.repeat(n > 1, n)
        if not many.any():
            continue
        mate = np.repeat(pos, n)
        mate = np.where(mate == np.arange(len(k)), np.minimum(mate + 1, len(k) - 1), mate)
        hits_i.append(i[by][many])
        hits_j.append(i[by[mate]][many])
        hits_t.append(np.full(int(many.sum()), t))
    if not hits_i:
        return none, none, none
    i, j, t = np.concatenate(hits_i), np.concatenate(hits_j), np.concatenate(hits_t)
    o = np.lexsort((t, j, i))
    i, j, t = i[o], j[o], t[o]
    head = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (t[1:] != t[:-1] + 1)]))
    first, last = t[head], t[np.concatenate([head[1:] - 1, [len(t) - 1]])]
    i, j = i[head], j[head]
    good = np.array([np.array_equal(buf[anchor[a] - q : anchor[a] - p + span], buf[anchor[b] - q : anchor[b] - p + span]) for a, b, p, q in zip(i, j, first, last, strict=True)], bool)
    if not good.all():  # a collision of hashes: those contexts are compared byte by byte with their whole group
        extra = []
        for a, p, q in zip(i[~good], first[~good], last[~good], strict=True):
            mates = [b for b in np.flatnonzero(group == group[a]) if b != a]
            for s in range(int(p), int(q) + 1):
                mine = buf[anchor[a] - s : anchor[a] - s + span]
                if any(lead[b] <= s <= t_high[b] and np.array_equal(mine, buf[anchor[b] - s : anchor[b] - s + span]) for b in mates):
                    extra.append((a, s, s))
        e = np.array(extra, np.int64).reshape(-1, 3)
        return np.concatenate([i[good], e[:, 0]]), np.concatenate([first[good], e[:, 1]]), np.concatenate([last[good], e[:, 2]])
    return i, first, last


CONTEXT = "gram long, k1 long, k2 long, at long, data binary, hot boolean"


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted contexts. wanted: k1, k2, d (a doc_id of the text), places (array of gram, at, hot)."""

    def run(batches):
        for b in batches:
            for r0 in range(0, b.num_rows, 100):
                s = b.slice(r0, 100)
                get = {c: s.column(s.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "text", "places")}
                out: list = []
                for k1, k2, text, places in zip(*get.values(), strict=True):
                    raw = text.encode()
                    for p in places:
                        _, lo, _, end = unpack(p["at"])
                        out.append((p["gram"], k1, k2, p["at"], raw[lo:end], p["hot"]))
                for lo in range(0, len(out), 4000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[lo : lo + 4000], strict=True), (*[pa.int64()] * 4, pa.binary(), pa.bool_()), strict=True)], ["gram", "k1", "k2", "at", "data", "hot"])

    one = (docs["k1"] == wanted["k1"]) & (docs["k2"] == wanted["k2"]) & docs["doc_id"].eqNullSafe(wanted["d"])
    return docs.join(wanted, one).select(docs["k1"], docs["k2"], "text", "places").mapInArrow(run, CONTEXT)


COVERED = "k1 long, k2 long, start long, end long, long boolean"


def _compare(contexts: DataFrame, short: int, span: int) -> DataFrame:
    """COVERED bytes of windows that equal another context's. Rows of one gram arrive together, in order."""

    def solve(parts):
        cols = {c: np.concatenate([p[c] for p in parts]) for c in ("gram", "k1", "k2", "at")}
        sizes = np.concatenate([p["size"] for p in parts])
        buf = np.frombuffer(b"".join(p["data"] for p in parts), np.uint8)
        _, inverse = np.unique(cols["gram"], return_inverse=True)
        a, lo, hi, _ = unpack(cols["at"])
        end = np.cumsum(sizes)
        start = end - sizes
        made = []
        for width, (i, p, q) in zip((short, span), equal_windows(buf, start, start + a - lo, end, a - hi, inverse, (short, span)), strict=True):
            made.append((cols["k1"][i], cols["k2"][i], a[i] - q, a[i] - p + width, np.full(len(i), width == span)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], ["k1", "k2", "start", "end", "long"])

    def run(batches):
        held: list = []
        held_bytes = 0
        for b in batches:
            ints = {c: b.column(b.schema.get_field_index(c)).to_numpy() for c in ("gram", "k1", "k2", "at")}
            # rows that repeat a text's doc_id and text bring the same place again
            ok = np.ones(b.num_rows, bool)
            ok[1:] = np.any([ints[c][1:] != ints[c][:-1] for c in ints], axis=0)
            if held and b.num_rows:
                ok[0] = any(held[-1][c][-1] != ints[c][0] for c in ints)
            ints = {c: x[ok] for c, x in ints.items()}
            data = b.column(b.schema.get_field_index("data")).filter(pa.array(ok)).to_pylist()
            gram = ints["gram"]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(gram)) + 1, [len(gram)]]) if len(gram) else np.zeros(1, int)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held_bytes > SORT_BYTES and held[-1]["gram"][-1] != gram[lo]:
                    yield solve(held)
                    held, held_bytes = [], 0
                piece = {c: x[lo:hi] for c, x in ints.items()}
                piece |= {"size": np.array([len(x) for x in data[lo:hi]], np.int64), "data": b"".join(data[lo:hi])}
                held_bytes += len(piece["data"])
                held.append(piece)
        if held:
            yield solve(held)

    return contexts.mapInArrow(run, COVERED)


def _block_digests(contexts: DataFrame, width: int, span: int) -> DataFrame:
    """(gram, k1, k2, at, a, core, whole) for each wanted block of each context: windows at distances a .. a + width - 1.

    core digests the bytes that all windows of the block share, whole all their bytes (null if the context lacks some).
    contexts may have ``want`` (array of a); without it every block that the context touches is wanted.
    """

    def run(batches):
        for b in batches:
            for r0 in range(0, b.num_rows, 1000):
                s = b.slice(r0, 1000)
                get = {c: s.column(s.schema.get_field_index(c)).to_pylist() for c in s.schema.names}
                out: list = []
                for i, data in enumerate(get["data"]):
                    pos, first, last, _ = unpack(get["at"][i])
                    at = pos - first
                    low, high = max(pos - last, at - (len(data) - span)), at
                    for a in get["want"][i] if "want" in get else range(max(0, low) // width * width, high + 1, width):
                        z = a + width - 1
                        if a > high or z < low:
                            continue
                        core = hashlib.blake2b(data[at - a : at - z + span], digest_size=16).digest()
                        whole = hashlib.blake2b(data[at - z : at - a + span], digest_size=16).digest() if low <= a and z <= high else None
                        out.append((get["gram"][i], get["k1"][i], get["k2"][i], get["at"][i], a, core, whole))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.int32(), pa.binary(), pa.binary()), strict=True)], ["gram", "k1", "k2", "at", "a", "core", "whole"])

    return contexts.mapInArrow(run, "gram long, k1 long, k2 long, at long, a int, core binary, whole binary")


def _block_bytes(contexts: DataFrame, width: int, span: int) -> DataFrame:
    """(gram, k1, k2, at, a, data): all bytes of the blocks of windows that contexts want, as in _block_digests."""
    gone = "gram long, k1 long, k2 long, at long, a int, data binary"

    def run(batches):
        for b in batches:
            for r0 in range(0, b.num_rows, 1000):
                s = b.slice(r0, 1000)
                get = {c: s.column(s.schema.get_field_index(c)).to_pylist() for c in s.schema.names}
                out = []
                for i, data in enumerate(get["data"]):
                    pos, first, _, _ = unpack(get["at"][i])
                    at = pos - first
                    out += [(get["gram"][i], get["k1"][i], get["k2"][i], get["at"][i], a, data[at - a - width + 1 : at - a + span]) for a in get["want"][i]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.int32(), pa.binary()), strict=True)], [c.split()[0] for c in gone.split(", ")])

    return contexts.mapInArrow(run, gone)


def _compare_hot(contexts: DataFrame, span: int, long: bool) -> DataFrame:
    """COVERED as _compare gives it for one span, by counting: no task gathers the contexts of a gram.

    Digests find the blocks that have a partner; those that are equal as a whole are then counted by their bytes.
    """
    covered, active = None, contexts
    me = F.struct("k1", "k2", "at")
    pos = F.shiftright("at", 32)
    for width, finer in zip(LEVELS, (*LEVELS[1:], 0), strict=True):
        h = staged(_block_digests(active, width, span))
        group = ["gram", "a", "core"]
        shared = h.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        equal = h.where("whole is not null").groupBy(*group, "whole").agg(F.count("*").alias("n"), F.min(me).alias("one")).where("n > 1").drop("n")
        alike = h.join(equal, [*group, "whole"]).groupBy("k1", "k2", "at").agg(F.collect_set("a").alias("want"))
        blocks = staged(_block_bytes(contexts.join(alike, ["k1", "k2", "at"]), width, span))
        same = blocks.groupBy("gram", "a", "data").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        done = blocks.join(same, ["gram", "a", "data"]).select("k1", "k2", (pos - F.col("a") - (width - 1)).alias("start"), (pos - F.col("a") + span).alias("end"), F.lit(long).alias("long"))
        covered = staged(done) if covered is None else covered.union(staged(done))
        if finer:
            # blocks with a partner; of equal ones the first goes on, to witness for contexts that hold only a part
            left = h.join(shared, group).join(equal, [*group, "whole"], "left").where(F.col("one").isNull() | (F.col("one") == me))
            parts = F.sequence(F.col("a"), F.col("a") + (width - finer), F.lit(finer))
            want = left.groupBy("k1", "k2", "at").agg(F.flatten(F.collect_list(parts)).alias("want"))
            active = contexts.join(want, ["k1", "k2", "at"])
    return covered


def _union(intervals) -> list[tuple[int, int]]:
    """Merged, sorted half-open intervals."""
    out: list = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _without(raw: bytes, gone) -> bytes:
    at, kept = 0, []
    for s, e in gone:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]])


def _cut(docs: DataFrame, words: int, short: int, span: int) -> DataFrame:
    """dedup()'s columns. docs: doc_id, text, sha, covered (array of start, end, long; null: nothing) and whole."""

    def run(batches):
        for b in batches:
            for r0 in range(0, b.num_rows, 500):
                s = b.slice(r0, 500)
                get = {c: s.column(s.schema.get_field_index(c)) for c in s.schema.names}
                texts, sha = get["text"].to_pylist(), get["sha"].to_pylist()
                size, gone, runs, passages = [], [], [], []
                for i, (covered, whole) in enumerate(zip(get["covered"].to_pylist(), get["whole"].to_pylist(), strict=True)):
                    raw = texts[i].encode()
                    size.append(len(raw))
                    spans = [(0, len(raw))] if whole and len(raw) >= span else _union((c["start"], c["end"]) for c in covered or () if c["long"])
                    near = [(0, len(raw))] if whole and len(raw) >= short else _union((c["start"], c["end"]) for c in covered or ())
                    near = [(x, y) for x, y in near if len(raw[x:y].split()) >= words]
                    gone.append(sum(y - x for x, y in spans))
                    runs.append(len(spans))
                    passages.append(len(near))
                    if spans:
                        sha[i] = hashlib.sha256(_without(raw, spans)).hexdigest()
                    if spans or near:
                        texts[i] = _without(raw, _union([*spans, *near])).decode(errors="ignore")
                longs = [pa.array(x, pa.int64()) for x in (size, gone, runs)]
                yield pa.RecordBatch.from_arrays([get["doc_id"], *longs, pa.array(sha, pa.string()), pa.array(passages, pa.int64()), pa.array(texts, pa.string())], [f.name for f in schema])

    schema = docs.select("doc_id").schema
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, "long")
    schema = schema.add("kept_sha256", "string").add("n_passages", "long").add("text", "string")
    return docs.select("doc_id", "text", "sha", "covered", "whole").mapInArrow(run, schema)


def dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, short: int = SHORT, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and text for each document.

    The first columns follow the rule of ``span`` bytes; n_passages counts the document's passages, and text is
    the document without its repeated strings and passages (a character that a cut divides goes with it).
    Columns of docs other than doc_id and text play no part.
    """
    docs = _keyed(docs)
    texts = staged(docs.groupBy("k1", "k2", "sha").agg(F.min("doc_id").alias("d"), F.count("*").alias("times")))
    found = staged(_anchors(docs, short, gram, span))
    place = F.xxhash64("k1", "k2", F.shiftright("at", 32))
    grams = staged(found.groupBy("gram").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("gram"))
    again = staged(found.join(grams.hint("shuffle_merge"), "gram", "left_semi"))
    discard(found, grams)
    kind = ["gram", "c1", "c2"]
    kinds = staged(again.groupBy(*kind).agg(F.min(F.struct("k1", "k2", "at")).alias("one"), (F.min(place) != F.max(place)).alias("many")))
    several = staged(kinds.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    any_hot = not several.where(F.col("n") > HOT).isEmpty()
    wanted = kinds.join(several, "gram").groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("gram", "one.at", (F.col("n") > HOT).alias("hot"))).alias("places"))
    contexts = staged(_fetch(docs, wanted.join(texts.select("k1", "k2", "d"), ["k1", "k2"])))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = contexts.where("not hot").drop("hot")
    near = _compare(few.repartition(partitions, "gram").sortWithinPartitions("gram", "k1", "k2", "at"), short, span)
    if any_hot:
        hot = contexts.where("hot").drop("hot")
        near = near.union(_compare_hot(hot, short, False)).union(_compare_hot(hot, span, True))
    # equal contexts: all their bytes have a second place
    first = F.shiftright("at", 32) - F.shiftright("at", 22).bitwiseAND(1023)
    end = first + F.shiftright("at", 12).bitwiseAND(1023) + F.col("at").bitwiseAND(4095)
    same = again.join(kinds.where("many").select(*kind), kind).select("k1", "k2", first.alias("start"), end.alias("end"), (end - first >= span).alias("long"))
    covered = near.union(same).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end", "long")).alias("covered"))
    whole = texts.where("times > 1").select("k1", "k2", "sha", F.lit(True).alias("whole"))
    info = staged(covered.join(whole, ["k1", "k2"], "full_outer").withColumnRenamed("sha", "of"))
    discard(contexts, again, kinds, several, texts)
    # sha: a text that shares 120 bits only with a repeated one is not repeated
    mine = (docs["k1"] == info["k1"]) & (docs["k2"] == info["k2"])
    return _cut(docs.join(info, mine, "left").withColumn("whole", F.col("whole") & (F.col("sha") == F.col("of"))), words, short, span)
