"""Operator 6: exact n-gram Jaccard join of texts with signature trees.

1. Every text becomes its set of hashed word shingles; equal sets form one class, so copies cost nothing more.
2. Two sets with Jaccard t or more differ in at most D = (1 - t) / t * (smaller size) shingles. The sets of a
   size band are cut by hash into m > D segments, so two linked ones agree in m - D segments whole. A set leaves
   out its smallest segments, those below its (m - D)th smallest: of the segments in which two linked sets agree
   one is left in by both. What is left out are mostly single shingles of common lines, which many sets share.
   Classes with an equal segment are candidates: pair by pair where few have it (PAIRED at most), as a star
   around the least where many do. A pair goes on if the classes' token bitmaps allow enough overlap. Of a longer
   run, the nodes that this has not connected are compared by their bitmaps, too, until they are. What stays
   connected makes the blocks within which all links lie.
3. In each block a signature tree is built over the classes: the nodes hold OR-combined token bitmaps, size
   ranges and the most tokens that share bits. A dual traversal drops node pairs whose greatest possible
   overlap is too small, or that are linked already, and compares the sets of the leaf pairs that stay.
   A block of more than BLOCK_SHINGLES is cut by hash; each task joins two cuts, and a step deals each cut out to
   2 * WAVE tasks at most, so that the disk it takes follows the block's size.
4. The links' connected components give each document's component.

Empty and null texts have no shingles and link with nothing. Texts with fewer words than a shingle are one
shingle as a whole. Repeated rows and ties keep one row each; the least doc_id of a component names it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.llm.common import LOWER, SPACE, components, discard, mix, pieces, staged, text_chunks, word_hashes, word_spans

#: Shingles that one task holds of a block.
BLOCK_SHINGLES = 2_000_000
#: Segment signatures that one bucket of the candidate search is meant to hold.
BUCKET_ENTRIES = 500_000
#: Distances between cuts of a block that one step joins.
WAVE = 4
#: Nodes of one run that one task holds, and bytes of bitmaps that one bucket of runs is meant to hold.
RUN_NODES = 8192
RUN_BYTES = 16 << 20
#: Shingles whose segments one map step signs at once.
MAP_SHINGLES = 400_000
#: Most classes with one equal segment that are compared pair by pair.
PAIRED = 4
FANOUT = 8
#: Bytes of the exact bitmaps of a block's shared tokens; beyond that leaf pairs are compared one by one.
EXACT_BYTES = 32 << 20
LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(column, k: int):
    """Yields (row, sorted distinct shingle hashes) for every row of an Arrow string column."""
    for lo, buf, offs in text_chunks(column):
        if len(offs) == 2:  # one text of any length, in pieces
            parts = [word_hashes(x, *word_spans(x, np.array([0, len(x)]), SPACE)[:2]) for x in map(LOWER.take, pieces(buf, SPACE))]
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            per = [len(h)]
        else:
            buf = LOWER[buf]
            starts, ends, per = word_spans(buf, offs, SPACE)
            h = word_hashes(buf, starts, ends)
        acc = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(acc)]
        acc = mix(acc)
        at = 0
        for r, n in enumerate(per):
            if n >= k:
                yield lo + r, np.unique(acc[at : at + n - k + 1])
            elif n:
                one = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in h[at : at + n]:
                        one = one * np.uint64(0xD6E8FEB86659FD93) + x
                yield lo + r, mix(np.array([one], np.uint64))
            else:
                yield lo + r, np.zeros(0, np.uint64)
            at += n


def digest(s: np.ndarray) -> bytes:
    """The class of a set: 128 bits over its sorted hashes."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def bands(largest: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(least size, greatest size, D) of the size bands; a pair lies in the band of its smaller size."""
    out, lo = [], 1
    while lo <= largest:
        nxt = max(lo + 1, lo * 13 // 10)
        out.append((lo, (nxt - 1) * den // num, (nxt - 1) * (den - num) // num))
        lo = nxt
    return out


def segment_signatures(sets: list[np.ndarray], num: int, den: int):
    """(signature, index of its set) over all bands of all sets; equal signatures stand for equal segments."""
    sizes = np.array([len(s) for s in sets], np.int64)
    sigs, owners = [], []
    for band, (lo, hi, d) in enumerate(bands(int(sizes.max(initial=0)), num, den)):
        of = np.flatnonzero((sizes >= lo) & (sizes <= hi))
        if d == 0 or not len(of):
            continue
        m = d + 2 + d // 2
        h = np.concatenate([sets[i] for i in of])
        v = mix(h ^ np.uint64(0x5851F42D4C957F2D))
        slot = np.repeat(np.arange(len(of)) * m, sizes[of]) + (mix(h + np.uint64(band * 7919 + 13)) % np.uint64(m)).astype(np.int64)
        n = len(of) * m
        # sums of 32-bit halves are exact in doubles
        low = np.bincount(slot, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
        high = np.bincount(slot, (v >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
        count = np.bincount(slot, minlength=n)
        seg = np.arange(n) % m
        sig = mix(low + (high << np.uint64(32)) + np.uint64(0xA0761D6478BD642F) * (seg + m * (band + 1)).astype(np.uint64) + mix(count.astype(np.uint64)))
        # linked sets agree in m - d segments: fewer of a set's own are smaller than its (m - d)th smallest, and what a partner leaves out beyond that is smaller still
        count = count.reshape(len(of), m)
        keep = (count >= np.partition(count, m - d - 1, axis=1)[:, m - d - 1 : m - d]).ravel()
        sigs.append(sig[keep])
        owners.append(np.repeat(of, m)[keep])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def runs_of(sig: np.ndarray, node: np.ndarray):
    """(pairs, run members): the entries' runs of equal signatures. Runs of up to PAIRED nodes give all their pairs (lesser
    node first); longer ones give the pairs of their least node, and (signature, node) for each of their nodes.
    """
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    none = np.zeros((0, 2), np.uint64)
    if not len(sig):
        return none, none
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    sig, node = sig[new], node[new]
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    n = np.diff(np.concatenate([at, [len(sig)]]))
    few, many = np.repeat((n > 1) & (n <= PAIRED), n), np.repeat(n > PAIRED, n)
    pairs = [none]
    for step in range(1, min(int(n.max()), PAIRED)):
        i = np.flatnonzero(few[:-step] & (sig[step:] == sig[:-step]))
        pairs.append(np.stack([node[i], node[i + step]], 1))
    members = np.stack([sig[many], node[many]], 1)
    many[at] = False
    pairs.append(np.stack([np.repeat(node[at], n)[many], node[many]], 1))
    return np.unique(np.concatenate(pairs), axis=0), members


def bitmap(s: np.ndarray) -> bytes:
    """A bitmap of the set's tokens with about two bits for each, 256 to 8192; half as wide it is the OR of its halves."""
    bits = 256
    while bits < 2 * len(s) and bits < 8192:
        bits *= 2
    flags = np.zeros(bits, bool)
    flags[(s % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def may_link(a: bytes, na: int, b: bytes, nb: int, num: int, den: int) -> bool:
    """Whether two sets of na and nb tokens with these bitmaps can overlap enough: a common token has a common bit, and
    at most as many tokens share bits as a set has tokens beyond its bits.
    """
    if na * den < num * nb or nb * den < num * na:
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    spare = min(na - int(np.bitwise_count(x).sum()), nb - int(np.bitwise_count(y).sum()))
    return (int(np.bitwise_count(x & y).sum()) + spare) * (num + den) >= num * (na + nb)


def _six(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def features(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, cls, bits) for each row."""

    def run(batches):
        for b in batches:
            n, cls, bits = [], [], []
            for _, s in shingle_sets(b.column(b.schema.get_field_index("text")), k):
                n.append(len(s))
                cls.append(digest(s) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "cls", "bits"])

    schema = docs.select("doc_id").schema.add("n_shingles", "long").add("cls", "binary").add("bits", "binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def candidates(docs: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """(u, v, run) between 48-bit class numbers: pairs with an equal segment and, marked as run, (signature, class) for the
    classes of long runs.
    """

    def emit(batches):
        for b in batches:
            batch: list = []
            seen: set = set()
            size = 0

            def flush(batch):
                sig, owner = segment_signatures([s for _, s in batch], num, den)
                node = np.array([c for c, _ in batch], np.uint64)[owner] if len(owner) else np.zeros(0, np.uint64)
                where = (sig >> np.uint64(48)) % np.uint64(buckets) if buckets <= 65536 else mix(sig) % np.uint64(buckets)
                order = np.argsort(where, kind="stable")
                sig, node, where = sig[order], node[order], where[order]
                cut = np.flatnonzero(where[1:] != where[:-1]) + 1
                lo = np.concatenate([[0], cut]) if len(where) else np.zeros(0, int)
                hi = np.concatenate([cut, [len(where)]]) if len(where) else lo
                rows = [(int(where[i]), _six(sig[i:j]), _six(node[i:j])) for i, j in zip(lo, hi, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["bucket", "a", "b"])

            for _, s in shingle_sets(b.column(b.schema.get_field_index("text")), k):
                if not len(s):
                    continue
                d = digest(s)
                if d in seen:
                    continue
                seen.add(d)
                batch.append((int.from_bytes(d[:6], "little"), s))
                size += len(s)
                if size >= MAP_SHINGLES:
                    yield flush(batch)
                    batch, size = [], 0
                    seen = set()
            if batch:
                yield flush(batch)

    def gather(table):
        pairs, members = runs_of(*(np.concatenate([_unsix(x.as_py()) for x in table.column(c)]) for c in ("a", "b")))
        edges = np.concatenate([pairs, members]).astype(np.int64)
        return pa.table({"u": pa.array(edges[:, 0]), "v": pa.array(edges[:, 1]), "run": pa.array(np.arange(len(edges)) >= len(pairs))})

    blobs = docs.select("text").mapInArrow(emit, "bucket long, a binary, b binary")
    return blobs.groupBy("bucket").applyInArrow(gather, "u long, v long, run boolean")


def pruned(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of those pairs whose bitmaps allow a link. classes: node, n, bits."""

    def run(batches):
        for b in batches:
            get = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bu", "nu", "bv", "nv")}
            ok = pa.array([may_link(*x, num, den) for x in zip(get["bu"], get["nu"], get["bv"], get["nv"], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).filter(ok) for c in ("u", "v")], ["u", "v"])

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")).hint("shuffle_merge")
    close = pairs.distinct().join(side("u"), "u").join(side("v"), "v").where(f"nu * {den} >= nv * {num} and nv * {den} >= nu * {num}")
    return close.select("u", "v", "nu", "bu", "nv", "bv").mapInArrow(run, "u long, v long")


def run_links(comp, size, bits: list[bytes], side, num: int, den: int) -> list[tuple[int, int]]:
    """(u, v): comps of a run's nodes whose bitmaps allow a link, as many as connect what such pairs connect. Nodes of one
    comp count as connected. side: only pairs across its two values, or all if it has one value only.
    """
    order = np.argsort(size, kind="stable")
    comp, size, side, bits = comp[order], size[order], side[order], [bits[i] for i in order]
    _, label = np.unique(comp, return_inverse=True)
    width = min(map(len, bits)) // 8
    rows = np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width), axis=0) for b in bits])
    extra = size - np.bitwise_count(rows).sum(1).astype(np.int64)
    across, out = bool((side != side[0]).any()), []
    last = np.searchsorted(size, size * den // num, side="right")
    for i in range(len(comp)):
        j = np.arange(i + 1, last[i])
        j = j[(label[j] != label[i]) & (side[j] != side[i])] if across else j[label[j] != label[i]]
        for lo in range(0, len(j), 4096):
            x = j[lo : lo + 4096]
            most = np.bitwise_count(rows[i] & rows[x]).sum(1).astype(np.int64) + np.minimum(extra[i], extra[x])
            for t in x[most * (num + den) >= num * (size[i] + size[x])].tolist():
                if label[t] != label[i] and may_link(bits[i], int(size[i]), bits[t], int(size[t]), num, den):
                    out.append((int(comp[i]), int(comp[t])))
                    label[label == label[t]] = label[i]
    return out


def linked_runs(members: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of the comps that members' runs connect by their bitmaps. members: run, node, comp, n, bits."""
    size = members.groupBy("run").agg(F.ceil(F.count("*") / RUN_NODES).cast("long").alias("c"))
    cut = members.join(size, "run").withColumn("x", F.pmod(F.xxhash64("node"), "c"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda y: F.struct(F.least("x", y).alias("i"), F.greatest("x", y).alias("j")))
    dealt = cut.withColumn("ij", F.explode(pairs)).select("run", "ij.i", "ij.j", "x", "comp", "n", "bits")
    total = dealt.agg(F.sum(F.length("bits") + 100)).first()[0] or 0
    buckets = max(24, -(-total // RUN_BYTES))

    def gather(table):
        key = [table.column(c).to_numpy() for c in ("run", "i", "j")]
        order = np.lexsort(key)
        new = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in key])
        comp, size, side = (table.column(c).to_numpy() for c in ("comp", "n", "x"))
        bits = table.column("bits").combine_chunks()
        found: list = []
        for of in np.split(order, np.flatnonzero(new) + 1):
            found += run_links(comp[of], size[of], [bits[int(i)].as_py() for i in of], side[of], num, den)
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    bucket = F.pmod(F.xxhash64("run", "i", "j"), F.lit(buckets))
    return dealt.groupBy(bucket).applyInArrow(gather, "u long, v long").distinct()


def blocks_of(edges: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of the blocks: what candidates (see candidates) connect whose bitmaps allow links. classes: node, n, bits."""
    close = staged(pruned(edges.where("not run").select("u", "v"), classes, num, den))
    comps = components(close)
    runs = staged(edges.where("run").select(F.col("u").alias("run"), F.col("v").alias("node")).join(comps, "node", "left").select("run", "node", F.coalesce("component", "node").alias("comp")))
    # a run whose nodes are connected already says nothing more
    apart = runs.groupBy("run").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("run")
    members = staged(runs.join(apart, "run").join(classes.select("node", "n", "bits").hint("shuffle_merge"), "node"))
    more = staged(linked_runs(members, num, den))
    discard(close, runs, members)
    if more.isEmpty():
        return comps
    wider = components(more)
    named = wider.select(F.col("node").alias("component"), F.col("component").alias("wider"))
    single = wider.join(comps.select("node"), "node", "left_anti")
    return comps.join(named, "component", "left").select("node", F.coalesce("wider", "component").alias("component")).union(single)


class Tree:
    """A signature tree: per level an OR bitmap, a size range and the greatest number of tokens beyond the bits, for each node."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = len(sets)
        flags = np.zeros((n, bits), bool) if n * bits <= 1 << 24 else None
        rows = np.zeros((n, bits // 64), np.uint64)
        for i, s in enumerate(sets):
            f = flags[i] if flags is not None else np.zeros(bits, bool)
            f[(s % np.uint64(bits)).astype(np.int64)] = True
            rows[i] = np.packbits(f).view(np.uint64)
        size = np.array([len(s) for s in sets], np.int64)
        extra = size - np.bitwise_count(rows).sum(1).astype(np.int64)
        self.levels = [(rows, size, size, extra)]
        while len(self.levels[-1][0]) > 1:
            rows, least, most, extra = self.levels[-1]
            at = np.arange(0, len(rows), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(rows, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(extra, at)))

    def labels(self, leaf: np.ndarray) -> list[np.ndarray]:
        """For each level the label that all leaves below share, or -1."""
        out = [leaf]
        for rows, *_ in self.levels[1:]:
            at = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1)[: len(rows)])
        return out


def shared_bits(sets: list[np.ndarray]) -> np.ndarray | None:
    """A row of bits for each set, one bit for each token that several sets have; None if that takes over EXACT_BYTES."""
    size = np.array([len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    width = -(-int(number[-1] + 1) // 64) or 1
    if len(sets) * width * 8 > EXACT_BYTES:
        return None
    out = np.zeros((len(sets), width * 8), np.uint8)
    row, keep = np.repeat(np.arange(len(sets)), size), times[token] > 1
    row, bit = row[keep], number[token[keep]]
    for lo in range(0, len(sets), step := max(1, (1 << 24) // (width * 64))):
        mine = slice(*np.searchsorted(row, [lo, lo + step]))
        flags = np.zeros((min(step, len(sets) - lo), width * 64), bool)
        flags[row[mine] - lo, bit[mine]] = True
        out[lo : lo + step] = np.packbits(flags, axis=1)
    return out.view(np.uint64)


def join(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what is linked: (i, j) indexes into left, or into left + right if right is given
    (then only pairs across). Links between sets that earlier links connect already are left out.
    """
    sets = left + (right or [])
    n_left = len(left)
    parent = list(range(len(sets)))
    links = []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def linked(i, j):
        a, b = sets[i], sets[j]
        if len(a) > len(b):
            a, b = b, a
        if den * len(a) < num * len(b):
            return False
        slot = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int((b[slot] == a).sum())
        return den * both >= num * (len(a) + len(b) - both)

    def visit(i, j):
        x, y = find(i), find(j)
        if x != y and linked(i, j):
            parent[max(x, y)] = min(x, y)
            links.append((i, j))

    bits = 256
    while bits < 2 * max(len(s) for s in sets) and bits < 1 << 14:
        bits *= 2
    by = lambda ids: sorted(ids, key=lambda i: (int(sets[i][0]), len(sets[i])))
    order_a = by(range(n_left))
    order_b = by(range(n_left, len(sets))) if right is not None else order_a
    if right is None:
        for x, y in zip(order_a, order_a[1:], strict=False):
            visit(x, y)
        for x in order_a[2::2]:
            visit(order_a[0], x)
    else:
        near = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        for x, y in zip(near, near[1:], strict=False):
            if (x < n_left) != (y < n_left):
                visit(x, y)
        for x in order_b:
            visit(order_a[0], x)
        for x in order_a:
            visit(x, order_b[0])
    tree_a = Tree([sets[i] for i in order_a], bits)
    tree_b = tree_a if right is None else Tree([sets[i] for i in order_b], bits)
    order_a, order_b = np.array(order_a), np.array(order_b)
    exact, sizes = shared_bits(sets), np.array([len(s) for s in sets], np.int64)
    roots = lambda order: np.array([find(int(i)) for i in order])
    stamp, la, lb = -1, None, None
    top_a, top_b = len(tree_a.levels) - 1, len(tree_b.levels) - 1
    stack = [(top_a, top_b, np.array([0]), np.array([0]))]
    while stack:
        ka, kb, p, q = stack.pop()
        if stamp < 0 or len(links) - stamp > 64:
            stamp, la = len(links), tree_a.labels(roots(order_a))
            lb = la if right is None else tree_b.labels(roots(order_b))
        for lo in range(0, len(p), 4096):
            i, j = p[lo : lo + 4096], q[lo : lo + 4096]
            (ra, amin, amax, ax), (rb, bmin, bmax, bx) = tree_a.levels[ka], tree_b.levels[kb]
            ok = (amax[i] * den >= num * bmin[j]) & (bmax[j] * den >= num * amin[i]) & ((la[ka][i] < 0) | (la[ka][i] != lb[kb][j]))
            i, j = i[ok], j[ok]
            most = np.bitwise_count(ra[i] & rb[j]).sum(1).astype(np.int64) + np.minimum(ax[i], bx[j])
            ok = most * (num + den) >= num * (amin[i] + bmin[j])
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if ka == 0 and kb == 0:
                x, y = order_a[i], order_b[j]
                if exact is not None:
                    both = np.concatenate([np.bitwise_count(exact[x[c : c + 512]] & exact[y[c : c + 512]]).sum(1, dtype=np.int64) for c in range(0, len(x), 512)])
                    ok = den * both >= num * (sizes[x] + sizes[y] - both)
                    x, y = x[ok], y[ok]
                for u, v in zip(x.tolist(), y.tolist(), strict=True):
                    if u != v:
                        visit(u, v)
                continue
            # the higher of the two nodes is opened; in a self-join both, so that mirrored pairs can be dropped
            def opened(nodes, level, tree):
                if level == 0:
                    return nodes[:, None], np.ones((len(nodes), 1), bool)
                kids = nodes[:, None] * FANOUT + np.arange(FANOUT)
                return kids, kids < len(tree.levels[level - 1][0])

            ca, oka = opened(i, ka if right is None or ka >= kb else 0, tree_a)
            cb, okb = opened(j, kb if right is None or kb >= ka else 0, tree_b)
            pa_, pb_ = np.broadcast_arrays(ca[:, :, None], cb[:, None, :])
            ok = oka[:, :, None] & okb[:, None, :]
            if right is None:
                ok = ok & (pa_ <= pb_)
            stack.append((ka - (right is None or ka >= kb) if ka else 0, kb - (right is None or kb >= ka) if kb else 0, pa_[ok], pb_[ok]))
    return links


def _links(docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(u, v) classes linked in their blocks. reps: doc_id, cls, comp, nb (cuts of the block)."""

    def sets(batches):
        for b in batches:
            want = b.column(b.schema.get_field_index("cls")).to_pylist()
            rows, cls, data = [], [], []
            for r, s in shingle_sets(b.column(b.schema.get_field_index("text")), k):
                d = digest(s) if len(s) else None
                if d and want[r] in (d, None):  # else another text of the same doc_id
                    rows.append(r)
                    cls.append(d)
                    data.append(s.tobytes())
            take = pa.array(rows, pa.int64())
            cols = [b.column(b.schema.get_field_index(c)).take(take) for c in ("comp", "nb")]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), *cols, pa.array(data, pa.binary())], ["cls", "comp", "nb", "data"])

    # the same join at every size: a broadcast of reps would grow with the input
    texts = docs.select("doc_id", "text").join(reps.hint("shuffle_merge"), "doc_id")
    data = texts.select("cls", "comp", "nb", "text").mapInArrow(sets, "cls binary, comp long, nb long, data binary")
    # classes of rows without an id meet by their digest
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("binary").alias("cls"), F.lit(0).cast("long").alias("comp"), F.lit(0).cast("long").alias("nb"), "text").mapInArrow(sets, "cls binary, comp long, nb long, data binary")
    data = data.union(unnamed.drop("comp", "nb").join(reps.where("doc_id is null").drop("doc_id"), "cls").select("cls", "comp", "nb", "data"))
    most = reps.agg(F.max("nb")).first()[0] or 0
    cut = data.withColumn("x", F.pmod(F.xxhash64("cls"), "nb"))
    cut = staged(cut) if most > 2 * WAVE else cut

    def dealt(lo):
        """Each cut for each task that joins it with one whose number, in a circle, is lo to lo + WAVE - 1 further or less."""
        pair = lambda y: F.struct(F.least("x", y).alias("i"), F.greatest("x", y).alias("j"))
        far = F.sequence(F.lit(lo).cast("long"), F.least(F.lit(lo + WAVE - 1).cast("long"), F.floor(F.col("nb") / 2)))
        pairs = F.array_distinct(F.flatten(F.transform(far, lambda d: F.array(pair((F.col("x") + d) % F.col("nb")), pair((F.col("x") - d + F.col("nb")) % F.col("nb"))))))
        return cut.where(F.floor(F.col("nb") / 2) >= lo).select("cls", "comp", "x", "data", F.explode(pairs).alias("ij")).select("cls", "comp", "x", "data", "ij.i", "ij.j")

    def block(table):
        cls, x = table.column("cls").to_pylist(), table.column("x").to_pylist()
        raw = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("data")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one = dict(sorted({c: n for n, c in enumerate(cls)}.items()))  # each class once, in a fixed order
        left = [n for n in one.values() if x[n] == i]
        right = None if i == j else [n for n in one.values() if x[n] == j]
        if len(left) + len(right or []) < 2 or not left or right == []:
            found = []
        else:
            ids = left + (right or [])
            found = [(cls[ids[a]], cls[ids[b]]) for a, b in join([raw[n] for n in left], None if right is None else [raw[n] for n in right], num, den)]
        return pa.table({"u": pa.array([f[0] for f in found], pa.binary()), "v": pa.array([f[1] for f in found], pa.binary())})

    waves = [dealt(lo).groupBy("comp", "i", "j").applyInArrow(block, "u binary, v binary") for lo in range(0, most // 2 + 1, WAVE)]
    if len(waves) == 1:
        return waves[0]
    out = reduce(DataFrame.union, [staged(w) for w in waves])
    discard(cut)
    return out


def link(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, cls (its set's class; null for no words) and component_id for each document.

    k words make a shingle; two documents link when den * intersection >= num * union.
    """
    stats = staged(features(docs, k))
    total = stats.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(24, -(-int(total * 0.5) // BUCKET_ENTRIES))
    edges = staged(candidates(docs, k, num, den, buckets))
    number = F.conv(F.concat(*[F.substring(F.hex("cls"), 2 * i + 1, 2) for i in range(5, -1, -1)]), 16, 10).cast("long")
    classes = stats.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    sketches = stats.where("n_shingles > 0").withColumn("node", number).groupBy("node", "cls").agg(F.max("n_shingles").alias("n"), F.max("bits").alias("bits"))
    comps = blocks_of(edges, sketches, num, den)
    inside = classes.withColumn("node", number).join(comps, "node").select("doc_id", "cls", "n", F.col("component").alias("comp"))
    blocks = inside.groupBy("comp").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("nb"))
    reps = staged(inside.join(blocks, "comp").select("doc_id", "cls", "comp", "nb"))
    discard(edges)
    links = staged(_links(docs, reps, k, num, den))
    linked = components(links)
    named = classes.join(linked, classes["cls"] == linked["node"]).select("cls", "component", "doc_id")
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("cls").alias("rep"))).alias("least"))
    named = named.join(least, "component").select("cls", F.col("least.id").alias("component_id"), "least.rep")
    first = classes.select("cls", F.col("doc_id").alias("own"))
    names = staged(first.join(named, "cls", "left").select("cls", F.when(F.col("rep").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("rep", "cls").alias("rep")))
    discard(reps, links)
    found = stats.drop("bits").join(names, "cls", "left")
    return found.select("doc_id", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "rep")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of linked documents, and all that link with none; those without words all stay.

    The least doc_id of a group stays (an id comes before none), with its least class if that id has several texts.
    Of rows that repeat doc_id and class one stays; of rows without words one of those that are equal in every column.
    """
    found = staged(link(docs, k, num, den))
    named = found.where(F.col("cls").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("cls") == F.col("rep"))))
    times = found.groupBy("doc_id").agg(F.count("*").alias("times"))
    single = times.where("times = 1").join(named, "doc_id", "left_semi").select("doc_id")
    many = times.where("times > 1 or doc_id is null").select(F.col("doc_id").alias("d"))
    kept = docs.join(single.hint("shuffle_merge"), "doc_id", "left_semi").select(*docs.columns)
    if many.isEmpty():
        return kept
    cls = next(n for n in ("_cls", *(f"_cls{i}" for i in range(len(docs.columns)))) if n not in docs.columns)
    again = with_class(docs.join(many, docs["doc_id"].eqNullSafe(many["d"]), "left_semi"), k, cls)
    stay = named.where("cls is not null").select(F.col("doc_id").alias("_d"), F.col("cls").alias("_c")).distinct()
    chosen = again.join(stay, again["doc_id"].eqNullSafe(stay["_d"]) & (again[cls] == stay["_c"]), "left_semi").dropDuplicates(["doc_id", cls])
    return kept.union(chosen.select(*docs.columns)).union(again.where(F.col(cls).isNull()).select(*docs.columns).distinct())


def with_class(docs: DataFrame, k: int, name: str) -> DataFrame:
    """docs with the column ``name``: the class of its text's set (null for no words)."""

    def run(batches):
        for b in batches:
            cls = [digest(s) if len(s) else None for _, s in shingle_sets(b.column(b.schema.get_field_index("text")), k)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cls, pa.binary())], [*b.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast("binary")).schema)
