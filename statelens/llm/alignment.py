"""Operator 11: which tokens of two tokenizers stand for the same bytes, counted over the corpus by external spills.

A document's text is encoded by both tokenizers. Where tokens of both end at the same byte, the text is cut into
groups; every token of A is linked with every token of B in its group. An id pair counts the documents that hold it
linked, and a pair is best if no other pair of its A id counts more.

The counting is external. Tasks cut their documents into chunks of bounded size; a chunk's pairs and how many of its
documents hold each are sorted side-major (A id, then B id) and dealt by a radix of the A id into zstd runs. All runs of
a radix meet in one task, which merges them k ways through a heap of run heads; as A ids come whole and in order, each
one's highest count is known as soon as it has passed. The task then streams the same runs again and writes for each
the counts of its pairs back to its chunk, where they are summed by document. A pair held by all documents is one
entry of a run, so no key is hot, and what a task keeps is bounded by the pairs that both vocabularies allow.

Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and an empty
groups string. Repeated rows count each for themselves; a null doc_id stays null. An empty table gives an empty one.
Further columns are ignored. Texts are encoded whole; a group whose tokens can't be paired one by one within bounds is
paired by its distinct ids, with how often each pair occurs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from dataclasses import dataclass
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.llm.common import staged

#: Text bytes that are encoded at once (a longer text is one step of its own), and pair records of a chunk.
STEP_BYTES = 256 << 10
CHUNK_RECORDS = 1_000_000
#: Pairs that are expanded at once; groups of more token pairs than WIDE are paired by distinct ids.
SLICE_PAIRS = 4_000_000
WIDE = 64
#: Runs that one heap merges.
FAN = 64
#: Bytes of a Parquet input for each radix, and the bounds of their number (a power of two).
RADIX_BYTES, LEAST_RADIX, MOST_RADIX = 32 << 20, 16, 4096
# Fixed value: how the byte-level vocabulary's tokenizer cuts a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Files:
    """Where the two tokenizers lie: read by the driver, sent to the workers (both are a few MB at most)."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 ones for themselves, the rest from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken

        byte = _byte_characters()
        model = json.loads(a)
        vocab = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items()}
        added = {x["content"]: x["id"] for x in model["added_tokens"] if x["content"].encode() not in vocab}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["model"]["merges"]]
        if [model["model"]["vocab"][m] for m in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("the vocabulary's ids do not follow its merges")
        self.encoder = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a_bytes = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token
        piece = lambda i: bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.side = len(self.b_bytes)

    def encode(self, texts: list[str]):
        """For each text the ids of A and of B, or None where either does not give the text back."""
        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            a, want = self.encoder.encode_ordinary(" " + text), b" " + text.encode()
            same = lambda ids, table: bool(ids) and b"".join(itemgetter(*ids, ids[0])(table)[:-1]) == want
            out.append((np.array(a, np.int32), np.array(b, np.int32)) if text and same(a, self.a_bytes) and same(b, self.b_bytes) else None)
        return out


@cache
def _pair(digest: str, a_path_bytes: tuple[bytes, bytes]) -> Pair:
    return Pair(*a_path_bytes)


def _groups(a, b, tok: Pair):
    """(group of each token of A, of each of B, which tokens of B end a group) for texts laid end to end."""
    a_end, b_end = np.cumsum(tok.a_size[a]) - 1, np.cumsum(tok.b_size[b]) - 1
    ends = np.zeros(int(a_end[-1]) + 1, np.uint8)
    ends[a_end] = 1
    last_b = ends[b_end] == 1
    ends[:] = 0
    ends[b_end] = 1
    last_a = ends[a_end] == 1
    return np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b, last_b


def _rendered(a, b, ga, gb, doc_of_group, n_docs) -> list[bytes]:
    """Each document's groups as text: ids by commas, sides by bars, groups by semicolons."""
    ids, key = np.concatenate([a, b]), np.concatenate([ga * 2, gb * 2 + 1])
    order = np.argsort(key, kind="stable")
    ids, key = ids[order].astype(np.int64), key[order]
    width = np.searchsorted([10, 100, 1000, 10_000, 100_000, 1_000_000], ids, "right") + 1
    end = np.cumsum(width + 1)
    out = np.empty(int(end[-1]), np.uint8)
    place, rest = end - 2, ids
    live = np.arange(len(ids))
    while len(live):
        out[place] = 48 + rest % 10
        rest = rest // 10
        more = rest > 0
        live, place, rest = live[more], place[more] - 1, rest[more]
    after = np.append(key[1:], -1)
    out[end - 1] = np.where(after == key, 44, np.where((key % 2 == 0) & (after == key + 1), 124, 59))
    doc = doc_of_group[key >> 1]
    lo = np.searchsorted(doc, np.arange(n_docs), "left")
    hi = np.searchsorted(doc, np.arange(n_docs), "right")
    start = end - width - 1
    return [out[start[i] : end[j - 1] - 1].tobytes() if j > i else b"" for i, j in zip(lo, hi, strict=True)]


def _summed(key, n):
    """Distinct keys in order with their sums."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _expand(ga, ida, na, gb, idb, nb, doc_of_group, n_groups, side):
    """(document << 31 | id pair, occurrences), sorted, of sorted sides that are paired within each group."""
    size_b = np.bincount(gb, minlength=n_groups)
    first_b = np.cumsum(size_b) - size_b
    reps = size_b[ga]
    total = np.cumsum(reps)
    out, lo = [], 0
    while lo < len(ga):
        # at least one token of A at a time: it meets no more than its group's distinct tokens of B
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE_PAIRS, "right")))
        r = reps[lo:hi]
        at = np.repeat(first_b[ga[lo:hi]] - np.cumsum(r) + r, r) + np.arange(int(r.sum()))
        key = np.repeat(doc_of_group[ga[lo:hi]] << 31 | ida[lo:hi].astype(np.int64) * side, r) + idb[at]
        out.append(_summed(key, np.repeat(na[lo:hi], r) * nb[at]))
        lo = hi
    return out


def _distinct(g, ids):
    """(group, id, occurrences) of a side, distinct and in order."""
    key, n = _summed(g.astype(np.int64) << 20 | ids, np.ones(len(g), np.int64))
    return key >> 20, key & ((1 << 20) - 1), n


def _records(a, b, ga, gb, doc_of_group, n_groups, side):
    """Sorted (document << 31 | id pair) with occurrences."""
    na, nb = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    wide = na * nb > WIDE
    out = []
    for part in (False, True):
        ka, kb = wide[ga] == part, wide[gb] == part
        if part and not ka.any():
            continue
        sides = (ga[ka], a[ka].astype(np.int64), np.ones(int(ka.sum()), np.int64), gb[kb], b[kb].astype(np.int64), np.ones(int(kb.sum()), np.int64))
        if part:
            sides = (*_distinct(ga[ka], sides[1]), *_distinct(gb[kb], sides[4]))
        out += _expand(*sides, doc_of_group, n_groups, side)
    if len(out) == 1:
        return out[0]
    return _summed(np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out]))


def _pack(*arrays) -> bytes:
    """Integer arrays of one length as one zstd frame, each in as few bytes as its values need."""
    import zstandard

    body = [len(arrays[0]).to_bytes(8, "little")]
    for x in arrays:
        kind = np.dtype("<u1") if not len(x) or x.max() < 1 << 8 else np.dtype("<u2") if x.max() < 1 << 16 else np.dtype("<u4") if x.max() < 1 << 32 else np.dtype("<u8")
        body += [bytes([kind.itemsize]), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        kind = np.dtype(f"<u{raw[at]}")
        out.append(np.frombuffer(raw, kind, n, at + 1).astype(np.int64))
        at += 1 + n * kind.itemsize
    return out


def _deltas(keys):
    return np.diff(keys, prepend=0)


CHUNKS = pa.schema(
    [("chunk", pa.int64()), ("kind", pa.int32()), ("radix", pa.int32()), ("blob", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("groups", pa.list_(pa.string()))]
)
CHUNKS_DDL = "chunk long, kind int, radix int, blob binary, doc_ids array<long>, sizes array<long>, groups array<string>"
ROWS_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class _Chunk:
    """Documents of a task until their records are written: their numbers, and sorted records by document."""

    def __init__(self, radixes: int):
        self.radixes, self.docs, self.keys, self.n = radixes, [], [], []
        self.size = 0

    def add(self, docs, keys, n):
        """docs: (doc_id, n_a, n_b, n_groups, n_links, groups) each; keys: documents counted from 0 for the first of docs."""
        self.keys.append(keys + (np.int64(len(self.docs)) << 31))
        self.n.append(n)
        self.docs += docs
        self.size += len(keys)

    def rows(self, name: int, side: int):
        """The chunk's own row and a run for each radix."""
        keys, n = np.concatenate([*self.keys, np.zeros(0, np.int64)]), np.concatenate([*self.n, np.zeros(0, np.int64)])
        pair, doc = keys & ((1 << 31) - 1), keys >> 31
        radix = (pair // side) & (self.radixes - 1)
        order = np.argsort(radix << 31 | pair, kind="stable")
        sorted_keys = (radix << 31 | pair)[order]
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])[: len(order)]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        distinct = sorted_keys[new]
        held = np.diff(np.append(np.flatnonzero(new), len(order)))
        own = _pack(np.bincount(doc, minlength=len(self.docs)).astype(np.int64)), _pack(at, n)
        cuts = np.searchsorted(distinct >> 31, np.arange(self.radixes + 1))
        out = [(name, 0, -1, len(own[0]).to_bytes(8, "little") + own[0] + own[1], [d[0] for d in self.docs], [int(x) for d in self.docs for x in d[1:5]], [d[5] for d in self.docs])]
        for r in range(self.radixes):
            part = slice(cuts[r], cuts[r + 1])
            if part.stop > part.start:
                out.append((name, 1, r, _pack(_deltas(distinct[part] & ((1 << 31) - 1)), held[part]), None, None, None))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CHUNKS, strict=True)], schema=CHUNKS)


def _chunks(batches, tok: Pair, radixes: int, digest: bool):
    """The chunks of a task's documents. A chunk's name holds its task's number: one attempt of a task is kept."""
    from pyspark import TaskContext

    name = TaskContext.get().partitionId() << 32
    chunk = _Chunk(radixes)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        lo, sizes = 0, np.cumsum([0, *(texts[i].as_buffer().size if texts[i].is_valid else 0 for i in range(len(texts)))])
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + STEP_BYTES, "right")) - 1)
            chunk.add(*_step(ids[lo:hi], [t or "" for t in texts[lo:hi].to_pylist()], tok, digest))
            lo = hi
            if chunk.size >= CHUNK_RECORDS:
                yield chunk.rows(name, tok.side)
                name, chunk = name + 1, _Chunk(radixes)
    if chunk.docs:
        yield chunk.rows(name, tok.side)


def _step(ids, texts, tok: Pair, digest: bool):
    """Rows of documents and their records."""
    got = tok.encode(texts)
    some = [i for i, x in enumerate(got) if x is not None]
    docs = [(i, 0, 0, 0, 0, "") for i in ids]
    if not some:
        return docs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate([got[i][k] for i in some]) for k in (0, 1))
    ga, gb, last_b = _groups(a, b, tok)
    n_b = np.array([len(got[i][1]) for i in some])
    doc_of_b = np.repeat(np.array(some, np.int64), n_b)
    doc_of_group = doc_of_b[last_b]
    n_groups = len(doc_of_group)
    links = np.bincount(ga, minlength=n_groups).astype(np.int64) * np.bincount(gb, minlength=n_groups)
    cut = np.searchsorted(doc_of_group, some), np.searchsorted(doc_of_group, some, "right")
    before = np.concatenate([[0], np.cumsum(links)])
    text = _rendered(a, b, ga, gb, np.searchsorted(some, doc_of_group), len(some))
    for k, i in enumerate(some):
        groups = hashlib.sha256(text[k]).hexdigest() if digest else text[k].decode()
        docs[i] = (ids[i], len(got[i][0]), len(got[i][1]), int(cut[1][k] - cut[0][k]), int(before[cut[1][k]] - before[cut[0][k]]), groups)
    return docs, *_records(a, b, ga, gb, doc_of_group, n_groups, tok.side)


def merged(runs):
    """The k-way merge of sorted runs (keys, counts) into one, counts of equal keys added.

    The heap holds each run's next block by its last key: whatever is not above the least of them is complete.
    """
    if len(runs) < 2:
        return runs[0] if runs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    step = 1 << 16
    heads = [0] * len(runs)
    heap = [(int(k[min(step, len(k)) - 1]), i) for i, (k, _) in enumerate(runs) if len(k)]
    heapq.heapify(heap)
    keys, counts = [], []
    while heap:
        bound = heap[0][0]
        parts = []
        for i, (k, n) in enumerate(runs):
            to = heads[i] + int(np.searchsorted(k[heads[i] : heads[i] + step], bound, "right"))
            if to > heads[i]:
                parts.append((k[heads[i] : to], n[heads[i] : to]))
                heads[i] = to
        k, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        keys.append(k)
        counts.append(n)
        while heap and heap[0][0] <= bound:
            i = heapq.heappop(heap)[1]
            k = runs[i][0]
            if heads[i] < len(k):
                heapq.heappush(heap, (int(k[min(heads[i] + step, len(k)) - 1]), i))
    return np.concatenate(keys), np.concatenate(counts)


class _Radix:
    """What a task knows of one radix: merged runs, then counts and which pairs are best."""

    def __init__(self, side: int):
        self.side, self.runs, self.done = side, [], None

    def take(self, run):
        self.runs.append(run)
        if len(self.runs) >= FAN:
            self.runs = [merged(self.runs)]

    def close(self):
        """Counts in side-major order, and each A id's highest."""
        if self.done is None:
            keys, n = merged(self.runs)
            self.runs = []
            a = keys // self.side
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            top = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(a)))) if len(first) else n
            self.done = keys, n, n == top
        return self.done


def _answers(batches, side: int):
    """Rows (radix, again, chunk, blob), sorted: a radix's runs come once to be counted and once more to be answered."""
    radix, state = None, None
    for batch in batches:
        out = []
        for r, again, chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if r != radix:
                radix, state = r, _Radix(side)
            gaps, n = _unpack(blob)
            keys = np.cumsum(gaps)
            if not again:
                state.take((keys, n))
                continue
            pairs, counts, best = state.close()
            at = np.searchsorted(pairs, keys)
            out.append((chunk, 1, r, _pack(counts[at], best[at].astype(np.int64)), None, None, None))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CHUNKS, strict=True)], schema=CHUNKS)


def _counted(batches, side: int):
    """Rows (radix, again, chunk, blob), sorted: every pair with its count and whether it is its A id's best."""
    state, radix = None, None

    def table():
        keys, n, best = state.close()
        return pa.RecordBatch.from_pydict({"a": keys // side, "b": keys % side, "documents": n, "best": best})

    for batch in batches:
        for r, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if r != radix and state is not None:
                yield table()
            if r != radix:
                radix, state = r, _Radix(side)
            gaps, n = _unpack(blob)
            state.take((np.cumsum(gaps), n))
    if state is not None:
        yield table()


def _summed_up(batches):
    """Rows of CHUNKS, sorted by chunk, kind, radix: a chunk's documents, then the counts of its pairs in its order."""
    names = [x.split()[0] for x in ROWS_DDL.split(", ")]
    own, parts = None, []

    def finish():
        blob, ids, sizes, groups = own
        cut = 8 + int.from_bytes(blob[:8], "little")
        (per,), (at, n) = _unpack(blob[8:cut]), _unpack(blob[cut:])
        counts, best = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        edge = np.concatenate([[0], np.cumsum(per)])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edge])
        sizes = np.array(sizes, np.int64).reshape(-1, 4)
        columns = [pa.array(ids, pa.int64()), *(pa.array(sizes[:, k]) for k in range(4)), pa.array(total(n * best[at])), pa.array(total(n * counts[at])), pa.array(groups, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for i in range(batch.num_rows):
            kind, blob = batch.column(1)[i].as_py(), batch.column(3)[i].as_py()
            if kind == 0:
                if own is not None:
                    yield finish()
                own, parts = (blob, *(batch.column(k)[i].as_py() for k in (4, 5, 6))), []
            else:
                parts.append(_unpack(blob))
    if own is not None:
        yield finish()


def radixes_of(docs: DataFrame) -> int:
    """A power of two that grows with the input's size on disk."""
    files = docs.inputFiles()
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    size = sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files[:1]) * len(files)
    n = LEAST_RADIX
    while n < MOST_RADIX and n * RADIX_BYTES < size:
        n *= 2
    return n


class Alignment:
    """The alignment of a corpus: ``documents()``, ``pairs()``. The chunks and runs are staged once for both."""

    def __init__(self, docs: DataFrame, files: Files | None = None, radixes: int | None = None, digest: bool = False):
        """digest: keep the SHA-256 of each document's groups instead of their text."""
        files = files or Files()
        if not (os.path.isfile(files.a) and os.path.isfile(files.b)):
            raise FileNotFoundError(f"no tokenizer at {files.a} or {files.b}")
        with open(files.a, "rb") as fa, open(files.b, "rb") as fb:
            raw = fa.read(), fb.read()
        self.side = len(Pair(*raw).b_bytes)
        radixes, sent = radixes or radixes_of(docs), docs.sparkSession.sparkContext.broadcast(raw)
        name = hashlib.sha256(b"".join(raw)).hexdigest()
        self.radixes = radixes
        work = lambda batches: _chunks(batches, _pair(name, sent.value), radixes, digest)
        self.rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, CHUNKS_DDL))

    def _runs(self, times: int) -> DataFrame:
        runs = self.rows.where("kind = 1").select("radix", F.explode(F.array(*[F.lit(i) for i in range(times)])).alias("again"), "chunk", "blob")
        return runs.repartition(self.radixes, "radix").sortWithinPartitions("radix", "again", "chunk")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: a row for each document."""
        side, schema = self.side, CHUNKS_DDL
        answers = self._runs(2).mapInArrow(lambda batches: _answers(batches, side), schema)
        own = self.rows.where("kind = 0").unionByName(answers)
        tasks = max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        return own.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "radix").mapInArrow(_summed_up, ROWS_DDL)

    def pairs(self) -> DataFrame:
        """a, b, documents, best: every linked id pair, how many documents hold it, and whether no pair of a counts more."""
        side = self.side
        return self._runs(1).mapInArrow(lambda batches: _counted(batches, side), "a long, b long, documents long, best boolean")


def digest(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """The columns of query op11."""
    return Alignment(docs, files, digest=True).documents().withColumnRenamed("groups", "groups_sha256")
