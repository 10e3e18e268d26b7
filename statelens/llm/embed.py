"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax, numpy SGD.

A document's vector is the mean over its words of the word's vector, which is the mean of the learned
vectors of its hashed features: the word itself, its character n-grams with word borders, and on request its
shape and whether it repeats the word before it. The model is linear after the averages, so scoring needs only one
number per bucket and class. Training sees a bounded sample of labelled rows (``max_docs`` documents of
at most ``max_chars`` code points, by seeded hash), in the driver; scoring is one map over all rows.

Null and empty texts have no words: they get the softmax of the bias. Words are the runs of bytes other
than ASCII white space. A long text is summed over pieces that end between words (a repeat across two pieces
isn't seen).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.llm.common import BYTE_HASH, LOWER, SPACE, mix, pieces, powers, text_chunks, word_hashes, word_spans


#: Text bytes whose words' features are held at once: some hundred bytes for each.
STEP_BYTES = 1 << 18


@dataclass(frozen=True)
class Params:
    """max_docs, max_chars: the bounds of the training sample. shapes: also learn from case, symbols and repeats."""

    max_docs: int = 2000
    max_chars: int = 32_768
    buckets: int = 1 << 17
    dims: int = 8
    ngrams: tuple = (2, 3, 4)
    shapes: bool = False
    epochs: int = 8
    rate: float = 0.5
    batch: int = 32
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """classes, a bucket x class table of linear contributions, a bias, the calibrated temperature, and the least
    probability of the right answer among the documents that calibrated it.
    """

    classes: tuple
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    params: Params
    surest_low: float = 0.0


def word_features(buf, starts, ends, p: Params):
    """(bucket of each feature, number of features of each word) for the words at starts..ends, in word order."""
    n, lens = len(starts), ends - starts
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = lens + 2
    at0 = np.cumsum(padded) - padded
    text = np.zeros(int(padded.sum()), np.uint8)
    text[at0], text[at0 + padded - 1] = 1, 2
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    raw = buf[np.repeat(starts, lens) + inner]
    text[np.repeat(at0 + 1, lens) + inner] = raw if p.shapes else LOWER[raw]
    # characters: a byte 10xxxxxx goes with the one before
    begins = (text & 0xC0) != 0x80
    begins[at0] = begins[np.minimum(at0 + 1, len(text) - 1)] = True
    first = np.flatnonzero(begins)
    char = np.cumsum(begins) - 1
    hashed = np.add.reduceat(BYTE_HASH[text] * powers(8, np.uint64(0x2545F4914F6CDD1D))[np.minimum(np.arange(len(text)) - first[char], 7)], first)
    word = np.repeat(np.arange(n), padded)[first]
    size = np.bincount(word, minlength=n)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(first))
    base = powers(max(p.ngrams) + 1)
    owners, buckets = [np.arange(n)], [mix(word_hashes(text, at0, at0 + padded) + np.uint64(99))]
    for k in p.ngrams:
        if len(first) < k:
            continue
        h = hashed[: len(first) - k + 1].copy()
        for j in range(1, k):
            h += hashed[j : len(first) - k + 1 + j] * base[j]
        ok = left[: len(h)] >= k
        owners.append(word[: len(h)][ok])
        buckets.append(mix(h[ok] + np.uint64(k)))
    if p.shapes:
        kind = np.select([(text >= 65) & (text <= 90), (text >= 97) & (text <= 122), (text >= 48) & (text <= 57), text > 127], [1, 2, 4, 2], 8)
        kind[at0] = kind[at0 + padded - 1] = 0
        shape = np.bitwise_or.reduceat(kind, at0).astype(np.uint64)
        owners.append(np.arange(n))
        buckets.append(mix(shape * np.uint64(31) + np.minimum(lens, 20).astype(np.uint64) * np.uint64(1009) + np.uint64(5)))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets) % np.uint64(p.buckets - 8)
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int64) + 8, np.bincount(owner, minlength=n)


def bag(buf, offs, p: Params):
    """The words of some rows: unique words' features, and (row, unique word, count) triples; word 0 is "a repeat"."""
    starts, ends, per = word_spans(buf, offs, SPACE)
    rows = np.repeat(np.arange(len(per)), per)
    h = word_hashes(LOWER[buf] if not p.shapes else buf, starts, ends)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    feats, sizes = word_features(buf, starts[first], ends[first], p)
    feats, sizes, inverse = np.concatenate([[0], feats]), np.concatenate([[1], sizes]), inverse + 1
    if p.shapes and len(h) > 1:
        again = np.flatnonzero((h[1:] == h[:-1]) & (rows[1:] == rows[:-1])) + 1
        rows, inverse = np.concatenate([rows, rows[again]]), np.concatenate([inverse, np.zeros(len(again), np.int64)])
    return feats, sizes, rows, inverse, len(per)


def _train_numpy(texts: list[str], y: np.ndarray, n_classes: int, p: Params):
    """Bucket x class table and bias, by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(p.seed)
    data = [t.encode() for t in texts]
    emb = rng.normal(0, 0.1, (p.buckets, p.dims)).astype(np.float32)
    out, bias = np.zeros((p.dims, n_classes), np.float32), np.zeros(n_classes, np.float32)
    steps, step = max(1, p.epochs * -(-len(data) // p.batch)), 0
    bags = []
    for lo in range(0, len(data), p.batch):
        part = data[lo : lo + p.batch]
        feats, sizes, rows, words, n = bag(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]), p)
        key, count = np.unique(rows * len(sizes) + words, return_counts=True)
        rows, words = key // len(sizes), key % len(sizes)
        total = np.maximum(1, np.bincount(rows, count, minlength=n))
        # the buckets that a step touches, and which of them each feature is
        touched, slot = np.unique(feats, return_inverse=True)
        bags.append((touched, slot.astype(np.int32), feats.astype(np.int32), sizes.astype(np.int32), rows.astype(np.int32), words.astype(np.int32), (count / total[rows]).astype(np.float32), n, y[lo : lo + p.batch]))
    gather = lambda idx, val, n: np.stack([np.bincount(idx, val[:, d], minlength=n) for d in range(val.shape[1])], 1).astype(np.float32)
    for _ in range(p.epochs):
        for i in rng.permutation(len(bags)):
            touched, slot, feats, sizes, rows, words, weight, n, want = bags[i]
            vec = np.add.reduceat(emb[feats], np.cumsum(sizes) - sizes) / sizes[:, None]
            doc = gather(rows, vec[words] * weight[:, None], n)
            z = doc @ out + bias
            z = np.exp(z - z.max(1, keepdims=True))
            g = z / z.sum(1, keepdims=True)
            g[np.arange(n), want] -= 1
            g /= n
            rate = p.rate * (1 - step / steps)
            step += 1
            g_doc = g @ out.T
            g_word = gather(words, g_doc[rows] * weight[:, None], len(sizes)) / sizes[:, None]
            emb[touched] -= rate * 50 * gather(slot, np.repeat(g_word, sizes, axis=0), len(touched))
            out -= rate * 10 * (doc.T @ g)
            bias -= rate * g.sum(0)
    return emb @ out, bias


def _logits(buf, offs, model: Model) -> np.ndarray:
    if len(offs) == 2:  # one text of any length
        sums = [_sums(x, np.array([0, len(x)]), model) for x in pieces(buf, SPACE, STEP_BYTES)] or [_sums(buf, offs, model)]
        return sum(x for x, _ in sums) / max(1, sum(n for _, n in sums)) + model.bias
    total, n = _sums(buf, offs, model)
    return total / np.maximum(1, n)[:, None] + model.bias


def _sums(buf, offs, model: Model):
    """(sum of the words' contributions, number of words) of each row."""
    feats, sizes, rows, words, n = bag(buf, offs, model.params)
    per_word = np.add.reduceat(model.table[feats], np.cumsum(sizes) - sizes) / sizes[:, None]
    return np.stack([np.bincount(rows, per_word[words, c], minlength=n) for c in range(len(model.classes))], 1), np.bincount(rows, minlength=n)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def chosen(key: str, rows: int, params: Params = Params()):
    """Condition that about half as many rows again as max_docs of ``rows`` meet, by seeded hash of their key.

    It reads no text, so it holds back the other documents before they are joined or moved.
    """
    share = min(1.0, 1.5 * params.max_docs / max(1, rows))
    return F.pmod(F.xxhash64(F.col(key), F.lit(params.seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def fit(labelled: DataFrame, params: Params = Params()) -> Model | None:
    """Learns from (key, text, label); rows without text or label are left out. Every fifth sampled document
    is kept from the descent and sets the temperature that makes the probabilities fit (calibration).

    Only a bounded sample reaches the driver: max_docs rows by hash of key, each of at most max_chars. Large
    tables are to be thinned with chosen() first.
    Without any usable row there is nothing to learn from: None.
    """
    ok = labelled.where("text is not null and label is not null").where(F.length("text") <= params.max_chars)
    # rows of one key are told apart by their text's hash
    sample = (
        ok.select(F.xxhash64("key", F.lit(params.seed)).alias("h"), F.xxhash64("text").alias("h2"), "text", F.col("label").cast("string").alias("label"))
        .orderBy("h", "h2")
        .limit(params.max_docs)
        .collect()
    )
    if not sample:
        return None
    classes = tuple(sorted({r["label"] for r in sample}))
    y = np.array([classes.index(r["label"]) for r in sample])
    texts, held = [r["text"] for r in sample], np.arange(len(sample)) % 5 == 4
    table, bias = _train_numpy([t for t, x in zip(texts, held, strict=True) if not x], y[~held], len(classes), params)
    model = Model(classes, table.astype(np.float32), bias, 1.0, params)
    best, low = 1.0, 0.0
    if held.any():
        data = [t.encode() for t, x in zip(texts, held, strict=True) if x]
        z = _logits(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]), model)
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-9).mean()
        best = float(min(np.geomspace(0.1, 10, 41), key=loss))
        prob = _softmax(z / best)
        right = prob.argmax(1) == y[held]
        low = float(prob.max(1)[right].min()) if right.any() else 0.0
    return Model(classes, model.table, bias, best, params, low)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with the column ``probs`` (array of a probability for each of model.classes) in place of the text, or beside it.

    Without a model probs is empty.
    """
    if model is None:
        out = docs.withColumn("probs", F.array().cast("array<double>"))
        return out if keep_text else out.drop(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x classes floats: fixed by Params
    keep = [c for c in docs.columns if keep_text or c != text]
    schema = docs.select(*keep, F.array(F.lit(0.0)).alias("probs")).schema

    def run(batches):
        m = shared.value
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            got = [_softmax(_logits(buf, offs, m) / m.temperature) for _, buf, offs in text_chunks(column, STEP_BYTES)]
            probs = np.concatenate(got) if got else np.zeros((0, len(m.classes)))
            arrays = [b.column(b.schema.get_field_index(c)) for c in keep]
            flat = pa.ListArray.from_arrays(np.arange(0, probs.size + 1, len(m.classes), dtype=np.int32), pa.array(probs.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*arrays, flat], [*keep, "probs"])

    return docs.mapInArrow(run, schema)
