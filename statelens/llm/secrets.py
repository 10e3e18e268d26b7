"""Operator 2: secret scan with fixed patterns and a battery of randomness tests.

Fixed patterns find assignments, access keys and long hex runs. Beyond them every maximal token of 20 or
more characters of ``[A-Za-z0-9+/_=-]`` is a hypothesis "this is ordinary text". A token with an inner
``=`` (``NAME=value``) is cut there, and one with more separators than a random one has is cut at them, as it is
with runs of six digits; the parts of that length are hypotheses of their own. The encoding of each is inferred (hex,
base32, base64), and what ordinary tokens of that encoding look like is its null model: hex digits come in runs
of one class; capitals and mixed case come in words of letters that repeat, whose vowels alternate. Tests: too few
equal pairs of symbols (from the chi-squared statistic of alphabet uniformity), too many runs (of classes; of words, where
case is mixed), no alternation of vowels (lag-1 serial correlation); Fisher's method combines them, for hex the runs decide
alone. A token is never called random whose symbols a random source of its alphabet would not give: more uneven than
``UNIFORM_P``, or in the alphabet's own order.

False discoveries are controlled among a document's tested tokens, each weighted by its length (weighted
Benjamini-Hochberg; words too short to be tested have no weight), so what is found doesn't depend on how long
the text around it is. Single random tokens of 24 characters and more are found in over 0.9 of all cases in each
encoding, shorter ones and those among many other long tokens less often; dashed identifiers are found like base64.

Null and empty texts have no span; an empty table gives no rows; a column named ``found`` is replaced by scan(). Offsets count code points, ends are exclusive. Repeated rows each get
their own result; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.llm.common import text_chunks, word_spans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
MIN_TOKEN, FDR, UNIFORM_P = 20, 0.01, 1e-3
#: A random token has so many separators, or symbols in alphabetical order, less often than this.
SEPARATED_P, ORDERED_P = 1e-3, 1e-4
#: Ordinary tokens of each encoding: the chance that two symbols are equal (none: not tested), that a run ends, and the vowels' lag-1 correlation.
ORDINARY = {"hex": (None, 0.08, None), "base32": (0.06, 0.06, -0.35), "base64": (0.045, 0.16, -0.35)}
WORDS = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[+/_-]")
SEPARATORS = re.compile(rb"[+/_-]|[0-9]{6,}")
PART = re.compile(rb"[A-Za-z0-9+/_-]+(?:=+\Z)?")
_TOKEN = np.ones(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_=-")]] = False
_CLASS = np.full(256, 3)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 1, 0
_VOWEL = np.zeros(256)
_VOWEL[list(b"aeiouAEIOU")] = 1
ALPHABETS = (("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16), ("base32", re.compile(r"[A-Z2-7]+=*"), 32), ("base64", re.compile(r"[A-Za-z0-9+/_-]+=*"), 64))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out


def _at_least(k: int, n: int, p: float) -> float:
    """The chance of k or more of n events of chance p."""
    log_c = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
    return min(1.0, sum(math.exp(log_c(j) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k, n + 1)))


def _fisher(ps) -> float:
    """The combined p-value of independent tests."""
    x = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-x) * sum(x**i / math.factorial(i) for i in range(len(ps)))


def encoding(token: bytes) -> tuple[str, int]:
    """The smallest alphabet that a token is made of, and its size."""
    text = token.decode("ascii")
    return next(((name, size) for name, pattern, size in ALPHABETS if pattern.fullmatch(text)), ("none", 0))


def tests(token: bytes) -> tuple[str, float, float]:
    """(encoding, combined p-value under ordinary text, p-value under a random source; 0 where its symbols are in order)."""
    name, size = encoding(token)
    if not size:
        return name, 1.0, 0.0
    plain = token.rstrip(b"=")
    b = np.frombuffer(plain, np.uint8)
    n = len(b)
    counts = np.bincount(b, minlength=256)
    chi = size / n * float((counts**2).sum()) - n
    z = ((max(chi, 0.0) / (size - 1)) ** (1 / 3) - (1 - 2 / (9 * (size - 1)))) / math.sqrt(2 / (9 * (size - 1)))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    if _at_least(int((np.diff(b.astype(np.int16)) == 1).sum()), n - 1, 1 / size) < ORDERED_P:
        uniform = 0.0
    pair, turn, serial = ORDINARY[name]
    runs = len(WORDS.findall(plain)) - 1 if name == "base64" else int((np.diff(_CLASS[b]) != 0).sum())
    ps = [_at_least(runs, n - 1, turn)]
    if pair is not None:
        pairs, mean = int((counts * (counts - 1)).sum() // 2), n * (n - 1) / 2 * pair
        ps.append(min(1.0, sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(min(pairs, 5000) + 1))))
        v = _VOWEL[b]
        r = float(np.corrcoef(v[:-1], v[1:])[0, 1]) if 0 < v[:-1].sum() < n - 1 and 0 < v[1:].sum() < n - 1 else 0.0
        ps.append(0.5 * math.erfc((r - serial) * math.sqrt(n) / math.sqrt(2)))
    return name, _fisher(ps), uniform


def parts(token: bytes) -> list[tuple[int, bytes]]:
    """(offset, characters) of what is tested of a token: its long parts between inner ``=``; of those that are words between
    separators, or hold long numbers, the long parts between them.
    """
    whole = [(0, token)] if b"=" not in token.rstrip(b"=") else [(m.start(), m[0]) for m in PART.finditer(token) if len(m[0]) >= MIN_TOKEN]
    out = []
    for at, part in whole:
        if encoding(part)[0] == "base64":
            cuts = list(SEPARATORS.finditer(part))
            if any(len(m[0]) > 1 for m in cuts) or _at_least(len(cuts), len(part), 2 / 64) < SEPARATED_P:
                edges = [0, *(x for m in cuts for x in m.span()), len(part)]
                out += [(at + a, part[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= MIN_TOKEN]
                continue
        out.append((at, part))
    return out


def discoveries(found: list[tuple[float, float, int]]) -> list[bool]:
    """Which of (p, uniform p, length) are random: Benjamini-Hochberg over them, weighted by length."""
    if not found:
        return []
    mean = sum(n for _, _, n in found) / len(found)
    q = np.array([p * mean / n if u >= UNIFORM_P else 2.0 for p, u, n in found])
    order = np.argsort(q, kind="stable")
    ok = q[order] <= FDR * np.arange(1, len(q) + 1) / len(q)
    cut = np.flatnonzero(ok)
    out = np.zeros(len(q), bool)
    if len(cut):
        out[order[: cut[-1] + 1]] = True
    return [bool(x) and v <= 1 for x, v in zip(out, q, strict=True)]


def _scan_batch(column) -> list[list[tuple[int, int, str]]]:
    """Sorted spans of each row of an Arrow string column."""
    out: list = []
    for lo, buf, offs in text_chunks(column):
        starts, ends, _ = word_spans(buf, offs, _TOKEN)
        rows = np.searchsorted(offs, starts, side="right") - 1
        long_ones = np.flatnonzero(ends - starts >= MIN_TOKEN)
        by_row: dict = {}
        for i in long_ones:
            by_row.setdefault(int(rows[i]), []).append((int(starts[i]), int(ends[i])))
        for r in range(len(offs) - 1):
            raw = buf[offs[r] : offs[r + 1]]
            text = raw.tobytes().decode()
            spans = base_spans(text)
            if r in by_row:
                before = np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80)])
                cands = []
                for s, e in by_row[r]:
                    a = s - int(offs[r])
                    token, at = raw[a : a + e - s].tobytes(), a - int(before[a])
                    spans += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(token.decode()) if len(m[0]) >= 32]
                    cands += [(at + i, at + i + len(x), x) for i, x in parts(token)]
                free = [c for c in cands if not any(c[0] < e and s < c[1] for s, e, _ in spans)]
                judged = [(*tests(c[2])[1:], len(c[2])) for c in free]
                spans += [(s, e, "random") for (s, e, _), y in zip(free, discoveries(judged), strict=True) if y]
            out.append(sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with ``found``: an array of (start, end, kind) sorted by start, then kind."""
    import pyarrow as pa

    keep = [c for c in docs.columns if c not in (text, "found")]
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"
    schema = docs.select(*keep, F.lit(None).cast(kind).alias("found")).schema
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for b in batches:
            got = [[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in _scan_batch(b.column(b.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(got, arrow)], [*keep, "found"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op2 from the rows of scan()."""
    base = F.filter("found", lambda x: x["kind"] != "random")
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"), n("random").alias("n_random"),
    )


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every found span of ``text`` replaced by mask, overlapping spans by one; n_chars follows where it exists.

    Rows without a span, null texts included, are returned as they are.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            i = b.schema.get_field_index("text")
            found = _scan_batch(b.column(i))
            if not any(found):
                yield b
                continue
            texts, n = b.column(i).to_pylist(), b.schema.get_field_index("n_chars")
            sizes = b.column(n).to_pylist() if n >= 0 else None
            for r, spans in enumerate(found):
                if not spans:
                    continue
                parts, at = [], 0
                end = 0
                for s, e, _ in spans:
                    if s >= end:
                        parts += [texts[r][at:s], mask]
                    end = max(end, e)
                    at = end
                texts[r] = "".join(parts) + texts[r][at:]
                if sizes is not None:
                    sizes[r] = len(texts[r])
            cols = list(b.columns)
            cols[i] = pa.array(texts, b.schema.field(i).type)
            if sizes is not None:
                cols[n] = pa.array(sizes, b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
