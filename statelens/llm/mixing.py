"""Operator 3: mixing sources to target weights by fitting token budgets as subset sums.

Targets: sources by code point, null last, weigh ``weights`` in turn and share the size of all documents;
no target exceeds ``most`` times its source's size, and what is over is shared again by weight. That has
a closed form: sort the sources by size / weight; the smallest are full, the rest get a common rate.

Selection: every document is taken floor(target / size of the source) times. For the budget that is left,
documents are counted by exact length within the source. At every size each length gives its share of whole
documents, rounded down or (largest remainders first) up, until at most ``reach`` words are left; a
bounded-knapsack dynamic programme over the documents that remain of each length fits those to the word. Then
each length's number of documents is picked by seeded hash. ``gap`` says how many words of the target a source
still lacks: 0 wherever some set of documents fits.

Empty and null texts have size 0 and are taken 0 times; an empty table gives no rows; a source of size 0
has target 0. Equal lengths are told apart by (hash of doc_id, doc_id); fully repeated rows by an
arbitrary order that changes no output row. A document is never taken more than ``most`` times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelens.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents that one task ranks at once; longer lists of equal length are cut into hash buckets.
RANKED = 2000
#: Most words that the dynamic programme fits, in one bitset of as many bits for each length.
REACH = 40_000


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row for each source; the windows run over this aggregate, never over documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rate = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("rate", rate).withColumn("full", F.col("cap") <= F.col("rate") * F.col("w"))
    # from the first source that isn't full on, the rate holds for all
    common = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("rate")))).over(everything)["rate"]
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(common * F.col("w")).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, reach_words: int = REACH) -> np.ndarray:
    """How many documents of each length (distinct, positive) to take so that their words come as near to budget as can be, from below."""
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = np.array([int(c) * budget % total for c in counts], dtype=object)
    left = budget - int((take * lengths).sum())
    for i in sorted(range(len(lengths)), key=lambda i: (-rest[i], i)):
        if left <= reach_words:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    # bit s of reach: a set of the items so far has s words; items are 1, 2, 4, ... documents of one length
    mask, reach, items = (1 << (left + 1)) - 1, 1, []
    for i in range(len(lengths)):
        n, size = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while n > 0:
            size = min(size, n)
            items.append((i, size, reach))
            reach |= (reach << (size * int(lengths[i]))) & mask
            n -= size
            size *= 2
        if reach >> left & 1:
            break
    s = reach.bit_length() - 1
    for i, size, earlier in reversed(items):
        if not earlier >> s & 1:
            take[i] += size
            s -= size * int(lengths[i])
    return take


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 11, reach: int = REACH) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of all the document's repeats), repeats and gap for each document.

    Columns of docs other than doc_id, source and text play no part.
    """
    # counted once: every step below reads the sizes
    sized = staged(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    plan = targets(sized, weights, most)
    lengths = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    lengths = lengths.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(most, int(target // total))
        extra = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(round(target)) - whole * total if whole < most else 0, reach)
        gap = int(round(target)) - whole * total - int((extra * pdf["size"].to_numpy()).sum())
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "whole": whole, "extra": extra, "gap": gap})

    # one row for each distinct length: d lengths need d (d + 1) / 2 words at least
    fitted = lengths.groupBy("source").applyInPandas(choose, "source string, size long, n long, whole long, extra long, gap long")
    row = F.struct(F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.col("doc_id"))
    fitted = staged(fitted)
    # a row for each source and length: too many to send out at scale
    f = fitted.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "whole", "extra").hint("shuffle_merge")
    placed = sized.where("size > 0").join(f, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    placed = placed.withColumn("row", row).withColumn("bucket", F.pmod(F.shiftrightunsigned(F.col("row.h"), 8), F.ceil(F.col("n") / RANKED)))
    buckets = placed.groupBy("source", "size", "bucket").agg(F.count("*").alias("b"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("k"), F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("earlier")).hint("shuffle_merge")
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("k"))).drop("s", "z", "k")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("row"))
    repeats = F.col("whole") + (F.col("earlier") + rank <= F.col("extra")).cast("long")
    chosen = placed.select("doc_id", "source", "size", repeats.alias("repeats"))
    chosen = chosen.union(sized.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long")))
    gaps = fitted.groupBy("source").agg(F.max("gap").alias("gap")).withColumnRenamed("source", "g")
    plan = plan.join(gaps, F.col("source").eqNullSafe(F.col("g")), "left").select(F.col("source").alias("s"), "source_size", "target", F.coalesce("gap", F.lit(0).cast("long")).alias("gap"))
    out = chosen.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "gap")
