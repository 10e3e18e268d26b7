"""Operator 1: quality classifier on supervised subword embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.llm import embed

PARAMS = embed.Params(shapes=True)


def held_out(key: str):
    """Whether crc32 of the key's text leaves 2 modulo 4; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, params: embed.Params = PARAMS) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (score >= threshold) for each document.

    Learns from the labelled documents that aren't held out. Null and empty texts get the prior's score;
    a null doc_id is scored but never learnt from; a repeated row is scored each time it occurs. Without any
    labelled text every score is 0.5.
    """
    known = labels.where("quality in (0, 1)").where(~held_out("doc_id")).select("doc_id", F.col("quality").alias("label"))
    picked = embed.chosen("doc_id", known.count(), params)
    labelled = docs.select("doc_id", "text").where(picked & ~held_out("doc_id")).join(known.where(picked), "doc_id")
    model = embed.fit(labelled.withColumnRenamed("doc_id", "key"), params)
    classes = model.classes if model else ()
    scored = embed.score(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model)
    p = F.col("probs")[classes.index("1")] if "1" in classes else F.lit(0.0 if classes else 0.5)
    return scored.select("doc_id", "held_out", p.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
