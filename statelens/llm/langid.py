"""Operator 10: language identification on averaged hashed subword embeddings, with calibrated rejection.

The documents that the training keeps aside set the temperature of the probabilities and the rejection: a document
is rejected whose best language is less sure than MARGIN times the least sure right answer among those, or than CHANCE
times a guess; but who is surer of one language than of all others together never is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelens.llm import embed
from statelens.llm.common import aside
from statelens.llm.quality import held_out

PARAMS = embed.Params()
#: Has a letter of any alphabet.
LETTER = r"\p{L}"
MARGIN, CHANCE = 0.45, 1.4


def rejection(model: embed.Model | None, reject_below: float | None = None) -> float:
    """The probability of the best language below which a document is rejected."""
    if reject_below is not None or model is None:
        return reject_below or 0.0
    return min(0.5, max(CHANCE / len(model.classes), MARGIN * model.surest_low))


def annotate(docs: DataFrame, params: embed.Params = PARAMS, reject_below: float | None = None, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, lang_score and rejected.

    Learns from text and lang of the documents that aren't held out. ``und`` (score 0) stands for null
    texts, texts without a letter, and everything where there is no labelled text to learn from.
    ``rejected`` holds for those and where the calibrated probability of the best language is below
    reject_below, by default what rejection() finds. Repeated rows each get their answer; columns of docs with the
    names of the new ones are replaced.
    """
    known = docs.where(~held_out("doc_id") & F.col("lang").isNotNull())
    train = known.where(embed.chosen("doc_id", known.count(), params)).select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"))
    model = embed.fit(train.where(F.col("text").rlike(LETTER)), params)
    docs = docs.drop("lang_pred", "lang_score", "rejected", "probs", "_letters")
    letters = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)) if model else F.lit(False)
    scored = embed.score(docs.withColumn("_letters", letters), model, keep_text=keep_text)
    best = F.array_max("probs")
    names = F.array(*[F.lit(c) for c in model.classes]) if model else F.array(F.lit("und"))
    lang = F.when(F.col("_letters"), F.element_at(names, F.array_position("probs", best).cast("int"))).otherwise("und")
    out = scored.withColumn("lang_pred", lang).withColumn("lang_score", F.when(F.col("_letters"), best).otherwise(0.0))
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("lang_score") < rejection(model, reject_below))).drop("probs", "_letters")


def identify(docs: DataFrame, params: embed.Params = PARAMS, reject_below: float | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each document; see annotate()."""
    out = annotate(docs.select("doc_id", "text", "lang"), params, reject_below, keep_text=False)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


def accept(docs: DataFrame, params: embed.Params = PARAMS, reject_below: float | None = None) -> DataFrame:
    """The documents that aren't rejected, as they are."""
    names = aside(docs.columns, ("lang_pred", "lang_score", "rejected", "probs", "_letters"))
    kept = annotate(docs.withColumnsRenamed(names), params, reject_below).where("not rejected")
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
