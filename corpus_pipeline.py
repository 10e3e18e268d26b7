"""From raw documents to a training mix: language, near-duplicates, contamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on every document that the stage before kept, and returns a
DataFrame; all but the last return the columns of ``documents``. Nothing but a stage's own decision drops
or changes a document: stage 1 drops rejected languages, 2 keeps one document of each group of near-copies,
3 drops contaminated documents, 4 masks secrets inside the text, 5 says how many words the mix takes of each.

An empty table gives an empty table in every stage. Columns beyond those of ``documents`` come through the first
four, whatever their names.
"""

from __future__ import annotations

from statelens.llm import decontam, jaccard, langid, mixing, secrets
from statelens.llm.common import staged


def language(spark, docs, sf_dir):
    """Operator 10: documents whose language is rejected go: null and empty texts, texts without a letter, and those hardly
    surer of one language than of others. Repeated rows each stay or go; without any labelled text all are rejected.
    """
    return langid.accept(docs)


def near_duplicates(spark, docs, sf_dir):
    """Operator 6 on shingles of five words at a similarity of 0.8: one document of each group stays, that of the least
    doc_id. Ids that repeat or are null are told apart by their texts; texts without words are alike to none.
    """
    return jaccard.one_of_each(docs, 5, 80, 100)


def decontamination(spark, docs, sf_dir):
    """Operator 7: contaminated documents go. Null and empty texts are clean, and so is all without a benchmark."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark, docs, sf_dir):
    """Operator 2: secrets are masked, the documents stay; n_chars follows the text. Null texts stay null."""
    return secrets.redact(docs)


def mixture(spark, docs, sf_dir):
    """Operator 3: the words that the mix takes of each document. Null and empty texts have none; a null source is one."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_masking),
    ("mixing to target weights", mixture),
]
#: A trained model and a union of verified links decide: not for SQL. tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in order on ``documents``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
