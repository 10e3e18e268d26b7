"""The registered queries of this subpackage, and the SQL that DuckDB compares some of them with."""

from __future__ import annotations

from pyspark.sql import functions as F

from statelens.llm import alignment, decontam, html, jaccard, langid, licenses, media, mixing, quality, redirects, search, secrets, substrings


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_source_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "gap")


def op4_media_columns(spark, sf_dir):
    return media.features(media.store(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_license_scan(spark, sf_dir):
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op6_ngram_jaccard(spark, sf_dir):
    return jaccard.link(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_decontamination(spark, sf_dir):
    found = decontam.annotate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return decontam.digest(found).drop("longest_item")


def op8_suffix_dedup(spark, sf_dir):
    return substrings.dedup(_table(spark, sf_dir, "documents"))


def op9_html_text(spark, sf_dir):
    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark, sf_dir):
    return alignment.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The contract's rules.
URL_RULES = [
    redirects.Rule(True, "org", "/"), redirects.Rule(False, "example.org", "/es/"), redirects.Rule(False, "example.org", "/en/1"),
    redirects.Rule(True, "com", "/fr/"), redirects.Rule(False, "com", "/de/"),
]


def op12_url_filter(spark, sf_dir):
    return redirects.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op13_lexical_search(spark, sf_dir):
    return search.Index(_table(spark, sf_dir, "documents")).search(_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scan": op2_secret_scan,
    "op3_source_mixing": op3_source_mixing,
    "op4_media_columns": op4_media_columns,
    "op5_license_scan": op5_license_scan,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_html_text": op9_html_text,
    "op10_language_id": op10_language_id,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_url_filter": op12_url_filter,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES = {"op5_license_scan": licenses.oracle(), "op7_decontamination": decontam.ORACLE, "op12_url_filter": redirects.oracle(URL_RULES), "op13_lexical_search": search.ORACLE}
