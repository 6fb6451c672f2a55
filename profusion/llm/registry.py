"""The registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from profusion.llm import decontamination, html_extraction, importance_resampling, language_id, line_dedup, lm_scoring, near_dedup, ogg, periodic_runs, pii, quality_gam, sentencepiece_dropout, warc
from profusion.session import table


def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_dropout.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_ogg(spark, sf_dir):
    return ogg.media_digests(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_html_extraction(spark, sf_dir):
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark, sf_dir):
    return importance_resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_classifier(spark, sf_dir):
    return quality_gam.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


def queries():
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_sentencepiece, op2_ogg, op3_line_dedup, op4_pii, op5_lm_scoring, op6_language_id, op7_near_dedup, op8_decontamination, op9_warc, op10_html_extraction, op11_importance_resampling, op12_quality_classifier, op13_periodic_runs)}


def oracle_sql():
    return {"op3_line_dedup": line_dedup.ORACLE_SQL, "op7_near_dedup": near_dedup.ORACLE_SQL, "op8_decontamination": decontamination.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op11_importance_resampling": importance_resampling.ORACLE_SQL}
