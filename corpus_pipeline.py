"""A training corpus from ``documents``: language ID, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next
stage's docs. All but the last return the columns of ``documents``, whatever columns it has besides; what a stage adds and reads
itself takes names that are free. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from profusion.llm import decontamination, language_id, line_dedup, near_dedup, sentencepiece_dropout
from profusion.llm.common import new_names
from profusion.session import table, written

#: SQL can't express the language models; the stages are tested one by one and the whole by brute force.
ORACLE_SQL = None


def identify_language(spark, docs, sf_dir):
    """Documents whose language is rejected go; lang becomes the predicted language."""
    lang, accepted = new_names(docs, "lang_pred", "accepted")
    seen = language_id.detect(docs, language_id.train(docs)).filter(F.col(accepted))
    return seen.select(*(F.col(lang).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def dedup_lines(spark, docs, sf_dir):
    """Repeated lines stay only in their smallest document; documents left without text go."""
    dropped = F.col(new_names(docs, "n_dropped")[0])
    kept = line_dedup.dedup_lines(docs).filter((dropped == 0) | (F.trim("text") != ""))
    size = F.when(dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return kept.select(*(size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each class of near-duplicates stays."""
    return near_dedup.near_dedup(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that contain a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """Token ids with merge-dropout, and whether they decode to the text."""
    return sentencepiece_dropout.encode(docs).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
