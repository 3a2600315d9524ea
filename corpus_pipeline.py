"""A training-data pipeline over documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; all but the last return the
columns of documents.

Edge cases, for all stages: rows are decided on as rows, by id and text together, so rows of one id with different texts
are different documents and a null id is an id like any other.  Null and empty texts are of no language and go in the
first stage; later stages keep them, as they hold no words to compare or match.  Repeated rows share every decision, and
of rows with equal id and text one stays in the second stage.  Texts are read whole, however long.  Extra columns are kept by all
stages but the last, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontaminate, language_id, mixing, near_dedup, secret_scan
from textquarry.llm.common import crc_mod, cut, table, unused

#: A document whose language is less sure than this goes.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or of an uncertain one, go."""
    model = language_id.train(docs.where(crc_mod("doc_id", 4) != 2), "text", "lang", "doc_id")
    lang, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    told = language_id.identify(docs, model, lang_name=lang, score_name=score)
    return told.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shares at least 0.8 of its five-word shingles, one document stays: that of the smallest id, null last."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced by a mark; all documents stay."""
    return secret_scan.redact(docs, repo_col=F.concat_ws("/", "source", "lang"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; none is dropped."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model decides in the first stage, which SQL can't express.
ORACLE_SQL = None
