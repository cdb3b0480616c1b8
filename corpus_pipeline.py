"""A training corpus from documents: language, quality, near-duplicates, mixture, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.llm import language, minhash, mixing, packing, quality
from bytestrata.llm.queries import table, with_quality
from bytestrata.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Times the share that a text of no language in particular would have of each.
LEAST_GAIN = 1.2
NEAR = minhash.Params(shingle=5, num=80, den=100)
MIX = mixing.Params(weights=mixing.WEIGHTS, budget=0.9, epochs=1)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose best language scores below LEAST_GAIN over the number of learned ones.
    Texts that switch between languages stay: their score is the share of the main one.

    Null, empty and letterless texts go. Repeated rows and rows with a null doc_id, lang or source are judged by their text
    alone. Without a row that has lang and text nothing can be learned and all rows go. An empty table stays empty.
    """
    model = language.fit(docs, F.lit(True))
    least = min(0.999, LEAST_GAIN / max(1, len(model.languages)))
    return language.identify(docs, model, carry=True).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that importance resampling does not draw; it draws the share of good ones among the labelled.

    Null text counts as empty, and as equal to the target with a weight of 0. Repeated rows share their draw, and rows with
    a null doc_id share one. Without labels all rows stay. An empty table stays empty.
    """
    marked = with_quality(docs, table(spark, sf_dir, "labels"))
    return quality.resample(marked, F.col("quality") == 1, F.col("quality").isNotNull(), carry=True).where("selected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates.

    Null and empty texts and rows with a null doc_id are like nothing and stay. Rows that repeat a doc_id stay or go
    together. An empty table stays empty.
    """
    return minhash.keep_one(docs, NEAR).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, as near to the target weights as one epoch allows.

    Null lang and source are the value "". Texts without a word cost nothing and go with their leaf's order. Rows that repeat
    a doc_id and its number of words stay or go together. An empty table stays empty.
    """
    with_domain = docs.withColumn("domain", mixing.domain(F.col("source")))
    return mixing.mix(with_domain, MIX, mixing.n_tokens(F.col("text"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its place in a sequence of at most 2048 tokens.

    Null and empty texts are one piece of one token. Longer texts than a sequence are cut; repeated rows and rows with a null
    doc_id are packed each for itself. An empty table gives no row.
    """
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: SQL can't express the trained stages; tests/llm/test_pipeline.py holds each stage against its definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
            scratch.drop(before)
    return docs
