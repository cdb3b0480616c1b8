"""Driver queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.llm import bloom_lm, chat, hnsw, kdtree, language, minhash, mixing, packing, quality, warc
from bytestrata.llm.scratch import Scratch, fresh


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ECHO = "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ECHO).alias("text"))
    return chat.digests(chat.read_back(chat.format_turns(rows.unionByName(more))))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, similarity of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Params(shingle=3, num=85, den=100))


def id_fold(folds: int, column: str = "doc_id"):
    """crc32 of a doc_id's text modulo folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every vector whose id is divisible by 50, against all."""
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within each label."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, looked up in the index and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


MIX = mixing.Params(weights=mixing.WEIGHTS, budget=1.0, epochs=2)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as all documents have, at target weights, no document more than twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.domain(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    slim = docs.select("doc_id", "domain", "lang", "source", mixing.n_tokens(F.col("text")).alias("n"))
    return mixing.mix(Scratch(spark, "tokens").save(slim), MIX, F.col("n")).drop("n")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by a CRF that learns from the rows whose id fold is not 1. A null id counts as not held
    out and is not learned from."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"), F.coalesce(id_fold(3) != 1, F.lit(False)))
    return language.identify(docs.select("doc_id", F.coalesce(id_fold(3) == 1, F.lit(False)).alias("held_out"), "text"), model)


LABEL_ROWS = 200_000


def with_quality(docs: DataFrame, labels: DataFrame, most: int = LABEL_ROWS) -> DataFrame:
    """docs with a column quality, null where not labelled. Of more than ``most`` labelled ids those with the smallest hashes
    count, a bounded sample that is broadcast; of conflicting labels the lower one."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    name, h = fresh(docs, "labelled_id"), F.xxhash64("doc_id")
    share = min(1.0, 2 * most / max(1, labels.count()))
    few = one.where(F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.pmod(h, F.lit(1 << 30)), "doc_id").limit(most)
    few = few.withColumnRenamed("doc_id", name)
    return docs.drop("quality").join(F.broadcast(few), docs["doc_id"] == F.col(name), "left").drop(name)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling of all documents towards those labelled as of good quality."""
    docs = with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.resample(docs, F.col("quality") == 1, F.col("quality").isNotNull()).drop("quality")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents. Rows without an id are not learned from and count as held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", F.coalesce(id_fold(7) == 2, F.lit(True)).alias("held_out"), "text")
    return bloom_lm.score_documents(docs, ~F.col("held_out"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}
ORACLES: dict[str, str] = {
    "op1_exact_top_k": kdtree.ORACLE,
    "op4_mixing": mixing.oracle(MIX.budget, MIX.epochs, MIX.seed),
    "op9_chat_formatting": chat.ORACLE,
}
