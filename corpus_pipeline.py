"""A corpus run through five operators, each stage on all that the one before kept.

toxicity drops the documents it rejects; near_dedup keeps one document of each group; decontamination drops documents that
hold a benchmark passage; secrets replaces secrets in texts; bpe encodes what is left and gives digests of the ids and of what they decode to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, decontamination, near_dedup, secrets, toxicity
from tessera.llm.common import delete_folder, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below REJECT. Rows are judged each, repeated ones and ones without an id or a text as well."""
    return toxicity.score_texts(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).filter(F.col("score") < REJECT).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Rows with the same id and different texts are judged each; of rows with
    the same id and text one stays, the one with the least lang, source and n_chars. A row without an id stays.

    Repeated rows are taken together by an aggregation before anything is shuffled, under the hash of their text.
    """
    docs = docs.select(*COLUMNS)
    groups = near_dedup.near_groups(docs)
    kept = groups.filter("kept and doc_id is not null").select("doc_id", "text_hash").distinct()
    own = docs.filter("doc_id is not null").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    least = F.min(F.struct("text", "lang", "source", "n_chars")).alias("own")
    # a null text and an empty one have the same hash
    once = own.groupBy("doc_id", "text_hash", F.col("text").isNull().alias("bare")).agg(least)
    rows = once.join(kept, ["doc_id", "text_hash"], "left_semi").select("doc_id", "own.text", "own.lang", "own.source", "own.n_chars")
    return rows.unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Rows are searched each; a null or empty text holds none."""
    return decontamination.find_passages(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).filter(F.size("spans") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where there were any. A null text becomes an empty one."""
    found = secrets.find_secrets(docs, keep=("doc_id", "lang", "source", "n_chars"))
    some = F.size("spans") > 0
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.when(some, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text they decode to. Rows are encoded each; a null or empty
    text has no ids.
    """
    coded = bpe_codec.encode_decode(docs)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]
#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, with each one's result written as Parquet in the shared folder and read again.

    A stage's result is deleted when the next one's is written; the last stage reads what stays.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    former = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if former:
            delete_folder(spark, f"{folder}/{former}")
        former = name
    return STAGES[-1][1](spark, docs, sf_dir)
