"""A training-data pipeline over the documents table.

Stages, each over all that the one before kept, written as Parquet and read again in between:

1. toxicity: documents that the classifier predicts toxic go;
2. near_duplicates: of each group of near copies (five-word shingles, similarity 0.8) the document of the smallest doc_id stays;
3. repeated_passages: every byte covered by a 200-byte string that occurs twice is cut out of the texts, at all the places where it occurs;
4. personal_data: personal data gets format-preserving pseudonyms (the key is spark.barloom.pii.key, or one drawn for the session);
5. packing: texts are tokenized and packed into windows of up to 2048 tokens.

All stages but the last return the columns of documents, whatever other columns there are; n_chars, if there, is counted anew where a text has changed.
SQL can't express them, so ORACLE_SQL is None.

Edge cases: null, empty and wordless texts pass all stages and are packed as their end token; null texts become empty where
passages are cut. Rows that repeat a doc_id are scored, cut and packed one by one; as near duplicates they are one document, which stays or goes whole. Rows with a null doc_id
stay. An empty table gives an empty table at every stage. Columns named like those that a stage works with are no clash.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import minhash, packing, pii, suffix_array, toxicity
from barloom.llm.common import delete_folder, secret_key, shared_dir, table, workers_import


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of `like`, n_chars counted anew if there is such a column."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_import(spark)
    out = free_name(docs, "score")
    scored = toxicity.score_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), out=out)
    return scored.filter(F.col(out) < 0.5).drop(out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs, width=5, percent=80)
    gone = found.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(suffix_array.remove_repeats(docs), docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(pii.pseudonymize(docs, secret_key(spark)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", cut_repeats), ("personal_data", hide_personal_data), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
