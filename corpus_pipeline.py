"""A training-corpus pipeline over the documents table.

Toxic documents go, one document of each near-duplicate group stays, passages that an earlier
document has are cut out, documents that hold a benchmark item go, and the rest is packed into
sequences. Each stage works on all rows of the one before it and, up to the last, returns the
columns of ``documents``; its result is written and read again before the next, which first deletes
the tables that the stages before it left.

Nulls: a null text is an empty one for every stage; a null doc_id keeps its row. Extra columns
pass through all stages but the last. Texts from which nothing is cut stay as they are, white
space included; a text of which nothing is left stays as an empty one. Of rows with one doc_id each
is judged by its own text; repeated rows are near-duplicates, so one of them stays. Texts of any
length are read whole, each by one worker. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import common, decontamination, packing, simhash, substrings, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(docs)
    told = toxicity.toxicity(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return told.filter(F.col("score") < toxicity.CUT).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(common.release(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = substrings.deduplicated(common.release(docs))
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return told.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_items(common.release(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.release(docs), kept=KEPT)


#: Pieces of text whose ids a packing worker keeps; its executor's workers hold the stages before too.
KEPT = 150_000

STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL has no compression, tokenizer or majority hash; tests hold run() against a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.store(docs, name)
    return docs
