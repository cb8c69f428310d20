"""From raw documents to shards of a training mix: language ID, near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but
the last return the columns of docs. Between stages run() writes Parquet in the shared folder and reads it again.

Defined results: a document whose text is null or has no letter goes at the first stage; texts count whole, however
long; of repeated rows and of ties in doc_id one row stays at the second stage; an empty table gives an empty table; all
columns of a row stay as they are, whatever their names, but for text and n_chars where the mix cuts a document, and for
slot and shard, which the last stage sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pipeloom.llm import decontamination, language_id, mixing, near_dedup, sharding
from pipeloom.llm._store import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or with a doubtful language go."""
    return language_id.identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: links at 0.8 on sets of five-word shingles (op7's own has four)."""
    return near_dedup.deduplicated(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's rows: a document is there once for each pass that takes words of it, cut to these where they aren't all."""
    return mixing.realise(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard for every row, by a hash of its id."""
    return sharding.shard(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_copies), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", assign_shards)]

#: SQL can't express the trained language model, the sketches and the seeded selection; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs


