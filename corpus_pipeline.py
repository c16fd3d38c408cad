"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing, tokens. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import bpe, linededup, mixing, ngramjoin, toxicity
from tablewright.llm._shared import collected, drop_path, fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't find toxic."""
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier; those with nothing else go."""
    return linededup.dedup_documents(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngramjoin.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the sources' target proportions, in shards' order."""
    new = fresh(docs, "mix_shard"), fresh(docs, "mix_position")
    return mixing.mix_sources(docs, power=mixing.POWER, shard_col=new[0], position_col=new[1]).drop(*new)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and its text decoded from them."""
    return bpe.encode_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: The first stage trains a classifier, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written in the shared folder and read by the next. What a stage
    left there besides is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with collected() as paths:
            docs = written(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        for p in {*paths, before} - {docs.shared_path, None}:
            drop_path(spark, p)
        before = docs.shared_path
    return docs
