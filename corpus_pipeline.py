"""A corpus pipeline: each stage is one operator of evigraph.llm, and its decisions take effect.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Kept: documents
that aren't toxic; of those, documents in a learned language that dominates
them; one document of each group of near copies (the smallest id); documents
without a benchmark passage. The last stage packs them into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontamination, jaccard_join, language_id, packing, toxicity
from evigraph.llm._text import cut, in_fold, read

#: The least share of a document's words that its language must have.
MIN_SHARE = 0.5
#: Ids that are broadcast at once.
PASS_IDS = 1 << 21
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns from the labelled ones among docs.

    Null and empty texts are scored as such and stay, repeated rows are judged each, an empty table stays empty.
    Without labels of both classes, the labels' mean decides.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), ~in_fold("doc_id", 3, 1))
    return toxicity.keep_clean(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too), and those in which no learned language reaches MIN_SHARE.

    Rows with a null id are judged but not learned from. If nothing was learned, every row goes.
    """
    model = language_id.fit(docs, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 4, 2))
    return language_id.keep_dominated(docs, model, MIN_SHARE)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; of repeated ids, each row.

    Rows with a null id, and rows without words, aren't copies of anything and stay.
    """
    found = jaccard_join.jaccard_components(docs)
    dropped = found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept")).filter("not kept")
    return without_ids(docs, cut(dropped.select("doc_id"), "near-copies"))


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose id isn't among the distinct ones of dropped, in passes that broadcast at most PASS_IDS each: no text is shuffled."""
    passes = -(-dropped.count() // PASS_IDS)
    for k in range(passes):
        own = dropped.filter(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == k)
        docs = docs.join(F.broadcast(own.select(F.col("doc_id").alias("__dropped"))), F.col("doc_id") == F.col("__dropped"), "left_anti")
    return docs


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item, edited ones included.

    Null and empty texts hold none and stay; null items match nothing.
    """
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences; a null text is an empty document of one end token."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
