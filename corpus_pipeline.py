"""A corpus pipeline of five stages over ``documents``; part of the text subpackage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame
that is written as Parquet and reread as the next one's documents.  All but the last return the columns
of ``documents``; other columns are dropped.

1. Language ID learns from the labelled documents and drops what it rejects.
2. Near duplicates (Jaccard of word 5-grams of 0.75 or more): the smallest id of each group stays, of
   its texts the one of least hash, once.
3. Substring dedup cuts bytes that an earlier document holds; a document of which nothing is left goes.
4. Decontamination drops documents that hold a benchmark passage.
5. BPE encodes and decodes what is left.

A null text has no language and goes in the first stage.  Empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, decontaminate, language_id, ngram_join, substring_dedup
from tallyforge.llm.common import likely, read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    out = language_id.predict(docs, language_id.learn_from(docs), keep=tuple(COLUMNS))
    return out.where("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    groups = written(ngram_join.near_duplicates(docs).where("n_shingles > 0"), "groups")
    # an id may name several texts, so rows are told apart by id and text
    leads = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("leader_hash"))
    spare = groups.where(~leads).select("doc_id", "text_hash").distinct()
    repeated = groups.where(leads).groupBy("doc_id", "text_hash").count().where("count > 1").drop("count")
    known = written(spare.withColumn("one", F.lit(False)).unionByName(repeated.withColumn("one", F.lit(True))), "spare")
    # texts that no group may concern are not shuffled
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    asked = known.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    met = likely(own, known).join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    once = met.where("one").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)
    return likely(docs, known, others=True).unionByName(met.where("one is null").select(*COLUMNS)).unionByName(once)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    out = substring_dedup.cut_repeats(docs, keep=("lang", "source"), texts=True)
    out = out.where("n_bytes = 0 or n_removed < n_bytes")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    out = decontaminate.hit_spans(docs, read_table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return out.where(F.size("spans") == 0).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_substrings),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", encoding),
]

# Language models of the first stage and the tokenizer of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
