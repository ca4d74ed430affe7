"""A training corpus from raw documents, in five stages.

Each stage takes all documents that the one before it kept, as a stored table, and returns
the columns of ``documents``; the last returns what was written per document.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import contamination, langid, mixing, ngram_join, tokens
from barloom.llm.queries import domain_labels, table
from barloom.llm.shipping import ship
from barloom.session import materialize, workspace

#: Target shares of expected tokens. Clean text is asked for beyond what there is, so that at a rate of one
#: at most all of it stays and the rest is thinned out.
WEIGHTS = {"clean": 0.97, "poor": 0.02, "toxic": 0.01}
CLEAN_FACTOR = 1.25


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of these ids; rows without an id stay.

    The ids are stored first, so that few of them are broadcast by their measured size
    and the texts stay where they are.
    """
    gone = materialize(ids.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of no known language go."""
    ship(spark)
    judged = langid.identify(docs, langid.fit_text_model(docs), address_col="source", markup_col="text")
    return _without(docs, judged.where("not accepted"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest id stays; of repeated rows one."""
    ship(spark)
    linked = materialize(ngram_join.link_documents(docs, width=5, num=80), "linked-documents")
    repeated = linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    kept = _without(docs, linked.where("doc_id != component_id"))
    if repeated.isEmpty():
        return kept
    # Of rows that repeat an id, the one that is first by its columns.
    ids = materialize(repeated.select(F.col("doc_id").alias("_gone")), "repeated-ids")
    first = F.min(F.struct(*kept.columns)).alias("first")
    one = kept.join(ids, kept["doc_id"] == ids["_gone"], "left_semi").groupBy("doc_id").agg(first).select("first.*")
    return kept.join(ids, kept["doc_id"] == ids["_gone"], "left_anti").unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    ship(spark)
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents stay, poor and toxic ones are thinned to their target weights."""
    ship(spark)
    labelled = domain_labels(spark, sf_dir, docs)
    domains = {r.domain for r in labelled.where("domain is not null").select("domain").distinct().collect()}
    weights = {d: w for d, w in WEIGHTS.items() if d in domains}
    if not weights:
        return docs
    anchor = ("clean", CLEAN_FACTOR) if "clean" in weights else None
    mixed = mixing.mix_documents(docs, labelled, weights, anchor=anchor, most=1.0)
    return mixing.apply_copies(docs, mixed)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the written segments."""
    ship(spark)
    path = f"{workspace(spark)}/corpus-{uuid.uuid4().hex}"
    tokens.write_segments(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.checksums(spark, path).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_weights", mix_domains),
    ("token_ids", write_token_ids),
]

#: Trained models and iterations are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
