"""The numbered operators as named queries over whole tables.

Each query adapts one operator to the columns its contract names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat, collocations, contamination, embeddings, importance, langid, lm, mixing, ngram_join, pieces, quality, tokens, warc
from barloom.llm.shipping import ship
from barloom.session import materialize, workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ship(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.link_documents(table(spark, sf_dir, "documents"), width=3, num=90)


@query
def op1_warc_archive(spark, sf_dir):
    path = f"{workspace(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
    return warc.read_archive(spark, path).select(*names)


@query
def op2_chat_format(spark, sf_dir):
    tricky = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    return chat.read_back(materialize(chat.format_conversations(rows.unionByName(added)), "formatted"))


@query
def op8_token_ids(spark, sf_dir):
    path = f"{workspace(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write_segments(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.checksums(spark, path).withColumnRenamed("doc", "doc_id")


@query
def op7_benchmark_decontamination(spark, sf_dir):
    return contamination.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_embedding_near_dedup(spark, sf_dir):
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


@query
def op10_quality_classifier(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_text_model(docs), address_col="source", markup_col="text")


@query
def page_languages(spark, sf_dir):
    model = langid.fit_text_model(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages")
    text = langid.strip_markup(F.col("html"))
    return langid.identify(pages, model, "page_id", "html", address_col="url", markup_col="html", text=text)


@query
def op9_lm_scores(spark, sf_dir):
    scored = lm.score_documents(table(spark, sf_dir, "documents"))
    rounded = {c: F.round(c, 4) + F.lit(0.0) for c in ("log_score", "mean_log_score")}
    return scored.withColumns(rounded)


def domain_labels(spark, sf_dir, docs):
    """Labelled documents of three domains: toxic, and otherwise clean or poor."""
    toxic, quality = F.col("toxic"), F.col("quality")
    domain = F.when(toxic == 1, "toxic").when(quality == 1, "clean").when(quality == 0, "poor")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled_id"), domain.alias("domain"))
    texts = docs.select("doc_id", "text")
    return texts.join(labels, F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "domain")


MIX_WEIGHTS = {"clean": 0.90, "poor": 0.06, "toxic": 0.04}


@query
def op3_mixing_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_documents(docs, domain_labels(spark, sf_dir, docs), MIX_WEIGHTS)


@query
def op11_phrase_collocations(spark, sf_dir):
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


@query
def op12_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_sentence_pieces(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(pieces.encode_documents(table(spark, sf_dir, "documents"), path), path)
