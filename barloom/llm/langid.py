"""Language of documents by Bayesian fusion of several kinds of evidence.

* text: letter-trigram likelihoods per language, counted over labelled documents,
  beside a uniform background that stands for no language at all;
* markup: the language that the markup declares, with the reliability that each declared code shows
  in the corpus;
* address: a prior for the document's host, shrunk towards the prior of the
  address suffix, which is shrunk towards that of the corpus.

The corpus-wide parts are grouped sums of the text's posteriors. A document's own share is
taken out of them before it is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import SHARE, fold, share
from barloom.llm.words import PIECE, mix, text_slices
from barloom.session import materialize

BUCKETS = 1 << 15
SMOOTHING = 0.1
MOST_LANGUAGES = 500
#: Trigrams of a text stop counting as independent; so many count in full at most.
EFFECTIVE_TRIGRAMS = 200.0
BACKGROUND = "und"
BACKGROUND_PRIOR = 0.01
HOST_WEIGHT = 10.0
SUFFIX_WEIGHT = 10.0
DECLARED_SMOOTHING = 0.5
LEAST_PROBABILITY = 0.5

_LETTERS = np.full(256, 32, dtype=np.uint64)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def _trigrams(data: bytes) -> np.ndarray:
    """Buckets of the letter trigrams; runs of anything but letters count as one space."""
    letters = _LETTERS[np.frombuffer(data, dtype=np.uint8)]
    space = letters == 32
    letters = letters[np.concatenate(([True], ~(space[1:] & space[:-1])))] if len(letters) else letters
    if len(letters) < 3:
        return np.empty(0, dtype=np.int64)
    code = letters[:-2] << np.uint64(16) | letters[1:-1] << np.uint64(8) | letters[2:]
    return (mix(code + np.uint64(1)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _padded(text) -> bytes:
    return b" " + text.encode("utf-8", "surrogatepass") + b" " if isinstance(text, str) and text else b""


def text_trigrams(text) -> Iterator[np.ndarray]:
    """The trigram buckets of a whole text, by pieces that overlap in two bytes."""
    data = _padded(text)
    for at in range(0, len(data), PIECE):
        yield _trigrams(data[at : at + PIECE + 2])


@dataclass
class TextModel:
    languages: list[str]
    log_rates: np.ndarray  # (bucket, language), the background last

    def log_likelihoods(self, text) -> tuple[np.ndarray, int]:
        total, n = np.zeros(self.log_rates.shape[1]), 0
        for buckets in text_trigrams(text):
            total += self.log_rates[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return total * (1 / (1 + n / EFFECTIVE_TRIGRAMS)), n


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Counts the trigrams of all labelled documents; null labels and texts are left out."""
    labelled = docs.select(F.col(text_col).alias("text"), F.lower(lang_col).alias("lang")).where(
        "text is not null and lang is not null and lang != ''"
    )
    languages = sorted(r.lang for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"labels name more than {MOST_LANGUAGES} languages")
    place = {lang: i for i, lang in enumerate(languages)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for frame in text_slices(frames, 200):
            for text, lang in zip(frame["text"], frame["lang"]):
                for buckets in text_trigrams(text):
                    counts[place[lang]] += np.bincount(buckets, minlength=BUCKETS)
        yield share(counts)

    counts = np.zeros((0, BUCKETS))
    if languages:
        counts = fold(labelled.mapInPandas(run, SHARE), np.int64, len(languages) * BUCKETS)
        counts = counts.reshape(len(languages), BUCKETS)
    rates = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    rates = np.vstack([rates, np.full((1, BUCKETS), 1 / BUCKETS)])
    return TextModel(languages, np.ascontiguousarray(np.log(rates).T).astype(np.float32))


# --- evidence ---------------------------------------------------------------------------
def declared_language(markup: Column) -> Column:
    """The code that an ``html`` element's ``lang`` or ``xml:lang`` declares, in lower case; null without one."""
    code = F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.when(code != "", F.lower(code))


def host_of(address: Column) -> Column:
    """The host of an address or URL in lower case; empty without one."""
    host = F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1)).otherwise("")


def strip_markup(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces."""
    html = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(html, r"<[^>]*>", " ")


def _text_evidence(rows: DataFrame, shared) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: TextModel = shared.value
        prior = np.log(_start_prior(len(model.languages)))
        for frame in text_slices(frames, 200):
            logs, odds, counts = [], [], []
            for text in frame["text"]:
                log, n = model.log_likelihoods(text)
                p = np.exp(log + prior - (log + prior).max())
                logs.append(log)
                odds.append(p / p.sum())
                counts.append(n)
            yield frame.drop(columns="text").assign(log=logs, p=odds, trigrams=counts)

    schema = "doc bigint, host string, suffix string, declared string, log array<double>, p array<double>, trigrams bigint"
    return rows.mapInPandas(run, schema)


def _start_prior(languages: int) -> np.ndarray:
    if not languages:
        return np.ones(1)
    return np.append(np.full(languages, (1 - BACKGROUND_PRIOR) / languages), BACKGROUND_PRIOR)


def _sums(rows: DataFrame, width: int, *keys: str, source: str = "p", name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col(source)[i]) for i in range(width)]).alias(name))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def _shrunk(counts: Column, own: Column, parent: Column, weight: float) -> Column:
    """Counts without the document's own share, drawn towards the parent's distribution."""
    rest = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
    return F.zip_with(rest, parent, lambda c, q: (c + F.lit(weight) * q) / (_total(rest) + weight))


def identify(
    docs: DataFrame,
    model: TextModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    address_col: str | None = None,
    markup_col: str | None = None,
    text: Column | None = None,
) -> DataFrame:
    """(``id_col``, lang, probability, text_lang, declared, accepted) of every row.

    A row is accepted if its text has letters and its best language, fused from all evidence,
    is not the background and reaches ``LEAST_PROBABILITY``. Null and empty texts have no letters: they are
    rejected, and their language is null. Without a declared code or address that evidence is
    left out or is the corpus prior. Ties go to the first language in the alphabet. Rows without an id and
    repeated rows are judged like others. Without labelled documents nothing is accepted. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    none = F.lit(None).cast("string")
    host = host_of(F.col(address_col)) if address_col else F.lit("")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc"),
        host.alias("host"),
        suffix_of(host).alias("suffix"),
        (declared_language(F.col(markup_col)) if markup_col else none).alias("declared"),
        (F.col(text_col) if text is None else text).alias("text"),
    )
    seen = materialize(_text_evidence(rows, spark.sparkContext.broadcast(model)), "text-evidence")
    width = len(model.languages) + 1
    start = [float(x) for x in _start_prior(len(model.languages))]

    hosts = materialize(_sums(seen, width, "host", "suffix", name="host_sum"), "host-counts")
    suffixes = _sums(hosts, width, "suffix", source="host_sum", name="suffix_sum")
    codes = materialize(_sums(seen.where("declared is not null"), width, "declared", name="code_sum"), "declared-counts")
    whole = _sums(hosts, width, source="host_sum", name="all").first()["all"]
    corpus = np.array([x or 0.0 for x in whole]) + np.array(start)
    corpus = F.array(*[F.lit(float(x)) for x in corpus / corpus.sum()])
    declared = _sums(codes, width, source="code_sum", name="all").first()["all"]
    declared_all = F.array(*[F.lit(float(x or 0.0)) for x in declared])
    kinds = float(codes.count() + 1)

    joined = seen.join(hosts, ["host", "suffix"]).join(suffixes, "suffix").join(codes, "declared", "left")
    prior = _shrunk(F.col("suffix_sum"), F.col("p"), corpus, SUFFIX_WEIGHT)
    joined = joined.withColumn("suffix_prior", prior)
    joined = joined.withColumn("prior", _shrunk(F.col("host_sum"), F.col("p"), F.col("suffix_prior"), HOST_WEIGHT))
    code = F.zip_with("code_sum", "p", lambda c, o: F.greatest(c - o, F.lit(0.0)) + DECLARED_SMOOTHING)
    of_all = F.zip_with(declared_all, "p", lambda c, o: F.greatest(c - o, F.lit(0.0)) + DECLARED_SMOOTHING * kinds)
    said = F.coalesce(F.zip_with(code, of_all, lambda a, b: F.log(a / b)), F.transform("p", lambda _: F.lit(0.0)))
    joined = joined.withColumn("said", said)
    score = F.zip_with(
        F.zip_with("log", "said", lambda a, b: a + b), "prior", lambda a, q: a + F.log(F.greatest(q, F.lit(1e-12)))
    )
    joined = joined.withColumn("score", score).withColumn("best", F.array_max("score"))
    odds = F.transform("score", lambda s: F.exp(s - F.col("best")))
    names = F.array(*[F.lit(x) for x in [*model.languages, BACKGROUND]])
    at = F.array_position("score", F.col("best")).cast("int")
    has_text = F.col("trigrams") > 0
    lang = F.when(has_text, F.element_at(names, at))
    probability = F.when(has_text, 1 / _total(odds))
    text_lang = F.when(has_text, F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))
    return joined.select(
        F.col("doc").alias(id_col),
        lang.alias("lang"),
        probability.alias("probability"),
        text_lang.alias("text_lang"),
        "declared",
        F.coalesce((lang != BACKGROUND) & (probability >= LEAST_PROBABILITY), F.lit(False)).alias("accepted"),
    )
