"""Document quality from random-indexing word vectors and a small network.

Every word, and every run of symbols, has a row in a table of fixed size (rows are
shared by hash). Its index vector is sparse, ternary and derived from the row number. Its
word vector adds up the index vectors of the words around each of its occurrences in the
whole corpus, which are whole numbers, so the sum is exact and in any order. A document is
the mean of its words' vectors and of the products of neighbouring ones. A network of two layers learns the label
from a bounded sample of labelled documents; a temperature fitted on documents kept
apart from the training turns its output into calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import SHARE, fold, share
from barloom.llm.sampling import collect_sample
from barloom.llm.words import WORDS_AND_SYMBOLS, batch_word_hashes, text_slices
from barloom.session import materialize

ROWS = 1 << 14
DIMS = 64
NONZERO = 4
WINDOW = 2
HIDDEN = 32
POOL_STEP = 1 << 14
FEATURES = 2 * DIMS + 1
#: Labelled documents the network is fitted on, chosen by a hash of their ids.
TRAIN_DOCUMENTS = 20_000
EPOCHS = 60
BATCH = 256
RATE = 3e-3
DECAY = 1e-4
FOLDS = 5
CALIBRATION_FOLD = 1
DECISION = 0.3


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's nonzero elements."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((ROWS, DIMS)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), size=(ROWS, NONZERO))


def _word_rows(texts) -> list[np.ndarray]:
    return [(h & np.uint64(ROWS - 1)).astype(np.int64) for h in batch_word_hashes(texts, WORDS_AND_SYMBOLS)]


def _contexts(docs: DataFrame) -> np.ndarray:
    """Sums of the index vectors around every word, as (row, dimension)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, signs = _index_vectors()
        total = np.zeros(ROWS * DIMS, dtype=np.int64)
        for frame in text_slices(frames, 200):
            lists = _word_rows(frame["text"])
            rows = np.concatenate(lists)
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            for step in range(1, WINDOW + 1):
                same = doc[:-step] == doc[step:]
                left, right = rows[:-step][same], rows[step:][same]
                for word, context in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        at = word * DIMS + places[context, k]
                        total += np.bincount(at, weights=signs[context, k], minlength=len(total)).astype(np.int64)
        yield share(total.astype(np.int32))

    shares = docs.select("text").mapInPandas(run, SHARE)
    return fold(shares, np.int32, ROWS * DIMS, wide=np.int64).reshape(ROWS, DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors plus unit index vectors."""
    context = _contexts(docs).astype(np.float64)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1)
    places, signs = _index_vectors()
    own = np.zeros_like(context)
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO), axis=1)
    return (context + own).astype(np.float32)


def _pool(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Means of a text's word vectors and of the products of neighbours, and the log of its length.

    The products tell repeated words, which agree with their neighbours in every
    dimension, from running text. Long texts are added up piece by piece.
    """
    total = np.zeros(2 * DIMS)
    for at in range(0, len(rows), POOL_STEP):
        piece = words[rows[at : at + POOL_STEP + 1]]
        total[:DIMS] += piece[:POOL_STEP].sum(axis=0, dtype=np.float64)
        total[DIMS:] += np.einsum("ij,ij->j", piece[:-1], piece[1:], dtype=np.float64)
    total[:DIMS] /= max(1, len(rows))
    total[DIMS:] /= max(1, len(rows) - 1)
    return np.append(total, np.log1p(len(rows)) / 10).astype(np.float32)


def document_vectors(docs: DataFrame, words) -> DataFrame:
    """(doc, vector) of every row; zeros for a text without words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(frames, 200):
            out = [_pool(rows, words.value).tobytes() for rows in _word_rows(frame["text"])]
            yield pd.DataFrame({"doc": frame["doc"].to_numpy(), "vector": out})

    return docs.mapInPandas(run, "doc bigint, vector binary")


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        return np.tanh(z @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the cross-entropy; a constant where there is one class or no row."""
    rate = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(rate / (1 - rate)))
    dims = x.shape[1]
    if not len(y) or y.min() == y.max():
        zeros = np.zeros((dims, HIDDEN))
        return Network(np.zeros(dims), np.ones(dims), zeros, np.zeros(HIDDEN), np.zeros(HIDDEN), prior)
    rng = np.random.default_rng(seed)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - center) / scale
    w = [rng.normal(0, 1 / np.sqrt(dims), (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.array(prior)]
    first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            h = np.tanh(z[pick] @ w[0] + w[1])
            error = (_sigmoid(h @ w[2] + w[3]) - y[pick]) / len(pick)
            back = np.outer(error, w[2]) * (1 - h**2)
            grads = [z[pick].T @ back + DECAY * w[0], back.sum(axis=0), h.T @ error + DECAY * w[2], error.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                m, v = first[i] / (1 - 0.9**step), second[i] / (1 - 0.999**step)
                w[i] = w[i] - RATE * m / (np.sqrt(v) + 1e-8)
    return Network(center, scale, w[0], w[1], w[2], float(w[3]))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The scale of the logits with the least cross-entropy; 1 without rows."""
    if not len(y):
        return 1.0
    steps = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
    p = [np.clip(_sigmoid(logits / t), 1e-12, 1 - 1e-12) for t in steps]
    loss = [-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean() for q in p]
    return float(steps[int(np.argmin(loss))])


def fold_of(doc) -> F.Column:
    return F.pmod(F.crc32(F.encode(doc.cast("string"), "UTF-8")), F.lit(FOLDS))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """(``id_col``, held_out, score, predicted) of every row.

    ``score`` is the probability that the label is 1; ``predicted`` is 1 from
    ``DECISION`` on. Held out are rows whose crc32(id) mod ``FOLDS`` is 0: their labels are never
    read. Null and empty texts are scored like any other, from a zero vector. Rows without an id are scored
    and not held out. Labels that are null or neither 0 nor 1 are left out; repeated labels of a
    document all count. Without labels the score is 0.5 throughout; an empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    words = spark.sparkContext.broadcast(word_vectors(texts))
    vectors = materialize(document_vectors(texts, words), "document-vectors")
    known = (
        labels.select(F.col(id_col).cast("bigint").alias("doc"), F.col(label_col).cast("int").alias("label"))
        .where("label in (0, 1)")
        .withColumn("fold", fold_of(F.col("doc")))
        .where("fold != 0")
    )
    sample = collect_sample(vectors.join(known, "doc"), TRAIN_DOCUMENTS, "doc", "label")
    x = np.array([np.frombuffer(r.vector, dtype=np.float32) for r in sample], dtype=np.float64).reshape(-1, FEATURES)
    y = np.array([r.label for r in sample], dtype=np.float64)
    apart = np.array([r.fold == CALIBRATION_FOLD for r in sample], dtype=bool)
    network = train_network(x[~apart], y[~apart])
    network.temperature = fit_temperature(network.logits(x[apart]), y[apart])
    shared = spark.sparkContext.broadcast(network)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                points = np.stack([np.frombuffer(v, dtype=np.float32) for v in frame["vector"]]).astype(np.float64)
                yield pd.DataFrame({"doc": frame["doc"].to_numpy(), "score": shared.value.score(points)})

    scored = vectors.mapInPandas(run, "doc bigint, score double")
    return scored.select(
        F.col("doc").alias(id_col),
        F.coalesce(fold_of(F.col("doc")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= DECISION).cast("int").alias("predicted"),
    )
