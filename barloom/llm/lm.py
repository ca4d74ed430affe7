"""Stupid-backoff language model scores, each document left out of its own counts.

The corpus is cut into blocks of documents, stored once and bucketed by block, so that later
joins find them in place. For every order the n-grams of a block are exploded, counted
within the block and dealt by ranges of their hash; each range adds the blocks' counts up to
the range's part of the count table and joins them back to the blocks that asked. Scores are
then summed per document.

An n-gram can occur in another document only if both shorter n-grams inside it do. The orders
are counted from the shortest up, and n-grams that fail this are not sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import batch_word_hashes, mix, seeds
from barloom.session import materialize, workspace

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
_FACTORS = seeds(2, 31)


# --- compact arrays -----------------------------------------------------------------------
def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _cuts(parts: int) -> np.ndarray:
    """Upper ends of equal ranges of hashes."""
    return np.array([(i * (1 << 64)) // parts for i in range(1, parts)], dtype=np.uint64)


# --- blocks ---------------------------------------------------------------------------------
def _write_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0

        def flush() -> pd.DataFrame:
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            row = {
                "block": uuid.uuid4().hex,
                "docs": [None if pd.isna(i) else int(i) for i in ids],
                "lengths": [len(d) for d in data],
                "texts": zstandard.compress(b"".join(data), 3),
                "words": int(sum(map(len, batch_word_hashes(texts)))),
            }
            return pd.DataFrame([row])

        for frame in frames:
            for doc, text in zip(frame["doc"], frame["text"]):
                text = text if isinstance(text, str) else ""
                ids.append(doc)
                texts.append(text)
                size += len(text) + 1
                if size >= BLOCK_BYTES:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    spark = docs.sparkSession
    name = f"lm_blocks_{uuid.uuid4().hex}"
    schema = "block string, docs array<bigint>, lengths array<bigint>, texts binary, words bigint"
    (
        docs.mapInPandas(run, schema)
        .write.format("parquet")
        .option("path", f"{workspace(spark)}/{name}")
        .bucketBy(buckets, "block")
        .saveAsTable(name)
    )
    return spark.table(name)


class Block:
    """The words of a block's documents and how often each n-gram occurs elsewhere."""

    def __init__(self, lengths, texts: bytes):
        data, out, at = zstandard.decompress(texts), [], 0
        for n in lengths:
            out.append(data[at : at + n].decode("utf-8", "surrogatepass"))
            at += n
        words = batch_word_hashes(out)
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.words = np.concatenate(words) if words else np.empty(0, dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.hashes = self.words
        self.may = np.ones(len(self.words), dtype=bool)
        self.elsewhere: list[np.ndarray] = []

    def ask(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of the next order, ascending, and their counts in the block."""
        self.where = np.flatnonzero(self.may)
        keys, self.inverse, counts = np.unique(self.hashes[self.where], return_inverse=True, return_counts=True)
        return keys, counts.astype(np.uint32)  # a block's texts have fewer than 2^32 words

    def answer(self, totals: np.ndarray) -> None:
        """Takes the corpus counts of what ``ask`` returned and goes on to the next order."""
        out = np.zeros(len(self.words), dtype=np.int64)
        if len(self.where):
            pair = self.doc[self.where] * (len(totals) + 1) + self.inverse
            _, at, own = np.unique(pair, return_inverse=True, return_counts=True)
            out[self.where] = totals[self.inverse].astype(np.int64) - own[at]
        self.elsewhere.append(out)
        order = len(self.elsewhere) + 1
        seen = out > 0
        self.may = np.zeros(len(self.words), dtype=bool)
        self.may[1:] = seen[1:] & seen[:-1] & (self.place[1:] >= order - 1)
        longer = np.zeros_like(self.words)
        longer[1:] = mix(mix(self.hashes[:-1] * _FACTORS[0]) + self.words[1:] * _FACTORS[1])
        self.hashes = longer

    def scores(self, corpus_words: int) -> pd.DataFrame:
        order = len(self.elsewhere)
        n = np.maximum(1, corpus_words - self.sizes)[self.doc] if len(self.words) else np.empty(0)
        score = -np.log(n + 1.0)
        level = np.zeros(len(self.words), dtype=np.int64)
        for k in range(1, order + 1):
            found = np.flatnonzero(self.elsewhere[k - 1] > 0)
            below = n[found] if k == 1 else self.elsewhere[k - 2][found - 1]
            score[found] = np.log(self.elsewhere[k - 1][found]) - np.log(below)
            level[found] = k
        longest = np.minimum(self.place + 1, order)
        score += np.log(BACKOFF) * (longest - level)
        docs = len(self.sizes)
        out = {"n_words": self.sizes, "log_score": np.bincount(self.doc, weights=score, minlength=docs)}
        for k in range(order + 1):
            out[f"order_{k}"] = np.bincount(self.doc[level == k], minlength=docs)
        return pd.DataFrame(out)


def _replay(row, known: int) -> Block:
    block = Block(row["lengths"], row["texts"])
    for k in range(1, known + 1):
        keys, _ = block.ask()
        parts = row[f"counts_{k}"]
        given = [_unpack(p["totals"], np.uint64) for p in parts] if parts is not None else []
        totals = np.concatenate(given) if given else np.empty(0, dtype=np.uint64)
        if len(totals) != len(keys):
            raise RuntimeError("a block's counts are incomplete")
        block.answer(totals)
    return block


# --- count tables ------------------------------------------------------------------------------
def _explode(blocks: DataFrame, known: int, parts: int) -> DataFrame:
    """(part, block, hashes, counts): a block's n-grams of the next order by hash range."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = _cuts(parts)
        for frame in frames:
            for row in frame.to_dict("records"):
                keys, counts = _replay(row, known).ask()
                ends = [0, *np.searchsorted(keys, cuts), len(keys)]
                used = [p for p in range(parts) if ends[p] < ends[p + 1]]
                yield pd.DataFrame(
                    {
                        "part": used,
                        "block": row["block"],
                        "hashes": [_pack_sorted(keys[ends[p] : ends[p + 1]]) for p in used],
                        "counts": [_pack(counts[ends[p] : ends[p + 1]]) for p in used],
                    }
                )

    return blocks.mapInPandas(run, "part int, block string, hashes binary, counts binary")


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    """One range of the count table, joined back to the blocks that asked."""
    asked = [_unpack_sorted(h) for h in group["hashes"]]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.concatenate([_unpack(c, np.uint32) for c in group["counts"]])
    totals = np.zeros(len(keys), dtype=np.uint64)
    np.add.at(totals, inverse, counts.astype(np.uint64))
    totals = totals[inverse]
    ends = np.cumsum([len(a) for a in asked])[:-1]
    return pd.DataFrame(
        {"block": group["block"].to_numpy(), "part": group["part"].to_numpy(), "totals": [_pack(t) for t in np.split(totals, ends)]}
    )


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER
) -> DataFrame:
    """(``id_col``, n_words, log_score, mean_log_score, order_0 ... order_n) of every row.

    The score of a word is its relative count after the longest history with which it occurs in
    another document, times ``BACKOFF`` for every word of history given up; a word that no other document has
    counts as one in the rest of the corpus and is order 0. ``log_score`` is the sum of natural
    logarithms, ``order_k`` the number of words scored with k-grams. Words are
    runs of other than white space with A-Z lowered. Null and empty texts have 0 words, score 0 and no mean. Rows are documents
    of their own even if they repeat an id or text; rows without an id are scored too. An empty table
    gives an empty result; other columns are ignored.
    """
    if order < 1:
        raise ValueError("the order is 1 or more")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    blocks = _write_blocks(texts, parts)
    corpus_words = blocks.agg(F.sum("words")).first()[0] or 0
    joined = blocks.select("block", "docs", "lengths", "texts")
    for k in range(1, order + 1):
        asked = _explode(joined.drop("docs"), k - 1, parts)
        counted = asked.groupBy("part").applyInPandas(_add_up, "block string, part int, totals binary")
        counted = materialize(counted, f"counts-{k}")
        per_block = counted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "totals"))).alias(f"counts_{k}"))
        joined = joined.join(per_block, "block", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                out = _replay(row, order).scores(corpus_words)
                out.insert(0, "doc", pd.array(list(row["docs"]), dtype="Int64"))
                yield out

    levels = [f"order_{k}" for k in range(order + 1)]
    schema = "doc bigint, n_words bigint, log_score double, " + ", ".join(f"{c} bigint" for c in levels)
    scored = joined.mapInPandas(run, schema)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("doc").alias(id_col), "n_words", "log_score", mean.alias("mean_log_score"), *levels)
