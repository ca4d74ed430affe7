"""Documents drawn so that their hashed n-gram features look like those of target texts.

Features are words and pairs of neighbouring words, hashed into a fixed number of
buckets. For the counts, newlines cut texts into lines: equal lines of the corpus meet first, the
features of each distinct line are counted once and multiplied by its
occurrences, and pairs that go over a line's end are added from the documents. A long line
is cut further, into segments, so memory does not depend on the length of a text.

A draw without replacement is the top of weight plus Gumbel noise, and the noise comes from a
hash of the id, so it does not depend on partitions.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.arrays import SHARE, fold, share
from barloom.llm.words import char_slices
from barloom.session import materialize

BUCKETS = 10_000
#: A longer line is cut behind this many bytes.
SEGMENT_BYTES = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# --- check sums ---------------------------------------------------------------------
#: Words up to this many bytes have their check sums from tables.
_TABLE_BYTES = 64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check sums are affine over bits: the part of a byte so far from the end, the constant of a length, and
    what becomes of a check sum when so many bytes follow."""
    n = _TABLE_BYTES
    constant = [zlib.crc32(bytes(d)) for d in range(n + 1)]
    byte = [[zlib.crc32(bytes([b]) + bytes(d)) ^ constant[d + 1] for b in range(256)] for d in range(n)]
    moved = [[[zlib.crc32(bytes(d), b << 8 * k) ^ constant[d] for b in range(256)] for k in range(4)] for d in range(n + 1)]
    return np.array(byte, dtype=np.uint32), np.array(constant, dtype=np.uint32), np.array(moved, dtype=np.uint32)


_BYTE, _CONSTANT, _MOVED = _tables()
_SPACE_SUM = np.uint32(zlib.crc32(b" "))


def word_sums(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The crc32 of each word."""
    out = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero(sizes <= _TABLE_BYTES)
    if len(short):
        size = sizes[short]
        stop = np.cumsum(size)
        within = np.arange(stop[-1]) - np.repeat(stop - size, size)
        parts = _BYTE[np.repeat(size, size) - 1 - within, buffer[np.repeat(starts[short], size) + within]]
        out[short] = np.bitwise_xor.reduceat(parts, stop - size) ^ _CONSTANT[size]
    for i in np.flatnonzero(sizes > _TABLE_BYTES):
        out[i] = zlib.crc32(buffer[starts[i] : starts[i] + sizes[i]])
    return out


def _followed(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (
        _MOVED[sizes, 0, sums & 255]
        ^ _MOVED[sizes, 1, (sums >> np.uint32(8)) & 255]
        ^ _MOVED[sizes, 2, (sums >> np.uint32(16)) & 255]
        ^ _MOVED[sizes, 3, sums >> np.uint32(24)]
    )


def pair_sums(first: np.ndarray, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The crc32 of a word with check sum ``first``, a space, and the word at ``starts`` with check sum ``second``."""
    spaced = _followed(first, np.ones(len(first), dtype=np.int64)) ^ _SPACE_SUM
    out = _followed(spaced, np.minimum(sizes, _TABLE_BYTES)) ^ second
    for i in np.flatnonzero(sizes > _TABLE_BYTES):
        out[i] = zlib.crc32(buffer[starts[i] : starts[i] + sizes[i]], int(spaced[i]))
    return out


# --- segments -------------------------------------------------------------------------
def _cut(data: bytes) -> tuple[list[bytes], list[int]]:
    """Segments of a text and the number of the line each belongs to."""
    lines = data.split(b"\n")
    if len(data) <= SEGMENT_BYTES:
        return lines, list(range(len(lines)))
    segments, numbers = [], []
    for number, line in enumerate(lines):
        at = 0
        while at < len(line) or at == 0:
            end = min(at + SEGMENT_BYTES, len(line))
            while end < len(line) and _IN_WORD[line[end]]:
                end += 1
            segments.append(line[at:end])
            numbers.append(number)
            at = end or 1
    return segments, numbers


class Segments:
    """Texts as sequences of distinct segments, whose words are found and hashed once."""

    def __init__(self, texts: list[str | None], buckets: int):
        self.buckets, self.n_texts = buckets, len(texts)
        known: dict[bytes, int] = {}
        owner, line, chosen = [], [], []
        for i, text in enumerate(texts):
            segments, numbers = _cut(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"")
            owner += [i] * len(segments)
            line += numbers
            chosen += [known.setdefault(s, len(known)) for s in segments]
        self.buffer = _LOWER[np.frombuffer(b"\n".join(known), dtype=np.uint8)]
        inside = _IN_WORD[self.buffer]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.starts, self.sizes = edge[::2], edge[1::2] - edge[::2]
        offsets = np.cumsum([0, *(len(s) + 1 for s in known)])[:-1]
        self.segment = np.searchsorted(offsets, self.starts, side="right") - 1
        self.n = len(known)
        #: The words of segment i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.segment, np.arange(self.n + 1))
        chosen, owner, line = np.array(chosen, dtype=np.int64), np.array(owner, dtype=np.int64), np.array(line, dtype=np.int64)
        used = self.first[chosen + 1] > self.first[chosen]
        self.chosen, self.owner, self.line = chosen[used], owner[used], line[used]

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        """(segment, bucket) of the features within distinct segments."""
        sums = word_sums(self.buffer, self.starts, self.sizes)
        second = np.flatnonzero(self.segment[1:] == self.segment[:-1]) + 1
        pairs = pair_sums(sums[second - 1], self.buffer, self.starts[second], self.sizes[second], sums[second])
        return np.concatenate((self.segment, self.segment[second])), np.concatenate((sums, pairs)) % np.uint32(self.buckets)

    def between(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, whether a line ends in between, bucket) of the pairs that go from one segment to the next."""
        here = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        last, start = self.first[self.chosen[here] + 1] - 1, self.first[self.chosen[here + 1]]
        sums = [word_sums(self.buffer, self.starts[x], self.sizes[x]) for x in (last, start)]
        pairs = pair_sums(sums[0], self.buffer, self.starts[start], self.sizes[start], sums[1])
        return self.owner[here], self.line[here + 1] > self.line[here], pairs % np.uint32(self.buckets)

    def words(self) -> np.ndarray:
        """Words of each text."""
        sizes = (self.first[self.chosen + 1] - self.first[self.chosen]).astype(np.float64)
        return np.bincount(self.owner, sizes, minlength=self.n_texts).astype(np.int64)


# --- counts ---------------------------------------------------------------------------
def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def lines_run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for frame in char_slices(frames, "line"):
            segments = Segments(list(frame["line"]), buckets)
            times = frame["n"].to_numpy()
            each = np.bincount(segments.chosen, times[segments.owner], minlength=segments.n)
            owner, bucket = segments.inside()
            total += np.bincount(bucket, each[owner], minlength=buckets).astype(np.int64)
            text, _, bucket = segments.between()
            total += np.bincount(bucket, times[text], minlength=buckets).astype(np.int64)
        yield share(total)

    def ends_run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for frame in char_slices(frames, "text"):
            _, ends_line, bucket = Segments(list(frame["text"]), buckets).between()
            total += np.bincount(bucket[ends_line], minlength=buckets)
        yield share(total)

    named = texts.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    lines = named.select(F.explode(F.split("text", "\n")).alias("line")).where("line != ''")
    distinct = lines.groupBy("line").agg(F.count("*").alias("n"))
    shares = distinct.mapInPandas(lines_run, SHARE).unionByName(named.mapInPandas(ends_run, SHARE))
    return fold(shares, np.int64, buckets)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of target to corpus share, one added to every bucket."""
    n = len(corpus)
    ours, theirs = float(int(corpus.sum()) + n), float(int(target.sum()) + n)
    ratios = ((t + 1.0) * ours / ((s + 1.0) * theirs) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def noise(seed: int, doc: int | None) -> int:
    """Floored thousandths of standard Gumbel noise from a hash of the id; rows without an id share one value."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(
    docs: DataFrame, gains: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): the floored mean gain of a document's features, and with the noise added."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gains)
    buckets = len(gains)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = shared.value
        for frame in char_slices(frames, "text"):
            segments = Segments(list(frame["text"]), buckets)
            owner, bucket = segments.inside()
            features = np.bincount(owner, minlength=segments.n)
            sums = np.bincount(owner, gain[bucket], minlength=segments.n)
            text, _, crossing = segments.between()
            n = len(frame)
            n_features = np.bincount(segments.owner, features[segments.chosen], minlength=n) + np.bincount(text, minlength=n)
            total = np.bincount(segments.owner, sums[segments.chosen], minlength=n) + np.bincount(text, gain[crossing], minlength=n)
            n_features, total = n_features.astype(np.int64), total.astype(np.int64)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            doc = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
            drawn = weight + np.array([noise(seed, d) for d in doc], dtype=np.int64)
            columns = {"n_words": segments.words(), "n_features": n_features, "weight": weight, "score": drawn}
            yield pd.DataFrame({"doc_id": pd.array(doc, dtype="Int64"), **columns})

    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInPandas(run, schema)


# --- drawing --------------------------------------------------------------------------
def number_rows(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in the whole order. Range partitions are sorted and numbered apart and
    stored; only one count per partition meets in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    stored = materialize(local, "numbered")
    part = F.shiftrightunsigned("_row", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start")), "starts")
    place = F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1) + 1
    return stored.join(starts, part == F.col("_part")).withColumn(name, place).drop("_row", "_part", "_start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    buckets: int = BUCKETS,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    Words are runs of digits, ASCII letters with A-Z lowered, and characters beyond ASCII. Of the rows with at least ``min_words`` words,
    ``percent`` in a hundred, rounded down, are drawn and ranked by score; other ranks are NULL. Ties go to the smaller
    id, then to more features; rows without an id come last among equals, and all of them share one noise value. Null and empty
    texts have no features and weight 0. Rows that repeat an id are each scored, with the same noise. An empty target is one
    without features; empty tables give no rows. Other columns are ignored.
    """
    gains = bucket_gains(feature_counts(docs, text_col, buckets), feature_counts(target, target_text_col, buckets))
    scored = score_documents(docs, gains, seed, id_col, text_col).withColumn("_out", F.col("n_words") < min_words)
    order = (F.col("_out").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc())
    placed = number_rows(scored, *order)
    drawn = placed.where("not _out").count() * percent // 100
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
