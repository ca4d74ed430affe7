"""Token ids of documents in compressed binary segments.

Each document's ids become one zstandard frame, compressed with a dictionary that all
documents share, so a short document costs little and can be read alone. Frames lie
in document order in segments of a few megabytes. A segment's index has each
document's byte range and token counts; the dictionary stands beside the segments
under its SHA-256, and every segment names the hash it needs.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.sampling import hash_sample
from barloom.llm.words import mix, seeds
from barloom.session import materialize

# --- fixed values ------------------------------------------------------------------
END_ID = 2
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0)

SEGMENT_BYTES = 4 << 20
SEGMENT_DOCS = 1 << 16
#: Documents from which the dictionary is trained, and the longest text among them.
DICTIONARY_DOCS = 1000
DICTIONARY_TEXT_CHARS = 1 << 16
DICTIONARY_BYTES = 1 << 16
LEVEL = 3


# --- encoding ------------------------------------------------------------------------
_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = range(5)
_KNOWN_CODES = 0x250
_CHUNK_CHARS = 1 << 19
_CACHE_WORDS = 1_000_000
_RECENT_WORDS = 100_000


def _code_classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = [kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_KNOWN_CODES)]
    table = np.array(table, dtype=np.int8)
    table[list(WHITE_SPACE)] = _SPACE
    return np.append(table, np.int8(_BREAK))


_CLASSES = _code_classes()
_CODE_VALUES = seeds(_KNOWN_CODES + 1, 77)
_BASE = 0xD1342543DE82EF95
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(_CHUNK_CHARS + 2, _BASE, dtype=np.uint64)))
_INVERSES = np.cumprod(np.append(np.uint64(1), np.full(_CHUNK_CHARS + 2, pow(_BASE, -1, 1 << 64), dtype=np.uint64)))


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Where the byte-level tokenizer's words begin, in code points below U+0250.

    ``_KNOWN_CODES`` stands between texts. A word is a run of letters, of digits or of other
    characters with the one space before it, a contraction, or white space; of
    a run of white space the last character is cut off if more text follows.
    """
    kind = _CLASSES[codes]
    start = np.empty(len(kind), dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = np.flatnonzero(start)
    after = np.append(first[1:], len(kind))
    inner = (kind[first] == _SPACE) & (after < len(kind))
    inner[inner] = kind[after[inner]] != _BREAK
    last = after[inner] - 1
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False

    quote = first[(kind[first] == _OTHER) & (after - first == 1)]
    quote = quote[(codes[quote] == ord("'")) & start[quote] & (quote + 2 < len(codes))]
    for ending in CONTRACTIONS:
        tail = [ord(c) for c in ending[1:]]
        hit = quote[codes[quote + 1] == tail[0]]
        if len(tail) == 2:
            hit = hit[codes[hit + 2] == tail[1]]
        start[hit + 1] = False
        rest = hit + 1 + len(tail)
        start[rest[kind[rest] == _LETTER]] = True
    return np.flatnonzero(start & (kind != _BREAK))


def _is_plain(text: str) -> bool:
    return text.isascii() or np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).max() < _KNOWN_CODES


class WordCache:
    """Encodes texts word by word, calling the tokenizer once per new word.

    The tokenizer cuts a text into words first and merges within words only, so
    equal words have equal ids. Texts with code points from U+0250 on, or with the string of a special token, go to the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.single = Tokenizer.from_file(tokenizer_path)
        self.single.encode_special_tokens = True  # words have no special tokens in them
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.by_words = isinstance(self.whole.pre_tokenizer, pre_tokenizers.ByteLevel) and self.whole.normalizer is None
        if self.by_words:
            self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.recent: dict[int, int] = {}
        self.words = 0
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.offsets = np.zeros(1 << 16, dtype=np.int64)

    def _append(self, ids: np.ndarray, counts: np.ndarray) -> None:
        ends = self.offsets[self.words] + np.cumsum(counts)
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while len(self.offsets) <= self.words + len(counts):
            self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
        self.ids[ends[-1] - len(ids) : ends[-1]] = ids
        self.offsets[self.words + 1 : self.words + 1 + len(counts)] = ends
        self.words += len(counts)

    def _settle(self) -> None:
        """Moves recent words into the sorted arrays."""
        count = len(self.recent)
        hashes = np.concatenate((self.hashes, np.fromiter(self.recent, dtype=np.uint64, count=count)))
        at = np.concatenate((self.at, np.fromiter(self.recent.values(), dtype=np.int64, count=count)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.recent = hashes[order], at[order], {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            by_words = self.by_words and len(text) <= _CHUNK_CHARS and _is_plain(text)
            if not by_words or any(s in text for s in self.special):
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                continue
            if size + len(text) > _CHUNK_CHARS:
                self._encode_chunk(texts, held, out)
                held, size = [], 0
            held.append(i)
            size += len(text) + 1
        self._encode_chunk(texts, held, out)
        return out

    def _encode_chunk(self, texts: list[str], held: list[int], out: list) -> None:
        if not held:
            return
        mark = chr(_KNOWN_CODES)
        joined = mark.join(texts[i] for i in held) + mark
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        starts = word_starts(codes)
        breaks = np.flatnonzero(codes == _KNOWN_CODES)
        if not len(starts):
            out_counts = np.zeros(len(held), dtype=np.int64)
            ids = np.empty(0, dtype=np.uint32)
        else:
            following = np.append(starts[1:], len(codes))
            at = np.searchsorted(breaks, starts)
            ends = np.minimum(following, breaks[at])
            total = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum(_CODE_VALUES[codes] * _POWERS[: len(codes)], out=total[1:])
            raw = (total[ends] - total[starts]) * _INVERSES[starts]
            hashes = mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
            distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            places = self._places(distinct, np.stack((starts[where], ends[where]), axis=1).tolist(), joined)[inverse]
            begin, length = self.offsets[places], self.offsets[places + 1] - self.offsets[places]
            upto = np.cumsum(length)
            ids = self.ids[np.repeat(begin - upto + length, length) + np.arange(upto[-1])]
            out_counts = np.bincount(at, weights=length, minlength=len(held)).astype(np.int64)
        for i, part in zip(held, np.split(ids, np.cumsum(out_counts)[:-1])):
            out[i] = part

    def _places(self, hashes: np.ndarray, spans: list, joined: str) -> np.ndarray:
        if self.words > _CACHE_WORDS:
            self.forget()
        if len(self.recent) > _RECENT_WORDS:
            self._settle()
        places = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            held = self.hashes[at] == hashes
            places[held] = self.at[at[held]]
        open_ = np.flatnonzero(places < 0)
        places[open_] = [self.recent.get(h, -1) for h in hashes[open_].tolist()]
        new = np.flatnonzero(places < 0)
        if len(new):
            words = [joined[spans[i][0] : spans[i][1]] for i in new.tolist()]
            found = [e.ids for e in self.single.encode_batch_fast(words, add_special_tokens=False)]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum()))
            places[new] = np.arange(self.words, self.words + len(new))
            self.recent.update(zip(hashes[new].tolist(), places[new].tolist()))
            self._append(flat, counts)
        return places


_caches: dict[str, WordCache] = {}


def _word_cache(tokenizer_path: str) -> WordCache:
    """One per Python worker: tasks that follow each other share it."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if tokenizer_path not in _caches:
        _caches[tokenizer_path] = WordCache(tokenizer_path)
    return _caches[tokenizer_path]


def _texts(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


# --- the shared dictionary -----------------------------------------------------------
def _fit_dictionary(samples: list[bytes]) -> bytes:
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own bytes serve
        return b"".join(samples)[:DICTIONARY_BYTES]


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[int, bytes]:
    """Bytes of an id, and a dictionary from up to ``DICTIONARY_DOCS`` documents chosen by a hash of their ids.

    One task trains it, so the driver does not load the tokenizer.
    """
    chosen = hash_sample(docs, DICTIONARY_DOCS, "doc")
    fitting = F.length("text").between(1, DICTIONARY_TEXT_CHARS)
    rows = chosen.where(fitting).orderBy("doc", "text").limit(DICTIONARY_DOCS).select("text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _word_cache(tokenizer_path)
        width = 2 if cache.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        texts = [t for frame in frames for t in frame["text"]]
        samples = [np.append(ids, end_id).astype(f"<u{width}").tobytes() for ids in cache.encode(texts)]
        yield pd.DataFrame({"width": [width], "dictionary": [_fit_dictionary(samples)]})

    trained = rows.coalesce(1).mapInPandas(run, "width int, dictionary binary").first()
    return trained.width, bytes(trained.dictionary)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


# --- writing ---------------------------------------------------------------------------
def write_segments(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> None:
    """Encode whole texts and write them in ascending id order under ``path``.

    ``end_id`` follows every document. Null and empty texts have the end id only; rows
    without an id come first; rows that repeat an id are each written, ordered by
    their content. Strings of special tokens in a text become their ids, as the library has it. An empty table writes no
    segment. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    width, data = train_dictionary(texts, tokenizer_path, end_id)
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(digest, bytearray(data))], "sha256 string, dictionary binary").write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(data)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _word_cache(tokenizer_path)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                ids = [np.append(x, end_id).astype(f"<u{width}") for x in cache.encode(_texts(part["text"]))]
                yield pd.DataFrame(
                    {
                        "doc": part["doc"].to_numpy(),
                        "n": [len(x) for x in ids],
                        "frame": [packer.compress(x.tobytes()) for x in ids],
                    }
                )
        cache.forget()  # the worker lives on and may do other work next

    frames = materialize(texts.mapInPandas(encode, "doc bigint, n bigint, frame binary"), "token-frames")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        frames.repartitionByRange(parts, F.col("doc").asc_nulls_first())
        .sortWithinPartitions(F.col("doc").asc_nulls_first(), "n", "frame")
        .select(F.spark_partition_id().alias("part"), "doc", "n", "frame")
    )
    schema = (
        "part int, segment int, first_doc bigint, last_doc bigint, n_tokens bigint, dictionary_sha256 string, id_bytes int, "
        "docs array<struct<doc:bigint,start:bigint,n:bigint,offset:bigint,bytes:bigint>>, payload binary"
    )
    ordered.mapInPandas(_segments(digest, width), schema).write.parquet(f"{path}/segments")


def _segments(digest: str, width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, payload, size, tokens, segment, part = [], [], 0, 0, 0, 0

        def flush() -> pd.DataFrame:
            named = [d["doc"] for d in docs if d["doc"] is not None] or [None]
            row = (part, segment, named[0], named[-1], tokens, digest, width, list(docs), b"".join(payload))
            names = ["part", "segment", "first_doc", "last_doc", "n_tokens", "dictionary_sha256", "id_bytes", "docs", "payload"]
            return pd.DataFrame([row], columns=names)

        for frame in frames:
            for part, doc, n, data in zip(frame["part"], frame["doc"], frame["n"], frame["frame"]):
                doc = None if pd.isna(doc) else int(doc)
                docs.append({"doc": doc, "start": tokens, "n": int(n), "offset": size, "bytes": len(data)})
                payload.append(data)
                size, tokens = size + len(data), tokens + int(n)
                if size >= SEGMENT_BYTES or len(docs) >= SEGMENT_DOCS:
                    yield flush()
                    docs, payload, size, tokens, segment = [], [], 0, 0, segment + 1
        if docs:
            yield flush()

    return run


# --- reading ---------------------------------------------------------------------------
def read_dictionary(spark: SparkSession, path: str) -> dict[str, bytes]:
    """The dictionary under its hash; an error if its bytes do not have that hash."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.sha256:
        raise ValueError("the token dictionary is damaged")
    return {row.sha256: data}


def segment_starts(heads: DataFrame) -> DataFrame:
    """(part, segment, base): the ids of all documents before each segment.

    Sums run within a part first; only the parts' totals meet in one task.
    """
    sums = heads.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    local = heads.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("local"))
    return local.join(before, "part").select("part", "segment", (F.col("before") + F.col("local")).alias("base"))


def read_frames(spark: SparkSession, path: str, docs: list[int] | None = None) -> DataFrame:
    """(part, segment, doc, start, n, frame, id_bytes, dictionary_sha256); of the given documents only, if any are given."""
    segments = spark.read.parquet(f"{path}/segments")
    if docs is not None:
        segments = segments.where((F.col("first_doc") <= max(docs)) & (F.col("last_doc") >= min(docs)))
    rows = segments.select("part", "segment", "id_bytes", "dictionary_sha256", "payload", F.explode("docs").alias("d"))
    if docs is not None:
        rows = rows.where(F.col("d.doc").isin(docs))
    frame = F.substring("payload", (F.col("d.offset") + 1).cast("int"), F.col("d.bytes").cast("int"))
    return rows.select(
        "part", "segment", "d.doc", F.col("d.start").alias("start_in_segment"), "d.n", frame.alias("frame"), "id_bytes", "dictionary_sha256"
    )


def _unpack(frame: pd.DataFrame, dictionaries: dict[str, bytes]) -> list[np.ndarray]:
    out, readers = [], {}
    for data, width, digest in zip(frame["frame"], frame["id_bytes"], frame["dictionary_sha256"]):
        if digest not in readers:
            readers[digest] = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionaries[digest]))
        out.append(np.frombuffer(readers[digest].decompress(data), dtype=f"<u{width}"))
    return out


def read_ids(spark: SparkSession, path: str, docs: list[int] | None = None) -> DataFrame:
    """(doc, ids) of all or the given documents."""
    shared = spark.sparkContext.broadcast(read_dictionary(spark, path))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [x.astype(np.int64) for x in _unpack(frame, shared.value)]
            yield pd.DataFrame({"doc": frame["doc"], "ids": ids})

    return read_frames(spark, path, docs).mapInPandas(run, "doc bigint, ids array<bigint>")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document, from its decompressed ids."""
    shared = spark.sparkContext.broadcast(read_dictionary(spark, path))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = _unpack(frame, shared.value)
            yield pd.DataFrame(
                {
                    "part": frame["part"],
                    "segment": frame["segment"],
                    "doc": frame["doc"],
                    "local": frame["start_in_segment"],
                    "n_tokens": [len(x) for x in ids],
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                }
            )

    schema = "part int, segment int, doc bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
    read = read_frames(spark, path).mapInPandas(run, schema)
    heads = spark.read.parquet(f"{path}/segments").select("part", "segment", "n_tokens")
    starts = segment_starts(heads)
    return read.join(starts, ["part", "segment"]).select(
        "doc", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
