"""SentencePiece ids of whole texts, with the bytes of the source that each piece stands for.

A text is normalised here, by longest prefixes in the model's compiled character map,
and every byte of the normalised text keeps the place in the source it came from. The
library then segments text that is already normal: it loads the model with its
normaliser switched off. Lengths of pieces, added up, give places in the normalised
text, and the kept places turn those into byte spans of the source.

Text without a space inside is segmented once per task and remembered, unless the model has pieces that
go on behind a space.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import SLICE_ROWS, char_slices

# --- fixed values of the model format ------------------------------------------------
SPACE = "▁"
FIELD_PIECE, FIELD_TRAINER, FIELD_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_TYPE = 1, 3
TYPE_NORMAL, TYPE_USER_DEFINED, TYPE_BYTE = 1, 4, 6
NORMALIZER_MAP, NORMALIZER_PREFIX, NORMALIZER_TRIM, NORMALIZER_ESCAPE = 2, 3, 4, 5
TRAINER_SUFFIX_SPACE = 24
#: A normaliser that changes nothing; read after the model's own, its fields take their place.
NO_NORMALIZER = bytes([FIELD_NORMALIZER << 3 | 2, 8, NORMALIZER_MAP << 3 | 2, 0, NORMALIZER_PREFIX << 3, 0, NORMALIZER_TRIM << 3, 0, NORMALIZER_ESCAPE << 3, 0])

_SPACE_BYTES = SPACE.encode()
#: Words remembered by a task, and an eighth of their ids.
_CACHE_WORDS = 200_000


# --- reading the model ----------------------------------------------------------------
def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; groups do not occur in models."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _number(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 keys, and the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4 if blob else 0).astype(np.int64)
        self.texts = blob[4 + size :]
        self.label = units & 0x800000FF
        self.offset = (units >> 10) << ((units & 0x200) >> 6)
        self.has_value = (units >> 8) & 1 == 1
        self.value = units & 0x7FFFFFFF

    def __bool__(self) -> bool:
        return len(self.label) > 0

    def replacement(self, value: int) -> bytes:
        return self.texts[value : self.texts.index(b"\0", value)]

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and value of the longest key at each of ``starts``; length 0 where there is none.

        All places go down the trie together, one byte a step; those that fall out are dropped.
        """
        length = np.zeros(len(starts), dtype=np.int64)
        value = np.zeros(len(starts), dtype=np.int64)
        alive = np.arange(len(starts))
        node = np.full(len(starts), self.offset[0])
        depth = 0
        while len(alive):
            inside = starts[alive] + depth < len(data)
            alive, node = alive[inside], node[inside]
            byte = data[starts[alive] + depth].astype(np.int64)
            node = node ^ byte
            known = node < len(self.label)
            known[known] = self.label[node[known]] == byte[known]
            alive, node = alive[known], node[known]
            depth += 1
            at = node ^ self.offset[node]
            ends = self.has_value[node]
            length[alive[ends]] = depth
            value[alive[ends]] = self.value[at[ends]]
            node = at
        return length, value


class Model:
    """What encoding needs of a model file. Models with user-defined symbols, with spaces as suffixes
    or without byte fallback are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        texts, kinds, flags, blob = [], [], {NORMALIZER_PREFIX: 1, NORMALIZER_TRIM: 1, NORMALIZER_ESCAPE: 1}, b""
        suffix_space = 0
        for number, value in _fields(data):
            if number == FIELD_PIECE:
                piece = dict(_fields(value))
                texts.append(piece[PIECE_TEXT])
                kinds.append(piece.get(PIECE_TYPE, TYPE_NORMAL))
            elif number == FIELD_NORMALIZER:
                spec = dict(_fields(value))
                blob = spec.pop(NORMALIZER_MAP, blob)
                flags |= {k: v for k, v in spec.items() if k in flags}
            elif number == FIELD_TRAINER:
                suffix_space = dict(_fields(value)).get(TRAINER_SUFFIX_SPACE, suffix_space)
        if TYPE_USER_DEFINED in kinds or suffix_space or kinds.count(TYPE_BYTE) != 256:
            raise ValueError("the model must have byte fallback, and neither user-defined symbols nor spaces as suffixes")
        self.chars = CharMap(blob)
        self.prefix, self.trim, self.escape = (bool(flags[k]) for k in (NORMALIZER_PREFIX, NORMALIZER_TRIM, NORMALIZER_ESCAPE))
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=data + NO_NORMALIZER)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int32)
        self.byte_of = np.full(len(texts), -1, dtype=np.int16)
        for i, (text, kind) in enumerate(zip(texts, kinds)):
            if kind == TYPE_BYTE:
                self.byte_of[i] = int(text[3:5], 16)
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        self.crosses = any(crossing.search(t.decode()) for t, kind in zip(texts, kinds) if kind == TYPE_NORMAL)

    # --- normalising -------------------------------------------------------------------
    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and the end, a byte of the source."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        first = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        sizes = np.diff(np.append(first, len(data)))
        if not self.chars or not len(first):
            return self._spaced(data, np.repeat(first, sizes), first, sizes, first, len(data))
        first, sizes, out_sizes, filled = self._mapped(data, first, sizes)
        # Chunks are what one step of normalising takes from the source: a key of the map or a character.
        ends = np.cumsum(out_sizes)
        begins = ends - out_sizes
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
        source = np.repeat(first, out_sizes)
        same = np.ones(len(first), dtype=bool)
        for chunks, replacement in filled:
            same[chunks] = False
            at = (begins[chunks][:, None] + np.arange(len(replacement))).ravel()
            out[at] = np.tile(np.frombuffer(replacement, dtype=np.uint8), len(chunks))
        plain = np.repeat(same, out_sizes)
        within = np.arange(len(out)) - np.repeat(begins, out_sizes)
        out[plain] = data[(source + within)[plain]]
        return self._spaced(out, source, begins, out_sizes, first, len(data))

    def _mapped(self, data, first, sizes):
        """Chunks of the text once the map is applied, and (chunks, replacement) of those it changes."""
        length, value = self.chars.longest(data, first)
        hits = np.flatnonzero(length)
        # A key that ends inside or before the next hit's place leaves it free; only longer keys are sorted out one by one.
        stop = np.searchsorted(first, first[hits] + length[hits])
        if np.any(stop[:-1] > hits[1:]):
            free, kept = 0, []
            for i, (hit, end) in enumerate(zip(hits.tolist(), stop.tolist())):
                if hit >= free:
                    kept.append(i)
                    free = end
            hits, stop = hits[kept], stop[kept]
        swallowed = np.zeros(len(first) + 1, dtype=np.int64)
        np.add.at(swallowed, hits + 1, 1)
        np.add.at(swallowed, stop, -1)
        stays = np.cumsum(swallowed)[: len(first)] == 0
        place = np.cumsum(stays) - 1
        out_sizes = sizes.copy()
        filled = []
        for v in np.unique(value[hits]):
            chosen = hits[value[hits] == v]
            replacement = self.chars.replacement(int(v))
            out_sizes[chosen] = len(replacement)
            filled.append((place[chosen], replacement))
        first = first[stays]
        return first, np.diff(np.append(first, len(data))), out_sizes[stays], filled

    def _spaced(self, out, source, begins, out_sizes, first, n):
        """Spaces trimmed, marked and put in front, as the model asks."""
        space = out == 0x20
        start = 0
        if self.trim:
            used = np.flatnonzero(out_sizes)
            last = space[begins[used] + out_sizes[used] - 1]
            after_space = np.append(True, last[:-1])
            chunk = np.repeat(np.arange(len(used)), out_sizes[used])
            # Spaces in front of a chunk: no other byte of the chunk before or at them.
            others = np.cumsum(~space)
            leading = others - np.repeat(np.append(0, others)[begins[used]], out_sizes[used]) == 0
            keep = ~(leading & after_space[chunk])
            lone = space[np.minimum(begins, len(out) - 1)] & (out_sizes == 1) if len(out) else out_sizes < 0
            other = np.flatnonzero(~lone)
            if not len(other):
                return b"", np.array([n])
            start = int(first[other[0]])
            out, source, space = out[keep], source[keep], space[keep]
        elif not n:
            return b"", np.array([0])
        mark = np.frombuffer(_SPACE_BYTES if self.escape else b" ", dtype=np.uint8)
        width = np.where(space, len(mark), 1)
        marked = np.repeat(out, width)
        blank = np.flatnonzero(space)
        begin = blank + (len(mark) - 1) * np.arange(len(blank))
        for i, byte in enumerate(mark):
            marked[begin + i] = byte
        places = np.append(np.repeat(source, width), n)
        data = marked.tobytes()
        if self.prefix:
            data = mark.tobytes() + data
            places = np.concatenate((np.full(len(mark), start), places))
        if self.trim:
            while data.endswith(mark.tobytes()):
                data = data[: -len(mark)]
                places = places[: len(data) + 1]
        return data, places

    # --- segmenting --------------------------------------------------------------------
    def spans(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans in the source. Of a character in byte pieces, the last has the span, the others are empty before it."""
        byte = self.byte_of[ids]
        size = self.lengths[ids]
        if (byte >= 0).any():
            index = np.arange(len(ids))
            goes_on = (byte & 0xC0) == 0x80
            goes_on &= byte >= 0
            lead = np.maximum.accumulate(np.where(goes_on, 0, index))
            last = np.append(~goes_on[1:], True)
            size = np.where(byte < 0, size, np.where(last, index - lead + 1, 0))
        bounds = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum(size, out=bounds[1:])
        places = places[bounds]
        return places[:-1], np.where(size > 0, places[1:], places[:-1])


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _cut(text: str) -> list[str]:
    """The words of a normalised text, for ``_uncut``: what follows a space stands for both, all else has a mark in front."""
    if text.startswith(SPACE) and SPACE + SPACE not in text:
        return text.split(SPACE)[1:]
    return [w[1:] if w[0] == SPACE and w[1:2] != SPACE else SPACE + w for w in _WORD.findall(text)]


def _uncut(word: str) -> str:
    return word[1:] if word.startswith(SPACE) else SPACE + word


class _Words(dict):
    """Numbers of words, in the order in which they were first asked for."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """A model with the words that a task has met."""

    def __init__(self, path: str):
        self.model = Model(path)
        self._forget()

    def _forget(self) -> None:
        self.words = _Words()
        self.flat = np.empty(0, dtype=np.int32)
        self.stops = np.zeros(1, dtype=np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts."""
        if len(self.words) > _CACHE_WORDS or len(self.flat) > 8 * _CACHE_WORDS:
            self._forget()
        number = self.words.__getitem__
        cut = [[SPACE + t] for t in texts] if self.model.crosses else map(_cut, texts)
        numbers = [np.fromiter(map(number, words), dtype=np.int64, count=len(words)) for words in cut]
        if self.words.fresh:
            coded = self.model.plain.encode(list(map(_uncut, self.words.fresh)), num_threads=1)
            stops = np.cumsum([len(x) for x in coded]) + len(self.flat)
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(coded), dtype=np.int32)))
            self.stops = np.concatenate((self.stops, stops))
            self.words.fresh = []
        return [self._joined(x) for x in numbers]

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        start, stop = self.stops[numbers], self.stops[numbers + 1]
        size = stop - start
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(start - (ends - size), size)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) of each text."""
        normal = [self.model.normalize(t) for t in texts]
        ids = self.ids([data.decode("utf-8", "surrogatepass") for data, _ in normal])
        return [(x, *self.model.spans(x, places)) for x, (_, places) in zip(ids, normal)]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends): a document's piece ids, and for each piece the bytes ``[begin, end)`` of its text in UTF-8.

    Ids are those of the library without begin or end ids. Null and empty texts have empty arrays.
    Rows that repeat an id or have none are each encoded. A character that is spelt in byte
    pieces belongs to the last of them. Other columns are ignored. ``model_path`` is read on every worker.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model_path)
        for frame in char_slices(frames, "text"):
            coded = encoder.encode([t if isinstance(t, str) else "" for t in frame["text"]])
            ids, begins, ends = ([x.astype(np.int32, copy=False) for x in column] for column in zip(*coded))
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "ids": ids, "begins": begins, "ends": ends})

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInPandas(run, "doc_id bigint, ids array<int>, begins array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text): the library's text for the ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for frame in frames:
            for at in range(0, len(frame), SLICE_ROWS):
                part = frame.iloc[at : at + SLICE_ROWS]
                texts = model.decode([ids.tolist() for ids in part["ids"]], num_threads=1)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": part["ids"].to_numpy(), "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, ids array<int>, text string")


def digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered) of ``encode_documents``: digests of the ids and of the text
    that they decode to, and the bytes of the source that the pieces' spans cover."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = np.array([str(i) for i in range(model.get_piece_size())], dtype=object)
        for frame in frames:
            for at in range(0, len(frame), SLICE_ROWS):
                part = frame.iloc[at : at + SLICE_ROWS]
                texts = model.decode([ids.tolist() for ids in part["ids"]], num_threads=1)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "n_tokens": [len(ids) for ids in part["ids"]],
                        "ids_sha256": [hashlib.sha256(",".join(names[ids]).encode()).hexdigest() for ids in part["ids"]],
                        "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
                        "n_covered": [int((e - b).sum()) for b, e in zip(part["begins"], part["ends"])],
                    }
                )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_covered bigint"
    return encoded.mapInPandas(run, schema)
