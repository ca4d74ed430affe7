"""Words and word shingles of whole texts as 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered, so the
UTF-8 bytes of a text can be cut without decoding. Everything runs on numpy
arrays over pieces of a quarter of a megabyte; the memory does not depend on the length
of a text. Two different words share a hash with probability 2**-64.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n odd multipliers made from a counter."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(salt)) | np.uint64(1)


_BYTE_VALUE = seeds(256, 7)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Byte classes whose runs are words: all that is not space, or letters and digits apart from symbols.
WORDS = np.where(_IS_SPACE, 0, 1).astype(np.int8)
WORDS_AND_SYMBOLS = WORDS.copy()
WORDS_AND_SYMBOLS[[i for i in range(128) if WORDS[i] and not chr(i).isalnum()]] = 2
_LOWERED = {i: i + 32 for i in range(65, 91)}
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        step = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        step[0] = 1
        _powers[base] = np.cumprod(step)
    return _powers[base]


def _bounds(buffer: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = classes[buffer]
    edge = np.concatenate(([True], kind[1:] != kind[:-1], [True]))
    inside = kind != 0
    return np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside) + 1


def _hash_piece(buffer: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the runs of one class."""
    if not len(buffer):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    starts, ends = _bounds(buffer, classes)
    values = _BYTE_VALUE[buffer] * _power(_BASE, len(buffer))[: len(buffer)]
    total = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    raw = (total[ends] - total[starts]) * _power(_BASE_INVERSE, len(buffer))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_BASE)), starts


def _pieces(data: bytes):
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        yield np.frombuffer(data, dtype=np.uint8, count=min(end, len(data)) - at, offset=at)
        at = end


def word_hashes(text: str | None, classes: np.ndarray = WORDS) -> np.ndarray:
    """The hash of every word of a text, in order; none for an empty or null text."""
    if not isinstance(text, str) or not text:
        return np.empty(0, dtype=np.uint64)
    parts = [_hash_piece(p, classes)[0] for p in _pieces(text.encode("utf-8", "surrogatepass"))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def batch_word_hashes(texts, classes: np.ndarray = WORDS) -> list[np.ndarray]:
    """``word_hashes`` of many texts; short texts share one pass over their joined bytes."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush():
        nonlocal size
        if not held:
            return
        hashes, starts = _hash_piece(np.frombuffer(b" ".join(held), dtype=np.uint8), classes)
        cuts = np.cumsum([len(h) + 1 for h in held])[:-1]
        out.extend(np.split(hashes, np.searchsorted(starts, cuts)))
        held.clear()
        size = 0

    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if len(data) > PIECE // 2:
            flush()
            out.append(word_hashes(text, classes))
            continue
        if size + len(data) > PIECE:
            flush()
        held.append(data)
        size += len(data) + 1
    flush()
    return out


class Runs:
    """The runs of one class of many texts, in order: hash, class and text of each, and their bytes.

    Long texts go through in pieces that end at white space.
    """

    def __init__(self, texts, classes: np.ndarray):
        self.classes = classes
        self._buffers: list[np.ndarray] = []
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, owners, size = [], [], 0
        for owner, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            for piece in _pieces(data):
                if size + len(piece) > 2 * PIECE:
                    self._hash(held, owners)
                    held, owners, size = [], [], 0
                held.append(piece)
                owners.append(owner)
                size += len(piece) + 1
        self._hash(held, owners)
        hashes, starts, owner = (np.concatenate(x) for x in zip(*self._parts))
        self.hashes, self.owner, self._starts = hashes, owner, starts
        self._first = np.cumsum([0, *(len(p[0]) for p in self._parts)])
        kinds = [classes[b[p[1]]] for b, p in zip(self._buffers, self._parts)]
        self.kinds = np.concatenate(kinds)

    def _hash(self, held, owners):
        space = np.full(1, 0x20, dtype=np.uint8)
        buffer = np.concatenate([x for piece in held for x in (piece, space)] or [space])
        hashes, starts = _hash_piece(buffer, self.classes)
        offsets = np.cumsum([0, *(len(p) + 1 for p in held)])[:-1]
        owner = np.array(owners, dtype=np.int64)[np.searchsorted(offsets, starts, side="right") - 1] if held else starts
        self._buffers.append(buffer)
        self._parts.append((hashes, starts, owner))

    def text(self, i: int) -> str:
        """The bytes of run i with A-Z lowered."""
        part = int(np.searchsorted(self._first, i, side="right")) - 1
        buffer, start = self._buffers[part], self._starts[i]
        end, step = start, 64
        while True:
            other = np.flatnonzero(self.classes[buffer[end : end + step]] != self.kinds[i])
            if len(other) or end + step >= len(buffer):
                end = end + other[0] if len(other) else len(buffer)
                break
            end, step = end + step, step * 2
        return buffer[start:end].tobytes().decode("utf-8", "replace").translate(_LOWERED)


def text_slices(frames, rows: int = 1000):
    """Arrow batches in smaller steps, so that hashes of few texts are held at once."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


#: Most rows and characters of one step.
SLICE_ROWS = 500
SLICE_CHARS = 1 << 20


def char_slices(frames, text_col: str):
    """Arrow batches in steps of about a million characters; a longer text comes with few others."""
    for frame in frames:
        sizes = frame[text_col].str.len().fillna(0).to_numpy(dtype=np.int64)
        step = np.maximum(np.cumsum(sizes) // SLICE_CHARS, np.arange(len(frame)) // SLICE_ROWS)
        cuts = (np.flatnonzero(np.diff(step)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(frame)]):
            if b > a:
                yield frame.iloc[a:b]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    k = min(width, len(words))
    factors = seeds(k, 1000 + k)
    n = len(words) - k + 1
    total = words[:n] * factors[0]
    for i in range(1, k):
        total = mix(total) + words[i : i + n] * factors[i]
    return mix(total)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingles(words, width))
