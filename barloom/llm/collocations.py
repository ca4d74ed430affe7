"""Phrases whose words follow each other more often than their parts would by chance.

Level by level, candidates of k words are counted by a double-array trie: every task has
the trie, moves the states of all text positions forward together and counts
the accepting ones; the counts of all tasks are added. A candidate of the next length is a pair of
neighbouring accepted positions, so both its parts of k words are frequent, and no
frequent phrase is missed. A level with many candidates is counted by several tries of bounded size, in
one pass over the texts each. Words are told by 64-bit hashes, into which their language goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tries import Trie
from barloom.llm.words import Runs, char_slices, mix
from barloom.session import materialize

#: Candidates of one trie.
TRIE_PHRASES = 1 << 18
#: Distinct keys that a task adds up before it sends them.
HELD_KEYS = 1 << 20
UNKNOWN = "und"

# --- fixed values ----------------------------------------------------------------------
BETWEEN_WORDS = (0x20, 0x09)
BETWEEN_PIECES = (*b".,;:!?", *range(0x0A, 0x0E))
_WORD, _CUT = 1, 2
_CLASSES = np.full(256, _WORD, dtype=np.int8)
_CLASSES[list(BETWEEN_WORDS)] = 0
_CLASSES[list(BETWEEN_PIECES)] = _CUT


class _Keys:
    """Word keys of texts in several languages; a cut has the key 0."""

    def __init__(self):
        self.salts: dict[str, np.uint64] = {}

    def salt(self, lang: str) -> np.uint64:
        if lang not in self.salts:
            self.salts[lang] = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        return self.salts[lang]

    def of(self, frame: pd.DataFrame) -> tuple[Runs, np.ndarray]:
        """Runs of words and cuts, and their keys; a cut stands between texts too."""
        runs = Runs(frame["text"], _CLASSES)
        salts = np.array([self.salt(lang) for lang in frame["lang"]], dtype=np.uint64)
        keys = mix(runs.hashes ^ salts[runs.owner])
        keys[keys == 0] = 1
        keys[runs.kinds == _CUT] = 0
        return runs, keys


class _Sums:
    """Counts by two 64-bit keys, in arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None):
        """Adds ``n``, or one, for every pair."""
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        if len(first):
            n = np.diff(np.append(first, len(a))) if n is None else np.add.reduceat(n[order], first)
            self.parts.append((a[first], b[first], n))
            self.size += len(first)

    def merge(self) -> None:
        parts, self.parts, self.size = self.parts, [], 0
        if parts:
            self.add(*(np.concatenate(x) for x in zip(*parts)))

    def full(self) -> bool:
        if self.size > 2 * HELD_KEYS:
            self.merge()
        return self.size > HELD_KEYS

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        empty = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
        (found,) = self.parts or [empty]
        self.parts, self.size = [], 0
        return found


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    return docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")


def _strings(values: list) -> np.ndarray:
    return np.array(values, dtype=object)


# --- counting ---------------------------------------------------------------------------
def _count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of every word key; of all words together where ``word`` is NULL."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, sums, totals, langs = _Keys(), _Sums(), {}, {}

        def sent() -> pd.DataFrame:
            salt, word, n = sums.take()
            return pd.DataFrame({"lang": _strings([langs[x] for x in salt.tolist()]), "word": word.view(np.int64), "n": n})

        for frame in frames:
            for part in char_slices([frame], "text"):
                runs, found = keys.of(part)
                salts = np.array([keys.salt(lang) for lang in part["lang"]], dtype=np.uint64)[runs.owner]
                langs |= {int(keys.salt(lang)): lang for lang in set(part["lang"])}
                words = found != 0
                for lang, n in zip(part["lang"], np.bincount(runs.owner[words], minlength=len(part)).tolist()):
                    totals[lang] = totals.get(lang, 0) + n
                sums.add(salts[words], found[words])
                if sums.full():
                    yield sent()
        yield sent()
        n = np.array(list(totals.values()), dtype=np.int64)
        yield pd.DataFrame({"lang": _strings(list(totals)), "word": pd.array([None] * len(n), dtype="Int64"), "n": n})

    return texts.mapInPandas(run, "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _count_level(texts: DataFrame, trie: Trie, start: int, alone: bool) -> DataFrame:
    """(phrase, last, n, word) of one trie: counts of its phrases where ``last`` is NULL, and of phrases with one more word.

    ``start`` is the number of the trie's first phrase. With ``alone``, the trie has all candidates of its
    length, and a longer phrase must end in one of them. Phrases of one word come with the word.
    """
    shared = texts.sparkSession.sparkContext.broadcast(trie)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        keys, sums = _Keys(), _Sums()
        counts = np.zeros(int(trie.accept.max()) + 1, dtype=np.int64)
        named = np.zeros(len(counts) if trie.width == 1 else 0, dtype=bool)

        def longer() -> pd.DataFrame:
            phrase, last, n = sums.take()
            return pd.DataFrame({"phrase": phrase.view(np.int64) + start, "last": pd.array(last.view(np.int64), dtype="Int64"), "n": n, "word": _strings([None] * len(n))})

        for frame in frames:
            for part in char_slices([frame], "text"):
                runs, found = keys.of(part)
                # Texts follow each other without a cut in between: set one.
                ends = np.flatnonzero(runs.owner[1:] != runs.owner[:-1]) + 1
                places = np.arange(len(found)) + np.searchsorted(ends, np.arange(len(found)), side="right")
                spread = np.zeros(len(found) + len(ends), dtype=np.uint64)
                spread[places] = found
                position, phrase = trie.accepted(trie.word_ids(spread))
                counts += np.bincount(phrase, minlength=len(counts))
                if len(named):
                    fresh = np.unique(phrase)
                    fresh = fresh[~named[fresh]]
                    if len(fresh):
                        named[fresh] = True
                        _, first = np.unique(phrase, return_index=True)
                        at = dict(zip(phrase[first].tolist(), position[first].tolist()))
                        words = [runs.text(int(np.searchsorted(places, at[i]))) for i in fresh.tolist()]
                        yield pd.DataFrame({"phrase": fresh + start, "last": pd.array([None] * len(fresh), dtype="Int64"), "n": 0, "word": _strings(words)})
                goes_on = position + trie.width < len(spread)
                position, phrase = position[goes_on], phrase[goes_on]
                last = spread[position + trie.width]
                goes_on = last != 0
                if alone:
                    accepted = np.zeros(len(spread) + 1, dtype=bool)
                    accepted[position] = True
                    goes_on &= accepted[position + 1]
                sums.add(phrase[goes_on].astype(np.uint64), last[goes_on])
                if sums.full():
                    yield longer()
        yield longer()
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"phrase": used + start, "last": pd.array([None] * len(used), dtype="Int64"), "n": counts[used], "word": _strings([None] * len(used))})

    return texts.mapInPandas(run, "phrase bigint, last bigint, n bigint, word string")


def _numbered(candidates: DataFrame) -> tuple[DataFrame, int]:
    """Candidates dealt by hash to tries of bounded size."""
    tries = max(1, -(-candidates.count() // TRIE_PHRASES))
    return candidates.withColumn("trie", F.pmod(F.xxhash64("keys"), F.lit(tries)).cast("int")), tries


def _level(texts: DataFrame, candidates: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """Counted candidates (keys, lang, words, a), and pairs (keys, lang, words, last) that may be frequent.

    ``candidates`` has keys, lang and words, the words of a single key still unknown.
    """
    dealt, tries = _numbered(candidates)
    summed = numbered = None
    start = 0
    for i in range(tries):
        rows = dealt.where(F.col("trie") == i).drop("trie").toArrow()
        if not rows.num_rows:
            continue
        flat = rows["keys"].combine_chunks().flatten().to_numpy().view(np.uint64)
        trie = Trie(flat.reshape(rows.num_rows, -1))
        numbers = pa.array(np.arange(start, start + rows.num_rows))
        names = texts.sparkSession.createDataFrame(rows.append_column("phrase", numbers))
        counted = _count_level(texts, trie, start, tries == 1)
        start += rows.num_rows
        summed = counted if summed is None else summed.unionByName(counted)
        numbered = names if numbered is None else numbered.unionByName(names)
    sums = summed.groupBy("phrase", "last").agg(F.sum("n").alias("n"), F.max("word").alias("word"))
    sums = materialize(sums.where(F.col("n") >= min_count), "phrase-counts")
    known = materialize(numbered, "phrase-numbers")
    counts = sums.where("last is null").join(known, "phrase")
    words = F.coalesce("words", "word")
    level = materialize(counts.select("keys", "lang", words.alias("words"), F.col("n").alias("a")), "phrases")
    more = sums.where("last is not null").join(known.select("phrase", "keys"), "phrase").select("keys", "last")
    return level, more


def count_phrases(
    docs: DataFrame, longest: int = 5, min_count: int = 100, text_col: str = "text", lang_col: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to ``longest`` words that occur ``min_count`` times, and the words of every language.

    The first table has keys (array of word keys), lang, words (joined by spaces) and a (occurrences), the second lang and n.
    """
    texts = _texts(docs, text_col, lang_col)
    counted = materialize(_count_words(texts).where((F.col("n") >= min_count) | F.col("word").isNull()), "word-counts")
    totals = counted.where("word is null").select("lang", "n")
    frequent = counted.where("word is not null")
    candidates = frequent.select(F.array("word").alias("keys"), "lang", F.lit(None).cast("string").alias("words"))
    phrases = words = None
    for _ in range(longest):
        if candidates.isEmpty():
            break
        level, more = _level(texts, candidates, min_count)
        if words is None:
            words = level.select(F.col("keys")[0].alias("last"), F.col("words").alias("word"))
        phrases = level if phrases is None else phrases.unionByName(level)
        named = more.join(words, "last").join(level.select("keys", "lang", "words"), "keys")
        longer = F.concat("keys", F.array("last")).alias("keys")
        candidates = materialize(named.select(longer, "lang", F.concat_ws(" ", "words", "word").alias("words")), "candidates")
    if phrases is None:
        phrases = candidates.select("keys", "lang", "words", F.lit(0).cast("bigint").alias("a")).where("false")
    return phrases, totals


# --- scoring ----------------------------------------------------------------------------
def _exact(column: str) -> str:
    return f"cast({column} as decimal(17, 0))"


def score_phrases(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase of two or more words with l, r, n and score at its lowest-scoring cut.

    Sums and products are decimals of 38 digits: exact for counts below 10**17.
    """
    size = F.size("keys")
    cuts = phrases.where(size > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.slice("keys", F.lit(1), F.col("cut")), "right": F.slice("keys", F.col("cut") + 1, size - F.col("cut"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select(F.col("keys").alias(side), F.col("a").alias(name)), side)
    n = totals.select("lang", "n")
    score = f"(cast(1000 as decimal(4, 0)) * {_exact('a')} * {_exact('n')}) div ({_exact('l')} * {_exact('r')})"
    scored = cuts.join(n, "lang").withColumn("score", F.expr(score))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("low")
    best = scored.groupBy("keys", "lang", "words", "a", "n").agg(lowest)
    return best.select("keys", "lang", "words", "a", "n", "low.score", "low.l", "low.r")


def drop_covered(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases without those that a longer phrase contains in ``percent`` of their occurrences."""
    n = F.size("keys")
    inner = F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice("keys", i, k))))
    )
    inside = scored.where(n > 2).select(inner.alias("keys"), F.col("a").alias("longer"))
    most = inside.groupBy("keys").agg(F.max("longer").alias("longer"))
    covered = F.col("longer") * 100 >= F.col("a") * percent
    return scored.join(most, "keys", "left").where(~F.coalesce(covered, F.lit(False))).drop("longer")


def mine_collocations(
    docs: DataFrame,
    top: int = 2000,
    longest: int = 5,
    min_count: int = 100,
    covered_percent: int = 100,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, then occurrences, then text.

    A-Z are lowered. Texts are cut into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs; phrases
    lie within pieces. n counts all words of a language. A phrase of 2 to ``longest`` words that occurs ``min_count`` times is a
    candidate; its score is the floor of 1000 a n / (l r) at the cut where that is least, ties to the first cut. Candidates that a longer one contains in
    ``covered_percent`` of their occurrences go. Documents without a language have ``und``; null and empty texts have no words; repeated
    rows count repeatedly. Empty tables, and texts without frequent phrases, give no rows. Other columns are ignored.
    """
    if longest < 2 or min_count < 1:
        raise ValueError("phrases have two words at least and occur at least once")
    phrases, totals = count_phrases(docs, longest, min_count, text_col, lang_col)
    scored = materialize(drop_covered(score_phrases(materialize(phrases, "all-phrases"), totals), covered_percent), "scored-phrases")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("words").asc())
    # Within a language, parts first: a language may hold most phrases.
    part = F.pmod(F.xxhash64("keys"), F.lit(32))
    some = scored.withColumn("_place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    ranked = some.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", F.col("words").alias("phrase"), "a", "l", "r", "n", "score")
