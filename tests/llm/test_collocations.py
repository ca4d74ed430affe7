import random
import re
from collections import Counter

import numpy as np
import pytest
from tests_llm_help import LOWER

from barloom.llm import collocations
from barloom.llm.tries import Trie
from barloom.llm.words import Runs

PIECES, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def brute(docs, top, min_count):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in PIECES.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    f = Counter({g: a for g, a in f.items() if a >= min_count})
    out = []
    for (lang, words), a in f.items():
        if len(words) < 2:
            continue
        inside = lambda x, words=words: any(x[i : i + len(words)] == words for i in range(len(x) - len(words) + 1))
        if any(b >= a and o == lang and len(x) > len(words) and inside(x) for (o, x), b in f.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in n:
        rows = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(rows[:top])]
    return sorted(ranked)


def found(spark, docs, top, min_count):
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, n int, words string").repartition(3)
    return sorted(tuple(r) for r in collocations.mine_collocations(rows, top=top, min_count=min_count).collect())


@pytest.fixture(scope="module")
def docs(load):
    rng = random.Random(9)
    rows = [(r.text, r.lang) for r in load("documents").limit(120).collect()]
    words = ["New", "York", "city", "of", "ü", " x", "-", "A" * 300, "the"]
    seps = [" ", " ", " ", "\t ", ".", ", ", "\n", "\x0b", " ", "?!"]
    for lang in ("en", None, "und", "x"):
        rows += [("".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60))), lang) for _ in range(30)]
    rows += [(None, "en"), ("", None), (" .\t", "de"), ("again and again, " * 9000, "long"), ("one two", "x"), ("one two", "x")]
    return rows


def test_agrees_with_plain_counting(spark, docs):
    assert found(spark, docs, 40, 7) == brute(docs, 40, 7)


def test_many_tries_and_early_sends_change_nothing(spark, docs, monkeypatch):
    some = docs[100:]
    expected = brute(some, 2000, 6)
    monkeypatch.setattr(collocations, "TRIE_PHRASES", 9)
    monkeypatch.setattr(collocations, "HELD_KEYS", 5)
    assert found(spark, some, 2000, 6) == expected and len(expected) > 20


def test_empty_and_rare(spark):
    assert found(spark, [], 5, 2) == []
    assert found(spark, [("a b c", "en"), (None, None)], 5, 2) == []
    assert found(spark, [("a a.b", "en"), ("b;a", "en")], 5, 2) == []


def test_exact_beyond_64_bits(spark):
    big = 10**13
    rows = [([1], "x", "p", big + 1), ([2], "x", "q", big + 3), ([1, 2], "x", "p q", big)]
    phrases = spark.createDataFrame(rows, "keys array<bigint>, lang string, words string, a bigint")
    totals = spark.createDataFrame([("x", 10**16 + 7)], "lang string, n bigint")
    (row,) = collocations.score_phrases(phrases, totals).collect()
    assert row.score == 1000 * big * (10**16 + 7) // ((big + 1) * (big + 3))


@pytest.mark.parametrize("n, vocabulary, width", [(1, 1, 1), (300, 40, 3), (3000, 70000, 2), (900, 900, 1)])
def test_trie_finds_every_sequence(n, vocabulary, width):
    rng = np.random.default_rng(n)
    words = rng.integers(1, 2**64, vocabulary, dtype=np.uint64)
    draw = lambda *size: words[(rng.pareto(1.0, size) * 20).astype(int) % vocabulary]
    sequences = np.unique(draw(n, width), axis=0)
    rng.shuffle(sequences)
    text = draw(4000)
    text[::37] = 0
    trie = Trie(sequences)
    position, sequence = trie.accepted(trie.word_ids(text))
    rows = {tuple(s): i for i, s in enumerate(sequences.tolist())}
    parts = [tuple(text[i : i + width].tolist()) for i in range(len(text) - width + 1)]
    assert list(zip(position.tolist(), sequence.tolist())) == [(i, rows[p]) for i, p in enumerate(parts) if p in rows]


def test_runs_keep_bytes_and_owners(monkeypatch):
    texts = ["Ab c.d", None, "", "X" * 700000 + " y", "ü; Z"]
    runs = Runs(texts, collocations._CLASSES)
    got = [(int(o), int(k), runs.text(i)) for i, (o, k) in enumerate(zip(runs.owner, runs.kinds))]
    assert got == [(0, 1, "ab"), (0, 1, "c"), (0, 2, "."), (0, 1, "d"), (3, 1, "x" * 700000), (3, 1, "y"), (4, 1, "ü"), (4, 2, ";"), (4, 1, "z")]
