import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from tests_llm_help import LOWER

from barloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, items):
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for _, x in items for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000) / ((s[b] + 1.0) * (big_t + 10000))))
    rows = []
    for doc, text in docs:
        words, found = features(text)
        weight = math.floor(sum(gain(bucket(f)) for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(words), len(found), weight, score))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], -r[2]))
    drawn = fit[: 25 * len(fit) // 100]
    out = [(r[0], *r[2:], i + 1) for i, r in enumerate(drawn)]
    rest = Counter(rows) - Counter(drawn)
    return sorted(out + [(r[0], *r[2:], None) for r in rest.elements()], key=str)


def found(spark, docs, items):
    ours = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, line string, score int").repartition(3)
    theirs = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, n string")
    return sorted((tuple(r) for r in importance.resample(ours, theirs).collect()), key=str)


def test_agrees_with_plain_counting(spark, load, monkeypatch):
    monkeypatch.setattr(importance, "SEGMENT_BYTES", 300)
    docs = [(r.doc_id, r.text) for r in load("documents").collect()]
    docs += [(9001, None), (9002, ""), (9003, "\n\n one\n\ntwo\n"), (None, "a b " * 30), (None, "a b " * 30), (9004, docs[0][1]), (9004, docs[0][1])]
    docs += [(9005, "long " * 9000), (9006, "x" * 3000 + " ü " + "Y" * 70), (9007, "ÀÉ ÀÉ-b\tC_d\rE\x0bf 12a")]
    items = [(r.item_id, r.text) for r in load("benchmark").collect()] + [(-1, None)]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs = [(i, "word " * 25 + str(i)) for i in range(9)]
    assert found(spark, docs, []) == brute(docs, [])
    assert found(spark, [], docs) == []


def test_check_sums():
    rng = random.Random(3)
    words = ["".join(rng.choices("abü", k=n)).encode() for n in [*range(1, 70), 300]]
    buffer = np.frombuffer(b" ".join(words), dtype=np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    sums = importance.word_sums(buffer, starts, sizes)
    assert sums.tolist() == [zlib.crc32(w) for w in words]
    pairs = importance.pair_sums(sums[:-1], buffer, starts[1:], sizes[1:], sums[1:])
    assert pairs.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]
    pairs = importance.pair_sums(sums[:0], buffer, starts[:0], sizes[:0], sums[:0])
    assert len(pairs) == 0
