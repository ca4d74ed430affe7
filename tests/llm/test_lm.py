import math
from collections import Counter

import pytest
from tests_llm_help import words_of

from barloom.llm import lm


def brute(rows, order):
    words = [words_of(t) for _, t in rows]
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    own = [[grams(w, k) for k in range(1, order + 1)] for w in words]
    every = [sum((o[k] for o in own), Counter()) for k in range(order)]
    total, out = sum(map(len, words)), []
    for (doc, _), w, mine in zip(rows, words, own):
        elsewhere = lambda g, mine=mine: every[len(g) - 1][g] - mine[len(g) - 1][g]
        score, levels, n = 0.0, [0] * (order + 1), max(1, total - len(w))
        for i in range(len(w)):
            longest = min(i + 1, order)
            for k in range(longest, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if elsewhere(g) > 0:
                    score += math.log(elsewhere(g) / (n if k == 1 else elsewhere(g[:-1])))
                    break
            else:
                k = 0
                score -= math.log(n + 1)
            score += math.log(lm.BACKOFF) * (longest - k)
            levels[k] += 1
        out.append((doc, len(w), round(score, 6), *levels))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 3])
def test_scores_agree_with_plain_counting(spark, load, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 40_000)
    rows = [(r.doc_id, r.text) for r in load("documents").collect()]
    rows += [(9001, None), (9002, ""), (9003, "neverseen"), (None, "the of"), (9004, rows[0][1]), (9004, rows[0][1])]
    rows += [(9005, "again and again " * 4000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, block string").repartition(3)
    found = [
        (r.doc_id, r.n_words, round(r.log_score, 6), *[r[f"order_{k}"] for k in range(order + 1)])
        for r in lm.score_documents(docs, order=order).collect()
    ]
    expected = brute(rows, order)
    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=str), expected):
        assert a[:2] == b[:2] and a[3:] == b[3:] and a[2] == pytest.approx(b[2], rel=1e-6, abs=1e-5)


def test_empty_table_and_order(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score_documents(docs).collect() == []
    with pytest.raises(ValueError, match="order"):
        lm.score_documents(docs, order=0)
