import random

import numpy as np
import pytest
from tests_llm_help import components, shingles_of

from barloom.llm import ngram_join as J


def brute(rows, width, num):
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, shingles_of(text, width))
    ids = [d for d in sets if sets[d]]
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    label = components(sets, links)
    return {d: (len(sets[d]), label[d]) for d in sets}


def family(rng, start):
    """Copies, near copies around the threshold, and texts that share a long passage."""
    base = [f"w{rng.randrange(200)}" for _ in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((start + i, " ".join(words)))
    rows += [(start + 50 + i, " ".join(base + [f"y{rng.randrange(10**6)}" for _ in range(12)])) for i in range(20)]
    rows += [(start + 80 + i, " ".join(base)) for i in range(10)]
    return rows


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_components_and_sizes_agree_with_all_pairs(spark, load, width, num):
    rng = random.Random(width)
    rows = [(r.doc_id, r.text) for r in load("documents").collect()] + family(rng, 10**6) + family(rng, 2 * 10**6)
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "a b"), (10**7 + 3, "A \n B"), (10**7 + 4, " \t ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, key string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_documents(docs, width=width, num=num).collect()}
    assert found == brute(rows, width, num)


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (0, "a b c d")], schema)
    found = sorted(map(tuple, J.link_documents(docs).collect()), key=str)
    assert found == sorted([(1, 2, 0), (1, 2, 0), (None, 2, None), (0, 2, 0)], key=str)
    assert J.link_documents(docs.limit(0)).collect() == []


def test_prefix_tree_finds_what_all_comparisons_find():
    rng = np.random.default_rng(0)
    limit = J.Threshold(80)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    sets = []
    for _ in range(120):
        values = base.copy()
        change = rng.integers(0, 40, rng.integers(0, 12))
        values[change] = rng.integers(0, 2**63, len(change)).astype(np.uint64)
        sets.append(np.unique(values[: rng.integers(20, 41)]))
    tree = J.PrefixTree(sets)
    for query in sets[:40]:
        expected = set()
        for i, s in enumerate(sets):
            shared = len(np.intersect1d(query, s))
            if 100 * shared >= 80 * (len(query) + len(s) - shared):
                expected.add((i, shared))
        assert set(tree.search(query, limit)) == expected


def test_thresholds_are_whole_numbers():
    limit = J.Threshold(90)
    assert limit.overlap(9, 10) == 9 and limit.prefix(10) == 2
    with pytest.raises(ValueError, match="threshold"):
        J.Threshold(0)
