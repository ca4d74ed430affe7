import numpy as np
from tests_llm_help import shingles_of, words_of

from barloom.llm import contamination as C


def brute(docs, items, width=5, num=80):
    out = set()
    for doc, text in docs:
        for item, wanted in items:
            want = shingles_of(wanted, width)
            k = len(next(iter(want), ()))
            have = shingles_of(text, k) if len(words_of(text)) >= k > 0 else set()
            if want and doc is not None and 100 * len(want & have) >= num * len(want):
                out.add((doc, item, len(want), len(want & have)))
    return out


def test_hits_agree_with_all_pairs(spark, load):
    docs = [(r.doc_id, r.text) for r in load("documents").collect()]
    items = [(r.item_id, r.text) for r in load("benchmark").collect()]
    words = items[0][1].split()
    docs += [
        (9001, "x " * 20_000 + items[1][1] + " y" * 20_000), (9002, " ".join(words[: len(words) * 9 // 10])),
        (9003, " ".join(words[: len(words) * 7 // 10])), (9004, None), (9005, ""), (None, items[1][1]), (9006, "two words"),
    ]
    items += [(901, None), (902, ""), (903, "Two  words"), (903, "Two  words"), (904, words[0])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int")
    wanted = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(docs, set(items))
    assert {9001, 9002, 9006} <= {e[0] for e in expected} and {e[1] for e in expected if e[0] == 9003} == {904}
    assert sorted(map(tuple, C.find_contained(frame, wanted).collect())) == sorted(expected)
    blocks = C.find_contained(frame, wanted, block_shingles=300).collect()
    assert sorted(map(tuple, blocks)) == sorted(expected)
    left = {r.doc_id for r in C.drop_contaminated(frame, wanted).collect()}
    assert left == {d for d, _ in docs} - {e[0] for e in expected}


def test_empty_tables_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "A b c d e")], "item_id bigint, text string")
    assert [tuple(r) for r in C.find_contained(docs, items).collect()] == [(1, 7, 1, 1)] * 2
    assert C.find_contained(docs.limit(0), items).collect() == []
    assert C.find_contained(docs, items.limit(0)).collect() == []


def test_items_of_few_words_are_found_inside_longer_documents(spark):
    texts = ["one two three four five six seven eight", "three four five", "three four", "five four three two one", "", None, "Five"]
    wanted = ["three four five", "four", "FIVE six", "one two three four", "four three", "absent", "six seven eight nine"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(wanted)), "item_id bigint, text string")
    found = sorted(map(tuple, C.find_contained(docs, items).collect()))
    padded = [f" {t.lower()} " if t else "" for t in texts]
    assert found == [(d, i, 1, 1) for d, t in enumerate(padded) for i, w in enumerate(wanted) if f" {w.lower()} " in t]
    assert len(found) == 9


def test_sql_has_the_same_rule_for_items_of_few_words(spark):
    import duckdb

    from barloom.llm.sql import SQL

    texts = ["A b c d e f", "b c", "c b", "x b c d e f y", "", None, "a"]
    wanted = ["b C", "a", "b c d e f", "", None, "f y", "d c"]
    con = duckdb.connect()
    for table, key, values in (("documents", "doc_id", texts), ("benchmark", "item_id", wanted)):
        con.execute(f"CREATE TABLE {table} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {table} VALUES (?, ?)", list(enumerate(values)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(wanted)), "item_id bigint, text string")
    found = sorted(map(tuple, C.find_contained(docs, items).collect()))
    assert found == sorted(con.execute(SQL["op7_benchmark_decontamination"]).fetchall()) and len(found) == 8


def test_small_documents_are_not_searched_for_large_items():
    item = np.arange(1, 101, dtype=np.uint64)
    index = C.ItemIndex([(1, item)], 80, 100)
    assert not len(index.tables[6][0]) and len(index.tables[7][0]) == 21
    assert index.search(item[:63]) == [] and index.search(item[:80]) == [(1, 100, 80)]
