import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab' \n\t  ''sStreldvm1²½.,!\x85\xa0ßéªµ×漢😀\x1c_<|endoftext|>"


@pytest.fixture(scope="module")
def cache():
    return T.WordCache(PATH)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=ALPHABET, max_size=25), min_size=1, max_size=5))
def test_words_give_the_ids_of_whole_texts(cache, texts):
    whole = cache.whole.encode_batch(texts, add_special_tokens=False)
    assert [list(x) for x in cache.encode(texts)] == [e.ids for e in whole]


def test_full_cache_starts_anew(cache, monkeypatch):
    monkeypatch.setattr(T, "_RECENT_WORDS", 3)
    monkeypatch.setattr(T, "_CACHE_WORDS", 20)
    monkeypatch.setattr(T, "_CHUNK_CHARS", 60)
    small = T.WordCache(PATH)
    for i in range(40):
        texts = [f"word{i} another the of and thing {i * 7} x" * 3, "", "a" * 100]
        assert [list(x) for x in small.encode(texts)] == [e.ids for e in small.whole.encode_batch(texts)]


def test_segments_round_trip(spark, load, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT_DOCS", 16)
    rows = [(r.doc_id, r.text) for r in load("documents").collect()]
    rows += [(None, "no id"), (10**9, None), (10**9, ""), (5, "again"), (10**9 + 1, "long " * 50_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, part int").repartition(4)
    path = f"{tmp_path}/ids"
    T.write_segments(docs, path, PATH)
    encode = Tokenizer.from_file(PATH).encode
    expected, start = [], 0
    ids = {r: [*encode(r[1] or "", add_special_tokens=False).ids, T.END_ID] for r in rows}
    for doc in sorted({r[0] for r in rows}, key=lambda d: (d is not None, d)):
        same = sorted((ids[r] for r in rows if r[0] == doc), key=len)
        for x in same:
            expected.append((doc, start, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
            start += len(x)
    assert sorted(map(tuple, T.checksums(spark, path).collect()), key=lambda r: r[1]) == expected
    assert spark.read.parquet(f"{path}/segments").count() > 8
    assert sorted(len(r.ids) for r in T.read_ids(spark, path, [5, 10**9]).collect()) == sorted(
        len(ids[r]) for r in rows if r[0] in (5, 10**9)
    )
    (digest,) = T.read_dictionary(spark, path)
    assert {r.dictionary_sha256 for r in spark.read.parquet(f"{path}/segments").collect()} == {digest}


def test_empty_table(spark, tmp_path):
    T.write_segments(spark.createDataFrame([], "doc_id bigint, text string"), f"{tmp_path}/a", PATH)
    assert T.checksums(spark, f"{tmp_path}/a").collect() == []


def test_special_tokens_in_texts_are_as_in_the_library(cache):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "plain"]
    assert [list(x) for x in cache.encode(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
