import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from barloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["", " ", "  a  b ", "x▁y", "😀 乱码 \x00 tab\tnew\n\n  sp", "á  ", "▁▁ ▁", "\n", "ﬁ", "<s> <0x41>", "a" * 30000, " " * 3000]
RULES = {"\t": " ", "ﬁ": "fi", "á": "á", "áb": "Q", "abc": "ab", "bcé": "", "　": "  ", "Ａ": "A", "z": " z ", "\n": ""}


def compiled(rules):
    """A character map in the format of models; every node of the trie has a block of 256 units."""
    units, texts = np.zeros(256, dtype=np.int64), b""
    units = list(units)

    def build(at, keys, depth):
        nonlocal texts
        base = len(units)
        units.extend([0] * 256)
        units[at] |= (at ^ base) << 10
        for key, value in keys.items():
            if len(key) == depth:
                units[at] |= 1 << 8
                units[base] = 1 << 31 | len(texts)
                texts += value + b"\0"
        for label in sorted({k[depth] for k in keys if len(k) > depth}):
            units[base ^ label] = label
            build(base ^ label, {k: v for k, v in keys.items() if len(k) > depth and k[depth] == label}, depth + 1)

    build(0, {k.encode(): v.encode() for k, v in rules.items()}, 0)
    trie = np.array(units, dtype="<u4").tobytes()
    return len(trie).to_bytes(4, "little") + trie + texts


def with_normalizer(path, rules, prefix, trim):
    def field(number, value):
        head, n = bytes([number << 3 | 2]), len(value)
        while n > 127:
            head, n = head + bytes([n & 127 | 128]), n >> 7
        return head + bytes([n]) + value

    spec = field(pieces.NORMALIZER_MAP, compiled(rules)) if rules else b""
    spec += bytes([pieces.NORMALIZER_PREFIX << 3, prefix, pieces.NORMALIZER_TRIM << 3, trim])
    with open(PATH, "rb") as source, open(path, "wb") as out:
        out.write(source.read() + field(pieces.FIELD_NORMALIZER, spec))
    return str(path)


@pytest.fixture(scope="module")
def texts(load):
    rng = random.Random(5)
    some = ["".join(rng.choices([*RULES, " ", "b", "c", "é", "字"], k=rng.randint(1, 30))) for _ in range(400)]
    return [r.text for r in load("documents").limit(60).collect()] + TRICKY + some


def check(path, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for text, (ids, begin, end) in zip(texts, pieces.Encoder(path).encode(texts)):
        expected = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in expected.pieces], repr(text)
        assert list(zip(begin.tolist(), end.tolist())) == [(p.begin, p.end) for p in expected.pieces], repr(text)


def test_ids_and_spans_are_the_librarys(texts):
    check(PATH, texts)


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("trim", [0, 1])
@pytest.mark.parametrize("rules", [{}, RULES])
def test_character_maps_and_space_handling(tmp_path, texts, rules, prefix, trim):
    check(with_normalizer(tmp_path / "m.model", rules, prefix, trim), texts)


def test_remembered_words_change_nothing(texts, monkeypatch):
    monkeypatch.setattr(pieces, "_CACHE_WORDS", 20)
    encoder = pieces.Encoder(PATH)
    whole = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in texts:
        assert encoder.ids(["▁" + text.replace(" ", "▁") if text else ""])[0].tolist() == whole.encode(text)


def test_documents_round_trip(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, "z", "x"), (2, None, "x"), (3, "", "x"), *[(10 + i, t, "x") for i, t in enumerate(TRICKY)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    coded = pieces.encode_documents(docs, PATH)
    found = sorted(((r.doc_id, r.ids, r.text) for r in pieces.decode_documents(coded, PATH).collect()), key=str)
    whole = sentencepiece.SentencePieceProcessor(model_file=PATH)
    expected = [(d, whole.encode(t or ""), whole.decode(whole.encode(t or ""))) for d, t, _ in rows]
    assert found == sorted(expected, key=str)
    assert pieces.encode_documents(docs.where("false"), PATH).collect() == []
    for r in coded.where("doc_id = 1").collect():
        assert [bytes(b"a b")[x:y] for x, y in zip(r.begins, r.ends)] == [b"a", b" b"]


def test_query_agrees_with_the_library(spark, load):
    whole = sentencepiece.SentencePieceProcessor(model_file=PATH)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in load("documents").collect():
        ids = whole.encode(r.text or "")
        expected.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(whole.decode(ids)), len((r.text or "").encode())))
    from tests_llm_help import SF

    assert sorted(tuple(r) for r in queries.QUERIES["op13_sentence_pieces"](spark, SF).collect()) == sorted(expected)


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError, match="byte fallback"):
        pieces.Model(str(path))
