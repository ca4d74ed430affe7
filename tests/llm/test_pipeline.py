import zlib

import numpy as np
import public_tokenizers
from tests_llm_help import SF, components, shingles_of
from tokenizers import Tokenizer

import corpus_pipeline as P
from barloom.session import materialize


def test_stages_on_their_own_inputs(spark, load):
    docs = load("documents").selectExpr("*", "n_chars as extra")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert after.items() <= before.items()
        seen.append((name, before, after))
    language, near, leaks, mixed = seen
    assert len(language[2]) == len(language[1])

    sets = {d: shingles_of(r.text, 5) for d, r in near[1].items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    label = components(ids, links)
    assert set(near[2]) == {d for d in ids if label[d] == d}

    items = [shingles_of(r.text, 5) for r in load("benchmark").collect()]
    clean = {d for d, r in leaks[1].items() if not any(10 * len(i & shingles_of(r.text, 5)) >= 8 * len(i) for i in items if i)}
    assert set(leaks[2]) == clean

    labels = {r.doc_id: r for r in load("labels").collect()}
    good = {d for d in mixed[1] if d in labels and labels[d].quality == 1 and labels[d].toxic == 0}
    assert good <= set(mixed[2])

    encode, start, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode, 0, []
    for d in sorted(mixed[2]):
        ids = [*encode(mixed[2][d].text, add_special_tokens=False).ids, 2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    found = P.STAGES[-1][1](spark, docs, SF)
    assert sorted(map(tuple, found.collect())) == expected
    assert sorted(map(tuple, P.run(spark, SF).collect())) == expected


def test_rows_without_ids_and_repeats_survive(spark, load):
    docs = load("documents").limit(20)
    odd = docs.limit(1).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")
    table = materialize(docs.unionByName(docs.limit(2)).unionByName(odd), "odd")
    kept = P.drop_near_duplicates(spark, table, SF).collect()
    assert sum(r.doc_id is None for r in kept) == 1
    assert len({r.doc_id for r in kept if r.doc_id is not None}) == len(kept) - 1
    none = table.limit(0)
    for _, stage in P.STAGES[:-1]:
        none = stage(spark, none, SF)
    assert none.collect() == []
