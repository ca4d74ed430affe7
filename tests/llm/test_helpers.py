import random

import numpy as np
import pandas as pd
from tests_llm_help import components

from barloom.llm.arrays import SHARE, fold, share
from barloom.llm.components import connected_components
from barloom.llm.sampling import collect_sample, hash_sample


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    nodes = list(range(300))
    rng.shuffle(nodes)
    links = [(nodes[i], nodes[i + 1]) for i in range(99)]
    links += [(nodes[100], nodes[i]) for i in range(101, 200)]
    links += [(nodes[200 + 2 * i], nodes[201 + 2 * i]) for i in range(40)]
    links += links[:20] + [(b, a) for a, b in links[20:40]]
    label = components(range(300), links)
    odd = [(nodes[290], nodes[290]), (None, 1), (2, None)]
    edges = spark.createDataFrame(links + odd, "a bigint, b bigint").repartition(5)
    linked = {x for pair in links for x in pair}
    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert found == {x: label[x] for x in linked}
    assert connected_components(edges.limit(0), "a", "b").collect() == []


def test_arrays_of_many_tasks_add_up(spark):
    def run(frames):
        total = np.zeros(1000, dtype=np.uint8)
        for frame in frames:
            np.add.at(total, frame["id"] % 1000, 1)
        yield share(total, rows=7)

    shares = spark.range(0, 5000, 1, 20).where("id % 1000 < 500").mapInPandas(run, SHARE)
    total = fold(shares, np.uint8, 1000, wide=np.int64, rows=7)
    assert total.dtype == np.int64 and total.tolist() == [5] * 500 + [0] * 500
    assert not fold(shares.limit(0), np.uint8, 1000, rows=7).any()
    assert share(np.zeros(10)).empty and isinstance(share(np.ones(10)), pd.DataFrame)


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).toDF("id")
    sample = {r.id for r in hash_sample(rows, 1000, "id").collect()}
    assert 850 < len(sample) < 1150
    assert {r.id for r in hash_sample(rows.repartition(7), 1000, "id").collect()} == sample
    assert hash_sample(rows, 20_000, "id").count() == 20_000
    same = rows.selectExpr("cast(null as bigint) id")
    assert len(collect_sample(same, 50, "id")) <= 100


def test_parts_are_finished_before_the_driver_gets_them(spark, monkeypatch):
    import numpy as np

    from barloom.llm import arrays, ngram_join

    counts = np.zeros(1 << 12, dtype=np.uint32)
    counts[::5] = np.arange(len(counts[::5])) * 9
    sent = []
    rows = spark.createDataFrame(arrays.share(counts), arrays.SHARE)
    kind = type(rows)
    monkeypatch.setattr(kind, "collect", lambda self, real=kind.collect: sent.append(real(self)) or sent[-1])
    levels = arrays.fold(rows.unionByName(rows), np.uint32, len(counts), finish=ngram_join.frequency_levels)
    assert levels.dtype == np.uint8 and (levels == ngram_join.frequency_levels(2 * counts)).all()
    assert sum(len(r.data) for r in sent[0]) <= len(counts)
