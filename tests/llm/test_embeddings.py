import numpy as np
from tests_llm_help import components

from barloom.llm import embeddings as E


def brute(rows):
    points = np.array([v for _, v in rows], dtype=np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    linked = points @ points.T >= 0.95
    np.fill_diagonal(linked, False)
    ids = [i for i, _ in rows]
    label = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked))])
    return {i: (int(n), label[i], label[i] == i) for i, n in zip(ids, linked.sum(axis=1))}


def test_links_agree_with_all_pairs(spark, load, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in load("embeddings").collect()]
    for g in range(3):
        center = rng.normal(size=64)
        rows += [(10_000 + 1000 * g + i, (center + rng.normal(size=64) * 0.16).tolist()) for i in range(120)]
        rows += [(10_500 + 1000 * g + i, center.tolist()) for i in range(20)]
    monkeypatch.setattr(E, "BLOCK_VECTORS", 50)
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, rep int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.link_vectors(frame).collect()}
    expected = brute(rows)
    assert found.keys() == expected.keys()
    links = sum(v[0] for v in expected.values())
    assert all(found[i][0] <= expected[i][0] for i in found)
    assert sum(v[0] for v in found.values()) >= 0.99 * links > 10_000
    assert sum(found[i][1] == expected[i][1] for i in found) >= 0.99 * len(found)


def test_invalid_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, -0.0]), (6, [nan, 1.0]),
        (7, [None, 1.0]), (8, [inf, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted(map(tuple, E.link_vectors(frame).collect()), key=str)
    linked = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert found == sorted([*linked, *alone, (None, 0, None, True)], key=str)
    assert E.link_vectors(frame.limit(0)).collect() == []


def test_codes_never_hide_a_neighbour():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 30))
    points[300:] = points[:300] + rng.normal(size=(300, 30)) * 0.1
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    q = E.Quantizer.fit(points, 20, 0.95)
    own, codes, error = q.encode(points)
    visits = q.probes(points, own)
    for of_list in range(len(q.centers)):
        members = np.flatnonzero(own == of_list)
        norms = q.norms(of_list, codes[members])
        near = q.distances(points, q.tables(points), of_list, codes[members], norms)
        read = q.books[np.arange(codes.shape[1]), codes[members]].reshape(len(members), -1)[:, :30] + q.centers[of_list]
        assert np.allclose(near, ((points[:, None] - read[None]) ** 2).sum(axis=2), atol=1e-5)
        close = points @ points[members].T >= 0.95
        assert (near <= (q.radius + error[members] + E.TABLE_ERROR) ** 2)[close].all()
        assert visits[:, of_list][close.any(axis=1)].mean() >= 0.99 if close.any() else True


def test_links_of_vectors_that_vary_along_few_directions(spark):
    rng = np.random.default_rng(5)
    for dims, directions in ((64, 6), (768, 6), (768, 8)):
        points = rng.normal(size=(1500, directions)) @ rng.normal(size=(directions, dims))
        groups = rng.normal(size=(10, 1, dims)) * 3 + rng.normal(size=(10, 50, directions)) @ rng.normal(size=(10, directions, dims))
        rows = list(enumerate(np.concatenate((points, *groups)).tolist()))
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.link_vectors(frame).collect()}
        expected = brute(rows)
        links = sum(v[0] for v in expected.values())
        assert sum(v[0] for v in found.values()) >= 0.999 * links > 100
        assert sum(found[i][1] == expected[i][1] for i in found) >= 0.999 * len(found)
