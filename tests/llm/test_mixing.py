import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing as M
from barloom.llm import queries


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "Spam! buy now " * (1 + i % 5) + f"offer{i}", "x") for i in range(60)]
    rows += [(100 + i, "a calm and plain text about rivers " * (1 + i % 7) + f"bank{i}", "x") for i in range(200)]
    rows += [(400, None, "x"), (401, "", "x"), (None, "spam text", "x"), (402, "rivers " * 30_000, "x"), (5, "spam again", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row string")


@pytest.fixture(scope="module")
def labelled(docs):
    return docs.where("doc_id % 3 = 0").withColumn("domain", F.when(F.contains(F.lower("text"), F.lit("spam")), "spam").otherwise("calm"))


def expected_tokens(mixed):
    sums = mixed.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) for d in ("calm", "spam")]).first()
    return list(sums)


def test_expected_tokens_meet_the_targets(docs, labelled):
    mixed = M.mix_documents(docs, labelled, {"calm": 3, "spam": 1}, budget=50_000).cache()
    assert mixed.count() == docs.count()
    assert expected_tokens(mixed) == pytest.approx([37_500, 12_500], rel=1e-3)
    rows = mixed.collect()
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    assert all(abs(r.p_calm + r.p_spam - 1) < 1e-9 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (400, 401)} == {0}
    sure = {r.doc_id: r.p_spam for r in rows if r.n_tokens and r.doc_id is not None}
    assert min(p for d, p in sure.items() if d < 60) > 0.5 > max(p for d, p in sure.items() if 100 <= d < 300)


def test_rates_of_one_at_most_keep_what_is_short(docs, labelled):
    mixed = M.mix_documents(docs, labelled, {"calm": 0.99, "spam": 0.01}, anchor=("calm", 1.25), most=1.0).cache()
    rows = {r.doc_id: r for r in mixed.collect() if r.doc_id is not None and r.n_tokens}
    assert all(rows[d].copies == 1 for d in rows if 100 <= d < 300)
    assert sum(rows[d].rate for d in rows if d < 60) < 60
    kept = M.apply_copies(docs, mixed)
    assert kept.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert all(counts.get(d, 0) == rows[d].copies for d in rows if d != 5) and counts[None] == 1


def test_rates_agree_with_a_dense_solver(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    n, p = rng.integers(1, 50, 80), rng.dirichlet([0.2, 0.2, 0.2], 80)
    frame = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens bigint, p0 double, p1 double, p2 double")
    mass = p * n[:, None]
    targets = [float(t) for t in mass.sum(axis=0) * [0.5, 1.2, 1.6]]
    fitted, reached = M.fit_rates(frame, targets, steps=60)
    assert reached == pytest.approx(targets, rel=1e-3)
    w, rate = 1 / (p * p * n[:, None]).sum(axis=0), np.ones(80)
    for _ in range(5000):
        rate = np.maximum(0, rate - 0.3 * (p * (w * (rate @ mass - targets))).sum(axis=1))
    key = lambda r: (r.n_tokens, r.p0)
    found = [r.rate for r in sorted(fitted.collect(), key=key)]
    order = sorted(range(80), key=lambda i: (n[i], p[i, 0]))
    assert found == pytest.approx([rate[i] for i in order], abs=0.02)


def test_descent_ends_at_rest(spark, monkeypatch):
    rows = [(i % 7 + 1, 0.9 - i % 3 * 0.4, 0.1 + i % 3 * 0.4) for i in range(60)]
    frame = spark.createDataFrame(rows, "n_tokens bigint, p0 double, p1 double")
    mass = [sum(n * p[k] for n, *p in rows) for k in range(2)]
    asked = []
    monkeypatch.setattr(M, "_sums", lambda *a, real=M._sums: asked.append(1) or real(*a))
    targets = [mass[0] * 5, mass[1] * 0.4]  # the first cannot be met with rates of one at most
    rested, reached = M.fit_rates(frame, targets, most=1.0, steps=64)
    assert len(asked) < 64
    monkeypatch.setattr(M, "AT_REST", -1.0)
    whole, expected = M.fit_rates(frame, targets, most=1.0, steps=64)
    assert reached == pytest.approx(expected, rel=1e-4)
    rates = [[r.rate for r in f.orderBy("n_tokens", "p0").collect()] for f in (rested, whole)]
    assert rates[0] == pytest.approx(rates[1], abs=1e-3)


def test_extra_columns_keep_their_names(spark, tmp_path):
    rows = [(1, "a", "x", "y", "z", 5), (2, "b", "x", "y", "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `_` string, quality string, toxic string, _copies int")
    mixed = spark.createDataFrame([(1, 2), (2, 0)], "doc_id bigint, copies bigint")
    assert [tuple(r) for r in M.apply_copies(docs, mixed).collect()] == [rows[0], rows[0]]
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(map(tuple, queries.domain_labels(spark, str(tmp_path), docs).collect())) == [(1, "a", "clean"), (2, "b", "toxic")]


def test_main_path_has_no_python(docs, labelled):
    plan = M.domain_posteriors(docs, M.fit_domains(labelled))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_errors_and_empty_tables(docs, labelled):
    with pytest.raises(ValueError, match="nonnegative"):
        M.mix_documents(docs, labelled, {"calm": -1.0})
    with pytest.raises(ValueError, match="no labelled document"):
        M.mix_documents(docs, labelled, {"other": 1.0})
    with pytest.raises(ValueError, match="labelled documents"):
        M.mix_documents(docs, labelled.limit(0), {"calm": 1.0})
    assert M.mix_documents(docs.limit(0), labelled, {"calm": 1.0}).collect() == []


def test_poor_and_toxic_documents_of_each_kind_are_told_from_clean_ones(spark):
    from barloom.llm.queries import domain_labels, table

    sf = "/root/testdata/sf0.1"
    rows = domain_labels(spark, sf, table(spark, sf, "documents"))
    model = M.fit_domains(rows.where("doc_id % 2 = 0"))
    unseen = rows.where("doc_id % 2 = 1")
    found = M.domain_posteriors(unseen, model).join(unseen.withColumnRenamed("doc_id", "doc"), "doc")
    found = found.withColumnRenamed(f"p{model.domains.index('clean')}", "p_clean").select("domain", "text", "p_clean").toPandas()
    words = found.text.str.lower().str.split()
    share = lambda pattern: found.text.str.count(pattern) / found.text.str.len()
    kinds = {
        "one word over and over": words.map(lambda w: len(set(w)) / max(1, len(w))) < 0.1,
        "capitals": share("[A-Z]") > 0.3,
        "symbols": (share(r"[^\w\s]") > 0.12) & (share("[A-Z]") <= 0.3),
    }
    for kind in kinds.values():
        p = found.p_clean[kind & (found.domain == "poor")]
        assert len(p) >= 10 and p.mean() < 0.25
    p = found.groupby("domain").p_clean
    assert p.mean()["poor"] < 0.2 and p.mean()["toxic"] < 0.4 and p.median()["toxic"] < 0.2 and p.mean()["clean"] > 0.9


def test_repetition_is_evidence_and_no_feature_is_left_out(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[(i * 7 + j * (1 + i % 3)) % 40] for j in range(30)), "clean") for i in range(120)]
    rows += [(500 + i, " ".join([words[i % 40]] * 30), "poor") for i in range(20)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, domain string")
    model = M.fit_domains(labelled)
    assert {r.feature for r in model.table.collect()} >= set(words)
    fresh = spark.createDataFrame([(1, "w33 " * 30), (2, " ".join(words[5:35]))], "doc_id bigint, text string")
    p = {r.doc: r.p0 for r in M.domain_posteriors(fresh, model).collect()}
    assert p[1] < 0.2 and p[2] > 0.9


def test_what_the_rates_reach_is_logged(docs, labelled, caplog):
    with caplog.at_level("INFO", logger=M.log.name):
        M.mix_documents(docs, labelled, {"calm": 3, "spam": 1}, budget=50_000)
    assert [r.getMessage().split(":")[0] for r in caplog.records] == ["domain calm", "domain spam"]
    assert all("target" in r.getMessage() and r.levelname == "INFO" for r in caplog.records)


def test_codes_stand_for_the_features_of_odd_texts(spark):
    texts = ["", " ", "--", " -- a -b- c", "a---b ---", "x\ty\x0bz\x0cq\r\nr", "Foo, foo (FOO) [foo]", "ab\U0001f600\U0001f600cd \U0001d400", "p\u0085q ^x] y\\ &&a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    told = M._features(rows, "doc")
    codes = M._features(rows, "doc", hashed=True)
    assert sorted(map(tuple, told.select("doc", M._code(F.col("feature"))).collect())) == sorted(map(tuple, codes.collect()))
    found = {i: set() for i in range(len(texts))}
    for r in told.where(~F.startswith("feature", F.lit(M.FORM))).collect():
        found[r.doc].add(r.feature)
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
        assert found[i] == {w.strip(M.SYMBOLS) for w in words} - {""} | {M.ENDING + w[-M.ENDING_CHARS :] for w in words}


def test_features_themselves_are_not_sent(docs, labelled):
    model = M.fit_domains(labelled)
    told = model.look_up(M._features(docs.where("text is not null"), "doc_id", hashed=True))
    assert "feature" not in told.columns and dict(told.dtypes)["code"] == "bigint"
