import math

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import langid as L

SCHEMA = "doc_id bigint, text string, lang string, url string, html string"


def test_languages_of_documents_not_seen_in_fitting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit_text_model(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    found = {r.doc_id: r for r in L.identify(rest, model, address_col="source", markup_col="text").collect()}
    truth = {r.doc_id: r.lang for r in rest.collect()}
    assert found.keys() == truth.keys()
    assert np.mean([found[d].lang == truth[d] for d in truth]) > 0.98
    assert np.mean([r.accepted for r in found.values()]) > 0.99


def plain_fusion(rows, model):
    """The same evidence, one row at a time."""
    names = [*model.languages, L.BACKGROUND]
    start = L._start_prior(len(model.languages))
    seen = []
    for _, text, _, url, html in rows:
        log, n = model.log_likelihoods(text)
        p = np.exp(log + np.log(start))
        host = url.split("//")[-1].split("/")[0].lower() if url else ""
        code = html.split('lang="')[1][:2] if html and 'lang="' in html else None
        seen.append((log, p / p.sum(), n, host, host.rsplit(".", 1)[-1] if "." in host else "", code))
    corpus = sum(s[1] for s in seen) + start
    corpus = corpus / corpus.sum()
    codes = {s[5] for s in seen if s[5]}
    out = []
    for log, p, n, host, suffix, code in seen:
        of_suffix = sum(s[1] for s in seen if s[4] == suffix) - p
        prior = (of_suffix + L.SUFFIX_WEIGHT * corpus) / (of_suffix.sum() + L.SUFFIX_WEIGHT)
        of_host = sum(s[1] for s in seen if s[3] == host) - p
        prior = (of_host + L.HOST_WEIGHT * prior) / (of_host.sum() + L.HOST_WEIGHT)
        score = log + np.log(prior)
        if code:
            a = L.DECLARED_SMOOTHING
            one = np.maximum(sum(s[1] for s in seen if s[5] == code) - p, 0) + a
            every = np.maximum(sum(s[1] for s in seen if s[5]) - p, 0) + a * (len(codes) + 1)
            score = score + np.log(one / every)
        odds = np.exp(score - score.max())
        out.append((names[int(score.argmax())] if n else None, float(odds.max() / odds.sum()) if n else None))
    return out


def test_fusion_agrees_with_plain_arithmetic(spark):
    english, german = "the house of the man and the thing", "das haus der frau und die katze ist"
    fit = [(i, t, lang, None, None) for i, (t, lang) in enumerate([(english, "en"), (german, "de"), (None, "fr"), ("x", None)] * 3)]
    model = L.fit_text_model(spark.createDataFrame(fit, SCHEMA))
    assert model.languages == ["de", "en"]
    rows = [
        (1, "the man", None, "http://a.example.de/x", '<html lang="en">'), (2, german, None, "http://a.example.de", None),
        (3, german, None, "https://b.example.de/", '<html class=a lang="de">'), (4, "an", None, "http://c.org", '<html lang="de">'),
        (5, english, None, None, None), (6, "zq", None, "http://a.example.de", None), (6, "zq", None, "http://a.example.de", None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = L.identify(frame, model, address_col="url", markup_col="html").collect()
    expected = sorted(zip([r[0] for r in rows], plain_fusion(rows, model)))
    assert len(found) == len(expected)
    for r, (doc, (lang, probability)) in zip(sorted(found, key=lambda r: r.doc_id), expected):
        assert (r.doc_id, r.lang) == (doc, lang) and math.isclose(r.probability, probability, rel_tol=1e-6)


def test_nothing_to_judge(spark):
    model = L.fit_text_model(spark.createDataFrame([(1, "ein text", "de", None, None)], SCHEMA))
    rows = [(1, None, None, None, None), (None, "", None, None, None), (2, "12 *** 34", None, None, None), (3, "ein text " * 30_000, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: (r.lang, r.accepted) for r in L.identify(frame, model, markup_col="text").collect()}
    assert found == {1: (None, False), None: (None, False), 2: (None, False), 3: ("de", True)}
    assert L.identify(frame.limit(0), model).collect() == []
    nobody = L.fit_text_model(frame)
    assert not any(r.accepted for r in L.identify(frame, nobody).collect())


def test_pieces_of_markup_and_addresses(spark):
    row = spark.createDataFrame(
        [(1, None, None, "HTTPS://me@WWW.Example.org:80/a?b#c", "<!doctype html><HTML dir='x' xml:lang='pt-BR'><script>x</script>a<b>c</b><!-- d -->")], SCHEMA
    )
    host = L.host_of(F.col("url"))
    got = row.select(host, L.suffix_of(host), L.declared_language(F.col("html")), L.strip_markup(F.col("html"))).first()
    assert tuple(got)[:3] == ("www.example.org", "org", "pt") and got[3].split() == ["a", "c"]


def test_attributes_of_any_length_stand_before_the_language(spark):
    html = f'<html data-x="{"y" * 5000}" lang="de"><p lang="fr">'
    rows = spark.createDataFrame([(html,), ("<html><p lang='fr'>",), (None,)], "html string")
    found = rows.select(L.declared_language(rows["html"])).collect()
    assert [r[0] for r in found] == ["de", None, None]
