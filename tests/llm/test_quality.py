"""The quality classifier: held-out accuracy on a driver table, the prior, the risk, awkward rows."""

import numpy as np

from inkfold.llm import quality, queries

KINDS = "doc_id long, text string, lang string, score double, node long"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op13_quality(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [p for p, y in held if y], [p for p, y in held if not y]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1 and len(good) > 500 and len(bad) > 100
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    draw = lambda n, share: np.where(rng.random((n, 1)) < share, rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (n, 3)))
    p, u = draw(2000, 1.0), draw(3000, 0.7)
    model = quality.fit(p, u)
    assert abs(model["prior"] - 0.7) < 0.06
    s = quality.scores(model, draw(1000, 1.0)), quality.scores(model, draw(1000, 0.0))
    assert (s[0] > 0.5).mean() > 0.95 and (s[1] < 0.5).mean() > 0.95
    assert quality.scores(quality.fit(p[:0], u), p[:2]).tolist() == [0.5, 0.5]


def test_features_of_awkward_texts():
    assert not quality.features(None).any() and not quality.features("").any() and not quality.features(" \n\t ").any()
    for text in ("x", "\n", "é" * 3, "x" * 300_000, "a b " * 100_000, "\x00 \ud800", "!!! ???"):
        x = quality.features(text)
        assert x.shape == (quality.SIZE,) and np.isfinite(x).all()
    assert quality.features("a a a a")[6] == 1 and quality.features("tail " * 90 + "WORD !!")[2] > 0  # the end counts


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    texts = [(i, f"plain words number {i} in a row" if i % 4 else "###!! $$ ##", "en", 9.0, 1) for i in range(60)]
    odd = [(100, None, "en", 9.0, 1), (101, "", "en", 9.0, 1), (102, "w " * 150_000, None, None, None), (103, "same", "en", 0.0, 0), (103, "same", "en", 0.0, 0), (None, "nobody", "en", 0.0, 0)]
    got = quality.quality(spark.createDataFrame(texts + odd, KINDS).repartition(3), labels).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id in (100, 101)}) == 1 and len({r.score for r in got if r.doc_id == 103}) == 1
    assert quality.quality(spark.createDataFrame([], KINDS), labels).count() == 0
    lone = quality.quality(spark.createDataFrame(texts, KINDS), labels.limit(0)).collect()
    assert {r.score for r in lone} == {0.5}
    both = quality.score(spark.createDataFrame(texts, KINDS), {"base": 0.5})
    assert both.columns == [*[x.split()[0] for x in KINDS.split(", ")], "score_"]
