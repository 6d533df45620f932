"""op2 and op6: the parts against plain versions, the whole on held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import queries as q
from lodeworks.llm import quality, toxicity


def held_out(spark, query, sf, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    return rows, [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def auc(pairs):
    pos, neg = [s for s, _, y in pairs if y], [s for s, _, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    rows, pairs = held_out(spark, q.op6_quality, SF, "quality")
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([p == y for _, p, y in pairs]) > 0.97 and auc(pairs) > 0.98


def test_toxicity_on_held_out_labels(spark):
    rows, pairs = held_out(spark, q.op2_toxicity, SF, "toxic")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert np.mean([p == y for _, p, y in pairs]) > 0.94 and auc(pairs) > 0.9
    assert np.mean([p for _, p, y in pairs if not y]) < 0.02


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_tables(spark, scores):
    docs = spark.createDataFrame([(1, "fine words here", "x"), (2, None, "x"), (3, "", "x"), (None, "idiot idiot", "x"), (1, "fine words here", "x"), (4, "long " * 100_000, "x"), (5, "!!! ### \x00 \u200b", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = scores(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r["key"], r["score"]) == r["score"]
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1  # null is the empty text
    assert scores(docs, labels.limit(0)).count() == 7
    assert scores(docs.limit(0), labels).count() == 0


def test_filters_return_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit(1))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.8 < kept.count() / docs.count() < 0.97
    good = quality.keep_quality(docs, labels)
    assert good.columns == docs.columns and 0.8 < good.count() / docs.count() < 0.97


def test_isotonic_is_the_best_monotone_fit():
    x, y = quality.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 1.0]))
    assert list(y) == [0.0, 0.5, 1.0] or list(np.diff(y) >= 0) == [True] * (len(y) - 1)
    assert x[0] == 0.0 and y[0] == 0.0 and y[-1] == 1.0


def test_random_features_approximate_the_gaussian_kernel():
    x = np.random.default_rng(0).normal(size=(40, 5))
    f = quality.Features(np.zeros(5), np.ones(5), n=20_000, width=2.0)
    z = f(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 2.0**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.15
    rates = np.array([[0.01, 0.02, 0.05, 0.01], [0.7, 0.5, 0.3, 0.6]])
    fires = (rng.random((len(y), 4)) < rates[y.astype(int)]).astype(float)
    fires = np.hstack([fires, fires[:, :1]])  # a voter that copies the first
    got = toxicity.LabelModel(fires, np.full(len(y), -1), np.ones(len(y)))
    assert abs(got.prior - 0.15) < 0.05 and np.abs(got.rates[1, :4] - rates[1]).max() < 0.15
    assert got.share[0] < 0.75 and got.share[4] < 0.75 and got.share[1] > 0.9
    assert got.correlation[0, 4] > 0.9
    assert np.mean((got.posterior(fires) > 0.5) == y) > 0.93


def test_statistics_are_finite():
    for t in (None, "", " ", "\n\n", "a", "é" * 1000, "\x00", "!!! ###"):
        x = quality.statistics(t)
        assert len(x) == len(quality.STATISTICS) and np.isfinite(x).all()
