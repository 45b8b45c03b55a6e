from itertools import combinations
from math import factorial, inf

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowtally.operators.anomaly import AnomalyDetector
from flowtally.operators import attribution
from flowtally.operators.attribution import export_trees, sum_rule_gap, top_attributions, top_n_of
from flowtally.operators.treepaths import add_attributions, margins_mean, path_tree
from flowtally.operators.ensemble import SoftVoteModel, TreeSettings, fit_soft_vote, forest_importance
from flowtally.operators.textclf import train_text_classifier
from flowtally.plans import jobs

NAMES = [f"feature_{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(240, 6)).astype("float32")
    y = np.where(x[:, 0] + x[:, 1] > 0.5, 4, np.where(x[:, 2] > 0, 9, 0))
    pdf = pd.DataFrame(x.astype(float), columns=NAMES).assign(label=y.astype("int32"), key=np.arange(240))
    rows = pdf.astype(object).values.tolist()
    rows[0][0] = None
    rows[1][3] = None
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", label int, key bigint").persist()


@pytest.fixture(scope="module")
def model(data):
    return fit_soft_vote(data, NAMES, "label", TreeSettings(trees=3, depth=3))


def test_predict(model, data):
    out = model.transform(data).toPandas()
    p = np.stack(out.probabilities)
    assert p.shape == (240, 3) and np.allclose(p.sum(axis=1), 1, atol=1e-9)
    assert set(out.prediction) <= {0, 4, 9} and (out.prediction == out.label).mean() > 0.8
    assert [model.classes[i] for i in p.argmax(axis=1)] == out.prediction.tolist()


def test_save_and_load(spark, model, data, folder):
    model.save(spark, folder + "/m")
    again = SoftVoteModel.load(spark, folder + "/m")
    a, b = (m.transform(data).orderBy("key").toPandas() for m in (model, again))
    assert a.prediction.tolist() == b.prediction.tolist() and np.allclose(np.stack(a.probabilities), np.stack(b.probabilities))


def leaves_of(nodes, weight):
    """A leaf: its weighted value and, per feature of its path, the feature, its interval and cover share."""
    out = []

    def walk(i, box):
        node = nodes[i]
        if node["left"] < 0:
            f = sorted(box)
            out.append((weight * node["prediction"], f, *([box[j][a] for j in f] for a in range(3))))
            return
        j, t = node["feature"], node["threshold"]
        low, high, cover = box.get(j, (-inf, inf, 1.0))
        for child, lo, hi in ((node["left"], low, min(high, t)), (node["right"], max(low, t), high)):
            walk(child, {**box, j: (lo, hi, cover * nodes[child]["count"] / node["count"])})

    walk(0, {})
    return out


def expected(leaves, x, known):
    """Tree output when only the known features are used; the rest go by cover."""
    total = 0.0
    for value, features, low, high, cover in leaves:
        w = 1.0
        for f, lo, hi, c in zip(features, low, high, cover):
            w *= float(lo < x[f] <= hi) if f in known else c
        total += value * w
    return total


def test_attribution_equals_brute_force(spark, model, data):
    gbt = model.boosted[0]
    trees = export_trees(spark, gbt)
    leaves = [leaf for weight, nodes in trees for leaf in leaves_of(nodes, weight)]
    rows = model.prepare(data).select(vector_to_array("features").alias("x")).limit(4).collect()
    gbt.setRawPredictionCol("raw")
    margins = [r[0] for r in gbt.transform(model.prepare(data)).limit(4).select(F.get(vector_to_array("raw"), F.lit(1))).collect()]
    x = np.array([r.x for r in rows])
    paths = [path_tree(nodes, weight) for weight, nodes in trees]
    signed = np.zeros(x.T.shape)
    for tree in paths:
        add_attributions(tree, np.ascontiguousarray(x.T), signed)
    phi = signed.T
    assert margins_mean(paths) == pytest.approx(expected(leaves, x[0], set()), abs=1e-12)
    for r in range(4):
        for i in range(6):
            others = [j for j in range(6) if j != i]
            want = sum(factorial(s) * factorial(5 - s) / factorial(6)
                       * (expected(leaves, x[r], set(c) | {i}) - expected(leaves, x[r], set(c)))
                       for s in range(6) for c in combinations(others, s))
            assert phi[r, i] == pytest.approx(want, abs=1e-10)
        assert phi[r].sum() + expected(leaves, x[r], set()) == pytest.approx(margins[r], abs=1e-9)


def grown(rng, depth, n_features):
    """A tree with random splits; some branches end early, features come again on a path."""
    nodes = {}

    def node(d, count):
        i = len(nodes)
        nodes[i] = {"left": -1, "right": -1, "prediction": rng.normal(), "count": count}
        if d and count > 1 and (d == depth or rng.random() < 0.9):
            left = int(rng.integers(1, count))
            nodes[i] |= {"feature": int(rng.integers(n_features)), "threshold": float(rng.normal()), "left": node(d - 1, left), "right": node(d - 1, count - left)}
        return i

    node(depth, 5000)
    return nodes


@pytest.mark.parametrize("depth,n_features", [(0, 2), (1, 1), (3, 2), (5, 3), (7, 5)])
def test_paths_equal_brute_force_on_random_trees(depth, n_features):
    rng = np.random.default_rng(depth)
    for _ in range(4):
        nodes = grown(rng, depth, n_features)
        leaves, tree, x = leaves_of(nodes, 0.3), path_tree(nodes, 0.3), rng.normal(size=(n_features, 300))
        phi = np.zeros_like(x)
        add_attributions(tree, x, phi)
        for r in range(0, 300, 100):
            for i in range(n_features):
                others = [j for j in range(n_features) if j != i]
                want = sum(factorial(s) * factorial(n_features - 1 - s) / factorial(n_features)
                           * (expected(leaves, x[:, r], set(c) | {i}) - expected(leaves, x[:, r], set(c)))
                           for s in range(n_features) for c in combinations(others, s))
                assert phi[i, r] == pytest.approx(want, abs=1e-10)
        total = [expected(leaves, x[:, r], set(range(n_features))) for r in range(300)]
        assert phi.sum(axis=0) + tree["mean"] == pytest.approx(total, abs=1e-10)


def test_sum_rule_and_models_sent_in_parts(monkeypatch, model, data):
    assert sum_rule_gap(model, data).agg(F.max("gap"), F.count("gap")).first()[:] == (pytest.approx(0, abs=1e-9), 240)
    whole = top_attributions(model, data, 6).orderBy("key").toPandas()
    monkeypatch.setattr(attribution, "MAX_NODES", 20)
    assert top_attributions(model, data, 6).orderBy("key").toPandas().equals(whole)


def test_top_attributions(model, data):
    out = top_attributions(model, data, 3).toPandas()
    assert len(out) == 240
    for top in out.top_features:
        assert len(top) == 3 and set(top[0].asDict()) == {"feature", "value", "shap"}
        assert top[0].shap >= top[1].shap >= top[2].shap >= 0


def test_top_n_of(spark):
    df = spark.createDataFrame([([0.1, -0.9, 0.5],)], "v array<double>")
    top = df.select(top_n_of(["a", "b", "c"], F.col("v"), 2).alias("t")).first().t
    assert [(t.feature, t.value) for t in top] == [("b", -0.9), ("c", 0.5)]


def test_forest(data):
    r = forest_importance(data.na.drop(), NAMES, "label", "key", trees=5, depth=4, folds=3)
    imp = {x.feature: x.importance for x in r.importance.collect()}
    assert sum(imp.values()) == pytest.approx(1) and set(sorted(imp, key=imp.get)[-3:]) == {"feature_0", "feature_1", "feature_2"}
    assert r.folds.count() == 3 and r.confusion.agg(F.sum("n")).first()[0] == pytest.approx(238 * 0.3, abs=2)
    assert {x["name"] for x in r.report.collect()} >= {"Class_0", "Class_4", "Class_9", "macro avg"}


@pytest.fixture(scope="module")
def detector(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 3))
    x = np.hstack([base, base @ rng.normal(size=(3, 3)) + rng.normal(size=(300, 3)) * 0.1])
    benign = spark.createDataFrame(pd.DataFrame(x, columns=NAMES))
    d = AnomalyDetector(NAMES, 3)
    loss = d.fit(benign)
    assert loss > 0
    return d, benign


def test_detector(spark, detector, folder):
    d, benign = detector
    scored = d.score(benign).toPandas()
    assert (scored.reconstruction_error >= 0).all() and d.threshold > 0
    assert scored.is_anomaly.mean() == pytest.approx(0.05, abs=0.01)
    assert d.threshold == pytest.approx(np.percentile(scored.reconstruction_error, 95))
    odd = spark.createDataFrame(pd.DataFrame(np.random.default_rng(1).normal(size=(10, 6)) * 100, columns=NAMES))
    assert d.score(odd).where("is_anomaly").count() == 10
    d.save(spark, folder + "/d")
    again = AnomalyDetector.load(spark, folder + "/d").score(benign).toPandas()
    assert np.allclose(again.reconstruction_error, scored.reconstruction_error, rtol=1e-9)
    assert len(d.encode(benign).first().latent) == 3


def test_error_is_that_of_the_reconstruction(detector):
    d, benign = detector
    out = d.reconstruction_errors(benign).toPandas()
    x = out[NAMES].values
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    p = d.model.stages[2].pc.toArray()
    assert np.allclose(((z - z @ p @ p.T) ** 2).mean(axis=1), out.reconstruction_error)


def test_unfitted(data):
    with pytest.raises(RuntimeError):
        AnomalyDetector(NAMES).score(data)


def test_score_job(model, data):
    out = jobs.score(data.drop("label"), model, None, top_n=2).first()
    assert out.anomaly_score == 0.0 and out.is_anomaly is False and len(out.shap_top_features) == 2
    assert out.prediction in ("BENIGN", "DoS GoldenEye", "Bot") and 0 < out.confidence <= 1
    thin = jobs.score(data.select("key", "feature_0"), model, None, top_n=0)
    assert thin.count() == 240


def test_text_classifier(spark):
    rows = [(i, ("overflow heap buffer" if i % 2 else "script injection browser") + f" item{i % 7}", i % 2) for i in range(120)]
    _, held = train_text_classifier(spark.createDataFrame(rows, "id bigint, text string, label int"), "id", 256, 10)
    assert held.count() == 18 and held.where("label != prediction").count() == 0
