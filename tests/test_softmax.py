"""Softmax boosting: a tree worked out by hand, probabilities, quality beside the one-vs-rest fits, gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.operators import softmax as sm
from flowtally.operators.ensemble import TreeSettings, fit_soft_vote
from flowtally.operators.evaluate import macro_f1


def test_one_split_by_hand(spark):
    """Four rows, two classes, one feature that parts them: shares are 1/2, so derivatives are ±1/2 and 1/4."""
    df = spark.createDataFrame([(1.0, 0.0, 5), (2.0, 0.0, 5), (3.0, 0.0, 8), (4.0, 0.0, 8)], "a double, b double, label int")
    model = sm.fit_softmax(df, ["a", "b"], "label", sm.SoftmaxSettings(rounds=1, depth=1, rate=1.0, l2=1.0))
    assert model.classes == [5, 8] and model.base == [pytest.approx(np.log(0.5))] * 2
    first, second = model.rounds[0]
    assert first["feature"].tolist() == [0, -1, -1] == second["feature"].tolist()
    # class 5: gradient -1/2 - 1/2 = -1 on the left, hessian 1/4 + 1/4; value 1 / (1/2 + 1)
    assert first["value"].tolist() == pytest.approx([0.0, 2 / 3, -2 / 3]) and second["value"].tolist() == pytest.approx([0.0, -2 / 3, 2 / 3])
    shares = {r.a: r.probabilities for r in model.transform(df).collect()}
    e = np.exp(2 / 3 - -2 / 3)
    assert shares[1.0] == pytest.approx([e / (1 + e), 1 / (1 + e)]) and shares[4.0] == pytest.approx([1 / (1 + e), e / (1 + e)])


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x, g, h = rng.integers(0, sm.BINS, (80, 3)), rng.normal(size=80), rng.random(80) + 0.1
    sums = np.stack([np.stack([np.bincount(x[:, f], w, sm.BINS) for w in (g, h, np.ones(80))], axis=1) for f in range(3)])
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    want = max((worth(x[:, f] <= b) + worth(x[:, f] > b) - worth(x[:, f] >= 0), -f, -b) for f in range(3) for b in range(sm.BINS - 1) if 0 < (x[:, f] <= b).sum() < 80)
    f, b, gain, left, right = sm.best_split(sums, 1.0, 0.0)
    assert gain == pytest.approx(want[0]) and left == pytest.approx(-g[x[:, f] <= b].sum() / (h[x[:, f] <= b].sum() + 1))
    assert sm.best_split(np.zeros((2, sm.BINS, 3)), 1.0, 0.0) is None


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 4))
    y = np.where(x[:, 0] > 0.8, 7, np.where(x[:, 1] + x[:, 2] > 0, 2, np.where(x[:, 3] > 0.3, 4, 0)))
    data = [[*map(float, v), int(c), int(i)] for v, c, i in zip(x, y, range(1500))]
    for i in range(0, 1500, 100):
        data[i][1], data[i + 1][2], data[i + 2][3] = None, float("nan"), float("inf")
    data[3][4] = None
    return spark.createDataFrame(data, "a double, b double, c double, d double, label int, key long").repartition(3).persist()


def test_many_classes_in_one_model(spark, rows, folder, monkeypatch):
    monkeypatch.setattr(sm, "KEPT_ROUNDS", 3)
    train, held = rows.where("key % 3 <> 0"), rows.where("key % 3 = 0 AND label IS NOT NULL AND d < double('inf')")
    model = sm.fit_softmax(train, ["a", "b", "c", "d"], "label", sm.SoftmaxSettings(rounds=8, depth=3, rate=0.3))
    out = model.transform(rows)
    assert out.count() == 1500 and out.where("abs(aggregate(probabilities, 0D, (s, x) -> s + x) - 1) > 1e-12 OR size(probabilities) <> 4 OR prediction IS NULL").count() == 0
    old = fit_soft_vote(train.where("d < double('inf')"), ["a", "b", "c", "d"], "label", TreeSettings(trees=8, depth=3, rate=0.3, forest=False))
    f1 = [macro_f1(m.transform(held)).first()[0] for m in (model, old)]
    assert f1[0] >= f1[1] - 0.02 and f1[0] > 0.85
    model.save(spark, f"{folder}/m")
    again = sm.SoftmaxModel.load(spark, f"{folder}/m").transform(rows)
    assert sorted(map(str, again.select("key", "prediction").collect())) == sorted(map(str, out.select("key", "prediction").collect()))


def test_one_class_and_no_rows(spark, rows):
    one = sm.fit_softmax(rows.where("label = 7"), ["a", "b"], "label", sm.SoftmaxSettings(rounds=2, depth=2))
    assert one.classes == [7] and one.rounds == [] and one.transform(rows.limit(3)).where("prediction = 7 AND probabilities[0] = 1").count() == 3
    empty = sm.SoftmaxSettings(rounds=1, depth=1)
    assert sm.fit_softmax(rows.where("key < 0"), ["a"], "label", empty).classes == []
