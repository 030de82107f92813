import numpy as np
from pyspark.sql import functions as F

from wardline.functions import clinical
from wardline.operators import focal


def _windows(spark, n=300, seed=4):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 2, 3)).round(3)
    y = (x[:, :, 0].sum(axis=1) + 0.3 * rnd.normal(size=n) > 0.8).astype(int)
    split = np.where(np.arange(n) % 4 == 3, "val", "train")
    rows = [(str(s), [[float(v) for v in r] for r in w], int(t)) for s, w, t in zip(split, x, y, strict=True)]
    return spark.createDataFrame(rows, "split string, X array<array<float>>, y int"), x, y


def test_gradient_equals_a_numeric_one_and_the_loss_that_of_the_column(spark):
    df, x, _ = _windows(spark, 60)
    rnd = np.random.default_rng(1)
    for w in (np.zeros(7), rnd.normal(size=7)):
        loss, gradient = focal.loss_and_gradient(df, w, 0.1)
        h = 1e-5
        tries = np.concatenate([w + h * np.eye(7), w - h * np.eye(7)])
        found = focal.losses(df, tries, 0.1, 0.25, 2.0)
        assert np.allclose(gradient, (found[:7] - found[7:]) / (2 * h), atol=1e-6)
        z = sum((F.flatten("X")[i].cast("double") * float(w[i]) for i in range(6)), F.lit(float(w[6])))
        mean = df.select(F.avg(clinical.focal_loss(F.col("y"), 1 / (1 + F.exp(-z))))).first()[0]
        assert abs(mean + 0.05 * (w[:6] ** 2).sum() - loss) < 1e-9


def test_training_finds_the_minimum_and_chooses_on_validation(spark):
    df, x, y = _windows(spark)
    train = df.filter("split = 'train'")
    model = focal.fit(train, 6, 0.01, 40)
    _, gradient = focal.loss_and_gradient(train, np.append(model.weights, model.intercept), 0.01)
    assert np.abs(gradient).max() < 1e-4
    best, table = focal.train_focal_classifier(df, reg=(10.0, 0.001), max_iter=15)
    auc = {r.reg_param: r.val_auroc for r in table.collect()}
    assert max(auc.values()) > 0.95
    assert abs(best.weights[0]) > 3 * abs(best.weights[1])  # the informative channel
