import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duotide.operators import drift, features, metrics, model, registry, scoring
from duotide.schemas import SENSORS


def _linear(n=400, k=3, groups=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * [1.0, 50.0, 0.01] + [1000.0, -5.0, 0.0]
    g = rng.integers(0, groups, n)
    beta = rng.normal(size=(groups, k)) * [1, 0.1, 100]
    y = 7.0 + (x * beta[g]).sum(axis=1) + rng.normal(size=n) * 0.1
    return pd.DataFrame({"series_key": g.astype(str), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})


def test_var_equals_numpy_least_squares(spark):
    data = _linear()
    fitted = model.train(spark.createDataFrame(data), ["a", "b", "c"], "y").toPandas().set_index("series_key")
    for key, part in data.groupby("series_key"):
        x = np.column_stack([np.ones(len(part)), part[["a", "b", "c"]]])
        want, *_ = np.linalg.lstsq(x, part.y, rcond=None)
        assert np.allclose(fitted.loc[key, "weights"], want, rtol=1e-6, atol=1e-6)
        assert fitted.loc[key, "rmse"] == pytest.approx(np.sqrt(((x @ want - part.y) ** 2).mean()), rel=1e-6)
        assert fitted.loc[key, "n"] == len(part)


def test_var_recovers_the_process_that_made_the_data(spark):
    rng = np.random.default_rng(3)
    a, v = np.array([[0.5, 0.2], [-0.3, 0.4]]), np.zeros((4000, 2))
    for t in range(1, len(v)):
        v[t] = a @ v[t - 1] + [1.0, 2.0] + rng.normal(size=2) * 0.05
    df = spark.createDataFrame(pd.DataFrame({"series_key": "s", "t": range(len(v)), "u": v[:, 0], "w": v[:, 1]}))
    lagged = features.add_lags(df, 1, ["u", "w"], order=("t",))
    weights = model.train(lagged, ["ut-1", "wt-1"], "u").first()["weights"]
    assert np.allclose(weights, [1.0, 0.5, 0.2], atol=0.05)


def test_var_survives_constant_and_collinear_features(spark):
    data = _linear(groups=1).assign(b=3.0)
    data["c"] = data["a"] * 2
    data["y"] = 4 * data["a"]
    row = model.train(spark.createDataFrame(data), ["a", "b", "c"], "y", by=()).first()
    assert row["rmse"] < 1e-6 and np.isfinite(row["weights"]).all()


def test_nulls_are_skipped_or_refused(spark):
    data = _linear(groups=1)
    df = spark.createDataFrame(data).withColumn("a", F.when(F.col("a") > data.a.median(), F.col("a")))
    assert model.train(df, ["a", "b"], "y", by=()).first()["n"] == 200
    with pytest.raises(Exception, match="null in a"):
        model.train(df, ["a", "b"], "y", by=(), handle_invalid="error").collect()


def test_score_by_series_equals_own_model(spark):
    data = _linear()
    df = spark.createDataFrame(data.reset_index(names="id"))
    models = model.train(df, ["a", "b", "c"], "y")
    scored = scoring.score_by_series(df, ["a", "b", "c"], models, ["id"]).toPandas()
    weights = models.toPandas().set_index("series_key").weights
    for _, r in scored.iterrows():
        w = weights[r.series_key]
        assert r.prediction == pytest.approx(w[0] + w[1] * r.a + w[2] * r.b + w[3] * r.c)


def test_gated_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    k, hidden, dense = 3, 4, 3
    flat = rng.normal(size=sum(int(np.prod(s)) for s in model.gated_shapes(k, hidden, dense))) * 0.5
    x, y = rng.normal(size=(20, k)), rng.normal(size=20)
    grad, loss = model.gated_gradient(model.unpack(flat, k, hidden, dense), x, y)
    for at in range(len(flat)):
        step = np.zeros_like(flat)
        step[at] = 1e-6
        up = model.gated_gradient(model.unpack(flat + step, k, hidden, dense), x, y)[1]
        down = model.gated_gradient(model.unpack(flat - step, k, hidden, dense), x, y)[1]
        assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    assert loss > 0


def test_gated_has_the_expected_number_of_weights():
    assert sum(int(np.prod(s)) for s in model.gated_shapes(10)) == 1741


def test_gated_loss_falls_and_scores_like_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2)) * [5, 0.1] + [100, 3]
    data = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": 50 + 3 * (x[:, 0] - 100) - 20 * (x[:, 1] - 3)})
    df = spark.createDataFrame(data).repartition(3)
    options = dict(kind="gated", by=(), hidden=6, dense=5)
    early = model.train(df, ["a", "b"], "y", epochs=1, **options).first()
    late = model.train(df, ["a", "b"], "y", epochs=25, **options).first()
    assert late["train_mae"] < 0.7 * early["train_mae"]
    scored = scoring.score(df, ["a", "b"], late["weights"], "gated", hidden=6, dense=5)
    mae = metrics.regression_metrics(scored, "y", "prediction").first()["mae"]
    assert mae == pytest.approx(late["train_mae"], rel=1e-4)  # the same network on raw features
    parts = model.unpack(np.array(late["weights"]), 2, 6, 5)
    got = scored.select("a", "b", "prediction").toPandas()
    assert np.allclose(got.prediction, model.gated_forward(parts, got[["a", "b"]].to_numpy("float32").astype(float))[0])


def test_gated_scores_null_for_missing_features(spark):
    weights = np.zeros(1741 - 3 * 40 * 9)  # one feature
    df = spark.createDataFrame([(1.0,), (None,)], "a double")
    out = [r[0] for r in scoring.score(df, ["a"], weights, "gated").select("prediction").collect()]
    assert out == [0.0, None]


@pytest.mark.parametrize("kind", ["gradual", "abrupt"])
def test_retraining_beats_the_frozen_model_under_drift(spark, kind):
    rng = np.random.default_rng(5)
    base = np.cumsum(rng.normal(size=(3000, 5)) * 0.1, axis=0) % 10 + 20
    frame = pd.DataFrame(base.round(2), columns=SENSORS).assign(series_key="s", Date_time=range(3000))
    df = spark.createDataFrame(frame)
    slopes = {c: s * 10 for c, s in drift.SLOPES.items()}
    if kind == "gradual":
        moved = drift.gradual(df, slopes, order=("Date_time",))
    else:
        moved = drift.abrupt(df, "Date_time", slopes)
    names = features.lag_names(2)
    before, after = (features.add_lags(d, 2).persist() for d in (df, moved))
    error = {}
    for name, trained_on in (("frozen", before), ("retrained", after)):
        weights = model.train(trained_on, names, by=()).first()["weights"]
        scored = scoring.score(after, names, weights)
        error[name] = metrics.regression_metrics(scored, "Ot_avg", "prediction").first()["rmse"]
    assert error["retrained"] < error["frozen"]


def test_registry_keeps_versions_and_returns_the_newest(spark, tmp_path):
    path = str(tmp_path / "registry")
    rows = spark.createDataFrame([("s", 10, [1.0, 2.0], 0.5)], "series_key string, n bigint, weights array<double>, rmse double")
    for day in (1, 3, 2):
        registry.publish(rows.withColumn("n", F.lit(day)), path, "speed", "var", f"v{day}", "2021-01-01", f"2021-01-0{day}")
    registry.publish(rows, path, "batch", "var", "b1", "2020-01-01", "2021-01-01")
    registry.publish(rows.withColumn("n", F.lit(33)), path, "speed", "var", "v3", "2021-01-01", "2021-01-03")  # again
    every = registry.models(spark, path)
    assert every.count() == 4
    newest = {r["layer"]: (r["model_version"], r["n"]) for r in registry.latest(every).collect()}
    assert newest == {"speed": ("v3", 33), "batch": ("b1", 10)}
    assert registry.latest_weights(spark, path, "speed")["weights"] == [1.0, 2.0]
    assert registry.latest_weights(spark, path, "none") is None


def test_latest_artifact_ignores_other_files(spark, tmp_path):
    import os

    for i, name in enumerate(["model_1-2/Ot_stream.tflite", "model_3-4/Ot_stream.tflite", "model_3-4/Ot_stream.h5"]):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(b"x" * (i + 1))
        os.utime(file, (1000 + i, 1000 + i))
    row = registry.latest_artifact(spark, str(tmp_path)).first()
    assert row["path"].endswith("model_3-4/Ot_stream.tflite") and row["length"] == 2


def _bent(spark, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n) * 3 + 20, rng.normal(size=n)
    y = 5 * np.tanh((a - 20) / 3 + b) + 0.5 * b + rng.normal(size=n) * 0.1 + 50
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y})).repartition(4)


def test_local_steps_reach_the_error_in_a_tenth_of_the_passes(spark):
    train, held = _bent(spark, 6000, 1), _bent(spark, 2000, 2)
    shape = dict(hidden=6, dense=5)

    def error(**options):
        weights = model.train(train, ["a", "b"], "y", kind="gated", by=(), **shape, **options).first()["weights"]
        scored = scoring.score(held, ["a", "b"], weights, "gated", **shape)
        return metrics.regression_metrics(scored, "y", "prediction").first()["mae"]

    full = error(epochs=40)
    local = error(epochs=4, local=64)
    assert local <= full and local < 1.0
    assert error(epochs=4, local=64) == pytest.approx(local, rel=1e-6)  # the same partitions take the same steps


def test_local_steps_with_few_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 3.0), (2.0, 2.0, 4.0)], "a double, b double, y double").repartition(6)
    fitted = model.train(rows, ["a", "b"], "y", kind="gated", by=(), epochs=2, local=64, hidden=2, dense=2).first()
    assert fitted["n"] == 2 and all(np.isfinite(fitted["weights"])) and len(fitted["weights"]) == 27


def test_training_begins_with_given_weights(spark):
    rows = _bent(spark, 200, 3)
    start = [0.1 * (i % 7) - 0.3 for i in range(27)]
    options = dict(kind="gated", by=(), hidden=2, dense=2, start=start)
    none = model.train(rows, ["a", "b"], "y", epochs=0, **options).first()["weights"]
    one = model.train(rows, ["a", "b"], "y", epochs=1, rate=1e-9, **options).first()["weights"]
    assert one == pytest.approx(none, rel=1e-4, abs=1e-4)


def test_gated_network_goes_over_rows_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2 * model.SLICE + 7, 3))
    parts = model.unpack(model._initial(3, 5, 4, 1), 3, 5, 4)
    whole, sizes, forward = model.gated_forward(parts, x)[0], [], model.gated_forward
    monkeypatch.setattr(model, "gated_forward", lambda p, rows: sizes.append(len(rows)) or forward(p, rows))
    assert np.allclose(model.gated_outputs(parts, x), whole, rtol=0, atol=1e-12)
    assert sizes == [model.SLICE, model.SLICE, 7]
    assert model.gated_outputs(parts, x[:0]).shape == (0,)
