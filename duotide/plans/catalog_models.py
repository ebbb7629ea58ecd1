"""Queries that train, store and apply models."""

from __future__ import annotations

from collections.abc import Callable

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duotide import scratch
from duotide.operators import features, metrics, model, registry, scoring, split
from duotide.plans import forecast, frames
from duotide.plans.catalog import query
from duotide.plans.catalog_features import train_condition
from duotide.plans.oracle import LAGGED, RECORDS, lags, with_
from duotide.schemas import LABEL, SENSORS, SERIES, TIME

ORDER = (TIME, "offset")
AR = [f"{LABEL}t-1", f"{LABEL}t-2"]


def _label_lags(spark, sf_dir, p):
    rows = frames.records(spark, sf_dir).select(SERIES, *ORDER, LABEL)
    return features.add_lags(rows, p, [LABEL], order=ORDER)


def _sensor_lags(spark, sf_dir):
    return features.add_lags(frames.records(spark, sf_dir), 2, order=ORDER)


@query(
    with_(RECORDS, LAGGED)
    + """SELECT series_key, count(*) AS n, round(regr_intercept(Ot_avg, l1), 6) AS intercept,
  round(regr_slope(Ot_avg, l1), 6) AS slope FROM lagged WHERE nth > 1 GROUP BY 1"""
)
def ar1_fit(spark, sf_dir):
    fitted = model.train(_label_lags(spark, sf_dir, 1), AR[:1])
    w = F.col("weights")
    return fitted.select(
        SERIES, "n", F.round(F.get(w, 0), 6).alias("intercept"), F.round(F.get(w, 1), 6).alias("slope")
    )


# Each series has a level of its own, 1e8 apart from the next.
LEVEL_SQL = "CAST(substr(series_key, 2) AS BIGINT) * 1e8"


@query(
    with_(RECORDS, LAGGED, f"far AS (SELECT series_key, nth, Ot_avg + {LEVEL_SQL} AS y, l1 + {LEVEL_SQL} AS x FROM lagged)")
    + """SELECT series_key, count(*) AS n, round(regr_slope(y, x), 6) AS slope FROM far WHERE nth > 1 GROUP BY 1"""
)
def var_distant_levels(spark, sf_dir):
    """Series at levels far apart lose no digits to each other."""
    level = F.substring(SERIES, 2, 20).cast("bigint") * F.lit(1e8)
    rows = _label_lags(spark, sf_dir, 1).withColumns({c: F.col(c) + level for c in (LABEL, AR[0])})
    return model.train(rows, AR[:1]).select(SERIES, "n", F.round(F.get("weights", 1), 6).alias("slope"))


# Two regressors solved by Cramer's rule on their covariances.
AR2 = [
    RECORDS,
    LAGGED,
    """c AS (SELECT series_key, count(*) AS n, avg(Ot_avg) AS y, avg(l1) AS x1, avg(l2) AS x2,
    var_pop(Ot_avg) AS yy, var_pop(l1) AS a, var_pop(l2) AS d, covar_pop(l1, l2) AS b,
    covar_pop(Ot_avg, l1) AS e, covar_pop(Ot_avg, l2) AS f FROM lagged WHERE nth > 2 GROUP BY 1)""",
    """fit AS (SELECT *, (e * d - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2 FROM c)""",
]


@query(
    with_(*AR2)
    + """SELECT series_key, n, round(y - w1 * x1 - w2 * x2, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2,
  round(sqrt(yy - w1 * e - w2 * f), 6) AS rmse FROM fit"""
)
def ar2_fit(spark, sf_dir):
    fitted = model.train(_label_lags(spark, sf_dir, 2), AR)
    weights = [F.round(F.get("weights", i), 6).alias(f"w{i}") for i in range(3)]
    return fitted.select(SERIES, "n", *weights, F.round("rmse", 6).alias("rmse"))


@query(
    with_(*AR2)
    + """SELECT l.series_key, "offset", Ot_avg,
  round(y - w1 * x1 - w2 * x2 + w1 * l1 + w2 * l2, 6) AS prediction
FROM lagged l JOIN fit ON fit.series_key = l.series_key WHERE nth > 2"""
)
def ar2_score(spark, sf_dir):
    rows = scratch.materialise(_label_lags(spark, sf_dir, 2), "lags")
    scored = scoring.score_by_series(rows, AR, model.train(rows, AR), ["offset"])
    return scored.select(SERIES, "offset", LABEL, F.round("prediction", 6).alias("prediction"))


@query(
    with_(RECORDS, LAGGED)
    + """SELECT series_key, count(*) AS n, CAST(0 AS DOUBLE) AS bias, """
    + ", ".join(f"CAST(0 AS DOUBLE) AS g{i}" for i in range(10))
    + " FROM lagged WHERE nth > 2 GROUP BY 1"
)
def var_normal_equations(spark, sf_dir):
    """Least squares holds when the errors of each series are uncorrelated with every feature.

    Both the fit and the scoring path must be right for all of these to vanish.
    """
    names = features.lag_names(2)
    rows = scratch.materialise(_sensor_lags(spark, sf_dir), "lags")
    scored = scoring.score_by_series(rows, names, model.train(rows, names), ["offset"])
    e = F.col("prediction") - F.col(LABEL)

    def angle(x):
        return F.round(F.sum(e * x) / F.sqrt(F.sum(e * e) * F.sum(x * x)), 6) + F.lit(0.0)

    angles = [angle(F.col(c)).alias(f"g{i}") for i, c in enumerate(names)]
    return scored.groupBy(SERIES).agg(F.count("*").alias("n"), angle(F.lit(1.0)).alias("bias"), *angles)


ANGLES = [f"g{i}" for i in range(10)]


@query(
    with_(RECORDS, LAGGED)
    + "SELECT is_train, count(*) AS n, "
    + ", ".join(f"CASE WHEN is_train THEN CAST(0 AS DOUBLE) END AS {c}" for c in ["bias", *ANGLES])
    + f""" FROM (SELECT {train_condition('"offset"')} AS is_train FROM lagged WHERE nth > 2) GROUP BY 1"""
)
def var_forecast_errors(spark, sf_dir):
    """One model for all series, trained on the hash-drawn part and applied to both.

    Least squares holds when its errors on the part it was trained on are uncorrelated with every feature.
    """
    names = features.lag_names(2)
    rows = scratch.materialise(_sensor_lags(spark, sf_dir), "lags")
    train, _ = split.by_hash(rows, "offset")
    weights = model.train(train, names, by=()).first()["weights"]  # one row
    scored = scoring.score(rows, names, weights).withColumn("is_train", split.is_train(F.col("offset")))
    e = F.col("prediction") - F.col(LABEL)

    def angle(x):
        return F.when(F.col("is_train"), F.round(F.sum(e * x) / F.sqrt(F.sum(e * e) * F.sum(x * x)), 6) + F.lit(0.0))

    angles = [angle(F.col(f"`{c}`")).alias(g) for c, g in zip(names, ANGLES)]
    return scored.groupBy("is_train").agg(F.count("prediction").alias("n"), angle(F.lit(1.0)).alias("bias"), *angles)


# A small network with fixed weights: two lags, two hidden and two dense units.
SMALL = [round(math.sin(i + 1) * (0.02 if i < 18 and i % 6 < 4 else 0.9), 4) for i in range(27)]


def _small_network_sql() -> str:
    """The same network written out, on features in single precision."""
    x = ["l1::FLOAT::DOUBLE", "l2::FLOAT::DOUBLE"]
    w = [f"({v}::DOUBLE)" for v in SMALL]

    def layer(at, inputs):  # two units: kernel by rows, then biases
        return [f"({inputs[0]} * {w[at + u]} + {inputs[1]} * {w[at + 2 + u]} + {w[at + 4 + u]})" for u in range(2)]

    gates = [f"(1 / (1 + exp(-{z})))" for z in layer(0, x)]
    news = [f"tanh({z})" for z in layer(6, x)]
    outs = [f"(1 / (1 + exp(-{z})))" for z in layer(12, x)]
    hidden = [f"({o} * tanh({i} * {g}))" for i, g, o in zip(gates, news, outs)]
    dense = [f"greatest({z}, 0)" for z in layer(18, hidden)]
    return f"{dense[0]} * {w[24]} + {dense[1]} * {w[25]} + {w[26]}"


@query(
    with_(RECORDS, LAGGED)
    + f'SELECT series_key, "offset", round({_small_network_sql()}, 6) AS prediction FROM lagged WHERE nth > 2'
)
def gated_score(spark, sf_dir):
    """The gated network applied with known weights."""
    scored = scoring.score(_label_lags(spark, sf_dir, 2), AR, SMALL, kind="gated", hidden=2, dense=2)
    return scored.select(SERIES, "offset", F.round("prediction", 6).alias("prediction"))


@query()
def gated_forecast_errors(spark, sf_dir):
    """The gated network, a few epochs over all rows, scored on all rows."""
    names = features.lag_names(2)
    rows = scratch.materialise(_sensor_lags(spark, sf_dir), "lags")
    train, _ = split.by_hash(rows, "offset")
    weights = model.train(train, names, kind="gated", by=(), epochs=3).first()["weights"]  # one row
    scored = scoring.score(rows, names, weights, kind="gated").withColumn("is_train", split.is_train(F.col("offset")))
    return metrics.regression_metrics(scored, LABEL, "prediction", ["is_train"])


# Weights to begin with, of the smallest network: input, cell and output gate, then the two dense layers.
FIRST_WEIGHTS = dict(wi=0.3, bi=0.1, wg=-0.6, bg=0.2, wo=0.4, bo=-0.1, w1=0.9, b1=0.3, w2=0.8, b2=-0.2)
RATE = 0.05


def _unit_sql(w: Callable[[str], str]) -> list[str]:
    """The network's values on standardised ``x``, one select list on another, its weights given by ``w``."""
    gate = lambda k: f"1 / (1 + exp(-({w('w' + k)} * x + {w('b' + k)})))"
    return [
        f"{gate('i')} AS i, tanh({w('wg')} * x + {w('bg')}) AS g, {gate('o')} AS o",
        "tanh(i * g) AS t",
        "o * t AS h",
        f"greatest(h * {w('w1')} + {w('b1')}, 0) AS d",
        f"d * {w('w2')} + {w('b2')} AS made",
    ]


def _steps_sql(source: str, name: str, lists: list[str]) -> list[str]:
    names = [source, *[f"{name}_{i}" for i in range(len(lists) - 1)], name]
    return [f"{b} AS (SELECT *, {cols} FROM {a})" for a, b, cols in zip(names, names[1:], lists)]


_GRADIENT = dict(wi="x * di", bi="di", wg="x * dg", bg="dg", wo="x * do_", bo="do_", w1="h * dd", b1="dd", w2="d * dy", b2="dy")
ADAM_STEP = [
    RECORDS,
    LAGGED,
    "e AS MATERIALIZED (SELECT l1, Ot_avg FROM lagged WHERE nth > 1)",
    """scale AS (SELECT count(*) AS n, avg(l1) AS mx, stddev_pop(l1) AS sx, avg(Ot_avg) AS my, stddev_pop(Ot_avg) AS sy FROM e)""",
    "z AS MATERIALIZED (SELECT (l1 - mx) / sx AS x, (Ot_avg - my) / sy AS y FROM e, scale)",
    *_steps_sql(
        "z",
        "back",
        [
            *_unit_sql(lambda k: f"({FIRST_WEIGHTS[k]}::DOUBLE)"),
            f"sign(made - y) AS dy, CASE WHEN d > 0 THEN sign(made - y) * {FIRST_WEIGHTS['w2']}::DOUBLE ELSE 0 END AS dd",
            f"dd * {FIRST_WEIGHTS['w1']}::DOUBLE AS dh",
            "dh * o * (1 - t * t) AS dc",
            "dc * g * i * (1 - i) AS di, dc * i * (1 - g * g) AS dg, dh * t * o * (1 - o) AS do_",
        ],
    ),
    "grads AS (SELECT " + ", ".join(f"avg({g}) AS {k}" for k, g in _GRADIENT.items()) + " FROM back)",
    "stepped AS MATERIALIZED (SELECT "
    + ", ".join(f"{w}::DOUBLE - {RATE}::DOUBLE * {k} / (abs({k}) + {model.EPSILON}::DOUBLE) AS s_{k}" for k, w in FIRST_WEIGHTS.items())
    + " FROM grads)",
    *_steps_sql("(SELECT * FROM z, stepped)", "after_", _unit_sql(lambda k: f"s_{k}")),
]
_RAW_WEIGHTS = [f"s_{k}" for k in FIRST_WEIGHTS]
for _at in (0, 2, 4):
    _RAW_WEIGHTS[_at], _RAW_WEIGHTS[_at + 1] = f"{_RAW_WEIGHTS[_at]} / sx", f"{_RAW_WEIGHTS[_at + 1]} - mx * {_RAW_WEIGHTS[_at]} / sx"
_RAW_WEIGHTS[8], _RAW_WEIGHTS[9] = "s_w2 * sy", "s_b2 * sy + my"


@query(
    with_(*ADAM_STEP)
    + "SELECT n, "
    + ", ".join(f"round({w}, 6) AS w{i}" for i, w in enumerate(_RAW_WEIGHTS))
    + ", round((SELECT avg(abs(made - y)) FROM after_) * sy, 6) AS train_mae FROM stepped, scale"
)
def gated_adam_step(spark, sf_dir):
    """One full-batch step of the gated network's training, from given weights, over all rows."""
    rows = _label_lags(spark, sf_dir, 1)
    shape = dict(hidden=1, dense=1, start=list(FIRST_WEIGHTS.values()), rate=RATE, epochs=1)
    fitted = model.train(rows, AR[:1], kind="gated", by=(), **shape)
    return fitted.select("n", *[F.round(F.get("weights", i), 6).alias(f"w{i}") for i in range(10)], F.round("train_mae", 6).alias("train_mae"))


SCALED = {f"{c}t-{i}": f"s{k}" for k, (i, c) in enumerate((i, c) for i in (1, 2) for c in SENSORS)}


@query(
    with_(
        RECORDS,
        f"""l AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY Date_time, "offset") AS nth,
    {lags(2, SENSORS, 'PARTITION BY series_key', 'Date_time, "offset"')} FROM rec)""",
        "kept AS (SELECT * FROM l WHERE nth > 2)",
        "bounds AS (SELECT "
        + ", ".join(f'min("{c}") AS lo_{s}, max("{c}") AS hi_{s}' for c, s in SCALED.items())
        + f""" FROM kept WHERE {train_condition('"offset"')})""",
    )
    + 'SELECT series_key, "offset", '
    + ", ".join(f'round(("{c}" - lo_{s}) / (hi_{s} - lo_{s}), 9) AS {s}' for c, s in SCALED.items())
    + " FROM kept, bounds"
)
def minmax_scaled(spark, sf_dir):
    """Features assembled and scaled by ranges learnt on the training part."""
    rows = scratch.materialise(_sensor_lags(spark, sf_dir), "lags")
    train, _ = split.by_hash(rows, "offset")
    fitted = features.assemble(train, features.lag_names(2), scale=True)
    scaled = fitted.transform(rows).withColumn("_v", vector_to_array("scaledFeatures"))
    places = [F.round(F.get("_v", i), 9).alias(s) for i, s in enumerate(SCALED.values())]
    return scaled.select(SERIES, "offset", *places)


def _periods(rows):
    """The years that occur, in order: as many as the data's time span has."""
    return [r["period"] for r in rows.select("period").distinct().orderBy("period").collect()]


@query(
    with_(
        RECORDS,
        LAGGED,
        """yearly AS (SELECT series_key, year(Date_time) AS y, count(*) AS n, regr_slope(Ot_avg, l1) AS slope
  FROM lagged WHERE nth > 1 GROUP BY ALL)""",
    )
    + """SELECT series_key, 'model_' || y || '-' || (y + 1) AS model_version, n, round(slope, 6) AS slope FROM yearly
QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY y DESC) = 1"""
)
def latest_models(spark, sf_dir):
    """A model per series and training period is published; the newest of each is read back."""
    path = scratch.new_dir(spark, "registry")
    rows = _label_lags(spark, sf_dir, 1)
    fitted = scratch.materialise(model.train(rows.withColumn("period", F.year(TIME)), AR[:1], by=[SERIES, "period"]))
    for year in _periods(fitted):
        version = registry.version_name(str(year), str(year + 1))
        registry.publish(
            fitted.where(F.col("period") == year), path, "speed", "var", version, f"{year}-01-01", f"{year + 1}-01-01"
        )
    newest = registry.latest(registry.models(spark, path))
    return newest.select(SERIES, "model_version", "n", F.round(F.get("weights", 1), 6).alias("slope"))


@query(
    with_(RECORDS, LAGGED)
    + """SELECT 'model_' || max(y) || '-' || (max(y) + 1) AS model_version
FROM (SELECT year(Date_time) AS y FROM lagged WHERE nth > 1)"""
)
def latest_artifact(spark, sf_dir):
    """The newest model file below a folder, found by modification time alone."""
    path = scratch.new_dir(spark, "artifacts")
    rows = scratch.materialise(_label_lags(spark, sf_dir, 1).withColumn("period", F.year(TIME)))
    for year in _periods(rows):
        version = registry.version_name(str(year), str(year + 1))
        fitted = model.train(rows.where(F.col("period") == year), AR[:1], by=())
        registry.publish(fitted, path, "speed", "var", version, f"{year}-01-01", f"{year + 1}-01-01")
    newest = registry.latest_artifact(spark, path, "*.parquet")
    return newest.select(F.regexp_extract("path", "version=([^/]+)/", 1).alias("model_version"))


TWO_LAYER = [
    RECORDS,
    LAGGED,
    """e AS (SELECT series_key, Date_time, "offset", Ot_avg AS y, l1,
    date_diff('day', DATE '1970-01-01', CAST(Date_time AS DATE)) // 30 AS epoch_id FROM lagged WHERE nth > 1)""",
    "m AS (SELECT epoch_id, regr_slope(y, l1) AS a, regr_intercept(y, l1) AS b FROM e GROUP BY 1)",
    """fast AS (SELECT epoch_id, lag(a) OVER w AS a, lag(b) OVER w AS b FROM m WINDOW w AS (ORDER BY epoch_id))""",
    "history AS (SELECT min(epoch_id) + (max(epoch_id) - min(epoch_id)) // 3 AS last FROM e)",
    "slow AS (SELECT regr_slope(y, l1) AS a, regr_intercept(y, l1) AS b FROM e, history WHERE epoch_id <= last)",
    """scored AS (SELECT e.*, fast.b + fast.a * l1 AS s, slow.b + slow.a * l1 AS f
  FROM e JOIN fast USING (epoch_id), slow, history WHERE epoch_id > last AND fast.a IS NOT NULL)""",
    """sums AS (SELECT epoch_id, sum((y - f) * (s - f)) AS num, sum((s - f) * (s - f)) AS den FROM scored GROUP BY 1)""",
    """shares AS (SELECT epoch_id, CASE WHEN lag(den) OVER w > 0
      THEN least(1, greatest(0, lag(num) OVER w / lag(den) OVER w)) ELSE 0.5 END AS share
  FROM sums WINDOW w AS (ORDER BY epoch_id))""",
]


@query(
    with_(*TWO_LAYER)
    + """SELECT epoch_id, round(sqrt(avg((s - y) ** 2)), 6) AS speed_rmse, round(sqrt(avg((f - y) ** 2)), 6) AS batch_rmse,
  round(sqrt(avg((0.3::DOUBLE * s + 0.7::DOUBLE * f - y) ** 2)), 6) AS fixed_rmse,
  round(sqrt(avg((share * s + (1 - share) * f - y) ** 2)), 6) AS dynamic_rmse, count(*) AS n
FROM scored JOIN shares USING (epoch_id) GROUP BY 1"""
)
def two_layer_forecast(spark, sf_dir):
    """Speed model per epoch, batch model of history, and their fixed and dynamic combinations."""
    rows = _label_lags(spark, sf_dir, 1).withColumn("epoch_id", frames.epoch_of(TIME))
    scored = forecast.two_layer(rows, AR[:1], LABEL, "epoch_id", ["offset"])
    made = forecast.combined(scored, LABEL, TIME, f"{frames.EPOCH_DAYS} days", ["offset"])
    rated = forecast.errors(made, LABEL, ["epoch_id"])
    return rated.withColumns({c: F.round(c, 6) for c in rated.columns if c.endswith("_rmse")})
