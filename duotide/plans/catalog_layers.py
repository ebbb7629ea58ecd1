"""Queries over the two layers' predictions: matching, scores, weights, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from duotide import scratch
from duotide.operators import ensemble, metrics, scoring
from duotide.plans import frames, kpi, report
from duotide.plans.catalog import query
from duotide.plans.oracle import HYBRID, LAGGED, MATCHED, PREDICTED, RAW_PREDICTIONS, RECORDS, half_up, with_
from duotide.schemas import HYBRID_FIELDS, KPI_FIELDS, LABEL, SERIES, TIME
from duotide.sources import readers, sinks

RAW = [RECORDS, LAGGED, RAW_PREDICTIONS]
MATCHED_FIELDS = HYBRID_FIELDS[:15]
ERROR = "(Temp_Predict - Temp)"
SCORES = f"sqrt(avg({ERROR} * {ERROR})) AS rmse, avg({ERROR} * {ERROR}) AS mse, avg(abs({ERROR})) AS mae, count(*) AS n"


def _window(time: str, seconds: int) -> str:
    micros = seconds * 1_000_000
    return f"make_timestamp(epoch_us({time}) // {micros} * {micros})"


@query(
    with_(*RAW)
    + 'SELECT topic, series_key, "offset", TS, Temp, Temp_Predict FROM raw'
)
def split_layers(spark, sf_dir):
    sp, bt = ensemble.split_layers(frames.raw_predictions(spark, sf_dir), "speed", "batch")
    return report.union_results(sp, bt).select("topic", SERIES, "offset", "TS", "Temp", "Temp_Predict")


@query(with_(*PREDICTED, MATCHED) + f"SELECT series_key, {', '.join(MATCHED_FIELDS)} FROM matched")
def hybrid_join(spark, sf_dir):
    """Two separate prediction tables matched on series and time."""
    both = scratch.materialise(frames.predictions(spark, sf_dir), "predictions")
    sp, bt = ensemble.split_layers(both, "speed", "batch")
    return ensemble.hybrid_join(sp.drop("topic"), bt.drop("topic"))


def _hybrid(spark, sf_dir):
    matched = ensemble.hybrid_rows(frames.predictions(spark, sf_dir), "speed", "batch")
    epochs = matched.withColumn("epoch_id", frames.epoch_of("TS"))
    rated = ensemble.attach_hybrid_scores(epochs, ["epoch_id"], [SERIES, "TS"], latency=0.25)
    return rated.withColumns({c: F.round(c, 6) for c in ("Wt_RMSE", "Wt_MAE")})


HYBRID_SQL = with_(*PREDICTED, MATCHED, HYBRID)


@query(HYBRID_SQL + f"SELECT series_key, epoch_id, {', '.join(HYBRID_FIELDS)} FROM hybrid")
def weighted_ensemble(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(
    with_(*PREDICTED, MATCHED)
    + "SELECT epoch_id, "
    + ", ".join(
        f"round(sqrt(avg(({c} - RT_Temp) ** 2)), 6) AS {p}_RMSE, round(avg(abs({c} - RT_Temp)), 6) AS {p}_MAE"
        for p, c in (("Wt", "Wt_Temp"), ("Speed_Matched", "Speed_RT_Temp"), ("Batch_Matched", "Batch_RT_Temp"))
    )
    + ", count(*) AS n FROM matched GROUP BY 1"
)
def ensemble_scores(spark, sf_dir):
    """Ensemble and layer errors on the same rows, per epoch."""
    matched = ensemble.hybrid_rows(frames.predictions(spark, sf_dir), "speed", "batch")
    scores = ensemble.hybrid_scores(matched.withColumn("epoch_id", frames.epoch_of("TS")), ["epoch_id"])
    return scores.withColumns({c: F.round(c, 6) for c in scores.columns if c not in ("epoch_id", "n")})


@query(with_(*RAW) + f"SELECT topic, {SCORES} FROM raw GROUP BY 1")
def layer_metrics(spark, sf_dir):
    return metrics.regression_metrics(frames.raw_predictions(spark, sf_dir), "Temp", "Temp_Predict", ["topic"])


@query(with_(*RAW) + f"SELECT topic, {_window('TS', 7 * 86400)} AS window_start, {SCORES} FROM raw GROUP BY ALL")
def windowed_metrics(spark, sf_dir):
    rows = frames.raw_predictions(spark, sf_dir)
    return metrics.windowed(rows, "TS", "Temp", "Temp_Predict", "7 days", ["topic"])


@query(
    f"""WITH e AS (SELECT event_type, {_window('ts', 60)} AS window_start, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
SELECT event_type, window_start, count(*) AS n, sum(cents) AS cents FROM e GROUP BY ALL"""
)
def minute_windows(spark, sf_dir):
    """The 60-second windows that stand for one micro-batch each."""
    events = metrics.with_window(frames.table(spark, sf_dir, "events"), "ts", "60 seconds")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events.groupBy("event_type", "window_start").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


@query(
    with_(*PREDICTED)
    + 'SELECT series_key, topic, "offset", epoch_id, TS, Temp, Temp_Predict, RMSE_Score, MAE_Score, MSE_Score FROM pred'
)
def attach_scores(spark, sf_dir):
    rows = frames.raw_predictions(spark, sf_dir)
    return metrics.attach_scores(rows, "Temp", "Temp_Predict", ["topic", "epoch_id"], ["offset"])


@query(
    with_(
        RECORDS,
        LAGGED,
        """found AS (SELECT Ot_avg, arg_min(l1, "offset") AS Temp_Predict, count(*) AS matches
  FROM lagged WHERE nth > 1 GROUP BY 1)""",
    )
    + 'SELECT series_key, Date_time, "offset", l.Ot_avg, Temp_Predict, matches FROM lagged l JOIN found USING (Ot_avg) WHERE nth > 1'
)
def attach_by_label(spark, sf_dir):
    raw = frames.raw_predictions(spark, sf_dir).where("topic = 'speed'")
    rows = raw.select(SERIES, F.col("TS").alias(TIME), "offset", F.col("Temp").alias(LABEL), "Temp_Predict")
    return scoring.attach_by_label(rows, LABEL, "Temp_Predict", "offset")


# Both layers on one row: the series' own last value and the mean of its last two.
PAIRED = """paired AS (
  SELECT series_key, Date_time AS TS, "offset", Ot_avg AS y, l1 AS s, (l1 + l2) / 2 AS b FROM lagged WHERE nth > 2)"""
SHARE = "CASE WHEN {den} > 0 THEN least(1, greatest(0, {num} / {den})) ELSE 0.5 END"


def _paired(spark, sf_dir):
    raw = frames.raw_predictions(spark, sf_dir)
    matched = ensemble.match_layers(
        raw, "speed", "batch", keys=(SERIES, "offset"), carried=("Temp", "Temp_Predict"), offset="epoch_id"
    )
    return matched.select(
        SERIES,
        "TS",
        "offset",
        F.col("sp_Temp").alias("y"),
        F.col("sp_Temp_Predict").alias("s"),
        F.col("bt_Temp_Predict").alias("b"),
    )


@query(
    with_(
        RECORDS,
        LAGGED,
        PAIRED,
        """sums AS (SELECT series_key, sum((y - b) * (s - b)) AS num, sum((s - b) * (s - b)) AS den, count(*) AS n
  FROM paired GROUP BY 1)""",
    )
    + f"""SELECT series_key, round({SHARE.format(num='num', den='den')}, 9) AS speed_weight,
  round(1 - {SHARE.format(num='num', den='den')}, 9) AS batch_weight, n FROM sums"""
)
def best_weights_rmse(spark, sf_dir):
    best = ensemble.best_weights(_paired(spark, sf_dir), "y", "s", "b", by=[SERIES])
    return best.withColumns({c: F.round(c, 9) for c in ("speed_weight", "batch_weight")})


@query(
    with_(
        RECORDS,
        LAGGED,
        PAIRED,
        """grid AS (SELECT series_key, k, avg(abs(y - ((k / 20.0::DOUBLE) * s + (1 - k / 20.0::DOUBLE) * b))) AS mae,
    count(*) AS n FROM paired, range(21) g(k) GROUP BY ALL)""",
    )
    + """SELECT series_key, round(k / 20.0::DOUBLE, 6) AS speed_weight, round(1 - k / 20.0::DOUBLE, 6) AS batch_weight,
  round(mae, 6) AS mae, n FROM grid QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY round(mae, 9), k) = 1"""
)
def best_weights_mae_grid(spark, sf_dir):
    best = ensemble.best_weights(_paired(spark, sf_dir), "y", "s", "b", metric="mae", by=[SERIES])
    return best.withColumns({c: F.round(c, 6) for c in ("speed_weight", "batch_weight", "mae")})


@query(
    with_(
        RECORDS,
        LAGGED,
        PAIRED,
        """shares AS (SELECT series_key, least(1, greatest(0, (y - b) / (s - b))) AS v, sum(abs(s - b)) AS w FROM paired
  WHERE s <> b GROUP BY 1, 2)""",
        """summed AS (SELECT series_key, v, sum(w) OVER (PARTITION BY series_key ORDER BY v) AS upto,
    sum(w) OVER (PARTITION BY series_key) AS total FROM shares)""",
        "medians AS (SELECT series_key, min(v) AS share FROM summed WHERE upto >= total / 2 GROUP BY 1)",
    )
    + """SELECT series_key, round(coalesce(any_value(share), 0.5), 9) AS speed_weight,
  round(1 - coalesce(any_value(share), 0.5), 9) AS batch_weight, count(*) AS n
FROM paired LEFT JOIN medians USING (series_key) GROUP BY 1"""
)
def best_weights_mae_exact(spark, sf_dir):
    """The weight of least absolute error as a weighted median, found by narrowing bins."""
    best = ensemble.best_weights_exact(_paired(spark, sf_dir), "y", "s", "b", by=[SERIES])
    return best.withColumns({c: F.round(c, 9) for c in ("speed_weight", "batch_weight")})


DYNAMIC = [
    RECORDS,
    LAGGED,
    PAIRED,
    f"""sums AS (SELECT series_key, {_window('TS', 28 * 86400)} AS window_start, sum((y - b) * (s - b)) AS num,
    sum((s - b) * (s - b)) AS den, count(*) AS n FROM paired GROUP BY ALL)""",
    f"""weights AS (SELECT series_key, window_start, n,
    {SHARE.format(num='lag(num) OVER w', den='lag(den) OVER w')} AS speed_weight
  FROM sums WINDOW w AS (PARTITION BY series_key ORDER BY window_start))""",
]


@query(
    with_(*DYNAMIC)
    + """SELECT series_key, window_start, round(speed_weight, 9) AS speed_weight,
  round(1 - speed_weight, 9) AS batch_weight, n FROM weights"""
)
def dynamic_weights(spark, sf_dir):
    weights = ensemble.dynamic_weights(_paired(spark, sf_dir), "y", "s", "b", width="28 days")
    return weights.withColumns({c: F.round(c, 9) for c in ("speed_weight", "batch_weight")})


@query(
    with_(*DYNAMIC)
    + f"""SELECT p.series_key, TS, "offset", y, round(speed_weight * s + (1 - speed_weight) * b, 6) AS Wt_Temp
FROM paired p JOIN weights w ON p.series_key = w.series_key AND w.window_start = {_window('TS', 28 * 86400)}"""
)
def dynamic_ensemble(spark, sf_dir):
    rows = ensemble.dynamic_ensemble(_paired(spark, sf_dir), "y", "s", "b", ["offset"], width="28 days")
    return rows.select(SERIES, "TS", "offset", "y", F.round("Wt_Temp", 6).alias("Wt_Temp"))


KPI_SHOWN = [f"{p}_{m}" for m in ("Latency", "RMSE", "MAE") for p in ("Speed", "Batch", "Wt")]


@query(
    HYBRID_SQL
    + "SELECT epoch_id AS Epoch_Id, count(*) AS Record_Num, "
    + ", ".join(f"arg_min({c}, (TS, series_key)) AS {c}" for c in KPI_SHOWN)
    + ", round(avg(Speed_RMSE), 6) AS Speed_RMSE_Mean, round(avg(Batch_RMSE), 6) AS Batch_RMSE_Mean FROM hybrid GROUP BY 1"
)
def kpi_rollup(spark, sf_dir):
    rows = kpi.rollup(_hybrid(spark, sf_dir), order=("TS", SERIES)).drop("MQTT_Publish_Time")
    return rows.withColumns({c: F.round(c, 6) for c in ("Speed_RMSE_Mean", "Batch_RMSE_Mean")})


@query(
    HYBRID_SQL
    + "SELECT CAST(epoch_id AS VARCHAR) AS Epoch_Id, CAST(count(*) AS VARCHAR) AS Record_Num, "
    + ", ".join(f"round(arg_min({c}, (TS, series_key)), 6) AS {c}" for c in KPI_SHOWN)
    + ", CAST(5 AS DOUBLE) AS MQTT_Publish_Time FROM hybrid GROUP BY epoch_id"
)
def kpi_messages(spark, sf_dir):
    """JSON messages, whose values are all strings, read back."""
    rolled = kpi.rollup(_hybrid(spark, sf_dir), order=("TS", SERIES), publish_time=F.lit(5.0))
    schema = ", ".join(f"{c} string" for c in KPI_FIELDS)
    back = sinks.kpi_message(rolled).select(F.from_json("value", schema).alias("m")).select("m.*")
    return back.select(*KPI_FIELDS[:2], *[F.round(F.col(c).cast("double"), 6).alias(c) for c in KPI_FIELDS[2:]])


REPORT = [
    *PREDICTED,
    MATCHED,
    HYBRID,
    f"""clean AS (SELECT * FROM hybrid
  QUALIFY row_number() OVER (PARTITION BY series_key, TS ORDER BY {', '.join(c for c in HYBRID_FIELDS if c != 'TS')}) = 1)""",
    """spans AS (SELECT *, greatest(Speed_Latency_End, Batch_Latency_End) AS End_time,
    least(Speed_Latency_Start, Batch_Latency_Start) AS Start_time FROM clean)""",
    "timed AS (SELECT *, End_time - Start_time + Wt_Latency AS Total_Latency FROM spans)",
    f"""windows AS (SELECT {', '.join(report.WINDOW_METRICS)}, count(*) AS counts FROM timed GROUP BY ALL)""",
    """win AS (SELECT windows.*, f.TS FROM windows
  LEFT JOIN (SELECT Total_Latency, min(TS) AS TS FROM timed GROUP BY 1) f
    ON windows.Total_Latency IS NOT DISTINCT FROM f.Total_Latency)""",
    """tps AS (SELECT *, """
    + ", ".join(f"counts / nullif({p}_Latency, 0) AS {p}_TPS" for p in ("Speed", "Batch", "Wt", "Total"))
    + " FROM win)",
]


@query(with_(*REPORT) + f"SELECT series_key, {', '.join(HYBRID_FIELDS)}, End_time, Start_time, Total_Latency FROM timed")
def total_latency(spark, sf_dir):
    rows = _hybrid(spark, sf_dir).drop("epoch_id")
    return report.total_latency(report.clean_results(rows))


@query(with_(*REPORT) + "SELECT * FROM win")
def window_report(spark, sf_dir):
    rows = _hybrid(spark, sf_dir).drop("epoch_id")
    return report.window_report(report.total_latency(report.clean_results(rows)))


@query(with_(*REPORT) + "SELECT * FROM tps")
def throughput_report(spark, sf_dir):
    return report.build(_hybrid(spark, sf_dir).drop("epoch_id"))


SUMMARY = [*report.WINDOW_METRICS, "Speed_TPS", "Batch_TPS", "Wt_TPS", "Total_TPS"]


@query(
    with_(*REPORT)
    + "SELECT count(*) AS windows, CAST(sum(counts) AS BIGINT) AS records, "
    + ", ".join(f"{half_up(f'avg({c})', 3)} AS mean_{c}" for c in SUMMARY)
    + " FROM tps"
)
def report_summary(spark, sf_dir):
    return report.summary(report.build(_hybrid(spark, sf_dir).drop("epoch_id")))


@query(HYBRID_SQL + f"SELECT series_key, epoch_id % 2 AS epoch_id, {', '.join(HYBRID_FIELDS)} FROM hybrid")
def hybrid_results_csv(spark, sf_dir):
    """Result rows written as CSV per part and read back as one table."""
    path = scratch.new_dir(spark, "hybrid")
    rows = _hybrid(spark, sf_dir)  # a written table joined with few scores: cheaper to read for each part than to write once more
    for epoch_id, odd in enumerate((False, True)):
        sinks.write_hybrid(rows.where((F.col("epoch_id") % 2 == 1) == F.lit(odd)), path, epoch_id)
    back = readers.hybrid_results(spark, path)
    return back.withColumns({"TS": F.col("TS").cast("timestamp_ntz"), "epoch_id": F.col("epoch_id").cast("bigint")})


@query(
    HYBRID_SQL
    + """SELECT series_key, TS, RT_Temp, Wt_Temp FROM hybrid WHERE epoch_id % 2 = 0
UNION ALL SELECT series_key, TS, RT_Temp, NULL FROM hybrid WHERE epoch_id % 2 = 1"""
)
def union_results(spark, sf_dir):
    """Result tables with different columns appended into one."""
    rows = scratch.materialise(_hybrid(spark, sf_dir).select(SERIES, "epoch_id", "TS", "RT_Temp", "Wt_Temp"))
    even, odd = rows.where("epoch_id % 2 = 0"), rows.where("epoch_id % 2 = 1").drop("Wt_Temp")
    return report.union_results(even, odd).drop("epoch_id")
