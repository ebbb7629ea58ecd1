"""SQL building blocks shared by the oracle statements."""

from __future__ import annotations

from duotide.schemas import SENSORS

SPEED, BATCH = "0.3::DOUBLE", "0.7::DOUBLE"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def records(series: str = "'S' || CAST(l_suppkey AS VARCHAR)", name: str = "rec") -> str:
    return f"""{name} AS (
  SELECT {series} AS series_key, l_shipdate AS Date_time,
    (l_orderkey * 8 + l_linenumber) * 1024 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
      l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS "offset",
    l_extendedprice AS Db1t_avg, l_discount AS Db2t_avg, l_tax AS Gb1t_avg,
    CAST(l_linenumber AS DOUBLE) AS Gb2t_avg, l_quantity AS Ot_avg
  FROM lineitem)"""


RECORDS = records()
HOT_RECORDS = records("l_returnflag")

HOURLY = """hourly AS (
  SELECT date_trunc('hour', ts) AS Date_time, """ + ", ".join(
    f"CAST(sum(CASE WHEN event_type = '{kind}' THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE)"
    f" / nullif(100.0::DOUBLE * count(CASE WHEN event_type = '{kind}' THEN 1 END), 0) AS {sensor}"
    for kind, sensor in zip(["click", "error", "purchase", "signup", "view"], SENSORS)
) + """
  FROM events GROUP BY 1)"""


def lags(p: int, cols, partition: str, order: str, default: str = "CAST(0 AS DOUBLE)") -> str:
    over = f"OVER ({partition} ORDER BY {order})"
    return ", ".join(f'lag({c}, {i}, {default}) {over} AS "{c}t-{i}"' for i in range(1, p + 1) for c in cols)


LAGGED = """lagged AS (
  SELECT *, row_number() OVER w AS nth, lag(Ot_avg, 1) OVER w AS l1, lag(Ot_avg, 2) OVER w AS l2
  FROM rec WINDOW w AS (PARTITION BY series_key ORDER BY Date_time, "offset"))"""

RAW_PREDICTIONS = """raw AS MATERIALIZED (
  SELECT *, date_diff('day', DATE '1970-01-01', CAST(TS AS DATE)) // 30 AS epoch_id FROM (
    SELECT series_key, 'speed' AS topic, "offset", Date_time AS TS, Ot_avg AS Temp, l1 AS Temp_Predict
    FROM lagged WHERE nth > 1
    UNION ALL
    SELECT series_key, 'batch', "offset", Date_time, Ot_avg, (l1 + l2) / 2 FROM lagged WHERE nth > 2))"""

PREDICTIONS = """scores AS MATERIALIZED (
  SELECT topic, epoch_id, sqrt(avg((Temp_Predict - Temp) * (Temp_Predict - Temp))) AS RMSE_Score,
    avg(abs(Temp_Predict - Temp)) AS MAE_Score, avg((Temp_Predict - Temp) * (Temp_Predict - Temp)) AS MSE_Score
  FROM raw GROUP BY ALL),
pred AS MATERIALIZED (
  SELECT series_key, topic, "offset", epoch_id, TS, Temp, Temp_Predict, RMSE_Score, MAE_Score, MSE_Score,
    CAST(epoch_id * 60 + CASE topic WHEN 'speed' THEN 0 ELSE 1 END AS DOUBLE) AS Latency_Start,
    CAST(epoch_id * 60 + CASE topic WHEN 'speed' THEN 5 + epoch_id % 7 ELSE 5 + epoch_id % 5 END AS DOUBLE)
      AS Latency_End,
    CAST(CASE topic WHEN 'speed' THEN 5 + epoch_id % 7 ELSE 4 + epoch_id % 5 END AS DOUBLE) AS Latency
  FROM raw JOIN scores USING (topic, epoch_id))"""


def half_up(value: str, digits: int) -> str:
    """Rounding on the printed decimal, as Spark rounds doubles."""
    return f"CAST(ROUND(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def settle(sql: str) -> str:
    """Every two-argument ``round(value, digits)`` as :func:`half_up`.

    The engines round exact halves of doubles differently; on decimals they agree.
    """
    out, at = [], 0
    while (found := sql.find("round(", at)) >= 0:
        depth, comma, end = 1, None, found + len("round(")
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        call = sql[found:end]
        if comma is not None:
            inner = settle(sql[found + len("round(") : comma])
            call = half_up(f"({inner})", int(sql[comma + 1 : end - 1]))
        out += [sql[at:found], call]
        at = end
    return "".join(out) + sql[at:]


def first_of(layer: str, value: str) -> str:
    """A layer's value in its record with the lowest offset, within one series and time."""
    return f"""arg_min({value}, "offset") FILTER (WHERE topic = '{layer}')"""


# The two layers side by side: one group per series and time, no join.
BOTH_LAYERS = """pairs AS MATERIALIZED (
  SELECT series_key, TS, min(epoch_id) AS epoch_id, """ + ", ".join(
    f"{first_of(layer, value)} AS {prefix}_{value}"
    for layer, prefix in (("speed", "sp"), ("batch", "bt"))
    for value in ("Temp", "Temp_Predict", "RMSE_Score", "MAE_Score", "Latency", "Latency_Start", "Latency_End")
) + """
  FROM {source} GROUP BY series_key, TS HAVING bool_or(topic = 'speed') AND bool_or(topic = 'batch'))"""

SHOWN = ", ".join(
    f"{half_up(value, 3)} AS {name}"
    for name, value in {
        "RT_Temp": "sp_Temp",
        "Speed_RT_Temp": "sp_Temp_Predict",
        "Batch_RT_Temp": "bt_Temp_Predict",
        "Wt_Temp": f"({SPEED} * sp_Temp_Predict + {BATCH} * bt_Temp_Predict)",
        "Speed_RMSE": "sp_RMSE_Score",
        "Batch_RMSE": "bt_RMSE_Score",
        "Speed_MAE": "sp_MAE_Score",
        "Batch_MAE": "bt_MAE_Score",
    }.items()
)

MATCHED = BOTH_LAYERS.format(source="pred") + """,
matched AS (
  SELECT series_key, TS, epoch_id, """ + ", ".join(
    f"{prefix}_{stamp} AS {layer}_{stamp}"
    for stamp in ("Latency", "Latency_Start", "Latency_End")
    for layer, prefix in (("Speed", "sp"), ("Batch", "bt"))
) + f""",
    {SHOWN}
  FROM pairs)"""

PREDICTED = [RECORDS, LAGGED, RAW_PREDICTIONS, PREDICTIONS]

HYBRID = """wt AS (
  SELECT epoch_id, sqrt(avg((Wt_Temp - RT_Temp) ** 2)) AS Wt_RMSE, avg(abs(Wt_Temp - RT_Temp)) AS Wt_MAE
  FROM matched GROUP BY 1),
hybrid AS (SELECT m.*, round(Wt_RMSE, 6) AS Wt_RMSE, round(Wt_MAE, 6) AS Wt_MAE, CAST(0.25 AS DOUBLE) AS Wt_Latency
  FROM matched m JOIN wt USING (epoch_id))"""
