"""The streaming queries: scoring layers, ensemble, carried history, retraining."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Sequence
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from duotide import scratch
from duotide.functions import codec
from duotide.operators import ensemble, features, metrics, model, registry, scoring, skew
from duotide.plans import kpi
from duotide.schemas import BATCH_WEIGHT, HYBRID_FIELDS, LABEL, PREDICTION_FIELDS, SENSORS, SERIES, SPEED_WEIGHT, TIME
from duotide.sources import sinks
from duotide.streaming import state

OnBatch = Callable[[DataFrame, int], None]
WEIGHTS_SCHEMA = "speed_weight double, batch_weight double, n long, epoch_id long"


def _tidy(on_batch: OnBatch) -> OnBatch:
    """Drop the intermediate tables of each micro-batch once it is done."""

    @wraps(on_batch)
    def tidied(records: DataFrame, epoch_id: int) -> None:
        with scratch.scope(records.sparkSession):
            on_batch(records, epoch_id)

    return tidied


def run_query(
    stream: DataFrame, on_batch: OnBatch, checkpoint: str, seconds: int | None = None, wait: bool = True
) -> StreamingQuery:
    """Run ``on_batch`` per micro-batch, every ``seconds`` or over what is there now.

    The checkpoint folder is required: a restart goes on where the query stopped.
    """
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    query = writer.start()
    if wait:
        query.awaitTermination()
    return query


def sensor_rows(records: DataFrame, on_error: str = "null") -> DataFrame:
    """Topic records as sensor rows with series key and offset.

    A damaged record keeps its place, with NULL in the fields that cannot be read;
    ``drop`` leaves it out, so that the next record's lags reach over it.
    """
    keep = [F.col("key").cast("string").alias(SERIES), F.col("offset")]
    return codec.decode_sensor(records, keep, on_error)


def prediction_rows(records: DataFrame, on_error: str = "drop") -> DataFrame:
    keep = [F.col("key").cast("string").alias(SERIES), F.col("offset"), F.col("topic")]
    return codec.decode_prediction(records, keep, on_error)


def scoring_layer(
    layer: str,
    weights_of: Callable[[], tuple[str, Sequence[float]]] | None,
    target: dict,
    p: int = 2,
    kind: str = "var",
    clock: Callable[[], float] = time.time,
    on_error: str = "null",
    counts: str | None = None,
    cols: Sequence[str] = SENSORS,
    models_of: Callable[[int], DataFrame | None] | None = None,
    lagged: tuple[DataFrame, DataFrame] | None = None,
    **layout,
) -> OnBatch:
    """Score each micro-batch with the model current at its start.

    ``weights_of`` returns version and weights, or None while there is no model, and
    is called once per micro-batch, so all its rows carry predictions of one model.
    History starts anew in every batch; see :func:`carried_lags` for the alternative.
    A row that is damaged, or whose history is, has no prediction and is not sent;
    ``counts`` names a folder for how many records came, were damaged and were scored,
    and how many had a history but no model.

    ``models_of`` takes the place of ``weights_of`` for a ``var`` model per series: the
    registry rows for an epoch, as :func:`registry.snapshot` gives them. ``lagged`` are the
    batch's :func:`lagged_rows`, where a chain has persisted them for all its steps.
    """

    @_tidy
    def on_batch(records: DataFrame, epoch_id: int) -> None:
        start = clock()
        # decoded once: the lags, the count and the scores all read the same rows
        rows = lagged[0] if lagged else sensor_rows(records, on_error).persist()
        current = models_of(epoch_id) if models_of else weights_of()
        if current is None or rows.isEmpty():
            if not lagged:
                rows.unpersist()
            return
        names = features.lag_names(p, cols)
        past = lagged[1] if lagged else features.add_lags(rows, p, cols, order=(TIME, "offset"), **layout)
        if models_of:
            scored = scoring.score_by_series(past, names, current, ["offset"], out="Temp_Predict", keep=["model_version"])
        else:
            scored = scoring.score(past, names, current[1], kind, out="Temp_Predict").withColumn("model_version", F.lit(current[0]))
        usable = [F.col(c).isNotNull() for c in (LABEL, TIME, *[f"`{n}`" for n in names])]
        scored = scored.where(reduce(lambda a, b: a & b, usable))
        if models_of or not lagged:  # one model's weights are quicker applied again
            scored = scored.persist()
        try:
            if counts:
                damaged = F.count(F.when(F.greatest(*[F.col(c).isNull() for c in (TIME, *SENSORS)]), 1))
                seen = rows.agg(F.count("*").alias("records"), damaged.alias("damaged"))
                done = scored.agg(F.count("Temp_Predict").alias("scored"), F.count_if(F.col("model_version").isNull()).alias("without_model")).first()
                sinks.to_folder(seen.withColumns({k: F.lit(v) for k, v in done.asDict().items()}), counts, epoch_id)  # one row
            scores = metrics.regression_metrics(scored, LABEL, "Temp_Predict").first()  # one row
            if not scores["n"]:
                return
            rated = scored.where(F.col("Temp_Predict").isNotNull()).select(
                F.col(SERIES).alias("key"),
                "offset",
                F.lit(layer).alias("topic"),
                "model_version",
                F.col(TIME).alias("TS"),
                F.col(LABEL).alias("Temp"),
                "Temp_Predict",
                F.lit(scores["rmse"]).alias("RMSE_Score"),
                F.lit(scores["mae"]).alias("MAE_Score"),
                F.lit(scores["mse"]).alias("MSE_Score"),
            )
            stamped = metrics.stamp_latency(rated, start, clock())
            keep = ("key", "offset", "topic", "model_version")
            sinks.write_predictions(codec.encode_prediction(stamped, keep), target, epoch_id)
        finally:
            if models_of or not lagged:
                scored.unpersist()
            if not lagged:
                rows.unpersist()

    return on_batch


def lagged_rows(records: DataFrame, p: int, cols: Sequence[str], on_error: str = "null") -> tuple[DataFrame, DataFrame]:
    """A batch's sensor rows, and those with a history with their lags; both persisted."""
    rows = sensor_rows(records, on_error).persist()
    return rows, features.add_lags(rows, p, cols, order=(TIME, "offset")).persist()


def hybrid_layer(
    speed: str,
    batch: str,
    rows_path: str,
    kpi_target: dict,
    speed_weight: float = SPEED_WEIGHT,
    batch_weight: float = BATCH_WEIGHT,
    format: str = "csv",
    clock: Callable[[], float] = time.time,
    weights_path: str | None = None,
    counts: str | None = None,
) -> OnBatch:
    """Match and combine the predictions that arrive in one micro-batch.

    With ``weights_path``, the weights of a batch are those that would have been best
    on the batch before it; the fixed ones only stand in until there is one. A
    prediction that cannot be read matches nothing; ``counts`` names a folder for how
    many came and were unreadable.
    """

    @_tidy
    def on_batch(records: DataFrame, epoch_id: int) -> None:
        start = clock()
        predictions = prediction_rows(records)
        if counts:
            every = prediction_rows(records, on_error="null")
            damaged = F.count(F.when(F.greatest(*[F.col(c).isNull() for c in PREDICTION_FIELDS]), 1))
            sinks.to_folder(every.agg(F.count("*").alias("records"), damaged.alias("damaged")), counts, epoch_id)
        shares = learnt_weights(records.sparkSession, weights_path, epoch_id) if weights_path else None
        sp, bt = shares or (speed_weight, batch_weight)
        rows = ensemble.hybrid_rows(predictions, speed, batch, sp, bt).persist()
        try:
            scores = ensemble.hybrid_scores(rows).first()  # one row
            if not scores["n"]:
                return
            rated = rows.withColumns(
                {
                    "Wt_RMSE": F.lit(scores["Wt_RMSE"]),
                    "Wt_MAE": F.lit(scores["Wt_MAE"]),
                    "Wt_Latency": F.lit(clock() - start),
                }
            )
            sinks.write_hybrid(rated, rows_path, epoch_id, format)
            if weights_path:
                best = ensemble.best_weights(rows, "RT_Temp", "Speed_RT_Temp", "Batch_RT_Temp")
                sinks.to_folder(best, weights_path, epoch_id)
            message = kpi.of_epoch(rated, epoch_id, order=("TS", SERIES), publish_time=F.lit(clock()), complete=HYBRID_FIELDS)
            sinks.write_kpi(message, kpi_target, epoch_id)
        finally:
            rows.unpersist()

    return on_batch


def learnt_weights(spark: SparkSession, path: str, epoch_id: int) -> tuple[float, float] | None:
    """Speed and batch weights learnt on the last epoch before this one, if any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema(WEIGHTS_SCHEMA).parquet(path).where(F.col("epoch_id") < epoch_id)
    row = rows.orderBy(F.desc("epoch_id")).first()  # one row an epoch
    return (row["speed_weight"], row["batch_weight"]) if row else None


def hybrid_join_stream(
    records: DataFrame,
    speed: str,
    batch: str,
    delay: str = "10 minutes",
    speed_weight: float = SPEED_WEIGHT,
    batch_weight: float = BATCH_WEIGHT,
) -> DataFrame:
    """Matched rows as a stream; the two layers may arrive in different micro-batches.

    A match is sent at once. The watermark bounds how long an unmatched or duplicate time
    is remembered. Of copies in one micro-batch any may survive; where that matters, use
    :func:`hybrid_match_stream`.
    """
    sides = []
    for topic, prefix in ((speed, "sp_"), (batch, "bt_")):
        rows = prediction_rows(records.where(F.col("topic") == topic)).drop("topic", "offset")
        once = rows.withWatermark("TS", delay).dropDuplicatesWithinWatermark([SERIES, "TS"])
        sides.append(once.select(*[F.col(c).alias(prefix + c) for c in once.columns]))
    sp, bt = sides
    joined = sp.join(bt, (F.col(f"sp_{SERIES}") == F.col(f"bt_{SERIES}")) & (F.col("sp_TS") == F.col("bt_TS")))
    keyed = joined.withColumnRenamed(f"sp_{SERIES}", SERIES)
    return ensemble.project_hybrid(keyed, speed_weight, batch_weight, time="sp_TS")


def hybrid_match_stream(
    records: DataFrame,
    speed: str,
    batch: str,
    delay: str = "10 minutes",
    speed_weight: float = SPEED_WEIGHT,
    batch_weight: float = BATCH_WEIGHT,
    span: int = 3600,
) -> DataFrame:
    """Matched rows as a stream, with a defined survivor among copies.

    The lowest offset of each layer, series and time counts, whenever it comes within
    ``delay``; a match is sent once the watermark has passed its time (see
    :func:`state.match_stream`; ``span``, how many seconds one state row held, has no effect
    any more). Every micro-batch observes, as ``predictions``, how many records came and how
    many of them could not be read and so match nothing.
    """
    predictions = prediction_rows(records, on_error="null")
    unreadable = F.count_if(F.greatest(*[F.col(c).isNull() for c in PREDICTION_FIELDS]))
    predictions = predictions.observe("predictions", F.count(F.lit(1)).alias("records"), unreadable.alias("damaged"))
    whole = predictions.dropna("any", subset=PREDICTION_FIELDS)
    matched = state.match_stream(whole, speed, batch, PREDICTION_FIELDS[1:], delay)
    return ensemble.project_hybrid(matched, speed_weight, batch_weight)


def carried_lags(
    state: str,
    write: OnBatch,
    p: int = 2,
    cols: Sequence[str] = SENSORS,
    keys: Sequence[str] = (SERIES,),
    order: Sequence[str] = (TIME, "offset"),
    decode: Callable[[DataFrame], DataFrame] = sensor_rows,
    **layout,
) -> OnBatch:
    """Lag features whose history goes on from one micro-batch to the next.

    The last ``p`` rows of every series are kept as a small table per epoch and
    put in front of the next batch. The lags themselves come from the batch
    operator, which also splits a series that dominates the batch. ``const`` is
    1 where ``p`` earlier rows were known. A row that is not newer than what was
    kept of its series comes too late for lags: it is flagged ``late``, has no history
    (``const`` 0, lags 0) and is in no other row's.
    """
    names = features.lag_names(p, cols)

    @_tidy
    def on_batch(records: DataFrame, epoch_id: int) -> None:
        rows = decode(records).withColumns({"_fresh": F.lit(True), "late": F.lit(False)})
        if epoch_id > 0:
            spark = records.sparkSession
            before = spark.read.schema(rows.schema).parquet(f"{state}/epoch_id={epoch_id - 1}")
            newest = before.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_newest"))
            known = skew.on_keys(rows, newest, keys, "left")
            rows = known.withColumn("late", F.coalesce(F.struct(*order) <= F.col("_newest"), F.lit(False))).drop("_newest")
            rows = rows.unionByName(before.withColumn("_fresh", F.lit(False)))
        rows = rows.persist()
        try:
            on_time = rows.where(~F.col("late"))
            lagged = features.add_lags(on_time, p, cols, keys, order, const=True, drop_warmup=False, **layout)
            late = rows.where("late").withColumns({n: F.lit(0.0) for n in names} | {"const": F.lit(0)})
            write(lagged.where("_fresh").unionByName(late).drop("_fresh"), epoch_id)
            last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
            # the limit is applied per input partition before the shuffle
            tail = on_time.withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") <= p).drop("_nth")
            sinks.to_folder(tail, state, epoch_id)
            if epoch_id > 1:  # a retry of the next epoch needs this one only
                scratch.delete(records.sparkSession, f"{state}/epoch_id={epoch_id - 2}")
        finally:
            rows.unpersist()

    return on_batch


def retraining(
    registry_path: str,
    layer: str = "speed",
    kind: str = "var",
    p: int = 2,
    cols: Sequence[str] = SENSORS,
    by: Sequence[str] = (),
    on_error: str = "null",
    lagged: tuple[DataFrame, DataFrame] | None = None,
    **options,
) -> OnBatch:
    """Train on each recent window of rows and publish: one model, or one per ``by``.

    Rows that are damaged, or whose history is, keep their place but are not learnt from.
    ``lagged`` are the batch's :func:`lagged_rows`, where there are some.
    """

    @_tidy
    def on_batch(records: DataFrame, epoch_id: int) -> None:
        rows = lagged[0] if lagged else sensor_rows(records, on_error)
        span = rows.agg(F.min(TIME).alias("low"), F.max(TIME).alias("high")).first()  # one row
        if span["low"] is None:
            return
        past = lagged[1] if lagged else features.add_lags(rows, p, cols, order=(TIME, "offset"))
        fitted = model.train(past, features.lag_names(p, cols), kind=kind, by=by, **options)
        low, high = str(span["low"]), str(span["high"])
        version = registry.version_name(*(s.replace(" ", "T").replace(":", "") for s in (low, high)))
        version = f"{version}-{epoch_id}"
        registry.publish(fitted, registry_path, layer, kind, version, low, high)
        registry.commit(records.sparkSession, registry_path, version, epoch_id)

    return on_batch


def refreshed(spark: SparkSession, registry_path: str, layer: str) -> Callable[[], tuple[str, Sequence[float]] | None]:
    """The newest model of a layer whenever it is asked for; None before the first."""

    def weights_of():
        folder = spark._jvm.org.apache.hadoop.fs.Path(registry_path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        row = registry.latest_weights(spark, registry_path, layer)
        return (row["model_version"], row["weights"]) if row else None

    return weights_of


def _only(models_of: Callable[..., DataFrame | None], epoch_id: int) -> tuple[str, Sequence[float]] | None:
    """Version and weights of the one model of a layer that is not kept per series."""
    models = models_of(epoch_id)
    row = models.first() if models is not None else None  # one row
    return (row["model_version"], row["weights"]) if row else None


def two_layer(
    registry_path: str,
    predictions: str,
    rows_path: str,
    kpi_target: dict,
    weights_path: str,
    p: int = 2,
    cols: Sequence[str] = SENSORS,
    clock: Callable[[], float] = time.time,
    by: Sequence[str] = (),
) -> OnBatch:
    """The whole chain on each micro-batch of sensor records.

    Models are refreshed from the registry, both layers score, their predictions are
    matched and combined with the weights learnt so far, the KPI row is sent, and the
    batch retrains the speed model. The first batch stands for history and trains both.
    There is one model a layer, or one ``by`` series. An epoch uses what epochs before
    it published, so repeating it after it has published gives the same predictions.
    Records are decoded and given their lags once, for both layers and the training.
    """

    @_tidy
    def on_batch(records: DataFrame, epoch_id: int) -> None:
        spark = records.sparkSession
        lagged = lagged_rows(records, p, cols)
        try:
            for layer in ("speed", "batch"):
                own = functools.partial(registry.snapshot, spark, f"{registry_path}/{layer}", layer)
                current = {"models_of": own} if by else {"weights_of": functools.partial(_only, own, epoch_id)}
                target = {"path": f"{predictions}/{layer}"}
                scoring_layer(layer, current.pop("weights_of", None), target, p, clock=clock, cols=cols, lagged=lagged, **current)(records, epoch_id)
            if epoch_id > 0:
                sent = [spark.read.parquet(f"{predictions}/{layer}/epoch_id={epoch_id}") for layer in ("speed", "batch")]
                hybrid_layer("speed", "batch", rows_path, kpi_target, format="parquet", clock=clock, weights_path=weights_path)(
                    sent[0].unionByName(sent[1]), epoch_id
                )
            for layer in ("speed", "batch") if epoch_id == 0 else ("speed",):
                retraining(f"{registry_path}/{layer}", layer, p=p, cols=cols, by=by, lagged=lagged)(records, epoch_id)
        finally:
            for table in lagged:
                table.unpersist()

    return on_batch


def publishing(archive: str, rows_per_message: int = codec.ROWS_PER_MESSAGE) -> OnBatch:
    """Archive each micro-batch as columnar JSON messages for retraining."""

    @_tidy
    def on_batch(records: DataFrame, epoch_id: int) -> None:
        rows = sensor_rows(records, on_error="null")
        if rows.isEmpty():
            return
        messages = codec.frame_columnar_json(rows, rows_per_message)
        sinks.to_folder(messages.select("value"), archive, epoch_id, "text")

    return on_batch
