"""Calendar features of a date column, as columns and as ML transformers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotide.operators import features

# The first week and the last days of a month, Saturday and Sunday.
MONTH_BEGIN_LAST_DAY = 7
MONTH_END_FIRST_DAY = 24
WEEKEND_DAYS = (5, 6)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def weekend(weekday: Column) -> Column:
    return _flag(weekday.isin(*WEEKEND_DAYS))


def month_begin(day: Column) -> Column:
    return _flag(day <= MONTH_BEGIN_LAST_DAY)


def month_end(day: Column) -> Column:
    return _flag(day >= MONTH_END_FIRST_DAY)


def year_quarter(month: Column) -> Column:
    """0 to 3; a missing month counts as the last quarter."""
    return F.coalesce(F.floor((month - 1) / 3).cast("int"), F.lit(3))


def add_calendar(df: DataFrame, time: str = "Date_time", only: Sequence[str] | None = None) -> DataFrame:
    """All calendar columns of ``time`` in one projection, without a Python UDF."""
    date = F.to_date(time)
    day, month, weekday = F.dayofmonth(date), F.month(date), F.weekday(date)
    made = {
        "date": date,
        "day": day,
        "month": month,
        "year": F.year(date),
        "weekday": weekday,
        "weekend": weekend(weekday),
        "monthbegin": month_begin(day),
        "monthend": month_end(day),
        "yearquarter": year_quarter(month),
    }
    return df.withColumns({name: made[name] for name in (only or made)})


class _ColumnStage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """One input column of a required type to one output column."""

    accepts: type[T.DataType] = T.DateType
    defaults: dict[str, str] = {}

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._setDefault(**self.defaults)
        self._set(**self._input_kwargs)

    def expression(self, col: Column) -> Column:
        raise NotImplementedError

    def check_input_type(self, schema: T.StructType) -> None:
        found = schema[self.getInputCol()].dataType
        if not isinstance(found, self.accepts):
            raise TypeError(f"{type(self).__name__} needs {self.accepts.__name__}, {self.getInputCol()} is {found}")

    def _transform(self, df: DataFrame) -> DataFrame:
        self.check_input_type(df.schema)
        return df.withColumn(self.getOutputCol(), self.expression(F.col(self.getInputCol())))


class DateConverter(_ColumnStage):
    accepts = T.TimestampType

    def expression(self, col):
        return F.to_date(col)


class DayExtractor(_ColumnStage):
    defaults = {"outputCol": "day"}

    def expression(self, col):
        return F.dayofmonth(col)


class MonthExtractor(_ColumnStage):
    defaults = {"outputCol": "month"}

    def expression(self, col):
        return F.month(col)


class YearExtractor(_ColumnStage):
    defaults = {"outputCol": "year"}

    def expression(self, col):
        return F.year(col)


class WeekDayExtractor(_ColumnStage):
    defaults = {"outputCol": "weekday"}

    def expression(self, col):
        return F.weekday(col)


class WeekendExtractor(_ColumnStage):
    accepts = T.IntegerType
    defaults = {"inputCol": "weekday", "outputCol": "weekend"}

    def expression(self, col):
        return weekend(col)


class MonthBeginExtractor(_ColumnStage):
    accepts = T.IntegerType
    defaults = {"inputCol": "day", "outputCol": "monthbegin"}

    def expression(self, col):
        return month_begin(col)


class MonthEndExtractor(_ColumnStage):
    accepts = T.IntegerType
    defaults = {"inputCol": "day", "outputCol": "monthend"}

    def expression(self, col):
        return month_end(col)


class YearQuarterExtractor(_ColumnStage):
    accepts = T.IntegerType
    defaults = {"inputCol": "month", "outputCol": "yearquarter"}

    def expression(self, col):
        return year_quarter(col)


class SerieMaker(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Array of the last ``serieSize`` values, the count of padded places and the rank by date."""

    dateCol = Param(Params._dummy(), "dateCol", "order column", typeConverter=TypeConverters.toString)
    serieSize = Param(Params._dummy(), "serieSize", "values per array", typeConverter=TypeConverters.toInt)
    keyCols = Param(Params._dummy(), "keyCols", "series key columns", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, dateCol=None, serieSize=None, keyCols=None):
        super().__init__()
        self._setDefault(inputCol="scaledFeatures", outputCol="serie", dateCol="Date_time", serieSize=7, keyCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        keys, date = self.getOrDefault(self.keyCols), self.getOrDefault(self.dateCol)
        return features.serie(
            df,
            self.getInputCol(),
            n=self.getOrDefault(self.serieSize),
            keys=keys,
            order=(date,),
            out=self.getOutputCol(),
            rank="rank",
        )
