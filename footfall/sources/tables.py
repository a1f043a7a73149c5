"""Reading and writing the page view and event tables (Parquet by `dt_date`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.times import day_of
from footfall.schema import EVENT, PAGEVIEW

_DAY = T.StructField("dt_date", T.DateType())


def _stored(layout: T.StructType) -> T.StructType:
    return T.StructType(layout.fields + [_DAY])


def read_pageviews(spark: SparkSession, path: str) -> DataFrame:
    """The fact table with its fixed layout; no schema inference."""
    return spark.read.schema(_stored(PAGEVIEW)).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_stored(EVENT)).parquet(path)


def history(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Live and archived rows as one table."""
    return live.unionByName(archive)


def with_day(df: DataFrame) -> DataFrame:
    return df if "dt_date" in df.columns else df.withColumn("dt_date", day_of("dt"))


def first_day(start: int) -> Column:
    """The day of a second, as a bound for the partition column."""
    return F.to_date(F.timestamp_seconds(F.lit(start)))


def day_range(start: int, end: int) -> Column:
    """Partition predicate that goes with a `dt` range."""
    first = first_day(start)
    last = F.to_date(F.timestamp_seconds(F.lit(end)))
    return F.col("dt_date").between(first, last)


def _by_day(df: DataFrame) -> DataFrame:
    """Rows brought together by day in partitions of even size.

    Rebalancing splits a busy day over as many tasks as its size asks for and
    puts quiet days together.
    """
    return with_day(df).hint("rebalance", "dt_date")


def members_path(path: str) -> str:
    """Where a table's filters of ids lie; readers of the table pass folders with such names."""
    return f"{path}/_members"


def updates_path(path: str) -> str:
    """Where updates of a table wait until they are folded."""
    return f"{path}/_updates"


def append_rows(df: DataFrame, path: str, known: bool = False) -> None:
    """Append to a table by day. Unless the rows' ids are `known` to its filters, these go and are made anew when next asked."""
    if not known:
        drop_path(df.sparkSession, members_path(path))
    _by_day(df).write.mode("append").partitionBy("dt_date").parquet(path)


def replace_days(df: DataFrame, path: str) -> None:
    """Overwrite only the days present in `df`; other days stay."""
    writer = _by_day(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dt_date").parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a write to this path has finished."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def drop_days(spark: SparkSession, path: str, days: list[str]) -> None:
    """Remove whole day partitions (directories) of a table."""
    if not days:
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for day in days:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/dt_date={day}")
        target.getFileSystem(conf).delete(target, True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a finished stage of this library's own."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders inside a folder, in order; none if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(target) if f.isDirectory()) if system.exists(target) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    """What the files below a folder take."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Save the rows of any report; `kind` is csv, json or parquet."""
    options = {"header": "true"} if kind == "csv" else {}
    df.write.mode("errorifexists").format(kind).options(**options).save(path)
