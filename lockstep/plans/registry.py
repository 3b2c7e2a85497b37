"""Registered queries: a DataFrame function and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The events of each user in order: place from 1, number of the user's events, microseconds since the first.
EV = """ev AS (
    SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
        count(*) OVER (PARTITION BY user_id) AS n,
        epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS rel
    FROM events)"""

#: Line items as a long score table: subject (supplier), family (return flag), time (month), score (quantity).
SCORES = """scores AS (
    SELECT l_suppkey AS subject, l_returnflag AS family, month(l_shipdate) AS time, year(l_shipdate) AS split,
        l_quantity AS score, l_linestatus = 'F' AS valid FROM lineitem)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if there is any."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def events(spark: SparkSession, folder: str) -> DataFrame:
    """As EV."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    frame = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", us.alias("us"))
    return frame.select("*", F.row_number().over(w.orderBy("us", "event_id")).alias("pos"), F.count("*").over(w).alias("n"), (F.col("us") - F.min("us").over(w)).alias("rel"))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """As SCORES."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("family"), F.month("l_shipdate").alias("time"), F.year("l_shipdate").alias("split"),
        F.col("l_quantity").alias("score"), (F.col("l_linestatus") == "F").alias("valid"),
    )


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})
