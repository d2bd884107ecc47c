"""Trial, log and signal tables derived from the supplied tables, as FIXTURES.md defines them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per event: session, t, seq, action (1 left, 0 right, null no choice), reward, manual, block, state, correct, valid."""
    return trials_of(table(spark, sf_dir, "events"))


def trials_of(e: DataFrame) -> DataFrame:
    """The same of a table or stream of events."""
    kind, value, t = F.col("event_type"), F.coalesce("value", F.lit(0.0)), F.col("ts").cast("timestamp")
    action = F.when(kind.isin("click", "purchase"), 1).when(kind.isin("view", "signup"), 0)
    e = e.select(
        F.col("user_id").alias("session"), t.alias("t"), F.col("event_id").alias("seq"), action.alias("action"), (value >= 20).cast("int").alias("reward"),
        ((kind == "signup") & (value < 5)).cast("int").alias("manual"), F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).alias("block"),
        (F.dayofmonth(t) % 2).alias("state"),
    )
    e = e.withColumn("correct", (F.col("action") == F.col("state")).cast("int"))
    return e.withColumn("valid", F.col("action").isNotNull() & (F.col("manual") == 0))


#: The same table for the SQL that queries are held against.
TRIALS_SQL = """
trials AS (SELECT *, CAST(action = state AS INTEGER) AS correct, action IS NOT NULL AND manual = 0 AS valid FROM (
  SELECT user_id AS session, ts AS t, event_id AS seq,
    CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type IN ('view', 'signup') THEN 0 END AS action,
    CAST(coalesce(value, 0) >= 20 AS INTEGER) AS reward, CAST(event_type = 'signup' AND coalesce(value, 0) < 5 AS INTEGER) AS manual,
    CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS block, CAST(day(ts) % 2 AS INTEGER) AS state FROM events))
"""
