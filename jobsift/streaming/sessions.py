"""The session fold on an unbounded event log (Structured Streaming).

Actions arrive as files; a session closes after ``gap`` without actions
(the reference ends a session when its list runs out; the gap is ours).
Late events beyond the watermark are dropped.  Output is append-only: a
session is emitted once the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.functions.codes import ACTION_VIEW


#: later than any event, with room for the gap and the watermark
END_OF_INPUT = "2200-01-01 00:00:00"


def action_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event files as a stream; vacancy id and action type as in the
    interaction view."""
    ev = spark.readStream.schema(schema).parquet(path)
    return ev.filter(F.col("event_type").isin("purchase", "view", "click")).select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("action_dt"),
        F.get_json_object("props", "$.k").cast("bigint").alias("vacancy_id"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 2)
        .otherwise(3).alias("action_type"))


def fold_sessions_stream(actions: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour",
                         skip_views: bool = False) -> DataFrame:
    """Per (user, session window): actions in order as parallel arrays."""
    a = actions.filter(F.col("action_type") != ACTION_VIEW) if skip_views else actions
    a = a.withWatermark("action_dt", watermark)
    g = a.groupBy("user_id", F.session_window("action_dt", gap).alias("session")).agg(
        F.array_sort(F.collect_list(F.struct("action_dt", "event_id", "vacancy_id", "action_type"))).alias("s"))
    return g.select("user_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
                    F.transform("s", lambda x: x["vacancy_id"]).alias("vacancy_id"),
                    F.transform("s", lambda x: x["action_type"]).alias("action_type"))


def with_end_of_input(actions: DataFrame, path: str) -> DataFrame:
    """The stream and, after it, one row of no user far in the future, written
    to ``path``: it moves the watermark past every real session, so those that
    are open when the input ends are emitted too.  Only for inputs that end."""
    spark = actions.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in actions.schema.fields}
    end = spark.range(1).select(*[
        (F.lit(END_OF_INPUT) if c == "action_dt" else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
    end.write.parquet(path)
    return actions.unionByName(spark.readStream.schema(end.schema).parquet(path))


def fold_sessions_batch(actions: DataFrame, gap: str = "30 minutes", skip_views: bool = False) -> DataFrame:
    """The same fold on a static DataFrame (parity reference for the stream)."""
    a = actions.filter(F.col("action_type") != ACTION_VIEW) if skip_views else actions
    g = a.groupBy("user_id", F.session_window("action_dt", gap).alias("session")).agg(
        F.array_sort(F.collect_list(F.struct("action_dt", "event_id", "vacancy_id", "action_type"))).alias("s"))
    return g.select("user_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
                    F.transform("s", lambda x: x["vacancy_id"]).alias("vacancy_id"),
                    F.transform("s", lambda x: x["action_type"]).alias("action_type"))


def run_available_now(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything available, write parquet, stop."""
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
