"""The log as a stream: session states that follow an append-only folder. An extension; the batch form defines the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechmill import schemas
from speechmill.operators.sessions import session_states


def log_stream(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """Records of JSON Lines files as they appear; each has to carry its ``seq``."""
    return spark.readStream.schema(f"seq BIGINT, {schemas.LOG}").option("maxFilesPerTrigger", most_files).json(folder)


def live_states(log: DataFrame) -> DataFrame:
    """One row per session, for output mode "complete" or "update": the last field record counts by ``seq``, whenever it arrives."""
    return session_states(log)
